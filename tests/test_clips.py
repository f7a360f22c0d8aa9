"""Clips from stored 8-bit frames: states in any blocks, verdicts on known motion, the track's summary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.operators.video import clips, kernels as K, physics

FRAMES = "video_id string, frame_idx int, height int, width int, pixels binary"


def store(spark, block=clips.BLOCK, **videos):
    rows = [(k, i, v.shape[1], v.shape[2], bytearray((f * 255).astype(np.uint8).tobytes())) for k, v in videos.items() for i, f in enumerate(v)]
    return clips.store_frames(spark.createDataFrame(rows, FRAMES), block=block)


def falling(t=16, h=96, w=96):
    """A square that falls with constant acceleration."""
    out = np.full((t, h, w, 3), 0.05, np.float32)
    for i in range(t):
        y = int(8 + i * i * 0.25)
        if y + 12 <= h:
            out[i, y : y + 12, w // 2 - 6 : w // 2 + 6] = 1.0
    return out


def sliding(t=16, h=64, w=96):
    """A square that slides to the right ever more slowly."""
    out, x, v = np.full((t, h, w, 3), 0.05, np.float32), 4.0, 6.0
    for i in range(t):
        if x + 12 <= w:
            out[i, h // 2 - 6 : h // 2 + 6, int(x) : int(x) + 12] = 1.0
        x, v = x + v, v * 0.85
    return out


RNG = np.random.default_rng(2)
NOISE = RNG.random((37, 9, 11, 3)).astype(np.float32)
VIDEOS = {"falling": falling(), "sliding": sliding(), "noise": NOISE, "one": NOISE[:1], "still": np.repeat(NOISE[:1], 7, 0), "two": NOISE[:2]}


def brute(video, min_area=5):
    """The clip's scores and centroids from the whole clip at once."""
    u = (video * 255).astype(np.uint8)
    x, n = u / 255.0, len(u)
    gray = ((u.astype(int) @ np.array([299, 587, 114]) + 500) // 1000) / 255.0

    def chain(feats):
        feats = feats / (np.linalg.norm(feats, axis=1, keepdims=True) + 1e-8)
        return (np.mean([0.5 * (feats[0] @ feats[t] + feats[t - 1] @ feats[t]) for t in range(1, n)]) + 1) / 2 if n > 1 else 1.0

    gaps = [np.abs(0.5 * (x[t - 1] + x[t + 1]) - x[t]).mean() for t in range(1, n - 1, 2)]
    i, j = K.pair_indices(gray[0].size)
    order = np.sign(gray.reshape(n, -1)[:, i] - gray.reshape(n, -1)[:, j])
    moved = [K.moving(gray[t - 1], gray[t], min_area) for t in range(1, n)]
    areas = [(g > gray.mean() + gray.std()).sum() for g in gray]
    track, default = [], (0.0, 0.0) if not moved or moved[0][3] == "still" else (gray.shape[2] / 2, gray.shape[1] / 2)
    for _, a, b, how in moved:
        track.append((a, b) if how == "moved" else track[-1] if track else default)
    return {
        "subject_consistency": chain(x.mean((1, 2))),
        "background_consistency": chain(x.reshape(n, -1)),
        "motion_smoothness": max(0.0, 1 - np.mean(gaps)) if gaps else 1.0,
        "aesthetic_quality": min(1.0, x.mean(-1).std((1, 2)).mean() * 2),
        "imaging_quality": min(1.0, np.mean([K.laplacian_variance(f.astype(int).sum(-1) // 3 / 255) for f in u]) / 500),
        "depth_stability": (order == order[0]).all(0).mean() if n > 1 else 1.0,
        "blob_count_stability": 1 / (1 + np.std([m[0] for m in moved])) if moved else 1.0,
        "mass_drift": (max(areas) - min(areas)) / max(areas) if max(areas) else 0.0,
    }, track


@pytest.mark.parametrize("block, fan_in", [(16, 64), (1, 2), (3, 3)])
def test_states_in_any_blocks(spark, block, fan_in):
    found = clips.clip_states(store(spark, block, **VIDEOS), fan_in, block=block, min_area=5).cache()
    got = {r.video_id: r for r in clips.clip_scores(found).collect()}
    tracks = {}
    for r in clips.trajectories(found).orderBy("video_id", "t").collect():
        tracks.setdefault(r.video_id, []).append((r.x, r.y))
    assert set(got) == set(VIDEOS)
    for name, video in VIDEOS.items():
        want, track = brute(video)
        for k, v in want.items():
            assert got[name][k] == pytest.approx(v, abs=1e-9), (name, k)
        assert np.allclose(tracks[name], track) if track else name not in tracks


def test_stored_blocks(spark):
    rows = {(r.video_id, r.block): r for r in store(spark, 4, a=NOISE[:9], b=NOISE[:4]).collect()}
    assert {k: (r.first, r.n, len(r.pixels)) for k, r in rows.items()} == {("a", 0): (False, 4, 5), ("a", 1): (True, 4, 6), ("a", 2): (True, 1, 2), ("b", 0): (False, 4, 4)}
    plan = clips.states(store(spark, 4, a=NOISE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # pixels are not shuffled again


def verdicts(spark, kind, video, gravity=1.0, hits=0, **how):
    checked = clips.clip_checks(store(spark, v=video), **how)
    items = spark.createDataFrame([("syn", "everyday", kind, gravity, hits)], "item_id string, domain string, physics_category string, gravity_y double, expected_collisions long")
    preds = spark.createDataFrame([("m", "syn", "v"), ("m", "syn", "unreadable"), ("m", "unknown", "v")], "model_id string, item_id string, video_id string")
    rows = clips.generation_items(items, preds, checked).collect()
    assert len(rows) == 1  # clips that can't be read and unknown items go
    full = physics.verdicts(checked.withColumn("physics_category", F.lit(kind)).withColumn("gravity_y", F.lit(gravity)).withColumn("expected_collisions", F.lit(hits).cast("long"))).first()
    assert rows[0].verdict == full.score
    return rows[0], full


def test_falling_square_is_aligned_with_gravity(spark):
    row, full = verdicts(spark, "rigid_body", VIDEOS["falling"])
    assert full.verifier_type == "analytic" and full.score >= 0.5 and row.judge_type == "analytic"
    assert {"gravity_alignment", "collision_count", "no_interpenetration", "flow_smoothness"} <= set(full.checks) and full.checks["gravity_alignment"]
    assert set(full.supplementary) == {"flow_smoothness", "depth_stability", "blob_count_stability", "pose_validity"}
    assert all(v is None or 0 <= v <= 1 for v in full.supplementary.values()) and full.supplementary["pose_validity"] is None
    assert not verdicts(spark, "rigid_body", VIDEOS["falling"], gravity=-1.0)[1].checks["gravity_alignment"]


def test_sliding_square_decelerates(spark):
    _, full = verdicts(spark, "contact", VIDEOS["sliding"])
    assert full.verifier_type == "analytic" and full.score >= 0.5 and "friction_violation_speeding_up" not in full.violations


def test_other_categories_and_short_clips(spark):
    row, full = verdicts(spark, "thermal", VIDEOS["falling"])
    assert full.verifier_type == "intractable" and full.score is None and (row.verdict, row.judge_type, row.uncertainty) == (None, "none", "high")
    assert verdicts(spark, "rigid_body", VIDEOS["two"])[1].violations == ["insufficient_motion"]
    row, full = verdicts(spark, "fluid", VIDEOS["one"])
    assert full.verifier_type == "heuristic" and full.score == 1.0 and row.uncertainty == "medium"


def test_fallback_and_summary(spark):
    checked = clips.clip_checks(store(spark, **VIDEOS))
    items = spark.createDataFrame([("i", "a", "thermal", None, None), ("j", "b", "fluid", None, None)], "item_id string, domain string, physics_category string, gravity_y double, expected_collisions long")
    preds = spark.createDataFrame([("m", "i", "noise"), ("m", "j", "still"), ("m", "j", "still"), ("n", "i", "two")], "model_id string, item_id string, video_id string")
    panel = spark.createDataFrame([("m", "i", 0.25, "medium", ["odd"])], "model_id string, item_id string, score double, uncertainty string, violations array<string>")
    rows = clips.generation_items(items, preds, checked, panel).collect()
    assert sorted((r.model_id, r.item_id, r.verdict, r.judge_type) for r in rows if r.item_id == "i" or r.model_id == "n") == [("m", "i", 0.25, "ensemble"), ("n", "i", None, "none")]
    assert len([r for r in rows if r.item_id == "j"]) == 2  # repeats stay
    got = {(r.model_id, r.scope, r.scope_value): r for r in clips.generation_track(items, preds, checked, fallback=panel).collect()}
    m = [r for r in rows if r.model_id == "m"]
    whole = got[("m", "overall", None)]
    assert whole.n == 3 and whole.domain_score == pytest.approx(np.mean([r.verdict for r in m])) and whole.quality_score == pytest.approx(np.mean([r.quality for r in m]))
    assert whole.overall == pytest.approx(0.3 * whole.quality_score + 0.7 * whole.domain_score)
    assert got[("n", "overall", None)].domain_score == 0.0 and got[("n", "overall", None)].intractable_items == 1 and got[("n", "domain", "a")].domain_score is None
    assert clips.generation_track(items, preds.limit(0), checked).count() == 0
