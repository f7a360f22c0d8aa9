"""Pixel kernels and clip measures: identities, orderings, brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.functions.frames import sampled_indices
from framescore.operators.video import control, frames, kernels as K, physics, quality

FRAMES = "video_id string, frame_idx int, height int, width int, gray array<double>"


def clip(spark, **videos):
    rows = [(k, i, v.shape[1], v.shape[2], f.ravel().tolist()) for k, v in videos.items() for i, f in enumerate(v)]
    return spark.createDataFrame(rows, FRAMES)


def square(n, size, place):
    out = np.full((n, size, size), 0.05)
    for i in range(n):
        x, y = place(i)
        out[i, y : y + 12, x : x + 12] = 1.0
    return out


RNG = np.random.default_rng(1)
STEADY = square(12, 64, lambda i: (4 * i, 20))
JUMPS = square(12, 64, lambda i: tuple(int(v) for v in np.random.default_rng(i).integers(0, 50, 2)))
FLICKER = np.stack([np.hstack([np.full((48, 24), a), np.full((48, 24), 1 - a)]) for a in (0.9, 0.1) * 4])
NOISE = RNG.random((8, 64, 64))


def test_blobs_equal_flood_fill():
    for _ in range(30):
        mask = RNG.random((9, 11)) < 0.4
        seen, n = np.zeros_like(mask), 0
        for i, j in zip(*np.nonzero(mask)):
            if seen[i, j]:
                continue
            stack, size = [(i, j)], 0
            seen[i, j] = True
            while stack:
                a, b = stack.pop()
                size += 1
                for y in range(max(0, a - 1), min(9, a + 2)):
                    for x in range(max(0, b - 1), min(11, b + 2)):
                        if mask[y, x] and not seen[y, x]:
                            seen[y, x] = True
                            stack.append((y, x))
            n += size >= 3
        assert K.blobs(mask, 3) == n


def test_identities():
    assert K.ssim(NOISE[0], NOISE[0]) == pytest.approx(1) and K.ssim(NOISE[0, :5], NOISE[0, :5]) is None
    assert K.iou(STEADY[0] > 0.5, STEADY[0] > 0.5) == 1 and K.laplacian_variance(np.full((5, 5), 0.3)) == 0
    assert K.gaussian(np.full((9, 9), 0.4), 2.0) == pytest.approx(0.4)
    assert K.to_gray(np.ones((2, 2, 3))) == pytest.approx(1)


def test_orderings_and_chunks(spark):
    df = clip(spark, steady=STEADY, jumps=JUMPS, flicker=FLICKER, noise=NOISE, still=np.repeat(STEADY[:1], 8, 0))
    m = frames.measures(df, chunk=5).cache()
    whole = frames.measures(df)
    key = lambda x: {(r.video_id, r.frame_idx): (r.gap, r.blobs, r.x, r.how) for r in x.collect()}
    assert key(m) == key(whole)
    blob = {r.video_id: r.blob_count_stability for r in quality.blob_stability(m).collect()}
    depth = {r.video_id: r.depth_stability for r in quality.depth_stability(m).collect()}
    smooth = {r.video_id: r.motion_smoothness for r in quality.quality(m).collect()}
    assert blob["steady"] >= blob["noise"] and depth["still"] == 1.0 > depth["flicker"] and smooth["still"] == 1.0 > smooth["noise"]
    t = {}
    for r in physics.centroids(m).orderBy("t").collect():
        t.setdefault(r.video_id, []).append((r.x, r.y))
    assert t["still"] == [(0.0, 0.0)] * 7 and len(t["steady"]) == 11


def test_falling_square_is_gravity_aligned(spark):
    falling = square(16, 96, lambda i: (40, int(8 + 0.25 * i * i)))
    traj = physics.centroids(frames.measures(clip(spark, falling=falling)))
    a = physics.curvature(traj).first().a
    points = traj.orderBy("t").toPandas()
    assert a == pytest.approx(np.polyfit(points.t, points.y, 2)[0]) and a > 1e-3
    checks = physics.motion_checks(traj).first()
    speed = np.hypot(np.diff(points.x), np.diff(points.y))
    assert checks.jumps == (speed > 5 * (np.median(speed) + 1e-6)).sum() and checks.spikes == (np.abs(np.diff(speed)) > 0.6 * (np.median(speed) + 1e-6)).sum()


def test_prepare_and_fluid(spark):
    rgb = (RNG.random((3, 6, 5, 3)) * 255).astype(np.uint8)
    rows = [("a", i, 6, 5, bytearray(f.tobytes())) for i, f in enumerate(rgb)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, pixels binary")
    arrays = spark.createDataFrame([(*r[:4], [float(x) for x in r[4]]) for r in rows], "video_id string, frame_idx int, height int, width int, pixels array<double>")
    a, b = (frames.prepare(x).orderBy("frame_idx").collect() for x in (df, arrays))
    assert [r.gray for r in a] == [r.gray for r in b] and a[0].gray == pytest.approx(K.to_gray(rgb[0] / 255).ravel().tolist())
    drift = physics.fluid_mass(clip(spark, n=NOISE)).first()
    areas = [(f > NOISE.mean() + NOISE.std()).sum() for f in NOISE]
    assert drift.mass_drift == pytest.approx((max(areas) - min(areas)) / max(areas))


def test_vorticity_is_the_exact_percentile(spark):
    u, v = RNG.normal(size=(2, 5, 16, 12)) * 3
    rows = [("a", i, 16, 12, u[i].ravel().tolist(), v[i].ravel().tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, u array<double>, v array<double>")
    want = np.percentile(np.abs(np.gradient(u, axis=1) - np.gradient(v, axis=2)), 99)
    assert physics.vorticity(df).first().curl_p99 == pytest.approx(want)
    d = np.linalg.norm(np.diff(np.stack([u, v], -1), axis=0), axis=-1).mean()
    assert quality.flow_smoothness(df).first().flow_smoothness == pytest.approx(1 / (1 + d))
    assert quality.flow_smoothness(df.where("frame_idx < 1")).first().flow_smoothness == 1.0


def test_control_identity_and_diversity(spark):
    df = clip(spark, a=NOISE).withColumn("edges", F.transform("gray", lambda x: F.when(x > 0.5, 1).otherwise(0))).withColumn("mask", F.col("edges")).withColumn("depth", F.col("gray"))
    one = lambda x, c: getattr(x(df, df, ["video_id"]).first(), c)
    assert one(control.blur_ssim, "blur_ssim") == pytest.approx(1) and one(control.edge_f1, "edge_f1") == 1 and one(control.mask_miou, "mask_miou") == 1 and one(control.depth_si_rmse, "depth_si_rmse") == pytest.approx(1)
    both = clip(spark, a=NOISE, b=1 - NOISE, c=NOISE[:3]).withColumn("item", F.lit(1)).withColumnRenamed("video_id", "variant")
    n = NOISE
    want = np.mean([np.abs(2 * n - 1).mean(), 0, np.abs(1 - 2 * n[:3]).mean()])
    assert control.diversity(both, ["item"]).first().diversity == pytest.approx(want)
    assert control.diversity(both.where("variant = 'a'"), ["item"]).first().diversity == 0


def test_verdict_routing(spark):
    base = "1.0D gravity_y, cast(null as bigint) expected_collisions, 0L spikes, 0L jumps, true friction_ok, false reflection_ok, -1.0D cos, true mass_ok, 0.1D mass_drift, true curl_ok, 0.0D curl_p99, true surface_ok, 0.0D jitter"
    extra = "map('flow_smoothness', 0.1D, 'pose_validity', cast(null as double)) supplementary"
    rows = spark.createDataFrame([("rigid_body", 9), ("rigid_body", 3), ("contact", 9), ("fluid", 0), ("thermal", 9)], "physics_category string, n_centroids int").selectExpr("*", "0.5D a", *base.split(", "), extra)
    got = [(r.score, r.passed, r.violations, r.verifier_type) for r in physics.verdicts(rows).collect()]
    assert got[0] == (0.75, True, ["flow_smoothness_low_0.10"], "analytic")
    assert got[1] == (0.0, False, ["insufficient_motion"], "analytic")
    assert got[2][0] == 0.5 and got[2][2] == ["reflection_implausible_cos_-1.00", "flow_smoothness_low_0.10"]
    assert got[3][0] == 0.75 and got[3][3] == "heuristic" and got[4] == (None, False, [], "intractable")


def test_sampled_indices(spark):
    got = [r[0] for r in spark.createDataFrame([(9,), (22,), (50,), (3,)], "t int").select(sampled_indices(F.col("t"))).collect()]
    assert got == [[0, 1, 2, 3, 4, 5, 6, 8], [0, 3, 6, 9, 12, 15, 18, 21], [0, 7, 14, 21, 28, 35, 42, 49], [0, 1, 2]]


def test_pose(spark):
    rows = [("a", f, k, float(k % 5), float(k)) for f in range(3) for k in range(32)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, landmark int, x double, y double")
    assert quality.pose_validity(df).first().pose_validity == 1.0
    assert quality.pose_validity(df.where("frame_idx = 0")).first().pose_validity is None


def test_no_prompt_is_half_and_small_frames_are_null(spark):
    features = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [1.0, 0.0])], "video_id string, frame_idx int, feature array<double>")
    prompts = spark.createDataFrame([("a", [1.0, 0.0])], "video_id string, vector array<double>")
    got = {r.video_id: r.overall_consistency for r in quality.prompt_consistency(features, prompts).collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.5}
    assert control.blur_ssim(clip(spark, a=NOISE[:2, :5, :5]), clip(spark, a=NOISE[:2, :5, :5]), ["video_id"]).first().blur_ssim is None
