"""Pairs of stored clips and variants from 8-bit frames, against whole clips and all pairs."""

from itertools import combinations

import numpy as np
import pytest

from framescore.operators import tracks
from framescore.operators.video import kernels as K, pairs

RNG = np.random.default_rng(5)


def frames(spark, **clips):
    rows = [(k, i, v.shape[1], v.shape[2], bytearray(f.tobytes()), bytearray((f.max(-1) > 200).astype(np.uint8).tobytes())) for k, v in clips.items() for i, f in enumerate(v)]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, pixels binary, edges binary")


def clip(n, h=9, w=10):
    return RNG.integers(0, 256, (n, h, w, 3)).astype(np.uint8)


def brute(a, b):
    """Measures of two clips on their shared frames."""
    out = []
    for x, y in zip(a, b):
        p, q = (((f.astype(int) @ np.array([299, 587, 114])) + 500) // 1000 for f in (x, y))
        e, r = x.max(-1) > 200, y.max(-1) > 200
        d = np.log(p / 255 + 1e-3) - np.log(q / 255 + 1e-3)
        out.append((K.ssim(K.gaussian(p / 255, 2.0), K.gaussian(q / 255, 2.0)), 2 * (e & r).sum() / (e.sum() + r.sum()), d.std(), K.iou(p > 128, q > 128)))
    s, f, d, i = np.mean(out, 0)
    return min(1.0, max(0.0, s)), f, 1 / (1 + d), i


@pytest.mark.parametrize("block", [1, 4, 16])
def test_control_scores(spark, block):
    clips = {"a": clip(7), "b": clip(5), "c": clip(11), "small": clip(2, 5, 5), "other": clip(3, 9, 12)}
    names = spark.createDataFrame([("x", "a", "b"), ("x", "c", "a"), ("y", "b", "b"), ("z", "small", "small"), ("z", "a", "other"), ("z", "a", "missing")], "model_id string, video_id string, reference_id string")
    names = names.selectExpr("concat(model_id, ':', video_id, ':', reference_id) as pair", "video_id", "reference_id")
    store = pairs.store_pairs(frames(spark, **clips), names, block=block)
    got = {r.pair: r for r in pairs.control_scores(store).collect()}
    assert set(got) == {"x:a:b", "x:c:a", "y:b:b", "z:small:small"}  # other sizes and unread clips go
    for p, (a, b) in {"x:a:b": "ab", "x:c:a": "ca", "y:b:b": "bb"}.items():
        r = got[p]
        assert r.n_frames == min(len(clips[a]), len(clips[b])) and (r.blur_ssim, r.edge_f1, r.depth_si_rmse, r.mask_miou) == pytest.approx(brute(clips[a], clips[b]))
    assert got["y:b:b"].blur_ssim == pytest.approx(1) and got["y:b:b"].edge_f1 == got["y:b:b"].mask_miou == got["y:b:b"].depth_si_rmse == 1
    assert got["z:small:small"].blur_ssim is None and got["z:small:small"].mask_miou == 1
    plan = pairs.control_scores(store)._jdf.queryExecution().executedPlan().toString()
    assert "pixels" not in "".join(line for line in plan.split("\n") if "Exchange" in line)


def test_diversity_of_forty_variants(spark):
    clips = {f"v{k}": clip(int(RNG.integers(1, 9)), 3, 4) for k in range(40)} | {"alone": clip(2), "same1": clip(3), "empty": clip(0)}
    clips["same2"] = clips["same1"]
    item = lambda n: "many" if n[0] == "v" else "one" if n in ("alone", "empty") else "same"
    names = spark.createDataFrame([(item(n), n) for n in clips] + [("none", "missing")], "item_id string, video_id string")
    got = {r.item_id: r.diversity for r in pairs.diversity(frames(spark, **clips), names).collect()}
    own = [v / 255.0 for n, v in clips.items() if n[0] == "v"]
    want = np.mean([np.abs(a[: min(len(a), len(b))] - b[: min(len(a), len(b))]).mean() for a, b in combinations(own, 2)])
    assert got == {"many": pytest.approx(want), "one": 0.0, "same": 0.0, "none": 0.0}


def test_conditional_track(spark):
    clips = {"ref": clip(6), "l0": clip(6), "l1": clip(4), "l3": clip(6), "w0": clip(5)}
    clips["same"] = clips["ref"]
    items = spark.createDataFrame([("i", "d1", "ref"), ("j", "d2", "ref"), ("k", "d2", "unread")], "item_id string, domain string, reference_id string")
    levels = spark.createDataFrame([("m", "i", 0, "l0"), ("m", "i", 1, "l1"), ("m", "i", 3, "l3"), ("m", "j", 0, "same"), ("n", "i", 1, "l1"), ("n", "k", 0, "l0"), ("n", "zz", 0, "l0")], "model_id string, item_id string, level int, video_id string")
    variants = levels.where("model_id = 'm' and item_id = 'i'").select("model_id", "item_id", "video_id")
    args = items, levels, variants, frames(spark, **clips)
    rows = {(r.model_id, r.item_id): r for r in pairs.conditional_items(*args).collect()}
    assert set(rows) == {("m", "i"), ("m", "j")}  # without level 0 or a reference there is no row
    s, f, d, i = brute(clips["l0"], clips["ref"])
    fidelity = [s, brute(clips["l1"], clips["ref"])[0], brute(clips["l3"], clips["ref"])[0]]
    r = rows[("m", "i")]
    assert (r.blur_ssim, r.edge_f1, r.depth_si_rmse, r.mask_miou, r.visual) == pytest.approx((s, f, d, i, (s + f) / 2))
    assert r.robustness == pytest.approx(((fidelity[0] + fidelity[1]) / 2 + (fidelity[1] + fidelity[2])) / 3)
    assert rows[("m", "j")].robustness == pytest.approx(1) and rows[("m", "j")].diversity == 0.0 and r.diversity > 0
    total = {(r.scope, r.scope_value): r for r in pairs.conditional_track(*args).collect()}
    for m in tracks.CONDITIONAL:
        assert total[("overall", None)][m] == pytest.approx(np.mean([x[m] for x in rows.values()])) and total[("domain", "d1")][m] == pytest.approx(r[m])
