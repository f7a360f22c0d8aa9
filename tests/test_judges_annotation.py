"""Exact values of verdict reduction, annotation, sampling and quality control."""

import math

import numpy as np
import pytest

from framescore.operators import annotation as an
from framescore.operators import irt, judges, leaderboard, qc, sampling
from framescore.plans.queries import QUERIES

V = "item_id string, judge string, score double, violations array<string>"


def verdict(spark, scores, **how):
    rows = [("i", f"j{k}", s, ["b", "a"] if k == 0 else ["c", "a"]) for k, s in enumerate(scores)]
    return judges.ensemble(spark.createDataFrame(rows, V), **how).first()


def test_ensemble_values(spark):
    r = verdict(spark, [0.2, 0.6, 0.9])
    assert r.score == pytest.approx(0.6) and r.n_judges == 3 and r.violations == ["a", "b", "c"] and len(r.breakdown) == 3
    r = verdict(spark, [0.1, 0.9], aggregation="mean", threshold=0.2)
    assert (r.std, r.range) == (pytest.approx(0.4), pytest.approx(0.8)) and r.flagged and r.uncertainty == "high"
    assert verdict(spark, [0.4, 0.7, 0.8], aggregation="majority").score == pytest.approx(2 / 3)
    r = verdict(spark, [None, 0.7])
    assert r.score == 0.7 and r.n_judges == 1 and r.violations == ["a", "c"] and r.uncertainty == "high"
    r = verdict(spark, [None, None])
    assert r.score is None and r.n_judges == 0 and not r.flagged and r.uncertainty == "high"
    with pytest.raises(ValueError):
        verdict(spark, [0.1], aggregation="max")
    with pytest.raises(ValueError):
        judges.require_judges([])


def test_routing(spark):
    a = spark.createDataFrame([("x", 0.5, "analytic", None, []), ("y", None, "intractable", None, []), ("z", None, "intractable", None, [])], "item_id string, score double, verifier_type string, uncertainty string, violations array<string>")
    f = spark.createDataFrame([("y", 0.9, None, "mllm", ["v"])], "item_id string, score double, uncertainty string, judge_type string, violations array<string>")
    got = {r.item_id: (r.score, r.judge_type, r.uncertainty) for r in judges.route(a, f).collect()}
    assert got == {"x": (0.5, "analytic", None), "y": (0.9, "mllm", "high"), "z": (None, "none", "high")}
    got = {r.item_id: (r.judge_type, r.uncertainty) for r in judges.route(a, None, label_style="domain").collect()}
    assert got == {"x": ("analytic", "low"), "y": ("none", "high"), "z": ("none", "high")}


def test_agreement_is_padded_with_the_first_vote(spark):
    votes = {"i0": [0, 0, 0], "i1": [1, 1, 0], "i2": [0, 1, 2], "i3": [0]}
    df = spark.createDataFrame([(k, i, v) for k, x in votes.items() for i, v in enumerate(x)], "item_id string, arrival int, vote int")
    got = {r.item_id: (round(r.share, 4), r.passed) for r in an.agreement(df, threshold=0.5).collect()}
    assert got == {"i0": (1.0, True), "i1": (0.6667, True), "i2": (0.3333, False), "i3": (1.0, True)}
    assert an.panel_kappa(df).first().n_pairs == 3
    assert all(r.share == 1.0 for r in an.agreement(df.where("arrival = 0")).collect())


def test_kappa(spark):
    a, b = [0, 1, 1, 2, 0, 1], [0, 1, 0, 2, 0, 2]
    po = np.mean([x == y for x, y in zip(a, b)])
    pe = sum(np.mean(np.array(a) == k) * np.mean(np.array(b) == k) for k in range(3))
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert an.cohen_kappa(df).first().kappa == pytest.approx((po - pe) / (1 - pe))
    assert an.cohen_kappa(df.limit(0)).first().kappa == 0.0
    assert an.cohen_kappa(spark.createDataFrame([(1, 1)], "a int, b int")).first().kappa is None


def test_queue_and_prior(spark):
    q = spark.createDataFrame([("t", k, f"a{k}", k) for k in range(5)] + [("u", 1, "a", 7)], "task_id string, arrival int, annotator_id string, answer_idx int")
    tasks, late = an.review_queue(q)
    got = {r.task_id: (r.votes, r.done) for r in tasks.collect()}
    assert got == {"t": ([0, 1, 2], True), "u": ([7], False)} and late.count() == 2
    trials = spark.createDataFrame([("i1", "d", 1, 1), ("i1", "d", 1, None), ("i2", "d", 0, 0)], "item_id string, domain string, answer_idx int, pred int")
    assert {r.item_id: r.passed for r in an.prior_audit(trials).collect()} == {"i1": True, "i2": False}


@pytest.mark.parametrize("parts", [1, 3])
def test_flags_do_not_hang_on_the_order_of_rows(spark, tmp_path, parts):
    """An item whose mean is 11/12, so b is -2.5 and no floor; added as doubles in the first order b is below it."""
    tie = [0.0, 0.03, 0.0, 0.04, 0.02, 0.01]
    items = {1: tie, 2: sorted(tie), 3: [0.0, 0.0], 4: [0.1, 0.1], 5: [0.1, None], 6: [float("nan"), 0.1], 7: [None], 8: [-1e12, -1e12]}
    rows = [(k, 0, 7, d) for k, ds in items.items() for d in ds]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_suppkey long, l_discount double").coalesce(parts).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.item_id // 10: r for r in QUERIES["an8_irt_flags"](spark, str(tmp_path)).collect()}
    assert {k: (got[k].a, got[k].b, got[k].floor, got[k].low_disc) for k in (1, 2, 3, 4, 5)} == {1: (0.916667, -2.5, False, False), 2: (0.916667, -2.5, False, False), 3: (1.0, -3.0, True, False), 4: (0.5, 0.0, False, False), 5: (0.5, 0.0, False, False)}
    assert math.isnan(got[6].a) and got[7].a is None and got[7].floor is None and got[8].a == 5e12 + 1


def test_irt_recovers_and_improves(spark):
    rng = np.random.default_rng(0)
    theta, b = rng.normal(size=24), rng.normal(size=12)
    rows = [(int(m), int(i), int(rng.random() < 1 / (1 + np.exp(-1.5 * (theta[m] - b[i]))))) for m in range(24) for i in range(12)]
    responses = spark.createDataFrame(rows, "model_id int, item_id int, correct int").cache()
    items, models = irt.fit_2pl(responses, rounds=6)
    got = {r.item_id: r.b for r in items.collect()}
    assert np.corrcoef([got[i] for i in range(12)], b)[0, 1] > 0.8
    start = irt.objective(responses, items.selectExpr("item_id", "1.0D as a", "0.0D as b"), models.selectExpr("model_id", "0.0D as theta"))
    assert irt.objective(responses, items, models) > start
    one = irt.fit_2pl(responses.where("model_id = 0"))[0].collect()
    assert all(r.a == 1.0 and r.b == 0.0 for r in one)


def test_quotas_follow_the_rounds():
    def rounds(counts, config, target):
        order = [d for d in config if d in counts] + sorted(set(counts) - set(config))
        take = {d: min(config.get(d, (0, 1.0))[0], counts[d]) for d in order}
        most = {d: min(counts[d], int(config[d][1] * target) if d in config else target) for d in order}
        while sum(take.values()) < target and any(take[d] < most[d] for d in order):
            for d in order:
                if take[d] < most[d] and sum(take.values()) < target:
                    take[d] += 1
        return take

    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {d: int(rng.integers(0, 40)) for d in "abcdef"}
        config = {d: (int(rng.integers(0, 10)), float(rng.choice([0.1, 0.2, 0.5]))) for d in "abcd"}
        target = int(rng.integers(0, 120))
        assert sampling.quotas(counts, config, target) == rounds(counts, config, target)


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i % 5 == 0 else "x") for i in range(50)], "item_id int, domain string, physics_category string")
    got = sampling.audit_sample(df, 0.3).groupBy("domain", "physics_category").count().collect()
    assert {(r.domain, r.physics_category): r["count"] for r in got} == {("a", "unknown"): 2, ("a", "x"): 6, ("b", "unknown"): 2, ("b", "x"): 6}
    with pytest.raises(ValueError):
        sampling.audit_sample(df, 0)


def test_saturation_and_drift(spark):
    s = spark.createDataFrame([("a", "m", x) for x in (0.95, 0.92, 0.99, 0.1)] + [("b", "m", x) for x in (0.95, 0.92, 0.5)] + [("c", "m", 1.0)], "item_id string, model_id string, score double")
    assert [r.item_id for r in qc.saturated(s).collect()] == ["a"]
    h = spark.createDataFrame([("2024-01-15", 0.2), ("2024-05-01", 0.3), ("2024-08-01", 0.4)], "date string, quality_index double").selectExpr("cast(date as date) date", "quality_index")
    assert qc.drift(h).first().verdict == "refresh_items" and qc.drift(h.limit(0)).first().verdict == "insufficient_data"


def test_leaderboard(spark):
    s = spark.createDataFrame([("m", "U.accuracy", 3 / 7), ("n", "U.accuracy", 5 / 7)], "model_id string, metric string, value double")
    got = {r.model_id: round(r.quality_index, 6) for r in leaderboard.index(s).collect()}
    assert got == {"m": 0.128571, "n": 0.214286}
    x, y = (1, 2, 2, 5, 7), (3, 1, 4, 4, 9)
    s = spark.createDataFrame([(k, "U.accuracy", float(v)) for k, v in enumerate(x)], "model_id int, metric string, value double")
    dv = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "model_id int, rate double")
    assert leaderboard.spearman_validity(s, dv).first().rho == pytest.approx(0.763158, abs=1e-6)
    assert leaderboard.spearman_validity(s, dv.where("model_id < 2")).count() == 0


def test_irt_tells_that_rounds_cut_the_fit_off(spark):
    responses = spark.createDataFrame([(m, i, int((m * 7 + i * 3) % 5 < 2 + m % 2)) for m in range(6) for i in range(4)], "model_id int, item_id int, correct int")
    assert not any(r.converged for r in irt.fit_2pl(responses, rounds=1)[0].collect())
    assert any(r.converged for r in irt.fit_2pl(responses, rounds=3, tolerance=10.0)[0].collect())
