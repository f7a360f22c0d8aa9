"""Exact values of track scoring, worked out by hand."""

import random

import pytest

from framescore.functions import text as T
from framescore.operators import tracks
from framescore.operators.predict import constant_model, constant_predictions, requests, run_model
from pyspark.sql import functions as F


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, domain string, physics_category string, answer_idx int, chain_id string, hop_index int, language_prior_score double")


def preds(spark, rows):
    return spark.createDataFrame(rows, "model_id string, item_id string, answer_idx int, seq long")


def test_chain_with_one_wrong_hop(spark):
    i = items(spark, [(x, "robotics", "contact", 0, "c", k, 0.1 + 0.6 * (k == 2)) for k, x in enumerate("abc")] + [("d", "sports_biomechanics", "fluid", 1, None, None, 0.0)])
    p = preds(spark, [("m", "a", 0, 1), ("m", "b", 2, 2), ("m", "c", 3, 3), ("m", "c", 0, 4), ("m", "zz", 0, 5)])
    acc = {(r.scope, r.scope_value): (r.accuracy, r.n) for r in tracks.accuracy(i, p).collect()}
    assert acc[("overall", None)] == (pytest.approx(2 / 3), 3) and ("domain", "sports_biomechanics") not in acc
    r = tracks.chain_summary(tracks.chains(i, p)).first()
    assert (r.n_chains, r.multihop_chain_accuracy, r.error_propagation_rate, r.mean_first_error_hop) == (1, 0.0, 1.0, 1.0)
    assert tracks.prior_leaks(i).first().n_leaky == 1


def test_full_chain_and_missing_answer(spark):
    i = items(spark, [(x, "robotics", "contact", 1, "c", k, 0.0) for k, x in enumerate("abc")])
    p = preds(spark, [("m", x, 1, 1) for x in "abc"] + [("n", x, 1, 1) for x in "bc"])
    got = {r.model_id: (r.chain_ok, r.first_error_hop) for r in tracks.chains(i, p).collect()}
    assert got == {"m": (1, None), "n": (0, 0)}


def test_counterfactual_matches(spark):
    df = spark.createDataFrame(
        [("It fills much less and slower than before.", "slower", "much_less", "slower filling"), ("faster and slower", "faster", "same", ""), (None, None, None, "x"), ("once upon a time", "up", "much_more", "a time upon")], "p string, d string, m string, o string"
    )
    out = df.select(T.direction_match(F.col("p"), F.col("d")).alias("d"), T.magnitude_match(F.col("p"), F.col("m")).alias("m"), T.entailment(F.col("p"), F.col("o")).alias("e")).collect()
    assert [(r.d, r.m, r.e) for r in out] == [(True, True, 0.5), (False, False, 0.0), (False, False, 0.0), (True, False, 1.0)]


def test_judge_replies(spark):
    df = spark.createDataFrame([("Score: 0.75 of 1",), ("10/10",), ("none",), (None,), ('text {"a": {"b": 1}} end',)], "r string")
    assert [r[0] for r in df.select(T.judge_score(F.col("r"))).collect()] == [0.75, 1.0, 0.5, None, 1.0]
    assert df.select(T.draft_json(F.col("r"))).collect()[4][0] == '{"a": {"b": 1}}'


def test_generation_keeps_null_verdicts(spark):
    rows = spark.createDataFrame([("m", "robotics", "fluid", 0.5, 1.0), ("m", "robotics", "thermal", 0.7, None), ("m", "sports_biomechanics", "thermal", 0.9, None)], "model_id string, domain string, physics_category string, quality double, verdict double")
    got = {(r.scope, r.scope_value): r for r in tracks.generation(rows).collect()}
    total = got[("overall", None)]
    assert total.quality_score == pytest.approx(0.7) and total.domain_score == 1.0 and total.intractable_items == 2 and total.overall == pytest.approx(0.91)
    assert got[("domain", "sports_biomechanics")].domain_score is None


def test_robustness_and_conditional(spark):
    levels = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("a", 3, 0.5), ("b", 2, 1.7)], "item_id string, level int, fidelity double")
    got = {r.item_id: r.robustness for r in tracks.robustness(levels).collect()}
    assert got == {"a": pytest.approx((0.75 + 1.0) / 3), "b": 1.0}


def test_model_runs_over_requests(spark):
    i = spark.createDataFrame([("x", "v", "q", ["a", "b", "c", "d"])], "item_id string, video_path string, question string, choices array<string>")
    r = run_model(requests(i, "U"), "U", constant_model).first()
    assert (r.model_id, r.item_id, r.answer_idx) == ("baseline", "x", 0)
    assert constant_predictions(i, "U").first().answer_idx == 0
    with pytest.raises(ValueError):
        requests(i, "X")


def test_one_pass_equals_chains_and_accuracy(spark):
    """Random answers: chains of one to ninety members, hops that repeat, skip or lack, models that leave chains out, repeated and unknown answers."""
    rng = random.Random(4)
    rows, answers = [], []
    for c in range(25):
        for k in range(rng.choice([1, 2, 3, 5, 90])):
            rows.append((f"i{c}_{k}", rng.choice(["a", "b"]), "fluid", rng.randrange(2), rng.choice([f"c{c}"] * 9 + [None, ""]), rng.choice([k, k, k // 2, None, k + 3]), 0.0))
    for m in "mnop":
        for i in rows:
            if m == "n" and i[4] in ("c1", "c2", "c3") or rng.random() < 0.1:
                continue
            for s in range(rng.choice([1, 1, 2])):
                answers.append((m, i[0], i[3] if rng.random() < (1.0 if m == "o" else 0.8) else rng.choice([None, 9]), s))
    answers += [("q", "unknown", 1, 0)]
    i, p = items(spark, rows), preds(spark, answers)
    want = {r.model_id: r for r in tracks.chain_summary(tracks.chains(i, p)).collect()}
    acc = {r.model_id: r for r in tracks.accuracy(i, p).where("scope = 'overall'").collect()}
    got = {r.model_id: r for r in tracks.track_summary(i, p).collect()}
    assert set(got) == set(want) == set("mnopq") and got["q"].accuracy is None
    for m, r in got.items():
        assert r.n_chains == want[m].n_chains
        for k in ("multihop_chain_accuracy", "error_propagation_rate", "mean_first_error_hop"):
            assert r[k] == pytest.approx(want[m][k]), (m, k)
        if m in acc:
            assert (r.accuracy, r.n) == (pytest.approx(acc[m].accuracy), acc[m].n)
    none = tracks.track_summary(i.where("chain_id is null"), p.where("model_id = 'm'")).first()
    assert (none.n_chains, none.error_propagation_rate, none.mean_first_error_hop) == (0, 0.0, 0.0)
    assert {r.model_id for r in tracks.understanding(i, p).collect()} == set("mnop")
    assert tracks.track_summary(i, p.limit(0)).count() == 0
