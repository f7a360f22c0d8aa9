"""The call ledger: failures, reruns, equal requests; judges and prior trials asked through it."""

import os
from collections import Counter

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from framescore.operators import annotation, calls, judges
from framescore.operators.predict import requests, run_model


def counting(folder, reply, fails=lambda r: False):
    """A client that leaves a file for each call."""

    def make():
        def client(request):
            with open(os.path.join(folder, f"{os.getpid()}-{id(request)}-{os.urandom(6).hex()}"), "w"):
                pass
            if fails(request):
                raise RuntimeError("quota")
            return reply(request)

        return client

    return make


def asked(spark, n):
    return spark.range(n).select(F.col("id").alias("item_id"), F.struct("id").alias("request"))


def test_rerun_asks_only_what_failed(spark, tmp_path):
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()
    n = lambda: len(list(seen.iterdir()))
    make = counting(seen, lambda r: {"score": r["id"]}, lambda r: r["id"] % 7 == 0)
    got = {r.item_id: r for r in calls.ask(asked(spark, 70), "m", make, ledger, wave=32, per_task=5).collect()}
    assert n() == 70 and len(got) == 70
    assert all((r.reply is None and r.error == "call_failed_quota") if i % 7 == 0 else (r.reply == f'{{"score": {i}}}' and r.error is None) for i, r in got.items())
    # failed calls are asked again, the others are not; without ``again`` none is
    assert calls.ask(asked(spark, 70), "m", make, ledger, again=False).count() == 70 and n() == 70
    calls.ask(asked(spark, 70), "m", make, ledger)
    assert n() == 80
    good = counting(seen, lambda r: "0.5")
    more = calls.ask(asked(spark, 77), "m", good, ledger)  # ten failed ones and seven new ones
    assert n() == 97 and more.where("error is null").count() == 77 and more.where("reply = '0.5'").count() == 17
    assert calls.ask(asked(spark, 3), "other", good, ledger).count() == 3 and n() == 100  # someone else is asked anew
    both = asked(spark, 5).union(asked(spark, 5))
    assert calls.ask(both, "twice", good, ledger).count() == 10 and n() == 105  # equal requests are one call
    assert calls.ask(asked(spark, 0), "m", good, ledger).count() == 0


def test_no_wave_and_no_task_has_more_calls_than_it_may(spark, tmp_path):
    """And requests are evaluated once, a wave reads none of another's, and the ledger has some files a wave, not one a task."""
    seen, made, ledger = tmp_path / "seen", tmp_path / "made", str(tmp_path / "ledger")
    seen.mkdir(), made.mkdir()

    def trace(folder, name):
        open(os.path.join(folder, f"{name}-{os.urandom(6).hex()}"), "w").close()

    def make():
        task = TaskContext.get()
        where = f"{task.stageId()}-{task.partitionId()}"

        def client(request):
            trace(seen, where)
            return request["q"]

        return client

    @F.udf("string")
    def question(i):
        trace(made, i)
        return f"q{i}"

    rows = spark.range(200, numPartitions=3).select((F.col("id") % 150).alias("item_id"), F.col("id")).select("id", "item_id", F.struct("item_id", question("item_id").alias("q")).alias("request"))
    got = calls.ask(rows, "m", make, ledger, wave=32, per_task=5)
    assert got.columns == ["id", "item_id", "request", "reply", "error"]
    assert sorted((r.id, r.reply) for r in got.collect()) == [(i, f"q{i % 150}") for i in range(200)]
    assert len(list(made.iterdir())) == 200
    tasks = [tuple(f.name.split("-")[:2]) for f in seen.iterdir()]
    waves = Counter(stage for stage, _ in tasks)
    assert len(tasks) == 150 and max(waves.values()) <= 32 and len(waves) <= 6 and max(Counter(tasks).values()) <= 5
    assert len(list((tmp_path / "ledger").glob("*.parquet"))) <= calls.FILES * len(waves)
    # what is left is asked, and files that hold none of it are not read
    spark.read.parquet(ledger).where("reply like '%7'").write.parquet(str(tmp_path / "part"))
    stored = rows.withColumn("call", calls.call_key("m", F.col("request")))
    stored.repartition(1).sortWithinPartitions("id").write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    left = [(n, set(files), places.collect()) for n, files, places in calls._waves(stored, calls.answered(spark, str(tmp_path / "part")), True, 4, 5, 32)]
    assert [n for n, _, _ in left] == [len(places) for _, _, places in left] and sum(n for n, _, _ in left) == 135
    assert sum(len(files) for _, files, _ in left) == len(set().union(*(files for _, files, _ in left))) == 38  # the last 50 rows repeat the first
    assert all({p.file for p in places} == files and max(Counter(p.task for p in places).values()) <= 5 for _, files, places in left)


def test_failed_judges_are_dropped(spark, tmp_path):
    def fails():
        raise_ = lambda r: 1 / 0
        return raise_

    fixed = lambda s: lambda: lambda r: f"I rate it {s}"
    verdicts = calls.judged(asked(spark, 1), {"a": fixed(0.5), "b": fails, "c": fixed(0.7)}, str(tmp_path / "l"))
    row = judges.ensemble(verdicts, "mean").first()
    assert row.n_judges == 2 and row.score == pytest.approx(0.6) and {r.score for r in row.breakdown} == {0.5, 0.7, None}
    alone = calls.judged(asked(spark, 1), {"b": fails}, str(tmp_path / "l"))
    row = judges.ensemble(alone).first()
    assert row.score is None and row.n_judges == 0 and row.uncertainty == "high"
    assert alone.first().rationale.startswith("call_failed_division")
    with pytest.raises(ValueError):
        calls.judged(asked(spark, 1), {}, str(tmp_path / "l"))


def test_language_prior_rejects_above_threshold(spark, tmp_path):
    items = spark.createDataFrame([("i1", "d", 0, "easy", list("abcd")), ("i2", "d", 0, "hard", list("abcd")), ("i3", "d", 0, "dumb", list("abcd"))], "item_id string, domain string, answer_idx int, question string, choices array<string>")

    def client():
        return lambda r: {"easy": "it is 0", "hard": 3, "dumb": "none of them"}[r["question"]]

    got = {r.item_id: (r.prior, r.passed) for r in annotation.prior_audit(calls.prior_trials(items, client, str(tmp_path / "l"), n_trials=4)).collect()}
    assert got == {"i1": (1.0, False), "i2": (0.0, True), "i3": (0.0, True)}
    none = annotation.prior_audit(calls.prior_trials(items, None, str(tmp_path / "l"))).collect()
    assert {r.prior for r in none} == {0.0}


def test_model_failures(spark, tmp_path):
    items = spark.createDataFrame([(str(i), "v", "q", list("abcd")) for i in range(14)], "item_id string, video_path string, question string, choices array<string>").withColumn("video_path", F.col("item_id"))

    def model():
        def answer(request):
            if int(request["video_path"]) % 7 == 0:
                raise ValueError("broken")
            return {"answer_idx": int(request["video_path"]) % 4, "video_paths_by_level": {"0": "x"}, "variant_video_paths": ["y"]}

        return answer

    for ledger in (None, str(tmp_path / "l")):
        got = {r.item_id: r for r in run_model(requests(items, "U"), "U", model, ledger).collect()}
        assert len(got) == 14 and got["0"].error == "call_failed_broken" and got["0"].answer_idx is None and got["7"].error
        assert (got["5"].answer_idx, got["5"].model_id, got["5"].error, got["5"].video_paths_by_level, got["5"].variant_video_paths) == (1, "unknown", None, {"0": "x"}, ["y"])
