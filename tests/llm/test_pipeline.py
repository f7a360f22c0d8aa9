"""Each stage of the pipeline against a brute-force version, on its own input."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import psutil
from pyspark import SparkContext

import corpus_pipeline
from framescore.llm.common import released, written
from test_language_pii import brute_base
from test_ngram_join import brute
from test_sharding_packing import check_packing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "benchmark", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    step = written(stages["language"](spark, docs, SF))
    assert step.columns == docs.columns and step.count() > 0.99 * docs.count()
    before = rows(step)
    step = written(stages["near_copies"](spark, step, SF))
    firsts = {d for (_, d), _, c in brute([(d, r.text) for d, r in before.items()]) if d == c}
    assert step.columns == docs.columns and set(rows(step)) == firsts
    before = rows(step)
    step = written(stages["benchmark"](spark, step, SF))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = r.text.lower().split()
        grams |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    bad = set()
    for d, r in before.items():
        w = r.text.lower().split()
        if any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12)):
            bad.add(d)
    after = rows(step)
    assert step.columns == docs.columns and not bad & set(after) and len(set(before) - bad - set(after)) <= 2 and bad
    before = after
    step = written(stages["personal_data"](spark, step, SF))
    after = rows(step)
    assert step.columns == docs.columns and set(after) == set(before)
    for d, r in after.items():
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        if not brute_base(before[d].text) and "token" not in before[d].text and not any(c.isdigit() for c in before[d].text):
            assert r.text == before[d].text
    texts = defaultdict(list)
    for d, r in after.items():
        texts[d].append(r.text)
    check_packing(stages["packing"](spark, step, SF).collect(), texts)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, `a.b` int, `row` string"
PROSE = "the people of the old town walked along the river and talked about the weather and the price of bread in the market while their children played near the bridge until the evening came"


def _odd_rows():
    """Repeated rows, one doc_id with two texts, nulls in every column, near copies, columns named as the stages' own."""
    other = " ".join(reversed(PROSE.split()))
    row = lambda d, t, **k: (d, t, k.get("lang", "en"), k.get("source", "s"), None if t is None else len(t), k.get("score", 1.5), "kept", 7, "r")
    rows = [row(1, PROSE), row(1, PROSE), row(2, PROSE + " again"), row(3, other), row(3, PROSE.upper() + " " + other), row(4, None), row(5, ""), row(6, "!!! 123 ???"), row(None, other + " mail bob@example.com now"), row(None, None), row(8, f"{other[:60]} call +1 (555) 123-4567 or write ann@example.org", lang=None, source=None, score=None)]
    return rows + [(9, PROSE[:90] + " and nothing else was said about it", None, None, None, None, None, None, None)]


def test_stages_on_odd_rows(spark):
    df = spark.createDataFrame(_odd_rows(), ODD)
    stages = dict(corpus_pipeline.STAGES)
    same = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))
    learned = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "1.5D as score", "'x' as rejected", "7 as `a.b`", "'r' as `row`")
    out = stages["language"](spark, df.union(learned), SF)
    assert out.columns == df.columns
    kept = [r for r in out.where("doc_id is null or doc_id < 1000").collect()]
    want = [r for r in df.collect() if r.text and any(map(str.isalpha, r.text))]
    assert same(kept, want)  # values of other columns are their own; und texts go

    out = stages["near_copies"](spark, df, SF)
    assert out.columns == df.columns
    rows = out.collect()
    by = lambda d: sorted(r.text for r in rows if r.doc_id == d)
    assert by(1) == [PROSE] and by(2) == [] and len(by(3)) == 2 and len([r for r in rows if r.doc_id is None]) == 2
    assert {r.doc_id for r in rows} == {1, 3, 4, 5, 6, 8, 9, None}
    assert all(repr(r) in set(map(repr, df.collect())) for r in rows)
    assert same(rows, stages["near_copies"](spark, df.repartition(5), SF).collect())

    out = stages["benchmark"](spark, df, SF)
    assert out.columns == df.columns and same(out.collect(), df.collect())

    out = stages["personal_data"](spark, df, SF)
    assert out.columns == df.columns
    after = out.collect()
    assert same([(r.doc_id, r.score, r.rejected, r["a.b"], r["row"]) for r in after], [(r[0], r[5], r[6], r[7], r[8]) for r in _odd_rows()])
    assert not any("@" in (r.text or "") for r in after) and all(r.text is None or r.n_chars == len(r.text) for r in after)
    assert sum(r.text is None for r in after) == 2

    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(r.text)
    check_packing(stages["packing"](spark, df, SF).collect(), texts)
    for name, stage in stages.items():
        assert stage(spark, df.limit(0), SF).count() == 0, name


def test_run(spark, tmp_path):
    """run() is its stages one after the other; an empty table gives no piece."""
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/one/{t}.parquet")
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/one")
    docs = spark.read.parquet(f"{tmp_path}/one/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, f"{tmp_path}/one"))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda df: {r[0]: (r[1], r[2]) for r in df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).select("doc_id", "sum(length)", "max(doc_tokens)").collect()}
    assert set(key) <= set(got.columns) and total(got) == total(docs) and total(got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_workers_give_freed_memory_back():
    """A task's small blocks lie below one that is kept, where freeing them alone leaves the process as large as it was."""
    kept, size = [], lambda: psutil.Process().memory_info().rss / 1e6

    def run(batches):
        blocks = [bytes(100_000) + bytes([i % 7]) for i in range(3000)]
        kept.append(bytes(90_000) + b"x")
        yield from batches
        assert size() > before + 250
        del blocks

    before = size()
    assert list(released(run)(iter([1, 2]))) == [1, 2] and released(run).__name__ == "run"
    assert size() < before + 50


def test_stages_take_texts_in_small_batches(spark, monkeypatch):
    """Whoever reads a stage's result, no Python runs over 10,000 texts at once; no list is dealt out, which starts workers of another kind."""
    monkeypatch.setattr(SparkContext, "parallelize", None)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("language", "personal_data", "packing"):
        plan = stages[name](spark, docs, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan, name
