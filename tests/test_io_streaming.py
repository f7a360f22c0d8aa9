"""Files in and out, and the review stream against the batch queue."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from framescore.operators.annotation import review_queue
from framescore.sources import items as I
from framescore.sources import results as R
from framescore.streaming.review import replay

ITEM = {"item_id": "u1", "video_path": "v.mp4", "domain": "robotics", "physics_category": "contact", "question": "what?", "choices": ["a", "b", "c", "d"], "answer_idx": 1, "requires_temporal": True, "language_prior_score": 0.1, "annotator_agreement": 0.9}


def test_items_predictions_and_faults(spark, tmp_path):
    folder = tmp_path / "items" / "U"
    folder.mkdir(parents=True)
    bad = ITEM | {"item_id": "u2", "choices": ["a"], "answer_idx": 7, "domain": "space"}
    for x in (ITEM, bad):
        (folder / f"{x['item_id']}.json").write_text(json.dumps(x, indent=1))
    df = I.read_items(spark, str(tmp_path), "U")
    good, rejected = I.validate_items(df, "U")
    assert [r.item_id for r in good.collect()] == ["u1"] and good.first().difficulty == 0.0 and good.first().tags == []
    assert rejected.first().faults == ["domain", "choices", "answer_idx"]
    with pytest.raises(Exception, match="invalid item u2"):
        I.validate_items(df, "U", "fail")[0].collect()
    with pytest.raises(ValueError):
        I.read_items(spark, str(tmp_path), "Z")
    df.write.parquet(str(tmp_path / "p" / "items" / "U"))
    assert I.read_items(spark, str(tmp_path / "p"), "U", "parquet").count() == 2
    assert I.item_union(U=df, C=df.select("item_id", "domain")).count() == 4
    (tmp_path / "preds.json").write_text(json.dumps([{"model_id": "m", "item_id": "u1", "track": "U", "prediction": {"answer_idx": 1}}, {"model_id": "m", "item_id": "c1", "track": "CF", "prediction": "some text"}, {"model_id": "m", "item_id": "c2", "track": "C", "prediction": {"video_paths_by_level": {"0": "x"}, "variant_video_paths": ["y"]}}]))
    got = I.read_predictions(spark, str(tmp_path / "preds.json")).orderBy("seq").collect()
    assert [(r.answer_idx, r.text) for r in got] == [(1, None), (None, "some text"), (None, None)] and got[2].video_paths_by_level == {"0": "x"} and got[2].variant_video_paths == ["y"]


def test_results_tree(spark, tmp_path):
    for model in ("m1", "m2"):
        (tmp_path / model).mkdir()
        (tmp_path / model / "U.json").write_text(json.dumps({"track": "U", "model_id": "other", "n_items": 7, "scores": {"accuracy": 0.75}, "per_domain": {"robotics": {"accuracy": 0.5, "n": 2}}, "per_physics_category": {}}))
    (tmp_path / "m1" / "report.json").write_text("{}")
    (tmp_path / "m2" / "C.json").write_text("{ not json")
    got = R.read_results(spark, str(tmp_path))
    assert sorted((r.model_id, r.track) for r in got.collect()) == [("m1", "U"), ("m2", "U")]
    long = R.long_scores(got)
    assert sorted((r.scope, r.metric, r.value) for r in long.where("model_id = 'm1'").collect()) == [("domain", "accuracy", 0.5), ("domain", "n", 2.0), ("overall", "accuracy", 0.75)]
    R.write_scores(R.wire_scores(long, got.select("model_id", "track", "n_items")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    R.write_markdown(got.where("model_id = 'm1'"), str(tmp_path / "md"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines == ["## Track U", "- n_items: 7", "- **accuracy**: 0.7500", "", "### Per-domain", "- robotics: accuracy=0.500, n=2.000"]
    work = spark.createDataFrame([("m1", "U"), ("m3", "U")], "model_id string, track string")
    assert [r.model_id for r in R.pending(work, got).collect()] == ["m3"] and R.resumed(got, got).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, i, f"a{i % 3}", i % 4) for i in range(60)]
    schema = "task_id long, arrival long, annotator_id string, answer_idx int"
    for k in range(4):  # four micro-batches in order of arrival
        spark.createDataFrame(rows[k * 15 : (k + 1) * 15], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sent = replay(source, folder=str(tmp_path / "stream"))
    batch, late = review_queue(spark.createDataFrame(rows, schema))
    assert {r.task_id: r.votes for r in sent.where("not late").collect()} == {r.task_id: r.votes for r in batch.where("done").collect()}
    assert sent.where("late").count() == late.count()


CHECKED = ("flagship_ranking", "a2_accuracy", "a9_counterfactual", "jg1_median", "an2_review_stream", "an4_agreement", "l4_validity", "v12_v14_motion_checks", "v1_consistency")


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_sql_has_its_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
