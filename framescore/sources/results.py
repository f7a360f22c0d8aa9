"""Result trees, score tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.schemas import TRACK_SCORE


def read_results(spark: SparkSession, results_dir: str) -> DataFrame:
    """Track scores of ``<results>/<model>/<track>.json``: the folder names the model, unreadable files and reports are
    skipped, the last file of a model and track wins."""
    schema = T.StructType([*TRACK_SCORE.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(f"{results_dir}/*/")
    path = F.col("_metadata.file_path")
    rows = rows.withColumn("path", path).where(~F.col("path").endswith("/report.json"))
    rows = rows.where(F.col("_corrupt_record").isNull() & F.col("track").isNotNull()).drop("_corrupt_record")
    rows = rows.withColumn("model_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    last = W.partitionBy("model_id", "track").orderBy(F.desc("path"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "path")


def long_scores(scores: DataFrame) -> DataFrame:
    """(model_id, track, scope, scope_value, metric, value) of wire-form scores."""
    keys = ["model_id", "track"]
    overall = scores.select(*keys, F.lit("overall").alias("scope"), F.lit("").alias("scope_value"), F.explode("scores").alias("metric", "value"))
    out = overall
    for scope, col in (("domain", "per_domain"), ("physics", "per_physics_category")):
        nested = scores.select(*keys, F.explode(col).alias("scope_value", "m"))
        out = out.unionByName(nested.select(*keys, F.lit(scope).alias("scope"), "scope_value", F.explode("m").alias("metric", "value")))
    return out


def wire_scores(long: DataFrame, n_items: DataFrame) -> DataFrame:
    """Wire form of long scores; ``n_items``: (model_id, track, n_items)."""
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    flat = long.where("scope = 'overall'").groupBy("model_id", "track").agg(entries("metric", "value").alias("scores"))
    out = n_items.join(flat, ["model_id", "track"], "left")
    for scope, col in (("domain", "per_domain"), ("physics", "per_physics_category")):
        inner = long.where(F.col("scope") == scope).groupBy("model_id", "track", "scope_value").agg(entries("metric", "value").alias("m"))
        out = out.join(inner.groupBy("model_id", "track").agg(entries("scope_value", "m").alias(col)), ["model_id", "track"], "left")
    return out.select(*(F.col(f.name).cast(f.dataType) for f in TRACK_SCORE))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    scores.write.mode(mode).partitionBy("model_id", "track").json(path)


def markdown_report(scores: DataFrame) -> DataFrame:
    """(model_id, track, line_no, line): a report of each track's scores."""
    number = lambda v: F.format_string("%.4f", v)
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,double>"))))
    nested = lambda c, title: F.when(
        F.size(F.col(c)) > 0,
        F.concat(
            F.array(F.lit(""), F.lit(f"### {title}")),
            F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.array_join(F.transform(entries(F.element_at(c, k)), lambda e: F.format_string("%s=%.3f", e["key"], e["value"])), ", "))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("## Track "), "track"), F.concat(F.lit("- n_items: "), F.col("n_items").cast("string"))),
        F.transform(entries(F.col("scores")), lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), number(e["value"]))),
        nested("per_domain", "Per-domain"),
        nested("per_physics_category", "Per-physics-category"),
    )
    return scores.select("model_id", "track", F.posexplode(lines).alias("line_no", "line"))


def write_markdown(scores: DataFrame, path: str) -> None:
    """One text file of a report's lines in order; a report is small."""
    markdown_report(scores).coalesce(1).sortWithinPartitions("model_id", "track", "line_no").select("line").write.mode("overwrite").text(path)


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Models and tracks of ``work`` without a score yet."""
    return work.join(done.select("model_id", "track").distinct(), ["model_id", "track"], "left_anti")


def resumed(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Cached scores with those of the pending work."""
    return cached.unionByName(new.join(cached.select("model_id", "track").distinct(), ["model_id", "track"], "left_anti"))
