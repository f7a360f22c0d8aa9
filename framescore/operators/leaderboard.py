"""Weighted index, ranking, rank-correlation validity. Input: long scores (model_id, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.schemas import INDEX_WEIGHTS


def _index(weights: dict[str, float] | None) -> Column:
    weight = F.create_map(*(x for k, v in (weights or INDEX_WEIGHTS).items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.sum(F.col("value") * F.try_element_at(weight, F.col("metric"))), F.lit(0.0)).alias("quality_index")


def index(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(model_id, quality_index): weighted sum; what is missing adds 0, weights are not re-normalised."""
    return scores.groupBy("model_id").agg(_index(weights))


def ranking(scores: DataFrame, metrics: tuple[str, ...] = tuple(INDEX_WEIGHTS)) -> DataFrame:
    """A row a model: index, a column a metric ("." becomes "_"), best first. One pass over the scores."""
    wide = (F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m.replace(".", "_")) for m in metrics)
    return scores.groupBy("model_id").agg(_index(None), *wide).orderBy(F.desc("quality_index"), "model_id")


def _rank(keys: list[str], value: str) -> Column:
    """Average rank among equal values."""
    ties = F.count("*").over(W.partitionBy(*keys, value))
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2


def _rho(x: str, y: str) -> Column:
    """Correlation; null for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman_validity(scores: DataFrame, success: DataFrame) -> DataFrame:
    """(metric, rho, n) of each metric against ``success`` (model_id, rate), over models in both.

    Empty with under three models in ``success`` or in both; a metric that a common model lacks, or that is
    constant, is dropped."""
    common = scores.select("model_id").distinct().join(success, "model_id")
    sizes = common.agg(F.count("*").alias("common")).crossJoin(success.agg(F.count("*").alias("dv")))
    rows = scores.join(common, "model_id")
    ranked = rows.select("metric", _rank(["metric"], "value").alias("rx"), _rank(["metric"], "rate").alias("ry"))
    out = ranked.groupBy("metric").agg(_rho("rx", "ry").alias("rho"), F.count("*").alias("n")).crossJoin(F.broadcast(sizes))
    return out.where((F.col("common") >= 3) & (F.col("dv") >= 3) & (F.col("n") == F.col("common")) & F.col("rho").isNotNull()).select("metric", "rho", "n")


def predictive_validity(scores: DataFrame, dv: DataFrame, tasks: tuple[str, ...], tracks: tuple[str, ...]) -> DataFrame:
    """(track, rho): each track's main metric against the mean of the tasks' rates (missing 0), over models in both, and
    the row "mean"; a missing score is 0, a constant gives 0; empty under three models."""
    success = dv.where(F.col("task").isin(*tasks)).groupBy("model_id").agg((F.sum("rate") / len(tasks)).alias("success"))
    success = dv.select("model_id").distinct().join(success, "model_id", "left").fillna(0.0)
    models = scores.select("model_id").distinct().join(success, "model_id")
    names = F.array(*map(F.lit, tracks))
    grid = models.select("*", F.explode(names).alias("metric")).join(scores, ["model_id", "metric"], "left").fillna(0.0, ["value"])
    ranked = grid.select("metric", _rank(["metric"], "value").alias("rx"), _rank(["metric"], "success").alias("ry"))
    each = ranked.groupBy("metric").agg(F.coalesce(_rho("rx", "ry"), F.lit(0.0)).alias("rho"), F.count("*").alias("n")).where("n >= 3").select(F.col("metric").alias("track"), "rho")
    mean = each.agg(F.avg("rho").alias("rho"), F.count("*").alias("n")).where("n > 0").select(F.lit("mean").alias("track"), "rho")
    return each.unionByName(mean)


def leaderboard_markdown(scores: DataFrame, metrics: tuple[str, ...] = tuple(INDEX_WEIGHTS)) -> DataFrame:
    """(line_no, line) of the ranked table; empty cells where a model lacks a metric."""
    cols = [m.replace(".", "_") for m in metrics]
    ranked = ranking(scores, metrics)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("model_id").cast("string"), *(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).otherwise("") for c in ["quality_index", *cols])), F.lit(" |"))
    w = W.orderBy(F.desc("quality_index"), "model_id")  # a row a model
    body = ranked.select((F.row_number().over(w) + 1).alias("line_no"), row.alias("line"))
    head = "| model | index | " + " | ".join(metrics) + " |"
    rule = "|" + " --- |" * (len(metrics) + 2)
    return ranked.sparkSession.createDataFrame([(0, head), (1, rule)], "line_no int, line string").unionByName(body)
