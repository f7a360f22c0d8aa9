"""Saturated items, difficulty drift, audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def saturated(scores: DataFrame, top_n: int = 3, threshold: float = 0.9) -> DataFrame:
    """Items with ``top_n`` scores at the threshold or above (so that their top ``top_n`` all are)."""
    return scores.groupBy("item_id").agg(F.count_if(F.col("score") >= threshold).alias("n_high")).where(F.col("n_high") >= top_n).select("item_id")


def saturation_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(scope, scope_value, n): all saturated ids, and known ones by domain and by physics category."""
    known = found.join(items.select("item_id", "domain", "physics_category"), "item_id")
    parts = known.groupingSets([["domain"], ["physics_category"]], "domain", "physics_category").agg(F.grouping("domain").alias("_d"), F.count("*").alias("n"))
    parts = parts.select(F.when(F.col("_d") == 0, "domain").otherwise("physics").alias("scope"), F.coalesce(F.col("domain").cast("string"), F.col("physics_category").cast("string")).alias("scope_value"), "n")
    return found.agg(F.count("*").alias("n")).select(F.lit("overall").alias("scope"), F.lit("").alias("scope_value"), "n").unionByName(parts)


def drift(history: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(trend, n_quarters, verdict) of ``history``: date, quality_index."""
    quarter = history.select(F.concat(F.year("date"), F.lit("Q"), F.quarter("date")).alias("quarter"), "quality_index").groupBy("quarter").agg(F.avg("quality_index").alias("mean"))
    steps = quarter.withColumn("d", F.col("mean") - F.lag("mean").over(W.orderBy("quarter")))  # a row a quarter
    out = steps.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("trend"), F.count("*").alias("n_quarters"))
    verdict = F.when(F.col("n_quarters") == 0, "insufficient_data").when(F.col("trend") > threshold, "refresh_items").when(F.col("trend") < -threshold, "investigate_regression").otherwise("stable")
    return out.withColumn("verdict", verdict)


def quarterly(history: DataFrame) -> DataFrame:
    return history.select(F.concat(F.year("date"), F.lit("Q"), F.quarter("date")).alias("quarter"), "quality_index").groupBy("quarter").agg(F.avg("quality_index").alias("mean_index"), F.count("*").alias("n"))


def audit_counts(items: DataFrame, prior: float = 0.6, agreement: float = 0.8) -> DataFrame:
    return items.agg(F.count("*").alias("n_items"), F.count_if(F.col("language_prior_score") >= prior).alias("n_prior"), F.count_if(F.col("annotator_agreement") < agreement).alias("n_disagree"))
