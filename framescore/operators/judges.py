"""Reduction of judge verdicts. A null score is "unscored" and never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATIONS = ("median", "mean", "majority")


def ensemble(verdicts: DataFrame, aggregation: str = "median", threshold: float = 0.25, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """One verdict a group of judges: score over non-null verdicts, their spread, flag, uncertainty, sorted distinct union
    of violations, and the breakdown by judge. ``verdicts``: keys, judge, score, violations (array).

    All null gives a null score, no judges, high uncertainty and no flag."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {aggregation}")
    score = {"median": F.median("score"), "mean": F.avg("score"), "majority": F.avg((F.col("score") >= 0.5).cast("int"))}[aggregation]
    out = verdicts.groupBy(*keys).agg(
        score.alias("score"),
        F.count("score").alias("n_judges"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std"),
        F.coalesce(F.max("score") - F.min("score"), F.lit(0.0)).alias("range"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("score").isNotNull(), F.col("violations")))))).alias("violations"),
        F.array_sort(F.collect_list(F.struct("judge", "score"))).alias("breakdown"),
    )
    flagged = (F.col("n_judges") > 0) & (F.round("std", 9) >= threshold)  # a spread equal to the threshold, whatever the order of sums
    out = out.withColumn("flagged", flagged)
    return out.withColumn("uncertainty", F.when(F.col("flagged") | (F.col("n_judges") < 2), "high").otherwise("medium"))


def require_judges(judges: list) -> list:
    if not judges:
        raise ValueError("an ensemble needs a judge")
    return judges


def route(analytic: DataFrame, fallback: DataFrame | None, keys: tuple[str, ...] = ("item_id",), label_style: str = "hybrid") -> DataFrame:
    """The analytic verdict unless it is intractable or null, then the fallback's, else unscored.

    ``analytic``: keys, score, verifier_type, uncertainty, violations; ``fallback``: keys, score, uncertainty, judge_type,
    violations. Style "hybrid" names what answered (analytic, the fallback's own type, none); "domain" calls every
    fallback mllm with high uncertainty and an analytic verdict without uncertainty low, and routes on
    intractable alone."""
    keys_ = list(keys)
    direct = F.coalesce(F.col("verifier_type") != "intractable", F.lit(True))
    if label_style == "hybrid":
        direct = direct & F.col("score").isNotNull()
    if fallback is None:
        rows = analytic.select("*", F.lit(None).cast("double").alias("_s"), F.lit(None).cast("string").alias("_u"), F.lit(None).cast("string").alias("_j"), F.lit(None).cast("array<string>").alias("_v"), F.lit(False).alias("_has"))
    else:
        other = fallback.select(*keys_, F.col("score").alias("_s"), F.col("uncertainty").alias("_u"), F.col("judge_type").alias("_j"), F.col("violations").alias("_v"), F.lit(True).alias("_has"))
        rows = analytic.join(other, keys_, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    none = F.array().cast("array<string>")
    pick = lambda own, theirs, missing: F.when(direct, own).when(F.col("_has"), theirs).otherwise(missing)
    hybrid = label_style == "hybrid"
    return rows.select(
        *keys_,
        pick(F.col("score"), F.col("_s"), F.lit(None).cast("double")).alias("score"),
        pick(F.lit("analytic"), F.coalesce("_j", F.lit("mllm")) if hybrid else F.lit("mllm"), F.lit("none")).alias("judge_type"),
        pick(F.col("uncertainty") if hybrid else F.coalesce("uncertainty", F.lit("low")), F.coalesce("_u", F.lit("high")) if hybrid else F.lit("high"), F.lit("high")).alias("uncertainty"),
        pick(F.coalesce("violations", none), F.coalesce("_v", none), none).alias("violations"),
    )


