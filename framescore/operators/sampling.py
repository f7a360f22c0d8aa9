"""Stratified and audit samples. Order within a stratum is a hash of seed and item, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int, item: str = "item_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")))


def quotas(counts: dict[str, int], config: dict[str, tuple[int, float]], target: int) -> dict[str, int]:
    """How many of each domain: its floor first (whatever the target), then one each in rounds up to the target, a domain
    stopping at its cap or when it is empty. Domains go in the order of ``config``, others by name after them."""
    order = [d for d in config if d in counts] + sorted(set(counts) - set(config))
    take = {d: min(config.get(d, (0, 1.0))[0], counts[d]) for d in order}
    most = {d: min(counts[d], int(config[d][1] * target) if d in config else target) for d in order}
    left = target - sum(take.values())
    while left > 0:
        able = [d for d in order if take[d] < most[d]]
        if not able:
            break
        rounds = min(left // len(able), min(most[d] - take[d] for d in able))
        for d in able if rounds else able[:left]:
            take[d] += max(rounds, 1)
            left -= max(rounds, 1)
    return take


def stratified_sample(items: DataFrame, config: dict[str, tuple[int, float]], target: int, seed: int = 42) -> DataFrame:
    """``config``: domain to (min_samples, max_fraction). Items without a domain are left out."""
    rows = items.where(F.col("domain").isNotNull())
    counts = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}  # a row a domain
    take = quotas(counts, config, target)
    spark = items.sparkSession
    quota = spark.createDataFrame(sorted(take.items()) or [("", 0)], "domain string, quota long")
    w = W.partitionBy("domain").orderBy(seeded(seed), "item_id")
    first = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(take.values(), default=0))  # a literal: tasks cut before the shuffle
    return first.join(quota, "domain").where(F.col("rn") <= F.col("quota")).drop("rn", "quota")


def audit_sample(items: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Of each domain and physics category at least one, else the rounded share (half to even)."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    rows = items.withColumn("domain", F.coalesce(F.col("domain").cast("string"), F.lit("unknown"))).withColumn("physics_category", F.coalesce(F.col("physics_category").cast("string"), F.lit("unknown")))
    keys = ["domain", "physics_category"]
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction)).cast("long")).alias("k"))
    w = W.partitionBy(*keys).orderBy(seeded(seed), "item_id")
    return rows.join(sizes, keys).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("k")).drop("rn", "k")
