"""Frame sampling and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sampled_indices(n_frames: Column, n: int = 8) -> Column:
    """Indices of evenly spaced frames; all of a clip of at most n."""
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * ((n_frames - 1) / F.lit(max(n - 1, 1)))).cast("int"))
    return F.when(n_frames <= n, F.sequence(F.lit(0), (n_frames - 1).cast("int"))).otherwise(even)


def sample_frames(frames: DataFrame, n: int = 8) -> DataFrame:
    """The frames of each clip that ``sampled_indices`` names; frames are numbered from 0."""
    total = F.count("*").over(W.partitionBy("video_id"))
    return frames.withColumn("_t", total).where(F.array_contains(sampled_indices(F.col("_t"), n), F.col("frame_idx").cast("int"))).drop("_t")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Frames that two clips share, trimmed to the shorter: ``value`` and ``value``_other."""
    return left.join(right.select(*keys, "frame_idx", F.col(value).alias(f"{value}_other")), [*keys, "frame_idx"])
