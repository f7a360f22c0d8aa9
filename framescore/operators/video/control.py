"""Fidelity of generated clips to references, and diversity of variants. Both sides: keys, frame_idx and arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.functions.frames import aligned
from framescore.operators.video import kernels as K
from framescore.operators.video.quality import clip01


def _per_frame(function):
    """Pandas UDF of (array, array, height, width): a number, or null, a row."""

    def run(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([function(np.asarray(x, float).reshape(y, z), np.asarray(q, float).reshape(y, z)) for x, q, y, z in zip(a, b, h, w)], dtype="float64")

    return F.pandas_udf(run, "double")


def blur_ssim(generated: DataFrame, reference: DataFrame, keys: list[str], sigma: float = 2.0) -> DataFrame:
    """Mean similarity of blurred frames, clipped; null where frames are under 7 pixels."""
    one = _per_frame(lambda a, b: K.ssim(K.gaussian(a, sigma), K.gaussian(b, sigma)))
    rows = aligned(generated, reference, keys, "gray")
    return rows.withColumn("s", one("gray", "gray_other", "height", "width")).groupBy(*keys).agg(clip01(F.avg("s")).alias("blur_ssim"))


def edge_f1(generated: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Mean F1 of edge maps (``edges``: array of 0 or more)."""
    rows = aligned(generated, reference, keys, "edges")
    both = F.zip_with("edges", "edges_other", lambda a, b: F.when((a > 0) & (b > 0), 2).when((a > 0) | (b > 0), 1).otherwise(0))
    tp = F.size(F.filter("both", lambda x: x == 2))
    one = F.size(F.filter("both", lambda x: x == 1))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + one), F.lit(0.0))
    return rows.withColumn("both", both).withColumn("f", f1).groupBy(*keys).agg(clip01(F.avg("f")).alias("edge_f1"))


def depth_si_rmse(generated: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """1 / (1 + mean deviation of log depth ratios) (``depth``: array)."""

    def one(a, b):
        d = np.log(a + 1e-3) - np.log(b + 1e-3)
        return float(np.sqrt(max(0.0, (d**2).mean() - d.mean() ** 2)))

    rows = aligned(generated, reference, keys, "depth")
    return rows.withColumn("r", _per_frame(one)("depth", "depth_other", "height", "width")).groupBy(*keys).agg((1 / (1 + F.avg("r"))).alias("depth_si_rmse"))


def mask_miou(generated: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over frames of mean intersection over union of labels (``mask``: array)."""
    rows = aligned(generated, reference, keys, "mask")
    return rows.withColumn("i", _per_frame(K.iou)("mask", "mask_other", "height", "width")).groupBy(*keys).agg(clip01(F.avg("i")).alias("mask_miou"))


def diversity(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of pairs of variants on their shared frames, clipped; 0 with under two. ``variants``: keys, variant,
    frame_idx, gray; an item has few variants."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.abs(np.asarray(x, float) - np.asarray(y, float)).mean()) for x, y in zip(a, b)], dtype="float64")

    other = variants.select(*keys, "frame_idx", F.col("variant").alias("variant2"), F.col("gray").alias("gray2"))
    pairs = variants.join(other, [*keys, "frame_idx"]).where("variant < variant2").withColumn("d", distance("gray", "gray2")).groupBy(*keys, "variant", "variant2").agg(F.avg("d").alias("d"))
    return variants.select(*keys).distinct().join(pairs.groupBy(*keys).agg(F.avg("d").alias("d")), keys, "left").select(*keys, F.coalesce(clip01(F.col("d")), F.lit(0.0)).alias("diversity"))
