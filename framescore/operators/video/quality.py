"""Clip quality from frame measures and features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framescore.operators.video.frames import neighbours


def clip01(c: Column) -> Column:
    """``c`` between 0 and 1; null stays null, which least and greatest would pass over."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


@F.pandas_udf(DoubleType())
def unit_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dot product of vectors divided by their norms (+1e-8); null where one is null."""
    norm = lambda x: x / (np.sqrt((x * x).sum()) + 1e-8)
    return pd.Series([None if x is None or y is None else float(norm(np.asarray(x, float)) @ norm(np.asarray(y, float))) for x, y in zip(a, b)], dtype="float64")


def consistency(features: DataFrame, value: str = "feature") -> DataFrame:
    """(video_id, consistency): mean cosine to the first frame and to the one before, as (s + 1) / 2; 1 under two frames.
    With mean colors it is subject consistency, with pixels background consistency."""
    firsts = features.groupBy("video_id").agg(F.min_by(value, "frame_idx").alias("first"), F.min("frame_idx").alias("at"))
    rows = neighbours(features.select("video_id", "frame_idx", value), value).join(firsts, "video_id")
    step = F.when(F.col("frame_idx") > F.col("at"), 0.5 * (unit_dot("first", value) + unit_dot("prev", value)))
    return rows.withColumn("s", step).groupBy("video_id").agg(F.coalesce((F.avg("s") + 1) / 2, F.lit(1.0)).alias("consistency"))


def prompt_consistency(features: DataFrame, prompts: DataFrame) -> DataFrame:
    """(video_id, overall_consistency): mean cosine of frames with the prompt's vector, as (s + 1) / 2 clipped; 0.5
    without a prompt. ``prompts``: video_id, vector."""
    rows = features.join(prompts, "video_id", "left").withColumn("s", unit_dot("feature", "vector"))
    return rows.groupBy("video_id").agg(F.coalesce(clip01((F.avg("s") + 1) / 2), F.lit(0.5)).alias("overall_consistency"))


def quality(measured: DataFrame) -> DataFrame:
    """(video_id, motion_smoothness, aesthetic_quality, imaging_quality) from frame measures."""
    odd = F.when(F.col("frame_idx") % 2 == 1, F.col("gap"))
    return measured.groupBy("video_id").agg(
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.avg(odd)), F.lit(1.0)).alias("motion_smoothness"),
        clip01(F.avg("contrast") * 2).alias("aesthetic_quality"),
        clip01(F.avg("sharp") / 500).alias("imaging_quality"),
    )


def depth_stability(measured: DataFrame) -> DataFrame:
    """(video_id, depth_stability): share of pixel pairs whose order is the same in all frames; 1 under two frames."""
    pairs = measured.select("video_id", F.posexplode("signs").alias("pair", "s")).groupBy("video_id", "pair").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n"))
    return pairs.groupBy("video_id").agg(F.when(F.max("n") < 2, 1.0).otherwise(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("depth_stability"))


def blob_stability(measured: DataFrame) -> DataFrame:
    """(video_id, blob_count_stability): 1 / (1 + deviation of the numbers of moving blobs)."""
    return measured.groupBy("video_id").agg((1 / (1 + F.coalesce(F.stddev_pop("blobs"), F.lit(0.0)))).alias("blob_count_stability"))


def flow_smoothness(flow: DataFrame) -> DataFrame:
    """(video_id, flow_smoothness) of flow fields (video_id, frame_idx, u, v): 1 / (1 + mean length of the change between
    consecutive fields); 1 under two fields."""

    @F.pandas_udf("s double, n long")
    def change(u: pd.Series, v: pd.Series, pu: pd.Series, pv: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(u, v, pu, pv):
            if c is None:
                out.append((0.0, 0))
            else:
                x = np.hypot(np.asarray(a, float) - np.asarray(c, float), np.asarray(b, float) - np.asarray(d, float))
                out.append((float(x.sum()), len(x)))
        return pd.DataFrame(out, columns=["s", "n"])

    both = neighbours(flow.withColumn("uv", F.struct("u", "v")), "uv")
    rows = both.withColumn("c", change("u", "v", "prev.u", "prev.v")).groupBy("video_id").agg(F.sum("c.s").alias("s"), F.sum("c.n").alias("n"))
    return rows.select("video_id", F.when(F.col("n") == 0, 1.0).otherwise(1 / (1 + F.col("s") / F.greatest(F.col("n"), F.lit(1)))).alias("flow_smoothness"))


#: Joined landmarks.
SKELETON = ((11, 13), (13, 15), (12, 14), (14, 16), (23, 25), (25, 27), (24, 26), (26, 28), (11, 12), (23, 24), (11, 23), (12, 24))


def pose_validity(keypoints: DataFrame) -> DataFrame:
    """(video_id, pose_validity): 1 / (1 + mean over edges of deviation / mean length); edges need two frames and a mean
    of 1e-6; null where no edge has."""
    edges = keypoints.sparkSession.createDataFrame(SKELETON, "landmark int, other int")
    ends = keypoints.select("video_id", "frame_idx", F.col("landmark").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    bones = keypoints.join(F.broadcast(edges), "landmark").join(ends, ["video_id", "frame_idx", "other"])
    per_edge = bones.withColumn("l", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).groupBy("video_id", "landmark", "other").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"), F.count("*").alias("n"))
    cov = F.when((F.col("n") >= 2) & (F.col("m") >= 1e-6), F.col("s") / F.col("m"))
    return per_edge.groupBy("video_id").agg((1 / (1 + F.avg(cov))).alias("pose_validity"))
