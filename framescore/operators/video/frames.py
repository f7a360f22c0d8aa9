"""Frame tables: a row a frame. ``gray``: array of H x W values in 0..1; ``height``, ``width``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.operators.video import kernels as K

#: Frames of one clip that one task reads; longer clips are cut, with one frame of overlap at each side.
CHUNK = 256


def prepare(frames: DataFrame) -> DataFrame:
    """Adds ``gray`` and ``color`` (mean of each channel) to frames of ``pixels``: binary 8-bit RGB, or an array of RGB
    values. Values above 1.5 anywhere in the clip mean 0..255; values are clipped to 0..1."""
    binary = dict(frames.dtypes)["pixels"] == "binary"
    if binary:
        rows = frames.withColumn("_scale", F.lit(255.0))
    else:
        top = frames.groupBy("video_id").agg(F.max(F.array_max("pixels")).alias("_top"))
        rows = frames.join(top, "video_id").withColumn("_scale", F.when(F.col("_top") > 1.5, 255.0).otherwise(1.0)).drop("_top")

    @F.pandas_udf("gray array<double>, color array<double>")
    def convert(pixels: pd.Series, scale: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for p, s, a, b in zip(pixels, scale, h, w):
            x = np.frombuffer(p, np.uint8).astype(float) if binary else np.asarray(p, float)
            x = np.clip(x.reshape(a, b, 3) / s, 0, 1)
            out.append((K.to_gray(x).ravel(), x.mean((0, 1))))
        return pd.DataFrame(out, columns=["gray", "color"])

    rows = rows.withColumn("_c", convert("pixels", "_scale", "height", "width"))
    return rows.select(*frames.columns, "_c.gray", "_c.color")


def neighbours(frames: DataFrame, value: str = "gray", chunk: int = CHUNK) -> DataFrame:
    """Each frame with ``prev`` and ``next`` of its clip (null at the ends); no task sorts more than a chunk of one clip.
    Frames are numbered without gaps."""
    c, i = F.floor(F.col("frame_idx") / chunk), F.col("frame_idx") % chunk
    near = F.array_compact(F.array(c, F.when((i == 0) & (c > 0), c - 1), F.when(i == chunk - 1, c + 1)))
    w = W.partitionBy("video_id", "_chunk").orderBy("frame_idx")
    rows = frames.withColumn("_own", c).withColumn("_chunk", F.explode(near))
    rows = rows.withColumn("prev", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
    return rows.where("_chunk = _own").drop("_chunk", "_own")


MEASURES = "contrast double, sharp double, gap double, blobs int, x double, y double, how string, signs array<int>"


def measures(frames: DataFrame, min_area: int = 32, n_pairs: int = 256, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Scalars of every frame, for all metrics at once, so that pixels cross to Python once: contrast and sharpness of
    the frame, distance from the mean of its neighbours, blobs and centroid of the change from the frame before, signs
    of sampled pixel pairs."""

    @F.pandas_udf(MEASURES)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for gray, prev, nxt, h, w in batches:
            out = []
            for g, p, q, a, b in zip(gray, prev, nxt, h, w):
                x = np.asarray(g, float).reshape(a, b)
                before = None if p is None else np.asarray(p, float).reshape(a, b)
                gap = None if p is None or q is None else float(np.abs(0.5 * (before + np.asarray(q, float).reshape(a, b)) - x).mean())
                n, cx, cy, how = (None, None, None, None) if before is None else K.moving(before, x, min_area)
                i, j = K.pair_indices(a * b, n_pairs, seed)
                signs = np.sign(x.ravel()[i] - x.ravel()[j]).astype(int)
                nan = lambda v: None if v is None or np.isnan(v) else v
                out.append((float(x.std()), K.laplacian_variance(x), gap, n, nan(cx), nan(cy), how, signs))
            t = pd.DataFrame(out, columns=["contrast", "sharp", "gap", "blobs", "x", "y", "how", "signs"])
            t["blobs"] = t["blobs"].astype("Int32")
            yield t

    return neighbours(frames, chunk=chunk).withColumn("m", run("gray", "prev", "next", "height", "width")).select("video_id", "frame_idx", "height", "width", "m.*")
