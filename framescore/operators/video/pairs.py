"""Generated clips against references, and variants of an item, from 8-bit frames to the conditional track's scores.

Frames of both clips of a pair are stored side by side, some consecutive frames a row: pixels are shuffled once, when they are
stored, and every measure reads its rows where they lie. Variants of an item are compared without pairs: of each pixel's
sorted values, the k-th smallest of V counts 2k - V - 1 times in the sum of all differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.operators import tracks
from framescore.operators.video import kernels as K
from framescore.operators.video.clips import BLOCK
from framescore.operators.video.quality import clip01
from framescore.sources.folders import shared_folder

MEASURES = "n long, ssim double, n_ssim long, f1 double, rmse double, iou double"


def store_pairs(frames: DataFrame, pairs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Frames that both clips of a pair have (so that the longer is trimmed), a row a block, written as Parquet and read again: the columns of
    ``pairs`` but its clips, block, height, width, a and b (arrays of struct: pixels, edges).

    ``frames``: video_id, frame_idx, height, width, pixels (binary 8-bit RGB), and edges (binary, a byte a pixel) if there are edge maps;
    ``pairs``: video_id, reference_id, and what names a pair. Frames of different sizes, and those without pixels, are left out."""
    path = path or shared_folder(frames.sparkSession, "pairs")
    keys = [c for c in pairs.columns if c not in ("video_id", "reference_id")]
    if "edges" not in frames.columns:
        frames = frames.withColumn("edges", F.lit(None).cast("binary"))
    frames = frames.where(F.col("pixels").isNotNull()).select("video_id", "frame_idx", "height", "width", F.struct("pixels", "edges").alias("x"))
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("video_id").alias("video_id"), F.lit(0).alias("side")), F.struct(F.col("reference_id").alias("video_id"), F.lit(1).alias("side")))).alias("s"))
    rows = sides.select(*keys, "s.video_id", "s.side").join(frames, "video_id").withColumn("block", F.floor(F.col("frame_idx") / block).cast("long"))
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("frame_idx", "height", "width", "x")))).alias("ab"[k])
    rows = rows.groupBy(*keys, "block").agg(side(0), side(1))
    other = lambda x, y: (x["frame_idx"] == y["frame_idx"]) & (x["height"] == y["height"]) & (x["width"] == y["width"])
    both = lambda own, theirs: F.filter(own, lambda x: F.exists(theirs, lambda y: other(x, y)))
    rows = rows.select(*keys, "block", both("a", "b").alias("a"), both("b", "a").alias("b")).where(F.size("a") > 0)
    first = F.get("a", F.lit(0))
    rows = rows.select(*keys, "block", first["height"].alias("height"), first["width"].alias("width"), F.transform("a", lambda x: x["x"]).alias("a"), F.transform("b", lambda x: x["x"]).alias("b"))
    rows.write.parquet(path)
    return frames.sparkSession.read.schema(rows.schema).parquet(path)


def gray8(pixels: bytes, h: int, w: int) -> np.ndarray:
    rgb = np.frombuffer(pixels, np.uint8).reshape(h, w, 3).astype(np.int32)
    return (rgb @ np.array([299, 587, 114], np.int32) + 500) // 1000


def compared(a, b, h: int, w: int, sigma: float) -> tuple[float | None, float, float, float]:
    """(similarity of the blurred frames, F1 of edges, deviation of log depth ratios, mean intersection over union) of two frames. Gray stands
    for depth, and gray above 128 for the mask, as no model is at hand; without edge maps F1 is 0."""
    x, y = gray8(a["pixels"], h, w), gray8(b["pixels"], h, w)
    p, q = x / 255, y / 255
    f1 = 0.0
    if a["edges"] is not None and b["edges"] is not None:
        e, r = np.frombuffer(a["edges"], np.uint8) > 0, np.frombuffer(b["edges"], np.uint8) > 0
        f1 = 2 * (e & r).sum() / max(1, e.sum() + r.sum())
    d = np.log(p + 1e-3) - np.log(q + 1e-3)
    return K.ssim(K.gaussian(p, sigma), K.gaussian(q, sigma)), float(f1), float(np.sqrt(max(0.0, (d * d).mean() - d.mean() ** 2))), K.iou(x > 128, y > 128)


def control_scores(store: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(the pair's names, n_frames, blur_ssim, edge_f1, depth_si_rmse, mask_miou) of stored pairs; blur_ssim is null for frames under 7 pixels."""
    keys = [c for c in store.columns if c not in ("block", "height", "width", "a", "b")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                s, f, d, i = zip(*(compared(a, b, r.height, r.width, sigma) for a, b in zip(r.a, r.b)))
                known = [x for x in s if x is not None]
                out.append((len(s), float(sum(known)), len(known), sum(f), sum(d), sum(i)))
            yield pd.concat([t[keys].reset_index(drop=True), pd.DataFrame(out, columns=[x.split()[0] for x in MEASURES.split(", ")])], axis=1)

    kinds = ", ".join(f"`{k}` {store.schema[k].dataType.simpleString()}" for k in keys)
    sums = store.mapInPandas(run, f"{kinds}, {MEASURES}").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "ssim", "n_ssim", "f1", "rmse", "iou")))
    mean = lambda c: F.col(c) / F.col("n")
    return sums.select(*keys, F.col("n").alias("n_frames"), clip01(F.try_divide("ssim", "n_ssim")).alias("blur_ssim"), mean("f1").alias("edge_f1"), (1 / (1 + mean("rmse"))).alias("depth_si_rmse"), clip01(mean("iou")).alias("mask_miou"))


def diversity(frames: DataFrame, variants: DataFrame) -> DataFrame:
    """(the item's names, diversity): mean over pairs of an item's variants of the mean distance of their pixels on the frames that both have,
    clipped; 0 with under two. ``variants``: video_id and what names the item; a clip without frames is no variant.

    Of the variants that have a frame, those of each least length are one set: the pairs of a length are the pairs of its set less those
    of the next longer one's, so that each pair is divided by its own number of frames and none is formed."""
    keys = [c for c in variants.columns if c != "video_id"]
    length = frames.where(F.col("pixels").isNotNull()).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("length"))
    clips = variants.distinct().join(length, "video_id")
    rows = clips.join(frames.where(F.col("pixels").isNotNull()).select("video_id", "frame_idx", "pixels"), "video_id")
    rows = rows.groupBy(*keys, "frame_idx").agg(F.collect_list(F.struct("length", "pixels")).alias("v"))  # a frame of each variant

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> pd.Series:
        """Sum over pairs of the mean distance at a frame, divided by the pair's number of frames."""
        out = []
        for one in v:
            lengths = np.array([x["length"] for x in one])
            pixels = np.stack([np.frombuffer(x["pixels"], np.uint8) for x in one]).astype(np.int64)
            total, longer = 0.0, 0.0
            for n in np.unique(lengths)[::-1]:  # longest first
                own = np.sort(pixels[lengths >= n], axis=0)
                k = len(own)
                now = float(((2 * np.arange(1, k + 1) - k - 1) @ own).mean() / 255)
                total += (now - longer) / n
                longer = now
            out.append(total)
        return pd.Series(out, dtype="float64")

    sums = rows.withColumn("s", spread("v")).groupBy(*keys).agg(F.sum("s").alias("s"))
    counts = clips.groupBy(*keys).agg(F.count("*").alias("c"))
    pairs = F.col("c") * (F.col("c") - 1) / 2
    return variants.select(*keys).distinct().join(counts, keys, "left").join(sums, keys, "left").select(*keys, F.coalesce(clip01(F.try_divide("s", pairs)), F.lit(0.0)).alias("diversity"))


def conditional_items(items: DataFrame, levels: DataFrame, variants: DataFrame, frames: DataFrame, **how) -> DataFrame:
    """A row a model and item whose reference and clip of level 0 could be read: model_id, item_id, domain and the seven metrics of
    ``tracks.CONDITIONAL``. ``items``: item_id, domain, reference_id; ``levels``: model_id, item_id, level, video_id; ``variants``: model_id, item_id,
    video_id. Robustness is the area under blurred similarity over all levels read."""
    pairs = levels.join(items.select("item_id", "reference_id"), "item_id").select("model_id", "item_id", "level", "video_id", "reference_id")
    folder = shared_folder(frames.sparkSession, "control")
    control_scores(store_pairs(frames, pairs, **how)).write.parquet(folder)
    scores = frames.sparkSession.read.parquet(folder)
    keys = ["model_id", "item_id"]
    robust = tracks.robustness(scores.select(*keys, "level", F.col("blur_ssim").alias("fidelity")), tuple(keys)).drop("n_levels")
    zero = scores.where("level = 0").drop("level").withColumn("has_level_0", F.lit(True)).withColumn("has_reference", F.lit(True))
    return tracks.conditional_items(zero, robust, diversity(frames, variants)).join(items.select("item_id", "domain"), "item_id").select(*keys, "domain", *tracks.CONDITIONAL)


def conditional_track(items: DataFrame, levels: DataFrame, variants: DataFrame, frames: DataFrame, **how) -> DataFrame:
    """The conditional track's summary (``tracks.conditional``) from frames."""
    return tracks.conditional(conditional_items(items, levels, variants, frames, **how))
