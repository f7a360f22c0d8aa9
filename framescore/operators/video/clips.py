"""Clips of any length from 8-bit frames to quality, verdict and the generation track's scores.

Frames are stored as blocks: some consecutive frames of a clip with one frame of overlap at each side, so that what needs
neighbours reads one row and pixels are shuffled once, when they are stored. One pass over blocks gives each a
state of sums; states of neighbouring blocks add up to that of both, in any grouping, and so a clip is as many tasks as it has
blocks. Thresholds that need the whole clip cost no second pass: 8-bit values have 256 levels, and a state holds what
each would give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.operators import judges, tracks
from framescore.operators.video import kernels as K
from framescore.operators.video import physics, quality
from framescore.sources.folders import shared_folder

#: Frames of a block, and states that one merge adds up.
BLOCK, FAN_IN = 16, 64


def store_frames(frames: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Frames (video_id, frame_idx from 0 without gaps, height, width, pixels: binary 8-bit RGB) written as Parquet, a row a block,
    and read again: video_id, block, height, width, first (whether a frame of overlap comes first), n (frames of
    the block's own), pixels (array of binary, with the overlap). Frames without pixels are left out."""
    path = path or shared_folder(frames.sparkSession, "frames")
    own, place = F.floor(F.col("frame_idx") / block).cast("long"), F.col("frame_idx") % block
    near = F.array_compact(F.array(own, F.when((place == 0) & (own > 0), own - 1), F.when(place == block - 1, own + 1)))
    rows = frames.where(F.col("pixels").isNotNull()).select("video_id", "height", "width", F.struct("frame_idx", own.alias("own"), "pixels").alias("f"), F.explode(near).alias("block"))
    rows = rows.groupBy("video_id", "block").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.array_sort(F.collect_list("f")).alias("f"))  # at most block + 2 frames
    mine = F.size(F.filter("f", lambda x: x["own"] == F.col("block")))
    rows = rows.select("video_id", "block", "height", "width", (F.get("f", F.lit(0))["own"] < F.col("block")).alias("first"), mine.alias("n"), F.transform("f", lambda x: x["pixels"]).alias("pixels"))
    rows.where("n > 0").write.parquet(path)  # the overlap of a clip's end is no block
    return frames.sparkSession.read.schema(rows.schema).parquet(path)


_SUMS = ("n", "contrast", "sharp", "gap", "gaps", "blob_n", "blob_sum", "blob_squares", "near_color", "near_pixels")
_ADDED = ("histogram", "color", "pixel")
STATE = (
    "n long, contrast double, sharp double, gap double, gaps long, blob_n long, blob_sum long, blob_squares long, near_color double, near_pixels double, "
    "histogram array<long>, color array<double>, pixel array<double>, most array<long>, least array<long>, signs array<long>, first_color array<double>, first_pixel array<double>, "
    "height int, width int, points array<struct<x:double,y:double,how:string>>"
)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / 255.0
    return x / (np.sqrt((x * x).sum(-1, keepdims=True)) + 1e-8)


def state(rgb: np.ndarray, before: int, own: int, start: int, min_area: int, n_pairs: int, seed: int) -> dict:
    """The state of ``own`` frames of ``rgb`` (frames, height, width, 3), after ``before`` frames of overlap; ``start`` is the number of the
    first own frame in its clip."""
    _, h, w, _ = rgb.shape
    at = slice(before, before + own)
    wide = rgb.astype(np.int32)
    gray = ((wide @ np.array([299, 587, 114], np.int32) + 500) // 1000).astype(np.uint8)  # in whole numbers, so that ties round alike everywhere
    level = wide.sum(-1)
    out = {"n": own, "height": h, "width": w}
    out["contrast"] = float(level[at].std((1, 2)).sum() / 765)
    out["sharp"] = float(sum(K.laplacian_variance(x // 3 / 255) for x in level[at]))
    inner = [t for t in range(before, before + own) if 0 < t < len(rgb) - 1 and (start + t - before) % 2 == 1]
    out["gap"] = float(sum(np.abs(wide[t - 1] + wide[t + 1] - 2 * wide[t]).mean() / 510 for t in inner))
    out["gaps"] = len(inner)
    # clip-wide limits of brightness: how many pixels of a frame lie above each level, at most and at least
    counts = np.stack([np.bincount(x.ravel(), minlength=256) for x in gray[at]])
    above = counts.sum(1, keepdims=True) - np.cumsum(counts, 1)
    out["histogram"], out["most"], out["least"] = counts.sum(0), above.max(0), above.min(0)
    # the orders of sampled pixel pairs that occur, as bits: first those with a smaller first pixel, then equal, then larger
    i, j = K.pair_indices(h * w, n_pairs, seed)
    flat = gray[at].reshape(own, -1).astype(int)
    order = np.sign(flat[:, i] - flat[:, j])
    bits = np.stack([(order == s).any(0) for s in (-1, 0, 1)])
    packed = np.zeros((3, 64 * -(-n_pairs // 64)), bool)
    packed[:, :n_pairs] = bits
    out["signs"] = np.packbits(packed, axis=1, bitorder="little").view(np.int64).ravel()
    # features of unit length: their sum stands for all of a clip's cosines with its first frame
    color, pixel = _unit(rgb.mean((1, 2))), _unit(rgb.reshape(len(rgb), -1))
    pairs = range(before if before else 1, before + own)
    out["color"], out["pixel"] = color[at].sum(0), pixel[at].sum(0)
    out["near_color"] = float(sum(color[t - 1] @ color[t] for t in pairs))
    out["near_pixels"] = float(sum(pixel[t - 1] @ pixel[t] for t in pairs))
    out["first_color"], out["first_pixel"] = (None, None) if start else (color[before], pixel[before])
    moved = [K.moving(gray[t - 1] / 255, gray[t] / 255, min_area) for t in pairs]
    blobs = np.array([m[0] for m in moved], np.int64)
    out["blob_n"], out["blob_sum"], out["blob_squares"] = len(blobs), int(blobs.sum()), int((blobs * blobs).sum())
    out["points"] = [{"x": None if np.isnan(x) else x, "y": None if np.isnan(y) else y, "how": how} for _, x, y, how in moved]
    return out


def merged(states: list[dict]) -> dict:
    """The state of states in the order of their blocks."""
    out = {k: sum(s[k] for s in states) for k in _SUMS}
    out |= {k: np.sum([s[k] for s in states], 0) for k in _ADDED}
    out["most"], out["least"] = np.max([s["most"] for s in states], 0), np.min([s["least"] for s in states], 0)
    out["signs"] = np.bitwise_or.reduce([np.asarray(s["signs"], np.int64) for s in states])
    out["first_color"], out["first_pixel"] = states[0]["first_color"], states[0]["first_pixel"]
    out["height"], out["width"] = states[0]["height"], states[0]["width"]
    out["points"] = [p for s in states for p in s["points"]]
    return out


def states(store: DataFrame, min_area: int = 32, n_pairs: int = 256, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """A state a block of the store, a row at a time: pixels reach Python once, are shuffled never. ``block`` as the store's."""
    fields = [x.strip().split()[0] for x in STATE.replace("struct<x:double,y:double,how:string>", "s").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rgb = np.stack([np.frombuffer(p, np.uint8).reshape(r.height, r.width, 3) for p in r.pixels])
                s = state(rgb, int(r.first), int(r.n), int(r.block) * block, min_area, n_pairs, seed)
                yield pd.DataFrame([(r.video_id, r.block, *(s[f] for f in fields))], columns=["video_id", "block", *fields])

    kind = store.schema["video_id"].dataType.simpleString()
    return store.mapInPandas(run, f"video_id {kind}, block long, {STATE}")


def clip_states(store: DataFrame, fan_in: int = FAN_IN, **how) -> DataFrame:
    """One state a clip: states are added up by ``fan_in``, level by level, so that no task holds a long clip's."""
    now = states(store, **how)
    fields = [f for f in now.columns if f not in ("video_id", "block")]

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = merged([r._asdict() for r in rows.sort_values("block").itertuples(index=False)])
        return pd.DataFrame([(*key, *(whole[f] for f in fields))], columns=["video_id", "block", *fields])

    most = store.agg(F.max("block")).first()[0] or 0
    while True:
        now = now.groupBy("video_id", F.floor(F.col("block") / fan_in).alias("block")).applyInPandas(add, now.schema)
        most //= fan_in
        if not most:
            return now.drop("block")


CLIP = "subject_consistency double, background_consistency double, motion_smoothness double, aesthetic_quality double, imaging_quality double, depth_stability double, blob_count_stability double, mass_drift double, mass_ok boolean"


def _chain(first: np.ndarray, total: np.ndarray, near: float, n: int) -> float:
    """Mean of half the cosines with the first frame and with the one before, as (s + 1) / 2."""
    return 1.0 if n < 2 else float((0.5 * (first @ total - first @ first + near) / (n - 1) + 1) / 2)


def clip_scores(clips: DataFrame, most_drift: float = 0.5, n_pairs: int = 256) -> DataFrame:
    """(video_id, CLIP's columns) of clip states."""
    clip01 = lambda x: float(min(1.0, max(0.0, x)))

    def one(s) -> tuple:
        n, hist, g = s.n, np.asarray(s.histogram, float), np.arange(256.0)
        total, mean = hist.sum(), float(hist @ g) / hist.sum()
        limit = mean + np.sqrt(max(0.0, float(total * (hist @ (g * g)) - (hist @ g) ** 2))) / total
        hi, lo = s.most[min(255, int(np.floor(limit)))], s.least[min(255, int(np.floor(limit)))]
        drift = float(hi - lo) / hi if hi else 0.0
        bits = np.unpackbits(np.asarray(s.signs, np.int64).view(np.uint8).reshape(3, -1), axis=1, bitorder="little")[:, :n_pairs]
        blobs = max(0.0, s.blob_squares / s.blob_n - (s.blob_sum / s.blob_n) ** 2) if s.blob_n else 0.0
        return (
            _chain(np.asarray(s.first_color), np.asarray(s.color), s.near_color, n),
            _chain(np.asarray(s.first_pixel), np.asarray(s.pixel), s.near_pixels, n),
            max(0.0, 1 - s.gap / s.gaps) if s.gaps else 1.0,
            clip01(s.contrast / n * 2),
            clip01(s.sharp / n / 500),
            float((bits.sum(0) == 1).mean()) if n > 1 else 1.0,
            1 / (1 + float(np.sqrt(blobs))),
            drift,
            drift < most_drift,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.video_id, *one(r)) for r in b.itertuples(index=False)], columns=["video_id", *(c.split()[0] for c in CLIP.split(", "))])

    return clips.drop("points").mapInPandas(run, f"video_id {clips.schema['video_id'].dataType.simpleString()}, {CLIP}")


def trajectories(clips: DataFrame) -> DataFrame:
    """(video_id, t, x, y): the motion centroids of clip states."""
    rows = clips.select("video_id", "height", "width", F.posexplode("points").alias("frame_idx", "p"))
    return physics.centroids(rows.select("video_id", "height", "width", "frame_idx", "p.x", "p.y", "p.how"))


def clip_checks(store: DataFrame, flow: DataFrame | None = None, edges: DataFrame | None = None, keypoints: DataFrame | None = None, **how) -> DataFrame:
    """A row a clip with all that ``physics.verdicts`` and the quality mean need. ``flow`` (video_id, frame_idx, height, width, u, v), ``edges``
    (video_id, frame_idx, edges) and ``keypoints`` (video_id, frame_idx, landmark, x, y) may lack clips or be left out: such a clip passes
    the checks on them, and has no pose check."""
    spark = store.sparkSession
    folder = shared_folder(spark, "clips")
    clip_states(store, **how).write.parquet(folder)
    clips = spark.read.parquet(folder)
    traj = trajectories(clips)
    out = clip_scores(clips)
    points = clips.select("video_id", F.size("points").alias("n_centroids"))
    for more in (points, physics.curvature(traj).select("video_id", "a"), physics.motion_checks(traj), physics.reflection(traj)):
        out = out.join(more, "video_id", "left")
    kind = store.schema["video_id"].dataType
    nothing = lambda **cols: spark.range(0).select(F.lit(None).cast(kind).alias("video_id"), *(F.lit(None).cast(t).alias(c) for c, t in cols.items()))
    out = out.join(quality.flow_smoothness(flow) if flow is not None else nothing(flow_smoothness="double"), "video_id", "left")
    out = out.join(physics.vorticity(flow) if flow is not None else nothing(curl_p99="double", curl_ok="boolean"), "video_id", "left")
    out = out.join(physics.surface_jitter(edges) if edges is not None else nothing(jitter="double", surface_ok="boolean"), "video_id", "left")
    out = out.join(quality.pose_validity(keypoints) if keypoints is not None else nothing(pose_validity="double"), "video_id", "left")
    # speeds need two centroids: a shorter track has no spikes and no jumps
    out = out.fillna(0, ["spikes", "jumps"]).fillna(True, ["friction_ok", "reflection_ok", "curl_ok", "surface_ok"]).fillna(0.0, ["curl_p99", "jitter"]).fillna(1.0, ["flow_smoothness"])
    extra = [x for c in physics.FLOORS for x in (F.lit(c), F.col(c))]
    return out.withColumn("supplementary", F.create_map(*extra))


QUALITY = ("subject_consistency", "background_consistency", "motion_smoothness", "aesthetic_quality", "imaging_quality", "overall_consistency")


def generation_items(items: DataFrame, predictions: DataFrame, clips: DataFrame, fallback: DataFrame | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """A row a prediction of a known item whose clip could be read (repeats stay): model_id, item_id, video_id, domain, physics_category,
    quality, verdict (null: unscored), passed, judge_type, uncertainty, violations.

    ``items``: item_id, domain, physics_category, gravity_y and expected_collisions (null: downward, and as many as there are); ``predictions``:
    model_id, item_id, video_id; ``clips``: of ``clip_checks``; ``fallback``: judges' verdicts by model_id and item_id (as ``judges.ensemble`` gives
    them) for what the checks can't decide; ``prompts``: video_id, overall_consistency (0.5 where it lacks)."""
    rows = predictions.join(items, "item_id").join(clips, "video_id")
    if prompts is not None:
        rows = rows.join(prompts, "video_id", "left")
    else:
        rows = rows.withColumn("overall_consistency", F.lit(None).cast("double"))
    rows = rows.fillna(0.5, ["overall_consistency"]).withColumn("quality", tracks.item_quality(*QUALITY))
    judged = physics.verdicts(rows).withColumn("_row", F.monotonically_increasing_id())
    folder = shared_folder(rows.sparkSession, "verdicts")
    judged.select("_row", "model_id", "item_id", "video_id", "domain", "physics_category", "quality", "score", "passed", "violations", "verifier_type", "uncertainty").write.parquet(folder)
    judged = rows.sparkSession.read.parquet(folder)
    if fallback is not None and "judge_type" not in fallback.columns:
        fallback = fallback.withColumn("judge_type", F.lit("ensemble"))
    other = None if fallback is None else judged.select("_row", "model_id", "item_id").join(fallback, ["model_id", "item_id"]).drop("model_id", "item_id")
    routed = judges.route(judged.select("_row", "score", "verifier_type", "uncertainty", "violations"), other, ("_row",)).withColumnRenamed("score", "verdict")
    return judged.select("_row", "model_id", "item_id", "video_id", "domain", "physics_category", "quality", "passed", "verifier_type").join(routed, "_row").drop("_row")


def generation_track(items: DataFrame, predictions: DataFrame, clips: DataFrame, **how) -> DataFrame:
    """The generation track's summary (``tracks.generation``) from clips."""
    rows = generation_items(items, predictions, clips, **how)
    return tracks.generation(rows.select("model_id", "domain", "physics_category", "quality", "verdict"))
