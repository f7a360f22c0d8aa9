"""Trajectories, plausibility checks and clip verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.operators.video.kernels import curl


def centroids(measured: DataFrame) -> DataFrame:
    """Trajectory (video_id, t, x, y) from frame measures: a still or nearly still pair carries the last centroid on;
    before any, a clip that begins still is at (0, 0), one that begins with few changed pixels at the frame's centre."""
    w = W.partitionBy("video_id").orderBy("frame_idx")
    rows = measured.where(F.col("how").isNotNull())
    first = F.first("how").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    carried = lambda c, size: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.when(first == "few", F.col(size) / 2).otherwise(0.0))
    return rows.select("video_id", (F.row_number().over(w) - 1).alias("t"), carried("x", "width").alias("x"), carried("y", "height").alias("y"))


def steps(traj: DataFrame) -> DataFrame:
    """(video_id, t, vx, vy, speed) between consecutive points."""
    w = W.partitionBy("video_id").orderBy("t")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    rows = traj.select("video_id", "t", d("x").alias("vx"), d("y").alias("vy")).where(F.col("vx").isNotNull())
    return rows.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def curvature(traj: DataFrame) -> DataFrame:
    """(video_id, a, n): the quadratic coefficient of y over t, from sums with centred t."""
    mean = traj.groupBy("video_id").agg(F.avg("t").alias("mid"))
    rows = traj.join(mean, "video_id").withColumn("q", (F.col("t") - F.col("mid")) * (F.col("t") - F.col("mid")))
    s = rows.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum("y").alias("y"), F.sum(F.col("q") * F.col("y")).alias("qy"))
    return s.select("video_id", F.try_divide(F.col("n") * F.col("qy") - F.col("q") * F.col("y"), F.col("n") * F.col("qq") - F.col("q") * F.col("q")).alias("a"), "n")


def gravity_aligned(a: Column, gravity_y: Column) -> Column:
    return F.coalesce((F.signum(a) * F.signum(gravity_y) > 0) & (F.abs(a) > 1e-3), F.lit(False))


def motion_checks(traj: DataFrame, spike: float = 0.6, jump: float = 5.0, slip: float = 1.2) -> DataFrame:
    """(video_id, spikes, jumps, friction_ok): sudden changes of speed and steps against the clip's median, and whether
    the second half is no faster than the first (true up to four speeds)."""
    w = W.partitionBy("video_id").orderBy("t")
    rows = steps(traj).withColumn("dv", F.abs(F.col("speed") - F.lag("speed").over(w))).withColumn("i", F.row_number().over(w) - 1)
    clips = rows.groupBy("video_id").agg(F.median("speed").alias("med"), F.count("*").alias("n"))
    rows = rows.join(clips, "video_id")
    late = F.col("i") >= F.floor(F.col("n") / 2)
    out = rows.groupBy("video_id").agg(
        F.count_if(F.col("dv") > spike * (F.col("med") + 1e-6)).alias("spikes"),
        F.count_if(F.col("speed") > jump * (F.col("med") + 1e-6)).alias("jumps"),
        F.first("n").alias("n"),
        F.avg(F.when(late, F.col("speed"))).alias("late"),
        F.avg(F.when(~late, F.col("speed"))).alias("early"),
    )
    return out.select("video_id", "spikes", "jumps", ((F.col("n") <= 4) | (F.col("late") <= (F.col("early") + 1e-6) * slip)).alias("friction_ok"))


def reflection(traj: DataFrame, tolerance: float = 0.7, mode: str = "reference") -> DataFrame:
    """(video_id, reflection_ok, cos): the direction after the sharpest bend against the reflected one before it; true up
    to two velocities. The normal is the sum of both directions; with mode "surface_normal" their difference."""
    w = W.partitionBy("video_id").orderBy("t")
    d = steps(traj)
    d = d.select("video_id", "t", (F.col("vx") / (F.col("speed") + 1e-6)).alias("ix"), (F.col("vy") / (F.col("speed") + 1e-6)).alias("iy"))
    n = F.count("*").over(W.partitionBy("video_id"))
    d = d.withColumn("ox", F.lead("ix").over(w)).withColumn("oy", F.lead("iy").over(w)).withColumn("n", n)
    dot = F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy")
    bend = d.groupBy("video_id").agg(F.max("n").alias("n"), F.min_by(F.struct("ix", "iy", "ox", "oy"), F.when(F.col("ox").isNotNull(), F.struct(dot.alias("dot"), "t"))).alias("b"))
    sign = 1 if mode == "reference" else -1
    nx, ny = F.col("b.ix") + sign * F.col("b.ox"), F.col("b.iy") + sign * F.col("b.oy")
    size = F.sqrt(nx * nx + ny * ny) + 1e-6
    nx, ny = nx / size, ny / size
    along = F.col("b.ix") * nx + F.col("b.iy") * ny
    cos = (F.col("b.ix") - 2 * along * nx) * F.col("b.ox") + (F.col("b.iy") - 2 * along * ny) * F.col("b.oy")
    cos = F.when(F.col("n") > 2, cos)
    return bend.select("video_id", F.coalesce(cos > tolerance, F.lit(True)).alias("reflection_ok"), cos.alias("cos"))


def fluid_mass(frames: DataFrame, most: float = 0.5) -> DataFrame:
    """(video_id, mass_drift, mass_ok): change of the area above the clip's mean plus deviation. Two passes: sums a frame,
    then areas."""

    @F.pandas_udf("n long, s double, q double")
    def sums(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(x), float(np.sum(x)), float(np.square(x).sum())) for x in g], columns=["n", "s", "q"])

    @F.pandas_udf("long")
    def area(g: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([int((np.asarray(x) > y).sum()) for x, y in zip(g, t)])

    clips = frames.withColumn("m", sums("gray")).groupBy("video_id").agg((F.sum("m.s") / F.sum("m.n")).alias("mean"), (F.sum("m.q") / F.sum("m.n")).alias("sq"))
    limit = clips.select("video_id", (F.col("mean") + F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean")))).alias("limit"))
    areas = frames.join(limit, "video_id").withColumn("area", area("gray", "limit")).groupBy("video_id").agg(F.max("area").alias("hi"), F.min("area").alias("lo"))
    drift = F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")), F.lit(0.0))
    return areas.select("video_id", drift.alias("mass_drift"), (drift < most).alias("mass_ok"))


def vorticity(flow: DataFrame, most: float = 5.0, bins: int = 2048) -> DataFrame:
    """(video_id, curl_p99, curl_ok): exact 99th percentile of |curl| over a clip's pixels. Pass one merges a histogram of
    each field to find the bins of the two ranks; pass two sends only values of those bins."""
    edge = 2.0

    def to_bin(x):
        return np.minimum((np.log1p(x) / edge * (bins / 4)).astype(int), bins - 1)

    shape = lambda a, h, w: np.asarray(a, float).reshape(h, w)

    @F.pandas_udf("array<struct<bin:int,c:long>>")
    def histogram(u: pd.Series, v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for a, b, y, x in zip(u, v, h, w):
            k, c = np.unique(to_bin(curl(shape(a, y, x), shape(b, y, x))), return_counts=True)
            out.append([{"bin": int(i), "c": int(j)} for i, j in zip(k, c)])
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def inside(u: pd.Series, v: pd.Series, h: pd.Series, w: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for a, b, y, x, i, j in zip(u, v, h, w, lo, hi):
            c = curl(shape(a, y, x), shape(b, y, x)).ravel()
            k = to_bin(c)
            out.append(c[(k == i) | (k == j)])
        return pd.Series(out)

    counts = flow.select("video_id", F.explode(histogram("u", "v", "height", "width")).alias("b")).groupBy("video_id", "b.bin").agg(F.sum("b.c").alias("c"))
    w = W.partitionBy("video_id").orderBy("bin")
    cum = counts.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(W.partitionBy("video_id")))
    rank = 0.99 * (F.col("total") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    cum = cum.withColumn("before", F.col("upto") - F.col("c"))
    has = lambda r: (F.col("before") <= r) & (r < F.col("upto"))
    ends = cum.groupBy("video_id").agg(F.max("total").alias("total"), F.max(F.when(has(low), F.col("bin"))).alias("lo"), F.max(F.when(has(high), F.col("bin"))).alias("hi"), F.max(F.when(has(low), F.col("before"))).alias("skip_lo"), F.max(F.when(has(high), F.col("before"))).alias("skip_hi"))
    values = flow.join(ends, "video_id").select("video_id", "total", "skip_lo", F.explode(inside("u", "v", "height", "width", "lo", "hi")).alias("x"))
    # equal values are counted, so that a still clip's are one row
    sums = values.groupBy("video_id", "total", "skip_lo", "x").agg(F.count("*").alias("c"))
    ordered = sums.withColumn("upto", F.col("skip_lo") + F.sum("c").over(W.partitionBy("video_id").orderBy("x")))
    ordered = ordered.withColumn("before", F.col("upto") - F.col("c"))
    all_values = ordered.groupBy("video_id").agg(F.max("total").alias("total"), F.max(F.when(has(low), F.col("x"))).alias("a"), F.max(F.when(has(high), F.col("x"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    # with ranks in two bins, the upper is the first value of its bin, which follows the last of the lower
    p99 = a + (b - a) * (rank - low)
    return all_values.select("video_id", p99.alias("curl_p99"), (p99 < most).alias("curl_ok"))


def surface_jitter(edges: DataFrame, most: float = 20.0) -> DataFrame:
    """(video_id, jitter, surface_ok) of edge maps (video_id, frame_idx, edges: array of 0/255): deviation of their means."""
    mean = F.aggregate("edges", F.lit(0.0), lambda a, x: a + x) / F.size("edges")
    return edges.withColumn("m", mean).groupBy("video_id").agg(F.stddev_pop("m").alias("jitter")).withColumn("surface_ok", F.col("jitter") < most)


#: Floors of the supplementary checks.
FLOORS = {"flow_smoothness": 0.30, "depth_stability": 0.55, "blob_count_stability": 0.50, "pose_validity": 0.50}


def supplementary(scores: Column) -> tuple[Column, Column]:
    """(checks, violations) of a map of scores; null ones are skipped."""
    have = F.map_filter(scores, lambda k, v: v.isNotNull())
    floor = F.create_map(*(x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))))
    checks = F.transform_values(have, lambda k, v: v >= F.element_at(floor, k))
    low = F.filter(F.map_entries(have), lambda e: e["value"] < F.element_at(floor, e["key"]))
    return checks, F.transform(low, lambda e: F.format_string("%s_low_%.2f", e["key"], e["value"]))


def verdicts(clips: DataFrame, passing: float = 0.66) -> DataFrame:
    """Verdict of each clip (model_id and others stay) by its physics category. ``clips``: physics_category, n_centroids,
    a, gravity_y, spikes, expected_collisions, jumps, friction_ok, reflection_ok, cos, mass_ok, mass_drift, curl_ok,
    curl_p99, surface_ok, jitter, supplementary (map)."""
    extra, extra_low = supplementary(F.col("supplementary"))
    ok_gravity = gravity_aligned(F.col("a"), F.coalesce("gravity_y", F.lit(1.0)))
    expected = F.coalesce("expected_collisions", F.col("spikes"))
    ok_hits = F.abs(F.col("spikes") - expected) <= 1
    ok_jumps = F.coalesce(F.col("jumps") == 0, F.lit(True))
    checks = {
        "rigid_body": {"gravity_alignment": ok_gravity, "collision_count": ok_hits, "no_interpenetration": ok_jumps},
        "contact": {"friction_consistent": F.col("friction_ok"), "reflection_plausible": F.col("reflection_ok"), "no_interpenetration": ok_jumps},
        "fluid": {"fluid_mass_conservation": F.col("mass_ok"), "vorticity_plausible": F.coalesce("curl_ok", F.lit(True)), "surface_smoothness": F.col("surface_ok")},
    }
    text = {
        "gravity_alignment": F.lit("acceleration_not_gravity_aligned"),
        "collision_count": F.format_string("collision_count_mismatch_%d_vs_%d", F.col("spikes").cast("long"), expected.cast("long")),
        "no_interpenetration": F.format_string("interpenetration_jumps_%d", F.col("jumps").cast("long")),
        "friction_consistent": F.lit("friction_violation_speeding_up"),
        "reflection_plausible": F.format_string("reflection_implausible_cos_%.2f", "cos"),
        "fluid_mass_conservation": F.format_string("fluid_mass_drift_%.2f", "mass_drift"),
        "vorticity_plausible": F.format_string("vorticity_extreme_%.2f", "curl_p99"),
        "surface_smoothness": F.format_string("surface_jitter_%.2f", "jitter"),
    }
    none, nothing = F.create_map().cast("map<string,boolean>"), F.array().cast("array<string>")
    own, low = none, nothing
    category = F.col("physics_category")
    for name, rules in checks.items():
        own = F.when(category == name, F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), v)))).otherwise(own)
        low = F.when(category == name, F.array_compact(F.array(*(F.when(~v, text[k]) for k, v in rules.items())))).otherwise(low)
    tractable = category.isin(*checks)
    short = category.isin("rigid_body", "contact") & (F.col("n_centroids") < 5)
    both = F.map_concat(own, extra)
    share = F.aggregate(F.map_values(both), F.lit(0.0), lambda a, x: a + x.cast("int")) / F.size(both)
    score = F.when(~tractable, None).when(short, 0.0).otherwise(share)
    return clips.select(
        "*",
        score.alias("score"),
        (tractable & ~short & (score >= passing)).alias("passed"),
        F.when(~tractable, nothing).when(short, F.array(F.lit("insufficient_motion"))).otherwise(F.concat(low, extra_low)).alias("violations"),
        F.when(tractable & ~short, both).otherwise(none).alias("checks"),
        F.when(~tractable, "intractable").when(category == "fluid", "heuristic").otherwise("analytic").alias("verifier_type"),
        F.when(category == "fluid", "medium").alias("uncertainty"),
    )
