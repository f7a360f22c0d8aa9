"""Near-duplicate vectors by PCA-ordered tiles.

Equal vectors are one. Vectors are rotated to their principal axes; a grid on the first three, as wide as the largest
distance of a link, holds tiles, and only tiles of the same or touching cells meet. A tile travels as one block in single
precision. A pair of tiles adds up the leading axes first; the rest of a product is at most the product of the suffix
norms, so a pair stops as soon as its cosine can't reach the threshold. Cosines so near the threshold that single
precision can't tell are computed from the whole vectors. A tile pair returns counts of links and links that span its
components, never all pairs.

Exact, so the work grows with the square of the number of different vectors where three axes don't spread them: each
vector travels to as many tile pairs as there are tiles of ``TILE`` in reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import components, partitions, written

THRESHOLD, TILE, STEP, AXES = 0.95, 8192, 16, 3
#: What rounding in single precision may add to a bound, and by how much it may miss a cosine.
SLACK, NEAR = 1e-4, 1e-5


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches):
    """Sums of unit vectors' products: a row of bounded size a task."""
    total = {}
    for b in batches:
        for d in set(b.column("d").to_pylist()):
            x = _unit(_matrix(b.column("embedding").filter(pa.array(np.array(b.column("d").to_pylist()) == d))))
            total[d] = total.get(d, 0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["d", "m"])


def _added(batches):
    """Sums of rows (d, m)."""
    total = {}
    for b in batches:
        for d, m in zip(b.column("d").to_pylist(), b.column("m").to_pylist()):
            total[d] = total.get(d, 0) + np.frombuffer(m)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["d", "m"])


def axes(vectors: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Principal axes by falling variance, as columns, for each dimension; sums of eight tasks reach the driver."""
    total = {d: np.zeros(d * d) for d in dims}
    for r in vectors.select("d", "embedding").mapInArrow(_moments, "d int, m binary").repartition(8).mapInArrow(_added, "d int, m binary").toLocalIterator():
        total[r.d] += np.frombuffer(r.m)
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in total.items()}


CELL = [f"a{k}" for k in range(AXES)]


def _rotated(shared):
    def run(batches):
        for b in batches:
            d = np.array(b.column("d").to_pylist())
            for k in np.unique(d):
                part = b.filter(pa.array(d == k))
                x = _unit(_matrix(part.column("embedding"))) @ shared.value[int(k)]
                cell = np.zeros((len(x), AXES), np.int32)
                cell[:, : min(AXES, int(k))] = np.floor(x[:, :AXES] / np.sqrt(2 * (1 - THRESHOLD) + SLACK))
                rows = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("d"), part.column("c"), *(pa.array(np.ascontiguousarray(cell[:, i])) for i in range(AXES)), pa.array([r.tobytes() for r in rows], pa.binary())], ["uid", "d", "c", *CELL, "x"])

    return run


def pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) of unit vectors in single precision, by falling variance of their axes, whose cosine may be at the threshold or
    above, and whether single precision can tell that it is."""
    found = []
    ends = [*range(step, a.shape[1], step), a.shape[1]]
    rest = lambda x: {z: np.sqrt(np.maximum((x[:, z:] ** 2).sum(1), 0)) for z in ends}
    ra, rb = rest(a), rest(b)
    for s in range(0, len(a), 512):
        z = ends[0]
        p = a[s : s + 512, :z] @ b[:, :z].T
        i, j = np.nonzero(p + ra[z][s : s + 512, None] * rb[z][None, :] >= threshold - SLACK)
        p, i = p[i, j], i + s
        for k, z in zip(ends, ends[1:]):
            if not len(i):
                break
            keep = []
            for t in range(0, len(i), 1 << 17):
                u, v = i[t : t + (1 << 17)], j[t : t + (1 << 17)]
                p[t : t + (1 << 17)] += np.einsum("ij,ij->i", a[u, k:z], b[v, k:z])
                keep.append(p[t : t + (1 << 17)] + ra[z][u] * rb[z][v] >= threshold - (SLACK if z < ends[-1] else NEAR))
            keep = np.concatenate(keep)
            i, j, p = i[keep], j[keep], p[keep]
        keep = p >= threshold - NEAR
        found.append((i[keep], j[keep], p[keep] >= threshold + NEAR))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links with the same components."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _blocks(batches):
    """A row a tile: its vectors' uids, numbers and rotated vectors. Rows come sorted by tile."""

    def send(tile, rows):
        uid, c, x = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([tile]), *(pa.array([v], pa.binary()) for v in (np.array(uid, np.int64).tobytes(), np.array(c, np.int64).tobytes(), b"".join(x)))], ["tile", "uid", "c", "x"])

    now, rows = None, []
    for b in batches:
        for tile, *row in zip(*(b.column(k).to_pylist() for k in ("tile", "uid", "c", "x"))):
            if tile != now and rows:
                yield send(now, rows)
                rows = []
            now = tile
            rows.append(row)
    if rows:
        yield send(now, rows)


def _compare(batches):
    """(kind, a, n): "n", links' weight of a class; "e", b linked to a; "?", a pair to be computed from whole vectors. Rows, of one or two
    tiles a unit, come sorted by unit."""

    def unit(tiles):
        first, last = tiles[0], tiles[-1]
        i, j, sure = pairs(first[2], last[2])
        if len(tiles) == 1:
            keep = i < j
            i, j, sure = i[keep], j[keep], sure[keep]
        a, b = first[0][i], last[0][j]
        if not sure.all():
            yield "?", a[~sure], b[~sure]
            i, j, a, b = i[sure], j[sure], a[sure], b[sure]
        if len(i):
            for own, at, other in ((first, i, last[1][j]), (last, j, first[1][i])):
                w = np.bincount(at, other, len(own[0]))
                has = np.flatnonzero(w)
                yield "n", own[0][has], w[has].astype(np.int64)
            yield "e", *_spanning(a, b)

    def send(tiles):
        for kind, a, n in unit(tiles):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(n)], ["kind", "a", "n"])

    now, tiles = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("unit", "uid", "c", "x"))):
            if row[0] != now and tiles:
                yield from send(tiles)
                tiles = []
            now = row[0]
            uid = np.frombuffer(row[1], np.int64)
            tiles.append((uid, np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.float32).reshape(len(uid), -1)))
    if tiles:
        yield from send(tiles)


def near_duplicates(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a vector.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a vec_id, link with
    nothing (a null id has a null component and is not kept). Vectors of different length never link; rows that
    repeat are vectors of their own. An empty table gives an empty one; other columns are ignored. ``tile``, the vectors of a
    tile, changes the work and not the result."""
    spark = vectors.sparkSession
    n = partitions(spark)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("h2"))
    known = rows.where(F.col("embedding").isNotNull()).groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("c"), F.any_value("embedding").alias("embedding"))
    classes = written(known.withColumn("d", F.size("embedding")).withColumn("uid", F.monotonically_increasing_id()), "classes")
    dims = [r.d for r in classes.select("d").distinct().collect()]  # the lengths that occur
    cells = ", ".join(f"{c} int" for c in CELL)
    turned = written(classes.mapInArrow(_rotated(spark.sparkContext.broadcast(axes(classes, dims))), f"uid long, d int, c long, {cells}, x binary"), "rotated")
    counts = written(turned.groupBy("d", *CELL).agg(F.ceil(F.count("*") / tile).cast("int").alias("t")), "cells")  # at most 7 ** AXES a length
    name = lambda k: F.concat_ws(".", "d", *CELL, k)
    placed = turned.join(counts, ["d", *CELL]).select(name(F.pmod(F.xxhash64("uid"), F.col("t"))).alias("tile"), "uid", "c", "x")
    blocks = written(placed.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(_blocks, "tile string, uid binary, c binary, x binary"), "blocks")
    tiles = counts.select("d", *CELL, F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("k")).select("d", *CELL, name(F.col("k")).alias("tile"))
    touching = tiles.withColumnRenamed("tile", "one")
    for c in CELL:
        touching = touching.withColumn(c, F.explode(F.array(*(F.col(c) + k for k in (-1, 0, 1)))))
    met = touching.join(tiles.withColumnRenamed("tile", "other"), ["d", *CELL]).where("one <= other")
    units = met.select(F.concat_ws("|", "one", "other").alias("unit"), F.explode(F.array_distinct(F.array("one", "other"))).alias("tile"))
    sent = units.join(blocks, "tile").select("unit", "tile", "uid", "c", "x").repartition(n, "unit").sortWithinPartitions("unit", "tile")
    found = written(sent.mapInArrow(_compare, "kind string, a long, n long"), "links")
    # what single precision can't tell
    most = F.array_max(F.transform("embedding", F.abs))
    scaled = F.when(most.between(1e-100, 1e100), F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / most))
    whole = lambda x: classes.select(F.col("uid").alias(x), scaled.alias(f"e{x}"), F.col("c").alias(f"c{x}"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    near = found.where("kind = '?'").select("a", F.col("n").alias("b")).join(whole("a"), "a").join(whole("b"), "b")
    near = written(near.where(dot("ea", "eb") / F.sqrt(dot("ea", "ea") * dot("eb", "eb")) >= THRESHOLD).select("a", "b", "ca", "cb"), "near")
    row = lambda kind, a, n: near.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(n).alias("n"))
    found = found.where("kind <> '?'").union(row("n", "a", "cb")).union(row("n", "b", "ca")).union(row("e", "a", "b"))
    weight = found.where("kind = 'n'").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
    part = components(found.where("kind = 'e'").select("a", F.col("n").alias("b"))).withColumnRenamed("node", "uid")
    firsts = classes.select("uid", "h1", "h2", "first_id", "c").join(weight, "uid", "left").join(part, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = firsts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    firsts = firsts.join(least, "component").select("h1", "h2", (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    # the hashes are those of a null embedding where it can't link, which no class has
    out = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("h1")).alias("h1"), "h2").join(firsts, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
