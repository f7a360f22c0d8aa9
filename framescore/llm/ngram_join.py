"""Exact Jaccard join of word shingles: size-banded tiles with hashed bitmap signatures.

1. Keys. A set's shingles are put in one order for all sets, shingles that many documents share last (``ordering``; any
   order gives the same result). Linked sets share three of the first quarter and three, or all that they have in common.
   A key of at most ``FEW`` sets gives its pairs of near size; a pair counts if it has three such keys. A more frequent
   key gives the pairs of its first set with each other one, and the rest of its pairs is left to step 4.
2. Signatures. A set's bitmap holds, a bit a bucket, whether an odd number of its shingles fall there. Bits that differ
   bound the symmetric difference from below, and so the overlap from above; pairs that can't link go.
3. Forest. Each set is compared exactly, as sorted arrays, with its smallest partner: links, and components of them.
4. Tiles. Sets of a frequent key that lie in different components are compared by signature in size-banded tiles;
   where these allow a link, and where a pair of step 2 is still open, the sets are compared exactly in tiles.

Equal sets are one. Texts, not shingles, travel to the exact steps: they compress. All pairs of a group are never rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import components, documents, grams, groups, mix, partitions, released, words, written

SHINGLE = 5
#: Sets in a tile, at most, and their shingles, on average (a set of more is a tile of its own); they bound what a task holds.
TILE, TILE_SHINGLES = 1024, 1 << 18
#: Sets of a key that gives pairs, keys that a pair shares, bytes of narrow rows that are broadcast.
FEW, SHARED, BROADCAST = 24, 3, 64 << 20
#: Documents from which the order of shingles is learned, and shingles that it puts last; they change speed alone.
SAMPLE, LAST = 4000, 1 << 17
_SALT = np.uint64(0xA0761D6478BD642F)


def shingles(w) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of a chunk's texts, distinct, sorted; a text of fewer words is one shingle."""
    g, at = grams(w, SHINGLE)
    of = w.doc[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([mix(np.array([np.bitwise_xor.reduce(mix(w.hash[w.first[i] : w.first[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64) * _SALT)) + np.uint64(n[i])]))[0] for i in short], np.uint64)
        of, g = np.concatenate([of, short]), np.concatenate([g, whole])
    order, first = groups(g, of)
    return of[order][first], g[order][first]


def _sets(w, n_texts: int):
    """Shingles by text with (size, h1, h2) of each text's set."""
    of, g = shingles(w)
    size = np.bincount(of, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(size)])
    none = np.zeros(1, np.uint64)
    sums = np.concatenate([none, np.cumsum(mix(g))]), np.concatenate([none, np.cumsum(mix(g ^ _SALT))])
    h1, h2 = (mix(s[begin[1:]] - s[begin[:-1]] + size.astype(np.uint64)) for s in sums)
    return g, begin, size, h1, h2


# --- signatures ------------------------------------------------------------------------------------


def signature(g: np.ndarray) -> np.ndarray:
    """Bitmap of two to four bits a shingle, as 64-bit words: whether an odd number of hashes fall on each bit."""
    bits = max(64, 1 << int(np.ceil(np.log2(2 * max(len(g), 1)))))
    flags = np.zeros(bits, np.uint8)
    np.bitwise_xor.at(flags, (g & np.uint64(bits - 1)).astype(np.int64), 1)
    return np.packbits(flags).view(np.uint64)


def folded(sign: np.ndarray, width: int) -> np.ndarray:
    """Signatures, one a row, at a width that divides theirs."""
    return np.bitwise_xor.reduce(sign.reshape(len(sign), -1, width), 1)


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Bits in which the signatures of each pair differ, at the narrower one's width."""
    u, v = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a), np.int64)
    for p, q in set(zip(u.tolist(), v.tolist())):
        at = np.flatnonzero((u == p) & (v == q))
        x, y = folded(np.stack([a[i] for i in at]), min(p, q)), folded(np.stack([b[i] for i in at]), min(p, q))
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def _possible(batches):
    """Pairs (a, b) whose sizes and signatures allow a link: overlap <= (na + nb - bits) / 2."""
    for b in batches:
        na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
        near = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
        b, total = b.filter(pa.array(near)), (na + nb)[near]
        if len(b):
            bits = differing(*([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("sa", "sb")))
            yield b.select(["a", "b"]).filter(pa.array(7 * bits <= total))


# --- keys ------------------------------------------------------------------------------------------


def ordering(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that most documents share, which come last in every set. They are learned from
    about SAMPLE documents, at most LAST of them; the result of the join doesn't depend on them."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches):
        for b in batches:
            for _, _, w in words(b.column("text"), lower=True):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(w)[1].view(np.int64))], ["g"])

    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(released(run), "g long")
    often = rows.groupBy("g").count().where("count >= 4").orderBy(F.desc("count"), "g").limit(LAST).toPandas()
    return np.sort(often.g.to_numpy(np.int64).view(np.uint64))


_ROW = "key long, node long, at long, doc struct<doc_id:long,text_hash:long,sign:binary>"


def _scatter(shared, few: int):
    """A row a key of a set: the key, the set (h1), and its size and the key's place, 32 bits each; and a row a document:
    h1, h2, size, ``doc``. A key that is frequent already in a batch gets place -2, with a single row of place -1 as a sign
    to the key's task: -2 rows go anywhere."""

    def send(key, node, n, place, doc=None):
        at = n.astype(np.int64) << 32 | (place.astype(np.int64) & 0xFFFFFFFF)
        doc = pa.nulls(len(key), _DOC) if doc is None else doc
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node.view(np.int64)), pa.array(at), doc], ["key", "node", "at", "doc"])

    def run(batches):
        last = shared.value
        for b in batches:
            has_id = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, w in words(b.column("text"), lower=True):
                g, begin, size, h1, h2 = _sets(w, hi - lo)
                signs = pa.array([signature(g[begin[i] : begin[i + 1]]).tobytes() if size[i] else None for i in range(hi - lo)], pa.binary())
                doc = pa.StructArray.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("text_hash").slice(lo, hi - lo), signs], ["doc_id", "text_hash", "sign"])
                yield send(h1, h2, size, np.full(hi - lo, -3), doc)
                # the prefixes of different sets, in the common order
                can = np.flatnonzero((size > 0) & has_id[lo:hi])
                first = np.zeros(hi - lo, bool)
                first[can[np.unique(h1[can], return_index=True)[1]]] = True
                prefix = np.where(first, np.minimum(size, size - (3 * size + 3) // 4 + SHARED), 0)
                of = np.repeat(np.arange(hi - lo), size)
                late = np.zeros(len(g), bool)
                if len(last):
                    late = last[np.searchsorted(last, g).clip(0, len(last) - 1)] == g
                g = g[np.lexsort((g, late, of))]
                at = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(prefix)[:-1]]), prefix) + np.arange(prefix.sum())
                key, node, n, place = g[at], np.repeat(h1, prefix), np.repeat(size, prefix), at - np.repeat(begin[:-1], prefix)
                order, starts = groups(key)
                count = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
                much = np.zeros(len(key), bool)
                much[order] = count > few
                head = np.zeros(len(key), bool)
                head[order[starts]] = True
                signal = head & much
                if much.any():
                    place[much] = -2
                    yield send(np.concatenate([key, key[signal]]), np.concatenate([node, node[signal]]), np.concatenate([n, n[signal]]), np.concatenate([place, np.full(signal.sum(), -1)]))
                elif len(key):
                    yield send(key, node, n, place)

    return run


_DOC = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sign", pa.binary())])
_FOUND = "kind string, a long, b long, n long, doc struct<doc_id:long,text_hash:long,sign:binary>"


def _pairs(key, node, n, place, few: int):
    """What whole keys, sorted, with different sets each, give: rows (kind, a, b, n): "pair" of sets, the size of the larger; "many": a
    frequent key and its set."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    told = np.bitwise_or.reduceat(place < 0, begin) if len(key) else np.zeros(0, bool)
    frequent = (count > few) | told
    rows = np.repeat(frequent, count)
    yield "many", key[rows], node[rows], n[rows]
    for c in np.unique(count[~frequent & (count > 1)]):
        at = begin[(count == c) & ~frequent][:, None] + np.arange(c)
        i, j = np.triu_indices(c, 1)
        x, y = at[:, i].ravel(), at[:, j].ravel()
        least = (3 * (n[x] + n[y]) + 6) // 7  # the overlap of a link; up to SHARED - 1 came before
        near = (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (np.minimum(n[x] - place[x], n[y] - place[y]) + SHARED - 1 >= least)
        u, v = node[x[near]].view(np.int64), node[y[near]].view(np.int64)
        yield "pair", np.minimum(u, v), np.maximum(u, v), np.maximum(n[x[near]], n[y[near]])


def _found(few: int):
    """Pairs and frequent keys of rows that come sorted by key and set; rows of documents pass. Held at once: a batch, and
    what came before of its first key, unless that is known to be frequent."""

    def send(found):
        for kind, a, b, n in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n), pa.nulls(len(a), _DOC)], ["kind", "a", "b", "n", "doc"])

    def run(batches):
        empty = np.zeros(0, np.int64)
        held, hot = (empty, empty, empty, empty), None
        for b in batches:
            key, node, at = (b.column(c).to_numpy() for c in ("key", "node", "at"))
            n, place = at >> 32, (at & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
            if (doc := place == -3).any():
                m = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * int(doc.sum()), pa.string()), b.column("key").filter(m), b.column("node").filter(m), pa.array(n[doc]), b.column("doc").filter(m)], ["kind", "a", "b", "n", "doc"])
            yield from send([("many", *(x[place == -2] for x in (key, node, n)))])
            key, node, n, place = (np.concatenate([h, x[place > -2]]) for h, x in zip(held, (key, node, n, place)))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (place[1:] < 0)
            key, node, n, place = (x[fresh] for x in (key, node, n, place))
            known = key == hot if hot is not None else np.zeros(len(key), bool)
            yield from send([("many", key[known], node[known], n[known])])
            key, node, n, place = (x[~known] for x in (key, node, n, place))
            open_ = key == key[-1] if len(key) else np.zeros(0, bool)
            yield from send(_pairs(*(x[~open_] for x in (key, node, n, place)), few))
            held = tuple(x[open_] for x in (key, node, n, place))
            if len(held[0]) > 4 * few:
                yield from send([("many", *held[:3])])
                hot, held = held[0][0], (empty, empty, empty, empty)
        yield from send(_pairs(*held, few))

    return run


# --- tiles -----------------------------------------------------------------------------------------


def _bands(n: np.ndarray, signs: list[np.ndarray]):
    """(i, later rows of near size, bits in which their signatures differ from that of i), for rows sorted by size."""
    widths = np.array([len(x) for x in signs])
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))  # those of near size and not smaller
        table = np.concatenate([folded(np.stack([signs[k] for k in at if widths[k] == x]), width) for x in (width, 2 * width) if (widths == x).any()])
        sizes = n[at]
        for k in range(int((widths[at] == width).sum())):
            z = int(np.searchsorted(sizes, sizes[k] * 4 // 3, "right"))
            if z > k + 1:
                yield at[k], at[k + 1 : z], np.bitwise_count(table[k + 1 : z] ^ table[k]).sum(1).astype(np.int64)


def linked(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links at 100 * intersection >= 75 * union that span the components of the sets, where sets of one label are
    connected already. Where two sides occur, only sets of different sides are compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    ids, side, sets = ids[order], side[order], [sets[i] for i in order]
    n = np.array([len(x) for x in sets])
    part, out = np.unique(label[order], return_inverse=True)[1], []
    both_sides = side.any() and not side.all()
    for i, j, bits in _bands(n, [signature(x) for x in sets]):
        ok = (7 * bits <= n[i] + n[j]) & (part[j] != part[i])
        if both_sides:
            ok &= side[j] != side[i]
        for k in j[ok]:
            if part[k] == part[i]:
                continue
            a, b = sets[i], sets[k]
            overlap = int((b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a).sum())
            if 100 * overlap >= 75 * (len(a) + len(b) - overlap):
                part[part == part[k]] = part[i]
                out.append((int(ids[i]), int(ids[k])))
    return out


def _active(ids: np.ndarray, n: np.ndarray, signs: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int, int]]:
    """(set, its label, a label) of the sets whose signatures allow a link to one of another label; the last is the same for labels
    that such pairs connect."""
    order = np.argsort(n, kind="stable")
    ids, n, side, label, signs = ids[order], n[order], side[order], label[order], [signs[i] for i in order]
    names, own = np.unique(label, return_inverse=True)
    part, active = np.arange(len(names)), np.zeros(len(ids), bool)
    both_sides = side.any() and not side.all()
    for i, j, bits in _bands(n, signs):
        ok = (7 * bits <= n[i] + n[j]) & (own[j] != own[i])
        if both_sides:
            ok &= side[j] != side[i]
        if ok.any():
            active[i] = True
            active[j[ok]] = True
            for p in np.unique(part[own[j[ok]]]):
                part[part == p] = part[own[i]]
    return [(int(ids[k]), int(label[k]), int(names[part[own[k]]])) for k in np.flatnonzero(active)]


def _by_unit(batches, columns: list[str], work, out: list[str]):
    """What ``work`` gives for the rows of each unit; rows come sorted by unit, the first column."""
    now, rows, found = None, [], []
    send = lambda f: pa.RecordBatch.from_arrays([pa.array([x[i] for x in f], pa.int64()) for i in range(len(out))], out)
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            if row[0] != now:
                found += work(rows) if len(rows) > 1 else []
                now, rows = row[0], []
            if not rows or row != rows[-1]:  # a row of documents may repeat
                rows.append(row)
        if len(found) > 10_000:
            yield send(found)
            found = []
    found += work(rows) if len(rows) > 1 else []
    if found:
        yield send(found)


def _compare_signs(batches):
    def work(rows):
        _, ids, n, sign, label, side = zip(*rows)
        return _active(np.array(ids), np.array(n), [np.frombuffer(x, np.uint64) for x in sign], np.array(label), np.array(side))

    return _by_unit(batches, ["unit", "id", "n", "sign", "label", "side"], work, ["id", "label", "root"])


def _compare_texts(batches):
    def work(rows):
        _, ids, text, label, side = zip(*rows)
        sets = []
        for lo, hi, w in words(pa.array(text, pa.large_string()), lower=True):
            g, begin, *_ = _sets(w, hi - lo)
            sets += [g[a:z] for a, z in zip(begin[:-1], begin[1:])]
        return linked(np.array(ids), sets, np.array(label), np.array(side))

    return _by_unit(batches, ["unit", "id", "text", "label", "side"], work, ["a", "b"])


def tiles_of(sets, shingles, tile: int):
    """How many tiles hold so many sets of so many shingles together."""
    return F.greatest(F.ceil(sets / tile), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _units(sets: DataFrame, tile: int) -> DataFrame:
    """A row for each unit that a set of (cluster, id, n, ...) is compared in, with ``side``: its cluster, or, in a large cluster, every pair
    of tiles of the same or neighbouring bands of size."""
    sets = sets.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(1.34))).cast("int"))
    counts = sets.groupBy("cluster", "band").agg(tiles_of(F.count("*"), F.sum("n"), tile).alias("t"), F.count("*").alias("c"), F.sum("n").alias("shingles"))
    tiles = counts.groupBy("cluster").agg(tiles_of(F.sum("c"), F.sum("shingles"), tile).alias("all"), F.map_from_entries(F.collect_list(F.struct("band", "t"))).alias("tiles"))
    sets = sets.join(tiles, "cluster")
    count = lambda b: F.coalesce(F.try_element_at("tiles", b), F.lit(0))
    sets = sets.withColumn("tile", F.pmod(F.xxhash64("id"), count(F.col("band"))).cast("int"))
    each = lambda b: F.when(count(b) > 0, F.sequence(F.lit(0), count(b) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda b1, t1, b2, t2: F.concat_ws(".", "cluster", b1, t1, b2, t2)
    own, up, down = F.col("band"), F.col("band") + 1, F.col("band") - 1
    unit = lambda n, s: F.struct(n.alias("unit"), s.alias("side"))
    many = F.concat(
        F.transform(each(own), lambda j: unit(name(own, F.least("tile", j), own, F.greatest("tile", j)), F.col("tile") > j)),
        F.transform(each(up), lambda j: unit(name(own, F.col("tile"), up, j), F.lit(False))),
        F.transform(each(down), lambda j: unit(name(down, j, own, F.col("tile")), F.lit(True))),
    )
    one = F.array(unit(F.col("cluster").cast("string"), F.lit(False)))
    return sets.withColumn("u", F.explode(F.when(F.col("all") == 1, one).otherwise(many))).select("*", "u.unit", "u.side").drop("u", "tiles", "all", "band", "tile")


def _few(units: DataFrame) -> DataFrame:
    """``units`` marked for broadcast if their rows take at most BROADCAST bytes; else a join with them is shuffled."""
    size = units.agg(F.sum(F.octet_length("unit") + F.lit(64).cast("long"))).first()[0] or 0
    return F.broadcast(units) if size <= BROADCAST else units


def joined(docs: DataFrame, tile: int = TILE, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row a document.

    A null or empty text, or one of white space, has no shingles and is its own component, as is every document
    without a doc_id (null component). Rows that repeat, and documents with equal sets, share a component. An empty
    table gives an empty one; other columns are ignored. ``tile`` and ``few`` change the work, not the result."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    order = spark.sparkContext.broadcast(ordering(docs))  # at most LAST numbers
    keys = docs.mapInArrow(released(_scatter(order, few)), _ROW)
    salted = F.when(F.col("at").bitwiseAND(0xFFFFFFFF) == 0xFFFFFFFE, F.xxhash64("key", "node")).otherwise(F.col("key"))
    found = written(keys.repartition(n, salted).sortWithinPartitions("key", "node").mapInArrow(released(_found(few)), _FOUND), "keys")

    table = found.where("kind = 'doc'").select(F.col("a").alias("h1"), F.col("b").alias("h2"), "n", "doc.*")
    sets = table.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    sets = written(sets.select("h1", "h2", F.col("f.doc_id").alias("id"), "f.text_hash", "n", "sign"), "sets")
    many = found.where("kind = 'many'").select(F.col("a").alias("key"), F.col("b").alias("h1")).distinct()
    many = written(many.join(sets.select("h1", "id", "n"), "h1").select("key", "id", "n"), "many")

    # pairs of rare keys, and of the first set of a frequent key with the others
    named = lambda h, x: sets.select(F.col("h1").alias(h), F.col("id").alias(x))
    rare = found.where("kind = 'pair'").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    rare = rare.where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * 3 / 4))).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    rare = rare.join(named("ha", "a"), "ha").join(named("hb", "b"), "hb").select("a", "b")
    hubs = many.groupBy("key").agg(F.min("id").alias("a"))
    pairs = rare.union(many.join(hubs, "key").select("a", F.col("id").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    part = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sign").alias(f"s{x}"))
    open_ = written(pairs.join(part("a"), "a").join(part("b"), "b").mapInArrow(released(_possible), "a long, b long"), "pairs")

    def compared(units: DataFrame) -> DataFrame:
        meant = written(units.distinct().join(sets.select("id", "text_hash"), "id").withColumnRenamed("id", "doc_id"), "units")
        rows = docs.join(_few(meant), ["doc_id", "text_hash"]).select("unit", F.col("doc_id").alias("id"), "text", "label", "side")
        return written(rows.repartition(n, "unit").sortWithinPartitions("unit", "id").mapInArrow(released(_compare_texts), "a long, b long"), "links")

    # each set with its smallest partner; a set that is the smallest of many meets them in units of ``tile``
    tree = open_.groupBy("a").agg(F.min("b").alias("b"))
    near = tree.join(sets.select(F.col("id").alias("a"), "n"), "a").groupBy("b").agg(tiles_of(F.count("*"), F.sum("n"), tile).alias("k"))
    tree = tree.join(near, "b")
    unit = lambda k: F.concat_ws(".", "b", k)
    child = tree.select(unit(F.pmod(F.xxhash64("a"), "k")).alias("unit"), F.col("a").alias("id"), F.col("a").alias("label"), F.lit(False).alias("side"))
    parent = tree.select("b", "k").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(unit(F.col("i")).alias("unit"), F.col("b").alias("id"), F.col("b").alias("label"), F.lit(True).alias("side"))
    links = compared(child.union(parent))
    label = written(components(links).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")

    # what lies in different components yet
    labelled = lambda df, x, y: df.join(label.select(F.col("id").alias(x), F.col("label").alias(y)), x, "left").withColumn(y, F.coalesce(y, x))
    rest = labelled(labelled(open_.join(tree, ["a", "b"], "left_anti"), "a", "la"), "b", "lb").where("la <> lb")
    rest = rest.select(F.col("a").alias("id"), F.col("la").alias("label"), F.col("lb").alias("root")).union(rest.select("b", "lb", "lb"))
    of = labelled(many, "id", "label")
    several = of.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"), F.count("*").alias("c")).where("x < y")
    several = several.groupBy("members", "c").agg(F.min("key").alias("key"))  # keys of the same sets are compared once
    tiled = _units(of.join(several, "key", "left_semi").withColumnRenamed("key", "cluster"), tile).join(sets.select("id", "sign"), "id")
    tiled = tiled.select("unit", "id", "n", "sign", "label", "side").repartition(n, "unit").sortWithinPartitions("unit")
    active = written(rest.union(tiled.mapInArrow(released(_compare_signs), "id long, label long, root long")).distinct(), "active")
    clusters = components(active.select(F.col("label").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    chosen = active.select("id", "label").distinct().join(clusters, "label").join(sets.select("id", "n"), "id")
    links = links.union(compared(_units(chosen, tile).select("unit", "id", "label", "side")))

    found = components(links).select(F.col("node").alias("id"), "component")
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(sets.select("h1", "h2", "id"), ["h1", "h2"], "left").join(found, "id", "left")
    linked_ = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(linked_, F.coalesce("component", "id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, unchanged, whatever their other columns are named.

    Of rows with one doc_id each different text stays, once: with the row that is first by a hash of all its columns. Rows
    without a doc_id all stay; an empty table gives an empty one."""
    ids = written(joined(docs).where("component_id = doc_id").groupBy("doc_id").count(), "kept")
    small = ids.count() * 16 <= BROADCAST  # two numbers a row
    several = ids.where("count > 1")
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = lambda some: rows.join(F.broadcast(some) if small else some, "doc_id", "left_semi")
    out = kept(ids.where("count = 1")).select("row").union(rows.where("doc_id is null").select("row"))
    if not several.isEmpty():
        first = kept(several).groupBy("doc_id", F.xxhash64("row.text").alias("text_hash")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.union(first.select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_bitmap_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir))
