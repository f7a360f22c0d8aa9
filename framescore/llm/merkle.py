"""Merkle manifest of a dataset: a tree of 16 a source, and one over the sources' roots, by windows.

A document's leaf digests its fields. On each level a window over nodes in order brings a node the 15 before and after it
by lag and lead; those outside its run of 16, by its slot and the run's length, are masked. The first of a run hashes the
parent. Going down again, a node's path to the root is its own siblings and its parent's path, so that a document
gets its proof from one join with a table of a sixteenth of its rows.

Windows and joins are cut into chunks of whole runs, so that a source with a third of all rows is many tasks. Only digests
are shuffled, never texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.llm.common import ascii_lower, documents, written

#: Children of a node, and nodes of a chunk: whole runs, whose parents are whole runs again.
ARITY, CHUNK = 16, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of fields: "-" for null, else the bytes of its text, a colon and the text."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(*(one(c.cast("string")) for c in fields))


def lowered_fifth(doc_id: Column, text: Column) -> Column:
    """A tampered text: of every document whose crc32(doc_id as text) 5 divides, with A-Z lower-cased; null stays."""
    return F.when((F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0) & text.isNotNull(), ascii_lower(text)).otherwise(text)


def numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place among those of their ``g`` in the order of ``by`` (gapless from 0; equal ones in any order),
    and ``n``, how many these are. A range of the order is a task; the ranges' counts give each its first place."""
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())
    order = ["g", *by, "_tie"]
    placed = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = placed.groupBy("g", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_c"))  # a row a range and group
    before = F.coalesce(F.sum("_c").over(W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_c").over(W.partitionBy("g")).alias("n"))
    return placed.join(parts, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def beside(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, n, pos, hash) with ``chunk`` and ``left`` and ``right``, the digests before and after each in its run, joined."""
    w = W.partitionBy("g", "chunk").orderBy("pos")
    slot = F.col("pos") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - (F.col("pos") - slot))
    left = [F.coalesce(F.when(slot >= k, F.lag("hash", k).over(w)), F.lit("")) for k in range(ARITY - 1, 0, -1)]
    right = [F.coalesce(F.when(slot + k < run, F.lead("hash", k).over(w)), F.lit("")) for k in range(1, ARITY)]
    return nodes.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).withColumn("left", F.concat(*left)).withColumn("right", F.concat(*right))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees of ``leaves`` (g, n, pos, hash), lowest first; a group ends on the level where it is one node."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        firsts = beside(out[-1].select("g", "n", "pos", "hash").where("n > 1")).where(F.col("pos") % ARITY == 0)
        up = firsts.select("g", F.ceil(F.col("n") / ARITY).alias("n"), F.floor(F.col("pos") / ARITY).alias("pos"), digest(F.col("hash"), F.col("right")).alias("hash"))
        out.append(written(up, "level"))
        most = -(-most // ARITY)
    return out


def paths(trees: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with ``path``, siblings (left, right) from each leaf to the root, and the columns of ``above`` (g, path,
    more): the path beyond a group's own root."""
    more = [c for c in above.columns if c not in ("g", "path")]
    found = None
    for i in range(len(trees) - 1, -1, -1):
        ends = trees[i].where("n = 1").select("g", F.lit(0).cast("long").alias("up")).join(above, "g")
        upper = ends if found is None else found.select("g", F.col("pos").alias("up"), "path", *more).unionByName(ends)
        upper = upper.withColumn("chunk", F.floor(F.col("up") / (CHUNK // ARITY)))
        under = F.col("pos") - ARITY * F.col("up")
        rows = beside(trees[i]).join(upper.withColumnRenamed("g", "_g").withColumnRenamed("chunk", "_chunk"), (F.col("g") == F.col("_g")) & (F.col("chunk") == F.col("_chunk")) & (under >= 0) & (under < ARITY))
        rows = rows.withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct("left", "right")), F.col("path"))))
        found = rows.select(*trees[i].columns, "path", *more)
        if i:
            found = written(found, "paths")
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, tampered=lowered_fifth) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a document.

    Leaves are ordered by doc_id (null first), those of one doc_id by digest; rows that repeat are leaves of their own, and
    change places unseen. Null and empty fields differ ("-" and "0:"), a null source comes first and is not an
    empty one. An empty table gives an empty one; other columns are ignored, whatever their names. ``tampered`` is a
    function of (doc_id, text) columns that gives the text to verify against the manifest."""
    own = [F.col(c) for c in FIELDS]
    # null sources sort before all others, also the empty one
    group = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    rows = docs.select(group.alias("g"), "doc_id", leaf(*own).alias("hash"), leaf(*own[:-1], tampered(F.col("doc_id"), F.col("text"))).alias("given"))
    trees = levels(numbered(rows, ["doc_id", "hash"]))

    ends = [t.where("n = 1").select("g", "hash") for t in trees]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.union(e)
    subroots = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "hash"), ["source"])
    top = levels(subroots)
    root = top[-1].where("n = 1").select("hash").first()  # one row
    none = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(PATH).alias("path"))
    above = written(paths(top, none).select(F.col("source").alias("g"), "path", F.col("hash").alias("subroot")), "above")

    out = paths(trees, above)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("given"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))
