"""How the sources of a language differ in their words: divergences of all pairs of sources, by a cube of cells.

Terms are counted by source while texts are read (Arrow kernels; a row a batch, source and term leaves a task). Of each
language the terms of enough documents stay. Sources are dealt into blocks and terms into blocks; a cell of the cube is two
blocks of sources and one of terms. A slice, the counts of one source in one block of terms, is sent to each cell of
its block of sources; the cell sums the divergence of its pairs of sources over its terms; sums over the
term axis give the whole. All numbers are integers, so the sums are exact in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.llm.common import CHUNK, documents, written

#: Documents of a language that a term needs, parts that probabilities are counted in, and terms told a source.
LEAST, UNIT, TOP = 3, 1_000_000_000, 200
#: Sources and terms of a block (on average; they are dealt by hash). They change the work, not the result.
GROUPS, TERMS = 32, 4096

_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about CHUNK bytes of text; a longer text is a piece of its own."""
    ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy())
    lo = 0
    while lo < len(b):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of each piece: occurrences of a term and documents with it; and a row with a null term for each
    group that occurs."""
    for whole in batches:
        for b in _pieces(whole):
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(k, len(groups)) for k in zip(b.column("lang").fill_null("").to_pylist(), b.column("source").fill_null("").to_pylist())], np.int64)
            lists = pc.split_pattern_regex(pc.ascii_lower(b.column("text").fill_null("")), _BETWEEN)
            terms = lists.flatten().dictionary_encode()
            words, code = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            keep = real[code] if len(code) else np.zeros(0, bool)
            size = max(len(words), 1)
            seen, times = np.unique(row[keep] * size + code[keep], return_counts=True)  # a document's terms
            key, where = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
            n = np.bincount(where, times, len(key)).astype(np.int64)
            df = np.bincount(where, minlength=len(key)).astype(np.int64)
            names = list(groups)
            lang, source = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
            at = pa.array(key // size)
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), words.take(pa.array(key % size)), pa.array(n), pa.array(df)], schema=_COUNTS)
            none = np.zeros(len(names), np.int64)
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), pa.array(none), pa.array(none)], schema=_COUNTS)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact whatever the counts; 1 where there is neither."""
    parts = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")  # a count times UNIT may be beyond a long
    return F.when(total + terms > 0, 1 + F.call_function("div", parts, (total + terms).cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a cell: of every ordered pair of its sources (of different blocks, if it has two) the sum over the terms that any of its
    sources has, and the number of these."""
    ids = [np.asarray(x, np.int64) for x in rows.ids]
    every = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64)
    p = np.repeat(rows.p0.to_numpy(np.int64)[:, None], len(every), 1)
    for i, (x, y) in enumerate(zip(ids, rows.ps)):
        p[i, np.searchsorted(every, x)] = np.asarray(y, np.int64)
    block, a, b = rows.block.to_numpy(), rows.a.iloc[0], rows.b.iloc[0]
    out = []
    for i in range(len(rows)):
        other = np.flatnonzero((block == b) if block[i] == a else (block == a))
        other = other[other != i]
        step = p[i] - p[other]
        out.append((np.full(len(other), i), other, (step * step // p[other]).sum(1)))
    i, j, s = (np.concatenate(x) for x in zip(*out))
    source, p0 = rows.source.to_numpy(), rows.p0.to_numpy()
    return pd.DataFrame({"lang": rows.lang.iloc[0], "source": source[i], "item": source[j], "v": rows.v.iloc[0], "part": s, "seen": len(every), "p0": p0[i], "q0": p0[j]})


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair", a row for each other source of the language; part "term", the terms
    that a source has more of than its language, at most ``top``.

    Null text, lang and source count as empty; each row is a document of its own, also one that repeats. A source without
    terms, or a language without kept terms, has pairs all the same, of value 0 in the latter. Ties are ranked by the item's
    bytes. An empty table gives an empty one; other columns are ignored. ``groups`` and ``terms`` change the work alone."""
    found = docs.select("lang", "source", "text").mapInArrow(_term_counts, "lang string, source string, term string, n long, df long")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least)
    kept = written(kept.drop("df").withColumn("id", F.monotonically_increasing_id()), "kept")
    own = written(counts.where("term is not null").drop("df").join(kept, ["lang", "term"]), "kept_counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))  # a row a language
    sources = counts.select("lang", "source").distinct().join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    sources = sources.fillna(0, ["total", "v", "total_lang"]).withColumn("p0", share(F.lit(0), F.col("total"), F.col("v")))
    sources = written(sources.withColumn("g", F.monotonically_increasing_id()), "sources")
    blocks = sources.groupBy("lang").agg(F.ceil(F.count("*") / groups).alias("nb"))
    sized = sources.join(blocks, "lang").withColumn("nt", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / terms)))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("g"), F.col("nb")))
    rows = own.join(sized.select("lang", "source", "g", "total", "v", "total_lang", "nt"), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    q = share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    best = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(best).where(F.col("rank") <= top)

    slices = rows.groupBy("g", F.pmod(F.xxhash64("id"), F.col("nt")).alias("t")).agg(F.collect_list(F.struct("id", "p")).alias("x"))  # about ``terms`` each
    every = sized.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1))).join(slices, ["g", "t"], "left")
    every = every.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    part = lambda c: F.coalesce(F.col(f"x.{c}"), F.array().cast("array<bigint>")).alias(f"{c}s")
    cube = every.select("lang", "source", "v", "p0", "t", "block", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), part("id"), part("p"))
    sums = cube.groupBy("lang", "a", "b", "t").applyInPandas(_cells, "lang string, source string, item string, v long, part long, seen long, p0 long, q0 long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("part").alias("s"), F.sum("seen").alias("seen"), F.first("v").alias("v"), F.first("p0").alias("p0"), F.first("q0").alias("q0"))
    # terms that no source of any of the pair's cells has are alike
    value = F.col("s") + (F.col("v") - F.col("seen")) * gap(F.col("p0"), F.col("q0"))
    pairs = ranked(whole.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))
    return pairs.union(best)


def op12_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))
