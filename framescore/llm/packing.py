"""Packing of documents into fixed windows by non-negative least squares over length combinations.

Lengths are binned (64 bins a window, rounded up). A combination is up to three stacks of one bin, repeated 1, 2, 4, ...
times, that fill the window exactly. Repeat counts that reproduce the histogram of lengths come from non-negative
least squares; they are rounded down and given to documents by their rank in the bin. What is left is packed greedily: it
is cut to fill the slack that rounding up leaves in planned windows, and then windows of its own.
The driver sees 64 bins and at most some thousand combinations, whatever the input."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.llm.common import binary, documents, partitions, released, words, written

WINDOW, BINS, END_ID = 4096, 64, 2
#: Words whose ids a worker process keeps.
KEPT_WORDS = 1_200_000
#: Words that the tokenizer takes at once, which holds far more a word than its ids, and bytes of text worked on at once: two workers share an
#: executor's memory with a heap that is as large as it may be.
GIVEN_WORDS, TEXT_BYTES = 2048, 1 << 19
#: Letters, digits and punctuation of ASCII, between which this vocabulary always cuts. The apostrophe, which begins
#: contractions, control characters and other bytes (0) may belong to either side.
CUTS = np.zeros(256, np.uint8)
CUTS[[*range(65, 91), *range(97, 123)]] = 1
CUTS[48:58] = 2
CUTS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = 3


# --- tokens ----------------------------------------------------------------------------------------


class Encoder:
    """Ids of the words of many texts: each distinct word, in lower case, goes to the tokenizer once, as this vocabulary
    lower-cases and never joins characters over ASCII white space or over a cut (``CUTS``)."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, vocab: str) -> Encoder:
        """The one of this worker process, which keeps its words from task to task."""
        if vocab not in cls._kept:
            cls._kept[vocab] = cls(vocab)
        return cls._kept[vocab]

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocab)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)

    def whole(self, text: np.ndarray) -> np.ndarray:
        """Ids of a text that may hold special tokens."""
        return np.array(self.tok.encode(text.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def ids(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the words in order, ids before each word and one more)."""
        if len(self.keys) > KEPT_WORDS:
            self.clear()
        u, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, u)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == u[known]
        slots = np.zeros(len(u), np.int64)
        slots[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            sizes, flat = [], []
            for a in range(0, len(new), GIVEN_WORDS):
                found = [e.ids for e in self.tok.encode_batch_fast([w.word(i).decode("utf-8", "replace") for i in first[new[a : a + GIVEN_WORDS]]], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                flat.append(np.fromiter((i for x in found for i in x), self.flat.dtype))
            slots[new] = np.arange(len(self.keys), len(self.keys) + len(new))
            self.keys, self.slots = np.insert(self.keys, place[new], u[new]), np.insert(self.slots, place[new], slots[new])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
            self.flat = np.concatenate([self.flat, *flat])
        s = slots[inverse]
        n = self.at[s + 1] - self.at[s]
        before = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.at[s] - before[:-1], n) + np.arange(before[-1])], before


def _tokenised(vocab: str, window: int, end_id: int, kind: str):
    def run(batches):
        enc = Encoder.of(vocab)
        for b in batches:
            for lo, hi, w in words(b.column("text"), lower=True, size=TEXT_BYTES, classes=CUTS):
                flat, before = enc.ids(w)
                marks = np.flatnonzero((w.buf[:-1] == ord("<")) & (w.buf[1:] == ord("|")))
                special = {int(i): enc.whole(w.buf[w.offs[i] : w.offs[i + 1]]) for i in set(np.searchsorted(w.offs, marks, "right") - 1)}
                keys = b.column("doc_id").slice(lo, hi - lo)
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i in range(hi - lo):
                    ids = special[i] if i in special else flat[before[w.first[i]] : before[w.first[i + 1]]]
                    ids = np.append(ids, end_id).astype("<u4")
                    for a in range(0, len(ids), window):
                        piece = ids[a : a + window]
                        row.append(i)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                        kept.append(None if len(piece) == window else piece.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), binary(kept)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


# --- the plan --------------------------------------------------------------------------------------


def combinations(bins: int = BINS) -> np.ndarray:
    """Columns of how often a combination holds each bin (row b-1 for bin b): up to three stacks that fill ``bins``."""
    stacks = [(b, r) for b in range(1, bins + 1) for r in (1, 2, 4, 8, 16, 32, 64) if b * r <= bins]
    by_size: dict[int, list] = {}
    for s in stacks:
        by_size.setdefault(s[0] * s[1], []).append(s)
    found = {(s,) for s in by_size[bins]}
    for s in stacks:
        found |= {tuple(sorted((s, t))) for t in by_size.get(bins - s[0] * s[1], []) if t[0] != s[0]}
        for t in stacks:
            if t[0] < s[0]:
                found |= {(t, s, u) for u in by_size.get(bins - s[0] * s[1] - t[0] * t[1], []) if u[0] > s[0]}
    out = np.zeros((bins, len(found)))
    for k, combo in enumerate(sorted(found)):
        for b, r in combo:
            out[b - 1, k] = r
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes |a x - h| least: an active-set search that solves the unconstrained problem on the free columns
    and steps back to the border where a value turns negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (h - a @ x)
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(h.max(initial=0))):
            break
        free[k] = True
        while True:
            cols = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, cols], h, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            down = z <= 0
            have = x[cols]
            step = np.min(have[down] / np.maximum(have[down] - z[down], 1e-300))
            x[cols] = have + step * (z - have)
            free[cols[(x[cols] <= 1e-12)]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(counts: np.ndarray, tokens: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (bin, first rank, rank after the last, repeats, first window, stack) from documents and tokens in each bin.

    The solution is scaled so that what stays unplanned suffices to fill the slack of planned windows."""
    a = combinations(len(counts))
    x = nnls(a, counts.astype(float))
    mean = tokens / np.maximum(counts, 1)
    best = None
    for share in np.arange(1.0, -0.001, -0.01):
        left, chosen = counts.copy(), []
        for k in np.argsort(-x, kind="stable"):
            if x[k] * share < 1:
                break
            need = a[:, k].astype(np.int64)
            n = min(int(x[k] * share), int((left[need > 0] // need[need > 0]).min()))
            if n > 0:
                chosen.append((k, n))
                left -= n * need
        slack = sum(n for _, n in chosen) * window - float(((counts - left) * mean).sum())
        if best is None or slack <= float((left * mean).sum()):
            best = chosen
        if slack <= float((left * mean).sum()):
            break
    rank, base, out = np.zeros(len(counts), np.int64), 0, []
    for k, n in best or []:
        for stack, b in enumerate(np.flatnonzero(a[:, k])):
            r = int(a[b, k])
            out.append((int(b) + 1, int(rank[b]), int(rank[b]) + n * r, r, base, stack))
            rank[b] += n * r
        base += n
    return out


def _before(df: DataFrame, value: str, order: list[str], salts: int) -> DataFrame:
    """``df`` with ``_before``, the sum of ``value`` over all rows that come earlier: by salt, then ``order``. Only one
    row a salt meets in one task."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    totals = df.groupBy("_salt").agg(F.sum(value).alias("_t"))
    totals = totals.select("_salt", F.coalesce(F.sum("_t").over(W.orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("_salt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(totals, "_salt").withColumn("_before", F.col("_base") + F.col("_inner")).drop("_salt", "_inner", "_base")


def packed(docs: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID, bins: int = BINS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is its end id alone, equal rows are
    packed as separate rows, a text longer than a window is cut into whole windows and a rest, and an empty table
    gives an empty one. Ids are kept only of rests, which the greedy step may cut."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(vocab).get_vocab_size() <= 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    pieces = docs.select("doc_id", "text").mapInArrow(released(_tokenised(vocab, window, end_id, kind)), f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    narrow = pieces.drop("ids")
    rests = narrow.where(F.col("length") < window).withColumn("bin", F.ceil(F.col("length") * bins / window).cast("int"))

    counts, tokens = np.zeros(bins, np.int64), np.zeros(bins)
    for r in rests.groupBy("bin").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect():  # a row a bin
        counts[r.bin - 1], tokens[r.bin - 1] = r.n, r.t
    slots = plan(counts, tokens, window)
    n_planned = max((base + (hi - lo) // r for _, lo, hi, r, base, _ in slots), default=0)

    salts = 4 * partitions(spark)
    ranked = rests.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    offsets = ranked.groupBy("bin", "_salt").agg(F.count("*").alias("_n"))
    offsets = offsets.select("bin", "_salt", F.coalesce(F.sum("_n").over(W.partitionBy("bin").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = ranked.withColumn("_rn", F.row_number().over(W.partitionBy("bin", "_salt").orderBy("uid")) - 1).join(offsets, ["bin", "_salt"])
    ranked = ranked.withColumn("rank", F.col("_base") + F.col("_rn")).drop("_base", "_rn", "_salt")
    # an Arrow table stays in the JVM, where a list starts Python workers of another kind, which stay beside those of tasks
    names, types = ["bin", "lo", "hi", "repeats", "base", "stack"], [pa.int32(), *[pa.int64()] * 4, pa.int32()]
    slot = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*(slots or [(0, 0, 0, 1, 0, 0)])), types)], names))
    placed = written(ranked.join(F.broadcast(slot.withColumnRenamed("bin", "_bin")), (F.col("bin") == F.col("_bin")) & F.col("rank").between(F.col("lo"), F.col("hi") - 1), "left").withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("repeats"))).select(*narrow.columns, "sequence_id", "stack", "rank"), "placed")

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    planned = placed.where("sequence_id is not null")
    inside = W.partitionBy("sequence_id").orderBy("stack", "rank")
    planned_rows = planned.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(*out)
    full = narrow.where(F.col("length") == window)

    # the rest, end to end, flows into the slack of planned windows and then into new windows
    slack = planned.groupBy("sequence_id").agg(F.sum("length").alias("fill")).select("sequence_id", "fill", (window - F.col("fill")).alias("room")).where("room > 0")
    room = slack.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    stream = placed.where("sequence_id is null").drop("sequence_id", "stack", "rank")
    flow = stream.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_extra = -(-max(0, flow - room) // window)
    holes = _before(slack, "room", ["sequence_id"], salts).select("sequence_id", "fill", F.col("_before").alias("h0"), (F.col("_before") + F.col("room")).alias("h1"))
    more = spark.range(n_extra).select((F.col("id") + n_planned).alias("sequence_id"), F.lit(0).alias("fill"), (F.lit(room) + F.col("id") * window).alias("h0"), (F.lit(room) + (F.col("id") + 1) * window).alias("h1"))
    step = 1 << 14
    cells = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / step), F.floor((F.col(b) - 1) / step))))
    flowing = _before(stream, "length", ["uid"], salts).withColumnRenamed("_before", "s0").withColumn("s1", F.col("s0") + F.col("length"))
    cut = cells(flowing, "s0", "s1").join(cells(holes.union(more), "h0", "h1"), "cell").withColumn("lo", F.greatest("s0", "h0")).withColumn("hi", F.least("s1", "h1"))
    cut = cut.where(F.col("lo") < F.col("hi")).where(F.col("cell") == F.floor(F.col("lo") / step))
    cut = written(cut.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.col("fill") + F.col("lo") - F.col("h0")).alias("offset"), (F.col("lo") - F.col("s0")).alias("skip"), (F.col("hi") - F.col("lo")).alias("take")), "cut")
    whole = cut.where(F.col("take") == F.col("length"))
    parts = cut.where(F.col("take") < F.col("length")).join(pieces.select("uid", "ids").hint("merge"), "uid")

    def crc(batches):
        for b in batches:
            got = [zlib.crc32(np.frombuffer(x[s * width : (s + t) * width], kind).astype("<u4").tobytes()) for x, s, t in zip(b.column("ids").to_pylist(), b.column("skip").to_pylist(), b.column("take").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "take")), pa.array(got, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], out)

    parts = parts.withColumn("start", F.col("start") + F.col("skip")).select("doc_id", "start", "take", "doc_tokens", "sequence_id", "offset", "skip", "ids").mapInArrow(released(crc), planned_rows.select(*out).schema)
    parts = written(parts, "parts")  # in batches of its size, as ids are large
    full_rows = full.withColumn("sequence_id", F.col("uid") + (n_planned + n_extra)).withColumn("offset", F.lit(0).cast("long"))
    return planned_rows.unionByName(full_rows.select(*out)).unionByName(whole.select(*out)).unionByName(parts)


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
