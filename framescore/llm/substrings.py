"""Removal of word windows that an earlier document has, by repeated-phrase automata.

Every window of 13 words has one anchor, the run of five words in it with the smallest hash, so copies of a window share
their anchor. Anchors of two different texts are found by hash; only segments around those travel as text. Shards of
segments confirm which windows recur, word by word, and in which document first; each shard compiles those
phrases into an Aho-Corasick automaton over words, and streams its documents' segments through it to find every place.
Texts with the same words count once: the first keeps its windows to be compared, the others lose all of theirs."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import BLOCK, block, block_rows, bucketed, by_bucket, documents, grams, groups, mix, partitions, words, written

WINDOW, ANCHOR = 13, 5
#: Segments of one anchor in a shard before the anchor is dealt to several.
SEGMENTS = 50_000
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


def anchors(w, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, word where its anchor begins, the anchor's hash) of all windows of a chunk."""
    g, at = grams(w, anchor)
    m = len(w.hash) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    by_word = np.full(len(w.hash), ~np.uint64(0), np.uint64)
    by_word[at] = g
    least, place = by_word[:m].copy(), np.arange(m)
    for j in range(1, window - anchor + 1):
        here = by_word[j : j + m]
        less = here < least
        least[less] = here[less]
        place[less] = np.flatnonzero(less) + j
    own = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :])
    return own, place[own], least[own]


def text_ids(w, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the word sequence of each text."""
    none, n = np.zeros(1, np.uint64), np.diff(w.first)
    index = (np.arange(len(w.hash)) - w.first[w.doc]).astype(np.uint64)
    out = []
    for salt in (np.uint64(0), _SALT):
        sums = np.concatenate([none, np.cumsum(mix(mix(w.hash ^ salt) + index * np.uint64(0x9E3779B97F4A7C15)))])
        out.append(mix(sums[w.first[1:]] - sums[w.first[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def _scatter(buckets: int):
    def run(batches):
        task = TaskContext.get().partitionId() << 24
        for k, b in enumerate(batches):
            ids = b.column("doc_id").to_pylist()
            has_id = np.array([i is not None for i in ids])
            sizes, first, second, keys, texts, places = [], [], [], [], [], []
            for lo, hi, w in words(b.column("text"), lower=False):
                t1, t2 = text_ids(w, hi - lo)
                _, place, key = anchors(w)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                new &= has_id[lo:hi][w.doc[place]]
                place, key = place[new], key[new]
                keys.append(key)
                texts.append(t1[w.doc[place]])
                places.append((place - w.first[w.doc[place]]).astype(np.uint32))
                sizes.append(np.diff(w.first))
                first.append(t1)
                second.append(t2)
            if not ids:
                continue
            sha = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).digest() for t in b.column("text").to_pylist()]
            home = int(mix(np.array([task | k], np.uint64))[0] % np.uint64(buckets))
            rows = [block("docs", home, task | k, ids, np.concatenate(sizes), np.concatenate(first), np.concatenate(second), sha)]
            key, text, place = np.concatenate(keys), np.concatenate(texts), np.concatenate(places)
            order, at = groups(place, text, key)  # a text that repeats in the batch is one
            order = order[at]
            key, text, place = key[order], text[order], place[order]
            several, lead = _shared(key, text)
            if several.any():  # known to recur; one record tells the anchor's bucket
                rows.append(block("hits", home, task | k, text[several], place[several]))
            rest = ~several | lead
            key, text, place, known = key[rest], text[rest], place[rest], several[rest]
            order, cuts = by_bucket(key, buckets)
            for i, x, z in cuts:
                different, at = np.unique(text[order[x:z]], return_inverse=True)
                own = key[order[x:z]] // np.uint64(buckets)  # 40 bits and the bucket stay: a chance match is dropped when words are compared
                rows.append(block("keys", i, task | k, (own & np.uint64(0xFFFFFFFF)).astype(np.uint32), (own >> np.uint64(32)).astype(np.uint8), different, at.astype(np.uint16 if len(different) <= 1 << 16 else np.uint32), place[order[x:z]], np.packbits(known[order[x:z]])))
            for i in range(0, len(rows), 64):
                yield block_rows(rows[i : i + 64])

    return run


def _shared(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records sorted by key and text: those whose key has several texts, and the first of each key."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(lead)
    last = np.append(start[1:], len(key)) - 1
    several = text[start] != text[last]
    return np.repeat(several, np.diff(np.append(start, len(key)))), lead


def _hits(batches):
    """Anchors of a partition that several texts have; other blocks pass."""
    parts = []
    for b in batches:
        through = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != "keys":
                through.append(row)
            else:
                low, high, different, at, place, known = pickle.loads(row[3])
                key = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)) * np.uint64(1 << 20) + np.uint64(row[1])
                parts.append((key, different[at], place, np.unpackbits(known, count=len(key)).astype(bool)))
        if through:
            yield block_rows(through)
    if parts:
        key, text, place, known = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((text, key))
        key, text, place, known = key[order], text[order], place[order], known[order]
        several, lead = _shared(key, text)
        start = np.flatnonzero(lead)
        told = np.logical_or.reduceat(known, start)
        hit = (several | np.repeat(told, np.diff(np.append(start, len(key))))) & ~known
        text, place = text[hit], place[hit]
        for i in range(0, len(text), 1 << 18):
            yield block_rows([block("hits", 0, -1, text[i : i + (1 << 18)], place[i : i + (1 << 18)])])


def _hit_rows(batches):
    for b in batches:
        for x in b.column("block").to_pylist():
            text, place = pickle.loads(x)
            order, at = groups(text)
            text, place = text[order], place[order].astype("<u4")
            ends = np.append(at[1:], len(text))
            yield pa.RecordBatch.from_arrays([pa.array(text[at].view(np.int64)), pa.array([place[s:e].tobytes() for s, e in zip(at, ends)], pa.binary())], ["t1", "places"])


def _doc_rows(batches):
    for b in batches:
        for x in b.column("block").to_pylist():
            ids, n, t1, t2, sha = pickle.loads(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array([s.hex() for s in sha])], ["doc_id", "n_words", "t1", "t2", "sha"])


def _same_text(batches):
    """Rows whose text is the one meant; another may have the same doc_id."""
    for b in batches:
        want, keep = b.column("t1").to_numpy(), []
        for lo, hi, w in words(b.column("text"), lower=False):
            keep.append(text_ids(w, hi - lo)[0].view(np.int64) == want[lo:hi])
        if keep:
            yield b.filter(pa.array(np.concatenate(keep)))


def _segments(batches):
    """Runs of windows around each recurring anchor, as text."""
    for b in batches:
        ids, t1, places = b.column("doc_id").to_numpy(), b.column("t1").to_numpy(), b.column("places").to_pylist()
        for lo, hi, w in words(b.column("text"), lower=False):
            hit = np.zeros(len(w.hash), bool)
            for i in range(hi - lo):
                hit[w.first[i] + np.frombuffer(b"".join(places[lo + i]), "<u4")] = True
            window, place, key = anchors(w)
            keep = hit[place]
            window, place, key = window[keep], place[keep], key[keep]
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(place)) - 1
            if not len(start):
                continue
            first, last = w.start[window[start]], w.end[window[end] + WINDOW - 1]
            text = [w.buf[a:z].tobytes().decode("utf-8", "surrogatepass") for a, z in zip(first.tolist(), last.tolist())]
            doc = w.doc[window[start]]
            yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(ids[lo + doc]), pa.array(t1[lo + doc]), pa.array((window[start] - w.first[doc]).astype(np.int64)), pa.array(text, pa.string())], ["anchor", "doc_id", "t1", "start", "text"])


def _owners(batches):
    """(w1, w2, anchor, least and greatest document) of the windows of segments, combined in a batch."""
    for b in batches:
        key, docs = b.column("anchor").to_numpy(), b.column("doc_id").to_numpy()
        for lo, hi, w in words(b.column("text"), lower=False):
            h1, at = grams(w, WINDOW)
            w.hash = mix(w.hash ^ _SALT)
            h2, _ = grams(w, WINDOW)
            row = w.doc[at] + lo
            a, d = key[row], docs[row]
            order, first = groups(a, h2, h1)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(h1[order][first].view(np.int64)), pa.array(h2[order][first].view(np.int64)), pa.array(a[order][first]), pa.array(np.minimum.reduceat(d[order], first)), pa.array(np.maximum.reduceat(d[order], first))], ["w1", "w2", "anchor", "low", "high"])


def _locate(batches):
    """Places of recurring phrases. A partition's rows come sorted by shard, the phrases of dealt anchors (kind 0) before
    the segments (kind 1); a shard is confirmed, compiled and streamed at a time."""
    import ahocorasick

    def shard(owner: dict, segs: list):
        number: dict[str, int] = {}
        of = [number.setdefault(x[4], len(number)) for x in segs]  # equal segments are read once
        texts, docs = list(number), np.array([x[1] for x in segs])
        low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
        np.minimum.at(low, of, docs)
        np.maximum.at(high, of, docs)
        dealt = np.zeros(len(texts), bool)
        dealt[of] = [x[0] for x in segs]
        h1s, h2s, rows, offs = [], [], [], []
        for lo, _, w in words(pa.array(texts, pa.string()), lower=False):
            h1, at = grams(w, WINDOW)
            w.hash = mix(w.hash ^ _SALT)
            h1s.append(h1)
            h2s.append(grams(w, WINDOW)[0])
            rows.append(w.doc[at] + lo)
            offs.append(at - w.first[w.doc[at]])
        h1, h2, row, off = (np.concatenate(x) for x in (h1s, h2s, rows, offs))
        order, first = groups(h2, h1)
        least, most = np.minimum.reduceat(low[row[order]], first), np.maximum.reduceat(high[row[order]], first)
        one = order[first]  # a place of each window
        ids: dict[bytes, int] = {}
        seqs = [[ids.setdefault(x, len(ids) + 1) for x in t.encode("utf-8", "surrogatepass").split()] for t in texts]
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, lo, hi in zip(one.tolist(), least.tolist(), most.tolist()):
            if dealt[row[i]]:
                lo, hi = owner.get((int(h1[i].view(np.int64)), int(h2[i].view(np.int64))), hi), hi + 1
            if lo < hi:
                machine.add_word(tuple(seqs[row[i]][off[i] : off[i] + WINDOW]), lo)
        out = []
        if len(machine):
            machine.make_automaton()
            found = [[(end - WINDOW + 1, end + 1, d) for end, d in machine.iter(tuple(seq))] for seq in seqs]
            for (_, doc, t1, start, _), t in zip(segs, of):
                a = z = None
                for s, e, first_doc in found[t]:
                    if first_doc < doc:
                        if z is not None and s <= z:
                            z = e
                            continue
                        if z is not None:
                            out.append((doc, t1, start + a, start + z))
                        a, z = s, e
                if z is not None:
                    out.append((doc, t1, start + a, start + z))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["doc_id", "t1", "begin", "end"])

    now, owner, segs = None, {}, []
    for b in batches:
        for at, kind, dealt, w1, w2, doc, t1, start, text in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "dealt", "w1", "w2", "doc_id", "t1", "start", "text"))):
            if at != now:
                if segs:
                    yield shard(owner, segs)
                now, owner, segs = at, {}, []
            if kind == 0:
                owner[(w1, w2)] = doc
            else:
                segs.append((dealt, doc, t1, start, text))
    if segs:
        yield shard(owner, segs)


def _removed(batches):
    for b in batches:
        n, sha = [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            w = (text or "").encode("utf-8", "surrogatepass").split()
            drop = np.zeros(len(w), bool)
            for s in spans:
                drop[s["begin"] : s["end"]] = True
            n.append(int(drop.sum()))
            sha.append(hashlib.sha256(b" ".join(x for x, d in zip(w, drop.tolist()) if not d)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "t1", "cut", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row a document.

    A null or empty text has no words. A document without a doc_id loses and causes nothing. Rows that repeat with
    their doc_id are not copies of each other, as neither has a smaller doc_id. A window that repeats only within its
    document stays. An empty table gives an empty one; other columns are ignored."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = written(docs.mapInArrow(_scatter(4 * n), BLOCK).repartition(n, "bucket").mapInArrow(_hits, BLOCK), "anchors")
    table = written(blocks.where("kind = 'docs'").select("block").mapInArrow(_doc_rows, "doc_id long, n_words long, t1 long, t2 long, sha string"), "texts")
    texts = written(table.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id")), "texts")
    hits = blocks.where("kind = 'hits'").select("block").mapInArrow(_hit_rows, "t1 long, places binary").groupBy("t1").agg(F.collect_list("places").alias("places"))  # at most a text's words
    chosen = texts.join(hits, "t1").select(F.col("first_id").alias("doc_id"), "t1", "places")
    chosen = docs.join(chosen, "doc_id").select("doc_id", "t1", "places", "text")
    chosen = bucketed(chosen.mapInArrow(_same_text, chosen.schema), "doc_id", n)  # joined again below, without a shuffle of texts
    segments = written(chosen.mapInArrow(_segments, "anchor long, doc_id long, t1 long, start long, text string"), "segments")
    # an anchor's segments meet in one shard; a hot anchor's are dealt to several, to which its phrases are sent
    many = segments.groupBy("anchor").count().where(F.col("count") > SEGMENTS).select("anchor", F.ceil(F.col("count") / SEGMENTS).cast("int").alias("parts"))
    many = written(many, "dealt")
    hot = segments.join(many.select("anchor"), "anchor", "left_semi")
    owners = hot.mapInArrow(_owners, "w1 long, w2 long, anchor long, low long, high long").groupBy("w1", "w2", "anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    shard = lambda part: F.pmod(F.xxhash64("anchor", part), F.lit(4 * n))
    zero = F.lit(0).cast("long")
    phrases = owners.join(many, "anchor").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(shard(F.col("part")).alias("shard"), F.lit(0).alias("kind"), F.lit(True).alias("dealt"), "w1", "w2", F.col("low").alias("doc_id"), zero.alias("t1"), zero.alias("start"), F.lit("").alias("text"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))
    streams = segments.join(many, "anchor", "left").select(shard(part).alias("shard"), F.lit(1).alias("kind"), F.col("parts").isNotNull().alias("dealt"), zero.alias("w1"), zero.alias("w2"), "doc_id", "t1", "start", "text")
    places = phrases.union(streams).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_locate, "doc_id long, t1 long, begin long, end long")
    spans = places.groupBy("doc_id").agg(F.collect_list(F.struct("t1", "begin", "end")).alias("spans"))  # at most a text's words
    own = F.filter("spans", lambda x: x["t1"] == F.col("t1"))
    changed = chosen.join(spans, "doc_id").select("doc_id", "t1", "text", own.alias("spans")).mapInArrow(_removed, "doc_id long, t1 long, cut long, kept string").dropDuplicates(["doc_id", "t1"])

    out = table.join(texts, ["t1", "t2"], "left").join(changed, ["doc_id", "t1"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    copy = F.coalesce(copy, F.lit(False))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))
