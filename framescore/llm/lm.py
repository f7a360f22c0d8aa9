"""Katz backoff bigram model, learned from the training documents and evaluated on every whole text.

Every word is a word of the model. The ``VOCAB`` most frequent ones (common words) have an id, and their probabilities
are broadcast; every other word goes by its 64-bit hash, and what is known of it is joined to its bigrams in the bucket
of that hash. How many words are common decides where a bigram is counted, not what it counts. UNK is a word that no
training document has. Counts up to five are discounted by Good-Turing; what a history then lacks to one goes to its
unseen continuations by its backoff weight, which is exact: (1 - sum of seen) / (1 - sum of the seen ones' unigram
probabilities).

Documents do not travel: a task sends, for each of many buckets, one block of (bigram, document, count); the bucket's
task counts, and sends back one block of sums for each batch of documents. A bigram is sent to the bucket of

- both ids, where both words are common. Bigrams of two of the ``HOT`` most frequent words, which would make a bucket
  large, are counted beforehand in a dense table of fixed size, so that no bucket has a code with more than the training
  count of the next word;
- the rare word's hash, where one is rare;
- the history's hash, where both are; the next word's count is asked for at that word's bucket beforehand.

A rare word is sent once, with the words on both sides of it. Blocks are sorted, so that keys travel as their differences, and
compressed: they, and not the texts, are what takes disk. What comes back are whole numbers, each of which few bits hold: counts
of bigrams and of rare words, each with its document. Sums a bucket, in fractions, would near one a bigram as buckets grow in number."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import BLOCK, block, block_rows, by_bucket, documents, groups, mix, partitions, words, written

VOCAB, HOT, CUT = (1 << 16) - 8, 512, 5
#: Bytes of text whose records are made at once (a batch), and of a bucket's share of all texts, where all are ``SIZE`` bytes; both grow with the
#: root of the texts' size, so that blocks, one a batch and bucket, grow with the size and not with its square. The most that they grow to.
SIZE, TEXT, SHARE, MOST_TEXT, MOST_SHARE = 1 << 30, 2 << 20, 9 << 20, 16 << 20, 64 << 20
UNK, END, FIRST = 0, 1, 2  # ids; words by falling count follow
COMMON = 1 << 16  # ids are below this


def discounts(n: np.ndarray, cut: int = CUT) -> np.ndarray:
    """Katz's d_0 .. d_cut from the numbers of types seen 1 .. cut + 1 times (n[0] of those seen once); where these
    give no discount between 0 and 1, (r - 0.5) / r."""
    r = np.arange(1, cut + 1)
    with np.errstate(all="ignore"):
        share = (cut + 1) * n[cut] / n[0]
        d = ((r + 1) * n[1 : cut + 1] / n[:cut] / r - share) / (1 - share)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        d = (r - 0.5) / r
    return np.concatenate([[1.0], d])


def unigrams(docs: DataFrame) -> DataFrame:
    """(h, c): 64-bit hash and count of each word of the training documents."""

    def run(batches):
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for _, _, w in words(b.column("text"), lower=True):
                x, n = np.unique(w.hash, return_counts=True)
                h, c = np.concatenate([h, x]), np.concatenate([c, n])
                if len(h) > 1 << 21:
                    order, at = groups(h)
                    h, c = h[order][at], np.add.reduceat(c[order], at)
                    if len(h) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])
                        h, c = h[:0], c[:0]
        if len(h):
            order, at = groups(h)
            yield pa.RecordBatch.from_arrays([pa.array(h[order][at].view(np.int64)), pa.array(np.add.reduceat(c[order], at))], ["h", "c"])

    rows = docs.where("not held_out").select("text").mapInArrow(run, "h long, c long")
    return written(rows.groupBy("h").agg(F.sum("c").alias("c")), "unigrams")


class Vocabulary:
    """Ids, unigram probabilities and history counts of the common words; at most VOCAB words, whatever the input."""

    def __init__(self, h: np.ndarray, c: np.ndarray, n_docs: int, levels: np.ndarray, n_types: np.ndarray):
        """``levels``: the different counts of all words, ``n_types``: how many words have each."""
        order = np.lexsort((h, -c))
        self.count = np.concatenate([[0, n_docs], c[order]]).astype(float)
        self.tokens, self.types = int((levels * n_types).sum()) + n_docs, int(n_types.sum()) + (n_docs > 0)
        by_hash = np.argsort(h[order], kind="stable")
        self.hash, self.id = h[order][by_hash], (by_hash + FIRST).astype(np.int64)
        by = dict(zip(levels.tolist(), n_types.tolist()))
        self.d = np.concatenate([discounts(np.array([by.get(k, 0) for k in range(1, CUT + 2)], float)), [1.0]])
        p = self._share(self.count)
        p[END] = max(p[END], 0.5 / (self.tokens + 1))  # also without training documents
        p[UNK] = 1 - p[END] - float((self._share(levels) * n_types).sum())
        self.p1 = p

    def _share(self, c: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(c, CUT + 1).astype(int)] * c / (self.tokens + 1)

    def prob(self, c: np.ndarray) -> np.ndarray:
        """Unigram probability of words of these counts; that of UNK for 0."""
        return np.where(c > 0, self._share(c), self.p1[UNK])

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hash, h).clip(0, len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.id[at], UNK)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def sequence(self, w) -> tuple[np.ndarray, ...]:
        """(history, token, document, the history's hash, the token's) of all words and ends of a chunk; the id of a
        word that is not common is UNK, the hash of an end 0."""
        n = np.diff(w.first)
        of = np.repeat(np.arange(len(n)), n + 1)
        now, h = np.full(len(of), END, np.int64), np.zeros(len(of), np.uint64)
        at = np.arange(len(w.hash)) + w.doc
        now[at], h[at] = self.ids(w.hash), w.hash
        return np.concatenate([[END], now[:-1]]), now, of, np.concatenate([np.zeros(1, np.uint64), h[:-1]]), h


def vocabulary(uni: DataFrame, n_docs: int, size: int = VOCAB) -> Vocabulary:
    per_count = uni.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # different counts: at most the root of twice the words
    least, got = (per_count[0].c + 1 if per_count else 1), 0
    for r in per_count:
        if got + r.n > size:
            break
        least, got = r.c, got + r.n
    rows = uni.where(F.col("c") >= least).toPandas()  # at most ``size`` rows
    levels, n = (np.array([r[k] for r in per_count], np.int64) for k in (0, 1))
    return Vocabulary(rows.h.to_numpy(np.int64).view(np.uint64), rows.c.to_numpy(np.int64), n_docs, levels, n)


def _hot(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return (before < HOT) & (now < HOT) & (before != UNK) & (now != UNK)


def _pair(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One 64-bit key of two."""
    return mix(h ^ mix(other + np.uint64(1)))


def _found(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The value of each key by sorted keys, 0 where it is none of them."""
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.searchsorted(keys, key).clip(0, len(keys) - 1)
    return np.where(keys[at] == key, values[at], 0).astype(np.int64)  # logarithms of one byte would have but 11 bits


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as they need; others as they are."""
    return x.astype(np.min_scalar_type(int(x.max()))) if x.dtype.kind in "iu" and len(x) else x


def _packed(kind: str, bucket: int, batch: int, *arrays: np.ndarray) -> tuple:
    """A block of arrays of numbers, compressed: all first bytes of an array, then all second ones, and so on."""
    form = [(x.dtype.str, len(x)) for x in arrays]
    data = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays)
    return kind, int(bucket), int(batch), pickle.dumps((form, len(data), pa.compress(data, "zstd", asbytes=True)), 5)


def _unpacked(data: bytes) -> list[np.ndarray]:
    form, size, packed = pickle.loads(data)
    flat, at, out = np.frombuffer(pa.decompress(packed, size, "zstd"), np.uint8), 0, []
    for kind, n in form:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending whole numbers by their differences, of which ``_sorted`` gives them back."""
    return _narrow(np.diff(x, prepend=x.dtype.type(0)))


def _sorted(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Different ones, how many of each) of sorted numbers."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _counts(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Sorted different keys, sums of n)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(n).astype(np.int64)
    order, at = groups(key)
    return key[order][at], np.add.reduceat(n[order], at) if len(at) else n


def _by(name: str, batches):
    """(value, rows (kind, bucket, batch, block)) of each value of a column by which the rows come sorted."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "batch", "block"))):
            value = row[1] if name == "bucket" else row[2]
            if value != now and rows:
                yield now, rows
                rows = []
            now = value
            rows.append(row)
    if rows:
        yield now, rows


def hot_counts(docs: DataFrame, shared) -> np.ndarray:
    """Training counts of bigrams of ids below HOT."""

    def run(batches):
        voc, out = shared.value, np.zeros(HOT * HOT, np.int64)
        for b in batches:
            for _, _, w in words(b.column("text"), lower=True):
                before, now, *_ = voc.sequence(w)
                hot = _hot(before, now)
                out += np.bincount(before[hot] * HOT + now[hot], minlength=HOT * HOT)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["k", "c"])

    rows = docs.where("not held_out").select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(HOT * HOT)
    out[rows.k.to_numpy(int)] = rows.c.to_numpy(float)
    return out


def _sums(of, size, before, p1, c):
    """Sums a document: log10 of seen counts less those of histories (``before``) or of the token's unigram
    probability, and tokens by small count."""
    value = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(before + 1), np.log10(p1))
    return np.bincount(of, value, minlength=size), [np.bincount(of[c == r], minlength=size) for r in range(1, CUT + 1)]


def blocked(size: int) -> tuple[int, int]:
    """(bytes of text in a batch, number of buckets) for so many bytes of texts."""
    root = (size / SIZE) ** 0.5
    share = min(max(SHARE * root, 1), MOST_SHARE)
    return int(min(max(TEXT, TEXT * root), MOST_TEXT)), max(1, math.ceil(size / share))


def _parts(batches, most: int):
    """Batches of about ``most`` bytes of text, across those that come; a longer text is in one of its own."""
    have, full = [], 0
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)  # rows without text count too
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            z = int(np.searchsorted(size, before + most - full, "right"))
            if z <= at and not have:
                z = at + 1
            if z > at:
                have.append(b.slice(at, z - at))
                full += int(size[z - 1] - before)
                at = z
            if at < b.num_rows:
                yield _joined(have)
                have, full = [], 0
    if have:
        yield _joined(have)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _ask(shared, most: int, buckets: int):
    """Blocks of the different bigrams of two rare words of a batch, to the next word's bucket."""

    def run(batches):
        voc = shared.value
        for b in _parts(batches, most):
            pairs = []
            for _, _, w in words(b.column("text"), lower=True):
                before, now, _, hb, hn = voc.sequence(w)
                m = (before == UNK) & (now == UNK)
                pairs.append((hb[m], hn[m]))
            if pairs:
                hb, hn = (np.concatenate(x) for x in zip(*pairs))
                order, at = groups(hb, hn)
                hn, hb = hn[order][at], hb[order][at]
                order, cuts = by_bucket(hn, buckets)
                rows = [_packed("ask", i, 0, _steps(hn[order[a:z]]), hb[order[a:z]]) for i, a, z in cuts]
                if rows:
                    yield block_rows(rows)

    return run


def _answer(buckets: int):
    """(bigram, count of its next word) to the history's bucket; rows come sorted by bucket."""

    def run(batches):
        for _, rows in _by("bucket", batches):
            yield from answer(rows)

    def answer(rows):
        uni = [_unpacked(r[3]) for r in rows if r[0] == "uni"]
        asked = [_unpacked(r[3]) for r in rows if r[0] == "ask"]
        if uni and asked:
            h, c = np.concatenate([_sorted(x[0]) for x in uni]), np.concatenate([x[1] for x in uni])
            by = np.argsort(h)
            hn, hb = np.concatenate([_sorted(x[0]) for x in asked]), np.concatenate([x[1] for x in asked])
            order, at = groups(hb, hn)
            hn, hb = hn[order][at], hb[order][at]
            n = _found(h[by], c[by], hn)
            known = n > 0
            hb, pair, n = hb[known], _pair(hb[known], hn[known]), n[known]
            to = (hb % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pair, to))
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [_packed("next", i, 0, _steps(pair[order[a:z]]), _narrow(n[order[a:z]])) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
            for i in range(0, len(rows), 64):
                yield block_rows(rows[i : i + 64])

    return run


def _scatter(shared, hot_shared, most: int, buckets: int):
    """Blocks of a batch: its documents with all that needs no counting, its other bigrams by bucket."""

    def run(batches):
        voc, hot_c = shared.value, hot_shared.value
        known, log_count = voc.base(voc.count), np.log10(voc.count + 1)
        task = TaskContext.get().partitionId() << 24
        for k, b in enumerate(_parts(batches, most)):
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            size = len(train)
            home = {"n_tokens": np.zeros(size, np.int64), "n_known": np.zeros(size, np.int64), "base": np.zeros(size), "value": np.zeros(size), "small": [np.zeros(size, np.uint32) for _ in range(CUT)]}
            un, grams, rare = [], [], []
            for lo, hi, w in words(b.column("text"), lower=True):
                before, now, of, hb, hn = voc.sequence(w)
                m, here = hi - lo, slice(lo, hi)
                common = now != UNK
                home["n_tokens"][here] = np.bincount(of, minlength=m)
                home["n_known"][here] = np.bincount(of[common & (voc.count[now] > 0)], minlength=m)
                home["base"][here] = np.bincount(of[common], known[now[common]], minlength=m)
                hot = _hot(before, now)
                c = hot_c[before[hot] * HOT + now[hot]]
                value, small = _sums(of[hot], m, voc.count[before[hot]], voc.p1[now[hot]], c)
                unseen = np.flatnonzero(hot)[c == 0]
                open_ = ~hot & (before != UNK)  # counts come back from the buckets
                home["value"][here] = value - np.bincount(of[open_], log_count[before[open_]], minlength=m)
                for r in range(CUT):
                    home["small"][r][here] = small[r]
                un.append(((of[unseen] + lo).astype(np.uint32), before[unseen].astype(np.uint32), np.ones(len(unseen), np.uint32)))
                cold = open_ & common
                u, n = np.unique((of[cold] + lo) << 32 | before[cold] << 16 | now[cold], return_counts=True)
                grams.append((u, n))
                at = np.flatnonzero(~common)  # an end follows every word
                rare.append((hn[at], (of[at] + lo) << 32 | before[at] << 16 | now[at + 1], hn[at + 1]))
            rows = [block("home", int(mix(np.array([task | k], np.uint64))[0] % np.uint64(buckets)), task | k, b.column("doc_id").to_pylist(), ~train, home)]
            un = [np.concatenate(x) for x in zip(*un)] if un else []
            if un and len(un[0]):
                rows.append(_packed("unseen", rows[0][1], task | k, *(_narrow(x) for x in un)))
            if grams:
                u, n = (np.concatenate(x) for x in zip(*grams))
                code, d = u & 0xFFFFFFFF, u >> 32
                to = (mix(code.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to << 32 | code, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                code, flagged, n = code[order], _narrow((d << 1 | train[d])[order]), _narrow(n[order])
                rows += [_packed("gram", i, task | k, _steps(code[a:z]), flagged[a:z], n[a:z]) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                h, around, follows = (np.concatenate(x) for x in zip(*rare))
                to = (h % np.uint64(buckets)).astype(np.int64)
                order, at = groups(follows, around, h, to)
                h, around, follows, to, n = h[order][at], around[order][at], follows[order][at], to[order][at], _narrow(np.diff(np.append(at, len(order))))
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                d, then = around >> 32, (around & 0xFFFF).astype(np.uint16)
                flagged, prior = _narrow(d << 1 | train[d]), (around >> 16 & 0xFFFF).astype(np.uint16)
                for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if z > a:
                        w, times = _runs(h[a:z])
                        rows.append(_packed("rare", i, task | k, _steps(w), _narrow(times), flagged[a:z], prior[a:z], then[a:z], n[a:z], follows[a:z][then[a:z] == UNK]))
            for i in range(0, len(rows), 64):
                yield block_rows(rows[i : i + 64])

    return run


def _unigram_blocks(buckets: int):
    def run(batches):
        for b in batches:
            h, c = b.column("h").to_numpy().view(np.uint64), b.column("c").to_numpy()
            order, cuts = by_bucket(h, buckets)
            rows = [_packed("uni", i, 0, _steps(h[order[a:z]]), _narrow(c[order[a:z]])) for i, a, z in cuts]
            if rows:
                yield block_rows(rows)

    return run


def _types(of: np.ndarray, c: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of a history's bigrams seen 1 .. CUT + 1 times, and the sum of counts above CUT."""
    return [np.bincount(of[c == r], minlength=size) for r in range(1, CUT + 2)], np.bincount(of, np.where(c > CUT, c, 0), minlength=size).astype(np.int64)


def _trained(bigrams) -> tuple[np.ndarray, np.ndarray]:
    """(Sorted keys, counts) of the training bigrams of (key, flagged document, times, ...)."""
    parts = [(x[0][t], x[2][t]) for x in bigrams for t in [x[1] & 1 == 1]]
    return _counts([x[0] for x in parts], [x[1] for x in parts])


def _around(listed: np.ndarray, blocks: list) -> tuple[tuple[np.ndarray, ...], ...]:
    """Bigrams (key, flagged document, times, rare word's place in ``listed``, other word) of a batch's rare words: with a common
    word before, with a common word after, and with a rare one after. A key is the place and the other's id, or of both hashes."""
    w = np.concatenate([np.repeat(np.searchsorted(listed, _sorted(x[0])), x[1]) for x in blocks]).astype(np.uint32)
    flagged, prior, then, n, follows = (np.concatenate([x[i] for x in blocks]) for i in range(2, 7))

    def common(at, other):
        return w[at].astype(np.uint64) << np.uint64(16) | other[at], flagged[at], n[at], w[at], other[at]

    rare = then == UNK
    return common(prior != UNK, prior), common(~rare, then), (_pair(listed[w[rare]], follows), flagged[rare], n[rare], w[rare], follows)


def _numbered(parts: list) -> list[np.ndarray]:
    """Different (flagged document, number) with their times, sorted: steps of documents, numbers, times."""
    d, x, n = (np.concatenate(y) for y in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(3))
    key, n = _counts([(d >> 1).astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)], [n])
    return [_steps(key >> np.uint64(32)), _narrow(key & np.uint64(0xFFFFFFFF)), _narrow(n)]


def _listed(parts: list) -> list[np.ndarray]:
    """(Flagged document, numbers, ...): documents, numbers, ..."""
    d, *more = (np.concatenate(y) for y in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(4))
    return [_narrow(x) for x in (d >> 1, *more)]


def _table(kind: str, h: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple:
    """A table of counts by word (sorted hashes) and the other word."""
    one, times = _runs(h)
    return _packed(kind, 0, -1, _steps(one), _narrow(times), _narrow(other), _narrow(n))


def _count(shared):
    """Of each bucket, held one at a time: counts of its bigrams (kept as the model's table) and, back to each batch, those of its bigrams by document. The token
    after an unseen bigram's history is given by its id or, if rare, by COMMON and its count.
    Rows come sorted by bucket."""

    def run(batches):
        for _, rows in _by("bucket", batches):
            yield from count(rows)

    def count(rows):
        voc = shared.value
        got = {k: defaultdict(list) for k in ("gram", "rare", "uni", "next")}
        through = [r for r in rows if r[0] in ("home", "unseen")]
        for i in range(0, len(through), 64):
            yield block_rows(through[i : i + 64])
        for kind, _, batch, data in rows:
            if kind in got:
                got[kind][batch].append(_unpacked(data))

        none = np.zeros(0, np.uint64)
        uni, following = (_counts([_sorted(x[0]) for x in got[k][0]], [x[1] for x in got[k][0]]) for k in ("uni", "next"))
        grams = {batch: (np.concatenate([_sorted(x[0]).astype(np.uint32) for x in blocks]), *(np.concatenate([x[i] for x in blocks]) for i in (1, 2))) for batch, blocks in got.pop("gram").items()}
        listed = np.unique(np.concatenate([none, *(_sorted(x[0]) for blocks in got["rare"].values() for x in blocks)]))
        rare = {batch: _around(listed, blocks) for batch, blocks in got.pop("rare").items()}
        into, out_of, pairs = ([x[i] for x in rare.values()] for i in range(3))
        seen = _found(*uni, listed)
        p_listed = voc.prob(seen)

        # counts of bigrams; those of two rare words are by one hash, whose words come from where it first is
        code, count = _trained(grams.values())
        before, now = (code >> np.uint32(16)).astype(np.int64), (code & np.uint32(0xFFFF)).astype(np.int64)
        (k_into, n_into), (k_from, n_from), (k_pair, n_pair) = (_trained(x) for x in (into, out_of, pairs))
        (w_into, o_into), (w_from, o_from) = (((k >> np.uint64(16)).astype(np.int64), (k & np.uint64(0xFFFF)).astype(np.int64)) for k in (k_into, k_from))
        key, at = np.unique(np.concatenate([none, *(x[0] for x in pairs)]), return_index=True)
        at = at[np.searchsorted(key, k_pair)]
        w_pair, o_pair = (np.concatenate([none, *(x[i] for x in pairs)])[at] for i in (3, 4))

        # common histories
        if len(code) or len(k_into):
            ids, of = np.unique(np.concatenate([before, o_into]), return_inverse=True)
            types, large = _types(of, np.concatenate([count, n_into]), len(ids))
            p1 = np.bincount(of, np.concatenate([voc.p1[now], p_listed[w_into]]), minlength=len(ids))
            yield block_rows([_packed("history", 0, -1, _steps(ids), *(_narrow(t) for t in types), _narrow(large), p1)])
            yield block_rows([_packed("count", 0, -1, _steps(code), _narrow(count)), _table("count_into", listed[w_into], o_into, n_into)])

        # a rare history: its weight needs only the discounts, which are known when all buckets are counted
        of = np.concatenate([w_from, w_pair.astype(np.int64)])
        types, large = _types(of, np.concatenate([n_from, n_pair]), len(listed))
        p1 = np.bincount(of, np.concatenate([voc.p1[o_from], voc.prob(_found(*following, k_pair))]), minlength=len(listed))
        if len(of):
            order = np.argsort(w_pair, kind="stable")
            yield block_rows([_table("count_from", listed[w_from], o_from, n_from), _table("count_pair", listed[w_pair[order]], o_pair[order], n_pair[order])])
            yield block_rows([_packed("history", 0, -1, np.array([UNK]), *(np.array([t.sum()]) for t in types), np.zeros(1, np.int64), np.zeros(1))])

        for batch in dict.fromkeys([*grams, *rare]):
            found, rares, unseen, opened, at = [], [], [], [], np.zeros(0, np.int64)
            if batch in grams:
                g, d, n = grams[batch]
                c = _found(code, count, g)
                found.append((d, c, n))
                g, d, n = g[c == 0], d[c == 0], n[c == 0]
                unseen.append((d, g >> np.uint32(16), g & np.uint32(0xFFFF), n))
            if batch in rare:
                (key, d, n, w, b), after, pair = rare[batch]
                c = _found(k_into, n_into, key)
                un = c == 0
                found.append((d, c, n))
                unseen.append((d[un], b[un], COMMON + seen[w[un]], n[un]))
                for (key, d, n, w, token), table in ((after, (k_from, n_from)), ((*pair[:4], COMMON + _found(*following, pair[0])), (k_pair, n_pair))):
                    c = _found(*table, key)
                    un = c == 0
                    found.append((d, c, n))
                    rares.append((d, seen[w], n))  # a rare word is the history of one token each time it occurs
                    opened.append((d[un], w[un], token[un], n[un]))
                d, w, token, n = (np.concatenate(x) for x in zip(*opened))
                at, which = np.unique(w, return_inverse=True)  # one that training does not have leaves all to the unigrams: its weight is 1
                opened = [(d, which, token, n)]
            found = [(d[c > 0], c[c > 0], n[c > 0]) for d, c, n in found]
            yield block_rows([_packed("counted", 0, batch, *_numbered(found), *_numbered(rares), *_listed(unseen), *_listed(opened), *(_narrow(t[at]) for t in types[:CUT]), _narrow(large[at]), _narrow(seen[at]), p1[at])])

    return run


def weights(types, large, count, p1, d: np.ndarray) -> np.ndarray:
    """Backoff weights of histories by their sums."""
    seen = (np.array(types[:CUT]) * (d[1:] * np.arange(1, CUT + 1))[:, None]).sum(0) + large
    return np.maximum(1 - seen / (count + 1), 0) / np.maximum(1 - p1, 1e-12)


def _gather(shared, model):
    def run(batches):
        voc, (d, alpha) = shared.value, model.value
        with np.errstate(divide="ignore"):
            log_d, log_alpha, log_count = np.append(np.log10(d), 0), np.log10(np.maximum(alpha, 1e-300)), np.log10(voc.count + 1)

        def log_p1(token):
            token = token.astype(np.int64)
            return np.log10(np.where(token < COMMON, voc.p1[np.where(token < COMMON, token, UNK)], voc.prob(np.maximum(token - COMMON, 0))))

        for _, rows in _by("batch", batches):
            ids, held, h = next(pickle.loads(data) for kind, _, _, data in rows if kind == "home")
            score, base, known = h["value"].copy(), h["base"].copy(), h["n_known"].copy()
            for r in range(CUT):
                score += h["small"][r] * log_d[r + 1]

            def total(at, x, size=len(score)):
                return np.bincount(at.astype(np.int64), x, minlength=size)

            for kind, _, _, data in sorted(rows, key=lambda r: (r[0], r[3])):  # the same order whatever came first
                if kind == "unseen":
                    at, before, n = _unpacked(data)
                    score += total(at, log_alpha[before] * n)
                elif kind == "counted":
                    x = _unpacked(data)
                    at, c, n = _sorted(x[0]), x[1].astype(np.int64), x[2]  # in a byte, logarithms would have but 11 bits, and 255 + 1 is 0
                    score += total(at, (np.log10(c) + log_d[np.minimum(c, CUT + 1)]) * n)
                    at, c, n = _sorted(x[3]), x[4].astype(np.int64), x[5]
                    score -= total(at, np.log10(c + 1) * n)
                    base += total(at, voc.base(c) * n)
                    known += total(at, (c > 0) * n).astype(np.int64)
                    at, before, token, n = x[6:10]
                    score += total(at, (log_p1(token) + log_count[before] + log_alpha[before]) * n)
                    at, which, token, n = x[10:14]
                    *types, large, count, p1 = (y.astype(float) for y in x[14:])
                    lack = np.log10(np.maximum(weights(types, large, count, p1, d), 1e-300)) + np.log10(count + 1)
                    score += total(at, (log_p1(token) + lack[which]) * n)
            n = len(score)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(h["n_tokens"]), pa.array(known), pa.array(np.full(n, voc.tokens, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz(blocks: DataFrame, voc: Vocabulary, hot_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d_0 .. d_cut, backoff weight of each history) from the histories' sums, combined in tasks."""
    size = len(voc.count)

    def combine(batches):
        types, large, p1 = np.zeros((CUT + 1, size), np.int64), np.zeros(size), np.zeros(size)
        for b in batches:
            for block in b.column("block").to_pylist():
                ids, *t, x, p = _unpacked(block)
                ids = _sorted(ids).astype(np.int64)
                types[:, ids] += np.array(t, np.int64)
                large[ids] += x
                p1[ids] += p
        at = np.flatnonzero(types.sum(0) + large)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in types), pa.array(large[at]), pa.array(p1[at])], ["id", *(f"t{r}" for r in range(CUT + 1)), "large", "p1"])

    fields = ", ".join(f"t{r} long" for r in range(CUT + 1))
    rows = blocks.where("kind = 'history'").select("block").mapInArrow(combine, f"id long, {fields}, large double, p1 double").groupBy("id").agg(*(F.sum(f"t{r}").alias(f"t{r}") for r in range(CUT + 1)), F.sum("large").alias("large"), F.sum("p1").alias("p1")).toPandas()  # a row a history
    types, large, p1 = np.zeros((CUT + 1, size)), np.zeros(size), np.zeros(size)
    at = rows.id.to_numpy(int)
    for r in range(CUT + 1):
        types[r, at] = rows[f"t{r}"]
    large[at], p1[at] = rows.large, rows.p1
    k = np.flatnonzero(hot_c)
    before, now, c = k // HOT, k % HOT, hot_c[k]
    for r in range(1, CUT + 2):
        types[r - 1] += np.bincount(before[c == r], minlength=size)
    large += np.bincount(before[c > CUT], c[c > CUT], minlength=size)
    p1 += np.bincount(before, voc.p1[now], minlength=size)
    d = discounts(types.sum(1))
    return d, weights(types, large, voc.count, p1, d)


def scored(docs: DataFrame, common: int = VOCAB) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text, held_out).

    A null or empty text is an end alone, equal rows are scored alike (and count as often in training), an empty
    table gives an empty one, a model without training documents knows nothing and scores by UNK; other columns
    are ignored. ``common`` (at most VOCAB) is how many words are broadcast and does not change the result. The blocks
    that the counting step writes hold the model's partitioned bigram tables (kinds "count", "count_into", "count_from" and "count_pair")."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    uni = unigrams(docs)
    trained, size = docs.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    voc = vocabulary(uni, trained, min(common, VOCAB))
    shared = spark.sparkContext.broadcast(voc)  # at most VOCAB words
    hot_c = hot_counts(docs, shared)
    hot_shared = spark.sparkContext.broadcast(hot_c)  # HOT x HOT
    n = partitions(spark)
    most, buckets = blocked(size)
    counts = uni.mapInArrow(_unigram_blocks(buckets), BLOCK)
    following = docs.select("text").mapInArrow(_ask(shared, most, buckets), BLOCK).union(counts).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(buckets), BLOCK)
    sent = docs.mapInArrow(_scatter(shared, hot_shared, most, buckets), BLOCK).union(counts).union(following)
    blocks = written(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(shared), BLOCK), "counts")
    model = spark.sparkContext.broadcast(katz(blocks, voc, hot_c))  # a number a word of the vocabulary
    back = blocks.where("batch >= 0").repartition(n, "batch").sortWithinPartitions("batch")
    return written(back.mapInArrow(_gather(shared, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))
    return scored(docs)
