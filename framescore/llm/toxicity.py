"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its character n-grams (with marks at its ends) and of the word itself, so
that a misspelling or a new form of a word has most of its n-grams in common with it. Vectors live in a table of hashed
buckets. A window of a text is the mean of the vectors of its different words (a shorter text's window is filled up with
zeros); a linear layer and a softmax give its two classes, and a text is as toxic as its most toxic window. Table and
layer are trained together by gradient descent in NumPy, on a bounded sample of labelled texts, and calibrated on a part of
it; every text is scored whole, where it lies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import documents, mix, words

#: Buckets and length of vectors, lengths of n-grams, words of a window.
BUCKETS, DIM, GRAMS, WINDOW = 1 << 18, 16, (3, 4, 5), 64
#: Bounds of what is learned from: texts of each class, and windows of each, evenly spread over a longer text.
SAMPLE, WINDOWS = 3000, 64
#: Steps over the whole sample, of which the first take a text's mean instead of its most toxic window; momentum; the most that a step
#: moves a logit, and the layer by its own length; decay of vectors; texts with a bucket below which it moves no faster; every how
#: many texts one is kept back to calibrate.
STEPS, MEAN_STEPS, MOMENTUM, MOST, LAYER, DECAY, KEEN, KEPT, SEED = 100, 30, 0.8, 0.5, 0.01, 1e-3, 20, 5, 13
#: Words of the vocabulary whose n-grams are found at once.
SLICE = 1 << 13

#: Bytes of words: letters, digits and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the buckets of each word's n-grams and of the word itself, one word after the other; ``first`` has where each
    word's begin, and the end."""
    marked = [f"\x02{w}\x03" for w in vocabulary]
    size = np.array([len(w) for w in marked], np.int64)
    text = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), size)
    parts, owners = [], []
    h = np.zeros(len(text), np.uint64)
    for n in range(1, min(max(GRAMS), len(text)) + 1):  # h: of the n characters from each place on
        h = h[: len(text) - n + 1] * _STEP + (text[n - 1 :] + np.uint64(1)) * _ODD
        if n in GRAMS:
            same = np.flatnonzero(of[: len(text) - n + 1] == of[n - 1 :])
            parts.append(mix(h[same] + np.uint64(n)))
            owners.append(of[same])
    begin = np.concatenate([[0], np.cumsum(size)])
    power = np.ones(len(text) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(text), _STEP, np.uint64), out=power[1:])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    back = np.ones(len(text) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(text), inverse, np.uint64), out=back[1:])
    parts.append(mix(((total[begin[1:]] - total[begin[:-1]]) * back[begin[:-1]]) ^ _ODD) if len(marked) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(marked)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.searchsorted(owner[order], np.arange(len(marked) + 1))


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each run of values; 0 of an empty one."""
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


@dataclass
class Model:
    """``table`` (buckets x dim) and the layer: ``weights`` (dim x 2), ``bias`` (2); ``windows``: how many a text that was learned from has on
    average. ``constant``: the score of all texts where only one class, or none, was learned."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    empty: float
    windows: float = 1.0
    constant: float | None = None

    def margins(self) -> np.ndarray:
        """What each bucket's vector adds to the second class's logit over the first's."""
        return self.table @ (self.weights[:, 1] - self.weights[:, 0])


def _windows(doc: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, its text); the last window of a text is as long as the others where the text is."""
    count = np.bincount(doc, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    of_text = np.repeat(np.arange(n_texts), -(-count // WINDOW))
    k = np.arange(len(of_text)) - np.searchsorted(of_text, of_text)
    return begin[of_text] + np.minimum(k * WINDOW, np.maximum(count[of_text] - WINDOW, 0)), of_text


def _bags(code: np.ndarray, start: np.ndarray, size: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, window): the different words of each window; ``code`` has the number of each word of the texts."""
    place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    pairs = np.unique(np.repeat(np.arange(len(size)), size) * n_words + code[place])
    return pairs % n_words, pairs // n_words


def logits(model_margins: np.ndarray, bias: float, usual: float, col: pa.Array) -> np.ndarray:
    """The logit of each text's most toxic window; NaN for a text without a word. The largest of many windows is large by chance: by
    the bound for a union, the logarithm of how many times ``usual`` windows a text has is taken off."""
    out = np.full(len(col), np.nan)
    for lo, hi, w in words(pc.utf8_lower(col.fill_null("").cast(pa.large_string())), lower=False, isword=_WORD):
        if not len(w.hash):
            continue
        _, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
        buckets, first = subwords([w.word(i).decode("utf-8", "replace") for i in at])
        word = means(model_margins[buckets], first)
        start, of_text = _windows(w.doc, hi - lo)
        ids, of_window = _bags(code, start, np.minimum(WINDOW, np.bincount(w.doc, minlength=hi - lo)[of_text]), len(at))
        one = np.bincount(of_window, word[ids], len(start)) / WINDOW + bias
        best = np.full(hi - lo, -np.inf)
        np.maximum.at(best, of_text, one)
        best -= np.log(np.maximum(1, np.bincount(of_text, minlength=hi - lo) / usual))
        out[lo:hi] = np.where(np.isfinite(best), best, np.nan)
    return out


def train(texts: list[str], toxic: list[int], share: float) -> Model:
    """A model of texts and their labels (0 or 1), of which ``share`` are toxic among all that could be learned from."""
    y = np.asarray(toxic, float)
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weights = np.zeros((DIM, 2))
    weights[:, 1] = rng.uniform(-1, 1, DIM)
    if not len(y) or y.min() == y.max():
        return Model(table[:1], weights, np.zeros(2), share, constant=float(y[0]) if len(y) else 0.0)
    index: dict[str, int] = {}
    tokens = [np.array([index.setdefault(x, len(index)) for x in t.split("\n") if x], np.int32) for t in texts]
    length = np.array([len(t) for t in tokens])
    start, of_text = _windows(np.repeat(np.arange(len(tokens)), length), len(tokens))
    size = np.minimum(WINDOW, length[of_text])
    ids, of_window = (x.astype(np.int32) for x in _bags(np.concatenate(tokens), start, size, len(index)))
    del tokens
    # a slice of the vocabulary at a time, in four bytes a number: the driver's memory is small
    names, slices = list(index), []  # (buckets, where each word's begin)
    for k in range(0, len(names), SLICE):
        found, first = subwords(names[k : k + SLICE])
        slices.append((found.astype(np.int32), first))
    back = np.arange(len(y)) % KEPT == 0  # texts come in a hash's order
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back[:] = False
    has = np.bincount(of_text, minlength=len(y)) > 0
    learn = has & ~back
    # classes count alike
    weigh = np.where(y == 1, 0.5 / max(1, (learn & (y == 1)).sum()), 0.5 / max(1, (learn & (y == 0)).sum())) * learn
    windows = np.maximum(1, np.bincount(of_text, minlength=len(y)))

    def through(values: np.ndarray) -> np.ndarray:
        """Of each window the mean of ``values`` of its words' buckets."""
        word = np.concatenate([means(values[b], f) for b, f in slices] or [np.zeros(0)])
        return np.bincount(of_window, word[ids], len(size)) / WINDOW

    def pooled(z: np.ndarray, mean: bool) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text, and the part of it that each window is."""
        if mean:
            return np.bincount(of_text, z, len(y)) / windows, 1 / windows[of_text]
        best = np.lexsort((z, of_text))[np.searchsorted(of_text, np.flatnonzero(has), "right") - 1]
        part, out = np.zeros(len(z)), np.zeros(len(y))
        part[best], out[has] = 1, z[best]
        return out, part

    def errors(of: np.ndarray) -> np.ndarray:
        """The same way back: of each bucket the sum of the windows' errors."""
        word = np.bincount(ids, of[of_window] / WINDOW, len(index))
        out = np.zeros(BUCKETS)
        for k, (b, f) in enumerate(slices):
            n = np.diff(f)
            out += np.bincount(b, np.repeat(word[k * SLICE : k * SLICE + len(n)] / n, n), BUCKETS)
        return out

    # a bucket that most texts have moves in small steps, one that few have in no larger ones than KEEN texts would give it
    common = errors(np.repeat(1 / windows, windows * has) / len(y)) if len(size) else np.zeros(BUCKETS)
    once = 1 / (WINDOW * 20)
    pace = 1 / (common * (common + once) + KEEN * once * once)
    bias, speed = 0.0, np.zeros(BUCKETS)
    for step in range(STEPS):
        direction = weights[:, 1] - weights[:, 0]
        z, part = pooled(through(table @ direction), step < MEAN_STEPS)
        p = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        d = (p - y) * weigh
        c = errors(part * d[of_text])
        speed = MOMENTUM * speed - c * pace
        moved = np.abs(pooled(through(speed), step < MEAN_STEPS)[0]).max()
        toward = c @ table
        table += (speed * (MOST / max(moved, 1e-12)) / (direction @ direction))[:, None] * direction - DECAY * table
        weights += np.array([1, -1]) * (LAYER * np.linalg.norm(direction) * toward / max(np.linalg.norm(toward), 1e-12))[:, None]
        bias -= d.sum()
    z, _ = pooled(through(table @ (weights[:, 1] - weights[:, 0])), False)
    chosen = has & (back if back.any() else learn)
    slope, shift = calibrated(z[chosen], y[chosen], share)
    return Model(table.astype(np.float32), (weights * slope).astype(np.float32), np.array([0, shift]), share, float(max(1.0, windows[has].mean())))


def calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, shift) of a logistic curve through logits, where a share of all texts is of class 1; Newton steps on labels drawn in by one
    text a class, so that separate classes have a finite curve."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, share / n1, (1 - share) / n0)
    scale = max(float(np.std(z)), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    beta = np.array([1.0, np.log(share / (1 - share))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - t)) + 1e-6 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        beta -= move / max(1.0, float(np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return float(max(beta[0], 0.0) / scale), float(beta[1])


def _word_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, one a line: those of at most WINDOWS windows, evenly spread over a longer text."""
    for b in batches:
        out = []
        for lo, hi, w in words(pc.utf8_lower(b.column("text").fill_null("").cast(pa.large_string())), lower=False, isword=_WORD):
            start, of_text = _windows(w.doc, hi - lo)
            for i in range(hi - lo):
                mine = start[of_text == i]
                if len(mine) > WINDOWS:
                    mine = mine[np.linspace(0, len(mine) - 1, WINDOWS).astype(int)]
                at = np.unique((mine[:, None] + np.arange(WINDOW)).ravel()) if len(mine) else np.zeros(0, int)
                out.append("\n".join(w.word(j).decode("utf-8", "replace") for j in at[at < w.first[i + 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("toxic"), b.column("h")], ["words", "toxic", "h"])


def learnable(doc_id: Column) -> Column:
    """Whether labels of a document may be learned from; null ids have none."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the documents that have a label: at most ``sample`` texts of each class, chosen by a hash of id and text, with at
    most WINDOWS windows each. A document with several labels is toxic if one says so; labels other than 0 and 1 are
    ignored. The classes' shares are counted over all labels."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    texts, toxic = [], []
    for label in (0, 1):
        few = F.broadcast(given.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` narrow rows
        rows = docs.select("doc_id", "text").join(few, "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("h"))
        # an id may be that of many rows: the bound holds again
        for r in rows.orderBy("h").limit(sample).mapInArrow(_word_lines, "words string, toxic int, h long").orderBy("h").collect():
            texts.append(r.words)
            toxic.append(r.toxic)
    return train(texts, toxic, share)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``' doc_id with score (0 to 1) and predicted, a row a document.

    A null text, an empty one and one without a word score the share of toxic labels. Without labels all score 0, with labels
    of one class alone all score that class. Rows that repeat score alike; an empty table gives an empty one;
    other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float32), float(model.bias[1] - model.bias[0]), model.windows))  # a number a bucket
    empty, constant = model.empty, model.constant

    def run(batches):
        margins, bias, usual = shared.value
        for b in batches:
            if constant is not None:
                score = np.full(len(b), constant)
            else:
                z = logits(margins, bias, usual, b.column("text"))
                score = np.where(np.isnan(z), empty, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op13_subword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs, fit(docs, labels.where(learnable(F.col("doc_id")))))
    return out.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
