"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is its letters, lower-cased, with one boundary for each run of anything else; every letter of 16 bits is a symbol
of its own. A model is, for each order, sorted arrays of n-gram hashes (64 bits: the characters themselves) with their
discounted probability and of contexts with their backoff weight. The language with the lowest cross-entropy a character
wins. Held-back documents, cut into pieces, tell how high it may be: a text is rejected above the ``QUANTILE`` of pieces
at most a quarter as long, which vary more. Models are fitted on a bounded sample of labelled documents (about
``MAX_PIECES`` pieces of at most ``MAX_CHARS`` characters a language); every whole text is scored."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import carried, documents, mix, put_back, released, written

ORDER, BITS = 4, 16
MAX_PIECES, MAX_CHARS = 600, 20_000
#: Lengths of the pieces from which limits are learned, and which share of them a limit lets through.
LENGTHS, QUANTILE = (8, 32, 128, 512), 0.999
#: Characters worked on at once, and codes whose values a task keeps.
CHARS, SLOTS = 1 << 20, 20


@cache
def symbols() -> np.ndarray:
    """The 16-bit symbol of every code point: a letter's own number, 0 for anything else. Letters beyond 16 bits share the
    numbers of surrogates and private characters, which are no letters."""
    point = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.where(point < 1 << 16, point, 0xD800 + point % 8448), 0).astype(np.uint16)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each character with the ORDER - 1 before it, the text it is in); texts begin after boundaries."""
    gap = "\n" * (ORDER - 1)
    texts = [t.lower() for t in texts]
    joined = gap + gap.join(texts) + "\n"
    sym = symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), size + ORDER - 1)
    of = np.append(of, max(0, len(texts) - 1))
    first = np.concatenate([[0], np.cumsum(size + ORDER - 1)])[:-1]
    lead = np.zeros(len(sym), bool)
    for j in range(ORDER - 1):
        lead[first + j] = True
    keep = (sym > 0) | lead
    keep[1:] |= (sym[:-1] > 0) & ~lead[1:]
    keep[-1] = False  # one after the last text
    sym, of, lead = sym[keep].astype(np.uint64), of[keep], lead[keep]
    code = sym.copy()
    for j in range(1, ORDER):
        code[j:] |= sym[:-j] << np.uint64(BITS * j)
    return code[~lead], of[~lead]


def _low(k: int) -> np.uint64:
    """Mask of the last k characters of a code."""
    return np.uint64((1 << (BITS * k)) - 1)


def kneser_ney(code: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays gram{k}, prob{k}, context{k}, backoff{k} for orders 1 to ORDER."""
    out = {}
    grams, counts = np.unique(code, return_counts=True)
    for k in range(ORDER, 0, -1):
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        context, at, types = np.unique(grams >> np.uint64(BITS), return_inverse=True, return_counts=True)
        total = np.bincount(at, counts).astype(float)
        out |= {f"gram{k}": grams, f"prob{k}": (counts - d).clip(0) / total[at], f"context{k}": context, f"backoff{k}": (types * d) / total}
        # a lower order counts the different characters that come before
        grams, counts = np.unique(grams & _low(k - 1), return_counts=True)
    return out


def log_prob(model: dict[str, np.ndarray], code: np.ndarray, letters: int) -> np.ndarray:
    """log2 of the probability of each code's last character after the others; ``letters``: symbols that share what no
    order has seen."""
    p = np.full(len(code), 1 / letters)
    for k in range(1, ORDER + 1):
        own = code & _low(k)

        def found(keys, values, at, other):
            i = np.searchsorted(keys, at).clip(0, len(keys) - 1)
            return np.where(keys[i] == at, values[i], other)

        p = found(model[f"gram{k}"], model[f"prob{k}"], own, 0.0) + found(model[f"context{k}"], model[f"backoff{k}"], own >> np.uint64(BITS), 1.0) * p
    return np.log2(p)


class Scorer:
    """Cross-entropies of texts under every language. Values of codes met before are kept in slots by hash; a code not in its
    slot is looked up in the sorted arrays once a call."""

    def __init__(self, models: dict[str, dict], letters: int):
        self.langs = sorted(models)
        self.models, self.letters = [models[x] for x in self.langs], letters
        self.clear()

    def clear(self) -> None:
        self.code, self.row = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
        self.known, self.used = np.zeros((1 << 16, len(self.langs)), np.float32), 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character, a column a language; characters)."""
        code, of = codes(texts)
        if self.used > 1 << SLOTS:
            self.clear()
        slot = (mix(code) >> np.uint64(64 - SLOTS)).astype(np.int64)
        at = np.where(self.code[slot] == code, self.row[slot], -1)
        if (at < 0).any():
            new, first, inverse = np.unique(code[at < 0], return_index=True, return_inverse=True)
            while self.used + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            rows = np.arange(self.used, self.used + len(new))
            for k, m in enumerate(self.models):
                self.known[rows, k] = log_prob(m, new, self.letters)
            where = slot[at < 0][first]
            self.code[where], self.row[where] = new, rows
            self.used += len(new)
            at[at < 0] = rows[inverse]
        n = np.bincount(of, minlength=len(texts))
        bits = np.stack([np.bincount(of, self.known[at, k], minlength=len(texts)) for k in range(len(self.langs))], 1) if len(code) else np.zeros((len(texts), len(self.langs)))
        return -bits / np.maximum(n, 1)[:, None], n


def sample(docs: DataFrame, learn, pieces: int = MAX_PIECES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(lang, text, mark): about ``pieces`` of each language's labelled texts, all of them where there are no more, chosen by hash. A text of
    more than ``max_chars`` characters is several pieces, so that none is left out for its length."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / max_chars).cast("int"))))
    cut = cut.select("lang", F.xxhash64("doc_id", F.lit(7), F.col("i")).alias("mark"), F.substring("text", F.col("i") * max_chars + 1, F.lit(max_chars)).alias("text"))
    share = rows.select("lang", F.ceil(F.length("text") / max_chars).alias("n")).groupBy("lang").agg((pieces / F.sum("n")).alias("share"))  # a row a language
    chosen = cut.join(F.broadcast(share), "lang").where(F.pmod("mark", F.lit(1 << 31)) < F.col("share") * (1 << 31))
    return written(chosen.drop("share").dropDuplicates(["lang", "mark"]), "sample")


def limits(model: dict[str, np.ndarray], texts: list[str], letters: int) -> list[float]:
    """For each of LENGTHS the cross-entropy that QUANTILE of the texts' pieces of so many characters don't exceed."""
    code, of = codes(texts)
    bits = -log_prob(model, code, letters)
    out = []
    for size in LENGTHS:
        place = np.arange(len(code)) - np.searchsorted(of, of)  # in the text
        piece = np.unique(of * (1 << 32) + place // size, return_inverse=True)[1]
        n = np.bincount(piece)
        mean = np.bincount(piece, bits) / np.maximum(n, 1)
        whole = mean[n == size] if (n == size).any() else mean
        out.append(float(np.quantile(whole, QUANTILE, method="higher")) if len(whole) else float("inf"))
    return out


def fit(docs: DataFrame, learn) -> tuple[dict, int, dict]:
    """(models by language, number of symbols, limits by language) from the rows of ``docs`` where ``learn`` holds."""
    rows = sample(docs, learn)
    letters = 1 + rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).where(F.col("c").rlike("^\\p{L}$")).distinct().count()

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["mark", "text"]).text.tolist()
        held = texts[::5] if len(texts) > 5 else texts
        model = kneser_ney(codes([t for i, t in enumerate(texts) if i % 5] if len(texts) > 5 else texts)[0])
        out = {"lang": pdf.lang.iloc[0], **{k: [v.view(np.int64) if v.dtype == np.uint64 else v] for k, v in model.items()}}
        return pd.DataFrame(out | {"limits": [limits(model, held, letters)]})

    fields = ", ".join(f"gram{k} array<long>, prob{k} array<double>, context{k} array<long>, backoff{k} array<double>" for k in range(1, ORDER + 1))
    fitted = rows.groupBy("lang").applyInPandas(train, f"lang string, {fields}, limits array<double>").toPandas()
    array = lambda k, v: np.asarray(v).view(np.uint64) if k[0] in "gc" else np.asarray(v)
    models = {r["lang"]: {k: array(k, r[k]) for k in fitted.columns if k not in ("lang", "limits")} for _, r in fitted.iterrows()}
    return models, letters, {r["lang"]: list(r["limits"]) for _, r in fitted.iterrows()}


def identified(docs: DataFrame, learn) -> DataFrame:
    """``docs`` (doc_id, text, lang and any others) with lang_pred, score, cross_entropy and rejected.

    A null text and one without a letter are ``und`` with score 0 and rejected. Equal rows get equal answers, equal
    cross-entropies go to the first language by name. With nothing to learn from every text is ``und``. Columns
    named as added ones are replaced."""
    spark = docs.sparkSession
    models, letters, limit = fit(docs, learn)
    added = "lang_pred string, score double, cross_entropy double, rejected boolean"
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "cross_entropy", "rejected")]
    shared = spark.sparkContext.broadcast((models, letters, limit))  # bounded by the sample

    def run(batches):
        models, letters, limit = shared.value
        scorer = Scorer(models, letters)
        most = np.array([limit[x] for x in scorer.langs]).reshape(-1, len(LENGTHS))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            parts, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > CHARS:
                    parts.append(part)
                    part, size = [], 0
            parts.append(part)
            lang, score, ce, rejected = [], [], [], []
            for part in parts:
                if not part:
                    continue
                letter = np.array([any(map(str.isalpha, t)) for t in part])
                if not scorer.langs:
                    letter[:] = False
                h, n = scorer(part) if scorer.langs else (np.zeros((len(part), 1)), np.zeros(len(part)))
                best = h.argmin(1)
                low = h[np.arange(len(part)), best]
                p = 1 / np.exp2((low[:, None] - h) * np.minimum(n, 64)[:, None]).sum(1)
                if scorer.langs:
                    band = np.searchsorted(4 * np.array(LENGTHS), n, "right") - 1  # a text of under 32 characters is never rejected
                    bad = (band >= 0) & (low > most[best, band.clip(0)])
                for i, ok in enumerate(letter):
                    lang.append(scorer.langs[best[i]] if ok else "und")
                    score.append(float(p[i]) if ok else 0.0)
                    ce.append(float(low[i]) if ok else None)
                    rejected.append(bool(bad[i]) if ok else True)
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "cross_entropy", "rejected"])

    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in names] + list(StructType.fromDDL(added)))
    return docs.select(*names).mapInArrow(released(run), schema)


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, unchanged, whatever their other columns are named; learned from those of their
    labels that ``learnable`` allows. A null text and one without a letter go."""
    rows = carried(docs, "doc_id", "lang")
    return put_back(identified(rows, learnable(rows)).where("not rejected"), docs.columns)


def learnable(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identified(docs, learnable(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
