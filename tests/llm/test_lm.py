"""The Katz model against a dictionary version of it, with normalisation checked."""

import glob
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from framescore.llm import lm
from framescore.llm.common import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t, _ in rows]
    train = [t for t, r in zip(toks, rows) if not r[2]]
    uni = Counter(w for t in train for w in t)
    n_docs, n_words = len(train), sum(uni.values())
    N, V = n_words + n_docs, len(uni) + (n_docs > 0)
    per = sorted(Counter(uni.values()).items(), reverse=True)
    least, got = (per[0][0] + 1 if per else 1), 0
    for c, k in per:
        if got + k > size:
            break
        least, got = c, got + k
    voc = {w for w, c in uni.items() if c >= least}
    cls = lambda w: w if w in voc or w == "</s>" else "<unk>"
    count = Counter(cls(w) for t in train for w in t)
    count["</s>"] = n_docs
    bi = Counter()
    for t in train:
        seq = ["</s>", *map(cls, t), "</s>"]
        bi.update(zip(seq, seq[1:]))

    def disc(values):
        n = [sum(v == r for v in values) for r in range(1, 7)]
        d = [1.0]
        try:
            share = 6 * n[5] / n[0]
            d += [((r + 1) * n[r] / n[r - 1] / r - share) / (1 - share) for r in range(1, 6)]
            assert all(0 < x < 1 for x in d[1:])
        except (ZeroDivisionError, AssertionError):
            d = [1.0] + [(r - 0.5) / r for r in range(1, 6)]
        return lambda c: d[int(c)] * c if c <= 5 else c

    d1, d2 = disc(list(uni.values())), disc(list(bi.values()))
    ids = ["<unk>", "</s>", *voc]
    p1 = {w: d1(count[w]) / (N + 1) for w in ids[1:]}
    p1["</s>"] = max(p1["</s>"], 0.5 / (N + 1))
    p1["<unk>"] = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (a, b), c in bi.items():
        after[a][b] = d2(c) / (count[a] + 1)
    alpha = {a: (1 - sum(after[a].values())) / max(1 - sum(p1[b] for b in after[a]), 1e-12) for a in ids}
    p2 = lambda a, b: after[a][b] if b in after[a] else alpha[a] * p1[b]
    rare = n_words - sum(count[w] for w in voc)
    spell = lambda w: (uni[w] + 0.5) / (rare + 0.5 * (len(uni) - len(voc) + 1))
    for a in ids[:6]:
        if len(after[a]) < len(ids):
            assert abs(sum(p2(a, b) for b in ids) - 1) < 1e-9
    out = []
    for (d, _, h), t in zip(rows, toks):
        seq, score = ["</s>", *t, "</s>"], 0.0
        for a, b in zip(seq, seq[1:]):
            score += math.log10(p2(cls(a), cls(b))) + (math.log10(spell(b)) if cls(b) == "<unk>" else 0)
        c = [n_docs if w == "</s>" else uni[w] for w in [*t, "</s>"]]
        out.append((d, h, len(c), sum(x > 0 for x in c), N, sum(math.log10((x + 0.5) / (N + 0.5 * (V + 1))) for x in c), score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[6], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in docs]
    same(lm.op2_katz_backoff(spark, sf_dir).collect(), brute(rows, lm.VOCAB))


def test_small_vocabulary_and_odd_rows(spark):
    texts = ["The cat sat on the mat", "the  cat\tsat", None, "", "a b a b a b c", "É é É", "x " * 70000, "never seen words here", "the cat sat on the mat"] * 3
    rows = [(i // 2 if i % 7 else None, t, i % 4 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").selectExpr("*", "1 as score", "2 as h")
    same(lm.scored(df).collect(), brute(rows, lm.VOCAB))
    assert lm.scored(df.limit(0)).count() == 0
    nothing = [(1, "a b", True)]
    same(lm.scored(spark.createDataFrame(nothing, "doc_id long, text string, held_out boolean")).collect(), brute(nothing, lm.VOCAB))


def test_rare_words_are_words_of_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs][:60] + ["rare bird sings", "rare bird sings a rare bird", "rare bird", None, "bird sings rare unheard unseen"]
    rows = [(i, t, i % 5 == 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    for common in (0, 40):
        same(lm.scored(df, common).collect(), brute(rows, 1 << 40))


def test_more_words_than_are_broadcast(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 1000, (i + 1) * 1000)), False) for i in range(70)]
    rows += [(70, "w5 w6 w7 w9 w8", True), (71, "w5 never w6", True)]
    same(lm.scored(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect(), brute(rows, 1 << 40))


def test_blocks_grow_with_the_texts(spark):
    """However many partitions documents and shuffles have, blocks follow the size of the texts; results don't change."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 900}" for j in range(40)), i % 5 == 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(50)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/counts-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "120")
        same(lm.scored(df, 100).collect(), brute(rows, 1 << 40))  # counts of rare words that fit a byte
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    (new,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/counts-*")) - before
    assert spark.read.parquet(new).count() < 2000


def test_blocks_of_large_texts():
    number = lambda size: size / lm.blocked(size)[0] * lm.blocked(size)[1]
    assert number(50 << 30) < 60 * number(1 << 30) and lm.blocked(50 << 30)[0] <= lm.MOST_TEXT
    texts = ["a" * n for n in (5, 0, 300, 20, 20, 20, 1000, 1)] + [None, "b"]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 3], pa.string())}) for i in range(0, len(texts), 3)] + [pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    parts = [b.column("text").to_pylist() for b in lm._parts(iter(batches), 120)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [2, 1, 3, 1, 3]


def test_blocks_take_no_more_than_the_texts(spark, sf_dir):
    """What documents send to the buckets, compressed as a shuffle does, takes about the size of their texts, and not 1.4 times that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out").coalesce(1)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    voc = lm.vocabulary(lm.unigrams(docs), docs.where("not held_out").count(), 2000)
    shared, hot = (spark.sparkContext.broadcast(x) for x in (voc, lm.hot_counts(docs, spark.sparkContext.broadcast(voc))))
    blocks = docs.mapInArrow(lm._scatter(shared, hot, lm.TEXT, 8), lm.BLOCK).select("block").collect()
    assert sum(len(pa.compress(r.block, "lz4", asbytes=True)) for r in blocks) < 1.1 * size


def test_counts_at_the_end_of_a_byte(spark):
    """A rare history of 255 training tokens, before a word that never follows it."""
    rows = [(i, f"q z{i % 3}", False) for i in range(255)] + [(300, "q y z1 y", True), (301, "y", False)]
    same(lm.scored(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), 0).collect(), brute(rows, 1 << 40))


def test_what_comes_back_grows_with_the_texts(spark, sf_dir, monkeypatch):
    """Eight times as many buckets send back under twice as much: counts of few bits, not a fraction a document and bucket."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out").coalesce(1)
    size, bytes_back = docs.selectExpr("sum(octet_length(text))").first()[0], []
    for buckets in (4, 32):
        monkeypatch.setattr(lm, "blocked", lambda _: (size, buckets))
        before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/counts-*"))
        lm.scored(docs, 2000)
        (new,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/counts-*")) - before
        bytes_back.append(spark.read.parquet(new).where("batch >= 0").selectExpr("sum(length(block))").first()[0])
    assert bytes_back[1] < 1.8 * bytes_back[0]
