"""The Merkle manifest and the divergence audit against brute-force versions; toxicity by its model's arithmetic and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framescore.llm import toxicity as T
from framescore.llm.divergence import divergences, op12_divergence_cube
from framescore.llm.merkle import manifest, op11_merkle_manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# --- manifest --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """(root, siblings (left, right) of each node, level by level)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for way, a in zip(ways, at):
            run, k = runs[a // 16], a % 16
            way.append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, at = [H(*r) for r in runs], [a // 16 for a in at]
    return nodes[0], ways


def brute_manifest(docs):
    by = defaultdict(list)
    for d in docs:
        by[d[1]].append(d)
    trees = {}
    for s, rows in by.items():
        rows.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(*d)))
        trees[s] = (rows, *climb([leaf_of(*d) for d in rows]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for s, way_up in zip(order, above):
        rows, subroot, ways = trees[s]
        for d, way in zip(rows, ways):
            way = way + way_up
            given = d
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                given = (*d[:4], d[4].translate(LOWER))
            h = leaf_of(*given)
            for left, right in way:
                h = H(left, h, right)
            out.append((d[0], leaf_of(*d), subroot, root, H(*(x for lr in way for x in lr)), h, h == root))
    return Counter(out)


def test_manifest_whole_table(spark, sf_dir):
    docs = [(d.doc_id, d.source, d.lang, d.n_chars, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op11_merkle_manifest(spark, sf_dir).collect()
    want = brute_manifest(docs)
    assert Counter(map(tuple, got)) == want and {r.verified for r in got} == {True, False}


def test_manifest_hot_source_nulls_repeats_and_names(spark):
    rng = random.Random(3)
    docs = [(i, "hot", "en", 3, f"Text {i}") for i in rng.sample(range(10_000), 700)]
    docs += [(i, f"s{i % 19}é", None, None, rng.choice(["", None, "A b", "é" * 9])) for i in range(60)]
    docs += [(5, None, "x", 1, "AAA"), (None, None, None, None, None), (None, "hot", None, 2, "Z"), (7, "", "x", 1, "q"), (7, "", "x", 1, "q"), (7, "", "x", 1, "Q"), (8, "alone", "x", 1, "Q"), (10, "big", "x", 1, "W" * 300_000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("g", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("pos", F.lit(3)).repartition(7)
    assert Counter(map(tuple, manifest(df).collect())) == brute_manifest(docs)
    assert manifest(df.limit(0)).count() == 0
    one = manifest(df.where("source = 'alone'")).collect()
    assert Counter(map(tuple, one)) == brute_manifest([d for d in docs if d[1] == "alone"])


# --- divergence ------------------------------------------------------------------------------------


def brute_divergence(docs, least=3, top=200):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[(lang or "", source or "")].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {k for k, _ in counts}:
        kept = [t for t, c in df[lang].items() if c >= least]
        own = {s: c for (k, s), c in counts.items() if k == lang}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: E731, B023
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = {s: {t: share(own[s][t], total[s]) for t in kept} for s in own}
        everything = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: share(everything[t], sum(total.values())) for t in kept}
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows) if part == "pair" or i < top]
    return sorted(out)


def test_divergence_whole_table(spark, sf_dir):
    docs = [(d.text, d.lang, d.source) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_divergence_cube(spark, sf_dir).collect())) == brute_divergence(docs)


def test_divergence_blocks_ties_and_odd_rows(spark):
    rng = random.Random(5)
    words = ["Ab", "cd", "é", "x1y", "the", "THE", "of", "zz-top", "\x00nul"]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["a", "b", None]), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}") for _ in range(200)]
    docs += [(None, "a", None), ("", "a", "empty"), ("never kept here", "c", "one"), (None, "c", "two"), ("1 2 3", None, None), ("tie tie", "d", "x"), ("tie", "d", "x"), ("tie", "d", "y"), ("w " * 200_000, "d", "y")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("n", F.lit("x")).withColumn("df", F.lit(1)).withColumn("term", F.lit(1)).withColumn("a.b", F.lit(1))
    want = brute_divergence(docs)
    # two or three sources and terms a block: a cube of many cells
    assert sorted(map(tuple, divergences(df, groups=2, terms=3).collect())) == want
    assert sorted(map(tuple, divergences(df).collect())) == want
    assert [r for r in map(tuple, divergences(df, top=2).collect()) if r[2] == "term" and r[5] > 2] == []
    assert divergences(df.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------


def brute_logit(model, text):
    """The most toxic window's logit, one n-gram at a time."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    margins = model.margins()
    value = lambda w: float(np.mean(margins[T.subwords([w])[0]]))
    best = None
    for k in range(0, len(words), T.WINDOW):
        start = min(k, max(len(words) - T.WINDOW, 0))
        z = sum(value(w) for w in set(words[start : start + T.WINDOW])) / T.WINDOW + model.bias[1] - model.bias[0]
        best = z if best is None else max(best, z)
    return best - np.log(max(1, -(-len(words) // T.WINDOW) / model.windows))


def test_subwords():
    buckets, first = T.subwords(["abc", "é", "", "abcx"])
    assert [int(x) for x in np.diff(first)] == [3 + 2 + 1 + 1, 1 + 0 + 0 + 1, 0 + 1, 4 + 3 + 2 + 1]
    one = lambda w: T.subwords([w])[0].tolist()
    assert one("abc") == buckets[first[0] : first[1]].tolist() and one("abcx") == buckets[first[3] : first[4]].tolist()
    assert len(set(one("abc")) & set(one("abcx"))) == 3  # the mark and ab, the mark and abc, abc


def _labelled(rng, n):
    plain = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 8))) for _ in range(300)]
    bad = ["zoxwort", "quavizzle", "vrumpkin"]
    rows = []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randrange(20, 200)), i % 4 == 0
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                k = rng.randrange(1, len(w))
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.5 else w[:k] + rng.choice("xyz") + w[k:])
        rows.append((i, " ".join(words), int(toxic)))
    return rows, plain


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(1)
    rows, plain = _labelled(rng, 1500)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels.where(T.learnable(F.col("doc_id"))))
    got = {r.doc_id: r for r in T.toxicity(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, y in held if y]) >= 0.9 and np.mean([p for p, y in held if not y]) <= 0.02
    some = rows[:40]
    z = T.logits(model.margins(), float(model.bias[1] - model.bias[0]), model.windows, pa.array([t for _, t, _ in some]))
    assert np.allclose(z, [brute_logit(model, t) for _, t, _ in some], rtol=1e-4, atol=1e-4)

    # a toxic passage far inside a very long text; repeated words; texts without words
    long = " ".join(rng.choices(plain, k=30_000))
    odd = [(1, long), (2, long + " zoxwort quavizzle vrumpkin zoxwortx " + long), (3, None), (4, ""), (5, "!? ..."), (6, f"{plain[0]} " * 5000), (7, "zoxwort QUAVIZZLE"), (7, "zoxwort QUAVIZZLE"), (None, plain[1])]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("a.b", F.lit(1))
    out = T.toxicity(df, model).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].predicted == 0 and by[2].predicted == 1 and by[6].predicted == 0 and by[7].predicted == 1
    assert by[3].score == by[4].score == by[5].score == model.empty and by[3].predicted == 0
    assert T.toxicity(df.limit(0), model).count() == 0


def test_toxicity_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (3, "d"), (None, "e")], "doc_id long, text string")
    for rows, want in (([], 0.0), ([(1, 1), (3, 1)], 1.0), ([(1, 0), (1, 0)], 0.0), ([(None, 1), (3, None), (1, 7)], 0.0)):
        model = T.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.score for r in T.toxicity(docs, model).collect()} == {want}
    model = T.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.toxicity(docs, model).collect())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = T.op13_subword_bags(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.5 and np.mean([r.predicted for r in clean]) <= 0.02
    ranks = np.argsort(np.argsort([r.score for r in toxic + clean]))
    assert (ranks[: len(toxic)].mean() - (len(toxic) - 1) / 2) / len(clean) >= 0.9  # area under the curve
