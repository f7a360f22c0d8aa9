"""The shingle join against all pairs."""

import itertools
import random
import re

import numpy as np

from framescore.llm import ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [d for d, _ in rows]
    comp = dict.fromkeys(d for d in ids if d is not None)
    for d in comp:
        comp[d] = d
    changed, pairs = True, []
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if ids[i] is not None and ids[j] is not None and a and b and 3 * max(len(a), len(b)) <= 4 * min(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
            pairs.append((ids[i], ids[j]))
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return sorted(((d is None, d or 0), len(s), comp.get(d)) for d, s in zip(ids, sets))


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()])
    assert got(ngram_join.op4_bitmap_tiles(spark, "/root/testdata/sf0.01")) == want
    assert any(c != d[1] for d, _, c in want)


def family(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 3 + 1, " ".join(w[: rng.choice([120, 118, 100, 90])])))
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows += [(500 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))) + " " + passage) for i in range(40)]
    return rows


def test_families_in_small_tiles(spark):
    rows = family() + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "two one"), (904, "one two"), (None, "one two"), (None, rows_text := family()[0][1]), (906, "a " * 70000), (907, rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cluster", "'x' as h1")
    want = brute(rows)
    assert got(ngram_join.joined(df)) == want
    assert got(ngram_join.joined(df, tile=7, few=3)) == want
    assert got(ngram_join.joined(df.repartition(5), tile=3, few=2)) == want
    assert ngram_join.joined(df.limit(0)).count() == 0


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.05, 0.1, 0.2]), rng.integers(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(12)]
        part = list(range(12))
        for i, j in itertools.combinations(range(12), 2):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                part = [part[i] if p == part[j] else p for p in part]
        own = list(range(12))
        label, side = np.arange(12), np.zeros(12, bool)
        for a, b in ngram_join.linked(np.arange(12), sets, label, side):
            own = [own[a] if p == own[b] else p for p in own]
        assert len(set(own)) == len(set(part))
        active = {i: root for i, _, root in ngram_join._active(np.arange(12), np.array([len(x) for x in sets]), [ngram_join.signature(x) for x in sets], label, side)}
        assert all(active[i] == active[j] for i, j in itertools.combinations(range(12), 2) if part[i] == part[j])
