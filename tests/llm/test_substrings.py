"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
import re

from framescore.llm import substrings


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        drop = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                drop[i : i + 13] = [True] * 13
        kept = " ".join(x for x, y in zip(w, drop) if not y)
        out.append((d is None, d or 0, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()])
    assert got(substrings.op7_phrase_automata(spark, "/root/testdata/sf0.01")) == want
    assert sum(r[3] for r in want) > 0


def test_passages_copies_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: [rng.choice("abcdefghij") + rng.choice("xyz") * rng.randrange(3) for _ in range(n)]
    passages = [word(n) for n in (13, 14, 20, 60, 12)]
    rows = [(rng.randrange(1000), " ".join(word(rng.randrange(30)) + rng.choice(passages) + word(rng.randrange(30)) + rng.choice(passages))) for _ in range(120)]
    rows += rows[:6] + [(2000 + i, rows[i][1].replace(" ", "\n\t")) for i in range(5)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (None, rows[0][1]), (None, None), (3003, "é " * 40000), (3004, "é " * 20), (-5, " ".join(passages[3])), (3005, "x " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as t1", "'x' as places")
    want = brute(rows)
    assert got(substrings.deduplicated(df)) == want
    monkeypatch.setattr(substrings, "SEGMENTS", 9)
    assert got(substrings.deduplicated(df)) == want
    assert substrings.deduplicated(df.limit(0)).count() == 0
