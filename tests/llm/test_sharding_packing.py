"""Sharding and packing: exact round trips, and small tables with nulls, empty texts, repeated rows."""

import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framescore.llm import packing, sharding
from framescore.llm.packing import combinations, nnls, op9_nnls_packing, packed
from framescore.llm.sharding import op10_two_pass_shuffle, shuffled_shards, write_shards

VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "x"), (2, "", "x"), (3, "Hello  wörld <|endoftext|> it's 42", "x"), (3, "Hello  wörld <|endoftext|> it's 42", "x"), (None, "é   nbsp x", "x"), (5, "long " * 9000, "y"), (6, "one" * 3000, "y")]
SCHEMA = "doc_id long, text string, start string"


def check_packing(rows, texts, window=4096):
    """Ids lie in one piece each, checksums are those of the tokenizer's ids, windows are gapless."""
    tok = Tokenizer.from_file(VOCAB)
    want = {k: Counter() for k in texts}
    of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for k, all_texts in texts.items():
        ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in all_texts]
        assert {len(x) for x in ids} >= {r.doc_tokens for r in of[k]}
        assert sum(r.length for r in of[k]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in sorted(of[k], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids[0])
    for x in places.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= window
    return len(places) * window - sum(r.length for r in rows)


def test_packing_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    rows = op9_nnls_packing(spark, sf_dir).collect()
    padding = check_packing(rows, texts)
    assert padding < 0.02 * sum(r.length for r in rows) + 4096


def test_packing_odd_rows(spark):
    texts = defaultdict(list)
    for k, t, _ in ODD:
        texts[k].append(t)
    check_packing(packed(spark.createDataFrame(ODD, SCHEMA), VOCAB).collect(), texts)
    assert packed(spark.createDataFrame([], SCHEMA), VOCAB).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("aBzÉé'st.,!-|<>=09 \n\t\u0301\u0338\u00a0\x1c\x85²ßİ") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't"]), max_size=14).map("".join), min_size=1, max_size=5))
def test_words_give_the_tokenizers_ids(texts):
    tok = Tokenizer.from_file(VOCAB)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    (out,) = packing._tokenised(VOCAB, 4096, 2, "<u2")([batch])
    got = {d: np.frombuffer(x, "<u2").tolist() for d, x in zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist())}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(5):
        a, h = rng.random((8, 20)), rng.random(8)
        x = nnls(a, h)
        slope = a.T @ (h - a @ x)
        assert (x >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[x > 0]).max() < 1e-8
    assert (combinations(64).T @ np.arange(1, 65) == 64).all()


def test_sharding_law_and_order(spark, sf_dir):
    out = op10_two_pass_shuffle(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    texts = dict(zip(docs.doc_id, docs.text))
    assert len(out) == len(docs) and (out.grown_shard.eq(out["shard"]) | out.grown_shard.eq(24)).all() and out["shard"].between(0, 23).all()
    assert all(zlib.crc32((texts[d] or "").encode()) == c and len((texts[d] or "").encode()) + 8 == s for d, c, s in zip(out.doc_id, out.text_crc32, out["size"]))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    shifted = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id"))
    again = shuffled_shards(shifted.select("doc_id"), "doc_id").toPandas().set_index("doc_id")["shard"]
    assert (again.loc[out.doc_id].to_numpy() == out["shard"].to_numpy()).all()


def test_sharding_odd_rows_many_buckets_and_files(spark, tmp_path):
    df = spark.createDataFrame(ODD * 40, "doc_id long, text string, shard string")
    out = shuffled_shards(df, "doc_id", shards=3, bucket_bytes=640).toPandas()
    assert len(out) == len(ODD) * 40 and out.bucket.max() > 3
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    assert shuffled_shards(spark.createDataFrame([], SCHEMA), "doc_id").count() == 0
    write_shards(df.drop("shard"), str(tmp_path / "s"), shards=3, bucket_bytes=640)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, df.select("doc_id", "text").collect()))


def test_sharding_moves_whole_texts_in_buckets_sized_by_bytes(spark, sf_dir, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), 500).alias("text"), F.array(F.lit("x" * 1000)).alias("parts"))
    out = shuffled_shards(df, "doc_id", shards=1, bucket_bytes=1 << 14).toPandas()
    assert len(out) == 200 and out.bucket.max() >= 20 and set(out.text) == {"é" * 500}
    assert out.groupby("bucket").size().max() * 2000 < 3 << 14
    moved = []
    monkeypatch.setattr(sharding, "shuffled_shards", lambda records, *a, **k: moved.append(records.columns) or shuffled_shards(records, *a, **k))
    assert sharding.op10_two_pass_shuffle(spark, sf_dir).count() and set(spark.read.parquet(f"{sf_dir}/documents.parquet").columns) <= set(moved[0])


def test_sharding_does_not_depend_on_the_layout(spark, sf_dir):
    """The same rows in other files and partitions give the same shards and slots; names of inner columns may occur."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200).cache()
    df = df.select("doc_id", "text", F.lit(1).alias("_u"), F.lit(2).alias("_b"), F.lit(3).alias("r"), F.lit(4).alias("size"), F.lit(5).alias("u"), F.lit(6).alias("dotted.name"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    slots = lambda d: {(x.doc_id, x["shard"], x.bucket, x.slot) for x in shuffled_shards(d, "doc_id", shards=3, bucket_bytes=1 << 15).collect()}
    first = slots(df.coalesce(1))
    assert first == slots(df.repartition(7)) == slots(df.orderBy(F.desc("text"))) and len(first) == 200 and len({b for _, _, b, _ in first}) > 2
    same = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    out = shuffled_shards(same, "doc_id", shards=2, bucket_bytes=65 * 50, equal=100).toPandas()
    assert sorted(out.slot) == list(range(400)) and out.groupby("bucket").size().max() < 150


_PEAK = """
import re, sys
import numpy as np, pyarrow as pa, public_tokenizers
from framescore.llm import packing

def size(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(1)
text = lambda: " ".join(map(bytes.decode, rng.integers(97, 123, (600, 7), np.uint8).view("S7").ravel()))
batch = pa.record_batch({"doc_id": pa.array(range(1500)), "text": pa.array([text() for _ in range(1500)])})
vocab = public_tokenizers.path("word_bpe_49k.json")
packing.Encoder.of(vocab)
before = size("VmRSS")
n = sum(sum(b.column("length").to_pylist()) for b in packing._tokenised(vocab, 4096, 2, "<u2")([batch]))
print(n, size("VmHWM") - before)
"""


def test_tokens_of_many_new_words_in_little_memory():
    """7 MB of texts, of whose 900,000 words all are new: two such workers share an executor's memory with its heap."""
    out = subprocess.run([sys.executable, "-c", _PEAK], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], env=os.environ | {"PYTHONPATH": ":".join(sys.path)})
    n, mb = out.stdout.split()
    assert int(n) > 900_000 and float(mb) < 250
