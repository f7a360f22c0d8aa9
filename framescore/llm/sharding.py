"""Sharding of documents by a two-pass external shuffle.

Pass one scatters the records into buckets small enough for memory: the shard by seeded rendezvous hashes of the
key, the bucket within the shard by a seeded hash of the whole record, so that a table gives the same shards and slots
however its files are cut. Pass two draws a Fisher-Yates permutation of each bucket (Spark's seeded ``shuffle`` of the
bucket's array, sorted by that hash) and numbers the records through the buckets of a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from framescore.llm.common import documents, written

SHARDS, SEED, BUCKET_BYTES = 24, 42, 32 << 20
#: Rows that are equal in all columns from which on they are spread over buckets.
EQUAL = 10_000


def rendezvous(key, shards: int, seed: int):
    """The shard whose seeded hash with the key is largest: one more shard takes keys only into itself."""
    marks = F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards)))
    return F.array_max(marks)["i"]


def record_size(records: DataFrame):
    """Bytes of a record: 64 and those of its strings, binaries and nested values; null has none."""
    size = F.lit(64).cast("long")
    for f in records.schema:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0))
        elif isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return size


def _row_hash(records: DataFrame, names: list[str], seed: int):
    """A seeded hash of a whole record; maps, which Spark doesn't hash, by their text."""
    cols = [F.to_json(F.col(f"`{c}`")) if isinstance(records.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(f"`{c}`") for c in names]
    return F.xxhash64(F.lit(seed), *cols)


def shuffled_shards(records: DataFrame, key: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, record_bytes=None, equal: int = EQUAL) -> DataFrame:
    """``records`` with shard, grown_shard (with one shard more), bucket and slot (gapless from 0 in each shard, in
    shuffled order).

    A null key hashes as such, equal rows stay separate rows, an empty table gives an empty one. A column named as
    an added one is replaced; any other name may occur. ``record_bytes`` is a column's estimate of a record in memory (default
    ``record_size``); buckets have about ``bucket_bytes``, and a task of pass two about one bucket. Rows with one key share the
    shard (that is the law) but not the bucket. From ``equal`` rows on that are the same in all columns, and so could
    change places unseen, a random number spreads them, so that they make no bucket large."""
    names = [c for c in records.columns if c not in ("shard", "grown_shard", "bucket", "slot")]
    placed = records.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("r"),
        rendezvous(F.col(f"`{key}`"), shards, seed).alias("shard"),
        rendezvous(F.col(f"`{key}`"), shards + 1, seed).alias("grown"),
        _row_hash(records, names, seed).alias("h"),
        (record_size(records) if record_bytes is None else record_bytes).alias("size"),
    )
    placed = written(placed, "scatter")
    same = placed.groupBy("h").count().where(F.col("count") >= equal).select("h", F.lit(True).alias("many"))
    placed = placed.join(same, "h", "left").withColumn("u", F.when(F.col("many"), F.xxhash64("h", F.rand(seed))).otherwise(F.col("h"))).drop("many")
    buckets = placed.groupBy("shard").agg(F.ceil(F.sum("size") / bucket_bytes).cast("int").alias("buckets"))  # a row a shard
    n = buckets.agg(F.sum("buckets")).first()[0] or 1
    placed = placed.join(F.broadcast(buckets), "shard").withColumn("bucket", F.pmod("u", F.col("buckets")).cast("int"))
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.repartition(n, "shard", "bucket").groupBy("shard", "bucket").agg(F.collect_list(F.struct("u", "grown", "r")).alias("rows"))
    by = F.array_sort("rows", lambda x, y: F.when(x["u"] < y["u"], -1).when(x["u"] > y["u"], 1).otherwise(0))
    permuted = whole.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle(by, F.lit(seed)).alias("rows"))
    rows = permuted.select("shard", "bucket", F.posexplode("rows").alias("place", "x")).join(before, ["shard", "bucket"])
    return rows.select(*(F.col("x.r").getField(c).alias(c) for c in names), "shard", F.col("x.grown").alias("grown_shard"), "bucket", (F.col("before") + F.col("place")).alias("slot"))


def write_shards(records: DataFrame, path: str, key: str = "doc_id", **how) -> None:
    """Writes whole records in shuffled order, a folder a shard and a file a bucket."""
    out = shuffled_shards(records, key, **how)
    out.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    moved = shuffled_shards(documents(spark, sf_dir), "doc_id")
    return moved.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
