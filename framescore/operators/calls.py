"""Calls of models and judges with a ledger: what has been answered is never asked again, what fails is a null with its reason.

A call is a hash of who is asked and what. Answers are appended to a Parquet folder, the ledger, wave by wave, so that a job that
breaks off loses one wave at most; a rerun asks what an anti-join with the ledger leaves. In a task several calls are
under way at once. A task that Spark runs again, as it does with a wave's tasks of an executor that is lost, asks its calls
again: each is made at least once, and the last answer counts."""

from __future__ import annotations

import gc
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.functions.text import judge_score
from framescore.sources.folders import shared_folder

ANSWERS = "call string, who string, reply string, error string, asked double"
#: Calls under way at once in a task, calls of a task, calls of a wave.
PARALLEL, PER_TASK, WAVE = 8, 200, 100_000
#: Files of a wave: of its requests, about, and of its answers.
FILES = 8
#: Where a row of a stored table is.
PLACE = ("_metadata.file_name AS file", "_metadata.row_index AS place")


def call_key(who: str, request: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(who), F.to_json(request)), 256)


def attempted(make_client: Callable[[], Callable[[dict], object]], requests: list[str], parallel: int = PARALLEL, client=None) -> list[tuple[str | None, str | None, float]]:
    """(reply, error, time) of each request (JSON), several at once; an exception is the error of its own call alone."""
    client = client or make_client()

    def one(text: str) -> tuple[str | None, str | None, float]:
        try:
            got = client(json.loads(text))
            reply = got if got is None or isinstance(got, str) else json.dumps(got)
            return reply, None if reply is not None else "no_reply", time.time()
        except Exception as problem:  # noqa: BLE001 - whatever a client raises is the answer's error
            return None, f"call_failed_{problem!s}", time.time()

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(one, requests))


def answered(spark: SparkSession, ledger: str) -> DataFrame:
    """(call, reply, error): the last answer of each call in the ledger, one that has a reply before those that failed."""
    try:
        rows = spark.read.schema(ANSWERS).parquet(ledger)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], ANSWERS)
    best = F.max_by(F.struct("reply", "error"), F.struct(F.col("error").isNull(), "asked"))
    return rows.groupBy("call").agg(best.alias("x")).select("call", "x.reply", "x.error")


def _waves(stored: DataFrame, done: DataFrame, again: bool, per_file: int, per_task: int, wave: int) -> Iterator[tuple[int, list[str], DataFrame]]:
    """Waves of what of ``stored`` is not ``done``: (calls, files that hold them, rows (file, place, task) to be asked). A wave is whole files, so each
    is read once, and its calls go to tasks in their order. Only keys and places are shuffled."""
    spark = stored.sparkSession
    names = sorted(r.file for r in stored.selectExpr(PLACE[0]).distinct().collect())  # some FILES a wave
    files = spark.createDataFrame(list(enumerate(names)), "number long, file string")
    rows = stored.selectExpr(*PLACE, "call").join(F.broadcast(files), "file").select("call", (F.col("number") * per_file + F.col("place")).alias("at"))
    todo, folder = rows.groupBy("call").agg(F.min("at").alias("at")).join(done.where("error is null") if again else done, "call", "left_anti"), shared_folder(spark, "calls")
    todo.select("at", F.floor(F.col("at") / per_file).alias("number")).write.parquet(folder)
    todo = spark.read.parquet(folder)
    sizes, starts = [], []  # calls and files of each wave; of each file its number, wave and the calls before it there
    for number, n in sorted((r.number, r.n) for r in todo.groupBy("number").agg(F.count("*").alias("n")).collect()):
        if not sizes or sizes[-1][0] + n > wave:
            sizes.append((0, []))
        before, held = sizes[-1]
        starts.append((number, names[number], len(sizes) - 1, before))
        sizes[-1] = (before + n, [*held, names[number]])
    nth = F.row_number().over(W.partitionBy("number").orderBy("at")) - 1
    places = todo.join(F.broadcast(spark.createDataFrame(starts, "number long, file string, wave int, before long")), "number").withColumn("nth", nth)
    places = places.select("file", (F.col("at") % per_file).alias("place"), F.floor((F.col("before") + F.col("nth")) / per_task).cast("int").alias("task"), "wave")
    folder = shared_folder(spark, "waves")
    places.write.partitionBy("wave").parquet(folder)
    for w, (n, held) in enumerate(sizes):
        yield n, held, spark.read.schema(places.drop("wave").schema).parquet(f"{folder}/wave={w}")


def ask(requests: DataFrame, who: str, make_client: Callable[[], Callable[[dict], object]], ledger: str, again: bool = True, parallel: int = PARALLEL, per_task: int = PER_TASK, wave: int = WAVE) -> DataFrame:
    """``requests`` (request: struct, and others) with reply and error, asking only what the ledger lacks.

    ``make_client`` runs once a batch of a task and gives a function of the request as a dictionary. Equal requests are one call; add
    an id or a trial's number to the request where each is to be asked. With ``again`` failed calls are asked anew."""
    spark = requests.sparkSession
    keyed = requests.withColumn("call", call_key(who, F.col("request")))
    folder, per_file = shared_folder(spark, "requests"), max(1, wave // FILES)
    keyed.write.option("maxRecordsPerFile", per_file).parquet(folder)
    stored = spark.read.schema(keyed.schema).parquet(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not gc.get_freeze_count():
            gc.freeze()  # a worker looks for garbage after each task, in all that its imports made: longer than 200 quick calls take
        for b in batches:
            got = attempted(make_client, list(b.text), parallel)
            reply, error, asked = zip(*got) if got else ((), (), ())
            yield pd.DataFrame({"call": b.call, "who": who, "reply": pd.Series(reply, dtype=object, index=b.index), "error": pd.Series(error, dtype=object, index=b.index), "asked": pd.Series(asked, dtype=float, index=b.index)})

    for n, files, places in _waves(stored, answered(spark, ledger), again, per_file, per_task, wave):
        rows = spark.read.schema(keyed.schema).parquet(*(f"{folder}/{file}" for file in files)).selectExpr(*PLACE, "call", "to_json(request) AS text")
        part = rows.join(F.broadcast(places), ["file", "place"]).repartitionById(-(-n // per_task), F.col("task")).select("call", "text")
        part.mapInPandas(run, ANSWERS).repartition(FILES, "call").write.mode("append").parquet(ledger)
    # written, as a plan that reads the ledger twice, before and after an ask, would see one state of it
    found, folder = answered(spark, ledger).join(stored.select("call"), "call", "left_semi"), shared_folder(spark, "answers")
    found.write.parquet(folder)
    return stored.join(spark.read.schema(found.schema).parquet(folder), "call", "left").drop("call")


def judged(requests: DataFrame, judges: dict[str, Callable[[], Callable[[dict], object]]], ledger: str, uncertainty: str = "high", **how) -> DataFrame:
    """A verdict of each judge, by name, on each request: the other columns, judge, score (null where the call failed), uncertainty, violations,
    rationale (the reply, or why there is none); as ``judges.ensemble`` reads them. Without judges it raises ValueError."""
    if not judges:
        raise ValueError("an ensemble needs a judge")
    out = None
    for name, make in judges.items():
        rows = ask(requests, name, make, ledger, **how).withColumn("judge", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    none = F.array().cast("array<string>")
    return out.select("*", judge_score(F.col("reply")).alias("score"), F.lit(uncertainty).alias("uncertainty"), none.alias("violations"), F.coalesce("reply", "error").alias("rationale")).drop("request", "reply", "error")


def prior_trials(items: DataFrame, make_client: Callable[[], Callable[[dict], object]] | None, ledger: str, n_trials: int = 5, **how) -> DataFrame:
    """Text-only trials of ``items`` (item_id, domain, answer_idx, question, choices) as ``annotation.prior_audit`` reads them: item_id, domain,
    answer_idx, trial, pred, the first digit 0 to 3 of the reply. A failed call, and every trial without a client, is -1 and so wrong."""
    trials = items.select("item_id", "domain", "answer_idx", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial"), "question", "choices")
    if make_client is None:
        return trials.select("item_id", "domain", "answer_idx", "trial", F.lit(-1).alias("pred"))
    asked = trials.select("item_id", "domain", "answer_idx", "trial", F.struct("item_id", "trial", "question", "choices").alias("request"))
    digit = F.nullif(F.regexp_extract("reply", "[0-3]", 0), F.lit("")).cast("int")
    return ask(asked, "prior", make_client, ledger, **how).select("item_id", "domain", "answer_idx", "trial", F.coalesce(digit, F.lit(-1)).alias("pred"))
