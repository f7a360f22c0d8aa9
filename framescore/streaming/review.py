"""The review queue as a stateful stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from framescore.sources.folders import shared_folder

OUTPUT = "task_id long, votes array<int>, n int, late boolean"
STATE = "votes array<int>, done boolean"


def review_stream(annotations: DataFrame, n_required: int = 3) -> DataFrame:
    """Stream of (task_id, votes, n, late): a row when a task gets its n-th annotation, and a row with ``late`` for each
    one after that. ``annotations``: task_id long, arrival, annotator_id, answer_idx.

    A task's state is its votes, and a marker once it is done. Annotations of one micro-batch count in order of arrival,
    annotator and answer; between batches the first to come counts."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        votes, done = state.get if state.exists else ([], False)
        votes = list(votes or [])
        rows = pd.concat(list(batches)).sort_values(["arrival", "annotator_id", "answer_idx"], kind="stable")
        out = []
        for answer in rows.answer_idx.tolist():
            if done:
                out.append((key[0], [int(answer)], 1, True))
                continue
            votes.append(int(answer))
            if len(votes) == n_required:
                out.append((key[0], votes, n_required, False))
                votes, done = [], True
        state.update((votes, done))
        yield pd.DataFrame(out, columns=["task_id", "votes", "n", "late"])

    return annotations.groupBy("task_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(source: DataFrame, n_required: int = 3, folder: str | None = None) -> DataFrame:
    """Runs the stream over all that ``source`` (a streaming table) has now, and returns what it sent. Output and
    checkpoint go to the folder that executors share."""
    spark = source.sparkSession
    path = f"{folder}/review-{uuid.uuid4().hex}" if folder else shared_folder(spark, "review")
    sent = review_stream(source, n_required).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    sent.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{path}/out")
