"""Model requests and calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framescore.functions.text import counterfactual_question
from framescore.operators.calls import PARALLEL, ask, attempted

PREDICTIONS = "model_id string, item_id string, track string, answer_idx int, text string, video_path string, video_paths_by_level map<string,string>, variant_video_paths array<string>, latency_ms double, error string"


def requests(items: DataFrame, track: str) -> DataFrame:
    """(item_id, request): what a model is asked for each item."""
    fields = {
        "G": [F.col("prompt"), F.col("item_id")],
        "C": [F.col("prompt"), F.col("item_id"), F.col("control_signals"), F.col("variant_prompts")],
        "U": [F.col("video_path"), F.col("question"), F.col("choices")],
        "CF": [F.col("base_video_path").alias("video_path"), F.col("base_description").alias("scenario"), counterfactual_question(F.col("counterfactual_variable"), F.col("counterfactual_change")).alias("question")],
    }
    if track not in fields:
        raise ValueError(f"unknown track: {track}")
    return items.select("item_id", F.struct(*fields[track]).alias("request"))


def run_model(asked: DataFrame, track: str, make_model: Callable[[], Callable[[dict], dict]], ledger: str | None = None, parallel: int = PARALLEL) -> DataFrame:
    """Predictions of a black-box model. ``make_model`` runs once a task (with a ledger: once a batch; clients are opened there); ``parallel`` calls are
    under way at once in a task. A response names model_id ("unknown" if not) and the answer's fields; a failed call has none, and its
    reason in ``error``. With a ``ledger`` (see ``calls``) a rerun asks only what is not answered."""
    rows = asked.select(F.col("item_id").cast("string").alias("item_id"), "request")
    if ledger is None:

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make_model()
            for b in batches:
                got = attempted(make_model, list(b.text), parallel, model)
                yield pd.DataFrame({"item_id": b.item_id, "reply": pd.Series([x[0] for x in got], dtype=object, index=b.index), "error": pd.Series([x[1] for x in got], dtype=object, index=b.index)})

        replies = rows.select("item_id", F.to_json("request").alias("text")).mapInPandas(call, "item_id string, reply string, error string")
    else:
        replies = ask(rows, f"model of {track}", make_model, ledger, parallel=parallel)
    fields = StructType.fromDDL(PREDICTIONS)
    replies = replies.withColumn("x", F.from_json("reply", StructType([f for f in fields if f.name not in ("item_id", "track", "error")])))
    own = {"item_id": F.col("item_id"), "track": F.lit(track), "error": F.col("error"), "model_id": F.coalesce("x.model_id", F.lit("unknown"))}
    return replies.select(*(own.get(f.name, F.col(f"x.{f.name}")).alias(f.name) for f in fields))


def constant_model() -> Callable[[dict], dict]:
    """Baseline: answer 0, a stock text."""
    return lambda request: {"model_id": "baseline", "answer_idx": 0, "text": "The outcome would not change meaningfully."}


def constant_predictions(items: DataFrame, track: str) -> DataFrame:
    """The baseline without a call."""
    return items.select(F.lit("baseline").alias("model_id"), F.col("item_id").cast("string").alias("item_id"), F.lit(track).alias("track"), F.lit(0).alias("answer_idx"), F.lit("The outcome would not change meaningfully.").alias("text"))
