"""Two-parameter logistic item response model, fitted by alternating blocks on one objective."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.sources.folders import shared_folder

LIMIT = 10.0
#: Answers of a bucket of items, about.
ANSWERS = 20_000


def _items_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Newton steps for the (log a, b) of all items of a bucket at once, given abilities: log-likelihood less
    2 (log a) ** 2, |b| at most LIMIT."""
    k, names = pd.factorize(pdf.item_id)
    n = len(names)
    th, y = pdf.theta.to_numpy(), pdf.correct.to_numpy(float)
    first = np.unique(k, return_index=True)[1]
    la, b = np.log(pdf.a.to_numpy()[first]), pdf.b.to_numpy()[first]
    total = lambda x: np.bincount(k, x, n)

    def value(la, b):
        z = np.exp(la)[k] * (th - b[k])
        return total(y * z - np.logaddexp(0, z)) - 2 * la * la

    now = value(la, b)
    for _ in range(25):
        a, d = np.exp(la)[k], th - b[k]
        p = 1 / (1 + np.exp(-a * d))
        w, r = p * (1 - p), y - p
        ga, gb = total(r * a * d) - 4 * la, total(-a * r)
        haa, hab, hbb = total(w * (a * d) ** 2) + 4, -total(w * a * a * d), total(w * a * a) + 1e-6
        det = haa * hbb - hab * hab
        sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        todo, before = np.ones(n, bool), now
        for scale in (1, 0.5, 0.25, 0.1, 0.02):
            la2, b2 = np.clip(la + scale * sa, -3, 3), np.clip(b + scale * sb, -LIMIT, LIMIT)
            after = value(la2, b2)
            better = todo & (after > now)
            la, b, now = np.where(better, la2, la), np.where(better, b2, b), np.where(better, after, now)
            todo &= ~better
            if not todo.any():
                break
        if (now - before).max() < 1e-9:
            break
    return pd.DataFrame({"item_id": names, "a": np.exp(la), "b": b})


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its size is known and its lineage ends."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_2pl(responses: DataFrame, rounds: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, a, b, converged; models: model_id, theta) of ``responses``: model_id, item_id, correct 0/1.

    Items are fitted in buckets of some ten thousand answers against the models' abilities, each by itself; abilities by one grouped Newton step on
    sums. Abilities have a standard normal prior, log a a penalty of 2 (log a) ** 2. Stops when abilities move less
    than ``tolerance``. Under two models every a is 1 and b is 0. An item that all or none get right has no finite b
    and is held at the limit (converged false); no item has converged where the rounds end before abilities settle. Parameters are written each round to cut lineage."""
    spark = responses.sparkSession
    items = responses.groupBy("item_id").agg(F.lit(1.0).alias("a"), (2 * (0.5 - F.avg("correct"))).alias("b"))
    models = responses.groupBy("model_id").agg(F.lit(0.0).alias("theta"))
    if models.limit(2).count() < 2:
        return items.select("item_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(True).alias("converged")), models
    responses = kept(responses.select("model_id", "item_id", "correct"), "responses")  # read twice a round
    items = kept(responses.groupBy("item_id").agg(F.lit(1.0).alias("a"), (2 * (0.5 - F.avg("correct"))).alias("b")), "items")
    models = kept(models, "models")
    kind, far = dict(responses.dtypes)["item_id"], float("inf")
    buckets = max(8, responses.count() // ANSWERS)
    for _ in range(rounds):
        joined = responses.join(items, "item_id").join(models, "model_id")
        grad = F.sum(F.col("a") * (F.col("correct") - F.col("p")))
        info = F.sum(F.col("a") * F.col("a") * F.col("p") * (1 - F.col("p")))
        step = joined.withColumn("p", 1 / (1 + F.exp(-F.col("a") * (F.col("theta") - F.col("b"))))).groupBy("model_id").agg(F.first("theta").alias("t"), grad.alias("g"), info.alias("i"))
        moved = kept(step.select("model_id", (F.col("t") + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("g") - F.col("t")) / (F.col("i") + 1)))).alias("theta"), F.col("t")), "models")
        far = moved.agg(F.max(F.abs(F.col("theta") - F.col("t")))).first()[0]
        models = moved.drop("t")
        joined = responses.join(models, "model_id").join(items, "item_id").withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)))
        items = kept(joined.groupBy("bucket").applyInPandas(_items_step, f"item_id {kind}, a double, b double"), "items")
        if far < tolerance:
            break
    return items.withColumn("converged", (F.abs("b") < LIMIT) & F.lit(far < tolerance)), models


def objective(responses: DataFrame, items: DataFrame, models: DataFrame) -> float:
    """Penalised log-likelihood."""
    z = F.col("a") * (F.col("theta") - F.col("b"))
    ll = responses.join(items, "item_id").join(models, "model_id").agg(F.sum(F.col("correct") * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z))))).first()[0]
    return ll - items.agg(F.sum(2 * F.log("a") * F.log("a"))).first()[0] - models.agg(F.sum(F.col("theta") * F.col("theta") / 2)).first()[0]
