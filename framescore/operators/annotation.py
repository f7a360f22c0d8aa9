"""Review queue, language-prior audit, agreement, kappa, the filter cascade."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.sources.folders import shared_folder


def review_queue(annotations: DataFrame, n_required: int = 3) -> tuple[DataFrame, DataFrame]:
    """(tasks, late): a task is done at its n-th annotation by arrival; later ones are rejected; repeat annotators
    count. ``annotations``: task_id, arrival, annotator_id, answer_idx. ``tasks``: task_id, votes, n, done."""
    w = W.partitionBy("task_id").orderBy("arrival", "annotator_id", "answer_idx")
    ranked = annotations.withColumn("rn", F.row_number().over(w))
    votes = F.transform(F.array_sort(F.collect_list(F.struct("rn", "answer_idx"))), lambda x: x["answer_idx"])
    tasks = ranked.where(F.col("rn") <= n_required).groupBy("task_id").agg(votes.alias("votes"), F.count("*").alias("n"))
    return tasks.withColumn("done", F.col("n") >= n_required), ranked.where(F.col("rn") > n_required)


def prior_audit(trials: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(item_id, domain, prior, passed): share of text-only trials that are right; a missing reply is wrong.
    ``trials``: item_id, domain, answer_idx, pred."""
    out = trials.groupBy("item_id", "domain").agg(F.avg((F.coalesce("pred", F.lit(-1)) == F.col("answer_idx")).cast("int")).alias("prior"))
    return out.withColumn("passed", F.col("prior") < threshold)


def prior_rejections(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("passed")).groupBy("domain").agg(F.count("*").alias("n_rejected"))


def agreement(votes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(item_id, share, passed): share of the most frequent vote after an item's votes are padded with its first to the
    largest number of votes of any item; if that is under 2 every item passes at 1. ``votes``: item_id, arrival,
    vote."""
    per_vote = votes.groupBy("item_id", "vote").agg(F.count("*").alias("c"), F.min("arrival").alias("at"))
    items = per_vote.groupBy("item_id").agg(F.sum("c").alias("n"), F.min_by("vote", "at").alias("first"), F.map_from_entries(F.collect_list(F.struct("vote", "c"))).alias("counts"))
    top = items.agg(F.max("n").alias("top"))  # one row
    rows = items.crossJoin(F.broadcast(top))
    padded = F.transform(F.map_entries("counts"), lambda e: e["value"] + F.when(e["key"] == F.col("first"), F.col("top") - F.col("n")).otherwise(0))
    share = F.when(F.col("top") < 2, 1.0).otherwise(F.array_max(padded) / F.col("top"))
    return rows.select("item_id", share.alias("share")).withColumn("passed", F.col("share") >= threshold)


def _kappa(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Kappa of contingency counts (keys, a, b, c); null where chance agreement is 1."""
    n = cells.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.sum("c")).alias("po"))
    left = cells.groupBy(*keys, F.col("a").alias("v")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy(*keys, F.col("b").alias("v")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    rows = n.join(chance, keys, "left") if keys else n.join(chance)
    pe = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return rows.select(*keys, F.try_divide(F.col("po") - pe, 1 - pe).alias("kappa"), "n")


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """(kappa, n) of columns a and b, 0 if there are no pairs; only counts of (a, b) are shuffled."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    return _kappa(cells, []).select(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.col("kappa")).alias("kappa"), F.coalesce("n", F.lit(0)).alias("n"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, i, j, a, b, c) of a batch's items with n votes: how many have a at position i and b at j, i <= j; position n is padding."""
    for batch in batches:
        lists = batch.column("v")
        labels = lists.flatten().dictionary_encode("encode")
        names, code = labels.dictionary, labels.indices.to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        begin = np.cumsum(size) - size
        for n in np.unique(size[size > 0]):
            at = begin[size == n]
            votes = code[at[:, None] + np.append(np.arange(n), 0)]  # padding repeats the first vote
            seen, own = np.unique(votes, return_inverse=True)
            width = len(seen)
            x = np.zeros((len(at), (n + 1) * width))
            x[np.arange(len(at))[:, None], np.arange(n + 1) * width + own.reshape(votes.shape)] = 1
            tables = (x.T @ x).astype(np.int64)
            row, col = np.nonzero(tables)
            i, j = row // width, col // width
            keep = (i < j) | ((i == n) & (j == n))
            row, col, i, j = row[keep], col[keep], i[keep], j[keep]
            label = lambda k: names.take(pa.array(seen[k % width]))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), label(row), label(col), pa.array(tables[row, col])], ["n", "i", "j", "a", "b", "c"])


def panel_kappa(votes: DataFrame) -> DataFrame:
    """(panel_kappa, n_pairs): mean kappa over pairs of annotator positions on padded votes; 0 with under two. ``votes``: item_id, arrival,
    vote; the position is the arrival's rank in the item.

    An item's votes are a 0/1 vector over positions and labels; the sum of its outer products over items holds the contingency table of
    each pair of positions. Batches add up the items of each number of votes, so that only tables leave a task. Positions beyond an
    item's votes repeat its first: one position of padding stands for all of them, and is dealt to them at the end."""
    items = votes.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "vote"))), lambda x: x["vote"]).alias("v"))
    kind = votes.schema["vote"].dataType.simpleString()
    folder = shared_folder(votes.sparkSession, "tables")
    items.select("v").mapInArrow(_gram, f"n int, i int, j int, a {kind}, b {kind}, c long").groupBy("n", "i", "j", "a", "b").agg(F.sum("c").alias("c")).write.parquet(folder)
    tables = votes.sparkSession.read.parquet(folder)
    top = tables.agg(F.max("n")).first()[0] or 0
    # the positions that a table's i and j stand for
    spread = lambda c: F.when(F.col(c) < F.col("n"), F.array(c)).when(F.col("n") < top, F.sequence("n", F.lit(top - 1))).otherwise(F.array().cast("array<int>"))
    pairs = tables.withColumn("i", F.explode(spread("i"))).withColumn("j", F.explode(spread("j"))).where("i < j")
    nothing = F.lit(0).cast("long")
    same = F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(nothing)
    sides = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("c").alias("left"), nothing.alias("right"), same.alias("same")), F.struct(F.col("b").alias("v"), nothing.alias("left"), F.col("c").alias("right"), nothing.alias("same"))))
    margins = pairs.select("i", "j", sides.alias("x")).groupBy("i", "j", "x.v").agg(*(F.sum(f"x.{c}").alias(c) for c in ("left", "right", "same")))
    each = margins.groupBy("i", "j").agg(F.sum("left").alias("n"), F.sum("same").alias("same"), F.sum(F.col("left").cast("double") * F.col("right")).alias("chance"))
    pe = F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return each.select(F.try_divide(F.col("same") / F.col("n") - pe, 1 - pe).alias("kappa")).agg(F.coalesce(F.avg("kappa"), F.lit(0.0)).alias("panel_kappa"), F.count("*").alias("n_pairs"))


def irt_flags(params: DataFrame, floor: float = -2.5, ceiling: float = 2.5, low: float = 0.5) -> DataFrame:
    """``params`` (item_id, a, b) with floor, ceiling and low_disc."""
    return params.select("*", (F.col("b") < floor).alias("floor"), (F.col("b") > ceiling).alias("ceiling"), (F.col("a") < low).alias("low_disc"))


def cascade(items: DataFrame, tasks: DataFrame, audit: DataFrame, agreed: DataFrame, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items that pass review, prior and agreement, one row of counts). ``params`` (item_id, a, b) are attached as discrimination
    and difficulty if they are of as many items as pass; otherwise, and for an item they lack, these stay as they are (1 and 0
    where there is no such column)."""
    done = tasks.where("done").select(F.col("task_id").alias("item_id"), F.lit(1).alias("reviewed"))
    rows = items.join(done, "item_id", "left").join(audit.select("item_id", F.col("passed").alias("prior_ok")), "item_id", "left").join(agreed.select("item_id", F.col("passed").alias("agree_ok")), "item_id", "left")
    stage1 = F.col("reviewed").isNotNull()
    stage2 = stage1 & F.coalesce("prior_ok", F.lit(False))
    stage3 = stage2 & F.coalesce("agree_ok", F.lit(False))
    report = rows.agg(F.count("*").alias("n_items"), F.count_if(stage1).alias("n_reviewed"), F.count_if(stage2).alias("n_prior_passed"), F.count_if(stage3).alias("n_agreed"))
    kept = rows.where(stage3).select(*items.columns)
    if params is None:
        return kept, report
    sizes = kept.agg(F.count("*").alias("_kept")).crossJoin(params.agg(F.count("*").alias("_fitted")))  # one row
    both = kept.join(params.select("item_id", F.col("a").alias("_a"), F.col("b").alias("_b")), "item_id", "left").crossJoin(F.broadcast(sizes))
    fits = F.col("_kept") == F.col("_fitted")
    had = lambda c, default: F.col(c) if c in items.columns else F.lit(default)
    for name, value, default in (("discrimination", "_a", 1.0), ("difficulty", "_b", 0.0)):
        both = both.withColumn(name, F.coalesce(F.when(fits, F.col(value)), had(name, default)))
    return both.drop("_a", "_b", "_kept", "_fitted"), report
