"""Scores of the four tracks. Working form: a row a model, scope and metric's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from framescore.functions.text import direction_match, entailment, magnitude_match


def with_models(df: DataFrame, preds: DataFrame) -> DataFrame:
    """``df`` once for every model of ``preds``, whose names (a row a model) are read beforehand."""
    kind = preds.schema["model_id"].dataType
    models = [F.lit(r[0]).cast(kind) for r in preds.select("model_id").distinct().collect()]
    return df.withColumn("model_id", F.explode(F.array(*models).cast(ArrayType(kind))))


def last_predictions(preds: DataFrame, value: str = "answer_idx", order: str = "seq") -> DataFrame:
    """The last prediction of each model and item, combined before the shuffle."""
    return preds.groupBy("model_id", "item_id").agg(F.max_by(value, order).alias(value))


def join_answers(items: DataFrame, preds: DataFrame) -> DataFrame:
    """Every model with every item, with its last answer (null without one); predictions of unknown items go.

    The full grid exists for chains, in which a missing answer is wrong."""
    last = last_predictions(preds).withColumnRenamed("answer_idx", "pred_idx").withColumn("answered", F.lit(True))
    return with_models(items, preds).join(last, ["model_id", "item_id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def correct(pred: Column, answer: Column) -> Column:
    """1 or 0; an answer that is not an index counts as -1."""
    return (F.coalesce(pred, F.lit(-1)) == answer).cast("int")


def accuracy(items: DataFrame, preds: DataFrame, by: str = "domain") -> DataFrame:
    """(model_id, scope_value, accuracy, n) over answered items: null scope for all of them, else one value of ``by``."""
    got = _answered(items, preds)
    out = got.groupingSets([["model_id"], ["model_id", by]], "model_id", by).agg(F.grouping(by).alias("total"), F.avg("ok").alias("accuracy"), F.count("*").alias("n"))
    return out.select("model_id", F.when(F.col("total") == 1, "overall").otherwise("domain").alias("scope"), F.col(by).alias("scope_value"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "n")


def _answered(items: DataFrame, preds: DataFrame) -> DataFrame:
    last = last_predictions(preds).withColumnRenamed("answer_idx", "pred_idx")
    return last.join(items, "item_id").withColumn("ok", correct(F.col("pred_idx"), F.col("answer_idx")))


def chains(items: DataFrame, preds: DataFrame) -> DataFrame:
    """(model_id, chain_id, chain_ok, first_error_hop): a chain is right if every member is; a missing hop counts as 0.

    Only answered rows are joined: a chain's members are one array, of which those that a model has right are taken off."""
    inside = items.where(F.col("chain_id").isNotNull() & (F.col("chain_id").cast("string") != ""))
    members = inside.groupBy("chain_id").agg(F.collect_list(F.struct(F.coalesce("hop_index", F.lit(0)).alias("hop"), "item_id")).alias("members"))
    right = _answered(inside, preds).where("ok = 1").groupBy("model_id", "chain_id").agg(F.collect_list("item_id").alias("right"))
    rows = with_models(members, preds).join(right, ["model_id", "chain_id"], "left")
    wrong = F.filter("members", lambda x: ~F.coalesce(F.array_contains("right", x["item_id"]), F.lit(False)))
    out = rows.select("model_id", "chain_id", F.array_min(F.transform(wrong, lambda x: x["hop"])).alias("first_error_hop"))
    return out.withColumn("chain_ok", F.col("first_error_hop").isNull().cast("int"))


def chain_summary(chain: DataFrame) -> DataFrame:
    """(model_id, n_chains, multihop_chain_accuracy, error_propagation_rate, mean_first_error_hop)."""
    failed = F.col("first_error_hop")
    return chain.groupBy("model_id").agg(
        F.count("*").alias("n_chains"),
        F.avg("chain_ok").alias("multihop_chain_accuracy"),
        F.coalesce(F.avg(F.when(failed.isNotNull(), (failed > 0).cast("int"))), F.lit(0.0)).alias("error_propagation_rate"),
        F.coalesce(F.avg(failed), F.lit(0.0)).alias("mean_first_error_hop"),
    )


def _numbered(items: DataFrame) -> DataFrame:
    """``items`` with hop (0 for null), and, of a chain's members in the order of hop and item: place, size, first_hop, next_hop."""
    chained = F.col("chain_id").isNotNull() & (F.col("chain_id").cast("string") != "")
    rows = items.withColumn("chain_id", F.when(chained, F.col("chain_id"))).withColumn("hop", F.coalesce("hop_index", F.lit(0)))
    # items without a chain are windows of their own, not one large one
    own = W.partitionBy("chain_id", F.when(F.col("chain_id").isNull(), F.col("item_id"))).orderBy("hop", "item_id")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.select("*", (F.row_number().over(own) - 1).alias("place"), F.count("*").over(whole).alias("size"), F.first("hop").over(whole).alias("first_hop"), F.lead("hop").over(own).alias("next_hop"))


def track_summary(items: DataFrame, preds: DataFrame) -> DataFrame:
    """(model_id, accuracy, n, n_chains, multihop_chain_accuracy, error_propagation_rate, mean_first_error_hop), as ``accuracy`` overall and
    ``chain_summary`` give them, from one join of answers and items.

    An answer's row knows its place in the chain and the hop that follows. Of a model and chain, the right places from 0 on without a gap
    lead to the first error; chains that a model leaves out altogether are all chains less those it answers, so that no row is made for
    them. Accuracy is null for a model that answers no known item."""
    numbered = _numbered(items)
    known = numbered.select("item_id", "answer_idx", "chain_id", "place", "size", "first_hop", "next_hop", F.lit(True).alias("known"))
    last = last_predictions(preds).withColumnRenamed("answer_idx", "pred_idx")
    rows = last.join(known, "item_id", "left").withColumn("ok", correct(F.col("pred_idx"), F.col("answer_idx")))
    right = F.when(F.col("chain_id").isNotNull() & (F.col("ok") == 1), F.struct("place", "next_hop"))
    per = rows.groupBy("model_id", "chain_id").agg(F.count("known").alias("n"), F.sum(F.when(F.col("known"), F.col("ok"))).alias("n_ok"), F.array_sort(F.collect_list(right)).alias("right"), F.first("size").alias("size"), F.first(F.when(F.col("chain_id").isNotNull(), F.col("first_hop"))).alias("first_hop"))
    run = F.filter("right", lambda x, i: x["place"] == i)
    per = per.withColumn("run", F.size(run)).withColumn("after", F.get(run, F.size(run) - 1)["next_hop"])
    error = F.when(F.col("chain_id").isNull() | (F.col("run") == F.col("size")), None).when(F.col("run") == 0, F.col("first_hop")).otherwise(F.col("after"))
    per = per.withColumn("error", error)
    models = per.groupBy("model_id").agg(
        F.sum("n").alias("n"),
        F.sum("n_ok").alias("n_ok"),
        F.count("chain_id").alias("seen"),
        F.count("error").alias("failed"),
        F.count_if(F.col("error") > 0).alias("late"),
        F.coalesce(F.sum("error"), F.lit(0)).alias("hops"),
        F.coalesce(F.sum("first_hop"), F.lit(0)).alias("seen_hops"),
        F.count_if(F.col("first_hop") > 0).alias("seen_late"),
    )
    firsts = numbered.where("chain_id is not null and place = 0")
    every = F.broadcast(firsts.agg(F.count("*").alias("n_chains"), F.coalesce(F.sum("hop"), F.lit(0)).alias("all_hops"), F.count_if(F.col("hop") > 0).alias("all_late")))  # one row
    out = models.crossJoin(every)
    failed = F.col("failed") + F.col("n_chains") - F.col("seen")
    late = F.col("late") + F.col("all_late") - F.col("seen_late")
    hops = F.col("hops") + F.col("all_hops") - F.col("seen_hops")
    return out.select(
        "model_id",
        F.try_divide(F.col("n_ok"), F.col("n")).alias("accuracy"),
        "n",
        "n_chains",
        F.try_divide(F.col("n_chains") - failed, F.col("n_chains")).alias("multihop_chain_accuracy"),
        F.coalesce(F.try_divide(late, failed), F.lit(0.0)).alias("error_propagation_rate"),
        F.coalesce(F.try_divide(hops, failed), F.lit(0.0)).alias("mean_first_error_hop"),
    )


def prior_leaks(items: DataFrame, threshold: float = 0.6) -> DataFrame:
    return items.agg(F.count_if(F.col("language_prior_score") >= threshold).alias("n_leaky"), F.count("*").alias("n_items"))


def understanding(items: DataFrame, preds: DataFrame) -> DataFrame:
    """(model_id, metric, value) of the question-answering track."""
    wide = track_summary(items, preds).where("n > 0").fillna(0.0)
    return wide.select("model_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("U.accuracy", "U.multihop_chain_accuracy"))), F.array("accuracy", "multihop_chain_accuracy"))).alias("metric", "value"))


def counterfactual_rows(items: DataFrame, preds: DataFrame, threshold: float = 0.5, judge=entailment) -> DataFrame:
    """Every prediction of a known item (repeats stay) with entailed, direction and magnitude. ``judge`` may be a model's
    pandas UDF of (prediction, outcome)."""
    both = preds.join(items, "item_id")
    return both.select("*", (judge(F.col("prediction"), F.col("counterfactual_outcome")) >= threshold).cast("int").alias("entailed"), direction_match(F.col("prediction"), F.col("direction_keyword")).cast("int").alias("direction"), magnitude_match(F.col("prediction"), F.col("magnitude_bin")).cast("int").alias("magnitude"))


def counterfactual(rows: DataFrame, keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """Means of all rows, by domain and by physics category, in one pass."""
    keys = list(keys)
    out = rows.groupingSets([keys, [*keys, "domain"], [*keys, "physics_category"]], *keys, "domain", "physics_category").agg(
        F.grouping("domain").alias("_d"),
        F.grouping("physics_category").alias("_p"),
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("entailed", "direction", "magnitude")),
        F.count("*").alias("n"),
    )
    scope = F.when((F.col("_d") == 1) & (F.col("_p") == 1), "overall").when(F.col("_p") == 1, "domain").otherwise("physics")
    return out.select(*keys, scope.alias("scope"), F.coalesce("domain", "physics_category").alias("scope_value"), "entailed", "direction", "magnitude", "n")


def item_quality(*metrics: str) -> Column:
    """Mean of a clip's quality metrics."""
    return sum((F.col(m) for m in metrics[1:]), F.col(metrics[0])) / len(metrics)


def generation(rows: DataFrame, quality_weight: float = 0.3, domain_weight: float = 0.7) -> DataFrame:
    """Summary of (model_id, domain, physics_category, quality, verdict): means over all rows, by domain and by physics;
    a null verdict is unscored and never 0. Without any verdict the overall mean is 0, a scope's is null."""
    out = rows.groupingSets([["model_id"], ["model_id", "domain"], ["model_id", "physics_category"]], "model_id", "domain", "physics_category").agg(
        F.grouping("domain").alias("_d"), F.grouping("physics_category").alias("_p"), F.avg("quality").alias("quality_score"), F.avg("verdict").alias("domain_score"), F.count_if(F.col("verdict").isNull()).alias("intractable_items"), F.count("*").alias("n")
    )
    total = (F.col("_d") == 1) & (F.col("_p") == 1)
    scope = F.when(total, "overall").when(F.col("_p") == 1, "domain").otherwise("physics")
    zero = lambda c: F.when(total, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c))
    out = out.select("model_id", scope.alias("scope"), F.coalesce("domain", "physics_category").alias("scope_value"), zero("quality_score").alias("quality_score"), zero("domain_score").alias("domain_score"), "intractable_items", "n")
    return out.withColumn("overall", F.when(F.col("scope") == "overall", quality_weight * F.col("quality_score") + domain_weight * F.col("domain_score")))


def robustness(levels: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Area under fidelity over degradation levels by trapezoids, divided by the span, clipped to 0..1; one level gives
    its fidelity. ``levels``: keys, level, fidelity."""
    w = W.partitionBy(*keys).orderBy("level")
    step = levels.withColumn("_f", F.lead("fidelity").over(w)).withColumn("_l", F.lead("level").over(w))
    out = step.groupBy(*keys).agg(F.sum((F.col("fidelity") + F.col("_f")) / 2 * (F.col("_l") - F.col("level"))).alias("_a"), (F.max("level") - F.min("level")).alias("_s"), F.max_by("fidelity", "level").alias("_one"), F.count("*").alias("n_levels"))
    value = F.when(F.col("_s") > 0, F.col("_a") / F.col("_s")).otherwise(F.col("_one"))
    return out.select(*keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("robustness"), "n_levels")


CONDITIONAL = ("blur_ssim", "edge_f1", "depth_si_rmse", "mask_miou", "visual", "diversity", "robustness")


def conditional_items(metrics: DataFrame, robust: DataFrame, diversity: DataFrame) -> DataFrame:
    """Seven metrics of items that have level 0 and a reference; diversity is 0 with under two variants."""
    rows = metrics.where(F.col("has_level_0") & F.col("has_reference")).join(robust, ["model_id", "item_id"], "left").join(diversity, ["model_id", "item_id"], "left")
    return rows.withColumn("visual", 0.5 * F.col("blur_ssim") + 0.5 * F.col("edge_f1")).fillna(0.0, ["diversity", "robustness"])


def conditional(rows: DataFrame) -> DataFrame:
    """Means of the seven metrics, of all items and by domain."""
    out = rows.groupingSets([["model_id"], ["model_id", "domain"]], "model_id", "domain").agg(F.grouping("domain").alias("_d"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in CONDITIONAL), F.count("*").alias("n"))
    return out.select("model_id", F.when(F.col("_d") == 1, "overall").otherwise("domain").alias("scope"), F.col("domain").alias("scope_value"), *CONDITIONAL, "n")


def human_baseline(items: DataFrame, answers: DataFrame) -> DataFrame:
    """(domain, accuracy, n) of human answers, null domain for all; unmatched ids are ignored. ``answers``: item_id,
    human_answer_idx."""
    rows = answers.join(items, "item_id").withColumn("ok", correct(F.col("human_answer_idx"), F.col("answer_idx")))
    return rows.groupingSets([[], ["domain"]], "domain").agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))
