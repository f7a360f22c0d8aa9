"""Benchmark items and predictions as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.schemas import ANSWER, DOMAINS, ITEMS, PHYSICS, PREDICTION


def read_items(spark: SparkSession, data_dir: str, track: str, fmt: str = "json") -> DataFrame:
    """Items of one track, a file an item under ``<data_dir>/items/<track>``, or Parquet."""
    if track not in ITEMS:
        raise ValueError(f"unknown track: {track}")
    reader = spark.read.schema(ITEMS[track])
    path = f"{data_dir}/items/{track}"
    if fmt == "parquet":
        return reader.parquet(path)
    rows = reader.option("multiLine", True).json(path)
    if track == "U":
        rows = rows.fillna({"difficulty": 0.0, "discrimination": 1.0}).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows


def item_union(**tracks: DataFrame) -> DataFrame:
    """(item_id, track, domain, physics_category) of all tracks' items."""
    out = None
    for track, df in tracks.items():
        part = df.select("item_id", F.lit(track).alias("track"), *(c for c in ("domain", "physics_category") if c in df.columns))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def item_faults(track: str) -> Column:
    """Array of the rules that an item breaks."""
    rules: dict[str, Column] = {"item_id": F.col("item_id").isNull(), "domain": ~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False))}
    if track != "C":
        rules["physics_category"] = ~F.coalesce(F.col("physics_category").isin(*PHYSICS), F.lit(False))
    if track == "U":
        between = lambda c, lo, hi: ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))
        rules |= {
            "choices": ~F.coalesce(F.size("choices") == 4, F.lit(False)),
            "answer_idx": between("answer_idx", 0, 3),
            "language_prior_score": between("language_prior_score", 0.0, 1.0),
            "annotator_agreement": between("annotator_agreement", -1.0, 1.0),
            "question": F.col("question").isNull(),
            "requires_temporal": F.col("requires_temporal").isNull(),
        }
    required = {"CF": ("base_description", "counterfactual_variable", "counterfactual_change", "base_outcome", "counterfactual_outcome"), "G": ("prompt",), "C": ("prompt", "control_signals"), "U": ("video_path",)}
    rules |= {c: F.col(c).isNull() for c in required[track]}
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def validate_items(items: DataFrame, track: str, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``faults``); with mode "fail", reading a rejected item raises."""
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode: {mode}")
    marked = items.withColumn("faults", item_faults(track))
    if mode == "fail":
        marked = marked.withColumn("faults", F.when(F.size("faults") > 0, F.raise_error(F.concat(F.lit("invalid item "), F.coalesce("item_id", F.lit("?")), F.lit(": "), F.array_join("faults", ","))).cast("array<string>")).otherwise(F.col("faults")))
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def parse_prediction(prediction: Column) -> Column:
    """Struct of a prediction that is a JSON object; anything else is its ``text``."""
    isobject = F.trim(prediction).startswith("{")
    parsed = F.when(isobject, F.from_json(prediction, ANSWER))
    return F.struct(*(F.when(isobject, parsed[f.name]).otherwise(prediction if f.name == "text" else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANSWER))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a JSON array file, with the answer flattened and ``seq`` in file order."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).json(path)
    return rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("answer", parse_prediction(F.col("prediction"))).select("*", "answer.*").drop("answer", "prediction")
