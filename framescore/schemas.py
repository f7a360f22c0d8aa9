"""Schemas, enumerations and default weights of the evaluation tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
DOMAINS = ("autonomous_vehicles", "robotics", "industrial", "construction", "agriculture", "laboratory", "sports_biomechanics", "everyday_physics")
PHYSICS = ("rigid_body", "fluid", "deformable", "contact", "thermal", "electromagnetic")
TRACKS = ("G", "C", "U", "CF", "DV")

#: Weight of each track metric in the index; the C weight is shared by its four metrics.
INDEX_WEIGHTS = {
    "G.domain_score": 0.20,
    "C.blur_ssim": 0.15 / 4,
    "C.edge_f1": 0.15 / 4,
    "C.depth_si_rmse": 0.15 / 4,
    "C.mask_miou": 0.15 / 4,
    "U.accuracy": 0.30,
    "U.multihop_chain_accuracy": 0.20,
    "CF.counterfactual_delta_accuracy": 0.15,
}

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TEXTS, _NUMBERS = T.ArrayType(_S), T.MapType(_S, _D)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


QA_ITEM = _struct(
    item_id=_S, video_path=_S, domain=_S, physics_category=_S, question=_S, choices=_TEXTS, answer_idx=_I, requires_temporal=_B, language_prior_score=_D,
    annotator_agreement=_D, difficulty=_D, discrimination=_D, tags=_TEXTS, chain_id=_S, hop_index=_I,
)
CF_ITEM = _struct(
    item_id=_S, base_video_path=_S, base_description=_S, counterfactual_variable=_S, counterfactual_change=_S, base_outcome=_S, counterfactual_outcome=_S,
    domain=_S, physics_category=_S, direction_keyword=_S, magnitude_bin=_S,
)
G_ITEM = _struct(
    item_id=_S, prompt=_S, reference_video_path=_S, domain=_S, physics_category=_S, qa_pairs=T.ArrayType(QA_ITEM),
    expected_physics=_struct(gravity_direction=T.ArrayType(_D), expected_collisions=_I),
)
C_ITEM = _struct(item_id=_S, prompt=_S, control_signals=T.MapType(_S, _S), reference_video_path=_S, domain=_S, variant_prompts=_TEXTS)
ITEMS = {"U": QA_ITEM, "CF": CF_ITEM, "G": G_ITEM, "C": C_ITEM}

ANSWER = _struct(answer_idx=_I, text=_S, video_path=_S, video_paths_by_level=T.MapType(_S, _S), variant_video_paths=_TEXTS)
PREDICTION = _struct(model_id=_S, item_id=_S, track=_S, prediction=_S, confidence=_D, latency_ms=_D)
TRACK_SCORE = _struct(track=_S, model_id=_S, n_items=_I, scores=_NUMBERS, per_domain=T.MapType(_S, _NUMBERS), per_physics_category=T.MapType(_S, _NUMBERS))
