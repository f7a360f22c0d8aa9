"""The registered queries: each applies operators to a view of the given tables. Doubles are rounded to six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framescore.functions import text as T
from framescore.functions.frames import aligned, sample_frames
from framescore.operators import annotation as an
from framescore.operators import calls, irt, judges, leaderboard, qc, sampling, tracks
from framescore.operators.predict import requests, run_model, constant_model
from framescore.operators.video import clips, control, frames, pairs, physics, quality
from framescore.plans.views import view
from framescore.schemas import QA_ITEM
from framescore.sources.folders import shared_folder
from framescore.sources.items import parse_prediction, read_items, validate_items
from framescore.sources.results import long_scores, markdown_report, pending, wire_scores
from framescore.streaming.review import replay

QUERIES: dict = {}
TRACK_METRICS = ("G.domain_score", "C.blur_ssim", "U.accuracy", "U.multihop_chain_accuracy", "CF.counterfactual_delta_accuracy")
DV_TASKS = ("BUILDING", "MACHINERY", "FURNITURE")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema))


def query(f):
    """Registers a function of (v, spark, sf_dir), where v(name) is a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(lambda name: view(spark, sf_dir, name), spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


# --- understanding -------------------------------------------------------------------------------


@query
def j1_join_answers(v, spark, sf_dir):
    rows = tracks.join_answers(v("v_u_items"), v("v_u_preds")).withColumn("ok", tracks.correct(F.col("pred_idx"), F.col("answer_idx")))
    return rows.groupBy("model_id", "physics_category").agg(F.count("*").alias("n_rows"), F.count_if("answered").alias("n_answered"), F.sum("ok").alias("n_ok"))


@query
def a2_accuracy(v, spark, sf_dir):
    return tracks.accuracy(v("v_u_items"), v("v_u_preds"))


@query
def a3_chains(v, spark, sf_dir):
    return tracks.chains(v("v_u_items"), v("v_u_preds"))


@query
def a4_chain_summary(v, spark, sf_dir):
    return tracks.track_summary(v("v_u_items"), v("v_u_preds")).where("n_chains > 0").drop("accuracy", "n")


@query
def a5_prior_leaks(v, spark, sf_dir):
    return tracks.prior_leaks(v("v_u_items"))


@query
def q6_audit_counts(v, spark, sf_dir):
    return qc.audit_counts(v("v_u_items"))


@query
def a14_human_baseline(v, spark, sf_dir):
    answers = v("v_u_preds").where("model_id = 0").groupBy("item_id").agg(F.max_by("answer_idx", "seq").alias("human_answer_idx"))
    return tracks.human_baseline(v("v_u_items"), answers)


@query
def s8_pending(v, spark, sf_dir):
    work = v("v_u_preds").select("model_id", (F.col("item_id") % 7).alias("track")).distinct()
    return pending(work, work.where("(model_id + track) % 2 = 0"))


# --- counterfactual ------------------------------------------------------------------------------


def _cf(v):
    rows = v("v_cf")
    return rows.select(
        "*",
        T.entailment(F.col("prediction"), F.col("counterfactual_outcome")).alias("overlap"),
        T.direction_match(F.col("prediction"), F.col("direction_keyword")).cast("int").alias("direction"),
        T.magnitude_match(F.col("prediction"), F.col("magnitude_bin")).cast("int").alias("magnitude"),
    ).withColumn("entailed", (F.col("overlap") >= 0.5).cast("int"))


@query
def a6_a8_text_matches(v, spark, sf_dir):
    return _cf(v).select("item_id", "overlap", "direction", "magnitude")


@query
def a9_counterfactual(v, spark, sf_dir):
    return tracks.counterfactual(_cf(v).withColumn("model_id", F.col("item_id") % 3))


@query
def j2_repeats_stay(v, spark, sf_dir):
    items = v("v_u_items").select("item_id", "domain")
    return v("v_u_preds").join(items, "item_id").groupBy("model_id", "domain").agg(F.count("*").alias("n"))


@query
def p1_requests(v, spark, sf_dir):
    items = v("v_cf").select("item_id", F.lit("p").alias("base_video_path"), F.col("domain").alias("base_description"), F.col("direction_keyword").alias("counterfactual_variable"), F.col("magnitude_bin").alias("counterfactual_change"))
    return requests(items, "CF").select("item_id", "request.scenario", "request.question")


@query
def p2_run_model(v, spark, sf_dir):
    items = v("v_cf").select("item_id", F.lit("p").alias("base_video_path"), F.col("domain").alias("base_description"), F.col("direction_keyword").alias("counterfactual_variable"), F.col("magnitude_bin").alias("counterfactual_change"))
    return run_model(requests(items, "CF"), "CF", constant_model).select("model_id", F.col("item_id").cast("long").alias("item_id"), "track", "answer_idx", "text")


@query
def p1_generation(v, spark, sf_dir):
    return requests(v("v_prompts"), "G").select("item_id", "request.prompt")


@query
def p1_conditional(v, spark, sf_dir):
    items = v("v_prompts").select("item_id", "prompt", F.create_map(F.lit("depth"), "source").alias("control_signals"), F.array("lang", "source").alias("variant_prompts"))
    return requests(items, "C").select("item_id", "request.prompt", F.col("request.control_signals")["depth"].alias("depth"), F.array_join("request.variant_prompts", "|").alias("variants"))


@query
def p1_understanding(v, spark, sf_dir):
    items = v("v_prompts").select("item_id", F.col("source").alias("video_path"), F.col("prompt").alias("question"), F.array(F.lit("a"), "lang", F.lit("c"), F.lit("d")).alias("choices"))
    return requests(items, "U").select("item_id", "request.video_path", "request.question", F.array_join("request.choices", "|").alias("choices"))


# --- items ---------------------------------------------------------------------------------------


def _judged(items):
    """Valid and rejected items with what is wrong with them."""
    valid, rejected = validate_items(items, "U")
    return valid.withColumn("faults", F.lit("")).unionByName(rejected.withColumn("faults", F.array_join("faults", ",")))


@query
def s1_s2_read_and_validate(v, spark, sf_dir):
    """Items written as a track's folder, read back by its schema, and validated."""
    folder = shared_folder(spark, "items")
    choices = F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= F.col("n_choices")), lambda i: i.cast("string"))
    made = v("v_drawn_items").select("*", choices.alias("choices"), F.array().cast("array<string>").alias("tags"), F.lit(0.0).alias("difficulty"), F.lit(1.0).alias("discrimination"), F.lit(None).alias("chain_id"), F.lit(None).alias("hop_index"))
    made.select(*(F.col(f.name).cast(f.dataType) for f in QA_ITEM)).write.parquet(f"{folder}/items/U")
    return _judged(read_items(spark, folder, "U", fmt="parquet")).select("item_id", "domain", "answer_idx", "language_prior_score", "annotator_agreement", "faults")


@query
def p5_drafted_items(v, spark, sf_dir):
    """Items drafted from replies; invalid ones are told apart."""
    drafts = v("v_drafts").select("event_id", T.draft_item(F.col("reply"), F.lit("clip"), F.col("domain"), F.lit("fluid")).alias("x")).where("x is not null")
    return _judged(drafts.select("event_id", "x.*")).select("event_id", "item_id", "answer_idx", F.array_join("choices", "|").alias("choices"), "faults")


# --- judges --------------------------------------------------------------------------------------


def _verdicts(v):
    return v("v_verdicts").withColumn("violations", F.array("violation"))


def _ensemble(v, aggregation):
    return judges.ensemble(_verdicts(v), aggregation)


@query
def jg1_median(v, spark, sf_dir):
    return _ensemble(v, "median").select("item_id", "score", "n_judges", "std", "range", "flagged", "uncertainty", F.array_join("violations", ",").alias("violations"))


@query
def jg1_mean(v, spark, sf_dir):
    return _ensemble(v, "mean").select("item_id", "score")


@query
def jg1_majority(v, spark, sf_dir):
    return _ensemble(v, "majority").select("item_id", "score")


@query
def jg3_breakdown(v, spark, sf_dir):
    return _ensemble(v, "median").select("item_id", F.size("breakdown").alias("n_all"), F.size("violations").alias("n_violations"))


def _routes(v, style):
    analytic = v("v_verdicts").groupBy("item_id", "physics_category").agg(F.max(F.when(F.col("judge") == 1, F.col("score"))).alias("score"))
    analytic = analytic.select("item_id", "score", F.when(F.col("physics_category") >= 3, "intractable").otherwise("analytic").alias("verifier_type"), F.lit(None).cast("string").alias("uncertainty"), F.array().cast("array<string>").alias("violations"))
    fallback = judges.ensemble(_verdicts(v).where("judge > 1")).select("item_id", "score", "uncertainty", F.lit("ensemble").alias("judge_type"), "violations")
    return judges.route(analytic, fallback, label_style=style).select("item_id", "score", "judge_type", "uncertainty", F.array_join("violations", ",").alias("violations"))


@query
def jg4_hybrid(v, spark, sf_dir):
    return _routes(v, "hybrid")


@query
def jg5_domain(v, spark, sf_dir):
    return _routes(v, "domain")


@query
def a11_generation(v, spark, sf_dir):
    rows = v("v_verdicts").select((F.col("judge") % 3).alias("model_id"), "domain", "physics_category", tracks.item_quality("judge", "judge").alias("quality"), F.col("score").alias("verdict"))
    return tracks.generation(rows.withColumn("quality", F.col("quality") / 10))


@query
def p4_judge_score(v, spark, sf_dir):
    return v("v_replies").select("event_id", T.judge_score(F.col("reply")).alias("score"))


@query
def p5_draft(v, spark, sf_dir):
    return v("v_replies").select("event_id", T.draft_json(F.col("reply")).alias("draft"))


@query
def s3_parse_prediction(v, spark, sf_dir):
    p = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{{"answer_idx": '.replace("{{", "{")), (F.col("event_id") % 4).cast("string"), F.lit("}"))).otherwise(F.col("reply"))
    return v("v_replies").select("event_id", parse_prediction(p).alias("x")).select("event_id", "x.answer_idx", "x.text")


# --- control -------------------------------------------------------------------------------------


@query
def a15_robustness(v, spark, sf_dir):
    return tracks.robustness(v("v_robust"))


@query
def a13_conditional(v, spark, sf_dir):
    robust = tracks.robustness(v("v_robust")).select((F.col("item_id") % 3).alias("model_id"), "item_id", "robustness")
    levels = v("v_robust").groupBy("item_id").agg(F.max(F.when(F.col("level") == 1, F.col("fidelity"))).alias("blur_ssim"), F.min("fidelity").alias("edge_f1"), F.max("fidelity").alias("depth_si_rmse"), F.count("*").alias("n"))
    metrics = levels.select((F.col("item_id") % 3).alias("model_id"), "item_id", (F.col("item_id") % 8).alias("domain"), F.coalesce("blur_ssim", F.lit(0.0)).alias("blur_ssim"), "edge_f1", "depth_si_rmse", F.lit(0.5).alias("mask_miou"), (F.col("n") > 1).alias("has_level_0"), F.lit(True).alias("has_reference"))
    diversity = robust.where("item_id % 2 = 0").select("model_id", "item_id", F.lit(0.25).alias("diversity"))
    return tracks.conditional(tracks.conditional_items(metrics, robust, diversity))


# --- annotation ----------------------------------------------------------------------------------


@query
def an1_review_queue(v, spark, sf_dir):
    tasks, late = an.review_queue(v("v_queue"))
    out = tasks.join(late.groupBy("task_id").agg(F.count("*").alias("n_late")), "task_id", "left")
    return out.select("task_id", F.array_join("votes", ",").alias("votes"), "n", "done", F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query
def an2_review_stream(v, spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    queue = events.select(F.col("user_id").cast("long").alias("task_id"), F.col("ts").alias("arrival"), F.col("event_type").alias("annotator_id"), (F.col("event_id") % 4).cast("int").alias("answer_idx"))
    sent = replay(queue)
    done = sent.where("not late").select("task_id", F.array_join("votes", ",").alias("votes"), "n")
    late = sent.where("late").groupBy("task_id").agg(F.count("*").alias("n_late"))
    return done.join(late, "task_id", "left").fillna(0, ["n_late"])


@query
def an3_prior_audit(v, spark, sf_dir):
    return an.prior_audit(v("v_trials"))


@query
def an3_prior_rejections(v, spark, sf_dir):
    return an.prior_rejections(an.prior_audit(v("v_trials"), threshold=0.25))


def _reader():
    """A client that reads the question's length; it fails for every seventh item."""

    def answer(request: dict) -> str:
        if request["item_id"] % 7 == 0:
            raise RuntimeError("no answer")
        return f"Answer {(len(request['question']) + request['trial']) % 4}."

    return answer


@query
def an3_asked_prior(v, spark, sf_dir):
    """Trials asked through a ledger, failed calls and all, then audited."""
    items = v("v_prompts").select("item_id", F.col("lang").alias("domain"), (F.col("item_id") % 4).alias("answer_idx"), F.col("prompt").alias("question"), F.array("lang", "source").alias("choices"))
    return an.prior_audit(calls.prior_trials(items, _reader, shared_folder(spark, "ledger"), n_trials=3))


def _rater(k: int):
    """A judge that rates the prompt's length; the third fails for every seventh item."""

    def make():
        def rate(request: dict) -> str:
            if k == 2 and request["item_id"] % 7 == 0:
                raise RuntimeError("quota")
            return f"Score: 0.{(len(request['prompt']) * (k + 1)) % 10} of 1"

        return rate

    return make


@query
def jg1_asked_judges(v, spark, sf_dir):
    """Three judges asked through a ledger; a failed one is dropped, not counted as 0."""
    requests = v("v_prompts").select("item_id", F.struct("item_id", "prompt").alias("request"))
    panel = calls.judged(requests, {f"j{k}": _rater(k) for k in range(3)}, shared_folder(spark, "ledger"))
    return judges.ensemble(panel, "mean").select("item_id", "score", "n_judges", "flagged", "uncertainty")


@query
def an4_agreement(v, spark, sf_dir):
    return an.agreement(v("v_annotations"))


@query
def an5_kappa(v, spark, sf_dir):
    return an.cohen_kappa(v("v_kappa"))


@query
def an6_panel_kappa(v, spark, sf_dir):
    return an.panel_kappa(v("v_annotations"))


@query
def an7_irt(v, spark, sf_dir):
    items, _ = irt.fit_2pl(v("v_responses"))
    return rounded(items, 3)


def _steady_mean(name: str):
    """The mean of a column of doubles, the same in whatever order and parts its rows are added: they are added as decimals. Where one is no
    such decimal (NaN, infinite, 1e10 or more), the plain mean."""
    exact = F.col(name).try_cast("decimal(28,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(name), F.try_divide(F.try_sum(exact).cast("double"), F.count(name))), F.avg(name))


@query
def an8_irt_flags(v, spark, sf_dir):
    """Flags lie on bounds that means reach exactly (11/12 is b = -2.5), so a mean must not hang on the order of its rows."""
    params = v("v_item_scores").groupBy("item_id").agg(_steady_mean("score").alias("a")).withColumn("b", 6 * (0.5 - F.col("a")))
    return an.irt_flags(params)


@query
def an9_cascade(v, spark, sf_dir):
    tasks, _ = an.review_queue(v("v_queue"))
    items = v("v_queue").select(F.col("task_id").alias("item_id")).distinct()
    votes = v("v_queue").select(F.col("task_id").alias("item_id"), F.col("answer_idx").alias("vote"), F.row_number().over(W.partitionBy("task_id").orderBy("arrival", "annotator_id", "answer_idx")).alias("arrival")).where("arrival <= 3")
    _, report = an.cascade(items, tasks, an.prior_audit(v("v_trials"), threshold=0.3), an.agreement(votes, threshold=0.6))
    return report


# --- sampling and QC -----------------------------------------------------------------------------


@query
def q1_stratified_sample(v, spark, sf_dir):
    pool = v("v_pool").withColumn("domain", F.substring("domain", 1, 3))
    config = {d: (5, 0.2) for d in ("STA", "PRO", "MED")} | {"LAR": (2, 0.5)}
    return sampling.stratified_sample(pool, config, 100).select("item_id", "domain")


@query
def q2_audit_sample(v, spark, sf_dir):
    return sampling.audit_sample(v("v_pool")).select("item_id", "domain", "physics_category")


@query
def q3_saturated(v, spark, sf_dir):
    return qc.saturated(v("v_item_scores"), threshold=0.9)


@query
def q4_saturation_report(v, spark, sf_dir):
    items = v("v_u_items").select("item_id", "domain", "physics_category")
    return qc.saturation_report(qc.saturated(v("v_item_scores"), threshold=0.8), items)


@query
def q5_drift(v, spark, sf_dir):
    return qc.drift(v("v_history"))


@query
def q5_quarterly(v, spark, sf_dir):
    return qc.quarterly(v("v_history"))


# --- leaderboard ---------------------------------------------------------------------------------


@query
def l1_index(v, spark, sf_dir):
    return leaderboard.index(v("v_track_scores"))


@query
def l2_ranking(v, spark, sf_dir):
    return leaderboard.ranking(v("v_track_scores"), TRACK_METRICS)


@query
def l3_spearman(v, spark, sf_dir):
    success = v("v_dv").groupBy("model_id").agg(F.avg("rate").alias("rate"))
    return leaderboard.spearman_validity(v("v_track_scores"), success)


@query
def l4_validity(v, spark, sf_dir):
    return leaderboard.predictive_validity(v("v_track_scores"), v("v_dv"), DV_TASKS, TRACK_METRICS)


@query
def l5_markdown(v, spark, sf_dir):
    return leaderboard.leaderboard_markdown(v("v_track_scores"), TRACK_METRICS)


def _wire(v):
    long = v("v_track_scores").select("model_id", F.split_part("metric", F.lit("."), F.lit(1)).alias("track"), F.lit("overall").alias("scope"), F.lit("").alias("scope_value"), "metric", "value")
    parts = long.select("model_id", "track", F.lit("domain").alias("scope"), (F.col("model_id") % 3).cast("string").alias("scope_value"), "metric", (F.col("value") / 2).alias("value"))
    return long.unionByName(parts), long.groupBy("model_id", "track").agg(F.count("*").cast("int").alias("n_items"))


@query
def s5_s6_score_forms(v, spark, sf_dir):
    return long_scores(wire_scores(*_wire(v)))


@query
def s7_report(v, spark, sf_dir):
    return markdown_report(wire_scores(*_wire(v)))


# --- video ---------------------------------------------------------------------------------------


@query
def v11_curvature(v, spark, sf_dir):
    out = physics.curvature(v("v_traj"))
    return out.select("video_id", "n", F.round("a", 4).alias("a"), physics.gravity_aligned(F.col("a"), F.lit(1.0)).alias("aligned"))


@query
def v12_v14_motion_checks(v, spark, sf_dir):
    return physics.motion_checks(v("v_traj"))


@query
def v15_reflection(v, spark, sf_dir):
    return physics.reflection(v("v_traj")).select("video_id", "reflection_ok", F.round("cos", 4).alias("cos"))


def _frames(v):
    gray = F.transform("feature", lambda x: (x.cast("double") + 1) / 2)
    return v("v_features").select("video_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), gray.alias("gray"))


@query
def p7_gray(v, spark, sf_dir):
    """Binary RGB pixels to gray values and channel means."""
    byte = lambda i: F.lpad(F.hex(F.floor((F.element_at("feature", i + 1).cast("double") + 1) / 2 * 255).cast("long")), 2, "0")
    pixel = lambda i: F.concat(byte(i), byte(63 - i), byte((i + 7) % 64))
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), "")
    rows = v("v_features").select("video_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexes).alias("pixels"))
    got = frames.prepare(rows)
    mean = F.avg(F.aggregate("gray", F.lit(0.0), lambda a, x: a + x) / 64)
    return rounded(got.groupBy("video_id").agg(mean.alias("gray"), *(F.avg(F.get("color", F.lit(k))).alias(c) for k, c in enumerate(("red", "green", "blue")))), 3)


@query
def v1_consistency(v, spark, sf_dir):
    return rounded(quality.consistency(v("v_features")), 5)


@query
def v2_v4_quality(v, spark, sf_dir):
    return rounded(quality.quality(frames.measures(_frames(v))).select("video_id", "motion_smoothness", "aesthetic_quality"), 5)


@query
def v4_imaging(v, spark, sf_dir):
    return quality.quality(frames.measures(_frames(v))).select("video_id", "imaging_quality")


@query
def v5_prompt_consistency(v, spark, sf_dir):
    prompts = v("v_features").where("frame_idx = 3 and video_id % 3 <> 0").select("video_id", F.col("feature").alias("vector"))
    return rounded(quality.prompt_consistency(v("v_features"), prompts), 5)


@query
def v6_flow_smoothness(v, spark, sf_dir):
    flow = v("v_features").select("video_id", "frame_idx", F.col("feature").alias("u"), F.reverse("feature").alias("v"))
    return rounded(quality.flow_smoothness(flow), 5)


@query
def v7_depth_stability(v, spark, sf_dir):
    return quality.depth_stability(frames.measures(_frames(v)))


@query
def v8_blob_stability(v, spark, sf_dir):
    return quality.blob_stability(frames.measures(_frames(v), min_area=2))


@query
def v9_pose_validity(v, spark, sf_dir):
    points = v("v_features").select("video_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("landmark"), "feature")
    points = points.select("video_id", "frame_idx", "landmark", F.element_at("feature", 2 * F.col("landmark") + 1).cast("double").alias("x"), F.element_at("feature", 2 * F.col("landmark") + 2).cast("double").alias("y"))
    return rounded(quality.pose_validity(points), 5)


@query
def v10_centroids(v, spark, sf_dir):
    return physics.centroids(frames.measures(_frames(v)))


@query
def v16_fluid_mass(v, spark, sf_dir):
    return physics.fluid_mass(_frames(v))


@query
def v17_vorticity(v, spark, sf_dir):
    flow = v("v_features").select("video_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("feature", lambda x: 10 * x.cast("double")).alias("u"), F.reverse(F.transform("feature", lambda x: x.cast("double"))).alias("v"))
    return physics.vorticity(flow)


@query
def v18_surface_jitter(v, spark, sf_dir):
    edges = v("v_features").select("video_id", "frame_idx", F.transform("feature", lambda x: F.when(x > 0.1, 255.0).otherwise(0.0)).alias("edges"))
    return rounded(physics.surface_jitter(edges), 5)


@query
def v20_verdicts(v, spark, sf_dir):
    traj = v("v_traj")
    clips = physics.curvature(traj).withColumnRenamed("n", "n_centroids").join(physics.motion_checks(traj), "video_id").join(physics.reflection(traj), "video_id")
    kind = F.element_at(F.array(*map(F.lit, ("rigid_body", "contact", "fluid", "thermal"))), (F.col("video_id") % 4 + 1).cast("int"))
    extra = F.create_map(F.lit("flow_smoothness"), (F.col("video_id") % 10) / 10.0, F.lit("pose_validity"), F.when(F.col("video_id") % 2 == 0, (F.col("video_id") % 7) / 7.0))
    clips = clips.select("*", kind.alias("physics_category"), F.lit(1.0).alias("gravity_y"), F.lit(None).cast("long").alias("expected_collisions"), (F.col("video_id") % 3 > 0).alias("mass_ok"), F.lit(0.6).alias("mass_drift"), F.lit(True).alias("curl_ok"), F.lit(0.0).alias("curl_p99"), F.lit(True).alias("surface_ok"), F.lit(0.0).alias("jitter"), extra.alias("supplementary"))
    return physics.verdicts(clips).select("video_id", "score", "passed", F.size("violations").alias("n_violations"), F.size("checks").alias("n_checks"), "verifier_type")


def _rgb(v):
    """The frames of v_frames as 8-bit RGB, with edge maps."""
    byte = lambda i: F.lpad(F.hex(F.floor((F.element_at("feature", i + 1).cast("double") + 1) / 2 * 255).cast("long")), 2, "0")
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(byte(i), byte(63 - i), byte((i + 7) % 64))), "")
    edges = F.array_join(F.transform("feature", lambda e: F.when(e > 0.1, "ff").otherwise("00")), "")
    return v("v_frames").select("video_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexes).alias("pixels"), F.unhex(edges).alias("edges"))


@query
def a12_clip_conditional(v, spark, sf_dir):
    """Frames to the seven metrics of conditional items: the clips of an item are its levels and variants, the clip before its first is its reference;
    clips are cut to different lengths."""
    rows = _rgb(v).where("frame_idx < 20 + video_id % 3")
    clip = v("v_g_preds").select("video_id").distinct().select("video_id", F.floor(F.col("video_id") / 4).alias("item_id"), (F.col("video_id") % 4).alias("level"))
    items = clip.where("level = 0 and item_id > 0").select("item_id", F.concat(F.lit("d"), F.col("item_id") % 3).alias("domain"), (F.col("video_id") - 1).alias("reference_id"))
    levels = clip.select((F.col("item_id") % 2).alias("model_id"), "item_id", "level", "video_id")
    return rounded(pairs.conditional_items(items, levels, levels.drop("level"), rows, block=8), 5)


def _clips(v):
    """Clips of 25 frames of 8 x 8 pixels, with flow, edges and keypoints, as far as ``clips.clip_checks``."""
    rows, size = v("v_frames"), [F.lit(8).alias("height"), F.lit(8).alias("width")]
    store = clips.store_frames(_rgb(v), block=8)
    x = F.transform("feature", lambda e: e.cast("double"))
    flow = rows.where("frame_idx > 0").select("video_id", "frame_idx", *size, F.transform(x, lambda e: 10 * e).alias("u"), F.reverse(x).alias("v"))
    edges = rows.select("video_id", "frame_idx", F.transform("feature", lambda e: F.when(e > 0.1, 255.0).otherwise(0.0)).alias("edges"))
    points = rows.where("video_id % 2 = 0").select("video_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("landmark"), x.alias("e"))
    points = points.select("video_id", "frame_idx", "landmark", F.element_at("e", 2 * F.col("landmark") + 1).alias("x"), F.element_at("e", 2 * F.col("landmark") + 2).alias("y"))
    return clips.clip_checks(store, flow, edges, points, block=8, fan_in=2)


def _generation(v):
    """The arguments of the generation track over those clips: prompts for some of them, judges for some items."""
    rows = v("v_frames")
    prompts = rows.where("frame_idx = 3 and video_id % 3 <> 0").select("video_id", F.col("feature").alias("vector"))
    panel = _verdicts(v).withColumn("model_id", F.col("judge") % 3)
    return {"items": v("v_g_items"), "predictions": v("v_g_preds"), "clips": _clips(v), "fallback": judges.ensemble(panel, keys=("model_id", "item_id")), "prompts": quality.prompt_consistency(rows, prompts)}


@query
def a10_clip_quality(v, spark, sf_dir):
    """Six quality metrics and the depth, blob and mass checks of clips, from one pass over their frames."""
    own = [*clips.QUALITY[:-1], "depth_stability", "blob_count_stability", "mass_drift"]
    return rounded(_clips(v).select("video_id", *own), 5)


@query
def v20_clip_verdicts(v, spark, sf_dir):
    """Frames, flow, edges and keypoints to quality and a verdict of each prediction."""
    rows = clips.generation_items(**_generation(v))
    return rounded(rows.select("model_id", "item_id", "video_id", "quality", "verdict", F.coalesce("passed", F.lit(False)).alias("passed"), "judge_type", "uncertainty", F.size("violations").alias("n_violations")), 5)


@query
def a11_clip_generation(v, spark, sf_dir):
    """Frames, flow, edges and keypoints to the generation track's summary."""
    return rounded(clips.generation_track(**_generation(v)), 5)


def _two(v):
    """Even clips against the odd ones after them."""
    rows = _frames(v).withColumn("pair", F.floor(F.col("video_id") / 2))
    return rows.where("video_id % 2 = 0"), rows.where("video_id % 2 = 1")


@query
def j3_aligned(v, spark, sf_dir):
    a, b = _two(v)
    return aligned(a, b, ["pair"], "gray").groupBy("pair").agg(F.count("*").alias("n_frames"), F.max("frame_idx").alias("last"))


@query
def v21_blur_ssim(v, spark, sf_dir):
    a, b = _two(v)
    return rounded(control.blur_ssim(a, b, ["pair"]), 5)


@query
def v22_edge_f1(v, spark, sf_dir):
    edge = F.transform("gray", lambda x: F.when(x > 0.55, 1).otherwise(0))
    a, b = (x.withColumn("edges", edge) for x in _two(v))
    return rounded(control.edge_f1(a, b, ["pair"]), 5)


@query
def v23_depth(v, spark, sf_dir):
    a, b = (x.withColumnRenamed("gray", "depth") for x in _two(v))
    return rounded(control.depth_si_rmse(a, b, ["pair"]), 5)


@query
def v24_miou(v, spark, sf_dir):
    mask = F.transform("gray", lambda x: F.when(x > 0.5, 1).otherwise(0))
    a, b = (x.withColumn("mask", mask) for x in _two(v))
    return rounded(control.mask_miou(a, b, ["pair"]), 5)


@query
def v25_diversity(v, spark, sf_dir):
    rows = _frames(v).withColumn("item_id", F.floor(F.col("video_id") / 4)).withColumnRenamed("video_id", "variant")
    return rounded(control.diversity(rows, ["item_id"]), 5)


@query
def p6_sample_frames(v, spark, sf_dir):
    return sample_frames(v("v_features").select("video_id", "frame_idx")).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers scored, chains included, indexed and ranked."""
    scores = tracks.understanding(view(spark, sf_dir, "v_u_items"), view(spark, sf_dir, "v_u_preds"))
    return rounded(leaderboard.ranking(scores, ("U.accuracy", "U.multihop_chain_accuracy")))


QUERIES["flagship_ranking"] = flagship
