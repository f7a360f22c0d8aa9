"""DuckDB SQL with the rows of the registered queries, written from the definitions."""

from __future__ import annotations

from framescore.plans import clip_sql
from framescore.plans.clip_sql import CLIPS as _CLIPS
from framescore.plans.clip_sql import GENERATION as _GENERATION
from framescore.plans.clip_sql import STEPS as _STEPS
from framescore.plans.clip_sql import UNIT as _UNIT
from framescore.plans.views import with_views

_LAST = "last AS (SELECT model_id, item_id, arg_max(answer_idx, seq) AS pred FROM v_u_preds GROUP BY ALL)"
_CHAIN = _LAST + """, grid AS (SELECT m.model_id, i.* FROM (SELECT DISTINCT model_id FROM v_u_preds) m CROSS JOIN v_u_items i WHERE chain_id IS NOT NULL),
chain AS (SELECT g.model_id, g.chain_id, min(CASE WHEN coalesce(l.pred, -1) <> g.answer_idx THEN coalesce(g.hop_index, 0) END) AS first_error_hop
  FROM grid g LEFT JOIN last l ON g.model_id = l.model_id AND g.item_id = l.item_id GROUP BY ALL)"""
_CF_ROWS = r"""tok AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(prediction), '\s+'), lambda x: x <> '')) AS ta,
  list_distinct(list_filter(string_split_regex(lower(counterfactual_outcome), '\s+'), lambda x: x <> '')) AS tb, lower(prediction) AS p FROM v_cf),
cf AS (SELECT *, CASE WHEN len(tb) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / len(tb)::DOUBLE END AS overlap,
  (contains(p, direction_keyword) AND NOT contains(p, CASE direction_keyword WHEN 'more' THEN 'less' WHEN 'less' THEN 'more' WHEN 'up' THEN 'down' ELSE 'up' END))::INT AS direction,
  (CASE magnitude_bin WHEN 'same' THEN regexp_matches(p, '\bsame\b|unchanged|no\s+change') WHEN 'much_more' THEN regexp_matches(p, 'much\s+more|far\s+more|significantly\s+more')
   ELSE regexp_matches(p, 'slightly\s+less|a\s+bit\s+less|a\s+little\s+less') END)::INT AS magnitude FROM tok)"""
_RANKED = "(rank() OVER (PARTITION BY metric ORDER BY {0}) + (count(*) OVER (PARTITION BY metric, {0}) - 1) / 2.0)"
_FINITE = "CASE WHEN isnan(rho) OR isinf(rho) THEN NULL ELSE rho END"
_INDEX = "sum(value * CASE metric WHEN 'G.domain_score' THEN 0.20::DOUBLE WHEN 'U.accuracy' THEN 0.30::DOUBLE WHEN 'U.multihop_chain_accuracy' THEN 0.20::DOUBLE WHEN 'CF.counterfactual_delta_accuracy' THEN 0.15::DOUBLE ELSE 0.0375::DOUBLE END)"
_ENSEMBLE = """e AS (SELECT item_id, median(score) AS score, avg(score) AS mean, avg((score >= 0.5)::INT) AS majority, count(score) AS n_judges, coalesce(stddev_pop(score), 0) AS std,
  coalesce(max(score) - min(score), 0) AS range, coalesce(string_agg(DISTINCT violation, ',' ORDER BY violation) FILTER (score IS NOT NULL), '') AS violations FROM v_verdicts {0} GROUP BY 1)"""
_ROUTE = _ENSEMBLE.format("WHERE judge > 1") + """,
a AS (SELECT item_id, physics_category, max(CASE WHEN judge = 1 THEN score END) AS own FROM v_verdicts GROUP BY 1, 2),
r AS (SELECT a.item_id, a.own, a.physics_category < 3 AS tractable, e.item_id IS NOT NULL AS has, e.score AS other, CASE WHEN e.n_judges < 2 OR round(e.std, 9) >= 0.25 THEN 'high' ELSE 'medium' END AS u, e.violations AS vi FROM a LEFT JOIN e USING (item_id))"""
_G = "list_transform(feature, lambda x: (x::DOUBLE + 1) / 2)"
_TWO = "f AS (SELECT video_id, frame_idx, " + _G + " AS g FROM v_features), two AS (SELECT a.video_id // 2 AS pair, a.frame_idx, a.g AS a, b.g AS b FROM f a JOIN f b ON b.video_id = a.video_id + 1 AND a.frame_idx = b.frame_idx WHERE a.video_id % 2 = 0)"

_SQL = {
    "flagship_ranking": f"""{_CHAIN}, acc AS (SELECT l.model_id, avg((l.pred = i.answer_idx)::INT) AS a FROM last l JOIN v_u_items i USING (item_id) GROUP BY 1),
ch AS (SELECT model_id, avg((first_error_hop IS NULL)::INT) AS c FROM chain GROUP BY 1)
SELECT model_id, round(0.30::DOUBLE * a + 0.20::DOUBLE * c, 6) AS quality_index, round(a, 6) AS "U_accuracy", round(c, 6) AS "U_multihop_chain_accuracy" FROM acc JOIN ch USING (model_id)""",
    "j1_join_answers": f"""{_LAST}, grid AS (SELECT m.model_id, i.* FROM (SELECT DISTINCT model_id FROM v_u_preds) m CROSS JOIN v_u_items i)
SELECT g.model_id, physics_category, count(*) AS n_rows, count(*) FILTER (l.item_id IS NOT NULL) AS n_answered, sum((coalesce(l.pred, -1) = g.answer_idx)::INT)::BIGINT AS n_ok
FROM grid g LEFT JOIN last l ON g.model_id = l.model_id AND g.item_id = l.item_id GROUP BY ALL""",
    "a2_accuracy": f"""{_LAST} SELECT model_id, CASE WHEN grouping(domain) = 1 THEN 'overall' ELSE 'domain' END AS scope, domain AS scope_value, round(avg((pred = answer_idx)::INT), 6) AS accuracy, count(*) AS n
FROM last JOIN v_u_items USING (item_id) GROUP BY GROUPING SETS ((model_id), (model_id, domain))""",
    "a3_chains": f"{_CHAIN} SELECT model_id, chain_id, first_error_hop, (first_error_hop IS NULL)::INT AS chain_ok FROM chain",
    "a4_chain_summary": f"""{_CHAIN} SELECT model_id, count(*) AS n_chains, round(avg((first_error_hop IS NULL)::INT), 6) AS multihop_chain_accuracy,
round(coalesce(avg(CASE WHEN first_error_hop IS NOT NULL THEN (first_error_hop > 0)::INT END), 0), 6) AS error_propagation_rate, round(coalesce(avg(first_error_hop), 0), 6) AS mean_first_error_hop FROM chain GROUP BY 1""",
    "a5_prior_leaks": "SELECT count(*) FILTER (language_prior_score >= 0.6) AS n_leaky, count(*) AS n_items FROM v_u_items",
    "q6_audit_counts": "SELECT count(*) AS n_items, count(*) FILTER (language_prior_score >= 0.6) AS n_prior, count(*) FILTER (annotator_agreement < 0.8) AS n_disagree FROM v_u_items",
    "a14_human_baseline": f"""{_LAST} SELECT domain, round(avg((pred = answer_idx)::INT), 6) AS accuracy, count(*) AS n FROM last JOIN v_u_items USING (item_id) WHERE model_id = 0 GROUP BY GROUPING SETS ((), (domain))""",
    "s8_pending": "SELECT DISTINCT model_id, item_id % 7 AS track FROM v_u_preds WHERE (model_id + item_id % 7) % 2 <> 0",
    "a6_a8_text_matches": f"{_CF_ROWS} SELECT item_id, round(overlap, 6) AS overlap, direction, magnitude FROM cf",
    "a9_counterfactual": f"""{_CF_ROWS} SELECT item_id % 3 AS model_id, CASE WHEN grouping(domain) = 1 AND grouping(physics_category) = 1 THEN 'overall' WHEN grouping(physics_category) = 1 THEN 'domain' ELSE 'physics' END AS scope,
coalesce(domain, physics_category) AS scope_value, round(avg((overlap >= 0.5)::INT), 6) AS entailed, round(avg(direction), 6) AS direction, round(avg(magnitude), 6) AS magnitude, count(*) AS n
FROM cf GROUP BY GROUPING SETS ((item_id % 3), (item_id % 3, domain), (item_id % 3, physics_category))""",
    "j2_repeats_stay": "SELECT p.model_id, i.domain, count(*) AS n FROM v_u_preds p JOIN v_u_items i USING (item_id) GROUP BY ALL",
    "p1_requests": "SELECT item_id, domain AS scenario, 'If ' || direction_keyword || ' were ' || magnitude_bin || ', how would the outcome change? Describe specifically.' AS question FROM v_cf",
    "p2_run_model": "SELECT 'baseline' AS model_id, item_id, 'CF' AS track, 0::INT AS answer_idx, 'The outcome would not change meaningfully.' AS text FROM v_cf",
    "jg1_median": _ENSEMBLE.format("") + " SELECT item_id, round(score, 6) AS score, n_judges, round(std, 6) AS std, round(range, 6) AS range, n_judges > 0 AND round(std, 9) >= 0.25 AS flagged, CASE WHEN n_judges < 2 OR round(std, 9) >= 0.25 THEN 'high' ELSE 'medium' END AS uncertainty, violations FROM e",
    "jg1_mean": _ENSEMBLE.format("") + " SELECT item_id, round(mean, 6) AS score FROM e",
    "jg1_majority": _ENSEMBLE.format("") + " SELECT item_id, round(majority, 6) AS score FROM e",
    "jg3_breakdown": "SELECT item_id, count(*)::INT AS n_all, (count(DISTINCT CASE WHEN score IS NOT NULL THEN violation END))::INT AS n_violations FROM v_verdicts GROUP BY 1",
    "jg4_hybrid": f"""{_ROUTE} SELECT item_id, round(CASE WHEN tractable AND own IS NOT NULL THEN own WHEN has THEN other END, 6) AS score, CASE WHEN tractable AND own IS NOT NULL THEN 'analytic' WHEN has THEN 'ensemble' ELSE 'none' END AS judge_type,
CASE WHEN tractable AND own IS NOT NULL THEN NULL WHEN has THEN u ELSE 'high' END AS uncertainty, CASE WHEN tractable AND own IS NOT NULL OR NOT has THEN '' ELSE vi END AS violations FROM r""",
    "jg5_domain": f"""{_ROUTE} SELECT item_id, round(CASE WHEN tractable THEN own WHEN has THEN other END, 6) AS score, CASE WHEN tractable THEN 'analytic' WHEN has THEN 'mllm' ELSE 'none' END AS judge_type,
CASE WHEN tractable THEN 'low' ELSE 'high' END AS uncertainty, CASE WHEN tractable OR NOT has THEN '' ELSE vi END AS violations FROM r""",
    "a11_generation": """SELECT judge % 3 AS model_id, CASE WHEN grouping(domain) = 1 AND grouping(physics_category) = 1 THEN 'overall' WHEN grouping(physics_category) = 1 THEN 'domain' ELSE 'physics' END AS scope,
coalesce(domain, physics_category) AS scope_value, round(avg(judge / 10.0), 6) AS quality_score, round(avg(score), 6) AS domain_score, count(*) FILTER (score IS NULL) AS intractable_items, count(*) AS n,
CASE WHEN grouping(domain) = 1 AND grouping(physics_category) = 1 THEN round(0.3 * avg(judge / 10.0) + 0.7 * coalesce(avg(score), 0), 6) END AS overall
FROM v_verdicts GROUP BY GROUPING SETS ((judge % 3), (judge % 3, domain), (judge % 3, physics_category))""",
    "p4_judge_score": r"SELECT event_id, round(CASE WHEN x = '' THEN 0.5 ELSE least(1.0, greatest(0.0, x::DOUBLE)) END, 6) AS score FROM (SELECT event_id, regexp_extract(reply, '[0-1](\.\d+)?') AS x FROM v_replies)",
    "p5_draft": r"SELECT event_id, nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS draft FROM v_replies",
    "s3_parse_prediction": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 4)::INT END AS answer_idx, CASE WHEN event_id % 2 = 1 THEN reply END AS text FROM v_replies",
    "a15_robustness": """s AS (SELECT *, lead(fidelity) OVER w AS f2, lead(level) OVER w AS l2 FROM v_robust WINDOW w AS (PARTITION BY item_id ORDER BY level))
SELECT item_id, round(least(1.0, greatest(0.0, CASE WHEN max(level) > min(level) THEN sum((fidelity + f2) / 2 * (l2 - level)) / (max(level) - min(level)) ELSE max(fidelity) END)), 6) AS robustness, count(*) AS n_levels FROM s GROUP BY 1""",
    "a13_conditional": """s AS (SELECT *, lead(fidelity) OVER w AS f2, lead(level) OVER w AS l2 FROM v_robust WINDOW w AS (PARTITION BY item_id ORDER BY level)),
i AS (SELECT item_id % 3 AS model_id, item_id, item_id % 8 AS domain, coalesce(max(CASE WHEN level = 1 THEN fidelity END), 0) AS blur_ssim, min(fidelity) AS edge_f1, max(fidelity) AS depth_si_rmse, 0.5 AS mask_miou,
  CASE WHEN item_id % 2 = 0 THEN 0.25 ELSE 0 END AS diversity, least(1.0, greatest(0.0, sum((fidelity + f2) / 2 * (l2 - level)) / (max(level) - min(level)))) AS robustness FROM s GROUP BY item_id HAVING count(*) > 1)
SELECT model_id, CASE WHEN grouping(domain) = 1 THEN 'overall' ELSE 'domain' END AS scope, domain AS scope_value, round(avg(blur_ssim), 6) AS blur_ssim, round(avg(edge_f1), 6) AS edge_f1, round(avg(depth_si_rmse), 6) AS depth_si_rmse,
round(avg(mask_miou)::DOUBLE, 6) AS mask_miou, round(avg(0.5 * blur_ssim + 0.5 * edge_f1), 6) AS visual, round(avg(diversity)::DOUBLE, 6) AS diversity, round(avg(robustness), 6) AS robustness, count(*) AS n FROM i GROUP BY GROUPING SETS ((model_id), (model_id, domain))""",
    "an1_review_queue": """r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY arrival, annotator_id, answer_idx) AS rn FROM v_queue)
SELECT task_id, string_agg(answer_idx::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS votes, count(*) FILTER (rn <= 3) AS n, count(*) FILTER (rn <= 3) >= 3 AS done, count(*) FILTER (rn > 3) AS n_late FROM r GROUP BY 1""",
    "an2_review_stream": """r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY arrival, annotator_id, answer_idx) AS rn FROM v_queue)
SELECT task_id, string_agg(answer_idx::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS votes, 3::INT AS n, count(*) FILTER (rn > 3) AS n_late FROM r GROUP BY 1 HAVING count(*) >= 3""",
    "an3_prior_audit": "SELECT item_id, domain, round(avg((pred = answer_idx)::INT), 6) AS prior, avg((pred = answer_idx)::INT) < 0.6 AS passed FROM v_trials GROUP BY 1, 2",
    "an3_prior_rejections": "SELECT domain, count(*) AS n_rejected FROM (SELECT item_id, domain FROM v_trials GROUP BY 1, 2 HAVING avg((pred = answer_idx)::INT) >= 0.25) GROUP BY 1",
    "an4_agreement": """n AS (SELECT item_id, count(*) AS n, arg_min(vote, arrival) AS first FROM v_annotations GROUP BY 1), top AS (SELECT max(n) AS top FROM n),
c AS (SELECT item_id, vote, count(*) AS c FROM v_annotations GROUP BY 1, 2), p AS (SELECT c.item_id, max(c + CASE WHEN vote = first THEN top - n ELSE 0 END) AS m, any_value(top) AS top FROM c JOIN n USING (item_id), top GROUP BY 1)
SELECT item_id, round(CASE WHEN top < 2 THEN 1.0 ELSE m / top::DOUBLE END, 6) AS share, CASE WHEN top < 2 THEN 1.0 ELSE m / top::DOUBLE END >= 0.8 AS passed FROM p""",
    "an5_kappa": "o AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM v_kappa) SELECT round((po - pe) / (1 - pe), 6) AS kappa, n FROM o",
    "an6_panel_kappa": """r AS (SELECT item_id, vote, row_number() OVER (PARTITION BY item_id ORDER BY arrival) AS r FROM v_annotations), top AS (SELECT max(r) AS top FROM r),
pad AS (SELECT i.item_id, k.k, coalesce(r.vote, f.vote) AS vote FROM (SELECT DISTINCT item_id FROM r) i CROSS JOIN (SELECT unnest(range(1, (SELECT top FROM top) + 1)) AS k) k LEFT JOIN r ON r.item_id = i.item_id AND r.r = k.k JOIN r f ON f.item_id = i.item_id AND f.r = 1),
pr AS (SELECT a.k AS i, b.k AS j, a.vote AS a, b.vote AS b FROM pad a JOIN pad b ON a.item_id = b.item_id AND a.k < b.k),
po AS (SELECT i, j, count(*) AS n, avg((a = b)::INT) AS po FROM pr GROUP BY 1, 2), ca AS (SELECT i, j, a AS v, count(*) AS c FROM pr GROUP BY 1, 2, 3), cb AS (SELECT i, j, b AS v, count(*) AS c FROM pr GROUP BY 1, 2, 3),
pe AS (SELECT i, j, sum(ca.c::DOUBLE * cb.c) AS s FROM ca JOIN cb USING (i, j, v) GROUP BY 1, 2)
SELECT round(coalesce(avg(CASE WHEN n::DOUBLE * n = coalesce(s, 0) THEN NULL ELSE (po - coalesce(s, 0) / (n::DOUBLE * n)) / (1 - coalesce(s, 0) / (n::DOUBLE * n)) END), 0), 6) AS panel_kappa, count(*) AS n_pairs FROM po LEFT JOIN pe USING (i, j)""",
    "an8_irt_flags": "p AS (SELECT item_id, avg(score) AS a, 6 * (0.5 - avg(score)) AS b FROM v_item_scores GROUP BY 1) SELECT item_id, round(a, 6) AS a, round(b, 6) AS b, b < -2.5 AS floor, b > 2.5 AS ceiling, a < 0.5 AS low_disc FROM p",
    "an9_cascade": """q AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY arrival, annotator_id, answer_idx) AS rn FROM v_queue), t AS (SELECT task_id AS item_id, count(*) >= 3 AS done FROM q GROUP BY 1),
p AS (SELECT item_id, avg((pred = answer_idx)::INT) < 0.3 AS ok FROM v_trials GROUP BY 1), k AS (SELECT task_id AS item_id, answer_idx AS vote, rn FROM q WHERE rn <= 3),
n AS (SELECT item_id, count(*) AS n, arg_min(vote, rn) AS first FROM k GROUP BY 1), c AS (SELECT item_id, vote, count(*) AS c FROM k GROUP BY 1, 2),
g AS (SELECT c.item_id, max(c + CASE WHEN vote = first THEN (SELECT max(n) FROM n) - n ELSE 0 END) / (SELECT max(n) FROM n)::DOUBLE >= 0.6 AS ok FROM c JOIN n USING (item_id) GROUP BY 1)
SELECT count(*) AS n_items, count(*) FILTER (done) AS n_reviewed, count(*) FILTER (done AND p.ok) AS n_prior_passed, count(*) FILTER (done AND p.ok AND g.ok) AS n_agreed FROM t LEFT JOIN p USING (item_id) LEFT JOIN g USING (item_id)""",
    "q2_audit_sample": """s AS (SELECT *, row_number() OVER (PARTITION BY domain, physics_category ORDER BY md5('0:' || item_id), item_id) AS rn, count(*) OVER (PARTITION BY domain, physics_category) AS n FROM v_pool)
SELECT item_id, domain, physics_category::VARCHAR AS physics_category FROM s WHERE rn <= greatest(1, round_even(n * 0.2::DOUBLE, 0))""",
    "q3_saturated": "SELECT item_id FROM v_item_scores GROUP BY 1 HAVING count(*) FILTER (score >= 0.9) >= 3",
    "q4_saturation_report": """s AS (SELECT item_id FROM v_item_scores GROUP BY 1 HAVING count(*) FILTER (score >= 0.8) >= 3), k AS (SELECT i.* FROM s JOIN v_u_items i USING (item_id))
SELECT 'overall' AS scope, '' AS scope_value, count(*) AS n FROM s UNION ALL SELECT 'domain', domain::VARCHAR, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'physics', physics_category::VARCHAR, count(*) FROM k GROUP BY 2""",
    "q5_drift": """q AS (SELECT year(date) || 'Q' || quarter(date) AS quarter, avg(quality_index) AS m FROM v_history GROUP BY 1), d AS (SELECT m - lag(m) OVER (ORDER BY quarter) AS d FROM q), t AS (SELECT coalesce(avg(d), 0) AS trend, count(*) AS n FROM d)
SELECT round(trend, 6) AS trend, n AS n_quarters, CASE WHEN n = 0 THEN 'insufficient_data' WHEN trend > 0.05 THEN 'refresh_items' WHEN trend < -0.05 THEN 'investigate_regression' ELSE 'stable' END AS verdict FROM t""",
    "q5_quarterly": "SELECT year(date) || 'Q' || quarter(date) AS quarter, round(avg(quality_index), 6) AS mean_index, count(*) AS n FROM v_history GROUP BY 1",
    "l1_index": f"SELECT model_id, round({_INDEX}, 6) AS quality_index FROM v_track_scores GROUP BY 1",
    "l2_ranking": f"""SELECT model_id, round({_INDEX}, 6) AS quality_index, round(max(value) FILTER (metric = 'G.domain_score'), 6) AS "G_domain_score", round(max(value) FILTER (metric = 'C.blur_ssim'), 6) AS "C_blur_ssim", round(max(value) FILTER (metric = 'U.accuracy'), 6) AS "U_accuracy",
round(max(value) FILTER (metric = 'U.multihop_chain_accuracy'), 6) AS "U_multihop_chain_accuracy", round(max(value) FILTER (metric = 'CF.counterfactual_delta_accuracy'), 6) AS "CF_counterfactual_delta_accuracy" FROM v_track_scores GROUP BY 1""",
    "l3_spearman": f"""s AS (SELECT model_id, avg(rate) AS rate FROM v_dv GROUP BY 1), c AS (SELECT s.* FROM s WHERE model_id IN (SELECT model_id FROM v_track_scores)),
r AS (SELECT metric, {_RANKED.format("value")} AS rx, {_RANKED.format("rate")} AS ry FROM v_track_scores JOIN c USING (model_id)), o AS (SELECT metric, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY 1)
SELECT metric, round(rho, 6) AS rho, n FROM o WHERE n = (SELECT count(*) FROM c) AND (SELECT count(*) FROM c) >= 3 AND {_FINITE} IS NOT NULL""",
    "l4_validity": f"""s AS (SELECT model_id, sum(rate) / 3 AS success FROM v_dv GROUP BY 1), m AS (SELECT s.* FROM s WHERE model_id IN (SELECT model_id FROM v_track_scores)), k AS (SELECT DISTINCT metric FROM v_track_scores),
g AS (SELECT k.metric, m.success, coalesce(t.value, 0) AS value FROM m CROSS JOIN k LEFT JOIN v_track_scores t ON t.model_id = m.model_id AND t.metric = k.metric),
r AS (SELECT metric, {_RANKED.format("value")} AS rx, {_RANKED.format("success")} AS ry FROM g), o AS (SELECT metric AS track, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY 1), e AS (SELECT track, coalesce({_FINITE}, 0) AS rho FROM o WHERE n >= 3)
SELECT track, round(rho, 6) AS rho FROM e UNION ALL SELECT 'mean', round(avg(rho), 6) FROM e HAVING count(*) > 0""",
    "s5_s6_score_forms": """s AS (SELECT model_id, split_part(metric, '.', 1) AS track, metric, value FROM v_track_scores)
SELECT model_id::VARCHAR AS model_id, track, 'overall' AS scope, '' AS scope_value, metric, round(value, 6) AS value FROM s UNION ALL SELECT model_id::VARCHAR, track, 'domain', (model_id % 3)::VARCHAR, metric, round(value / 2, 6) FROM s""",
    "v11_curvature": """m AS (SELECT video_id, avg(t) AS mid FROM v_traj GROUP BY 1), q AS (SELECT video_id, y, (t - mid) * (t - mid) AS q FROM v_traj JOIN m USING (video_id)),
a AS (SELECT video_id, count(*) AS n, (count(*) * sum(q * y) - sum(q) * sum(y)) / nullif(count(*) * sum(q * q) - sum(q) * sum(q), 0) AS a FROM q GROUP BY 1)
SELECT video_id, n, round(a, 4) AS a, coalesce(a > 1e-3, false) AS aligned FROM a""",
    "v12_v14_motion_checks": f"""{_STEPS}, r AS (SELECT *, abs(speed - lag(speed) OVER w) AS dv, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY video_id ORDER BY t)), c AS (SELECT video_id, median(speed) AS med, count(*) AS n FROM s GROUP BY 1)
SELECT video_id, count(*) FILTER (dv > 0.6 * (med + 1e-6)) AS spikes, count(*) FILTER (speed > 5 * (med + 1e-6)) AS jumps,
any_value(n) <= 4 OR avg(speed) FILTER (i >= n // 2) <= (avg(speed) FILTER (i < n // 2) + 1e-6) * 1.2 AS friction_ok FROM r JOIN c USING (video_id) GROUP BY 1""",
    "v15_reflection": f"""{_STEPS}, u AS (SELECT video_id, t, vx / (speed + 1e-6) AS ix, vy / (speed + 1e-6) AS iy FROM s), o AS (SELECT *, lead(ix) OVER w AS ox, lead(iy) OVER w AS oy, count(*) OVER (PARTITION BY video_id) AS n FROM u WINDOW w AS (PARTITION BY video_id ORDER BY t)),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ox IS NULL, ix * ox + iy * oy, t) AS rn FROM o), k AS (SELECT *, (ix + ox) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS nx, (iy + oy) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS ny FROM b WHERE rn = 1),
c AS (SELECT video_id, CASE WHEN n > 2 THEN (ix - 2 * (ix * nx + iy * ny) * nx) * ox + (iy - 2 * (ix * nx + iy * ny) * ny) * oy END AS cos FROM k) SELECT video_id, coalesce(cos > 0.7, true) AS reflection_ok, round(cos, 4) AS cos FROM c""",
    "v1_consistency": f"""n AS (SELECT video_id, frame_idx, feature::DOUBLE[] AS x FROM v_features), l AS (SELECT *, lag(x) OVER w AS p, first_value(x) OVER w AS f FROM n WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
d AS (SELECT video_id, 0.5 * (list_dot_product(f, x) / ({_UNIT.format("f")}) + list_dot_product(p, x) / ({_UNIT.format("p")})) / ({_UNIT.format("x")}) AS s FROM l WHERE p IS NOT NULL)
SELECT video_id, round(coalesce((avg(s) + 1) / 2, 1.0), 5) AS consistency FROM (SELECT DISTINCT video_id FROM n) LEFT JOIN d USING (video_id) GROUP BY 1""",
    "v2_v4_quality": f"""f AS (SELECT video_id, frame_idx, {_G} AS g FROM v_features), l AS (SELECT *, lag(g) OVER w AS p, lead(g) OVER w AS q FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))
SELECT video_id, round(coalesce(greatest(0.0, 1 - avg(CASE WHEN frame_idx % 2 = 1 AND p IS NOT NULL AND q IS NOT NULL THEN list_avg(list_transform(range(1, 65), lambda i: abs((p[i] + q[i]) / 2 - g[i]))) END)), 1.0), 5) AS motion_smoothness,
round(least(1.0, greatest(0.0, avg(list_stddev_pop(g)) * 2)), 5) AS aesthetic_quality FROM l GROUP BY 1""",
    "v5_prompt_consistency": f"""n AS (SELECT video_id, frame_idx, feature::DOUBLE[] AS x FROM v_features), p AS (SELECT video_id, x AS q FROM n WHERE frame_idx = 3 AND video_id % 3 <> 0)
SELECT video_id, round(CASE WHEN count(q) = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, (avg(list_dot_product(x, q) / ({_UNIT.format("x")}) / ({_UNIT.format("q")})) + 1) / 2)) END, 5) AS overall_consistency FROM n LEFT JOIN p USING (video_id) GROUP BY 1""",
    "v9_pose_validity": """e(a, b) AS (VALUES (11, 13), (13, 15), (12, 14), (14, 16), (23, 25), (25, 27), (24, 26), (26, 28), (11, 12), (23, 24), (11, 23), (12, 24)),
l AS (SELECT video_id, a, b, sqrt((feature[2 * a + 1]::DOUBLE - feature[2 * b + 1]) ** 2 + (feature[2 * a + 2]::DOUBLE - feature[2 * b + 2]) ** 2) AS l FROM v_features CROSS JOIN e),
c AS (SELECT video_id, CASE WHEN count(*) >= 2 AND avg(l) >= 1e-6 THEN stddev_pop(l) / avg(l) END AS c FROM l GROUP BY video_id, a, b) SELECT video_id, round(1 / (1 + avg(c)), 5) AS pose_validity FROM c GROUP BY 1""",
    "v18_surface_jitter": "m AS (SELECT video_id, list_avg(list_transform(feature, lambda x: CASE WHEN x > 0.1::DOUBLE THEN 255.0 ELSE 0.0 END)) AS m FROM v_features) SELECT video_id, round(stddev_pop(m), 5) AS jitter, stddev_pop(m) < 20 AS surface_ok FROM m GROUP BY 1",
    "j3_aligned": f"{_TWO} SELECT pair, count(*) AS n_frames, max(frame_idx) AS last FROM two GROUP BY 1",
    "v22_edge_f1": f"""{_TWO}, c AS (SELECT pair, len(list_filter(range(1, 65), lambda i: a[i] > 0.55 AND b[i] > 0.55)) AS tp, len(list_filter(range(1, 65), lambda i: (a[i] > 0.55) <> (b[i] > 0.55))) AS one FROM two)
SELECT pair, round(avg(CASE WHEN 2 * tp + one = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + one) END), 5) AS edge_f1 FROM c GROUP BY 1""",
    "v23_depth": f"""{_TWO}, d AS (SELECT pair, list_transform(range(1, 65), lambda i: ln(a[i] + 1e-3) - ln(b[i] + 1e-3)) AS d FROM two)
SELECT pair, round(1 / (1 + avg(sqrt(greatest(0, list_avg(list_transform(d, lambda x: x * x)) - list_avg(d) ** 2)))), 5) AS depth_si_rmse FROM d GROUP BY 1""",
    "v24_miou": f"""{_TWO}, k AS (SELECT pair, len(list_filter(range(1, 65), lambda i: a[i] > 0.5 AND b[i] > 0.5)) AS i1, len(list_filter(range(1, 65), lambda i: a[i] > 0.5 OR b[i] > 0.5)) AS u1, len(list_filter(range(1, 65), lambda i: a[i] <= 0.5 AND b[i] <= 0.5)) AS i0, len(list_filter(range(1, 65), lambda i: a[i] <= 0.5 OR b[i] <= 0.5)) AS u0 FROM two)
SELECT pair, round(avg((coalesce(i1::DOUBLE / nullif(u1, 0), 0) + coalesce(i0::DOUBLE / nullif(u0, 0), 0)) / ((u1 > 0)::INT + (u0 > 0)::INT)), 5) AS mask_miou FROM k GROUP BY 1""",
    "v25_diversity": f"""f AS (SELECT video_id, video_id // 4 AS item_id, frame_idx, {_G} AS g FROM v_features), p AS (SELECT a.item_id, a.video_id AS x, b.video_id AS y, avg(list_avg(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i])))) AS d
FROM f a JOIN f b ON a.item_id = b.item_id AND a.frame_idx = b.frame_idx AND a.video_id < b.video_id GROUP BY 1, 2, 3) SELECT item_id, round(coalesce(least(1.0, avg(d)), 0.0), 5) AS diversity FROM (SELECT DISTINCT item_id FROM f) LEFT JOIN p USING (item_id) GROUP BY 1""",
    "p1_generation": "SELECT item_id, prompt FROM v_prompts",
    "p1_conditional": "SELECT item_id, prompt, source AS depth, concat_ws('|', lang, source) AS variants FROM v_prompts",
    "p1_understanding": "SELECT item_id, source AS video_path, prompt AS question, concat_ws('|', 'a', lang, 'c', 'd') AS choices FROM v_prompts",
    "s1_s2_read_and_validate": """SELECT item_id, domain, answer_idx, round(language_prior_score, 6) AS language_prior_score, round(annotator_agreement, 6) AS annotator_agreement, concat_ws(',',
CASE WHEN item_id IS NULL THEN 'item_id' END, CASE WHEN domain = 'kitchen' THEN 'domain' END, CASE WHEN physics_category = 'magic' THEN 'physics_category' END, CASE WHEN n_choices <> 4 THEN 'choices' END,
CASE WHEN answer_idx NOT BETWEEN 0 AND 3 THEN 'answer_idx' END, CASE WHEN language_prior_score NOT BETWEEN 0 AND 1 THEN 'language_prior_score' END, CASE WHEN annotator_agreement NOT BETWEEN -1 AND 1 THEN 'annotator_agreement' END,
CASE WHEN question IS NULL THEN 'question' END, CASE WHEN requires_temporal IS NULL THEN 'requires_temporal' END, CASE WHEN video_path IS NULL THEN 'video_path' END) AS faults FROM v_drawn_items""",
    "p5_drafted_items": r"""d AS (SELECT *, regexp_extract(reply, '(?s)\{.*\}') AS j FROM v_drafts)
SELECT event_id, sha256('clip|' || j) AS item_id, (event_id % 6)::INT AS answer_idx, CASE WHEN event_id % 5 = 0 THEN 'a|b|c' ELSE 'a|b|c|d' END AS choices,
concat_ws(',', CASE WHEN domain = 'kitchen' THEN 'domain' END, CASE WHEN event_id % 5 = 0 THEN 'choices' END, CASE WHEN event_id % 6 > 3 THEN 'answer_idx' END) AS faults FROM d""",
    "q1_stratified_sample": """p AS (SELECT item_id, substring(domain, 1, 3) AS domain FROM v_pool WHERE domain IS NOT NULL), n AS (SELECT domain, count(*) AS n FROM p GROUP BY 1),
cfg(domain, ord, least_, share) AS (VALUES ('STA', 0, 5, 0.2::DOUBLE), ('PRO', 1, 5, 0.2), ('MED', 2, 5, 0.2), ('LAR', 3, 2, 0.5)),
q AS (SELECT n.domain, coalesce(ord, 9) AS ord, least(n, coalesce(least_, 0)) AS base, least(n, CASE WHEN share IS NULL THEN 100 ELSE floor(share * 100)::BIGINT END) AS most FROM n LEFT JOIN cfg USING (domain)),
i AS (SELECT domain, row_number() OVER (ORDER BY k - base, ord, domain) AS place FROM (SELECT *, unnest(range(base, most)) AS k FROM q)),
t AS (SELECT q.domain, base + count(i.domain) AS quota FROM q LEFT JOIN i ON i.domain = q.domain AND place <= 100 - (SELECT sum(base) FROM q) GROUP BY q.domain, base),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || item_id), item_id) AS rn FROM p) SELECT item_id, domain FROM r JOIN t USING (domain) WHERE rn <= quota""",
    "l5_markdown": f"""x AS (SELECT model_id, {_INDEX} AS q, max(value) FILTER (metric = 'G.domain_score') AS m1, max(value) FILTER (metric = 'C.blur_ssim') AS m2, max(value) FILTER (metric = 'U.accuracy') AS m3,
max(value) FILTER (metric = 'U.multihop_chain_accuracy') AS m4, max(value) FILTER (metric = 'CF.counterfactual_delta_accuracy') AS m5 FROM v_track_scores GROUP BY 1)
SELECT 0::INT AS line_no, '| model | index | G.domain_score | C.blur_ssim | U.accuracy | U.multihop_chain_accuracy | CF.counterfactual_delta_accuracy |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- | --- | --- | --- |'
UNION ALL SELECT (row_number() OVER (ORDER BY q DESC, model_id) + 1)::INT, '| ' || model_id || ' | ' || printf('%.4f', q) || ' | ' || coalesce(printf('%.4f', m1), '') || ' | ' || coalesce(printf('%.4f', m2), '') || ' | ' || coalesce(printf('%.4f', m3), '')
|| ' | ' || coalesce(printf('%.4f', m4), '') || ' | ' || coalesce(printf('%.4f', m5), '') || ' |' FROM x""",
    "s7_report": """s AS (SELECT model_id::VARCHAR AS model_id, model_id % 3 AS part, split_part(metric, '.', 1) AS track, metric, value FROM v_track_scores),
t AS (SELECT model_id, track, count(*) AS n, any_value(part) AS part, string_agg(metric || '=' || printf('%.3f', value / 2), ', ' ORDER BY metric) AS parts FROM s GROUP BY 1, 2)
SELECT model_id, track, 0::INT AS line_no, '## Track ' || track AS line FROM t UNION ALL SELECT model_id, track, 1, '- n_items: ' || n FROM t
UNION ALL SELECT model_id, track, (1 + row_number() OVER (PARTITION BY model_id, track ORDER BY metric))::INT, '- **' || metric || '**: ' || printf('%.4f', value) FROM s
UNION ALL SELECT model_id, track, (2 + n)::INT, '' FROM t UNION ALL SELECT model_id, track, (3 + n)::INT, '### Per-domain' FROM t UNION ALL SELECT model_id, track, (4 + n)::INT, '- ' || part || ': ' || parts FROM t""",
    "v16_fluid_mass": f"""f AS (SELECT video_id, {_G} AS g FROM v_features), m AS (SELECT video_id, sum(list_sum(g)) / sum(len(g)) AS mean, sum(list_dot_product(g, g)) / sum(len(g)) AS sq FROM f GROUP BY 1),
a AS (SELECT video_id, len(list_filter(g, lambda x: x > mean + sqrt(greatest(0, sq - mean * mean)))) AS area FROM f JOIN m USING (video_id)), d AS (SELECT video_id, coalesce((max(area) - min(area)) / nullif(max(area), 0)::DOUBLE, 0) AS d FROM a GROUP BY 1)
SELECT video_id, round(d, 6) AS mass_drift, d < 0.5 AS mass_ok FROM d""",
    "v6_flow_smoothness": """f AS (SELECT video_id, frame_idx, feature::DOUBLE[] AS u, list_reverse(feature)::DOUBLE[] AS v FROM v_features), p AS (SELECT *, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
c AS (SELECT video_id, CASE WHEN pu IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: sqrt((u[i] - pu[i]) ** 2 + (v[i] - pv[i]) ** 2))) END AS s, CASE WHEN pu IS NULL THEN 0 ELSE 64 END AS n FROM p)
SELECT video_id, round(CASE WHEN sum(n) = 0 THEN 1.0 ELSE 1 / (1 + sum(s) / sum(n)) END, 5) AS flow_smoothness FROM c GROUP BY 1""",
    "p7_gray": """b AS (SELECT video_id, frame_idx, list_transform(feature, lambda x: floor((x::DOUBLE + 1) / 2 * 255) / 255) AS r FROM v_features),
c AS (SELECT *, list_transform(range(0, 64), lambda i: r[64 - i]) AS g, list_transform(range(0, 64), lambda i: r[(i + 7) % 64 + 1]) AS l FROM b)
SELECT video_id, round(avg(list_avg(list_transform(range(1, 65), lambda i: floor(0.299::DOUBLE * floor(r[i] * 255) + 0.587::DOUBLE * floor(g[i] * 255) + 0.114::DOUBLE * floor(l[i] * 255) + 0.5::DOUBLE) / 255))), 3) AS gray,
round(avg(list_avg(r)), 3) AS red, round(avg(list_avg(g)), 3) AS green, round(avg(list_avg(l)), 3) AS blue FROM c GROUP BY 1""",
    "v20_verdicts": f"""{_STEPS}, r AS (SELECT *, abs(speed - lag(speed) OVER w) AS dv, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY video_id ORDER BY t)), c AS (SELECT video_id, median(speed) AS med, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT video_id, count(*) FILTER (speed > 5 * (med + 1e-6)) = 0 AS ok_jumps, any_value(n) <= 4 OR avg(speed) FILTER (i >= n // 2) <= (avg(speed) FILTER (i < n // 2) + 1e-6) * 1.2 AS friction FROM r JOIN c USING (video_id) GROUP BY 1),
m AS (SELECT video_id, avg(t) AS mid FROM v_traj GROUP BY 1), q AS (SELECT video_id, y, (t - mid) * (t - mid) AS q FROM v_traj JOIN m USING (video_id)),
a AS (SELECT video_id, count(*) AS points, coalesce((count(*) * sum(q * y) - sum(q) * sum(y)) / nullif(count(*) * sum(q * q) - sum(q) * sum(q), 0) > 1e-3, false) AS gravity FROM q GROUP BY 1),
u AS (SELECT video_id, t, vx / (speed + 1e-6) AS ix, vy / (speed + 1e-6) AS iy FROM s), o AS (SELECT *, lead(ix) OVER w AS ox, lead(iy) OVER w AS oy, count(*) OVER (PARTITION BY video_id) AS n FROM u WINDOW w AS (PARTITION BY video_id ORDER BY t)),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ox IS NULL, ix * ox + iy * oy, t) AS rn FROM o), bn AS (SELECT *, (ix + ox) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS nx, (iy + oy) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS ny FROM b WHERE rn = 1),
f AS (SELECT video_id, coalesce(CASE WHEN n > 2 THEN (ix - 2 * (ix * nx + iy * ny) * nx) * ox + (iy - 2 * (ix * nx + iy * ny) * ny) * oy END > 0.7, true) AS reflects FROM bn),
x AS (SELECT *, video_id % 4 AS kind, video_id % 3 > 0 AS mass, (video_id % 10) / 10.0 >= 0.30 AS flow_ok, CASE WHEN video_id % 2 = 0 THEN (video_id % 7) / 7.0::DOUBLE >= 0.50 END AS pose_ok FROM a JOIN k USING (video_id) JOIN f USING (video_id)),
y AS (SELECT *, CASE kind WHEN 0 THEN [gravity, true, ok_jumps] WHEN 1 THEN [friction, reflects, ok_jumps] WHEN 2 THEN [mass, true, true] ELSE [] END || [flow_ok] || CASE WHEN pose_ok IS NULL THEN [] ELSE [pose_ok] END AS checks, kind < 2 AND points < 5 AS short FROM x),
z AS (SELECT *, len(list_filter(checks, lambda c: c)) / len(checks)::DOUBLE AS share FROM y)
SELECT video_id, CASE WHEN kind = 3 THEN NULL WHEN short THEN 0.0 ELSE round(share, 6) END AS score, kind < 3 AND NOT short AND share >= 0.66 AS passed, (CASE WHEN kind = 3 THEN 0 WHEN short THEN 1 ELSE len(checks) - len(list_filter(checks, lambda c: c)) END)::INT AS n_violations,
(CASE WHEN kind < 3 AND NOT short THEN len(checks) ELSE 0 END)::INT AS n_checks, CASE kind WHEN 3 THEN 'intractable' WHEN 2 THEN 'heuristic' ELSE 'analytic' END AS verifier_type FROM z""",
    "a10_clip_quality": f"""{_CLIPS} SELECT video_id, round(subject_consistency, 5) AS subject_consistency, round(background_consistency, 5) AS background_consistency, round(motion_smoothness, 5) AS motion_smoothness, round(aesthetic_quality, 5) AS aesthetic_quality,
round(imaging_quality, 5) AS imaging_quality, round(depth_stability, 5) AS depth_stability, round(coalesce(blob_count_stability, 1), 5) AS blob_count_stability, round(mass_drift, 5) AS mass_drift FROM q JOIN dw USING (video_id) JOIN px USING (video_id) LEFT JOIN bl USING (video_id)""",
    "v20_clip_verdicts": f"{_GENERATION} SELECT model_id, item_id, video_id, round(quality, 5) AS quality, round(verdict, 5) AS verdict, passed, judge_type, uncertainty, n_violations FROM g",
    "a11_clip_generation": f"""{_GENERATION}, su AS (SELECT model_id, CASE WHEN grouping(domain) = 1 AND grouping(kind) = 1 THEN 'overall' WHEN grouping(kind) = 1 THEN 'domain' ELSE 'physics' END AS scope, coalesce(domain::VARCHAR, kind) AS scope_value,
avg(quality) AS quality_score, avg(verdict) AS domain_score, count(*) FILTER (verdict IS NULL) AS intractable_items, count(*) AS n FROM g GROUP BY GROUPING SETS ((model_id), (model_id, domain), (model_id, kind)))
SELECT model_id, scope, scope_value, round(quality_score, 5) AS quality_score, round(CASE WHEN scope = 'overall' THEN coalesce(domain_score, 0) ELSE domain_score END, 5) AS domain_score, intractable_items, n, CASE WHEN scope = 'overall' THEN round(0.3::DOUBLE * quality_score + 0.7::DOUBLE * coalesce(domain_score, 0), 5) END AS overall FROM su""",
    "an3_asked_prior": """t AS (SELECT item_id, lang AS domain, (item_id % 7 <> 0 AND (length(prompt) + unnest(range(0, 3))) % 4 = item_id % 4)::INT AS ok FROM v_prompts)
SELECT item_id, domain, round(avg(ok), 6) AS prior, avg(ok) < 0.6 AS passed FROM t GROUP BY 1, 2""",
    "jg1_asked_judges": """k AS (SELECT item_id, unnest(range(0, 3)) AS k, prompt FROM v_prompts), s AS (SELECT item_id, ((length(prompt) * (k + 1)) % 10) / 10.0::DOUBLE AS s FROM k WHERE k < 2 OR item_id % 7 <> 0)
SELECT item_id, round(avg(s), 6) AS score, count(*) AS n_judges, round(stddev_pop(s), 9) >= 0.25 AS flagged, CASE WHEN round(stddev_pop(s), 9) >= 0.25 THEN 'high' ELSE 'medium' END AS uncertainty FROM s GROUP BY 1""",
    "a12_clip_conditional": clip_sql.CONDITIONAL,
    "v4_imaging": clip_sql.IMAGING,
    "v7_depth_stability": clip_sql.DEPTH,
    "v8_blob_stability": clip_sql.BLOBS,
    "v10_centroids": clip_sql.CENTROIDS,
    "v17_vorticity": clip_sql.VORTICITY,
    "v21_blur_ssim": clip_sql.ssim(_TWO),
    "p6_sample_frames": """t AS (SELECT video_id, count(*) AS n FROM v_features GROUP BY 1), k AS (SELECT video_id, n, unnest(range(0, 8)) AS i FROM t),
s AS (SELECT DISTINCT video_id, floor(i * ((n - 1) / 7.0::DOUBLE))::BIGINT AS frame_idx FROM k WHERE n > 8 UNION SELECT v.video_id, frame_idx FROM v_features v JOIN t USING (video_id) WHERE n <= 8) SELECT video_id, frame_idx FROM s""",
}


def _statement(sql: str) -> str:
    """Steps named in the text follow the views in one WITH; a text that begins with RECURSIVE makes it a recursive one."""
    if sql.startswith("RECURSIVE "):
        return _statement(sql.removeprefix("RECURSIVE ")).replace("WITH ", "WITH RECURSIVE ", 1)
    head = sql.lstrip()
    text = with_views(head)
    if head.upper().startswith("SELECT"):
        return text
    return text.replace("\n" + head, ",\n" + head, 1) if text.startswith("WITH") else "WITH " + head


ORACLE_SQL = {name: _statement(sql) for name, sql in _SQL.items()}
