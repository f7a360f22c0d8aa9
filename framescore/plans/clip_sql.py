"""DuckDB SQL from 8 x 8 frames to quality, verdicts and the generation track, from the definitions."""

from __future__ import annotations

import numpy as np

from framescore.operators.video.kernels import gaussian, pair_indices

UNIT = "sqrt(list_dot_product({0}, {0})) + 1e-8"
STEPS = """d AS (SELECT video_id, t, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM v_traj WINDOW w AS (PARTITION BY video_id ORDER BY t)),
s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM d WHERE vx IS NOT NULL)"""
_PAIRS = str([[int(a) + 1, int(b) + 1] for a, b in zip(*pair_indices(64))])


def _cosines(x: str) -> str:
    """Half the cosines of ``x`` with the first frame's and with the one before."""
    own, first, before = UNIT.format(x), UNIT.format("f" + x), UNIT.format("p" + x)
    return f"0.5 * (list_dot_product(f{x}, {x}) / ({first}) + list_dot_product(p{x}, {x}) / ({before})) / ({own})"


#: Clips of v_frames to a row a clip: quality (q), pixels (dw, px, bl), the track (k, a, rf), flow (fs, fl), edges (ed), pose (po).
CLIPS = f"""f AS (SELECT video_id, frame_idx, feature::DOUBLE[] AS e, list_transform(feature, lambda x: floor((x::DOUBLE + 1) / 2 * 255)::INT) AS r FROM v_frames),
c AS (SELECT *, flatten(list_transform(range(0, 64), lambda i: [r[i + 1], r[64 - i], r[(i + 7) % 64 + 1]])) AS p FROM f),
h AS (SELECT video_id, frame_idx, p, list_transform(range(0, 64), lambda i: (299 * p[3 * i + 1] + 587 * p[3 * i + 2] + 114 * p[3 * i + 3] + 500) // 1000) AS g,
  list_transform(range(0, 64), lambda i: p[3 * i + 1] + p[3 * i + 2] + p[3 * i + 3]) AS l, list_transform(range(0, 3), lambda k: list_avg(list_transform(range(0, 64), lambda i: p[3 * i + k + 1])) / 255) AS co, list_transform(p, lambda x: x / 255.0::DOUBLE) AS fl FROM c),
n AS (SELECT *, lag(p) OVER w AS pp, lead(p) OVER w AS np, lag(g) OVER w AS pg, lag(co) OVER w AS pco, lag(fl) OVER w AS pfl, first_value(co) OVER w AS fco, first_value(fl) OVER w AS ffl,
  list_transform(range(0, 64), lambda i: l[i + 1] // 3) AS s FROM h WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
la AS (SELECT *, list_transform(range(0, 64), lambda i: s[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + s[CASE WHEN i > 55 THEN i - 8 ELSE i + 8 END + 1] + s[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1]
  + s[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * s[i + 1]) AS lap FROM n), un AS (SELECT *, {_cosines("co")} AS sc, {_cosines("fl")} AS sp FROM la),
q AS (SELECT video_id, coalesce((avg(sc) FILTER (frame_idx > 0) + 1) / 2, 1.0) AS subject_consistency, coalesce((avg(sp) FILTER (frame_idx > 0) + 1) / 2, 1.0) AS background_consistency,
  coalesce(greatest(0.0, 1 - avg(CASE WHEN frame_idx % 2 = 1 AND np IS NOT NULL THEN list_avg(list_transform(range(1, 193), lambda i: abs(pp[i] + np[i] - 2 * p[i]))) / 510 END)), 1.0) AS motion_smoothness,
  least(1.0, avg(list_stddev_pop(l) / 765) * 2) AS aesthetic_quality, least(1.0, avg(list_var_pop(lap)) / 500) AS imaging_quality FROM un GROUP BY 1),
dp AS (SELECT video_id, k[1] * 100 + k[2] AS pair, sign(g[k[1]] - g[k[2]]) AS s FROM (SELECT video_id, g, unnest({_PAIRS}) AS k FROM h)),
dw AS (SELECT video_id, sum(same * times) / sum(times) AS depth_stability FROM (SELECT video_id, pair, (count(DISTINCT s) = 1)::INT AS same, count(*)::DOUBLE AS times FROM dp GROUP BY 1, 2) GROUP BY 1),
mo AS (SELECT video_id, sum(list_sum(g))::DOUBLE AS s, sum(list_dot_product(g::DOUBLE[], g::DOUBLE[])) AS sq, sum(64) AS n FROM h GROUP BY 1),
ar AS (SELECT video_id, len(list_filter(g, lambda x: x > s / n + sqrt(greatest(0, n * sq - s * s)) / n)) AS area FROM h JOIN mo USING (video_id)),
px AS (SELECT video_id, coalesce((max(area) - min(area)) / nullif(max(area), 0)::DOUBLE, 0) AS mass_drift FROM ar GROUP BY 1),
df AS (SELECT video_id, frame_idx, list_transform(range(1, 65), lambda i: abs(g[i] / 255.0::DOUBLE - pg[i] / 255.0::DOUBLE)) AS d FROM n WHERE pg IS NOT NULL),
mk AS (SELECT video_id, frame_idx, list_max(d) < 1e-3 AS still, list_filter(range(0, 64), lambda i: d[i + 1] > list_avg(d) + list_stddev_pop(d)) AS m FROM df),
bl AS (SELECT video_id, CASE WHEN max(len(m)) < 32 THEN 1.0 END AS blob_count_stability FROM mk GROUP BY 1),
ce AS (SELECT *, CASE WHEN still OR len(m) < 5 THEN NULL ELSE list_avg(list_transform(m, lambda i: i % 8)) END AS cx, CASE WHEN still OR len(m) < 5 THEN NULL ELSE list_avg(list_transform(m, lambda i: i // 8)) END AS cy FROM mk),
ca AS (SELECT *, last_value(cx IGNORE NULLS) OVER w AS kx, last_value(cy IGNORE NULLS) OVER w AS ky, CASE WHEN first_value(still) OVER w THEN 0.0 ELSE 4.0 END AS z FROM ce WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
traj AS (SELECT video_id, frame_idx - 1 AS t, coalesce(kx, z) AS x, coalesce(ky, z) AS y FROM ca),
{STEPS.replace("v_traj", "traj")}, ac AS (SELECT *, abs(speed - lag(speed) OVER w) AS dv, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY video_id ORDER BY t)), md AS (SELECT video_id, median(speed) AS med, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT video_id, count(*) FILTER (dv > 0.6 * (med + 1e-6)) AS spikes, count(*) FILTER (speed > 5 * (med + 1e-6)) AS jumps,
  any_value(n) <= 4 OR avg(speed) FILTER (i >= n // 2) <= (avg(speed) FILTER (i < n // 2) + 1e-6) * 1.2 AS friction FROM ac JOIN md USING (video_id) GROUP BY 1),
mi AS (SELECT video_id, avg(t) AS mid FROM traj GROUP BY 1), qu AS (SELECT video_id, y, (t - mid) * (t - mid) AS q FROM traj JOIN mi USING (video_id)),
a AS (SELECT video_id, count(*) AS points, (count(*) * sum(q * y) - sum(q) * sum(y)) / nullif(count(*) * sum(q * q) - sum(q) * sum(q), 0) AS a FROM qu GROUP BY 1),
u AS (SELECT video_id, t, vx / (speed + 1e-6) AS ix, vy / (speed + 1e-6) AS iy FROM s), o AS (SELECT *, lead(ix) OVER w AS ox, lead(iy) OVER w AS oy, count(*) OVER (PARTITION BY video_id) AS n FROM u WINDOW w AS (PARTITION BY video_id ORDER BY t)),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ox IS NULL, ix * ox + iy * oy, t) AS rn FROM o),
bn AS (SELECT *, (ix + ox) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS nx, (iy + oy) / (sqrt((ix + ox) ** 2 + (iy + oy) ** 2) + 1e-6) AS ny FROM b WHERE rn = 1),
rf AS (SELECT video_id, coalesce(CASE WHEN n > 2 THEN (ix - 2 * (ix * nx + iy * ny) * nx) * ox + (iy - 2 * (ix * nx + iy * ny) * ny) * oy END > 0.7, true) AS reflects FROM bn),
fi AS (SELECT video_id, frame_idx, list_transform(e, lambda x: 10 * x) AS u, list_reverse(e) AS v FROM f WHERE frame_idx > 0), fp AS (SELECT *, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM fi WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
fs AS (SELECT video_id, coalesce(1 / (1 + avg(list_avg(list_transform(range(1, 65), lambda i: sqrt((u[i] - pu[i]) ** 2 + (v[i] - pv[i]) ** 2)))) FILTER (pu IS NOT NULL)), 1.0) AS flow_smoothness FROM fp GROUP BY 1),
cu AS (SELECT video_id, unnest(list_transform(range(1, 65), lambda i: abs((u[CASE WHEN i > 56 THEN i ELSE i + 8 END] - u[CASE WHEN i < 9 THEN i ELSE i - 8 END]) / CASE WHEN i > 56 OR i < 9 THEN 1 ELSE 2 END
  - (v[CASE WHEN i % 8 = 0 THEN i ELSE i + 1 END] - v[CASE WHEN i % 8 = 1 THEN i ELSE i - 1 END]) / CASE WHEN i % 8 < 2 THEN 1 ELSE 2 END))) AS c FROM fi),
fl AS (SELECT video_id, quantile_cont(c, 0.99) < 5 AS curl_ok FROM cu GROUP BY 1),
ed AS (SELECT video_id, stddev_pop(m) < 20 AS surface_ok FROM (SELECT video_id, list_avg(list_transform(e, lambda x: CASE WHEN x > 0.1::DOUBLE THEN 255.0 ELSE 0.0 END)) AS m FROM f) GROUP BY 1),
sk(i, j) AS (VALUES (11, 13), (13, 15), (12, 14), (14, 16), (23, 25), (25, 27), (24, 26), (26, 28), (11, 12), (23, 24), (11, 23), (12, 24)),
bo AS (SELECT video_id, i, j, sqrt((e[2 * i + 1] - e[2 * j + 1]) ** 2 + (e[2 * i + 2] - e[2 * j + 2]) ** 2) AS size FROM f CROSS JOIN sk WHERE video_id % 2 = 0),
po AS (SELECT video_id, 1 / (1 + avg(cov)) AS pose_validity FROM (SELECT video_id, CASE WHEN count(*) >= 2 AND avg(size) >= 1e-6 THEN stddev_pop(size) / avg(size) END AS cov FROM bo GROUP BY video_id, i, j) GROUP BY 1)"""

GENERATION = f"""{CLIPS}, pr AS (SELECT video_id, e AS vec FROM f WHERE frame_idx = 3 AND video_id % 3 <> 0),
ov AS (SELECT video_id, CASE WHEN count(vec) = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, (avg(list_dot_product(e, vec) / ({UNIT.format("e")}) / ({UNIT.format("vec")})) + 1) / 2)) END AS overall_consistency FROM f LEFT JOIN pr USING (video_id) GROUP BY 1),
x AS (SELECT v_g_preds.*, domain, physics_category AS kind, (subject_consistency + background_consistency + motion_smoothness + aesthetic_quality + imaging_quality + overall_consistency) / 6 AS quality, coalesce(points, 0) AS points,
  coalesce(sign(a) * sign(coalesce(gravity_y, 1)) > 0 AND abs(a) > 1e-3, false) AS gravity, abs(coalesce(spikes, 0) - coalesce(expected_collisions, spikes, 0)) <= 1 AS hits, coalesce(jumps, 0) = 0 AS ok_jumps,
  coalesce(friction, true) AS friction, coalesce(reflects, true) AS reflects, mass_drift < 0.5 AS mass, coalesce(curl_ok, true) AS curl_ok, coalesce(surface_ok, true) AS surface_ok,
  [coalesce(flow_smoothness, 1) >= 0.30, depth_stability >= 0.55, coalesce(blob_count_stability, 1) >= 0.50] || CASE WHEN pose_validity IS NULL THEN [] ELSE [pose_validity >= 0.50] END AS extra
  FROM v_g_preds JOIN v_g_items USING (item_id) JOIN q USING (video_id) JOIN ov USING (video_id) JOIN dw USING (video_id) JOIN px USING (video_id) LEFT JOIN bl USING (video_id) LEFT JOIN k USING (video_id) LEFT JOIN a USING (video_id)
  LEFT JOIN rf USING (video_id) LEFT JOIN fs USING (video_id) LEFT JOIN fl USING (video_id) LEFT JOIN ed USING (video_id) LEFT JOIN po USING (video_id)),
y AS (SELECT *, CASE kind WHEN 'rigid_body' THEN [gravity, hits, ok_jumps] WHEN 'contact' THEN [friction, reflects, ok_jumps] WHEN 'fluid' THEN [mass, curl_ok, surface_ok] ELSE [] END || extra AS checks, kind IN ('rigid_body', 'contact') AND points < 5 AS short FROM x),
z AS (SELECT *, len(list_filter(checks, lambda c: c)) / len(checks)::DOUBLE AS share, kind <> 'thermal' AS own FROM y),
pa AS (SELECT judge % 3 AS model_id, item_id, median(score) AS other, CASE WHEN count(score) < 2 OR round(coalesce(stddev_pop(score), 0), 9) >= 0.25 THEN 'high' ELSE 'medium' END AS unsure, (count(DISTINCT violation) FILTER (score IS NOT NULL))::INT AS n_other FROM v_verdicts GROUP BY 1, 2),
g AS (SELECT z.*, CASE WHEN own AND short THEN 0.0 WHEN own THEN share ELSE other END AS verdict, own AND NOT short AND share >= 0.66 AS passed, CASE WHEN own THEN 'analytic' WHEN pa.item_id IS NOT NULL THEN 'ensemble' ELSE 'none' END AS judge_type,
  CASE WHEN own THEN CASE WHEN kind = 'fluid' THEN 'medium' END ELSE coalesce(unsure, 'high') END AS uncertainty, (CASE WHEN own AND short THEN 1 WHEN own THEN len(checks) - len(list_filter(checks, lambda c: c)) ELSE coalesce(n_other, 0) END)::INT AS n_violations
  FROM z LEFT JOIN pa ON pa.model_id = z.model_id AND pa.item_id = z.item_id)"""


# --- single measures of gray frames g (lists of 64 values) --------------------------------------------

_LAPLACE = """list_transform(range(0, 64), lambda i: s[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + s[CASE WHEN i > 55 THEN i - 8 ELSE i + 8 END + 1] + s[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1]
  + s[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * s[i + 1])"""
_GRAY = "f AS (SELECT video_id, frame_idx, list_transform(feature, lambda x: (x::DOUBLE + 1) / 2) AS g FROM v_features)"
IMAGING = f"""{_GRAY}, s AS (SELECT video_id, list_transform(g, lambda x: floor(x * 255)) AS s FROM f)
SELECT video_id, round(least(1.0, greatest(0.0, avg(list_var_pop({_LAPLACE})) / 500)), 6) AS imaging_quality FROM s GROUP BY 1"""
DEPTH = f"""{_GRAY}, p AS (SELECT video_id, g, unnest({_PAIRS}) AS k FROM f), d AS (SELECT video_id, k[1] AS i, k[2] AS j, sign(g[k[1]] - g[k[2]]) AS s, count(*) OVER (PARTITION BY video_id, k[1], k[2]) AS times FROM p),
e AS (SELECT video_id, i, j, (count(DISTINCT s) = 1)::INT AS same, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2, 3) SELECT video_id, round(sum(same * n) / sum(n), 6) AS depth_stability FROM e GROUP BY 1"""
CENTROIDS = f"""{_GRAY}, n AS (SELECT *, lag(g) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM f), d AS (SELECT video_id, frame_idx, list_transform(range(1, 65), lambda i: abs(g[i] - p[i])) AS d FROM n WHERE p IS NOT NULL),
m AS (SELECT video_id, frame_idx, list_max(d) < 1e-3 AS still, list_filter(range(0, 64), lambda i: d[i + 1] > list_avg(d) + list_stddev_pop(d)) AS m FROM d),
c AS (SELECT *, CASE WHEN still OR len(m) < 5 THEN NULL ELSE list_avg(list_transform(m, lambda i: i % 8)) END AS cx, CASE WHEN still OR len(m) < 5 THEN NULL ELSE list_avg(list_transform(m, lambda i: i // 8)) END AS cy FROM m),
k AS (SELECT *, row_number() OVER w - 1 AS t, last_value(cx IGNORE NULLS) OVER w AS kx, last_value(cy IGNORE NULLS) OVER w AS ky, CASE WHEN first_value(still) OVER w THEN 0.0 ELSE 4.0 END AS z FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT video_id, t, round(coalesce(kx, z), 6) AS x, round(coalesce(ky, z), 6) AS y FROM k"""
VORTICITY = """f AS (SELECT video_id, list_transform(feature, lambda x: 10 * x::DOUBLE) AS u, list_reverse(feature::DOUBLE[]) AS v FROM v_features),
c AS (SELECT video_id, unnest(list_transform(range(1, 65), lambda i: abs((u[CASE WHEN i > 56 THEN i ELSE i + 8 END] - u[CASE WHEN i < 9 THEN i ELSE i - 8 END]) / CASE WHEN i > 56 OR i < 9 THEN 1 ELSE 2 END
  - (v[CASE WHEN i % 8 = 0 THEN i ELSE i + 1 END] - v[CASE WHEN i % 8 = 1 THEN i ELSE i - 1 END]) / CASE WHEN i % 8 < 2 THEN 1 ELSE 2 END))) AS c FROM f)
SELECT video_id, round(quantile_cont(c, 0.99), 6) AS curl_p99, quantile_cont(c, 0.99) < 5 AS curl_ok FROM c GROUP BY 1"""
#: Blobs of two pixels or more that touch, also at corners.
BLOBS = f"""RECURSIVE {_GRAY}, n AS (SELECT *, lag(g) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM f), d AS (SELECT video_id, frame_idx, list_transform(range(1, 65), lambda i: abs(g[i] - p[i])) AS d FROM n WHERE p IS NOT NULL),
m AS (SELECT video_id, frame_idx, CASE WHEN list_max(d) < 1e-3 THEN [] ELSE list_filter(range(0, 64), lambda i: d[i + 1] > list_avg(d) + list_stddev_pop(d)) END AS m FROM d), p AS (SELECT video_id, frame_idx, unnest(m) AS i FROM m),
e AS (SELECT a.video_id, a.frame_idx, a.i, b.i AS j FROM p a JOIN p b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx WHERE abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
r AS (SELECT * FROM e UNION SELECT r.video_id, r.frame_idx, r.i, e.j FROM r JOIN e ON r.video_id = e.video_id AND r.frame_idx = e.frame_idx AND r.j = e.i),
c AS (SELECT video_id, frame_idx, i, min(j) AS root FROM r GROUP BY 1, 2, 3), s AS (SELECT video_id, frame_idx, root, count(*) AS n FROM c GROUP BY 1, 2, 3), k AS (SELECT video_id, frame_idx, count(*) FILTER (n >= 2) AS k FROM s GROUP BY 1, 2)
SELECT video_id, round(1 / (1 + coalesce(stddev_pop(coalesce(k, 0)) FILTER (m.video_id IS NOT NULL), 0)), 6) AS blob_count_stability FROM f LEFT JOIN m USING (video_id, frame_idx) LEFT JOIN k USING (video_id, frame_idx) GROUP BY 1"""
#: The blur is linear: the weight of each of eight places on a line in each blurred one.
_BLUR = str([[float(gaussian(np.outer(np.eye(8)[j], np.ones(8)), 2.0)[i, 4]) for j in range(8)] for i in range(8)])


def _blurred(x: str) -> str:
    rows = f"list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda j: k[i // 8 + 1][j + 1] * {x}[8 * j + i % 8 + 1])))"
    return f"list_transform([{rows}], lambda r: list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 8), lambda j: k[i % 8 + 1][j + 1] * r[8 * (i // 8) + j + 1]))))[1]"


def ssim(pairs: str) -> str:
    """Mean similarity of blurred frames of ``pairs``: tables with a last one named two (pair, a, b)."""
    window = lambda x: f"list_transform(range(0, 49), lambda q: {x}[8 * (q // 7 + w // 2) + q % 7 + w % 2 + 1])"
    return f"""{pairs}, k AS (SELECT {_BLUR} AS k), bl AS (SELECT pair, {_blurred("a")} AS a, {_blurred("b")} AS b FROM two CROSS JOIN k),
wi AS (SELECT pair, row_number() OVER () AS frame, a, b, unnest(range(0, 4)) AS w FROM bl), wx AS (SELECT pair, frame, {window("a")} AS x, {window("b")} AS y FROM wi),
mo AS (SELECT pair, frame, list_avg(x) AS mx, list_avg(y) AS my, list_var_samp(x) AS vx, list_var_samp(y) AS vy, 49 / 48.0::DOUBLE * (list_dot_product(x, y) / 49 - list_avg(x) * list_avg(y)) AS c FROM wx),
si AS (SELECT pair, frame, avg((2 * mx * my + 0.0001::DOUBLE) * (2 * c + 0.0009::DOUBLE) / ((mx * mx + my * my + 0.0001::DOUBLE) * (vx + vy + 0.0009::DOUBLE))) AS s FROM mo GROUP BY 1, 2)
SELECT pair, round(least(1.0, greatest(0.0, avg(s))), 5) AS blur_ssim FROM si GROUP BY 1"""


_SIMILAR = ssim("")[2:].rsplit("\nSELECT", 1)[0]
CONDITIONAL = f"""f AS (SELECT video_id, frame_idx, video_id // 4 AS item_id, feature AS e, list_transform(feature, lambda x: floor((x::DOUBLE + 1) / 2 * 255)::INT) AS r FROM v_frames WHERE frame_idx < 20 + video_id % 3),
h AS (SELECT *, flatten(list_transform(range(0, 64), lambda i: [r[i + 1], r[64 - i], r[(i + 7) % 64 + 1]])) AS p, list_transform(range(0, 64), lambda i: (299 * r[i + 1] + 587 * r[64 - i] + 114 * r[(i + 7) % 64 + 1] + 500) // 1000) AS g8 FROM f),
g AS (SELECT *, list_transform(g8, lambda x: x / 255.0::DOUBLE) AS g FROM h),
two AS (SELECT x.video_id AS pair, x.g AS a, y.g AS b, x.g8 AS a8, y.g8 AS b8, x.e AS ae, y.e AS be FROM g x JOIN g y ON y.video_id = 4 * x.item_id - 1 AND x.frame_idx = y.frame_idx WHERE x.item_id > 0),
{_SIMILAR}, sm AS (SELECT pair, least(1.0, greatest(0.0, avg(s))) AS blur_ssim FROM si GROUP BY 1),
co AS (SELECT pair, len(list_filter(range(1, 65), lambda i: ae[i] > 0.1::FLOAT AND be[i] > 0.1::FLOAT)) AS tp, len(list_filter(range(1, 65), lambda i: (ae[i] > 0.1::FLOAT) <> (be[i] > 0.1::FLOAT))) AS one, list_transform(range(1, 65), lambda i: ln(a[i] + 1e-3) - ln(b[i] + 1e-3)) AS d,
  len(list_filter(range(1, 65), lambda i: a8[i] > 128 AND b8[i] > 128)) AS i1, len(list_filter(range(1, 65), lambda i: a8[i] > 128 OR b8[i] > 128)) AS u1, len(list_filter(range(1, 65), lambda i: a8[i] <= 128 AND b8[i] <= 128)) AS i0, len(list_filter(range(1, 65), lambda i: a8[i] <= 128 OR b8[i] <= 128)) AS u0 FROM two),
cm AS (SELECT pair, avg(CASE WHEN 2 * tp + one = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + one) END) AS edge_f1, 1 / (1 + avg(sqrt(greatest(0, list_avg(list_transform(d, lambda x: x * x)) - list_avg(d) ** 2)))) AS depth_si_rmse,
  avg((coalesce(i1::DOUBLE / nullif(u1, 0), 0) + coalesce(i0::DOUBLE / nullif(u0, 0), 0)) / ((u1 > 0)::INT + (u0 > 0)::INT)) AS mask_miou FROM co GROUP BY 1),
le AS (SELECT pair, pair // 4 AS item_id, pair % 4 AS level, blur_ssim, lead(blur_ssim) OVER w AS nf, lead(pair % 4) OVER w AS nl FROM sm WINDOW w AS (PARTITION BY pair // 4 ORDER BY pair)),
ro AS (SELECT item_id, least(1.0, greatest(0.0, CASE WHEN max(level) > min(level) THEN sum((blur_ssim + nf) / 2 * (nl - level)) / (max(level) - min(level)) ELSE max(blur_ssim) END)) AS robustness FROM le GROUP BY 1),
dv AS (SELECT item_id, least(1.0, avg(d)) AS diversity FROM (SELECT x.item_id, x.video_id, y.video_id AS other, avg(list_avg(list_transform(range(1, 193), lambda i: abs(x.p[i] - y.p[i]))) / 255) AS d
  FROM h x JOIN h y ON x.item_id = y.item_id AND x.frame_idx = y.frame_idx AND x.video_id < y.video_id GROUP BY 1, 2, 3) GROUP BY 1)
SELECT sm.pair // 4 % 2 AS model_id, sm.pair // 4 AS item_id, 'd' || (sm.pair // 4 % 3) AS domain, round(blur_ssim, 5) AS blur_ssim, round(edge_f1, 5) AS edge_f1, round(depth_si_rmse, 5) AS depth_si_rmse, round(mask_miou, 5) AS mask_miou,
round(0.5 * blur_ssim + 0.5 * edge_f1, 5) AS visual, round(coalesce(diversity, 0), 5) AS diversity, round(robustness, 5) AS robustness FROM sm JOIN cm USING (pair) JOIN ro ON ro.item_id = sm.pair // 4 LEFT JOIN dv ON dv.item_id = sm.pair // 4 WHERE sm.pair % 4 = 0"""
