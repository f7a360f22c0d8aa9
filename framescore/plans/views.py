"""Views that give each operator a table at any scale. The SQL runs in Spark and in DuckDB; {names} are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_u_items": """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS item_id,
       CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey END AS chain_id,
       l_linenumber - 1 AS hop_index, l_orderkey % 8 AS domain, l_orderkey % 6 AS physics_category,
       CAST((l_orderkey + l_linenumber) % 4 AS INT) AS answer_idx,
       (l_orderkey % 11) / 10.0e0 AS language_prior_score, (l_orderkey % 7) / 6.0e0 AS annotator_agreement
FROM {lineitem}""",
    "v_u_preds": """
SELECT l_suppkey % 5 AS model_id, l_orderkey * 10 + l_linenumber AS item_id,
       CAST(CASE WHEN l_quantity <= 35 THEN (l_orderkey + l_linenumber) % 4 ELSE l_partkey % 4 END AS INT) AS answer_idx,
       row_number() OVER (PARTITION BY l_suppkey % 5, l_orderkey * 10 + l_linenumber
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
FROM {lineitem}""",
    "v_verdicts": """
SELECT l_orderkey AS item_id, l_linenumber AS judge,
       CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(l_discount * 10 AS DOUBLE) END AS score, l_returnflag AS violation,
       l_orderkey % 6 AS physics_category, l_orderkey % 8 AS domain
FROM {lineitem}""",
    "v_item_scores": """
SELECT l_partkey * 10 + l_linenumber AS item_id, l_suppkey AS model_id, CAST(1.0 - l_discount * 5 AS DOUBLE) AS score
FROM {lineitem}""",
    "v_history": "SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DOUBLE) / 500000.0e0 AS quality_index FROM {orders}",
    "v_annotations": """
SELECT l_partkey * 10 + l_linenumber AS item_id,
       CASE WHEN l_quantity <= 30 THEN 0 ELSE l_orderkey % 4 END AS vote,
       row_number() OVER (PARTITION BY l_partkey * 10 + l_linenumber
           ORDER BY l_shipdate, l_orderkey, l_suppkey, l_extendedprice) AS arrival
FROM {lineitem}""",
    "v_kappa": "SELECT doc_id AS item_id, quality AS a, toxic AS b FROM {labels}",
    "v_trials": "SELECT user_id AS item_id, event_id AS trial, event_id % 4 AS pred, user_id % 4 AS answer_idx, user_id % 8 AS domain FROM {events}",
    "v_queue": "SELECT user_id AS task_id, event_type AS annotator_id, CAST(event_id % 4 AS INT) AS answer_idx, ts AS arrival FROM {events}",
    "v_traj": """
SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
       CAST(value AS DOUBLE) AS x, CAST(event_id % 97 AS DOUBLE) AS y
FROM {events}""",
    "v_features": "SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding AS feature FROM {embeddings}",
    "v_frames": "SELECT CAST(floor(vec_id / 25) AS BIGINT) AS video_id, CAST(vec_id % 25 AS INT) AS frame_idx, embedding AS feature FROM {embeddings}",
    "v_g_preds": "SELECT DISTINCT CAST(floor(vec_id / 25) AS BIGINT) % 3 AS model_id, CAST(floor(vec_id / 75) AS BIGINT) AS item_id, CAST(floor(vec_id / 25) AS BIGINT) AS video_id FROM {embeddings}",
    "v_g_items": """
SELECT item_id, CONCAT('d', item_id % 8) AS domain, CASE item_id % 4 WHEN 0 THEN 'rigid_body' WHEN 1 THEN 'contact' WHEN 2 THEN 'fluid' ELSE 'thermal' END AS physics_category,
       CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1.0e0 ELSE -1.0e0 END AS gravity_y, CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 12 END AS expected_collisions
FROM (SELECT DISTINCT CAST(floor(vec_id / 75) AS BIGINT) AS item_id FROM {embeddings}) i""",
    "v_cf": """
SELECT d.doc_id AS item_id, d.text AS prediction, b.text AS counterfactual_outcome, d.lang AS domain, d.source AS physics_category,
       CASE d.doc_id % 4 WHEN 0 THEN 'more' WHEN 1 THEN 'less' WHEN 2 THEN 'up' ELSE 'down' END AS direction_keyword,
       CASE d.doc_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'much_more' ELSE 'slightly_less' END AS magnitude_bin
FROM {documents} d JOIN {benchmark} b ON d.doc_id % (SELECT count(*) FROM {benchmark}) = b.item_id""",
    "v_track_scores": """
SELECT c.c_nationkey AS model_id,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'G.domain_score' WHEN '2-HIGH' THEN 'C.blur_ssim'
            WHEN '3-MEDIUM' THEN 'U.accuracy' WHEN '5-LOW' THEN 'U.multihop_chain_accuracy'
            ELSE 'CF.counterfactual_delta_accuracy' END AS metric,
       avg(CAST(o.o_totalprice AS DOUBLE)) / 500000.0e0 AS value
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    "v_dv": """
SELECT c_nationkey AS model_id, c_mktsegment AS task, avg(CAST(c_acctbal AS DOUBLE)) / 10000.0e0 AS rate
FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1, 2""",
    "v_pool": "SELECT p_partkey AS item_id, p_type AS domain, p_size % 6 AS physics_category FROM {part}",
    "v_robust": "SELECT l_orderkey AS item_id, l_linenumber AS level, avg(1.0e0 - CAST(l_discount AS DOUBLE)) AS fidelity FROM {lineitem} GROUP BY 1, 2",
    "v_replies": "SELECT event_id, concat('Score ', event_type, ': ', props, ' end') AS reply FROM {events}",
    "v_drafts": """
SELECT event_id, concat('Draft: {{"question": "', event_type, '", "choices": ["a", "b", "c"', CASE WHEN event_id % 5 = 0 THEN '' ELSE ', "d"' END, '], "answer_idx": ', CAST(event_id % 6 AS STRING), '}} end') AS reply,
       CASE event_id % 4 WHEN 0 THEN 'robotics' WHEN 1 THEN 'industrial' WHEN 2 THEN 'laboratory' ELSE 'kitchen' END AS domain
FROM {events}""",
    "v_drawn_items": """
SELECT CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id AS STRING) END AS item_id, source AS video_path,
       CASE doc_id % 4 WHEN 0 THEN 'robotics' WHEN 1 THEN 'construction' WHEN 2 THEN 'agriculture' ELSE 'kitchen' END AS domain,
       CASE doc_id % 3 WHEN 0 THEN 'fluid' WHEN 1 THEN 'contact' ELSE 'magic' END AS physics_category, lang AS question,
       doc_id % 5 AS n_choices, CAST(doc_id % 7 - 1 AS INT) AS answer_idx, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS requires_temporal,
       (doc_id % 13) / 10.0e0 AS language_prior_score, (doc_id % 25) / 10.0e0 - 1.2e0 AS annotator_agreement, doc_id
FROM {documents}""",
    "v_prompts": "SELECT doc_id AS item_id, text AS prompt, source, lang FROM {documents}",
    "v_responses": """
SELECT l_suppkey AS model_id, l_partkey AS item_id, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS correct
FROM {lineitem} GROUP BY 1, 2""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of ``sf_dir``, reading only those it names."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names in front."""
    used = [v for v in VIEWS if v in sql]
    tables = {t: t for t in TABLES}
    return ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**tables)})" for v in used) + "\n" if used else "") + sql
