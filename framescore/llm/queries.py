"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from framescore.llm.contamination import op8_template_windows
from framescore.llm.divergence import op12_divergence_cube
from framescore.llm.embeddings import op5_pca_tiles
from framescore.llm.language import op3_kneser_ney
from framescore.llm.licences import op1_rare_token_index
from framescore.llm.lm import op2_katz_backoff
from framescore.llm.merkle import op11_merkle_manifest
from framescore.llm.ngram_join import op4_bitmap_tiles
from framescore.llm.packing import op9_nnls_packing
from framescore.llm.pii import op6_weak_supervision
from framescore.llm.substrings import op7_phrase_automata
from framescore.llm.sharding import op10_two_pass_shuffle
from framescore.llm.toxicity import op13_subword_bags

QUERIES = {f.__name__: f for f in (op1_rare_token_index, op2_katz_backoff, op3_kneser_ney, op4_bitmap_tiles, op5_pca_tiles, op6_weak_supervision, op7_phrase_automata, op8_template_windows, op9_nnls_packing, op10_two_pass_shuffle, op11_merkle_manifest, op12_divergence_cube, op13_subword_bags)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Everything that links lead to, and the smallest of it.
_REACH = "r(a, b) AS (SELECT {0}, {0} FROM {1} UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS {0}, min(b) AS component_id FROM r GROUP BY 1)"


def _tree(name: str, levels: int) -> str:
    """Common tables of trees of 16 over {name}0 (g, p, h), for up to 16^levels leaves a group: {name}i, with siblings l and r; and {name}f, which
    lifts the rows (id, g, p, given, proof) of {name}d to the roots."""
    out, lifted = [], f"{name}d"
    for i in range(levels):
        here, frame = f"{name}{i}", "OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN {0})"
        sides = ((x, frame.format(y)) for x, y in (("l", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("r", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))
        out.append(f"{here}s AS MATERIALIZED (SELECT *, {', '.join(f"CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(h, '') {w}, '') END AS {x}" for x, w in sides)} FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {here}))")
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, p // 16 AS p, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {here}s GROUP BY g, p // 16)")
        out.append(f"{name}f{i} AS MATERIALIZED (SELECT id, g, x.p // 16 AS p, CASE WHEN c = 1 THEN given ELSE sha256(l || given || r) END AS given, proof || l || r AS proof FROM {lifted} x JOIN {here}s USING (g, p))")
        lifted = f"{name}f{i}"
    return ",\n".join(out)


_LEVELS = 8
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_TERMS = r"regexp_extract_all({0}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_bitmap_tiles": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)), l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
{_REACH.format("doc_id", "documents")}
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN c USING (doc_id)""",
    "op5_pca_tiles": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) >= 0.95),
{_REACH.format("vec_id", "v")}, n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op7_phrase_automata": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM t), m AS (SELECT k, min(doc_id) AS first FROM k GROUP BY 1),
d AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (k) WHERE first < doc_id), a AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
o AS (SELECT a.doc_id, count(d.p) AS n_removed, string_agg(x, ' ' ORDER BY a.p) FILTER (d.p IS NULL) AS kept FROM a LEFT JOIN d ON a.doc_id = d.doc_id AND a.p = d.p GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)""",
    "op11_merkle_manifest": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('+' || source, '') AS g, {_LEAF.format("text")} AS h,
CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format("CASE WHEN text IS NOT NULL THEN " + _LOWER + " END")} ELSE {_LEAF.format("text")} END AS given FROM documents),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d), a0 AS (SELECT g, p, h FROM k), ad AS (SELECT id, g, p, given, '' AS proof FROM k),
{_tree("a", _LEVELS)},
n AS MATERIALIZED (SELECT g AS own, h, row_number() OVER (ORDER BY g) - 1 AS p FROM a{_LEVELS}), b0 AS (SELECT 0 AS g, p, h FROM n), bd AS (SELECT id, 0 AS g, n.p, given, proof FROM af{_LEVELS - 1} x JOIN n ON x.g = n.own),
{_tree("b", _LEVELS)}
SELECT doc_id, k.h AS leaf, n.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.given AS folded_root, f.given = r.h AS verified
FROM k JOIN n ON k.g = n.own JOIN bf{_LEVELS - 1} f USING (id) CROSS JOIN b{_LEVELS} r""",
    "op12_divergence_cube": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS x FROM documents),
t AS (SELECT r, lang, source, unnest({_TERMS.format("x")}) AS term FROM d), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS nl FROM c GROUP BY ALL HAVING sum(df) >= 3), g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(nl) AS tl FROM k GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, nl, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term), s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS p, 1 + 1000000000::HUGEINT * (nl + 1) // (tl + v) AS q FROM m JOIN s USING (lang, source) JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
z AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM z WHERE part = 'pair' OR rank <= 200""",
}
