"""Language identification by held-out accuracy, personal data against a brute-force version."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framescore.llm.language import ORDER, codes, identified, kneser_ney, learnable, limits, log_prob, op3_kneser_ney, sample
from framescore.llm.pii import KINDS, base_spans, found, fit, luhn, op6_weak_supervision, redacted, spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_held_out(spark):
    out = op3_kneser_ney(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("h")).toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both.held_out == (both.h % 4 == 2)).all() and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99
    assert held.rejected.mean() < 0.01


def test_language_odd_rows(spark):
    rows = [(i, "der die und das ist ein text " * 5 + str(i), "de", None, 1) for i in range(40)] + [(100 + i, "the and of this is a story " * 5, "en", "s", None) for i in range(40)]
    rows += [(200, None, "de", None, None), (201, "", None, None, None), (202, "123 !!", "en", None, None), (203, "qzxw kkjq vvxz wqqk zzxj qqxv " * 40, None, None, None), (None, "the and of this", None, None, None), (204, "und " * 50000, None, None, None), (204, "und " * 50000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {(r.doc_id, i): r for i, r in enumerate(identified(df, learnable(df)).collect())}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r)
    assert len(got) == len(rows)
    for d in (200, 201, 202):
        assert by[d][0].lang_pred == "und" and by[d][0].score == 0 and by[d][0].rejected
    assert by[203][0].rejected and by[203][0].lang_pred in ("de", "en")
    assert by[204][0].lang_pred == by[204][1].lang_pred == "de" and by[None][0].lang_pred == "en" and not by[3][0].rejected
    empty = spark.createDataFrame([], SCHEMA)
    assert identified(empty, learnable(empty)).count() == 0
    none = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert identified(none, learnable(none)).first().lang_pred == "und"


def test_scripts_and_long_texts(spark):
    """Languages that share a script of many letters, and one that has only long texts."""
    rng = np.random.default_rng(3)
    first, second = ("".join(map(chr, rng.choice(np.arange(0x4E00, 0x5200), 300, replace=False))) for _ in range(2))
    write = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, write(first if i % 2 else second, 400), "xx" if i % 2 else "yy", None, None) for i in range(80)]
    rows += [(100 + i, ("слово и дело " * 2500) + str(i), "ru", None, None) for i in range(3)] + [(200, write(first, 60), None, None, None), (201, write(second, 60), None, None, None), (202, "дело и слово", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang_pred for r in identified(df, F.col("lang").isNotNull()).collect()}
    assert (got[200], got[201], got[202]) == ("xx", "yy", "ru")
    pieces = sample(df, F.lit(True)).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert {r["lang"]: (r.n, r["size"]) for r in pieces}["ru"] == (6, sum(len(r[1]) for r in rows if r[2] == "ru"))


def test_kneser_ney_is_a_distribution_and_matches_the_recursion():
    text = "abracadabra barbara cab"
    code, _ = codes([text])
    model = kneser_ney(code)
    contexts = np.unique(code >> np.uint64(16))[:20]
    symbols = np.array([0, *map(ord, "abcdr")], np.uint64)
    p = np.exp2(log_prob(model, (contexts[:, None] << np.uint64(16) | symbols).ravel(), 6)).reshape(-1, 6)
    assert np.allclose(p.sum(1), 1)
    levels = {}
    grams = {}
    for c in code.tolist():
        grams[c] = grams.get(c, 0) + 1
    for k in range(ORDER, 0, -1):
        levels[k] = grams
        lower = {}
        for g in grams:
            s = g & ((1 << (16 * (k - 1))) - 1)
            lower[s] = lower.get(s, 0) + 1
        grams = lower

    def prob(c, k):
        if k == 0:
            return 1 / 6
        c &= (1 << (16 * k)) - 1
        own = levels[k]
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        same = [v for g, v in own.items() if g >> 16 == c >> 16]
        if not same:
            return prob(c, k - 1)
        return max(own.get(c, 0) - d, 0) / sum(same) + len(same) * d / sum(same) * prob(c, k - 1)

    assert np.allclose(np.log2([prob(c, ORDER) for c in code.tolist()]), log_prob(model, code, 6))
    assert limits(model, [text], 6)[0] > 0


def brute_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "@", "@b.c", ".", "1", "255", "256", "4111111111111111", " ", "-", "+", "+1 (555) ", "555-7713", "é", "%", "x@y.de", "1.2.3.4", "..", "\n", "0"]), max_size=24).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert sorted(base_spans(text), key=lambda x: (x[1], KINDS.index(x[0]))) == brute_base(text)


def test_pii_whole_table(spark, sf_dir):
    out = {r.doc_id: r for r in op6_weak_supervision(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    more = 0
    for d in docs:
        base = brute_base(d.text or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = out[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in KINDS]
        assert not base or set(text.split(",")) <= set(r.spans.split(","))
        more += len([x for x in r.spans.split(",") if x]) - len(base)
    assert more > 0


def test_pii_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "x", None, 0), (3, "mail a.b@c.de or +1 (555) 555-7713, ip 10.0.0.1; token = \"0123456789abcdef0123456789abcdef\"", None, None, 5), (3, "x " * 100000 + "card 4111 1111 1111 1111", None, None, 5), (None, "clean text of 12 words", None, None, 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash"))
    got = spans(found(df), fit(found(df))).collect()
    assert len(got) == len(rows)
    texts = [r.text for r in redacted(df).collect()]
    assert texts[0] is None and texts[1] == "" and texts[4] == rows[4][1]
    assert "a.b@c.de" not in texts[2] and "<EMAIL>" in texts[2] and "<PHONE>" in texts[2] and "4111" not in texts[3]
    assert spans(found(spark.createDataFrame([], SCHEMA)), set()).count() == 0
