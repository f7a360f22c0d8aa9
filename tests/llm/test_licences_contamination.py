"""Licences and decontamination against brute-force versions."""

import math
import random
import re

from pyspark.sql import functions as F

from framescore.llm.contamination import PARTICLES, UNITS, decontaminated, matches, op8_template_windows
from framescore.llm.licences import BASE, COMMON, ENOUGH, GAP, KEY_WORDS, TEMPLATES, VOCABULARY, licences, op1_rare_token_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string"


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(label, i) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))


def test_licences_whole_table(spark, sf_dir):
    out = {r.doc_id: r for r in op1_rare_token_index(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r = out[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(d.text), d.doc_id
        want = set(filter(None, r.base_labels.split(",")))
        if "Licensed under CC BY-NC 4.0." in (d.text or ""):
            want.add("cc-by-nc")
        assert set(filter(None, r.labels.split(","))) == want and 0 <= r.score <= 1 and (r.score > 0) == bool(want)


def test_licences_odd_rows(spark):
    gpl = "redistribute it and/or modify it under the terms of the GNU General Public License"
    rows = [(1, None, "x"), (2, "", None), (3, "MIT License. mit\nlicense", None), (3, "MIT License. mit\nlicense", None), (None, "mİt license MITé license mit", None), (5, "wörd " * 60000 + gpl, None), (6, "public license of the general and of the software", None), (7, "-- Apache License, Version 2.0 --", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("words", F.lit(1)).withColumn("labels", F.lit(2))
    out = licences(df).collect()
    assert len(out) == len(rows)
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert got == sorted(((d or 0), *brute_base(t)) for d, t, _ in rows)
    labels = {r.doc_id: r.labels for r in out}
    assert labels[5] == "gpl" and labels[6] == "" and labels[7] == "apache"
    assert licences(df.limit(0)).count() == 0


def test_licences_all_in_one_text(spark):
    notices = " zz ".join(text for _, text, _ in TEMPLATES)
    rows = [(1, notices, None), (2, "lesser affero mozilla unencumbered reserved redistribution reproduced universal zz licensed under CC BY 4.0", None), (3, "cc by 5 0 mozilla, with or without a fee", None)]
    rows += [(i, "a text without any", None) for i in range(4, 24)]
    got = {r.doc_id: (r.labels, r.score) for r in licences(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (",".join(sorted({label for label, _, _ in TEMPLATES})), 1.0)
    assert got[2][0] == "cc-by" and got[3] == ("", 0.0)


def brute_labels(text, weight):
    """Labels by laying every template on every place of its key phrase, word by word."""
    words, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)), {x for x in brute_base(text)[4].split(",") if x}
    for label, statement, key in TEMPLATES:
        parts, phrase = statement.split(), key.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
        total = sum(weight.get(w, 0.0) for w in parts)
        for p in (i for i in range(len(words)) if words[i : i + len(phrase)] == phrase):
            here = lambda k: words[max(0, p - at + k - GAP) : max(0, p - at + k + GAP + 1)]  # noqa: E731, B023
            if sum(weight.get(w, 0.0) for k, w in enumerate(parts) if w in here(k)) >= ENOUGH * total:
                out.add(label)
    return ",".join(sorted(out))


def weights(texts):
    """Inverse document frequencies as the operator counts them."""
    sets = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t in texts]
    n = max(1, len(sets))
    df = {w: sum(w in s for s in sets) for w in VOCABULARY}
    return {w: max(0.1, math.log((n + 1) / (df[w] + 0.5))) for w in VOCABULARY if w in KEY_WORDS or df[w] <= COMMON * n}


def test_licences_labels_whole_table(spark, sf_dir):
    """The method's labels over the whole table, with statements cut up, changed and repeated put into some of its texts."""
    rng = random.Random(9)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for k in range(150):
        words = rng.choice(TEMPLATES)[1].split() + rng.choice([[], ["and"], rng.choice(TEMPLATES)[1].split()])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(words))
            words[i : i + rng.randrange(2)] = rng.choice([[], ["odd"], ["two", "more"], ["license"], ["mozilla"]])
        host = (docs[rng.randrange(len(docs))][1] or "").split()[:80]
        i = rng.randrange(len(host) + 1)
        docs.append((100_000 + k, " ".join(host[:i] + words + host[i:])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences(df).collect()}
    w = weights([t for _, t in docs])
    want = {d: brute_labels(t, w) for d, t in docs}
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}
    assert len({x for x in want.values()}) > 10
    plan = licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_licences_with_words_put_in(spark):
    rows = [
        ("Licensed under the 3-clause BSD license", "bsd"),
        ("This is licensed under the Apache-2.0 License.", "apache"),
        ("Mozilla Public License, version 2.0", "mpl"),
        ("It is made available under the terms of the Mozilla Public License 2.0", "mpl"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: BSD-3-Clause", "bsd"),
        ("Redistribution and use, in source and binary forms, of this thing with or without any modification, are permitted", "bsd"),
        ("I read the Mozilla page about public things and a license", ""),
    ]
    got = {r.doc_id: r.labels for r in licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(i, "other text") for i in range(100, 130)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]


def test_contamination_whole_table(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in op8_template_windows(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    index = {}
    for i in items:
        w = i.text.lower().split()
        for k in range(len(w) - 12):
            index.setdefault(tuple(w[k : k + 13]), i.item_id)
    want = set()
    for d in docs:
        w = (d.text or "").lower().split()
        want |= {(d.doc_id, index[x]) for k in range(len(w) - 12) if (x := tuple(w[k : k + 13])) in index}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1


def test_contamination_slots_and_odd_rows(spark):
    item = "A train leaves the old station with 120 people on board and travels 45 km before it stops, where 120 people get out"
    rows = [
        (1, "Intro words here. " + item + " and more."),
        (2, "Intro. " + item.replace("120", "333").replace("45", "7")),
        (3, item.replace("with 120", "with 7").replace("where 120", "where 9")),
        (4, None),
        (5, ""),
        (6, "a clean text without any of it " * 20000),
        (None, item),
        (1, "Intro words here. " + item + " and more."),
        (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in matches(df, items).collect()}
    assert got[(1, 10)] == "copy" and got[(2, 10)] == "reparameterised" and got[(None, 10)] == "copy"
    assert (3, 10) not in got or got[(3, 10)] == "copy"
    assert got[(8, 13)] == "copy"  # an exact copy is found also without plain words
    assert {d for d, _ in got} <= {1, 2, 3, 8, None}
    assert matches(df.limit(0), items).count() == 0 and matches(df, items.limit(0)).count() == 0


def test_contamination_names_edges_and_short_items(spark):
    items = [
        (1, "What is the capital of France?"),
        (2, "Mr. Smith bought four boxes of apples at the old market and gave them to his two sisters"),
        (3, "What is the capital city of the country that borders Spain"),
        (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
        (5, "A farmer called Jones sells 12 eggs a day to the bakery of the village and keeps the other ones"),
        (6, "Name one"),
    ]
    rows = [
        (10, "They asked: What is the capital of France? Paris.", 1),
        (11, "Note. Mr. van Dyke bought four boxes of apples at the old market and gave them to his two sisters today", 2),
        (12, "Question: What is the capital city of the country that borders Spain. Answer", 3),
        (13, "numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 end", 4),
        (14, "A FARMER CALLED JONES SELLS 12 EGGS A DAY TO THE BAKERY OF THE VILLAGE AND KEEPS THE OTHER ONES", 5),
        (15, "once a farmer called Mary Ann Miller sells 30 eggs a day to the bakery of the village and keeps the other ones", 5),
        (16, "what is the capital of this and of that, name one", None),
        (17, "sells 12 eggs a day to the bakery", None),
    ]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 as _id", "2 as key", "3 as `row`", "4 as `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in matches(df, bench).collect()}
    assert set(got) == {(d, i) for d, _, i in rows if i}
    assert set(got.values()) == {"copy"}  # each holds 13 words of its item, or all of a shorter one, as they are
    left = decontaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {16, 17}


def test_contamination_recall_of_changed_items(spark):
    """Items with names, numbers and units changed, in a text, against a matcher over words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    pools = {"NAME": ["Anna", "Bob Miller", "Carla van Berg", "Dov", "Mr Ek"], "NUM": [str(i) for i in range(999)], "UNIT": ["km", "kg", "hours"]}
    items, docs = [], []
    for i in range(60):
        parts = [rng.choice(list(pools)) if k % 5 == 3 else word() for k in range(24)]
        item = [(p, rng.choice(pools[p])) if p in pools else (p, p) for p in parts]
        meant = {}  # a question asked anew has one value for each of the item's
        for p, v in item:
            if p in pools and v not in meant:
                meant[v] = rng.choice([x for x in pools[p] if x not in meant.values()])
        items.append((i, " ".join(v for _, v in item)))
        docs.append((i, " ".join(word() for _ in range(30)) + " " + " ".join(meant.get(v, v) for _, v in item) + ". " + " ".join(word() for _ in range(30))))
    docs += [(1000 + i, " ".join(word() for _ in range(80))) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= {(i, i) for i in range(60)} and len(got) >= 54


def test_contamination_conflicting_slot(spark):
    """One slot of five that contradicts the others costs its own windows alone; where values contradict each other evenly, none counts."""
    item = "anna has 7 red pens and bob takes 7 of them while carl brings 7 blue ones then dora breaks 7 pens and emil finds 7 more under his desk"
    item = " ".join(w.capitalize() if w in ("anna", "bob", "carl", "dora", "emil") else w for w in item.split())
    fill = lambda *v: item.replace("7", "{}").format(*v)
    rows = [(1, fill(9, 9, 9, 9, 9)), (2, fill(9, 9, 9, 9, 4)), (3, fill(9, 4, 9, 9, 9)), (4, fill(1, 2, 3, 4, 5)), (5, fill(7, 7, 7, 7, 2))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.kind, r.n_windows) for r in matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {d for d in got} == {1, 2, 3, 5} and got[1][0] == got[2][0] == got[3][0] == "reparameterised" and got[5][0] == "copy"
    assert got[1][1] > got[2][1] and got[1][1] > got[3][1]


def test_contamination_at_every_position(spark):
    """Items of one to three windows, plain and with numbers changed, wherever in the text they stand; shorter ones too."""
    items = [(1, "seven grey cats sat on one old mat"), (2, "add 12 red pens to my box of pens"), (3, "put 40 small nails into the wall near this door"), (4, "six words make one short item")]
    filler = "so we tell of some other thing that no item has".split()
    rows, want = [], set()
    for i, text in items:
        for k in range(7):
            for new in {text, text.replace("12", "7").replace("40", "9")}:
                rows.append((len(rows), " ".join([*filler[:k], new, *filler[k:]])))
                want.add((len(rows) - 1, i))
    # a longer item with every ninth word changed: six windows, none next to another
    long = [f"w{a}{b}" for a in "abcdef" for b in "qrstuvwxyz"]
    items.append((5, " ".join(long)))
    changed = ["other" if i % 9 == 0 else w for i, w in enumerate(long)]
    for k in range(3):
        rows.append((len(rows), " ".join([*filler[:k], *changed, "end"])))
        want.add((len(rows) - 1, 5))
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def brute_template(text):
    """Template words (kind or word, value) of a text, one word at a time: numbers, units, runs of names."""
    words = [x for x in (re.sub(r"[^\w]|_", "", w) for w in re.split(r"[\x20\x09-\x0D]+", text or "")) if x]
    kind = ["d" if w[0] in "0123456789" else "n" if w[0].lower() != w[0] else "u" if w in UNITS.split() else "p" if w in PARTICLES.split() else "w" for w in words]
    out = []
    for i, (w, k) in enumerate(zip(words, kind)):
        before, two, after = (kind[j] if 0 <= j < len(kind) else "w" for j in (i - 1, i - 2, i + 1))
        runs = (k == "n" and (before == "n" or (before == "p" and two == "n"))) or (k == "p" and before == "n" and after == "n")
        if runs:
            out[-1] = (out[-1][0], out[-1][1] + " " + w.lower())
        else:
            out.append((w, None) if k in "wp" else (k, w.lower()))
    return out


def brute_matches(docs, items):
    """(doc_id, item_id) by laying each item of at least 13 template words on each place of each text, word by word."""
    found = set()
    laid = [(i, [x[0] if x[1] is None else "\0" + x[0] for x in t], t) for i, t in ((i, brute_template(x)) for i, x in items) if len(t) >= 13]
    for d, text in docs:
        mine = brute_template(text)
        codes = [x[0] if x[1] is None else "\0" + x[0] for x in mine]
        places = {}
        for p, c in enumerate(codes):
            places.setdefault(c, []).append(p)
        for i, its, t in laid:
            rare = min(range(len(its)), key=lambda k: len(places.get(its[k], [])))
            shifts = {p - k for k in range(len(its)) for p in places.get(its[k], [])} if len(its) < 40 and len(codes) < 400 else {p - k for k in (rare,) for p in places.get(its[k], [])}
            counts = {}
            for s in shifts:
                same = [0 <= k + s < len(codes) and codes[k + s] == c for k, c in enumerate(its)]
                ats = [a for a in range(len(its) - 7) if all(same[a : a + 8])]
                cover = {k for a in ats for k in range(a, a + 8)}
                slots = [(k, t[k][1], mine[k + s][1]) for k in sorted(cover) if t[k][1] is not None]
                slots = [(k, v, v if o.endswith(" " + v) or o.startswith(v + " ") else o) for k, v, o in slots]
                votes = lambda v, o: sum(1 for _, x, y in slots if (x, y) == (v, o))  # noqa: E731, B023
                bad = {k for k, v, o in slots if any(x == v and y != o and votes(x, y) >= votes(v, o) for _, x, y in slots)}
                good = [a for a in ats if not bad & set(range(a, a + 8)) ]
                # a match is found where a window of four literals meets, which is looked up at every third place
                if any((a + s) % 3 == 0 and sum(t[k][1] is None for k in range(a, a + 8)) >= 4 for a in ats):
                    counts[s] = len(good)
            for s in counts:
                if sum(n for x, n in counts.items() if abs(x - s) <= 3) >= min(6, len(its) - 7):
                    found.add((d, i))
    return found


def test_contamination_templates_whole_table(spark, sf_dir):
    """All template matches of the whole table, against items laid on texts word by word."""
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(11)
    for k, (i, text) in enumerate(items[:20]):  # beside the table's own copies, some with numbers and names put in
        docs.append((10_000 + k, "so. " + re.sub(r"\b(the|der|la)\b", lambda m: rng.choice(["the", "der", "la", "12", "Anna"]), text) + " end"))
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = set()
    grams = {}
    for i, t in items:
        w = [x.lower() for x in (re.sub(r"[^\w]|_", "", w) for w in t.split()) if x]
        size = min(13, len(w))
        for k in range(len(w) - size + 1):
            if size >= 5:
                grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w = [x.lower() for x in (re.sub(r"[^\w]|_", "", w) for w in (t or "").split()) if x]
        plain |= {(d, i) for n in sizes for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    assert got == plain | brute_matches(docs, items)
