"""Licence scan by a positional rare-token index, in DataFrame operations only.

The index holds a posting (word, template, position) for each word of each licence statement, weighted by inverse document
frequency over all documents. Of each template whose rarest key word a file has, the file's LOOKED_UP words of highest weight
are looked up. Postings are intersected by relative position: where the rarest key word and another word looked
up put the beginning of a template within GAP words of each other, the template is laid on the text, its key phrase must
stand there whole, and its other words add up by weight, each up to GAP words out of place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.llm.common import ascii_lower, documents, written

#: Label, identifier in the words of the contract.
SPDX = (("mit", "mit"), ("apache", "apache 2 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("mpl", "mpl 2 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"))
#: Label, statement in the words of the contract, key phrase that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
    ("proprietary", "all rights reserved no part of this work may be reproduced", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "licensed under the apache 2 0 license", "apache 2 0 license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "unless required by applicable law or agreed to in writing"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("bsd", "licensed under the 3 clause bsd license", "clause bsd license"),
    ("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("mpl", "made available under the terms of the mozilla public license 2 0", "mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org mpl 2 0", "copy of the mpl was not distributed"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "free to copy modify publish use compile sell"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must be plainly marked as such"),
    *((label, f"spdx license identifier {name}", f"spdx license identifier {name}") for label, name in SPDX),
)
#: Fixed values of the contract: label, phrase.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in more than COMMON of all documents have a weight only where key phrases hold them.
COMMON, ENOUGH = 0.2, 0.6
#: Words of highest weight that are looked up for a file and template, and words by which one may be out of place.
LOOKED_UP, GAP = 3, 3

KEY_WORDS = sorted({w for _, _, key in TEMPLATES for w in key.split()} - set("the of to and in or with by a as be at any on 0 1 2 3 4".split()))
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
SPAN = max(len(text.split()) for _, text, _ in TEMPLATES) + GAP


def text_words(text):
    """Words of the contract in order."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _places(words, label: str, phrase: str):
    """Structs (label, start) of all places of a phrase."""
    parts = phrase.split()
    here = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    starts = F.filter(here, lambda i: i.isNotNull())
    follows = lambda k: lambda i: F.coalesce(F.get(words, i + k) == parts[k], F.lit(False))
    for k in range(1, len(parts)):
        starts = F.filter(starts, follows(k))
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))


def _index(weight: dict[str, float]) -> list[tuple]:
    """(template, label, parts, weights, total, key, anchor, anchor_at, ranked), a row a template: its words and their weights, the places of
    its key phrase, its rarest key word and that word's place, and its weighted words, rarest first."""
    rows = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        parts, phrase = text.split(), key.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
        places = list(range(at, at + len(phrase)))
        anchor = max((i for i in places if parts[i] in KEY_WORDS), key=lambda i: (weight[parts[i]], -i))
        weights = [weight.get(w, 0.0) for w in parts]
        ranked = sorted({w for w in parts if w in weight}, key=lambda w: (-weight[w], w))
        rows.append((t, label, parts, weights, sum(weights), places, parts[anchor], anchor, ranked))
    return rows


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row a document.

    A null or empty text has no words; equal rows each get a row; an empty table gives an empty one; other columns are
    ignored. ``score`` is the largest share of a verified template's weight found in place, at least 0.5 where a
    base phrase stands, 0 without labels."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_words(F.col("text")).alias("words"))
    vocabulary = lambda w: w.isin(VOCABULARY)
    seen = docs.select(F.explode(F.array_distinct(F.filter("words", vocabulary))).alias("word")).groupBy("word").count().collect()  # a row a vocabulary word
    n = max(1, docs.count())
    df = {r.word: r["count"] for r in seen}
    weight = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in VOCABULARY if w in KEY_WORDS or df.get(w, 0) <= COMMON * n}
    weight = {w: max(x, 0.1) for w, x in weight.items()}
    index = _index(weight)
    anchors = sorted({r[6] for r in index})
    templates = spark.createDataFrame([r[:8] for r in index], "t int, label string, parts array<string>, weights array<double>, total double, key array<int>, anchor string, anchor_at int")
    postings = spark.createDataFrame([(r[0], w, i) for r in index for i, w in enumerate(r[2]) if w in weight], "t int, word string, at int")

    base = F.concat(*(_places(F.col("words"), label, phrase) for label, phrase in BASE))
    base = F.when(F.array_contains("words", "license"), base).otherwise(F.array().cast("array<struct<label:string,start:bigint>>"))
    # the licence words that a file has, and of each template that it may hold the rarest of them
    own = F.array_distinct(F.filter("words", vocabulary))
    ranked = F.array(*(F.struct(F.lit(r[0]).alias("t"), F.lit(r[6]).alias("anchor"), F.array(*map(F.lit, r[8])).alias("ranked")) for r in index))
    lookup = F.transform(F.filter(ranked, lambda x: F.array_contains("own", x["anchor"])), lambda x: F.struct(x["t"].alias("t"), F.array_union(F.slice(F.array_intersect(x["ranked"], F.col("own")), 1, LOOKED_UP), F.array(x["anchor"])).alias("words")))
    nothing = F.array().cast("array<struct<t:int,words:array<string>>>")
    docs = docs.withColumn("own", own).withColumn("lookup", F.when(F.arrays_overlap("own", F.array(*map(F.lit, anchors))), lookup).otherwise(nothing))
    span = lambda w, i: F.when(w.isin(anchors), F.slice("words", F.greatest(i - SPAN, F.lit(0)) + 1, 2 * SPAN + 1))
    looked = docs.withColumn("wanted", F.array_distinct(F.flatten(F.transform("lookup", lambda x: x["words"]))))
    hit = F.transform("words", lambda w, i: F.when(vocabulary(w) & F.array_contains("wanted", w), F.struct(w.alias("word"), i.alias("pos"), F.least(i, F.lit(SPAN)).alias("place"), span(w, i).alias("span"))))
    hits = F.when(F.size("lookup") > 0, F.filter(hit, lambda x: x.isNotNull()))
    rows = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), "lookup", hits.alias("hits"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "licences")

    # postings of the words looked up, as beginnings of their template; those near each other agree
    some = rows.where(F.size("lookup") > 0)
    asked = some.select("uid", F.explode("lookup").alias("l"), "hits").select("uid", "l.t", F.explode(F.filter("hits", lambda h: F.array_contains(F.col("l.words"), h["word"]))).alias("h"))
    begins = asked.select("uid", "t", F.col("h.word").alias("word"), "h.pos", "h.place", "h.span").join(F.broadcast(postings), ["t", "word"]).join(F.broadcast(templates), "t")
    begins = begins.withColumn("begin", F.col("pos") - F.col("at"))
    near = W.partitionBy("uid", "t").orderBy("begin").rangeBetween(-GAP, GAP)
    begins = begins.withColumn("agree", F.size(F.collect_set("at").over(near)))
    few = F.size(F.filter("parts", lambda w: w.isin(sorted(weight))))
    found = begins.where((F.col("at") == F.col("anchor_at")) & (F.col("agree") >= F.least(F.lit(2), few)))

    word = lambda k: F.get("span", F.col("place") - F.col("at") + k)
    found = found.where(F.forall("key", lambda k: F.coalesce(word(k) == F.get("parts", k), F.lit(False))))
    close = lambda k: F.exists(F.sequence(F.lit(-GAP), F.lit(GAP)), lambda d: F.coalesce(word(k + d) == F.get("parts", k), F.lit(False)))
    got = F.aggregate(F.sequence(F.lit(0), F.size("parts") - 1), F.lit(0.0), lambda x, k: x + F.when(close(k), F.get("weights", k)).otherwise(0.0))
    found = found.withColumn("got", got).where(F.col("got") >= ENOUGH * F.col("total"))
    found = found.groupBy("uid").agg(F.max(F.least(F.lit(1.0), F.col("got") / F.col("total"))).alias("best"), F.collect_set("label").alias("more"))
    out = rows.join(found, "uid", "left")
    named = F.array_distinct(F.transform("base", lambda x: x["label"]))
    starts = F.transform("base", lambda x: x["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op1_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))
