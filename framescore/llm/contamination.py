"""Benchmark decontamination by template windows, in DataFrame operations only.

Numbers, names and units become typed placeholders on both sides, a run of names one placeholder. Windows of eight template
words are hash-joined, all of an item's with all of a document's, at every position.
Where one meets, the item is laid on the document and all windows are compared; alignments a few words apart add up. An
alignment's placeholders must map each value of the item to one value of the document; windows with a placeholder that
most of the same value contradict, or as many, don't count. What counts is a copy (all values equal) or a
re-parameterised question. Beside these, plain windows find an exact copy of 13 words, or of a shorter item as a
whole, whatever its words and letter case are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescore.llm.common import documents, written

#: Words of a window, and of the shortest passage that makes a match; items of fewer are one window, from SHORTEST words on.
WINDOW, PASSAGE, SHORTEST = 8, 13, 5
#: Template windows of an item that make a match (all of an item that has fewer), and words by which alignments that add up may be apart.
ENOUGH, APART = 6, 3
#: Words other than placeholders a template window needs (half of a shorter item's).
LITERALS = 4
#: Windows of all items that are broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 500_000

#: Units, words inside names.
UNITS = "km m cm mm mile miles kg g mg lb lbs oz ton tons l ml s sec seconds min minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh degrees meters metres litres liters grams"
PARTICLES = "van von der den de del della di da du la le al bin ibn of"

SPACE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def tokens(text):
    """Words of a text at white space, without punctuation; the empty word for none."""
    return F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), F.lit(BLANKS)), SPACE)


def _kind(w):
    """digit, unit, name, particle or word."""
    one = F.substring(w, 1, 1)
    return F.when(F.ascii(w).between(48, 57), "d").when(F.lower(one) != one, "n").when(w.isin(UNITS.split()), "u").when(w.isin(PARTICLES.split()), "p").otherwise("w")


def _codes(df: DataFrame) -> DataFrame:
    """Adds, for tokens ``t``, ``plain``: 64 bits of each word in lower case, and ``slots``: 64 bits of each template word,
    of a placeholder those of its type."""
    code = {k: int.from_bytes(k.encode()) for k in "dnup"}
    kind = lambda w: F.when(F.ascii(w).between(48, 57), code["d"]).when(F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1), code["n"]).when(w.isin(UNITS.split()), code["u"]).when(w.isin(PARTICLES.split()), code["p"]).otherwise(F.xxhash64(w))
    df = df.withColumn("plain", F.transform("t", lambda w: F.xxhash64(F.lower(w)))).withColumn("each", F.transform("t", kind))
    near = lambda i, k: F.coalesce(F.get("each", i + k), F.lit(0))

    def runs_on(h, i):  # a name's second word, a particle inside a name
        before = near(i, -1)
        return F.when(h == code["n"], (before == code["n"]) | ((before == code["p"]) & (near(i, -2) == code["n"]))).when(h == code["p"], (before == code["n"]) & (near(i, 1) == code["n"])).otherwise(False)

    return df.withColumn("slots", F.filter("each", lambda h, i: ~runs_on(h, i))).drop("each")


def templated(df: DataFrame) -> DataFrame:
    """Adds ``words``, the template words of tokens ``t``: lower-case words, and placeholders \\u0001, type and value; a number begins with
    a digit, a name's words begin with a capital, joined by \\u0002 over particles between them."""

    def marked(w, i):
        k = lambda j: F.coalesce(F.get("kinds", i + j), F.lit("w"))
        after = (k(-1) == "n") | ((k(-1) == "p") & (k(-2) == "n"))
        inside = (k(-1) == "n") & (k(1) == "n")
        own = F.get("kinds", i)
        return F.when(own == "w", w).when(own == "n", F.concat(F.when(after, "\u0002").otherwise("\u0001n"), F.lower(w))).when(own == "p", F.concat(F.when(inside, "\u0002").otherwise(""), w)).otherwise(F.concat(F.lit("\u0001"), own, F.lower(w)))

    # kinds is a column of its own: as an expression in the lambda it would be computed anew for each word
    df = df.withColumn("kinds", F.transform("t", _kind))
    joined = F.replace(F.array_join(F.transform("t", marked), " "), F.lit(" \u0002"), F.lit("\u0002"))
    return df.withColumn("words", F.split(joined, " ")).drop("kinds")


def _slot(word):
    return word.startswith("\u0001")


def _value(word):
    return F.substring(word, 3, 1 << 30)


def _window(size: int, plain: bool, at):
    """64 bits of the window of ``size`` words at ``at``, null where fewer are left."""
    codes = "plain" if plain else "slots"
    return F.when(at + size <= F.size(codes), F.xxhash64(F.lit(size), F.lit(plain), *(F.get(codes, at + k) for k in range(size))))


def _positions(codes: str):
    """A row for each word."""
    return F.explode(F.sequence(F.lit(0), F.size(codes) - 1))


def _index(items: DataFrame) -> DataFrame:
    """(item_id, size, plain, at, h): the windows of items; template ones with fewer than LITERALS words are left out."""
    words = _codes(templated(items.select("item_id", tokens(F.col("text")).alias("t"))))
    words = words.withColumn("literal", F.transform("words", lambda w: F.when(_slot(w), 0).otherwise(1)))
    out = None
    for plain, codes in ((True, "plain"), (False, "slots")):
        whole = PASSAGE if plain else WINDOW  # an item of fewer words is one window
        for size in range(SHORTEST, whole + 1):
            rows = words.where(F.size(codes) >= whole if size == whole else F.size(codes) == size)
            wide = WINDOW if size == whole else size
            rows = rows.select("item_id", "literal", codes, _positions(codes).alias("at")).withColumn("h", _window(wide, plain, F.col("at"))).where("h is not null")
            if not plain:
                rows = rows.where(F.aggregate(F.slice("literal", F.col("at") + 1, wide), F.lit(0), lambda a, b: a + b) >= min(LITERALS, (size + 1) // 2))
            rows = rows.select("item_id", F.lit(wide).alias("size"), F.lit(plain).alias("plain"), "at", "h")
            out = rows if out is None else out.union(rows)
    return out


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, total, n_windows, kind): alignments of documents, by ``key`` (doc_id and hash of the text), with items. ``docs``: key, text."""
    items = items.select("item_id", "text")
    index = written(_index(items), "items")
    shape = index.groupBy("size", "plain").count().collect()  # at most a row a size
    bounded = sum(r["count"] for r in shape) <= BROADCAST_ROWS
    # positions are rows before windows are hashed: the hash is compiled, and in one stage with the join no word list is copied
    mine = _codes(docs.select("key", tokens(F.col("text")).alias("t"))).select("key", "plain", "slots", _positions("plain").alias("pos"))
    windows = [_window(r["size"], r["plain"], F.col("pos")) for r in sorted(shape, key=str)]
    mine = mine.select("key", "pos", F.explode(F.array(*windows) if windows else F.array().cast("array<bigint>")).alias("h"))
    hits = mine.join(F.broadcast(index) if bounded else index, "h").select("key", "item_id", "plain", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    hits = written(hits, "hits")

    # the item laid on the document: which of its words agree, and the windows of those
    words = lambda df, key: _codes(templated(df.select(key, tokens(F.col("text")).alias("t"))))
    own = words(docs.join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "key").select("key", F.col("plain").alias("my_plain"), F.col("slots").alias("my_slots"), F.col("words").alias("my_words"))
    theirs = words(items, "item_id").select("item_id", F.col("plain").alias("its_plain"), F.col("slots").alias("its_slots"), "words")
    laid = hits.join(own, "key").join(theirs, "item_id")
    flag = F.col("plain")
    laid = laid.withColumn("its", F.when(flag, F.col("its_plain")).otherwise(F.col("its_slots"))).withColumn("mine", F.when(flag, F.col("my_plain")).otherwise(F.col("my_slots")))
    laid = laid.withColumn("same", F.transform("its", lambda h, p: F.coalesce(h == F.get("mine", p + F.col("shift")), F.lit(False))))
    size = F.least(F.when(flag, PASSAGE).otherwise(WINDOW), F.size("its"))
    laid = laid.withColumn("size", size).withColumn("total", F.size("its") - F.col("size") + 1)
    laid = laid.withColumn("ats", F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda a: F.forall(F.slice("same", a + 1, F.col("size")), lambda x: x)))
    full = F.greatest(F.lit(1), F.size("its_plain") - PASSAGE + 1)
    copies = laid.where(flag & (F.size("ats") > 0)).select("key", "item_id", full.alias("total"), F.size("ats").cast("long").alias("n_windows"), F.lit("copy").alias("kind"))

    some = laid.where(~flag & (F.size("ats") > 0)).withColumn("covered", F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1)))))
    slots = F.filter("covered", lambda p: _slot(F.get("words", p)))

    def slot(p):
        theirs, own = _value(F.get("words", p)), _value(F.get("my_words", p + F.col("shift")))
        # a name that begins or ends an item may run on in the document
        runs_on = own.endswith(F.concat(F.lit("\u0002"), theirs)) | own.startswith(F.concat(theirs, F.lit("\u0002")))
        return F.struct(p.alias("p"), theirs.alias("theirs"), F.when(runs_on, theirs).otherwise(own).alias("own"))

    some = some.withColumn("slots", F.transform(slots, slot))
    votes = lambda x: F.size(F.filter("slots", lambda y: (y["theirs"] == x["theirs"]) & (y["own"] == x["own"])))
    some = some.withColumn("slots", F.transform("slots", lambda x: F.struct(x["p"].alias("p"), x["theirs"].alias("theirs"), x["own"].alias("own"), votes(x).alias("votes"))))
    # a slot conflicts if as many of the same value, or more, have another one: only the windows that hold it are lost
    conflicts = lambda x: F.exists("slots", lambda y: (y["theirs"] == x["theirs"]) & (y["own"] != x["own"]) & (y["votes"] >= x["votes"]))
    some = some.withColumn("bad", F.transform(F.filter("slots", conflicts), lambda x: x["p"]))
    good = F.size(F.filter("ats", lambda a: ~F.exists("bad", lambda p: (p >= a) & (p < a + F.col("size")))))
    equal = F.forall(F.filter("slots", lambda x: ~F.array_contains("bad", x["p"])), lambda x: x["own"] == x["theirs"])
    need = F.least(F.lit(ENOUGH), F.col("total"))
    some = some.select("key", "item_id", "shift", full.alias("full"), need.alias("need"), good.alias("n"), equal.alias("copy"))
    near = W.partitionBy("key", "item_id").orderBy("shift").rangeBetween(-APART, APART)
    some = some.withColumn("n_windows", F.sum("n").over(near).cast("long")).withColumn("copy", F.min("copy").over(near)).where(F.col("n_windows") >= F.col("need"))
    return copies.union(some.select("key", "item_id", F.col("full").alias("total"), "n_windows", F.when(F.col("copy"), "copy").otherwise("reparameterised").alias("kind")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key"), "text")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, kind): a row for each document that holds a passage of an item; clean
    documents have none.

    Null and empty texts match nothing, nor do items of under five words; documents that repeat give one row a
    doc_id and item; empty tables give an empty one; other columns are ignored. ``kind`` is "copy" or
    "reparameterised"; ``coverage`` is the number of windows in the best alignment to those of the item's plain ones, at most 1."""
    best = alignments(_keyed(docs), items).groupBy("key.doc_id", "item_id").agg(F.max(F.struct(F.col("kind") == "copy", "n_windows", "kind", "total")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", F.least(F.lit(1.0), F.col("b.n_windows") / F.col("b.total")).alias("coverage"), "b.kind")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, unchanged, whatever their other columns are named. Null texts and null ids stay; rows
    that repeat stay or go together; empty tables give back ``docs``."""
    bad = written(alignments(_keyed(docs), items).select("key").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key"))
    left = rows.join(bad, rows["key"].eqNullSafe(bad["key"]), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op8_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
