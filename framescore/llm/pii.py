"""Personal data by weak supervision.

Candidates are wider than the plain patterns. Regex, gazetteer and context labelers vote on each; expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is, without labels; a logistic
classifier trained on those posteriors decides which candidates are spans. Plain pattern matches always stay.
The counts cover all candidates of all documents, and there are at most 3 ** labelers patterns a kind."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.common import carried, documents, put_back, released, written

#: Fixed values of the contract: kinds in order.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
MORE = ("secret",)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[^0-9]+")
_ANY_DIGIT = re.compile("[0-9]")
_AT_WORD = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)\b[\x20\"']{0,3}[:=][\x20\"']{0,3}([A-Za-z0-9+/_=-]{12,512})(?![A-Za-z0-9+/_=-])", re.I)
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])")

_TOP = frozenset("com org net edu gov io de fr es uk co info biz eu us ch at it nl ca au jp example".split())
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"call|phone|tel|mobile|fax|anruf|llam", re.I),
    "secret": re.compile(r"token|secret|pass|key|pwd|auth", re.I),
}
_AREA = frozenset("0 1 2 3 4 5 6 7 8 9".split())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain pattern matches of the contract, leftmost and non-overlapping within a kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:  # an address has one @, so look from each: the run before it, the domain after it
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if not _ANY_DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = _DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain match) of all spans to be judged; those that the method adds overlap no plain one."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        """No plain match overlaps: of those that start before ``e`` none reaches beyond ``s``."""
        before = bisect_left(starts, e)
        return before == 0 or reach[before - 1] <= s

    more = []
    if "at" in text and ("(" in text or "[" in text):
        more += [("email", m.start(), m.end()) for m in _AT_WORD.finditer(text)]
    digits = bool(_ANY_DIGIT.search(text))
    if digits:
        more += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 25 and 13 <= len(_DIGIT.sub("", m.group())) <= 19]
        more += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    if digits:
        more += [("secret", m.start(), m.end()) for m in _HEX.finditer(text)]
    out, seen = [(k, s, e, True) for k, s, e in base], set()
    for k, s, e in more:
        if (s, e) not in seen and free(s, e):
            seen.add((s, e))
            out.append((k, s, e, False))
    return out


def votes(text: str, kind: str, s: int, e: int) -> tuple[int, ...]:
    """Five labelers: 1 for personal data, -1 against, 0 abstains."""
    span, before = text[s:e], text[max(0, s - 32) : s]
    digits = _DIGIT.sub("", span)
    strict = {"email": "@" in span, "ip": True, "card": len(digits) in (15, 16), "phone": span[0] == "+", "secret": len(span) >= 20}[kind]
    if kind == "card":
        valid = 1 if luhn(digits) else -1
    elif kind == "ip":
        valid = -1 if digits.startswith("0") or span.startswith("127.") else 1
    elif kind == "secret":
        valid = 1 if len(set(span)) >= 8 and any(c.isdigit() for c in span) else -1
    else:
        valid = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\s]|dot|[\[(\])]", span.rstrip(")] "))[-1].lower() in _TOP else -1
    elif kind == "phone":
        gazetteer = 1 if digits[:1] in _AREA and len(digits) in (10, 11, 12) else -1
    elif kind == "card":
        gazetteer = 1 if digits[0] in "3456" else -1
    else:
        gazetteer = 0
    context = 1 if _CONTEXT[kind].search(before) else 0
    alone = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    return (1 if strict else -1, valid, gazetteer, context, 1 if alone else -1)


def pattern(v: tuple[int, ...]) -> int:
    return int(sum((x + 1) * 3**k for k, x in enumerate(v)))


def _unpack(p: np.ndarray, labelers: int = 5) -> np.ndarray:
    return np.stack([p // 3**k % 3 for k in range(labelers)], 1) - 1


def reliabilities(v: np.ndarray, n: np.ndarray, anchor: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for one kind: (posterior of each pattern, P(vote | class) as [class, labeler, vote + 1], share of the class).

    ``anchor``: plain matches among each pattern's ``n`` candidates, which are of the class."""
    post = np.clip((v.sum(1) + v.shape[1]) / (2 * v.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        post = np.where(n > 0, (anchor + (n - anchor) * post) / n, post)
        w = np.stack([n * (1 - post), n * post])
        share = float(np.clip((w[1].sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        table = np.stack([[[(w[c, v[:, k] == x].sum() + 0.5) / (w[c].sum() + 1.5) for x in (-1, 0, 1)] for k in range(v.shape[1])] for c in (0, 1)])
        ll = np.stack([np.log(table[c][np.arange(v.shape[1]), v + 1]).sum(1) for c in (0, 1)])
        after = 1 / (1 + np.exp(np.clip(ll[0] + np.log(1 - share) - ll[1] - np.log(share), -500, 500)))
        if np.abs(after - post).max() < 1e-9:
            break
        post = after
    return after, table, share


def classifier(v: np.ndarray, n: np.ndarray, post: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a ridge logistic model (bias first) trained on posteriors, each pattern counted n times."""
    x = np.hstack([np.ones((len(v), 1)), v])
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (post - p)) - 1e-3 * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base_sha256, n_email, ..., candidates) of every whole text; null is an empty text."""
    item = "array<struct<kind:string,start:int,end:int,pattern:int,base:boolean>>"

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            sha, counts, items = [], [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                got = sorted(candidates(t), key=lambda c: (c[1], (KINDS + MORE).index(c[0])))
                base = [c for c in got if c[3]]
                sha.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
                counts.append([sum(c[0] == k for c in base) for k in KINDS])
                items.append([{"kind": k, "start": s, "end": e, "pattern": pattern(votes(t, k, s, e)), "base": x} for k, s, e, x in got])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(sha, pa.string()), pa.array(items, kind)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "candidates"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}, base_sha256 string, candidates {item}")


def fit(candidates_: DataFrame) -> set[tuple[str, int]]:
    """(kind, vote pattern) that the final classifier accepts, from all candidates; a row a pattern reaches the driver."""
    rows = candidates_.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").agg(F.count("*").alias("n"), F.count_if("c.base").alias("base")).collect()
    accepted = set()
    for kind in KINDS + MORE:
        own = sorted((r.pattern, r.n, r.base) for r in rows if r.kind == kind)
        if own:
            p, n, base = (np.array(x) for x in zip(*own))
            v = _unpack(p)
            post, _, _ = reliabilities(v, n.astype(float), base.astype(float))
            w = classifier(v, n.astype(float), post)
            good = np.hstack([np.ones((len(v), 1)), v]) @ w > 0
            accepted |= {(kind, int(x)) for x in p[good]}
    return accepted


def spans(found_: DataFrame, accepted: set[tuple[str, int]]) -> DataFrame:
    """Adds ``spans``: kind:start:end of plain matches and accepted candidates, comma-joined by start and kind."""
    keys = F.array(*(F.lit(f"{k}:{p}") for k, p in sorted(accepted))) if accepted else F.array().cast("array<string>")
    kept = F.filter("candidates", lambda c: c["base"] | F.array_contains(keys, F.concat(c["kind"], F.lit(":"), c["pattern"].cast("string"))))
    return found_.withColumn("spans", F.array_join(F.transform(kept, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ","))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; clean and null texts stay as they
    are, and so do other columns, whatever their names. n_chars, where there is such a column, follows the text. An empty table
    gives an empty one, and rows that repeat stay."""
    spark = docs.sparkSession
    accepted = spark.sparkContext.broadcast(fit(found(docs)))  # at most 3 ** labelers a kind

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                if t:
                    parts, at = [], 0
                    for k, s, e, base in sorted(candidates(t), key=lambda c: (c[1], -c[2])):
                        if s >= at and (base or (k, pattern(votes(t, k, s, e))) in accepted.value):
                            parts += [t[at:s], f"<{k.upper()}>"]
                            at = e
                        elif at > s and e > at and base:
                            at = e
                    t = "".join(parts) + t[at:] if at else t
                out.append(t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    rows = carried(docs)
    out = put_back(rows.mapInArrow(released(run), rows.schema), docs.columns)
    if "n_chars" not in docs.columns:
        return out
    size = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(size if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(found(documents(spark, sf_dir)), "candidates")
    return spans(table, fit(table)).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
