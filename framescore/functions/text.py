"""Text expressions: overlap, direction, magnitude, judge replies, drafted items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescore.schemas import QA_ITEM

# Pairs of opposite directions, phrases of each magnitude.
OPPOSITES = {"faster": "slower", "higher": "lower", "more": "less", "left": "right", "up": "down", "longer": "shorter", "earlier": "later", "same": "different"}
MAGNITUDES = {
    "much_less": r"(much|far|significantly)\s+less",
    "slightly_less": r"(slightly|a\s+bit|a\s+little)\s+less",
    "same": r"\bsame\b|unchanged|no\s+change",
    "slightly_more": r"(slightly|a\s+bit|a\s+little)\s+more",
    "much_more": r"(much|far|significantly)\s+more",
}


def tokens(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def entailment(prediction: Column, outcome: Column) -> Column:
    """Share of the outcome's words that the prediction has; 0 for an empty outcome."""
    theirs = tokens(F.coalesce(outcome, F.lit("")))
    return F.when(F.size(theirs) == 0, 0.0).otherwise(F.size(F.array_intersect(tokens(F.coalesce(prediction, F.lit(""))), theirs)) / F.size(theirs))


def direction_match(prediction: Column, keyword: Column) -> Column:
    """The keyword is in the text and its opposite is not."""
    word, text = F.lower(F.trim(F.coalesce(keyword, F.lit("")))), F.lower(F.coalesce(prediction, F.lit("")))
    both = {**OPPOSITES, **{v: k for k, v in OPPOSITES.items()}}
    against = F.lit(False)
    for k, v in both.items():
        against = against | ((word == k) & text.contains(v))
    return (word != "") & F.contains(text, word) & ~against


def magnitude_match(prediction: Column, expected: Column) -> Column:
    """A phrase of the expected magnitude is in the text."""
    word, text = F.lower(F.trim(F.coalesce(expected, F.lit("")))), F.lower(F.coalesce(prediction, F.lit("")))
    out = F.lit(False)
    for k, phrases in MAGNITUDES.items():
        out = F.when(word == k, text.rlike(phrases)).otherwise(out)
    return out


def counterfactual_question(variable: Column, change: Column) -> Column:
    return F.format_string("If %s were %s, how would the outcome change? Describe specifically.", variable, change)


def judge_score(reply: Column, default: float = 0.5) -> Column:
    """The first number that begins with 0 or 1, clipped to 0..1; the default without one; null without a reply."""
    found = F.regexp_extract(reply, r"[0-1](\.\d+)?", 0)
    return F.when(reply.isNull(), None).when(found == "", default).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), found.try_cast("double"))))


def draft_json(reply: Column) -> Column:
    """The JSON object in a reply, from its first to its last brace; null without one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def draft_item(reply: Column, video_path: Column, domain: Column, physics: Column) -> Column:
    """A candidate item from a reply, with an id that depends on its content; null where there is no object."""
    text = draft_json(reply)
    x = F.from_json(text, QA_ITEM)
    made = {
        "item_id": F.sha2(F.concat_ws("|", video_path, text), 256),
        "video_path": video_path,
        "domain": domain,
        "physics_category": physics,
        "requires_temporal": F.coalesce(x["requires_temporal"], F.lit(True)),
        "language_prior_score": F.lit(0.0),
        "annotator_agreement": F.lit(0.0),
        "difficulty": F.lit(0.0),
        "discrimination": F.lit(1.0),
        "tags": F.coalesce(x["tags"], F.array().cast("array<string>")),
    }
    return F.when(text.isNotNull(), F.struct(*(made.get(f.name, x[f.name]).cast(f.dataType).alias(f.name) for f in QA_ITEM)))
