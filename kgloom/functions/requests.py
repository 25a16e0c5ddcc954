"""What a request may say: flags, limits and modes as texts, each judged in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import stripped

# The words for yes and no, and the bounds of a list's length and of a search's.
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
MODES = ("terms", "phrase")
LIMIT, TOP = (50, 1, 500), (20, 1, 200)
_WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*\z"


def flag(value: Column, default: bool) -> Column:
    """Yes or no; the default where nothing is said, null for any other text."""
    word = F.lower(stripped(value))
    return F.when(value.isNull(), default).when(word.isin(*YES), True).when(word.isin(*NO), False)


def bounded(value: Column, default: int, least: int, most: int) -> Column:
    """A whole number from `least` to `most`; the default where nothing is said, null for any other text."""
    said = stripped(value)
    number = F.when(F.rlike(said, F.lit(_WHOLE)), F.regexp_replace(said, "[_+]", "").try_cast("decimal(38,0)"))
    return F.when(value.isNull(), default).when(number.between(least, most), number.cast("int"))


def judged_requests(requests: DataFrame) -> DataFrame:
    """`requests` (mode, expand, top, limit: texts, null where nothing is said) with what they mean, and fault: the first of mode, expand, top and limit that cannot be read, else null."""
    mode = F.lower(stripped(F.coalesce("mode", F.lit(MODES[0]))))
    meant = {"mode": F.when(mode.isin(*MODES), mode), "expand": flag(F.col("expand"), True), "top": bounded(F.col("top"), *TOP), "limit": bounded(F.col("limit"), *LIMIT)}
    fault = F.coalesce(*(F.when(c.isNull(), name) for name, c in meant.items()))
    return requests.withColumns({**{f"_{name}": c for name, c in meant.items()}, "fault": fault}).drop(*meant).withColumnsRenamed({f"_{name}": name for name in meant})


# What JSON texts write for the characters that they cannot hold.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_text(text: Column) -> Column:
    """A text in JSON, characters beyond ASCII as they are; null as null."""
    escapes = ESCAPES | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in ESCAPES}
    usual = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), list(escapes.items())[:5], text)
    whole = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), list(escapes.items())[5:], usual)
    return F.coalesce(F.concat(F.lit('"'), F.when(F.rlike(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), whole).otherwise(usual), F.lit('"')), F.lit("null"))


def json_texts(texts: Column) -> Column:
    """An array of texts in JSON; null as null."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(texts, json_text), ", "), F.lit("]")), F.lit("null"))


def cache_key(version: int, mode: Column) -> Column:
    """The key under which what was made of a document (id, url, summary, key_points, source_sha256) in a mode is kept: it changes with any of them."""
    parts = [F.lit(str(version)), *map(json_text, (mode, F.col("id"), F.col("url"), F.col("summary"))), json_texts(F.col("key_points")), json_text(F.col("source_sha256"))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).cast("binary"), 256)
