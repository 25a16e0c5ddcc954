"""Scalar text functions of the graph engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# White space as Unicode text trimming takes it, and the patterns of sentences, tokens and slugs, which decide results.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SENTENCE_END = rf"(?<=[。！？!?]){BLANK}*|\n+"
TOKEN = r"[a-z0-9]{3,}|[㐀-鿿]{2}"
SLUG_DROPS = r'[\\/:*?"<>|#^\[\]]'


def stripped(text: Column) -> Column:
    """`text` without white space at its ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def folded(text: str) -> str:
    """NFKC, case folding, trimmed, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def normalize(names: pd.Series) -> pd.Series:
    """`folded` names; apply it to distinct ones."""
    return names.map(lambda s: None if s is None else folded(s))


def tokens(text: Column) -> Column:
    """Distinct latin or digit runs of three or more, and pairs of Han characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut after a full stop, exclamation or question mark (ASCII full stops do not cut) and at line ends."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def mentioned(text: Column, name: Column) -> Column:
    """Whether `name` occurs: an ASCII name as a whole word in any case, another as a folded substring; a blank one never."""
    literal = F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # a name may hold the end of a quotation
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), literal, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.coalesce(F.when((F.trim(name) == "") | ~F.contains(F.lower(text), F.lower(name)), False).when(name.rlike(r"^[\x00-\x7f]+$"), F.rlike(text, quoted)).otherwise(text.isNotNull() & name.isNotNull()), F.lit(False))


def slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, SLUG_DROPS, "")), F.lit("")), F.lit("untitled"))


def timestamp_seconds(stamp: Column) -> Column:
    """Seconds of [hh:]mm:ss with a dot or comma before the fraction; null for anything else."""
    parts = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p.try_cast("double"))
    return F.when(F.size(parts).isin(2, 3), total)


def srt_stamp(seconds: Column) -> Column:
    """hh:mm:ss,mmm, rounded to milliseconds."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def categories(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """Names of the rules (name, regex) that match, in order; else the fallback."""
    found = F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(regex)), F.lit(name)) for name, regex in rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))
