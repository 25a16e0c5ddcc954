"""Timed captions: WebVTT and JSON3 texts as arrays of (start, end, text)."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from kgloom.functions.text import LINE_END, stripped, timestamp_seconds

_STAMPED = ArrayType(StructType().add("start", StringType()).add("end", StringType()).add("text", StringType()))
# What counts as a cue, a clock origin, a tag and a payload that is no speech.
_CUE = re.compile(r"\s*([\d:.,]+)\s+-->\s+([\d:.,]+)")
_ORIGIN = r"X-TIMESTAMP-MAP=LOCAL:([^,\s]+),MPEGTS:(\d+)"
_TAG = re.compile(r"<[^>]+>")
PAYLOAD = r"^(#EXTM3U|#EXT-X-|\{|\[|<\?xml)|^(?i:<(!doctype|html|head|body|error)([^\p{L}\p{N}_]|\z))"
HEADERS = r"^(WEBVTT|Kind:|Language:|NOTE|X-TIMESTAMP-MAP|STYLE|REGION)|-->|^\d+\z"
BEFORE = r"^[\x{FEFF} \r\n\t]+"
_JSON3 = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"


def _cues(text: str | None) -> list[dict[str, str]]:
    """Stamps and texts; a cue's text ends at a blank line or at the next arrow."""
    found: list[tuple[str, str, list[str]]] = []
    body: list[str] | None = None
    for line in (text or "").splitlines():
        if "-->" in line or not line.strip():
            cue, body = _CUE.match(line), None
            if cue:
                body = []
                found.append((cue[1], cue[2], body))
        elif body is not None:
            body.append(line.strip())
    return [{"start": a, "end": b, "text": html.unescape(_TAG.sub("", "\n".join(lines))).strip()} for a, b, lines in found]


@F.pandas_udf(_STAMPED)
def _stamped(texts: pd.Series) -> pd.Series:
    return texts.map(_cues)


def vtt_segments(text: Column | str) -> Column:
    """Cues of a WebVTT text, without tags and with entities decoded; blank ones are left to `valid_segments`. A text whose clock does not start at zero has none."""
    text = F.col(text) if isinstance(text, str) else text
    local, ticks = (F.regexp_extract(text, _ORIGIN, k) for k in (1, 2))
    zero = (local != "") & (timestamp_seconds(local) == 0) & F.rlike(ticks, F.lit(r"^0+\z"))
    timed = F.transform(_stamped(text), lambda c: F.struct(timestamp_seconds(c["start"]).alias("start"), timestamp_seconds(c["end"]).alias("end"), c["text"].alias("text")))
    cues = F.filter(timed, lambda c: c["start"].isNotNull() & c["end"].isNotNull())
    return F.when(~F.contains(text, F.lit("X-TIMESTAMP-MAP")) | zero, cues).otherwise(F.slice(cues, 1, 0))


def vtt_text(text: Column) -> Column:
    """Lines of speech, each at its first occurrence only, without headers, times and numbers; then tags are cut within a line."""
    lines = F.transform(F.split(text, LINE_END), stripped)
    spoken = F.filter(lines, lambda s: (s != "") & ~F.rlike(s, F.lit(HEADERS)))
    plain = _each_unescaped(F.transform(spoken, lambda s: F.regexp_replace(s, "<[^>]+>", "")))
    return F.array_join(F.array_distinct(F.filter(plain, lambda s: s != "")), "\n")


@F.pandas_udf(ArrayType(StringType()))
def _each_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda all_: None if all_ is None else [html.unescape(s) for s in all_])


def json3_segments(text: Column) -> Column:
    """Cues of a JSON3 text, with entities decoded; events without times are left out, and a text that is no JSON gives null (an error of that row alone)."""
    events = F.filter(F.from_json(text, _JSON3)["events"], lambda e: e["tStartMs"].isNotNull() & e["dDurationMs"].isNotNull() & e["segs"].isNotNull())
    said = _each_unescaped(F.transform(events, lambda e: F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), "")))
    cue = lambda e, t: F.struct((e["tStartMs"] / 1000).alias("start"), ((e["tStartMs"] + e["dDurationMs"]) / 1000).alias("end"), stripped(t).alias("text"))
    return F.zip_with(events, said, cue)


def valid_transcript(text: Column) -> Column:
    """False for a blank text, a playlist, JSON, XML or HTML payload, or lines that all start as URLs."""
    body = F.regexp_replace(text, BEFORE, "")
    lines = F.filter(F.transform(F.split(body, LINE_END), stripped), lambda s: s != "")
    return F.coalesce((body != "") & ~F.rlike(body, F.lit(PAYLOAD)) & ~F.forall(lines, lambda s: F.rlike(s, F.lit("^https?://"))), F.lit(False))
