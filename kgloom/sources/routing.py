"""Where a link or a payload belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.sources.takeout import article_id

# Hosts of the two sources, and the order in which caption tracks are taken.
VIDEO_ADDRESS = r"(?i:https?://)(?:(?i:(?:www\.)?youtu\.be)(?::\d*)?/+|(?i:(?:www\.|m\.)?youtube\.com)(?::\d*)?/(?:(?:shorts|live|embed)/|watch\?(?:[^#]*?&)?v=))([A-Za-z0-9_-]{11})(?=[/?#&]|\z)"
VIDEO_ID = r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})"
KINDS = ("official", "automatic")
LANGUAGES = ("zh-Hans", "zh", "en")


def item_id(url: Column) -> Column:
    """The content id of a supported link: an article's or a video's; null for any other link."""
    video = F.nullif(F.regexp_extract(url, VIDEO_ID, 1), F.lit(""))
    return F.when(F.contains(url, F.lit("163.com")), article_id(url)).when(F.contains(url, F.lit("youtube.com")) | F.contains(url, F.lit("youtu.be")), F.concat(F.lit("yt:"), video))


def caption_format(payload: Column) -> Column:
    """hls, json3 or vtt, by how a caption payload begins or, of the last, by an arrow in it; null for any other."""
    body = F.regexp_replace(payload, r"^[\x{FEFF}\s]+", "")
    return F.when(F.startswith(body, F.lit("#EXTM3U")), "hls").when(F.startswith(body, F.lit("{")), "json3").when(F.startswith(body, F.lit("WEBVTT")) | F.contains(body, F.lit("-->")), "vtt")


def video_in(text: Column) -> Column:
    """The id of the first link in a text that leads to a video: a known host with a path of its own; null where there is none, however like one a link looks."""
    links = F.transform(F.regexp_extract_all(text, F.lit(r'https?://[^\s<>"\])]+'), F.lit(0)), lambda u: F.regexp_replace(u, "[。，；]+$", ""))
    ids = F.transform(links, lambda u: F.regexp_extract(u, "^" + VIDEO_ADDRESS, 1))
    return F.get(F.filter(ids, lambda i: i != ""), F.lit(0))


def preferred_tracks(tracks: DataFrame) -> DataFrame:
    """One track (doc, kind, lang, url) a document: official before automatic, then by language; tracks of other kinds or languages are never taken."""
    place = lambda column, known: F.array_position(F.array(*map(F.lit, known)), F.col(column))
    ranked = tracks.filter(F.col("kind").isin(*KINDS) & F.col("lang").isin(*LANGUAGES))
    best = ranked.groupBy("doc").agg(F.min(F.struct(place("kind", KINDS).alias("k"), place("lang", LANGUAGES).alias("l"), "url", "kind", "lang")).alias("b"))
    return best.select("doc", "b.kind", "b.lang", "b.url")
