"""Watch lists exported as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def video_id(cell: Column) -> Column:
    """The 11-character id of a cell, bare or in a link; else null."""
    cell = F.trim(F.regexp_replace(cell, '^﻿?"?|"$', ""))
    linked = F.regexp_extract(cell, r"(?:[?&]v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    return F.when(F.rlike(cell, F.lit(r"^[A-Za-z0-9_-]{11}$")), cell).otherwise(F.nullif(linked, F.lit("")))


def takeout_ids(rows: DataFrame) -> DataFrame:
    """(id, ord, cell) of the first occurrence of each id in rows (ord, line)."""
    cells = rows.select("ord", F.posexplode(F.split("line", ",")).alias("cell", "value")).select("ord", "cell", video_id(F.col("value")).alias("v")).filter("v IS NOT NULL")
    return cells.groupBy("v").agg(F.min(F.struct("ord", "cell")).alias("f")).select(F.concat(F.lit("yt:"), "v").alias("id"), "f.ord", "f.cell")


def article_id(url: Column) -> Column:
    return F.concat(F.lit("163:"), F.substring(F.sha1(url.cast("binary")), 1, 12))
