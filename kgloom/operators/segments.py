"""Timed segments: rows (doc, start, end, text) in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_segments(rows: DataFrame, most: int = 500, speed: float = 100.0) -> DataFrame:
    """Distinct segments of sane times and text; a timeline with one implausible segment (over `most` non-space characters, faster than `speed` a second) is empty."""
    sane = ~F.isnan("start") & ~F.isnan("end") & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") < float("inf")) & (F.trim("text") != "")
    rows = rows.filter(sane).dropDuplicates(["doc", "start", "end", "text"])
    size = F.length(F.regexp_replace("text", r"\s", ""))
    veto = F.max(((size > most) & (size > speed * (F.col("end") - F.col("start")))).cast("int")).over(Window.partitionBy("doc"))
    return rows.withColumn("_veto", veto).filter("_veto = 0").drop("_veto")


def islands(rows: DataFrame) -> DataFrame:
    """Unions of overlapping or touching segments: doc, start, end, n."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def timeline(clips: DataFrame) -> DataFrame:
    """Clips, in order of start, with where each begins and ends when they play one after another."""
    order = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("end") - F.col("start")).over(order)
    return clips.withColumns({"timeline_end": end, "timeline_start": end - (F.col("end") - F.col("start"))})


def _bucketed(clips: DataFrame, width: float) -> DataFrame:
    return clips.withColumn("_b", F.explode(F.sequence(F.floor(F.col("clip_start") / width) - 1, F.floor(F.col("clip_end") / width) + 1)))


def contained(cues: DataFrame, clips: DataFrame, slack: float = 0.002, width: float = 600.0) -> DataFrame:
    """Cues that lie in a clip (doc, clip_start, clip_end), with times from the clip's start; an equi-join on document and time bucket."""
    keyed = cues.withColumn("_b", F.floor(F.col("start") / width))
    inside = keyed.join(_bucketed(clips, width), ["doc", "_b"]).filter((F.col("start") >= F.col("clip_start") - slack) & (F.col("end") <= F.col("clip_end") + slack))
    length = F.col("clip_end") - F.col("clip_start")
    return inside.withColumns({"from": F.round(F.greatest(F.lit(0.0), F.col("start") - F.col("clip_start")), 3), "to": F.round(F.least(length, F.col("end") - F.col("clip_start")), 3)}).drop("_b")


def active_at(times: DataFrame, cues: DataFrame, width: float = 600.0) -> DataFrame:
    """For each (doc, t) the last cue that has begun and not ended: start of it, or null; an equi-join on document and the buckets of time that a cue touches."""
    spread = cues.select("doc", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    keyed = times.withColumn("_b", F.floor(F.col("t") / width))
    hits = keyed.join(spread, ["doc", "_b"], "left").groupBy("doc", "t").agg(F.max(F.when((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")), F.col("start"))).alias("cue_start"))
    return times.join(hits, ["doc", "t"], "left")


def greedy_windows(rows: DataFrame, width: float) -> DataFrame:
    """Windows anchored at the first unused segment, with those that start and end within `width` of it; one that crosses the end opens the next. Per document, in one fold."""
    listed = rows.filter(F.col("end") - F.col("start") <= width).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    empty = F.array().cast("array<struct<start:double,end:double,n:int>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (x["end"] <= last["start"] + width)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), (last["n"] + 1).alias("n"))
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("n"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return listed.select("doc", F.inline(F.aggregate("s", empty, step)))


def best_apart(clips: DataFrame, most: int, shortest: float = 1.0) -> DataFrame:
    """Of (doc, start, end, score) up to `most` clips a document, by falling score and then start, none overlapping a better one or shorter than `shortest`; one fold a document."""
    listed = clips.filter(F.col("end") - F.col("start") >= shortest).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "start", "end"))).alias("s"))
    empty = F.array().cast("array<struct<back:double,start:double,end:double>>")

    def step(acc, x):
        apart = ~F.exists(acc, lambda c: (c["start"] < x["end"]) & (c["end"] > x["start"]))
        return F.when((F.size(acc) < most) & apart, F.concat(acc, F.array(x))).otherwise(acc)

    return listed.select("doc", F.inline(F.aggregate("s", empty, step))).select("doc", "start", "end", (-F.col("back")).alias("score"))


def batches(cues: DataFrame, most: int = 12, chars: int = 1600) -> DataFrame:
    """Cues (doc, start, end, text) with `batch`, from 0: a cue opens a batch when the last one has `most` cues, or would hold over `chars` characters."""
    listed = cues.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("s"))
    start = F.struct(F.lit(-1).alias("b"), F.lit(most).alias("n"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        size = F.char_length(x["text"])
        opens = (acc["n"] >= most) | (acc["c"] + size > chars)
        b = acc["b"] + opens.cast("int")
        return F.struct(b.alias("b"), F.when(opens, 1).otherwise(acc["n"] + 1).alias("n"), F.when(opens, size).otherwise(acc["c"] + size).alias("c"), F.concat(acc["out"], F.array(b)).alias("out"))

    both = listed.select("doc", F.inline(F.arrays_zip("s", F.aggregate("s", start, step)["out"].alias("batch"))))
    return both.select("doc", "s.start", "s.end", "s.text", "batch")
