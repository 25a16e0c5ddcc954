"""Checks of media manifests: nested arrays are judged in place, each manifest by its first fault.

A manifest is (id, version, subtitle_language, status, mode, backend, duration, summary_steps: array<string>,
slides: array<struct<start, end, text, captions: array<struct<start, end, text, summary_index>>>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import stripped

# The version and languages of aligned captions, and how far one may end after its slide.
VERSION, LANGUAGES, SLACK = 1, ("zh", "mixed"), 0.005


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _spans(x: Column) -> Column:
    """Whether start and end are finite times in order."""
    return _finite(x["start"]) & _finite(x["end"]) & F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]), F.lit(False))


def _said(text: Column) -> Column:
    return F.coalesce(stripped(text) != "", F.lit(False))


def _first(faults: Column) -> Column:
    """The first element that is not null."""
    return F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0))


def _fault(name: str, slide: Column, caption: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(name).alias("fault"), slide.cast("int").alias("slide"), (none if caption is None else caption.cast("int")).alias("caption"))


def alignment_fault() -> Column:
    """(fault, slide, caption) of what first keeps a manifest's captions from being aligned; null where all is well.

    Faults: version, language, steps (missing, or one of them is), slides (none), then slide by slide times, captions (none) and
    text, then caption by caption text, times (which may pass the slide's length by SLACK) and index (of no summary step).
    """
    steps = F.size("summary_steps")

    def of_caption(slide: Column, i: Column):
        length = slide["end"] - slide["start"]
        wrong = lambda c: F.coalesce((c["summary_index"] < 0) | (c["summary_index"] >= steps), F.lit(False))
        return lambda c, j: F.when(~_said(c["text"]), _fault("caption text", i, j)).when(~(_spans(c) & F.coalesce(c["end"] <= length + SLACK, F.lit(False))), _fault("caption times", i, j)).when(wrong(c), _fault("caption index", i, j))

    def of_slide(s: Column, i: Column) -> Column:
        early = F.when(s.isNull() | ~_spans(s), _fault("times", i)).when(F.coalesce(F.size(s["captions"]), F.lit(0)) < 1, _fault("captions", i)).when(~_said(s["text"]), _fault("text", i))
        return F.coalesce(early, _first(F.transform(s["captions"], of_caption(s, i))))

    whole = F.lit(None)
    head = F.when(~F.col("version").eqNullSafe(F.lit(VERSION)), _fault("version", whole)).when(~F.coalesce(F.col("subtitle_language").isin(*LANGUAGES), F.lit(False)), _fault("language", whole))
    head = head.when(F.col("summary_steps").isNull() | F.exists("summary_steps", lambda s: s.isNull()), _fault("steps", whole)).when(F.coalesce(F.size("slides"), F.lit(0)) < 1, _fault("slides", whole))
    return F.coalesce(head, _first(F.transform("slides", of_slide)))


def playable_fault(mode: str) -> Column:
    """(fault, slide, caption) of what first keeps a manifest from being played in a mode: status, mode, duration, slides, times."""
    whole = F.lit(None)
    head = F.when(~F.col("status").eqNullSafe(F.lit("ready")), _fault("status", whole)).when(~F.col("mode").eqNullSafe(F.lit(mode)), _fault("mode", whole)).when(~(_finite(F.col("duration")) & F.coalesce(F.col("duration") > 0, F.lit(False))), _fault("duration", whole)).when(F.coalesce(F.size("slides"), F.lit(0)) < 1, _fault("slides", whole))
    return F.coalesce(head, _first(F.transform("slides", lambda s, i: F.when(s.isNull() | ~_spans(s), _fault("times", i)))))


def checked(manifests: DataFrame, mode: str, backend: str, most: int = 500, speed: float = 100.0) -> DataFrame:
    """`manifests` with alignment and playable (first faults) and cached: whether what is stored can be shown as it is.

    A stored manifest needs slides that are all sane segments of their own, none of over `most` characters spoken
    at more than `speed` a second; to be shown it is ready, aligned and by the `backend`.
    """
    size = lambda s: F.length(F.regexp_replace(s["text"], r"\s", ""))
    sane = F.forall("slides", lambda s: F.coalesce(_spans(s) & _said(s["text"]) & ~((size(s) > most) & (size(s) > speed * (s["end"] - s["start"]))), F.lit(False)))
    apart = F.size(F.array_distinct(F.transform("slides", lambda s: F.struct(s["start"], s["end"], s["text"])))) == F.size("slides")
    out = manifests.withColumns({"alignment": alignment_fault(), "playable": playable_fault(mode)})
    stored = (F.col("status") == "ready") & (F.size("slides") > 0) & sane & apart
    state = F.when(F.coalesce(stored & F.col("alignment").isNull() & (F.col("backend") == backend), F.lit(False)), "ready").when(F.coalesce(stored, F.lit(False)), "to be aligned").otherwise("to be made")
    return out.withColumn("cached", state)


def step_places(stored: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc, step, place) of each step of `stored` (doc, step, text): the same place in `shown` (doc, place, text) if that has its text, else the only place that has; null where several or none do."""
    here = shown.select("doc", F.col("place").alias("step"), F.col("text").alias("there"))
    only = shown.groupBy("doc", "text").agg(F.count("*").alias("n"), F.min("place").alias("only"))
    both = stored.join(here, ["doc", "step"], "left").join(only, ["doc", "text"], "left")
    return both.select("doc", "step", F.when(F.col("there") == F.col("text"), F.col("step")).when(F.col("n") == 1, F.col("only")).alias("place"))
