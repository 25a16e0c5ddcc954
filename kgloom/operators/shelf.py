"""What a reader is shown: lists of judgments and of their changes, and where each document stands."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.language import stamp
from kgloom.functions.text import stripped
from kgloom.sources.routing import video_in
from kgloom.store import shared_folder

# How much of a text and of a note is shown, how long a list is and how long a target may be.
TEXT_CHARS, NOTE_CHARS, LISTED, NEWEST, TARGET_CHARS = 150_000, 60_000, 250, 100, 2_000

_SCOPES = {"all": F.lit, "included": lambda _: F.col("included"), "reviewed": lambda _: F.col("reviewed"), "unreviewed": lambda _: ~F.col("reviewed")}


def _holds(texts: list[str], asked: str) -> Column:
    """Whether the texts, joined by a space, hold what is asked for, in any case."""
    wanted = asked.strip().lower()
    return F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))), F.lit(wanted)) if wanted else F.lit(True)


def matching_records(records: DataFrame, asked: str = "", kind: str = "all", scope: str = "all") -> DataFrame:
    """Records (title, note, kind, reviewed, included, ...) whose title or note holds `asked`, of a kind and of a scope (all, included, reviewed or unreviewed)."""
    if scope not in _SCOPES:
        raise ValueError(f"unknown scope {scope}")
    of_kind = F.lit(True) if kind == "all" else F.col("kind") == kind
    return records.filter(_holds(["title", "note"], asked) & of_kind & _SCOPES[scope](True))


def listed_records(records: DataFrame, asked: str = "", kind: str = "all", scope: str = "all", most: int = LISTED) -> DataFrame:
    """The first `most` of the matching records, by place."""
    return matching_records(records, asked, kind, scope).orderBy("place").limit(most)


def matching_history(history: DataFrame, records: DataFrame, asked: str = "", kind: str = "all") -> DataFrame:
    """Changes (memory_key, ...) of the records (key, title, kind) whose title holds `asked`, of a kind; those of records that are gone only where nothing is asked."""
    known = records.select(F.col("key").alias("memory_key"), "title", "kind").dropDuplicates(["memory_key"])
    rows = history.join(known, "memory_key", "left")
    of_kind = F.lit(True) if kind == "all" else F.col("kind") == kind
    return rows.filter(F.coalesce(_holds(["title"], asked) & of_kind, F.lit(False)))


def with_judgment(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Shown entities and triples `rows` (kind, id) with the judgment on each: key, reviewed and included of the current record of its kind and target.

    records: key, kind, current, target_id, current_target_id (where a merge moved it; else null), reviewed, included. Of several
    records of one target the least key counts; what has none is neither reviewed nor included.
    """
    target = F.coalesce("current_target_id", "target_id")
    own = records.filter("current").select("kind", target.alias("id"), F.struct("key", "reviewed", "included").alias("r")).groupBy("kind", "id").agg(F.min_by("r", F.col("r.key")).alias("r"))
    no = F.lit(False)
    return rows.join(own, ["kind", "id"], "left").select(*rows.columns, "r.key", F.coalesce("r.reviewed", no).alias("reviewed"), F.coalesce("r.included", no).alias("included"))


def target_kind(kind: Column, layer: str) -> Column:
    """The kind under which an entity of a type, or any triple, is judged."""
    return F.lit("triple") if layer == "triples" else F.when(kind == "Claim", "claim").otherwise("entity")


def memory_history(judged: DataFrame, at: Column) -> DataFrame:
    """Rows of history (memory_key, before_state, after_state, source_id, created_at) of judged updates (judgments.judged_updates) that change a record."""
    state = lambda revision, prefix: F.struct(*(F.col(prefix + c).alias(c) for c in ("reviewed", "included", "stance", "note")), revision.alias("revision"))
    now = F.col("is_now")
    source = F.coalesce("source_id", F.lit("")) if "source_id" in judged.columns else F.lit("")
    return judged.filter("outcome = 'changed'").select(F.col("key").alias("memory_key"), state(now, "old_").alias("before_state"), state(now + 1, "").alias("after_state"), source.alias("source_id"), at.alias("created_at"))


def known_sources(judged: DataFrame, contents: DataFrame) -> DataFrame:
    """Judged updates with source_id (blank or null: none): outcome is source where that document does not exist, unless a fault of the fields was found first."""
    known = contents.select(F.col("id").alias("source_id"), F.lit(True).alias("_known")).dropDuplicates(["source_id"])
    lost = F.col("_known").isNull() & (F.coalesce("source_id", F.lit("")) != "") & ~F.col("outcome").isin("stance", "note")
    return judged.join(known, "source_id", "left").withColumn("outcome", F.when(lost, "source").otherwise(F.col("outcome"))).select(judged.columns)


def by_status(contents: DataFrame) -> DataFrame:
    """`contents`, written to the shared folder with a partition for each status and read back: what one status holds is read without the others."""
    path = f"{shared_folder(contents.sparkSession)}/tables/{uuid.uuid4().hex}"
    contents.write.partitionBy("status").parquet(path)
    return contents.sparkSession.read.schema(contents.schema).parquet(path)


def processed(contents: DataFrame) -> DataFrame:
    """Documents whose analysis is done."""
    return contents.filter("status = 'processed'")


def resolved_targets(targets: DataFrame, contents: DataFrame, selected: str = "") -> DataFrame:
    """`targets` (target: a document's id, a text with a link to a video, or blank for the selected one) with id and fault: invalid (null or over 2,000 characters), missing or null."""
    asked = F.coalesce(F.nullif(stripped(F.col("target")), F.lit("")), F.lit(selected))
    valid = F.coalesce(F.char_length("target") <= TARGET_CHARS, F.lit(False))
    wanted = F.when(valid, F.coalesce(F.concat(F.lit("yt:"), video_in(asked)), asked))
    known = contents.select(F.col("id").alias("wanted"), F.lit(True).alias("known")).dropDuplicates(["wanted"])
    rows = targets.withColumns({"wanted": wanted, "valid": valid}).join(known, "wanted", "left")
    return rows.select(*targets.columns, F.when(F.col("known"), F.col("wanted")).alias("id"), F.when(~F.col("valid"), "invalid").when(F.col("known").isNull(), "missing").alias("fault"))


def newest_documents(contents: DataFrame, most: int = NEWEST) -> DataFrame:
    """(id, title, kind, url, status) of the last `most` documents by place."""
    return contents.orderBy(F.desc("place")).limit(most).select("id", "title", "kind", "url", "status")


def document_status(contents: DataFrame, texts: DataFrame, notes: DataFrame, triples: DataFrame, version: int) -> DataFrame:
    """Where each document stands: whether its analysis is of the text as it is now and its note says the summary, with the heads of both.

    contents: id, title, source, summary, stamped (struct of sha256, chars and version of what was analysed, or null), snapshot (null where the
    analysis is not stored whole); texts (id, text) and notes (id, note), one of each id at most; triples: source. What may be done:
    reanalyze is fetch for a video, text for another document with a text, else null; sync is ready, stale (analysed from another text) or snapshot (none is stored).
    """
    counted = triples.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("relations"))
    rows = contents.join(texts.select("id", "text"), "id", "left").join(notes.select("id", "note"), "id", "left").join(counted, "id", "left")
    text, note, summary = (F.coalesce(c, F.lit("")) for c in ("text", "note", "summary"))
    size, now = F.char_length(text), stamp(F.col("text"), version)
    same = [F.col("stamped")[c].eqNullSafe(now[c]) for c in ("sha256", "chars", "version")]
    current = (size > 0) & same[0] & same[1] & same[2]
    rows = rows.withColumn("analysis_current", F.coalesce(current, F.lit(False)))
    sync = F.when(~F.col("analysis_current"), "stale").when(F.col("snapshot").isNull(), "snapshot").otherwise("ready")
    return rows.select(
        "id", "title", "analysis_current", size.alias("source_characters"), F.when(F.col("stamped.chars").isNotNull(), F.least(F.col("stamped.chars"), F.lit(TEXT_CHARS))).alias("analyzed_characters"),
        ((summary != "") & F.contains(note, summary)).alias("note_matches_summary"), F.substring(note, 1, NOTE_CHARS).alias("note_text"), F.substring(text, 1, TEXT_CHARS).alias("source_transcript"),
        (size > TEXT_CHARS).alias("transcript_truncated"), F.coalesce("relations", F.lit(0)).alias("source_relations"),
        F.when(F.col("source") == "youtube", "fetch").when(size > 0, "text").alias("reanalyze"), sync.alias("sync"),
    )


def slide_offsets(slides: DataFrame) -> DataFrame:
    """`slides` (doc, idx, start, end, timeline_start) with offset: where each begins on the joined timeline, as it says or else where the one before ends."""
    in_order = Window.partitionBy("doc").orderBy("idx")
    said = slides.withColumn("_said", F.last(F.when(F.col("timeline_start").isNotNull(), F.col("idx")), ignorenulls=True).over(in_order))
    run = Window.partitionBy("doc", "_said").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end") - F.col("start")
    before = F.sum(length).over(run) - length + F.coalesce(F.first("timeline_start").over(run), F.lit(0.0))
    return said.withColumn("offset", F.round(before, 3)).drop("_said")


def slide_cues(slides: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, start, end, text) of captions (doc, idx, start, end, text; times within their slide) on the joined timeline."""
    at = slide_offsets(slides).select("doc", "idx", "offset")
    return captions.join(at, ["doc", "idx"]).select("doc", *(F.round(F.col("offset") + F.col(c), 3).alias(c) for c in ("start", "end")), "text")


def clip_plan(slides: DataFrame, untitled: str = "片段") -> DataFrame:
    """(doc, plan, fault): the cuts of each recording as lines of CSV (start, end, title), in order of idx; fault where a slide has no times in order, and no plan then.

    A slide without a title is numbered; a title with a comma, quotation mark or line end stands in quotation marks.
    """
    sane = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("start", "end")]
    good = F.coalesce(sane[0] & sane[1] & (F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False))
    k = F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit(untitled + " "), k.cast("string")))
    cell = F.when(F.rlike(title, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(title, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(title)
    line = F.concat(F.format_string("%.3f,%.3f,", "start", "end"), cell, F.lit("\r\n"))
    lines = slides.select("doc", k.alias("k"), good.alias("good"), F.when(good, line).alias("line")).groupBy("doc").agg(F.bool_and("good").alias("good"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    whole = F.concat(F.lit("start,end,title\r\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return lines.select("doc", F.when(F.col("good"), whole).alias("plan"), F.when(~F.col("good"), "times").alias("fault"))


def probed_duration(log: Column) -> Column:
    """Seconds of the first `Duration: h:m:s` in what a media probe says; null where there is none above zero."""
    part = lambda k: F.regexp_extract(log, r"Duration:\s*([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)", k).try_cast("double")
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when((seconds > 0) & (seconds < float("inf")), seconds)
