"""Personal judgments on assertions: targets keyed by what they say, saved records, and the baseline for a new source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.graph import with_names

STANCED = ("claim", "triple")
# The stances.
STANCES = ("unset", "agree", "uncertain", "disagree")


def triple_targets(named: DataFrame) -> DataFrame:
    """(key, kind, title, source) of named triples; another name or source gives another key, so that approval never moves on."""
    names, none = ("subject", "predicate", "object"), (1 << 21) - 1
    said = F.concat_ws("\x1f", F.lit("triple"), *(F.coalesce(c, F.lit("")) for c in (*names, "source"))).alias("said")
    # What is said moves once, neither hashed nor doubled in a title; three lengths in a number, of a null `none`, tell its parts.
    lengths = reduce(lambda all_, c: all_ * (none + 1) + F.coalesce(F.length(c), F.lit(none)), names, F.lit(0).cast("long"))
    rows = named.groupBy(said).agg(F.min(lengths).alias("n"))
    size = [F.shiftrightunsigned("n", 21 * (2 - i)).bitwiseAND(none).cast("int") for i in range(3)]
    wide = [F.when(n == none, 0).otherwise(n) for n in size]
    start = [F.lit(len("triple") + 2)]
    for n in wide:
        start.append(start[-1] + n + 1)
    part = [F.when(n != none, F.substring("said", at, n)) for n, at in zip(size, start, strict=False)]
    return rows.select(F.sha2(F.col("said").cast("binary"), 256).alias("key"), F.lit("triple").alias("kind"), F.concat_ws(" ", *part).alias("title"), F.substring("said", start[3], F.length("said")).alias("source"))


def records(targets: DataFrame, saved: DataFrame, redirects: DataFrame) -> DataFrame:
    """Current targets and saved (key, reviewed, included, stance) ones, with defaults for what is not saved; redirects (key, target_id) of merged ones."""
    both = targets.join(saved, "key", "full_outer").join(redirects, "key", "left")
    return both.select("key", "title", F.col("kind").isNotNull().alias("current"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("reviewed", "included")), F.coalesce("stance", F.lit("unset")).alias("stance"), "target_id")


def baseline(snapshots: DataFrame, source: str, most: int = 150, chars: int = 120_000) -> DataFrame:
    """Reviewed and included judgments with a stance that do not come from `source`. More than `most`, or titles of over `chars` characters in all, are an error: none is left out in silence.

    snapshots: key, kind, title, sources (array), reviewed, included, stance.
    """
    fit = snapshots.filter(F.col("kind").isin(*STANCED) & F.col("reviewed") & F.col("included") & (F.col("stance") != "unset") & ~F.array_contains("sources", source))
    size = fit.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("title")), F.lit(0)).alias("chars")).first()
    if size["n"] > most:
        raise ValueError(f"{size['n']:,} judgments to compare, {most:,} at most")
    if size["chars"] > chars:
        raise ValueError(f"judgments of {size['chars']:,} characters to compare, {chars:,} at most")
    return fit


def baselines(snapshots: DataFrame, sources: DataFrame, most: int = 150, chars: int = 120_000) -> DataFrame:
    """(source, judgments, characters, outcome) for each of `sources` (source): how many judgments there are to compare with, and none, many, long or ready. What all have in common is counted once."""
    fit = snapshots.filter(F.col("kind").isin(*STANCED) & F.col("reviewed") & F.col("included") & (F.col("stance") != "unset")).withColumn("c", F.char_length("title"))
    whole = fit.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    own = fit.select(F.explode(F.array_distinct("sources")).alias("source"), "c").groupBy("source").agg(F.count("*").alias("own_n"), F.sum("c").alias("own_c"))
    rows = sources.select("source").distinct().join(own, "source", "left").fillna(0, ["own_n", "own_c"])
    rows = rows.select("source", (F.lit(whole["n"]) - F.col("own_n")).alias("judgments"), (F.lit(whole["c"]) - F.col("own_c")).alias("characters"))
    return rows.withColumn("outcome", F.when(F.col("judgments") == 0, "none").when(F.col("judgments") > most, "many").when(F.col("characters") > chars, "long").otherwise("ready"))


def latest(history: DataFrame) -> DataFrame:
    """The newest row (by id) of each memory_key of an append-only history."""
    newest = history.groupBy("memory_key").agg(F.max_by(F.struct(*history.columns), "id").alias("r"))
    return newest.select("r.*")


def judged_updates(updates: DataFrame, records: DataFrame) -> DataFrame:
    """`updates` (key, revision, reviewed, included, stance, note; one a key) against records (key, kind, revision, reviewed, included, stance, note) with outcome.

    Outcomes, in the order they are found: stance, note (over 4,000 characters), missing, stale, entity (which takes no stance), same, changed.
    """
    fields = ("reviewed", "included", "stance", "note")
    now = records.select("key", "kind", F.col("revision").alias("is_now"), *(F.col(c).alias(f"old_{c}") for c in fields), F.lit(True).alias("here"))
    rows = updates.join(now, "key", "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in fields))
    outcome = F.when(F.col("stance").isNull() | ~F.col("stance").isin(*STANCES), "stance").when(F.col("note").isNull() | (F.char_length("note") > 4000), "note").when(F.col("here").isNull(), "missing").when(~F.col("revision").eqNullSafe(F.col("is_now")), "stale")
    return rows.withColumn("outcome", outcome.when((F.col("kind") == "entity") & (F.col("stance") != "unset"), "entity").when(same, "same").otherwise("changed"))


def updated_records(records: DataFrame, judged: DataFrame) -> DataFrame:
    """The records after the updates that change one; its revision grows by one."""
    fields = ("reviewed", "included", "stance", "note")
    done = judged.filter("outcome = 'changed'").select("key", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(1).alias("step"))
    rows = records.join(done, "key", "left")
    return rows.withColumns({"revision": F.col("revision") + F.coalesce("step", F.lit(0)), **{c: F.when(F.col("step").isNull(), F.col(c)).otherwise(F.col(f"new_{c}")) for c in fields}}).select(records.columns)


def _json_list(*parts: Column) -> Column:
    """A JSON array of texts and numbers, a space after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def _json_text(text: Column) -> Column:
    """A text in JSON; null counts as empty."""
    inside = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def targets(entities: DataFrame, triples: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """(key, kind, target_id, title, sources, evidence) of all that can be judged: entities, claims and triples (id, subject_id, predicate, object_id, source, evidence).

    A key follows from what a target says (of a triple also source and quote), so that approval never moves on to other
    evidence. evidence: (source, quote), of an entity each pair of its triples once, in the order of their first triple.
    Names of `hubs` (id) are broadcast.
    """
    kind = F.when(F.col("type") == "Claim", "claim").otherwise("entity")
    pairs = triples.filter("evidence <> ''").select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity"), "id", "source", "evidence")
    firsts = pairs.groupBy("entity", "source", "evidence").agg(F.min("id").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "source", "evidence"))), lambda x: F.struct(x["source"].alias("source"), x["evidence"].alias("quote")))
    quoted = firsts.groupBy(F.col("entity").alias("id")).agg(listed.alias("evidence"))
    none = F.expr("CAST(array() AS array<struct<source:string,quote:string>>)")
    key = lambda *parts: F.sha2(_json_list(*parts).cast("binary"), 256).alias("key")
    text = lambda c: F.col(c).cast("string")
    own = entities.join(quoted, "id", "left").withColumn("kind", kind)
    own = own.select(key(_json_text(F.col("kind")), text("id"), _json_text(F.col("name")), _json_text(F.col("type"))), "kind", F.col("id").alias("target_id"), F.col("name").alias("title"), "sources", F.coalesce("evidence", none).alias("evidence"))
    named = with_names(triples, entities, hubs)
    title = F.concat_ws(" \u2192 ", "subject", "predicate", "object")
    said = F.array(F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("evidence", F.lit("")).alias("quote")))
    sources = F.filter(F.array("source"), lambda s: s != "")
    lines = named.select(key(F.lit('"triple"'), text("subject_id"), *(_json_text(F.col(c)) for c in ("subject", "predicate")), text("object_id"), *(_json_text(F.col(c)) for c in ("object", "source", "evidence"))), F.lit("triple").alias("kind"), F.col("id").alias("target_id"), title.alias("title"), sources.alias("sources"), said.alias("evidence"))
    return own.unionByName(lines)


def assertions_of(targets: DataFrame, source: str) -> DataFrame:
    """Claims and triples of a source, with the evidence that is from it alone."""
    of = targets.filter(F.col("kind").isin(*STANCED) & F.array_contains("sources", source))
    return of.withColumns({"sources": F.array(F.lit(source)), "evidence": F.filter("evidence", lambda e: e["source"] == source)})
