"""The graph as strings: JSON-LD nodes, tab-separated edges, Markdown notes and subtitles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import slug, srt_stamp
from kgloom.operators.graph import counted
from kgloom.store import written

#: Lines of a part of a note.
PART_LINES = 1000


def _urn(kind: str, column: str):
    return F.concat(F.lit(f"urn:kgloom:{kind}:"), F.col(column).cast("string"))


def jsonld_nodes(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(id, node): an entity's node, or a triple as a reified statement, in JSON."""
    e = entities.select(_urn("entity", "id").alias("id"), F.to_json(F.struct(_urn("entity", "id").alias("@id"), F.col("type").alias("@type"), "name")).alias("node"))
    s = F.struct(_urn("statement", "id").alias("@id"), F.lit("rdf:Statement").alias("@type"), _urn("entity", "subject_id").alias("subject"), "predicate", _urn("entity", "object_id").alias("object"))
    return e.unionByName(triples.select(_urn("statement", "id").alias("id"), F.to_json(s).alias("node")))


def edge_lines(named: DataFrame) -> DataFrame:
    """(id, line) of named triples, tab-separated."""
    return named.select("id", F.concat_ws("\t", "subject", "predicate", "object").alias("line"))


def _parts(lines: DataFrame, part_lines: int) -> DataFrame:
    """(name, part, lines) of lines (name, id, line), by id, in parts of `part_lines`.

    A name with one part meets once. Lines of the others, which are few names, are dealt by name and id, so that those of a
    hot name lie in many slices; a line's number is its place in its slice and the count of the name's lines in earlier ones.
    """
    lines = written(lines.select("name", "id", "line"))
    large = F.broadcast(written(lines.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > part_lines).select("name")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("lines")
    short = lines.join(large, "name", "left_anti").groupBy("name").agg(listed).select("name", F.lit(1).cast("long").alias("part"), "lines")
    lines = lines.join(large, "name", "left_semi")
    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(lines.repartitionByRange(slices, "name", "id", "line").withColumn("slice", F.spark_partition_id()))
    earlier = F.sum("n").over(Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first name of a slice has lines in earlier ones, so this has a row for each slice at most.
    before = dealt.groupBy("name", "slice").agg(F.count("*").alias("n")).select("name", "slice", earlier.alias("before")).filter("before > 0")
    place = F.row_number().over(Window.partitionBy("name", "slice").orderBy("id", "line")) - 1 + F.coalesce("before", F.lit(0))
    parts = dealt.join(F.broadcast(before), ["name", "slice"], "left").select("name", "id", "line", (F.floor(place / part_lines) + 1).alias("part"))
    return short.unionByName(parts.groupBy("name", "part").agg(listed))


def entity_notes(named: DataFrame, part_lines: int = PART_LINES, only: DataFrame | None = None) -> DataFrame:
    """(name, part, note): a Markdown list of an entity's relations, outgoing and incoming, by triple id, in parts of `part_lines` lines. Parts from the second on have their number in the title. `only` (name): notes of these alone."""
    out = named.select(F.col("subject").alias("name"), "id", F.concat(F.lit("- "), "predicate", F.lit(" [["), "object", F.lit("]]")).alias("line"))
    back = named.select(F.col("object").alias("name"), "id", F.concat(F.lit("- [["), "subject", F.lit("]] "), "predicate").alias("line"))
    title = F.concat(F.lit("# "), "name", F.when(F.col("part") > 1, F.concat(F.lit(" ("), F.col("part").cast("string"), F.lit(")"))).otherwise(""), F.lit("\n\n"))
    lines = out.unionByName(back)
    return _parts(lines if only is None else lines.join(only, "name", "left_semi"), part_lines).select("name", "part", F.concat(title, "lines").alias("note"))


def content_notes(contents: DataFrame, named: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """(id, part, note) of contents (id, title, source, kind, url, summary, topics, key_points, relevance: a map) with what was extracted from each: front matter, summary, key points, relevance from the highest, relations.

    The first part holds all but the relations beyond `part_lines`, which follow in parts of their own.
    """
    line = F.concat(F.lit("- [["), slug(F.col("subject")), F.lit("]] **"), "predicate", F.lit("** [["), slug(F.col("object")), F.lit("]]"))
    known = _parts(named.join(contents.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("name"), "id", line.alias("line")), part_lines)
    links = F.array_join(F.transform("topics", lambda t: F.concat(F.lit('"[['), slug(t), F.lit(']]"'))), ", ")
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit('title: "'), "title", F.lit('"')), *(F.concat(F.lit(f"{label}: "), column) for label, column in (("source", "source"), ("kind", "kind"), ("url", "url"), ("content_id", "id"))), F.concat(F.lit("topics: ["), links, F.lit("]")), F.lit("tags: [inbox]"), F.lit("---"), F.lit(""))
    shown = F.array_sort(F.transform(F.map_entries("relevance"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    relevance = F.when(F.size("relevance") > 0, F.concat(F.lit("\n\n## Relevance\n"), F.array_join(F.transform(shown, lambda e: F.concat(F.lit("- "), e["k"], F.lit(": "), F.format_string("%.2f", -e["v"]))), "\n"))).otherwise("")
    points = F.concat(F.lit("\n\n## Key points"), F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("\n- "), p)), ""))
    head = F.concat(front, F.lit("\n# "), F.coalesce(F.nullif("title", F.lit("")), "id"), F.lit("\n\n## Summary\n"), "summary", points, relevance)
    heads = contents.select(F.col("id").alias("name"), F.lit(1).cast("long").alias("part"), head.alias("head"))
    body = F.when(F.col("lines").isNull(), "").when(F.col("part") == 1, F.concat(F.lit("\n\n## Extracted knowledge\n"), "lines")).otherwise(F.col("lines"))
    return heads.join(known, ["name", "part"], "full_outer").select(F.col("name").alias("id"), "part", F.concat(F.coalesce("head", F.lit("")), body, F.lit("\n")).alias("note"))


def graph_payload(entities: DataFrame, named: DataFrame) -> DataFrame:
    """(kind, source, predicate, target, type): a node an entity, and an edge for each distinct triple of names, whatever its sources."""
    nodes = entities.select(F.lit("node").alias("kind"), F.col("name").alias("source"), F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("target"), "type")
    edges = named.select(F.lit("edge").alias("kind"), F.col("subject").alias("source"), "predicate", F.col("object").alias("target"), F.lit(None).cast("string").alias("type")).distinct()
    return nodes.unionByName(edges)


def action_pages(actions: DataFrame, queued: DataFrame) -> DataFrame:
    """(path, line) that actions (action, rule, entity, ...) add: a page for each wiki or map of content, and a line of the report queue for each other action that is not in `queued` (line) yet."""
    name = F.col("entity")
    said = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(actions.columns) if c not in ("action", "rule")))), ", ")
    page = actions.filter(F.col("action").isin("create_wiki_page", "create_moc") & (name != ""))
    wiki = F.col("action") == "create_wiki_page"
    pages = page.select(F.when(wiki, F.concat(F.lit("Wiki/"), slug(name))).otherwise(F.concat(F.lit("MOC/"), slug(name), F.lit(" MOC"))).alias("path"), F.when(wiki, F.concat(F.lit("# "), name, F.lit(" by "), "rule")).otherwise(F.concat(F.lit("- [["), slug(name), F.lit("]]"))).alias("line"))
    lines = actions.filter(F.col("action").isin("queue_report", "flag_controversy")).select(F.lit("Reports/_queue").alias("path"), F.concat(F.lit("- `"), "action", F.lit("` "), said, F.lit(" (rule: "), "rule", F.lit(")")).alias("line")).distinct()
    return pages.unionByName(lines.join(queued.select("line"), "line", "left_anti").select("path", "line"))


def srt(cues: DataFrame) -> DataFrame:
    """(doc, srt) of cues (doc, start, end, text), numbered from 1."""
    k = F.row_number().over(Window.partitionBy("doc").orderBy("start", "end", "text"))
    block = F.concat_ws("\n", k.cast("string"), F.concat(srt_stamp(F.col("start")), F.lit(" --> "), srt_stamp(F.col("end"))), "text")
    numbered = cues.select("doc", k.alias("k"), block.alias("b"))
    return numbered.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "\n\n").alias("srt"))


# Fixed value: the heading of what a note's generated section begins with.
SECTION = "## Extracted knowledge"


def spliced(note: Column, lines: Column, renamed: list[tuple[str, str]] = ()) -> Column:
    """A note of a source with its generated section written anew from `lines` (null: none), all else as readers left it; links to `renamed` (old, new) names follow."""
    text = reduce(lambda t, pair: F.replace(t, F.lit(f"[[{pair[0]}]]"), F.lit(f"[[{pair[1]}]]")), renamed, note)
    section = F.concat(F.lit(SECTION + "\n"), F.coalesce(lines, F.lit("")), F.lit("\n"))
    start = F.instr(text, F.lit(SECTION))
    end = F.locate("\n## ", F.substring(text, start + len(SECTION), F.length(text)))
    tail = F.when(end > 0, F.substring(text, start + len(SECTION) + end - 1, F.length(text))).otherwise("")
    added = F.when(lines.isNotNull(), F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), section)).otherwise(text)
    return F.when(start > 0, F.concat(F.substring(text, F.lit(1), start - 1), section, tail)).otherwise(added)


def refreshed_notes(notes: DataFrame, named: DataFrame, affected: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Entity notes (name, part, note) after a change: those of `affected` (name) are written again from all relations, the others stay."""
    names = counted(written(affected.select("name").distinct()))
    again = entity_notes(named, part_lines, names)
    return notes.join(names, "name", "left_anti").select("name", "part", "note").unionByName(again.select("name", "part", "note"))
