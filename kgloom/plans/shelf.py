"""Queries of lists, histories, document states, requests and cuts, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import requests
from kgloom.functions.language import stamp
from kgloom.operators import shelf
from kgloom.plans import testgraph as G
from kgloom.plans.notes import _MEMORY, _memory
from kgloom.plans.queries import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _picked(words, n):
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


_RECORDS = """WITH rc AS (SELECT 'k' || o_orderkey AS key, o_orderkey AS place, o_orderpriority || ' ' || o_orderkey AS title, CASE WHEN o_custkey % 5 = 0 THEN 'High time' WHEN o_custkey % 5 = 1 THEN NULL ELSE 'n' END AS note, ['entity', 'claim', 'triple'][CAST(o_orderkey % 3 AS INT) + 1] AS kind, o_custkey % 2 = 0 AS reviewed, o_custkey % 3 = 0 AS included FROM orders)"""


def _records(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    note = F.when(c % 5 == 0, "High time").when(c % 5 != 1, "n")
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), k).alias("key"), k.alias("place"), F.concat("o_orderpriority", F.lit(" "), k).alias("title"), note.alias("note"), _picked(("entity", "claim", "triple"), k).alias("kind"), (c % 2 == 0).alias("reviewed"), (c % 3 == 0).alias("included"))


@query(_RECORDS + " SELECT key, title, kind FROM rc WHERE contains(lower(title || ' ' || coalesce(note, '')), 'high') AND kind = 'triple' AND NOT reviewed ORDER BY place LIMIT 250")
def memory_list(spark, sf_dir):
    """The first relations of those not reviewed that speak of what is asked for."""
    return shelf.listed_records(_records(spark, sf_dir), " HIGH ", "triple", "unreviewed").select("key", "title", "kind")


@query(_RECORDS + " SELECT kind, reviewed, included, count(*) AS n FROM rc WHERE included AND contains(lower(title || ' ' || coalesce(note, '')), 'h') GROUP BY ALL")
def memory_matching(spark, sf_dir):
    """How many included records match, all of them."""
    return shelf.matching_records(_records(spark, sf_dir), "h", scope="included").groupBy("kind", "reviewed", "included").agg(F.count("*").alias("n"))


_CHANGED = _MEMORY + """, s AS (SELECT *, CASE WHEN abs(key) % 7 = 0 THEN 'lost' WHEN abs(key) % 7 = 1 THEN '' ELSE 'order:' || abs(key) END AS source_id FROM j),
h AS (SELECT s.key, CASE WHEN outcome NOT IN ('stance', 'note') AND source_id = 'lost' THEN 'source' ELSE outcome END AS outcome, source_id, s.stance AS stance_after, r.stance AS stance_before, s.note AS note_after, r.note AS note_before, r.revision FROM s LEFT JOIN r USING (key))"""


def _sourced(spark, sf_dir):
    judged, k = _memory(spark, sf_dir)[1], F.abs("key")
    contents = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"))
    return shelf.known_sources(judged.withColumn("source_id", F.when(k % 7 == 0, "lost").when(k % 7 == 1, "").otherwise(F.concat(F.lit("order:"), k))), contents)


@query(_CHANGED + " SELECT key, outcome FROM h")
def memory_sources(spark, sf_dir):
    """Updates that name a document, which must be there."""
    return _sourced(spark, sf_dir).select("key", "outcome")


@query(_CHANGED + " SELECT key, source_id, stance_before || ' ' || note_before || ' ' || revision AS before, stance_after || ' ' || note_after || ' ' || (revision + 1) AS after, '2024-01-01' AS at FROM h WHERE outcome = 'changed'")
def memory_history(spark, sf_dir):
    """A row of history for each update that changes a record."""
    rows = shelf.memory_history(_sourced(spark, sf_dir), F.lit("2024-01-01"))
    said = lambda c: F.concat_ws(" ", f"{c}.stance", f"{c}.note", F.col(f"{c}.revision").cast("string"))
    return rows.select(F.col("memory_key").alias("key"), "source_id", said("before_state").alias("before"), said("after_state").alias("after"), F.col("created_at").alias("at"))


@query(_RECORDS + ", h AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'k' || (l_orderkey + l_linenumber % 2) AS memory_key FROM lineitem) SELECT id, memory_key, title FROM h JOIN (SELECT key AS memory_key, title, kind FROM rc) USING (memory_key) WHERE contains(lower(title), 'urgent') AND kind = 'claim'")
def memory_history_list(spark, sf_dir):
    """Changes of claims that speak of what is asked for; some are of records that are gone."""
    key = F.col("l_orderkey") + F.col("l_linenumber") % 2
    history = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("k"), key).alias("memory_key"))
    return shelf.matching_history(history, _records(spark, sf_dir), "Urgent", "claim").select("id", "memory_key", "title")


@query(""", en AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'claim' ELSE 'entity' END AS kind FROM entities), sh AS (SELECT kind, id FROM en UNION ALL SELECT 'triple', id FROM triples),
rc AS (SELECT CASE WHEN id % 4 = 1 THEN 'entity' ELSE kind END AS kind, id % 3 <> 0 AS current, CASE WHEN id % 7 = 0 THEN id + 1 ELSE id END AS target, kind || id AS key, id % 2 = 0 AS reviewed, id % 11 <> 0 AS included FROM sh),
b AS (SELECT kind, target AS id, arg_min({'key': key, 'reviewed': reviewed, 'included': included}, key) AS r FROM rc WHERE current GROUP BY kind, target)
SELECT sh.kind, sh.id, r.key AS key, coalesce(r.reviewed, false) AS reviewed, coalesce(r.included, false) AS included FROM sh LEFT JOIN b ON b.kind = sh.kind AND b.id = sh.id""")
def editor_judgments(spark, sf_dir):
    """Entities and relations as the editor lists them, with the judgment on each; a seventh of the records followed a merge."""
    i = F.col("id")
    entities = G.entities(spark, sf_dir).select(shelf.target_kind(F.when(i % 5 == 0, "Claim").otherwise(F.col("type")), "entities").alias("kind"), "id")
    shown = entities.unionByName(G.triples(spark, sf_dir).select(shelf.target_kind(F.lit(""), "triples").alias("kind"), "id"))
    records = shown.select(F.when(i % 4 == 1, "entity").otherwise(F.col("kind")).alias("kind"), (i % 3 != 0).alias("current"), i.alias("target_id"), F.when(i % 7 == 0, i + 1).alias("current_target_id"), F.concat("kind", i).alias("key"), (i % 2 == 0).alias("reviewed"), (i % 11 != 0).alias("included"))
    return shelf.with_judgment(shown, records)


@query("SELECT 'order:' || o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 4 = 2")
def documents_processed(spark, sf_dir):
    """Documents whose analysis is done; the partitions of others are not read."""
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), _picked(("new", "failed", "processed", "error"), F.col("o_orderkey")).alias("status"))
    return shelf.processed(shelf.by_status(rows)).select("id", "price")


_QUOTED = lambda c: rf"""'"' || replace(replace(replace(replace(replace({c}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"'"""


@query(f"""WITH d AS (SELECT *, '"u"\\' || doc_id AS url, CASE WHEN doc_id % 3 > 0 THEN text END AS summary FROM documents)
SELECT doc_id, sha256('[3, "' || CASE WHEN doc_id % 2 = 0 THEN 'audio' ELSE 'video' END || '", "doc:' || doc_id || '", ' || {_QUOTED("url")} || ', ' || coalesce({_QUOTED("summary")}, 'null') || ', ' || CASE doc_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '[]' ELSE '["' || lang || '", ' || {_QUOTED("text")} || ']' END || ', ' || coalesce('"' || CASE WHEN doc_id % 5 > 0 THEN sha256(text) END || '"', 'null') || ']') AS key FROM d""")
def media_cache_keys(spark, sf_dir):
    """Keys of what is made of documents, some without a summary, key points or a hash."""
    i = F.col("doc_id")
    points = F.when(i % 4 == 1, F.expr("CAST(array() AS array<string>)")).when(i % 4 > 1, F.array("lang", "text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc:"), i).alias("id"), F.concat(F.lit('"u"\\'), i).alias("url"), F.when(i % 3 > 0, F.col("text")).alias("summary"), points.alias("key_points"), F.when(i % 5 > 0, F.sha2("text", 256)).alias("source_sha256"))
    return rows.select("doc_id", requests.cache_key(3, F.when(i % 2 == 0, "audio").otherwise("video")).alias("key"))


@query(r"""WITH q AS (SELECT o_orderkey AS id, ['terms', ' Phrase ', 'odd', NULL, ''][CAST(o_orderkey % 5 AS INT) + 1] AS mode, ['1', 'NO', 'on ', NULL, '2', 'False'][CAST(o_custkey % 6 AS INT) + 1] AS expand, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS top, CASE o_orderkey % 7 WHEN 0 THEN '1_0' WHEN 1 THEN ' +7 ' WHEN 2 THEN '-3' WHEN 3 THEN '2.0' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS "limit" FROM orders),
m AS (SELECT id, CASE WHEN mode IS NULL THEN 'terms' WHEN lower(trim(mode)) IN ('terms', 'phrase') THEN lower(trim(mode)) END AS mode, CASE WHEN expand IS NULL THEN true WHEN expand IN ('1', 'on ') THEN true WHEN expand IN ('NO', 'False') THEN false END AS expand, CASE WHEN top IS NULL THEN 20 WHEN CAST(top AS BIGINT) BETWEEN 1 AND 200 THEN CAST(top AS INT) END AS top, CASE WHEN "limit" IS NULL THEN 50 WHEN "limit" = '1_0' THEN 10 WHEN "limit" = ' +7 ' THEN 7 WHEN regexp_matches("limit", '^\d+$') AND CAST("limit" AS BIGINT) BETWEEN 1 AND 500 THEN CAST("limit" AS INT) END AS "limit" FROM q)
SELECT *, CASE WHEN mode IS NULL THEN 'mode' WHEN expand IS NULL THEN 'expand' WHEN top IS NULL THEN 'top' WHEN "limit" IS NULL THEN 'limit' END AS fault FROM m""")
def request_options(spark, sf_dir):
    """What requests mean, and the first fault of each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(k % 7 == 0, "1_0").when(k % 7 == 1, " +7 ").when(k % 7 == 2, "-3").when(k % 7 == 3, "2.0").when(k % 7 == 4, "").when(k % 7 == 6, k.cast("string"))
    rows = _table(spark, sf_dir, "orders").select(k.alias("id"), _picked(("terms", " Phrase ", "odd", None, ""), k).alias("mode"), _picked(("1", "NO", "on ", None, "2", "False"), c).alias("expand"), F.when(c % 4 != 0, c.cast("string")).alias("top"), said.alias("limit"))
    return requests.judged_requests(rows)


_STATES = """WITH d AS (SELECT doc_id, 'doc:' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE left(text, 40) END AS summary, source, lang FROM documents),
n AS (SELECT id, coalesce(summary, '') || chr(10) || CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS note FROM d WHERE doc_id % 3 > 0), t AS (SELECT 'doc:' || (o_custkey % 400) AS id, count(*) AS n FROM orders GROUP BY ALL)"""


@query(_STATES + """ SELECT d.id, coalesce(length(text) > 0, false) AND doc_id % 4 < 2 AS analysis_current, CAST(coalesce(length(text), 0) AS INT) AS source_characters, CASE WHEN doc_id % 4 < 3 THEN CAST(least(coalesce(length(text), 0) + CASE WHEN doc_id % 4 = 2 THEN 200000 ELSE 0 END, 150000) AS INT) END AS analyzed_characters, coalesce(summary <> '' AND contains(note, summary), false) AS note_matches_summary, sha256(left(coalesce(note, ''), 60000)) AS note, sha256(left(coalesce(text, ''), 150000)) AS transcript, coalesce(length(text) > 150000, false) AS transcript_truncated, coalesce(t.n, 0) AS source_relations, CASE WHEN lang = 'en' THEN 'fetch' WHEN coalesce(text, '') <> '' THEN 'text' END AS reanalyze, CASE WHEN NOT (coalesce(length(text) > 0, false) AND doc_id % 4 < 2) THEN 'stale' WHEN doc_id % 8 < 4 THEN 'snapshot' ELSE 'ready' END AS sync FROM d LEFT JOIN n USING (id) LEFT JOIN t USING (id)""")
def document_states(spark, sf_dir):
    """Where documents stand: a seventh lost their text, half were analysed in another form or not at all."""
    i, docs = F.col("doc_id"), _table(spark, sf_dir, "documents")
    text = F.when(i % 7 != 0, F.col("text"))
    summary = F.when(i % 5 == 1, "").when(i % 5 > 1, F.substring("text", 1, 40))
    now = stamp(text, 2)
    stamped = F.when(i % 4 < 2, now).when(i % 4 == 2, F.struct(now["sha256"].alias("sha256"), (now["chars"] + 200000).alias("chars"), now["version"].alias("version")))
    rows = docs.select("doc_id", F.concat(F.lit("doc:"), i).alias("id"), text.alias("text"), summary.alias("summary"), F.col("lang").alias("title"), F.when(F.col("lang") == "en", "youtube").otherwise("article").alias("source"), stamped.alias("stamped"), F.when(i % 8 > 3, "s").alias("snapshot"))
    notes = rows.filter(i % 3 > 0).select("id", F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.when(i % 2 == 0, F.col("text")).otherwise("")).alias("note"))
    triples = _table(spark, sf_dir, "orders").select(F.concat(F.lit("doc:"), F.col("o_custkey") % 400).alias("source"))
    digest = lambda c, name: F.sha2(F.col(c).cast("binary"), 256).alias(name)
    found = shelf.document_status(rows.drop("text", "doc_id"), rows, notes, triples, 2)
    return found.select("id", "analysis_current", "source_characters", "analyzed_characters", "note_matches_summary", digest("note_text", "note"), digest("source_transcript", "transcript"), "transcript_truncated", "source_relations", "reanalyze", "sync")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, lpad(CAST(page_id AS VARCHAR), 11, 'a') AS v FROM pages) SELECT page_id, CASE WHEN k = 0 AND page_id % 5 > 0 THEN 'yt:' || v WHEN k = 1 THEN 'yt:' || v WHEN k = 2 THEN 'yt:none' END AS id, CASE WHEN k IN (3, 5) THEN 'invalid' WHEN k = 4 OR (k = 0 AND page_id % 5 = 0) THEN 'missing' END AS fault FROM p""")
def document_targets(spark, sf_dir):
    """What is asked for by link, by id, by leaving it blank, in vain and in too many words; a fifth of the links lead to no document."""
    i, v = F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 11, "a")
    link, own = F.concat(F.lit(" watch https://youtu.be/"), v, F.lit("。")), F.concat(F.lit("yt:"), v)
    asked = F.when(i % 6 == 0, link).when(i % 6 == 1, F.concat(F.lit("\t"), own)).when(i % 6 == 2, "　 ").when(i % 6 == 3, F.repeat(F.lit("x"), F.lit(2001))).when(i % 6 == 4, "y")
    pages = _table(spark, sf_dir, "pages")
    contents = pages.filter((i % 5 > 0) | (i % 6 == 1)).select(own.alias("id")).union(pages.limit(1).select(F.lit("yt:none")))
    return shelf.resolved_targets(pages.select("page_id", asked.alias("target")), contents, "yt:none").select("page_id", "id", "fault")


@query("SELECT 'order:' || o_orderkey AS id, o_orderpriority AS title, 'order' AS kind, 'u' || o_custkey AS url, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def newest_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(k.alias("place"), F.concat(F.lit("order:"), k).alias("id"), F.col("o_orderpriority").alias("title"), F.lit("order").alias("kind"), F.concat(F.lit("u"), "o_custkey").alias("url"), F.col("o_orderstatus").alias("status"))
    return shelf.newest_documents(rows)


_SLIDES = """WITH RECURSIVE li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), sl AS (SELECT l_orderkey AS doc, i AS idx, CAST(l_partkey AS DOUBLE) AS a, l_partkey + CASE WHEN l_partkey % 61 = 0 THEN 0.0 ELSE l_quantity / 4 END AS b, CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'x, "' || l_suppkey || '"' ELSE 's' || l_suppkey END AS title, CASE WHEN l_partkey % 7 = 0 THEN CAST(l_partkey AS DOUBLE) END AS said FROM li)"""


def _slides(spark, sf_dir):
    from pyspark.sql import Window

    p, s = F.col("l_partkey"), F.col("l_suppkey")
    title = F.when(s % 5 == 0, "").when(s % 5 == 2, F.concat(F.lit('x, "'), s, F.lit('"'))).when(s % 5 > 2, F.concat(F.lit("s"), s))
    length = F.when(p % 61 == 0, 0.0).otherwise(F.col("l_quantity") / 4)
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), idx.cast("long").alias("idx"), p.cast("double").alias("start"), (p + length).alias("end"), title.alias("title"), F.when(p % 7 == 0, p.cast("double")).alias("timeline_start"))


@query(_SLIDES + """ SELECT doc, CASE WHEN bool_and(b > a) THEN 'start,end,title' || chr(13) || chr(10) || string_agg(printf('%.3f,%.3f,', a, b) || CASE WHEN coalesce(title, '') = '' THEN '片段 ' || idx WHEN contains(title, ',') THEN '"' || replace(title, '"', '""') || '"' ELSE title END || chr(13) || chr(10), '' ORDER BY idx) END AS plan, CASE WHEN NOT bool_and(b > a) THEN 'times' END AS fault FROM sl GROUP BY doc""")
def clip_plans(spark, sf_dir):
    """The cuts of each recording as CSV; recordings with a cut of no length have none."""
    return shelf.clip_plan(_slides(spark, sf_dir))


@query(_SLIDES + """, pl AS (SELECT doc, idx, coalesce(said, 0.0) AS off, a, b FROM sl WHERE idx = 1 UNION ALL SELECT sl.doc, sl.idx, coalesce(said, pl.off + pl.b - pl.a), sl.a, sl.b FROM pl JOIN sl ON sl.doc = pl.doc AND sl.idx = pl.idx + 1),
cu AS (SELECT doc, idx, round(off + 0.25, 3) AS "start", round(off + 1.5, 3) AS "end" FROM pl) SELECT doc, idx, "start", "end", 'c' || idx AS text FROM cu""")
def slide_subtitles(spark, sf_dir):
    """Captions of cuts on the joined timeline; some cuts say where they begin."""
    slides = _slides(spark, sf_dir)
    captions = slides.select("doc", "idx", F.lit(0.25).alias("start"), F.lit(1.5).alias("end"), F.concat(F.lit("c"), "idx").alias("text"))
    return shelf.slide_cues(slides, captions).withColumn("idx", F.substring("text", 2, 9).cast("long"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 24 * 3600.0 + 61.25 WHEN 1 THEN CAST(n_chars AS DOUBLE) END AS seconds FROM documents""")
def probed_durations(spark, sf_dir):
    """What a probe's log says of the length, behind a text; some say nothing, or that there is none."""
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, F.concat(F.lit("Duration: "), i % 24, F.lit(":01:01.25, start"))).when(i % 4 == 1, F.concat(F.lit("  Duration:0:0:"), "n_chars", F.lit(" Duration: 9:9:9"))).when(i % 4 == 2, "Duration: 00:00:00.00").otherwise("Duration: N/A")
    return _table(spark, sf_dir, "documents").select("doc_id", shelf.probed_duration(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said)).alias("seconds"))
