"""Queries of notes, payloads, actions, judgments and fitted clips, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import clips, documents, graph, judgments, rules
from kgloom.plans import testgraph as G
from kgloom.plans.curation import DEFAULT_RULES, _FACTS, _facts
from kgloom.plans.queries import SEGMENTS, _segments, query
from kgloom.sinks import projections
from kgloom.sources import captions, routing


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(spark, sf_dir):
    return G.named(spark, sf_dir)


@query(", n AS (SELECT DISTINCT s.name AS s, predicate, o.name AS o FROM triples JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id) SELECT 'node' AS kind, name AS source, NULL AS predicate, NULL AS target, type FROM entities UNION ALL SELECT 'edge', s, predicate, o, NULL FROM n")
def graph_payload(spark, sf_dir):
    return projections.graph_payload(G.entities(spark, sf_dir), _named(spark, sf_dir))


@query(r""", l AS (SELECT source, string_agg('- [[' || s.name || ']] **' || predicate || '** [[' || o.name || ']]', chr(10) ORDER BY t.id, s.name, o.name) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM triples WHERE source LIKE 'order:%') t JOIN (SELECT id, regexp_replace(name, '#', '', 'g') AS name FROM entities) s ON s.id = subject_id JOIN (SELECT id, regexp_replace(name, '#', '', 'g') AS name FROM entities) o ON o.id = object_id GROUP BY source),
c AS (SELECT *, 'order:' || o_orderkey AS id, o_orderkey % 4 AS m FROM orders)
SELECT id, CAST(1 AS BIGINT) AS part, concat('---', chr(10), 'title: "', CASE m WHEN 0 THEN '' ELSE 'T' || o_orderkey END, '"', chr(10), 'source: tpch', chr(10), 'kind: order', chr(10), 'url: ', chr(10), 'content_id: ', id, chr(10), 'topics: ["[[a]]", "[[', o_orderpriority, ']]"]', chr(10), 'tags: [inbox]', chr(10), '---', chr(10), chr(10), '# ', CASE m WHEN 0 THEN id ELSE 'T' || o_orderkey END, chr(10), chr(10), '## Summary', chr(10), 's', o_custkey, chr(10), chr(10), '## Key points', CASE m WHEN 1 THEN '' ELSE chr(10) || '- one' || chr(10) || '- two' END,
    CASE m WHEN 2 THEN '' WHEN 3 THEN chr(10) || chr(10) || '## Relevance' || chr(10) || '- y: 0.75' || chr(10) || '- x: 0.50' ELSE chr(10) || chr(10) || '## Relevance' || chr(10) || '- x: 0.50' || chr(10) || '- y: 0.25' END, CASE WHEN lines IS NULL THEN '' ELSE chr(10) || chr(10) || '## Extracted knowledge' || chr(10) || lines END, chr(10)) AS note FROM c LEFT JOIN l ON l.source = c.id""")
def content_notes(spark, sf_dir):
    m, k = F.col("o_orderkey") % 4, F.col("o_orderkey")
    maps = lambda y: F.create_map(F.lit("y"), F.lit(y), F.lit("x"), F.lit(0.5))
    relevance = F.when(m == 2, F.expr("CAST(map() AS map<string,double>)")).when(m == 3, maps(0.75)).otherwise(maps(0.25))
    points = F.when(m == 1, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.lit("one"), F.lit("two")))
    contents = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), k).alias("id"), F.when(m == 0, "").otherwise(F.concat(F.lit("T"), k)).alias("title"), F.lit("tpch").alias("source"), F.lit("order").alias("kind"), F.lit("").alias("url"), F.concat(F.lit("s"), "o_custkey").alias("summary"), F.array(F.lit("a"), "o_orderpriority").alias("topics"), points.alias("key_points"), relevance.alias("relevance"))
    return projections.content_notes(contents, _named(spark, sf_dir))


@query(_FACTS + """, w AS (SELECT DISTINCT name FROM ef WHERE type = 'DefinedTerm' AND degree >= 5), q AS (SELECT '- `queue_report` topic=' || name || ' (rule: wiki-into-report)' AS line FROM w UNION SELECT '- `queue_report` content_id=' || id || ', topic=' || top_topic || ' (rule: interest-report)' FROM cf WHERE relevance >= 0.7)
SELECT 'Wiki/' || name AS path, '# ' || name || ' by hot-topic-wiki' AS line FROM w UNION ALL SELECT DISTINCT 'MOC/' || replace(name, '#', '') || ' MOC', '- [[' || replace(name, '#', '') || ']]' FROM ef WHERE type = 'Organization' AND degree >= 8 UNION ALL SELECT 'Reports/_queue', line FROM q WHERE line <> '- `queue_report` topic=NATION_1 (rule: wiki-into-report)'""")
def action_pages(spark, sf_dir):
    """Pages and queue lines of the default rules' actions; one line is queued already."""
    queued = spark.createDataFrame([("- `queue_report` topic=NATION_1 (rule: wiki-into-report)",)], "line string")
    return projections.action_pages(rules.fire(_facts(spark, sf_dir), DEFAULT_RULES), queued)


_MEMORY = """WITH r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'entity' ELSE 'triple' END AS kind, CAST(o_custkey % 4 AS INT) AS revision, o_orderkey % 2 = 0 AS reviewed, true AS included, 'unset' AS stance, 'n' AS note FROM orders),
u AS (SELECT CASE o_orderkey % 10 WHEN 9 THEN -o_orderkey ELSE o_orderkey END AS key, CAST(CASE o_orderkey % 10 WHEN 1 THEN 9 ELSE o_custkey % 4 END AS INT) AS revision, o_orderkey % 2 = 0 AS reviewed, true AS included, CASE WHEN o_orderkey % 10 = 2 THEN 'odd' WHEN o_orderkey % 10 < 6 THEN 'agree' ELSE 'unset' END AS stance, CASE o_orderkey % 10 WHEN 7 THEN repeat('x', 4001) WHEN 8 THEN 'm' ELSE 'n' END AS note FROM orders),
j AS (SELECT u.*, CASE WHEN u.stance = 'odd' THEN 'stance' WHEN length(u.note) > 4000 THEN 'note' WHEN r.key IS NULL THEN 'missing' WHEN r.revision <> u.revision THEN 'stale' WHEN kind = 'entity' AND u.stance <> 'unset' THEN 'entity' WHEN u.stance = r.stance AND u.note = r.note AND u.reviewed = r.reviewed THEN 'same' ELSE 'changed' END AS outcome FROM u LEFT JOIN r USING (key))"""


def _memory(spark, sf_dir):
    orders, k, c = _table(spark, sf_dir, "orders"), F.col("o_orderkey"), (F.col("o_custkey") % 4).cast("int")
    records = orders.select(k.alias("key"), F.when(k % 3 == 0, "entity").otherwise("triple").alias("kind"), c.alias("revision"), (k % 2 == 0).alias("reviewed"), F.lit(True).alias("included"), F.lit("unset").alias("stance"), F.lit("n").alias("note"))
    d = k % 10
    updates = orders.select(F.when(d == 9, -k).otherwise(k).alias("key"), F.when(d == 1, 9).otherwise(c).alias("revision"), (k % 2 == 0).alias("reviewed"), F.lit(True).alias("included"), F.when(d == 2, "odd").when(d < 6, "agree").otherwise("unset").alias("stance"), F.when(d == 7, F.repeat(F.lit("x"), F.lit(4001))).when(d == 8, "m").otherwise("n").alias("note"))
    return records, judgments.judged_updates(updates, records)


@query(_MEMORY + " SELECT key, outcome FROM j")
def memory_judged(spark, sf_dir):
    return _memory(spark, sf_dir)[1].select("key", "outcome")


@query(_MEMORY + " SELECT r.key, kind, r.revision + CASE WHEN outcome = 'changed' THEN 1 ELSE 0 END AS revision, r.reviewed, r.included, CASE WHEN outcome = 'changed' THEN j.stance ELSE r.stance END AS stance, CASE WHEN outcome = 'changed' THEN j.note ELSE r.note END AS note FROM r LEFT JOIN j USING (key)")
def memory_updated(spark, sf_dir):
    return judgments.updated_records(*_memory(spark, sf_dir))


@query(", k AS (SELECT *, CASE WHEN predicate = 'relatedTo' THEN 'mentions' ELSE predicate END AS p FROM triples) SELECT k.id, p AS predicate, source FROM k JOIN entities s ON s.id = subject_id WHERE NOT (p IN ('mentions', 'about') AND s.type = 'DefinedTerm')")
def source_triples(spark, sf_dir):
    """Terms stand for creative works, and being related for a mention."""
    named = _named(spark, sf_dir).withColumn("predicate", F.when(F.col("predicate") == "relatedTo", "mentions").otherwise(F.col("predicate")))
    return documents.source_triples(named, ["DefinedTerm"], knowledge_only=True).select("id", "predicate", "source")


@query(f"""WITH {SEGMENTS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY "start", "end", text) AS k FROM seg) SELECT doc, CAST(0 AS INT) AS idx, min("start") AS "start", max("end") AS "end" FROM c GROUP BY doc HAVING count(*) = 1""")
def clip_fitted_single(spark, sf_dir):
    """Timelines of one cue: the clip grows over the whole day and comes back to the cue."""
    cues = _segments(spark, sf_dir)
    lone = cues.groupBy("doc").agg(F.count("*").alias("n")).filter("n = 1").select("doc")
    own = cues.join(lone, "doc", "left_semi")
    return clips.fitted(own.withColumn("rank", F.lit(1)), own, lone.select("doc", F.lit(86400.0).alias("target"), F.lit(100000.0).alias("duration"))).select("doc", "idx", "start", "end")


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.163.com/a/' || page_id WHEN 1 THEN 'https://youtu.be/' || lpad(CAST(page_id AS VARCHAR), 11, 'a') WHEN 2 THEN 'https://www.youtube.com/watch?x=1&v=short' ELSE url END AS url, ['﻿ #EXTM3U x', ' {"events":[]}', 'WEBVTT', 'hello world'][CAST(page_id % 5 AS INT) % 4 + 1] AS payload FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '163:' || left(sha1(url), 12) WHEN 1 THEN 'yt:' || right(url, 11) END AS item, CASE WHEN contains(payload, '#EXTM3U') THEN 'hls' WHEN contains(payload, '{') THEN 'json3' WHEN payload = 'WEBVTT' THEN 'vtt' END AS format FROM p""")
def link_routing(spark, sf_dir):
    """Links of both sources, one without an id, and those of the pages, which belong to neither."""
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.concat(F.lit("https://www.163.com/a/"), i)).when(i % 4 == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(i.cast("string"), 11, "a"))).when(i % 4 == 2, "https://www.youtube.com/watch?x=1&v=short").otherwise(F.col("url"))
    payload = F.element_at(F.array(*map(F.lit, ("﻿ #EXTM3U x", ' {"events":[]}', "WEBVTT", "hello world"))), (i % 5 % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", routing.item_id(url).alias("item"), routing.caption_format(payload).alias("format"))


@query("""WITH t AS (SELECT o_custkey AS doc, ['official', 'automatic', 'other'][o_orderkey % 3 + 1] AS kind, ['en', 'zh', 'de', 'zh-Hans'][o_orderkey % 4 + 1] AS lang, 'u' || o_orderkey AS url FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY kind = 'automatic', CASE lang WHEN 'zh-Hans' THEN 0 WHEN 'zh' THEN 1 ELSE 2 END, url) AS k FROM t WHERE kind <> 'other' AND lang <> 'de') SELECT doc, kind, lang, url FROM r WHERE k = 1""")
def caption_tracks(spark, sf_dir):
    k, words = F.col("o_orderkey"), lambda *w: F.array(*map(F.lit, w))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.element_at(words("official", "automatic", "other"), (k % 3 + 1).cast("int")).alias("kind"), F.element_at(words("en", "zh", "de", "zh-Hans"), (k % 4 + 1).cast("int")).alias("lang"), F.concat(F.lit("u"), k).alias("url"))
    return routing.preferred_tracks(rows)


_LINKS = ["https://youtu.be/{}", "http://www.youtube.com/watch?x=1&v={}&t=2)", "https://m.youtube.com/shorts/{}/x", "https://youtube.com.example.org/watch?v={}", "https://youtube.com/watch?v={}x", "https://example.org/youtu.be/{}", "https://youtube.com/user?v={}", "https://youtube.com/embed/{}?start=1。"]


@query("""WITH p AS (SELECT page_id, page_id % 8 AS k, lpad(CAST(page_id AS VARCHAR), 11, 'a') AS v FROM pages) SELECT page_id, CASE WHEN k IN (0, 1, 2, 7) THEN v WHEN page_id % 3 = 0 THEN reverse(v) END AS video FROM p""")
def video_links(spark, sf_dir):
    """The video of a text with a link, some only like one, and in a third of the texts another link after it."""
    i, v = F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 11, "a")
    link = F.replace(F.element_at(F.array(*map(F.lit, _LINKS)), (i % 8 + 1).cast("int")), F.lit("{}"), v)
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(" see "), link, F.when(i % 3 == 0, F.concat(F.lit(" or https://www.youtu.be/"), F.reverse(v))).otherwise(""))
    return _table(spark, sf_dir, "pages").select("page_id", routing.video_in(text).alias("video"))


@query(rf"""WITH d AS (SELECT doc_id, 'WEBVTT' || chr(10) || 'NOTE x' || chr(10) || '12' || chr(10) || text || chr(10) || ' <c>Hello</c> a &lt; b' || chr(13) || chr(10) || 'REGION y' || chr(10) || '00:01.0 --> 00:02.0' || chr(10) || text AS t FROM documents),
l AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(t, '{T.LINE_END}'), lambda x: regexp_replace(x, '^{T.BLANK}+|{T.BLANK}+$', '', 'g'))) AS s, generate_subscripts(regexp_split_to_array(t, '{T.LINE_END}'), 1) AS i FROM d),
k AS (SELECT doc_id, i, replace(regexp_replace(s, '<[^>]+>', '', 'g'), '&lt;', '<') AS s FROM l WHERE s <> '' AND NOT regexp_matches(s, '^(WEBVTT|Kind:|Language:|NOTE|X-TIMESTAMP-MAP|STYLE|REGION)|-->|^\d+$')),
f AS (SELECT doc_id, s, min(i) AS i FROM k WHERE s <> '' GROUP BY ALL)
SELECT doc_id, sha256(coalesce(string_agg(s, chr(10) ORDER BY i), '')) AS speech FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def vtt_speech(spark, sf_dir):
    """The speech of texts as captions, each of them twice, between headers and tags."""
    text = F.concat(F.lit("WEBVTT\nNOTE x\n12\n"), "text", F.lit("\n <c>Hello</c> a &lt; b\r\nREGION y\n00:01.0 --> 00:02.0\n"), "text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(captions.vtt_text(text), F.lit("")).cast("binary"), 256).alias("speech"))
