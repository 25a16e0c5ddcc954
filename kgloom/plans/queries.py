"""Queries of the graph engine over the star-schema projection, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import conversations, graph, segments
from kgloom.plans import testgraph as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES = [("licensing", r"(?i)licen[cs]e"), ("address", r"[a-z0-9]+@[a-z0-9]+"), ("shouting", r"[A-Z]{4,}!!")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {G.SQL.strip()}{sql}" if sql.startswith(",") else sql
        return f

    return add


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events of a user as a timeline."""
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    start = F.unix_micros(ts) / 1e6 - F.unix_micros(day) / 1e6
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(day, "yyyy-MM-dd")).alias("doc"), F.round(start, 3).alias("start"), F.round(start + F.col("value"), 3).alias("end"), F.col("event_type").alias("text"))


SEGMENTS = "seg AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS doc, round(epoch_us(ts) / 1e6 - epoch_us(date_trunc('day', ts)) / 1e6, 3) AS \"start\", round(epoch_us(ts) / 1e6 - epoch_us(date_trunc('day', ts)) / 1e6 + value, 3) AS \"end\", event_type AS text FROM events)"


@query(", ends AS (SELECT subject_id AS e FROM triples UNION ALL SELECT object_id FROM triples WHERE object_id <> subject_id), deg AS (SELECT e AS id, count(*) AS degree FROM ends GROUP BY e) SELECT id, name, type, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM entities LEFT JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 20")
def kg_degree_topn(spark, sf_dir):
    return graph.degree(G.triples(spark, sf_dir), G.entities(spark, sf_dir)).select("id", "name", "type", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query(", edges AS (SELECT DISTINCT subject_id AS s, predicate, object_id AS o FROM triples) SELECT id, count(*) AS degree FROM (SELECT s AS id FROM edges UNION ALL SELECT o FROM edges) GROUP BY id")
def kg_degree_ui(spark, sf_dir):
    return graph.display_degree(G.triples(spark, sf_dir))


@query(" ,near AS (SELECT * FROM triples WHERE subject_id = 1000000001 OR object_id = 1000000001) SELECT near.id, s.name AS subject, predicate, o.name AS object, source FROM near JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id".strip())
def kg_neighbors(spark, sf_dir):
    near = G.triples(spark, sf_dir).filter("subject_id = 1000000001 OR object_id = 1000000001")
    return graph.with_names(near, G.entities(spark, sf_dir)).select("id", "subject", "predicate", "object", "source")


@query(", m AS (SELECT id FROM entities WHERE norm_name LIKE '%000000007%' ORDER BY norm_name, id LIMIT 50), near AS (SELECT * FROM triples WHERE subject_id IN (SELECT id FROM m) OR object_id IN (SELECT id FROM m) ORDER BY id LIMIT 50) SELECT near.id, s.name || ' ' || predicate || ' ' || o.name AS relation, source FROM near JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id")
def kg_related_graph(spark, sf_dir):
    entities = G.entities(spark, sf_dir)
    none = spark.createDataFrame([], "norm_alias string, entity_id bigint")
    found = graph.search(entities, none, ["000000007"], 50).select("id")
    near = graph.incident_edges(G.triples(spark, sf_dir), found).orderBy("id").limit(50)
    return graph.with_names(near, entities).select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("relation"), "source")


def alias_of(name: str) -> Column:
    """The part of a name after its last # or space, with leading zeros gone, so that entities share aliases."""
    return F.regexp_replace(F.regexp_extract(name, r"([^# ]+)$", 1), "^0+", "")


def _aliases(entities: DataFrame) -> DataFrame:
    """(norm_alias, entity_id): `alias_of` each name that has one."""
    return entities.select(alias_of("norm_name").alias("norm_alias"), F.col("id").alias("entity_id")).filter("norm_alias <> ''")


ALIASES = ", aliases AS (SELECT * FROM (SELECT regexp_replace(regexp_extract(norm_name, '([^# ]+)$', 1), '^0+', '') AS norm_alias, id AS entity_id FROM entities) WHERE norm_alias <> '')"


@query(ALIASES + ", terms AS (SELECT unnest(['nation_1', '77']) AS t), legs AS (SELECT id, norm_name, 'name' AS reason FROM terms, LATERAL (SELECT id, norm_name FROM entities WHERE norm_name LIKE '%' || t || '%' ORDER BY norm_name, id LIMIT 30) UNION ALL SELECT id, norm_name, 'alias' FROM terms, LATERAL (SELECT id, norm_name FROM aliases JOIN entities ON id = entity_id WHERE norm_alias LIKE '%' || t || '%' ORDER BY norm_name, id LIMIT 30)) SELECT id, norm_name, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM legs GROUP BY ALL ORDER BY norm_name, id LIMIT 30")
def kg_search_terms(spark, sf_dir):
    entities = G.entities(spark, sf_dir)
    return graph.search(entities, _aliases(entities), ["nation_1", "77"], 30)


@query(ALIASES + ", c AS (SELECT norm_name AS norm, id AS e, 0 AS r FROM entities UNION ALL SELECT norm_alias, entity_id, 2 FROM aliases), b AS (SELECT norm, min(r) AS r FROM c GROUP BY norm), o AS (SELECT norm, count(DISTINCT e) AS n, min(e) AS e FROM c JOIN b USING (norm, r) GROUP BY norm), q AS (SELECT DISTINCT norm_alias AS norm FROM aliases UNION SELECT norm_name FROM entities UNION SELECT 'nobody') SELECT norm, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM q LEFT JOIN o USING (norm)")
def kg_resolve(spark, sf_dir):
    entities = G.entities(spark, sf_dir)
    aliases = _aliases(entities)
    norms = aliases.select(F.col("norm_alias").alias("norm")).unionByName(entities.select(F.col("norm_name").alias("norm"))).unionByName(spark.createDataFrame([("nobody",)], "norm string")).distinct()
    return graph.resolve(norms, entities, spark.createDataFrame([], "norm string, entity_id bigint"), aliases)


_VALID = ", classes(class, parent) AS (VALUES " + ", ".join(f"('{c}', {repr(p) if p else 'NULL'})" for c, p in G.CLASSES) + "), sig(predicate, domain, range) AS (VALUES " + ", ".join(map(str, G.SIGNATURES)) + "), up AS (SELECT class, class AS ancestor FROM classes UNION ALL SELECT up.class, parent FROM up JOIN classes ON classes.class = up.ancestor WHERE parent IS NOT NULL), named AS (SELECT t.id, predicate, s.type AS st, o.type AS ot FROM triples t JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id), checked AS (SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM sig WHERE sig.predicate = named.predicate) THEN 'relation' WHEN NOT EXISTS (SELECT 1 FROM sig JOIN up ON up.ancestor = domain WHERE sig.predicate = named.predicate AND up.class = st) THEN 'domain' WHEN NOT EXISTS (SELECT 1 FROM sig JOIN up ON up.ancestor = range WHERE sig.predicate = named.predicate AND up.class = ot) THEN 'range' END AS error FROM named)"


def _validated(spark, sf_dir, entities=None):
    classes = spark.createDataFrame(G.CLASSES, "class string, parent string")
    signatures = spark.createDataFrame(G.SIGNATURES, "predicate string, domain string, range string")
    return graph.validated(G.triples(spark, sf_dir), entities or G.entities(spark, sf_dir), classes, signatures)


@query(_VALID + " SELECT id FROM checked WHERE error IS NULL")
def kg_validate_accept(spark, sf_dir):
    return _validated(spark, sf_dir).filter("error IS NULL").select("id")


@query(_VALID + " SELECT id, error FROM checked WHERE error IS NOT NULL")
def kg_validate_reject(spark, sf_dir):
    return _validated(spark, sf_dir).filter("error IS NOT NULL").select("id", "error")


@query(_VALID.replace("s.type AS st", "CASE WHEN s.id % 3 = 0 THEN 'Gadget' ELSE s.type END AS st").replace("o.type AS ot", "CASE WHEN o.id % 3 = 0 THEN 'Gadget' ELSE o.type END AS ot") + " SELECT id, CASE WHEN error <> 'relation' AND 'Gadget' IN (st, ot) THEN 'class' ELSE error END AS error FROM checked JOIN named USING (id) WHERE error IS NOT NULL OR 'Gadget' IN (st, ot)")
def kg_validate_classes(spark, sf_dir):
    """Errors where a third of the entities is of a class that the ontology lacks."""
    odd = G.entities(spark, sf_dir).withColumn("type", F.when(F.col("id") % 3 == 0, "Gadget").otherwise(F.col("type")))
    return _validated(spark, sf_dir, odd).filter("error IS NOT NULL").select("id", "error")


@query(" , r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, source ORDER BY id, confidence) AS k FROM triples) SELECT id, subject_id, predicate, object_id, confidence, source FROM r WHERE k = 1".strip())
def kg_triple_dedupe_first_wins(spark, sf_dir):
    return graph.first_wins(G.triples(spark, sf_dir)).select("id", "subject_id", "predicate", "object_id", "confidence", "source")


@query("WITH r AS (SELECT p_brand AS key, p_partkey AS ord, p_type AS source, CASE WHEN p_size > 25 THEN 'size' || p_size ELSE '' END AS added FROM part), f AS (SELECT key, source, min(ord) AS ord FROM r GROUP BY key, source), l AS (SELECT key, string_agg(source, '|' ORDER BY ord) AS sources FROM f GROUP BY key), a AS (SELECT key, arg_min(added, ord) AS first_added FROM r WHERE added <> '' GROUP BY key) SELECT key, sources, first_added FROM l LEFT JOIN a USING (key)")
def kg_entity_fold(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("source"), F.when(F.col("p_size") > 25, F.concat(F.lit("size"), "p_size")).otherwise("").alias("added_time"))
    return graph.fold_sources(rows).withColumn("sources", F.array_join("sources", "|"))


@query(", k AS (SELECT DISTINCT subject_id, predicate, object_id, source FROM triples WHERE predicate = 'makes' AND subject_id % 5 = 0) SELECT id, subject_id, predicate, object_id FROM triples ANTI JOIN k USING (subject_id, predicate, object_id, source)")
def kg_suppression(spark, sf_dir):
    rows = G.triples(spark, sf_dir)
    return graph.suppress(rows, rows.filter("predicate = 'makes' AND subject_id % 5 = 0").select(graph.KEY).distinct()).select("id", "subject_id", "predicate", "object_id")


def _redirects(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 2 = 0").select((F.lit(G.G) + F.col("s_suppkey")).alias("source_id"), (F.lit(G.G) + F.col("s_suppkey") - 1).alias("target_id"))


_MERGED = ", rd AS (SELECT 1000000000 + s_suppkey AS source_id, 999999999 + s_suppkey AS target_id FROM supplier WHERE s_suppkey % 2 = 0), rm AS (SELECT t.id, coalesce(a.target_id, subject_id) AS subject_id, predicate, coalesce(b.target_id, object_id) AS object_id, confidence, source, a.target_id IS NOT NULL OR b.target_id IS NOT NULL AS touched FROM triples t LEFT JOIN rd a ON a.source_id = subject_id LEFT JOIN rd b ON b.source_id = object_id)"


@query(_MERGED + " SELECT count(*) AS relations_before, count(DISTINCT (subject_id, predicate, object_id, source)) AS relations_after, count(*) FILTER (WHERE touched AND subject_id = object_id) AS self_relations, count(*) - count(DISTINCT (subject_id, predicate, object_id, source)) AS duplicates FROM rm")
def merge_preview(spark, sf_dir):
    return graph.merge_impact(G.triples(spark, sf_dir), _redirects(spark, sf_dir))


@query(_MERGED + ", r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, source ORDER BY touched, id, confidence) AS k FROM rm) SELECT id, subject_id, predicate, object_id, confidence, source FROM r WHERE k = 1")
def merge_apply(spark, sf_dir):
    return graph.merged(G.triples(spark, sf_dir), _redirects(spark, sf_dir)).select("id", "subject_id", "predicate", "object_id", "confidence", "source")


@query(" , h AS (SELECT type, count(*) AS n FROM entities GROUP BY type) SELECT type, n FROM h".strip())
def type_histogram(spark, sf_dir):
    return G.entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(" , c AS (SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'triples', count(*) FROM triples UNION ALL SELECT 'contents', count(*) FROM documents) SELECT name, n FROM c".strip())
def table_counts(spark, sf_dir):
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("entities", G.entities(spark, sf_dir)).unionByName(count("triples", G.triples(spark, sf_dir))).unionByName(count("contents", spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _rule(i: int) -> str:
    return f"regexp_matches(text, '{RULES[i][1]}')"


_CATEGORIES = "WITH c AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_rule(i)} THEN '{n}' END" for i, (n, _) in enumerate(RULES)) + "], lambda x: x IS NOT NULL) AS l FROM documents), d AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN ['other'] ELSE l END AS l FROM c)"


@query(_CATEGORIES + " SELECT doc_id, array_to_string(l, ',') AS categories FROM d")
def doc_categories(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(T.categories(F.col("text"), RULES, "other"), ",").alias("categories"))


@query(_CATEGORIES + " SELECT c AS category, count(*) AS n FROM (SELECT unnest(l) AS c FROM d) GROUP BY c")
def category_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(T.categories(F.col("text"), RULES, "other")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, '|') AS sentences FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？!?])" + T.BLANK + r"*', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^" + T.BLANK + "+|" + T.BLANK + r"+\z', '', 'g')), lambda s: s <> '') AS l FROM (SELECT doc_id, replace(replace(text, ' the ', '!' || chr(10) || chr(9) || ' ' || chr(10)), ' of ', chr(12288) || '。') AS text FROM documents))")
def doc_sentences(spark, sf_dir):
    """Sentences of texts in which two words became marks between white space of several kinds."""
    marked = F.replace(F.replace("text", F.lit(" the "), F.lit("!\n\t \n")), F.lit(" of "), F.lit("\u3000。"))
    found = T.sentences(marked)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("sentences"))


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}|[㐀-鿿]{2}')) AS l FROM documents), f AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[a-z0-9]{3,}|[㐀-鿿]{2}')) AS h FROM documents) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(len(list_intersect(l, h)) AS BIGINT) AS overlap FROM t JOIN f USING (doc_id)")
def doc_tokens_overlap(spark, sf_dir):
    words, head = T.tokens(F.col("text")), T.tokens(F.substring("text", 1, 200))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.array_intersect(words, head)).cast("long").alias("overlap"))


@query("WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) SELECT conv_id, count(*) % 2 = 0 AND count(*) <= 20 AND bool_and(coalesce(role = CASE WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END AND trim(text) <> '', false)) AND coalesce(sum(length(text)), 0) <= 32000 AS valid FROM r GROUP BY conv_id")
def history_validate(spark, sf_dir):
    return conversations.validate_history(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("WITH r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS p FROM conversations), s AS (SELECT conv_id, p, count(*) AS n, coalesce(sum(length(text)), 0) AS c FROM r GROUP BY ALL), b AS (SELECT conv_id, p, sum(n) OVER w AS n, sum(c) OVER w AS c FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY p DESC)) SELECT conv_id, turn, role, text FROM r SEMI JOIN (SELECT * FROM b WHERE n <= 4 AND c <= 2000) k USING (conv_id, p)")
def history_trim(spark, sf_dir):
    return conversations.trim_history(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 4, 2000).select("conv_id", "turn", "role", "text")


@query(f"WITH {SEGMENTS} SELECT DISTINCT doc, \"start\", \"end\", text FROM seg WHERE \"start\" >= 0 AND \"start\" < \"end\" AND trim(text) <> ''")
def seg_valid(spark, sf_dir):
    return segments.valid_segments(_segments(spark, sf_dir))


@query(f"WITH {SEGMENTS}, o AS (SELECT *, CASE WHEN max(\"end\") OVER (PARTITION BY doc ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= \"start\" THEN 0 ELSE 1 END AS fresh FROM seg), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT doc, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n FROM i GROUP BY doc, g")
def seg_islands(spark, sf_dir):
    return segments.islands(_segments(spark, sf_dir))


@query(f"WITH {SEGMENTS}, t AS (SELECT *, sum(\"end\" - \"start\") OVER (PARTITION BY doc ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS e FROM seg) SELECT doc, \"start\", round(e - (\"end\" - \"start\"), 2) AS timeline_start, round(e, 2) AS timeline_end FROM t")
def seg_timeline(spark, sf_dir):
    rows = segments.timeline(_segments(spark, sf_dir))
    return rows.select("doc", "start", F.round("timeline_start", 2).alias("timeline_start"), F.round("timeline_end", 2).alias("timeline_end"))


@query(f"WITH {SEGMENTS}, clips AS (SELECT doc, min(\"start\") AS a, min(\"start\") + 20000 AS b FROM seg GROUP BY doc) SELECT doc, \"start\", \"end\", text, round(greatest(0, \"start\" - a), 3) AS \"from\", round(least(b - a, \"end\" - a), 3) AS \"to\" FROM seg JOIN clips USING (doc) WHERE \"start\" >= a - 0.002 AND \"end\" <= b + 0.002")
def seg_containment(spark, sf_dir):
    cues = _segments(spark, sf_dir)
    clips = cues.groupBy("doc").agg(F.min("start").alias("clip_start")).withColumn("clip_end", F.col("clip_start") + 20000)
    return segments.contained(cues, clips).select("doc", "start", "end", "text", "from", "to")


@query(f"WITH {SEGMENTS}, times AS (SELECT DISTINCT doc, \"start\" + 5 AS t FROM seg) SELECT doc, t, (SELECT max(c.\"start\") FROM seg c WHERE c.doc = times.doc AND c.\"start\" <= t AND t < c.\"end\") AS cue_start FROM times")
def seg_asof(spark, sf_dir):
    cues = _segments(spark, sf_dir)
    return segments.active_at(cues.select("doc", (F.col("start") + 5).alias("t")).distinct(), cues)


@query()
def seg_greedy_windows(spark, sf_dir):
    return segments.greedy_windows(_segments(spark, sf_dir), 1800.0)


@query("SELECT o_orderkey, round(CAST(h AS DOUBLE) * 3600 + m * 60 + s / 100, 2) AS seconds FROM (SELECT o_orderkey, o_orderkey % 5 AS h, o_orderkey % 60 AS m, o_orderkey % 5999 AS s FROM orders)")
def timestamp_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    stamp = F.format_string("%d:%02d:%s", k % 5, k % 60, F.regexp_replace(F.format_string("%05.2f", (k % 5999) / F.lit(100.0)), r"\.", ","))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(T.timestamp_seconds(stamp), 2).alias("seconds"))
