"""Queries of ingest, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import ingest
from kgloom.plans import testgraph as G
from kgloom.plans.curation import _UP
from kgloom.plans.queries import ALIASES, _aliases, query

_PATHS = ingest.class_paths(G.CLASSES)
_URIS = {name: f"urn:class:{name}" for name in _PATHS}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _former(spark):
    return spark.createDataFrame([("brand#13", 1_000_000_002), ("brand#21", 1_000_000_003)], "norm string, entity_id bigint")


def _snapshot(spark, sf_dir):
    """Entities with an alias and a source each; a third is a plain Thing, an eleventh edited by a person."""
    entities, i = G.entities(spark, sf_dir), F.col("id")
    named = entities.join(_aliases(entities).withColumnRenamed("entity_id", "id"), "id", "left")
    return named.select("id", "name", "norm_name", F.when(i % 3 == 0, "Thing").otherwise(F.col("type")).alias("type"), F.array_compact(F.array("norm_alias")).alias("aliases"), F.create_map(F.lit("seed"), "type").alias("properties"), F.array(F.lit("base")).alias("sources"), F.when(i % 2 == 0, "2020").otherwise("").alias("added_time"), (i % 11 == 0).alias("manual"))


def _batch(spark, sf_dir):
    """What each order says of its suppliers, some by a bare number, and what each part says of its brand, some of a class that conflicts or is unknown."""
    line = F.col("l_linenumber")
    suppliers = G.with_makes_id(_table(spark, sf_dir, "lineitem")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.when(line == 5, F.col("l_suppkey").cast("string")).otherwise(F.col("s_name"))
    kind = F.element_at(F.array(*map(F.lit, ("Organization", "Thing", "Person", "Organization"))), (line % 4 + 1).cast("int"))
    said = suppliers.select(F.col("makes_id").alias("ord"), name.alias("name"), kind.alias("type"), F.array(F.concat(F.lit("no "), F.col("l_suppkey") % 10)).alias("aliases"), F.create_map(F.lit("line"), line.cast("string")).alias("properties"), F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.when(line == 1, "").otherwise(F.concat(F.lit("2021-"), line)).alias("added_time"))
    size = F.col("p_size")
    brand = F.when(size % 11 == 0, "Gadget").when(size % 7 == 0, "Person").otherwise(F.element_at(F.array(*map(F.lit, ("Thing", "CreativeWork", "Claim"))), (size % 3 + 1).cast("int")))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"), brand.alias("type"), F.array("p_type").alias("aliases"), F.create_map(F.lit("size"), size.cast("string")).alias("properties"), F.concat(F.lit("part:"), size).alias("source"), F.lit("").alias("added_time"))
    return said.unionByName(parts).withColumn("norm", F.lower(F.trim("name")))


_CTE = ALIASES + """, paths(type, path) AS (VALUES """ + ", ".join(f"('{c}', '{p}')" for c, p in _PATHS.items()) + """),
sn AS (SELECT e.id, name, norm_name, CASE WHEN e.id % 3 = 0 THEN 'Thing' ELSE type END AS type, type AS seed, norm_alias, CASE WHEN e.id % 2 = 0 THEN '2020' ELSE '' END AS added_time, e.id % 11 = 0 AS manual FROM entities e LEFT JOIN aliases ON entity_id = e.id),
b AS (SELECT *, lower(trim(name)) AS norm FROM (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS ord, CASE WHEN l_linenumber = 5 THEN CAST(l_suppkey AS VARCHAR) ELSE s_name END AS name, ['Organization', 'Thing', 'Person', 'Organization'][l_linenumber % 4 + 1] AS type, 'no ' || (l_suppkey % 10) AS alias, 'line' AS k, CAST(l_linenumber AS VARCHAR) AS v, 'order:' || l_orderkey AS source, CASE WHEN l_linenumber = 1 THEN '' ELSE '2021-' || l_linenumber END AS added_time FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT p_partkey, p_brand, CASE WHEN p_size % 11 = 0 THEN 'Gadget' WHEN p_size % 7 = 0 THEN 'Person' ELSE ['Thing', 'CreativeWork', 'Claim'][p_size % 3 + 1] END, p_type, 'size', CAST(p_size AS VARCHAR), 'part:' || p_size, '' FROM part)),
cand AS (SELECT norm_name AS norm, id AS e, 0 AS r FROM entities UNION ALL SELECT norm_alias, entity_id, 2 FROM aliases UNION ALL SELECT * FROM (VALUES ('brand#13', 1000000002, 1), ('brand#21', 1000000003, 1))), best AS (SELECT norm, min(r) AS r FROM cand GROUP BY norm), own AS (SELECT norm, count(DISTINCT e) AS n, min(e) AS e FROM cand JOIN best USING (norm, r) GROUP BY norm),
r0 AS (SELECT b.*, CASE WHEN n = 1 THEN e END AS eid, path, CASE WHEN path IS NULL THEN 'class' WHEN n > 1 THEN 'ambiguous' END AS early FROM b LEFT JOIN own USING (norm) LEFT JOIN paths USING (type)),
r1 AS (SELECT r0.*, coalesce(CAST(eid AS VARCHAR), norm) AS owner, p2.path AS cur, coalesce(sn.manual, false) AS manual FROM r0 LEFT JOIN sn ON sn.id = eid LEFT JOIN paths p2 ON p2.type = sn.type),
seen AS (SELECT owner, path, min(ord) AS ord, any_value(cur) AS cur FROM r1 WHERE early IS NULL GROUP BY owner, path),
way AS (SELECT owner, any_value(cur) AS cur, list(path ORDER BY ord) AS w FROM seen GROUP BY owner),
fin AS (SELECT owner, cur, w, list_reduce(CASE WHEN cur IS NULL THEN w ELSE list_prepend(cur, w) END, lambda a, x: CASE WHEN starts_with(x, a) THEN x ELSE a END) AS f FROM way),
fst AS (SELECT owner, f, CASE WHEN cur IS NULL OR starts_with(list_filter(w, lambda p: starts_with(f, p))[1], cur) THEN list_filter(w, lambda p: starts_with(f, p))[1] ELSE cur END AS first FROM fin),
jd AS (SELECT r1.*, f, first, CASE WHEN early IS NOT NULL THEN early WHEN NOT manual AND NOT starts_with(f, path) THEN 'conflict' END AS error FROM r1 LEFT JOIN fst USING (owner))"""


@query(_CTE + " SELECT ord, eid AS entity_id, error FROM jd")
def kg_upsert_judged(spark, sf_dir):
    entities = _snapshot(spark, sf_dir)
    return ingest.judged_entities(_batch(spark, sf_dir), entities, _former(spark), _aliases(G.entities(spark, sf_dir)), G.CLASSES).select("ord", "entity_id", "error")


@query(_CTE + """, ok AS (SELECT * FROM jd WHERE error IS NULL), src AS (SELECT owner, source, min(ord) AS ord FROM ok GROUP BY ALL), srcs AS (SELECT owner, list(source ORDER BY ord) AS s FROM src GROUP BY owner),
al AS (SELECT owner, list(DISTINCT alias) AS a FROM ok WHERE NOT manual GROUP BY owner),
kv AS (SELECT owner, ord, k, v FROM ok WHERE NOT manual UNION ALL SELECT owner, ord, 'text', name FROM ok WHERE NOT manual AND type = 'Claim' UNION ALL SELECT owner, ord, 'verificationStatus', 'unverified' FROM ok WHERE NOT manual AND type = 'Claim'),
kvs AS (SELECT owner, k, arg_max(v, ord) AS v FROM kv GROUP BY ALL),
w AS (SELECT owner, any_value(eid) AS id, min(ord) AS ord, arg_min(name, ord) AS name, any_value(norm) AS norm, any_value(f) AS f, any_value(first) AS first, arg_min(added_time, ord) FILTER (added_time <> '') AS t FROM ok GROUP BY owner),
al2 AS (SELECT coalesce(sn.id, 7000000077 + row_number() OVER (PARTITION BY sn.id IS NULL ORDER BY w.ord)) AS id, coalesce(sn.name, w.name) AS name, coalesce(sn.norm_name, w.norm) AS norm_name, CASE WHEN owner IS NOT NULL AND NOT coalesce(manual, false) THEN split_part(f, '/', -2) ELSE sn.type END AS type,
    CASE WHEN owner IS NOT NULL AND NOT coalesce(manual, false) THEN list_sort(list_distinct(list_concat(CASE WHEN norm_alias IS NULL THEN [] ELSE [norm_alias] END, coalesce(a, [])))) ELSE CASE WHEN norm_alias IS NULL THEN [] ELSE [norm_alias] END END AS aliases,
    list_concat(CASE WHEN sn.id IS NULL THEN [] ELSE ['base'] END, coalesce(s, [])) AS sources, CASE WHEN coalesce(manual, false) OR owner IS NULL THEN sn.added_time WHEN coalesce(sn.added_time, '') <> '' THEN sn.added_time ELSE coalesce(t, '') END AS added_time, coalesce(manual, false) AS manual, owner, first, seed
    FROM sn FULL JOIN w ON w.id = sn.id LEFT JOIN srcs USING (owner) LEFT JOIN al USING (owner)),
props AS (SELECT id, k, v FROM al2 JOIN kvs USING (owner) WHERE NOT manual UNION ALL SELECT id, 'seed', seed FROM al2 WHERE seed IS NOT NULL UNION ALL SELECT id, 'ontologyUri', 'urn:class:' || type FROM al2 WHERE owner IS NOT NULL AND NOT manual UNION ALL SELECT id, 'ontologyVersion', '2' FROM al2 WHERE owner IS NOT NULL AND NOT manual UNION ALL SELECT id, 'reviewStatus', 'needs_review' FROM al2 WHERE NOT manual AND first = '/Thing/'),
pj AS (SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM props GROUP BY id)
SELECT id, name, norm_name, type, array_to_string(aliases, ',') AS aliases, coalesce(properties, '') AS properties, array_to_string(sources, ',') AS sources, added_time, manual FROM al2 LEFT JOIN pj USING (id)""")
def kg_upsert(spark, sf_dir):
    after = ingest.upsert_entities(_batch(spark, sf_dir), _snapshot(spark, sf_dir), _former(spark), _aliases(G.entities(spark, sf_dir)), G.CLASSES, _URIS, "2", spark.sql("SELECT 7000000077L AS id"))
    pairs = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return after.withColumns({"properties": F.array_join(pairs, ";"), "aliases": F.array_join("aliases", ","), "sources": F.array_join("sources", ",")})


_PERSONS = " SELECT CASE WHEN l_linenumber = 7 THEN 'nobody' WHEN l_linenumber = 6 THEN '1' ELSE lower(s_name) END AS subject, CASE WHEN l_linenumber % 3 = 0 THEN 'produces' WHEN l_linenumber = 4 THEN 'invents' ELSE 'relatedTo' END AS predicate, CASE WHEN l_linenumber % 2 = 0 THEN lower(trim(p_name)) ELSE lower(s_name) END AS object, 'brand:' || p_brand AS source, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


def _statements(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = G.with_makes_id(_table(spark, sf_dir, "lineitem")).join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    subject = F.when(line == 7, "nobody").when(line == 6, "1").otherwise(F.lower("s_name"))
    predicate = F.when(line % 3 == 0, "produces").when(line == 4, "invents").otherwise("relatedTo")
    return rows.select(subject.alias("subject"), predicate.alias("predicate"), F.when(line % 2 == 0, F.lower(F.trim("p_name"))).otherwise(F.lower("s_name")).alias("object"), F.concat(F.lit("brand:"), "p_brand").alias("source"), F.col("makes_id").alias("ord"))


_JUDGED = ALIASES + ", sig(predicate, domain, range) AS (VALUES " + ", ".join(map(str, G.SIGNATURES)) + ")" + _UP.replace("up AS", "up AS") + """, st AS (""" + _PERSONS + """),
cand AS (SELECT norm_name AS norm, id AS e, 0 AS r FROM entities UNION ALL SELECT norm_alias, entity_id, 2 FROM aliases), best AS (SELECT norm, min(r) AS r FROM cand GROUP BY norm), own AS (SELECT norm, count(DISTINCT e) AS n, min(e) AS e FROM cand JOIN best USING (norm, r) GROUP BY norm),
j AS (SELECT ord, st.source, CASE WHEN sa.n = 1 THEN sa.e END AS subject_id, CASE WHEN oa.n = 1 THEN oa.e END AS object_id, CASE predicate WHEN 'produces' THEN 'makes' ELSE predicate END AS predicate, CASE WHEN subject IN ('supplier#000000003', 'nobody2') OR object = 'supplier#000000003' THEN 'rejected end' WHEN sa.n IS NULL THEN 'missing' WHEN sa.n > 1 THEN 'ambiguous' WHEN oa.n IS NULL THEN 'missing' WHEN oa.n > 1 THEN 'ambiguous' END AS e0 FROM st LEFT JOIN own sa ON sa.norm = subject LEFT JOIN own oa ON oa.norm = object),
k AS (SELECT j.*, s.type AS s_type, o.type AS o_type FROM j LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id),
dom AS (SELECT DISTINCT predicate, class FROM sig JOIN up ON ancestor = domain), ran AS (SELECT DISTINCT predicate, class FROM sig JOIN up ON ancestor = range),
m AS (SELECT k.*, CASE WHEN e0 IS NOT NULL THEN e0 WHEN subject_id % 5 = 0 AND predicate = 'relatedTo' THEN 'suppressed' WHEN predicate NOT IN (SELECT predicate FROM sig) THEN 'relation' WHEN NOT EXISTS (SELECT 1 FROM dom WHERE dom.predicate = k.predicate AND class = s_type) THEN 'domain' WHEN NOT EXISTS (SELECT 1 FROM ran WHERE ran.predicate = k.predicate AND class = o_type) THEN 'range' END AS e1 FROM k),
firsts AS (SELECT subject_id, predicate, object_id, source, min(ord) AS ord FROM m WHERE e1 IS NULL AND NOT (source = 'brand:Brand#1' AND predicate = 'relatedTo') GROUP BY ALL)"""


def _hidden(rows, entities):
    """A fifth of the suppliers' own relations are tombstones, and one brand's are stored already."""
    pairs = rows.filter("predicate = 'relatedTo'").select("subject", "predicate", "object", "source").distinct()
    ids = entities.select("norm_name", "id")
    found = pairs.join(ids.toDF("subject", "subject_id"), "subject").join(ids.toDF("object", "object_id"), "object").select("subject_id", "predicate", "object_id", "source")
    return found.filter("subject_id % 5 = 0"), found.filter("source = 'brand:Brand#1'")


@query(_JUDGED + " SELECT ord, subject_id, predicate, object_id, source, coalesce(e1, CASE WHEN ord IN (SELECT ord FROM firsts) THEN 'accepted' ELSE 'duplicate' END) AS outcome FROM m")
def kg_ingest(spark, sf_dir):
    rows, entities = _statements(spark, sf_dir), G.entities(spark, sf_dir)
    suppressed, existing = _hidden(rows, entities)
    rejected = spark.createDataFrame([("supplier#000000003",)], "norm string")
    none = spark.createDataFrame([], "norm string, entity_id bigint")
    return ingest.judged_triples(rows, rejected, entities, none, _aliases(entities), spark.createDataFrame(G.CLASSES, "class string, parent string"), spark.createDataFrame(G.SIGNATURES, "predicate string, domain string, range string"), {"produces": "makes"}, suppressed, existing)


def _replaced(spark, sf_dir):
    return _table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("source"))


_KEPT = ", kept AS (SELECT * FROM triples WHERE id % 13 = 0 OR source NOT IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 0))"


@query(_KEPT + " SELECT id, subject_id, predicate, object_id, source FROM kept")
def kg_replace_source(spark, sf_dir):
    triples = G.triples(spark, sf_dir)
    return ingest.replaced_triples(triples, _replaced(spark, sf_dir), triples.filter("id % 13 = 0")).select("id", "subject_id", "predicate", "object_id", "source")


@query(_KEPT + """, src AS (SELECT DISTINCT object_id AS id, source FROM triples WHERE predicate = 'makes'), left_ AS (SELECT id, list(source ORDER BY source) FILTER (NOT (source LIKE 'order:%' AND CAST(split_part(source, ':', 2) AS BIGINT) % 5 <> 0)) AS s FROM src GROUP BY id)
SELECT id, coalesce(array_to_string(s, ','), '') AS sources FROM left_ WHERE len(coalesce(s, [])) > 0 OR id % 17 = 0 OR id IN (SELECT subject_id FROM kept UNION SELECT object_id FROM kept)""")
def kg_prune(spark, sf_dir):
    """Products, with the orders that name them as sources, after four fifths of the orders are replaced."""
    triples = G.triples(spark, sf_dir)
    products = triples.filter("predicate = 'makes'").groupBy(F.col("object_id").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    kept = ingest.replaced_triples(triples, _replaced(spark, sf_dir), triples.filter("id % 13 = 0"))
    return ingest.pruned_entities(products, kept, _replaced(spark, sf_dir), products.filter("id % 17 = 0")).withColumn("sources", F.array_join("sources", ","))


@query("""WITH c AS (SELECT 'doc:' || doc_id AS id, lang AS kind, source, 'u' || doc_id AS url, 'old' AS title, 'processed' AS status, '{"n":1}' AS meta FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT 'doc:' || doc_id AS id, 'article' AS kind, 'other' AS source, '' AS url, coalesce(lang, '-') AS title, 'queued' AS status, '{}' AS meta FROM documents WHERE doc_id % 2 = 0)
SELECT id, CASE WHEN c.id IS NULL THEN b.kind ELSE c.kind END AS kind, CASE WHEN c.id IS NULL THEN b.source ELSE c.source END AS source, CASE WHEN c.id IS NULL THEN b.url ELSE c.url END AS url, coalesce(b.title, c.title) AS title, coalesce(b.status, c.status) AS status, coalesce(b.meta, c.meta) AS meta FROM c FULL JOIN b USING (id)""")
def content_queue(spark, sf_dir):
    """Half of the documents queued again over two thirds that are stored: title, status and meta of a stored one are reset."""
    docs, i = _table(spark, sf_dir, "documents"), F.concat(F.lit("doc:"), "doc_id").alias("id")
    stored = docs.filter("doc_id % 3 <> 0").select(i, F.col("lang").alias("kind"), "source", F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("old").alias("title"), F.lit("processed").alias("status"), F.lit('{"n":1}').alias("meta"))
    queued = docs.filter("doc_id % 2 = 0").select(i, F.lit("article").alias("kind"), F.lit("other").alias("source"), F.lit("").alias("url"), F.coalesce("lang", F.lit("-")).alias("title"), F.lit("queued").alias("status"), F.lit("{}").alias("meta"))
    return ingest.upsert_contents(stored, queued)


_PASTED = r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'NATION_' || doc_id % 7 WHEN 1 THEN ' Title ' || doc_id || ' ' WHEN 2 THEN repeat('t', CAST(doc_id % 400 AS INT)) ELSE 'x' END AS title, text, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'ftp://a.b' WHEN 2 THEN 'https:///p' ELSE 'HTTP://a.b/c' END AS url FROM documents),
n AS (SELECT *, trim(title) AS t, trim(coalesce(text, '')) AS x FROM d), k AS (SELECT *, 'article:' || left(sha256(t || chr(0) || url || chr(0) || x), 24) AS content_id FROM n)
SELECT doc_id, content_id, CASE WHEN length(t) < 1 OR length(t) > 200 THEN 'title' WHEN length(x) < 20 OR length(x) > 100000 THEN 'length' WHEN url IN ('ftp://a.b', 'https:///p') THEN 'url' WHEN right(content_id, 1) < '4' THEN 'reused' WHEN lower(t) IN (SELECT lower(n_name) FROM nation) THEN 'taken' ELSE 'new' END AS outcome FROM k"""


@query(_PASTED)
def pasted_articles(spark, sf_dir):
    i = F.col("doc_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("NATION_"), i % 7)).when(i % 4 == 1, F.concat(F.lit(" Title "), i, F.lit(" "))).when(i % 4 == 2, F.repeat(F.lit("t"), (i % 400).cast("int"))).otherwise("x")
    url = F.when(i % 5 == 0, "").when(i % 5 == 1, "ftp://a.b").when(i % 5 == 2, "https:///p").otherwise("HTTP://a.b/c")
    rows = _table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), "text", url.alias("url")).withColumn("norm_title", F.lower(F.trim("title")))
    nations = G.entities(spark, sf_dir).filter("type = 'DefinedTerm'")
    none = spark.createDataFrame([], "norm_alias string, entity_id bigint")
    ids = ingest.pasted_articles(rows, spark.createDataFrame([], "id string"), nations, none).select(F.col("content_id").alias("id")).filter(F.right("id", F.lit(1)) < "4")
    return ingest.pasted_articles(rows, ids, nations, none).select("doc_id", "content_id", "outcome")
