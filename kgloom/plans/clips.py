"""Queries of clips, captions and contents, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import language
from kgloom.operators import clips
from kgloom.plans import testgraph as G
from kgloom.plans.queries import SEGMENTS, _segments, query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clips(spark, sf_dir):
    """Two clips of each hour of a user's day, out of order on the joined timeline."""
    hours = _segments(spark, sf_dir).select("doc", F.floor(F.col("start") / 3600).alias("h")).distinct()
    one = lambda k, a, b: hours.select("doc", (F.col("h") * 2 + k).alias("idx"), (F.col("h") * 3600 + a).cast("double").alias("clip_start"), (F.col("h") * 3600 + b).cast("double").alias("clip_end"))
    return clips.timeline(one(0, 1800, 3600).union(one(1, 0, 1200)))


_TIMELINE = f"""WITH {SEGMENTS}, h AS (SELECT DISTINCT doc, CAST(floor("start" / 3600) AS BIGINT) AS h FROM seg),
c AS (SELECT doc, h * 2 AS idx, h * 3600 + 1800.0::DOUBLE AS cs, h * 3600 + 3600.0::DOUBLE AS ce FROM h UNION ALL SELECT doc, h * 2 + 1, h * 3600 + 0.0::DOUBLE, h * 3600 + 1200.0::DOUBLE FROM h),
tl AS (SELECT *, sum(ce - cs) OVER (PARTITION BY doc ORDER BY idx) - (ce - cs) AS a, sum(ce - cs) OVER (PARTITION BY doc ORDER BY idx) AS b FROM c)"""


@query(_TIMELINE + """ SELECT doc, idx, round(least(ce - cs, "end" - cs) + a, 3) AS "to", round(greatest(0.0, "start" - cs) + a, 3) AS "from", text FROM seg JOIN tl USING (doc) WHERE "start" >= cs - 0.002 AND "end" <= ce + 0.002""")
def clip_retimed(spark, sf_dir):
    return clips.retimed(_segments(spark, sf_dir), _clips(spark, sf_dir)).select("doc", "idx", "from", "to", "text")


@query(_TIMELINE + """, t AS (SELECT DISTINCT doc, floor("start" / 10) + 0.25::DOUBLE AS t FROM seg) SELECT t.doc, t, idx, round(cs + t - a, 3) AS "offset" FROM t LEFT JOIN tl ON tl.doc = t.doc AND a <= t AND t < b""")
def clip_at(spark, sf_dir):
    times = _segments(spark, sf_dir).select("doc", (F.floor(F.col("start") / 10) + 0.25).cast("double").alias("t")).distinct()
    return clips.clip_at(times, _clips(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, d AS (SELECT doc, CASE WHEN min("start") < 20000 THEN 'video' ELSE 'audio' END AS mode, round(max("end") - min("start"), 3) / 1000 + 1 AS target FROM seg GROUP BY doc), l AS (SELECT doc, min(x) AS least FROM (SELECT seg.doc, round("end" - "start", 3) AS x, target FROM seg JOIN d USING (doc)) WHERE x > 0 AND x <= target GROUP BY doc),
n AS (SELECT *, least(6, greatest(1, CAST(trunc(target / 5) AS INT))) AS n FROM d LEFT JOIN l USING (doc)), w AS (SELECT *, greatest(least(CASE mode WHEN 'video' THEN 15.0 ELSE 20.0 END::DOUBLE, target / n), coalesce(least, 0)) AS "window" FROM n)
SELECT doc, least(n, greatest(1, CAST(trunc(target / "window") AS INT))) AS clips, "window" FROM w""")
def clip_budget(spark, sf_dir):
    cues = _segments(spark, sf_dir)
    docs = cues.groupBy("doc").agg(F.when(F.min("start") < 20000, "video").otherwise("audio").alias("mode"), (F.round(F.max("end") - F.min("start"), 3) / 1000 + 1).alias("target"))
    return clips.selection_budget(docs, cues)


@query(f"""WITH {SEGMENTS}, p AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY "start", "end", text) - 1 AS INT) AS pos, "start", CAST(floor("start") AS INT) % 4 AS shared FROM seg), served AS (SELECT p.*, list_position([2, 0, 99, 2, 1], pos) AS ord FROM p WHERE doc LIKE '1%' AND pos IN (2, 0, 1)),
u AS (SELECT doc, pos, "start", shared, 'asked' AS how, ord FROM served UNION ALL SELECT doc, pos, "start", shared, 'words', -shared FROM p WHERE shared >= 2 AND doc NOT IN (SELECT doc FROM served)), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, pos) AS k FROM u)
SELECT doc, pos, "start", shared, how FROM r WHERE k <= 2""")
def clip_choice(spark, sf_dir):
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("doc").orderBy("start", "end", "text")) - 1).alias("pos")
    rows = _segments(spark, sf_dir).select("doc", pos, "start", (F.floor("start").cast("int") % 4).alias("shared"))
    asked = rows.select("doc").distinct().select("doc", F.when(F.startswith("doc", F.lit("1")), F.array(*map(F.lit, (2, 0, 99, 2, 1)))).otherwise(F.array(F.lit(-1))).alias("ids"))
    return clips.chosen_clips(rows, asked, 2)


@query(f"""WITH {SEGMENTS}, p AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY "start", "end", text) - 1 AS pos, text || '@' || "start" AS text FROM seg), n AS (SELECT doc, pos // 3 AS batch, pos, lag(text) OVER w AS p, lead(text) OVER w AS n FROM p WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, batch, max(p) FILTER (pos % 3 = 0) AS before, first(n ORDER BY pos DESC) AS after FROM n GROUP BY doc, batch""")
def caption_context(spark, sf_dir):
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("doc").orderBy("start", "end", "text")) - 1).cast("long")
    rows = _segments(spark, sf_dir).select("doc", pos.alias("pos"), F.concat("text", F.lit("@"), "start").alias("text")).withColumn("batch", F.floor(F.col("pos") / 3))
    return clips.with_context(rows)


@query(f"""WITH {SEGMENTS}, c AS (SELECT doc, CAST(floor("start" / 21600) AS INT) AS slide, "start", "end", text, CASE WHEN CAST(floor("start") AS INT) % 3 > 0 THEN CAST(floor("start") AS INT) % 5 END AS i FROM seg), t AS (SELECT doc, slide, text, min("start") AS s, arg_min("end", "start") AS e FROM c GROUP BY ALL), ts AS (SELECT doc, slide, string_agg(text, ' ' ORDER BY s, e, text) AS text FROM t GROUP BY ALL),
x AS (SELECT doc, slide, i, min("start") AS s FROM c WHERE i IS NOT NULL GROUP BY ALL), xs AS (SELECT doc, slide, string_agg(CAST(i AS VARCHAR), ',' ORDER BY s) AS indices, arg_min(i, s) AS main FROM x GROUP BY ALL) SELECT doc, slide, text, coalesce(indices, '') AS indices, main FROM ts LEFT JOIN xs USING (doc, slide)""")
def caption_rollup(spark, sf_dir):
    n = F.floor("start").cast("int")
    rows = _segments(spark, sf_dir).withColumns({"slide": F.floor(F.col("start") / 21600).cast("int"), "summary_index": F.when(n % 3 > 0, n % 5)})
    return clips.slide_rollup(rows).withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query("""WITH a AS (SELECT o_custkey AS batch, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE ' t' || o_orderkey || ' ' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 9 - 1 AS INT) END AS i FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'again', 0 FROM orders WHERE o_orderkey % 50 = 0),
odd AS (SELECT batch FROM a GROUP BY batch, id HAVING count(*) > 1 OR max(id) % 41 = 0) SELECT batch, id, trim(text) AS text, i AS summary_index FROM a WHERE batch NOT IN (SELECT batch FROM odd) AND trim(text) <> '' AND (i IS NULL OR i BETWEEN 0 AND 5)""")
def caption_answers(spark, sf_dir):
    """Answers to batches, some blank, some with an index out of range, some for cues that were not asked for."""
    orders, i = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("batch"), i.alias("id"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" t"), i, F.lit(" "))).alias("text"), F.when(i % 3 != 0, (i % 9 - 1).cast("int")).alias("summary_index"))
    again = orders.filter(i % 50 == 0).select("o_custkey", "o_orderkey", F.lit("again"), F.lit(0))
    return clips.valid_answers(rows.union(again), orders.filter(i % 41 != 0).select(F.col("o_custkey").alias("batch"), i.alias("id")), 6)


_GLUE = ", ".join(f"'{w}'" for w in language.GLUE)
_ORDINARY = ", ".join(f"'{w}'" for w in language.ORDINARY)


@query(rf"""WITH t AS (SELECT doc_id, text AS x FROM documents UNION ALL SELECT doc_id, ['中文字', 'かな 中', 'GPU4 A100', 'see https', 'https://a.b/c', '12:30, 5%', 'THIS IS', '由 MANUS Que Bot And Kit 组'][CAST(doc_id % 8 AS INT) + 1] FROM documents), n AS (SELECT *, length(regexp_replace(x, '[^\x{{3400}}-\x{{9fff}}]', '', 'g')) AS han, regexp_extract_all(x, '[A-Za-z]{{2,}}') AS latin, list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '') AS words FROM t)
SELECT doc_id, md5(x) AS text, coalesce(NOT regexp_matches(x, '[\x{{3040}}-\x{{30ff}}]') AND han > 0 AND (len(latin) <= greatest(3, han // 2) OR len(list_filter(latin, lambda w: lower(w) IN ({_GLUE}) OR NOT regexp_matches(w, '[A-Z]'))) = 0), false) AS chinese,
coalesce(trim(x) <> '' AND (regexp_matches(trim(x), '^https?://\S+$') OR regexp_matches(x, '^[0-9\s.,:%+\-/$¥€()]+$') OR (len(words) BETWEEN 1 AND 4 AND len(list_filter(words, lambda w: NOT regexp_matches(w, '^[A-Za-z0-9.+_-]+$') OR upper(w) IN ({_ORDINARY}) OR NOT (len(regexp_extract_all(w, '[A-Z]')) >= 2 OR regexp_matches(w, '^[0-9]+$')))) = 0)), false) AS literal FROM n""")
def caption_language(spark, sf_dir):
    docs, i = _table(spark, sf_dir, "documents"), F.col("doc_id")
    own = F.element_at(F.array(*map(F.lit, ("中文字", "かな 中", "GPU4 A100", "see https", "https://a.b/c", "12:30, 5%", "THIS IS", "由 MANUS Que Bot And Kit 组"))), (i % 8 + 1).cast("int"))
    rows = docs.select("doc_id", "text").union(docs.select("doc_id", own))
    return rows.select("doc_id", F.md5("text").alias("text"), language.chinese(F.col("text")).alias("chinese"), language.literal(F.col("text")).alias("literal"))


@query("WITH d AS (SELECT doc_id, ['nan', 'x', '12.5', '1e9', 'Infinity'][CAST(doc_id % 5 AS INT) + 1] AS a, CAST(n_chars AS VARCHAR) AS b, 500.0::DOUBLE AS e FROM documents) SELECT doc_id, coalesce(CASE WHEN a = '1e9' THEN 1e9 END, CASE WHEN CAST(b AS DOUBLE) >= e THEN CAST(b AS DOUBLE) END) AS duration FROM d")
def source_durations(spark, sf_dir):
    a = F.element_at(F.array(*map(F.lit, ("nan", "x", "12.5", "1e9", "Infinity"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", clips.source_duration(F.array(a, F.col("n_chars").cast("string")), F.lit(500.0)).alias("duration"))


@query(", v AS (SELECT id FROM entities WHERE type NOT IN ('Claim', 'VideoObject', 'Article', 'Book', 'CreativeWork', 'MediaObject') AND type = 'DefinedTerm') SELECT t.id, subject_id, object_id FROM triples t WHERE subject_id IN (SELECT id FROM v) AND object_id IN (SELECT id FROM v)")
def visible_edges(spark, sf_dir):
    shown = G.entities(spark, sf_dir).filter(language.visible(F.col("type"), "core", "DefinedTerm")).select("id")
    edges = G.triples(spark, sf_dir).select("id", "subject_id", "object_id")
    for end in ("subject_id", "object_id"):
        edges = edges.join(shown.withColumnRenamed("id", end), end, "left_semi")
    return edges


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['none'] WHEN 1 THEN ['a', 'b'] ELSE ['b'] END AS now, ['none', 'a', 'b', 'c'][CAST(doc_id // 3 % 4 AS INT) + 1] AS cat FROM documents)
SELECT doc_id, array_to_string(CASE WHEN cat = 'none' THEN ['none'] WHEN list_contains(now, cat) THEN CASE WHEN len(list_filter(now, lambda c: c <> cat AND c <> 'none')) = 0 THEN ['none'] ELSE list_filter(now, lambda c: c <> cat AND c <> 'none') END ELSE list_append(list_filter(now, lambda c: c <> 'none'), cat) END, ',') AS categories FROM d""")
def category_toggle(spark, sf_dir):
    i, words = F.col("doc_id"), lambda *w: F.array(*map(F.lit, w))
    now = F.when(i % 3 == 0, words("none")).when(i % 3 == 1, words("a", "b")).otherwise(words("b"))
    cat = F.element_at(words("none", "a", "b", "c"), (F.floor(i / 3) % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(language.toggled(now, cat, "none"), ",").alias("categories"))


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(text, '') LIKE '%e%' AS e FROM documents) SELECT doc_id, sha256(x) AS sha256, CAST(length(x) AS BIGINT) AS chars, replace(url_encode('doc:' || doc_id || '/*~ ü' || e), '+', '%20') AS quoted FROM d")
def content_stamps(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("s", language.stamp(F.col("text"), 1))
    name = F.concat(F.lit("doc:"), "doc_id", F.lit("/*~ ü"), F.contains(F.coalesce("text", F.lit("")), F.lit("e")))
    return docs.select("doc_id", "s.sha256", F.col("s.chars").cast("long").alias("chars"), language.quoted(name).alias("quoted"))
