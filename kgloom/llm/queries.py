"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, conversation_repair, decontaminate, jaccard_join, language_id, license_scan, lm_score, mixing, quality, simhash, source_divergence, substring_dedup, token_blocks
from kgloom.llm.common import fold, table

#: A text is kept from this score on.
QUALITY_THRESHOLD = 0.3


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown("f").alias("fingerprint"), shown("g").alias("edited_fingerprint"), simhash.likeness(F.col("f"), F.col("g")).alias("near_edited"), simhash.likeness(F.col("f"), F.col("next_f")).alias("near_next"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
starts AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, starts.k AS k FROM starts JOIN windows ON starts.s = windows.s AND starts.k = windows.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    places = F.col("base")["first"]
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(F.col("base")["label"]).alias("base_labels"), joined(F.concat(F.col("base")["label"], F.col("detections")["label"])).alias("labels"), "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_quality(docs, labels, "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", fold("held_out", 0, 5), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM windows JOIN firsts USING (s) WHERE doc_id > least GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(g, [])) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


#: Shares of the mix by domain.
MIX = {"good": 0.95, "low": 0.045, "toxic": 0.005}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the posteriors p_good, p_low, p_toxic, and the rate that brings the whole table's tokens to MIX."""
    rows = mixing.mixing_rates(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")), MIX)
    return rows.select("doc_id", "n_tokens", *(F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(MIX))), "rate")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold("held_out", 2, 7))
    return lm_score.score_texts(docs, "NOT held_out", keep=("doc_id", "held_out"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("held_out", 1, 3))
    learned = language_id.train_language_profiles(docs.filter("NOT held_out"))
    return language_id.predict_language(docs, *learned, keep=("doc_id", "held_out"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = token_blocks.token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([ord(c) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
        lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), 4294967295), 4294967295) % 20 AS kind FROM conversations),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM keyed WHERE kind <> 0)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM after),
faulty AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered),
moves AS (FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) t(initial, s, t)),
made AS (FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) t(s, t, role)),
ways(w, s, t, lines) AS (SELECT '', s, s, CAST([] AS VARCHAR[]) FROM range(4) x(s)
    UNION ALL SELECT w || 'I', ways.s, made.t, list_append(lines, role || ':') FROM ways JOIN made ON made.s = ways.t WHERE length(w) < 2),
paths(conv_id, i, s, cost, audit, lines, chosen) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]), 1::BIGINT FROM keyed
    UNION ALL SELECT conv_id, i, t, cost, audit, lines, row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) FROM (
        SELECT p.conv_id, f.i, e.t, p.cost + 5 * length(ways.w) + e.cost AS cost, p.audit || ways.w || e.letter AS audit, list_concat(list_concat(p.lines, ways.lines), e.line) AS lines
        FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ways ON ways.s = p.s,
        LATERAL (SELECT ways.t AS t, 2 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS line
            UNION ALL SELECT moves.t, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM moves WHERE f.fault NOT IN ('blank', 'duplicate') AND moves.initial = left(f.role, 1) AND moves.s = ways.t
            UNION ALL SELECT made.t, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 1 END, 'R', [made.role || ':' || f.text] FROM made WHERE f.fault NOT IN ('blank', 'duplicate') AND made.s = ways.t) e
        WHERE p.chosen = 1)),
counts AS (SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id),
ends AS (SELECT p.conv_id, p.cost + 5 * length(w) AS cost, audit || w AS audit, array_to_string(list_concat(p.lines, ways.lines), chr(10)) AS repaired
    FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id JOIN ways ON ways.s = p.s WHERE p.i = coalesce(c.n, 0) AND p.chosen = 1 AND ways.t IN (0, 3)),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(cost AS BIGINT) AS cost, audit, sha256(repaired) AS repaired_sha256 FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents"), path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    ids = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), "ids")
    return bpe.bpe_decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", digest(F.col("decoded_text")).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(totals.total, 0) + 2 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (kept.n + 2) // (v.total + 2 * v.v) AS BIGINT) AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10)
"""


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_license_scan, op4_jaccard_join, op5_quality, op6_substring_dedup, op7_mixing, op8_lm_score, op9_language_id, op10_token_blocks, op11_conversation_repair, op12_bpe, op13_source_divergence)}
ORACLES: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op11_conversation_repair": OP11_SQL, "op13_source_divergence": OP13_SQL}
