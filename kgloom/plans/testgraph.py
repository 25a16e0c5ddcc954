"""The knowledge graph that the star-schema tables stand for; ids are prefix * 10^9 + key."""

from __future__ import annotations

import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions.text import normalize
from kgloom.ontology import parse_ontology
from kgloom.operators import graph
from kgloom.store import shared_folder

G = 1_000_000_000
#: A lineitem's triple: its keys side by side.
MAKES_ID = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"
#: That number in two parts, which never overflow, and the first part's last value, within which 64 bits end.
_PART = 10**12
_REST = "(l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey)"
_HIGH, _LOW, _LAST = f"l_orderkey + {_REST} DIV {_PART}", f"{_REST} % {_PART}", (2**63 - 1) // _PART
ONTOLOGY = parse_ontology(Path(__file__).with_name("ontology.json").read_text(encoding="utf-8"))
CLASSES = list(ONTOLOGY.parents.items())
SIGNATURES = [(name, d, r) for name, relation in ONTOLOGY.relations.items() for d in relation.domain for r in relation.range]
#: Where the graph of a folder is stored, by application and folder.
_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of the graph, which is written when it is first asked for and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        df, path = make(spark, sf_dir), f"{shared_folder(spark)}/graph/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type, norm_name)"""
    return _stored(spark, sf_dir, "entities", _entities)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject_id, predicate, object_id, confidence, source), in ranges of subjects"""
    return _stored(spark, sf_dir, "triples", lambda *at: _triples(*at).repartitionByRange("subject_id").sortWithinPartitions("subject_id", "id"))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id)"""
    return _stored(spark, sf_dir, "hubs", lambda *at: graph.hubs(triples(*at)))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples with the names and types of their ends."""
    return graph.with_names(triples(spark, sf_dir), entities(spark, sf_dir), hubs(spark, sf_dir))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm_name, name, id): parts of one normalised name are one product."""
    part = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    named = part.withColumn("norm_name", normalize("p_name"))
    return named.groupBy("norm_name").agg((F.lit(3 * G) + F.min("k")).alias("id"), F.min_by("p_name", "k").alias("name"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = [("supplier", "s_suppkey", "s_name", 1, "Organization"), ("customer", "c_custkey", "c_name", 2, "Person"), ("nation", "n_nationkey", "n_name", 4, "DefinedTerm"), ("region", "r_regionkey", "r_name", 5, "DefinedTerm")]
    parts = [_read(spark, sf_dir, t).select((F.lit(p * G) + F.col(k)).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("type")) for t, k, n, p, kind in plain]
    parts.append(products(spark, sf_dir).select("id", "name", F.lit("Product").alias("type")))
    parts.append(_read(spark, sf_dir, "orders").select((F.lit(6 * G) + F.col("o_orderkey")).alias("id"), F.concat(F.lit("Order#"), "o_orderkey").alias("name"), F.lit("Event").alias("type")))
    return reduce(DataFrame.unionByName, parts).withColumn("norm_name", F.lower(F.trim("name")))


def with_makes_id(lines: DataFrame) -> DataFrame:
    """Lineitems with makes_id, their keys side by side.

    Where such a number takes more than 64 bits, the lines from order _LAST on share the ids that are left, as many for each
    order: within it they are numbered by their keys. So ids follow the keys, equal keys have one id, and no other line moves.
    """
    late, order = F.expr(f"{_HIGH} >= {_LAST}"), F.col("l_orderkey")
    ends = lines.agg(F.max(F.struct(F.expr(_HIGH).alias("high"), F.expr(_LOW).alias("low"))).alias("most"), F.min(F.when(late, order)).alias("first"), F.max(F.when(late, order)).alias("last")).first()
    if ends["most"] is None or tuple(ends["most"]) <= divmod(2**63 - 1, _PART):
        return lines.withColumn("makes_id", F.expr(MAKES_ID))
    each = (2**63 - _LAST * _PART) // (ends["last"] - ends["first"] + 1)
    place = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    numbered = F.when(place < each, F.lit(_LAST * _PART) + (order - ends["first"]) * each + place).otherwise(F.raise_error(F.lit(f"an order has over {each:,} lines, for which no ids are left")))
    return lines.filter(~late).withColumn("makes_id", F.expr(MAKES_ID)).unionByName(lines.filter(late).withColumn("makes_id", numbered))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("norm_name")).join(products(spark, sf_dir).select("norm_name", F.col("id").alias("object_id")), "norm_name")
    makes = with_makes_id(_read(spark, sf_dir, "lineitem")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("makes_id").alias("id"), (F.lit(G) + F.col("l_suppkey")).alias("subject_id"), F.lit("makes").alias("predicate"), "object_id", F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.concat(F.lit("order:"), "l_orderkey").alias("source"))
    row = lambda df, base, key, s, predicate, o: df.select((F.lit(base) + F.col(key)).alias("id"), s.alias("subject_id"), F.lit(predicate).alias("predicate"), o.alias("object_id"), F.lit(1.0).alias("confidence"), F.lit("base").alias("source"))
    orders, supplier, nation = (_read(spark, sf_dir, t) for t in ("orders", "supplier", "nation"))
    return reduce(DataFrame.unionByName, [
        makes,
        row(orders, 10**18, "o_orderkey", F.lit(2 * G) + F.col("o_custkey"), "participatesIn", F.lit(6 * G) + F.col("o_orderkey")),
        row(supplier, 2 * 10**18, "s_suppkey", F.lit(G) + F.col("s_suppkey"), "relatedTo", F.lit(4 * G) + F.col("s_nationkey")),
        row(nation, 3 * 10**18, "n_nationkey", F.lit(4 * G) + F.col("n_nationkey"), "relatedTo", F.lit(5 * G) + F.col("n_regionkey")),
        row(orders.filter("o_orderkey % 7 = 0"), 4 * 10**18, "o_orderkey", F.lit(2 * G) + F.col("o_custkey"), "develops", F.lit(6 * G) + F.col("o_orderkey")),
        row(nation, 5 * 10**18, "n_nationkey", F.lit(4 * G) + F.col("n_nationkey"), "unknownRelation", F.lit(5 * G) + F.col("n_regionkey")),
    ])


#: The same in SQL, for oracles.
SQL = """
products AS (SELECT lower(trim(p_name)) AS norm_name, 3000000000 + min(p_partkey) AS id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1),
entities AS (SELECT id, name, type, lower(trim(name)) AS norm_name FROM (
    SELECT 1000000000 + s_suppkey AS id, s_name AS name, 'Organization' AS type FROM supplier UNION ALL SELECT 2000000000 + c_custkey, c_name, 'Person' FROM customer
    UNION ALL SELECT 4000000000 + n_nationkey, n_name, 'DefinedTerm' FROM nation UNION ALL SELECT 5000000000 + r_regionkey, r_name, 'DefinedTerm' FROM region
    UNION ALL SELECT id, name, 'Product' FROM products UNION ALL SELECT 6000000000 + o_orderkey, 'Order#' || o_orderkey, 'Event' FROM orders)),
triples AS (
    SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS id, 1000000000 + l_suppkey AS subject_id, 'makes' AS predicate, products.id AS object_id, round(1 - l_discount, 4) AS confidence, 'order:' || l_orderkey AS source
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN products ON products.norm_name = lower(trim(p_name))
    UNION ALL SELECT 1000000000000000000 + o_orderkey, 2000000000 + o_custkey, 'participatesIn', 6000000000 + o_orderkey, 1.0, 'base' FROM orders
    UNION ALL SELECT 2000000000000000000 + s_suppkey, 1000000000 + s_suppkey, 'relatedTo', 4000000000 + s_nationkey, 1.0, 'base' FROM supplier
    UNION ALL SELECT 3000000000000000000 + n_nationkey, 4000000000 + n_nationkey, 'relatedTo', 5000000000 + n_regionkey, 1.0, 'base' FROM nation
    UNION ALL SELECT 4000000000000000000 + o_orderkey, 2000000000 + o_custkey, 'develops', 6000000000 + o_orderkey, 1.0, 'base' FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT 5000000000000000000 + n_nationkey, 4000000000 + n_nationkey, 'unknownRelation', 5000000000 + n_regionkey, 1.0, 'base' FROM nation)
"""
