"""Queries of a change of vocabulary, and the same in DuckDB SQL: the graph as former names have it, brought to the present ones."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import graph
from kgloom.operators.migration import entity_plan, migrate
from kgloom.plans import testgraph as G
from kgloom.plans.queries import query
from kgloom.store import Snapshots, shared_folder

DECIDED = "name string, from_type string, to_type string, reason string, properties map<string,string>"


def _state(spark, sf_dir) -> dict[str, DataFrame]:
    """Relations that hold, each once; suppliers are companies, nations topics, parts wares, some orders contents."""
    i = F.col("id")
    former = F.when(F.col("type") == "Organization", "Company").when(F.col("type") == "DefinedTerm", "Topic").when((F.col("type") == "Product") & (i % 2 == 0), "Ware").otherwise(F.col("type"))
    properties = F.when(i % 3 == 0, F.create_map(F.lit("legacyType"), F.lit("older"))).otherwise(F.create_map(F.lit("ontologyVersion"), F.lit("1")))
    entities = G.entities(spark, sf_dir).select("id", "name", "norm_name", former.alias("type"), F.array(F.concat(F.lit("alias "), i.cast("string"))).alias("aliases"), properties.alias("properties"))
    triples = graph.first_wins(G.triples(spark, sf_dir).filter("predicate IN ('makes', 'participatesIn', 'relatedTo')"))
    return {
        "entities": entities,
        "triples": triples.withColumn("predicate", F.when((F.col("predicate") == "makes") & (F.col("id") % 2 == 0), "produces").otherwise(F.col("predicate"))),
        "aliases": entities.select(F.col("aliases")[0].alias("norm_alias"), F.col("id").alias("entity_id")),
        "merged_entities": spark.createDataFrame([], "source_id bigint, target_id bigint, former string"),
    }


def _decisions(spark, to="Thing"):
    return spark.createDataFrame([("NATION_3", "Topic", to, "unsure", {"reviewReason": "ask"}), ("NATION_4", "Country", "Person", "stale", {})], DECIDED)


_SQL = """, en AS (SELECT id, name, CASE WHEN type = 'Organization' THEN 'Company' WHEN type = 'DefinedTerm' THEN 'Topic' WHEN type = 'Product' AND id % 2 = 0 THEN 'Ware' ELSE type END AS before, type, id % 3 = 0 AS old FROM entities),
pl AS (SELECT *, CASE WHEN name = 'NATION_3' THEN 'Thing' ELSE type END AS after, CASE WHEN name = 'NATION_3' THEN 'unsure' WHEN before = type THEN 'kept' ELSE 'renamed' END AS reason FROM en),
pr AS (SELECT id, before, after, name, reason, concat_ws(';', CASE WHEN before <> after THEN 'classificationReason=' || reason END, CASE WHEN old THEN 'legacyType=older' WHEN before <> after THEN 'legacyType=' || before END, 'ontologyUri=', 'ontologyVersion=2', CASE WHEN after = 'Thing' THEN 'reviewReason=ask' END, CASE WHEN after = 'Thing' THEN 'reviewStatus=needs_review' END, CASE WHEN after = 'DefinedTerm' THEN 'termCategory=research_topic' END) AS properties FROM pl)"""


def _pairs(properties):
    return F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(_SQL + " SELECT id, before, after, reason, properties, true AS changed, CAST(NULL AS VARCHAR) AS error FROM pr")
def migration_entities(spark, sf_dir):
    """The plan of all entities."""
    plan = entity_plan(_state(spark, sf_dir)["entities"], G.ONTOLOGY, _decisions(spark))
    return plan.select("id", "before", "after", "reason", _pairs("properties").alias("properties"), "changed", "error")


@query(_SQL + """, kept AS (SELECT * FROM triples WHERE predicate IN ('makes', 'participatesIn', 'relatedTo') QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id, source ORDER BY id) = 1)
SELECT 'entity' AS part, CAST(id AS VARCHAR) AS key, after || '|' || properties AS value FROM pr UNION ALL SELECT 'triple', CAST(id AS VARCHAR), predicate FROM kept
UNION ALL FROM (VALUES ('outcome', '1 refused', 'blocked, 25 errors, version 1'), ('outcome', '2 preview', 'planned, 0 errors, version 1'), ('outcome', '3 applied', 'applied, 0 errors, version 2'), ('outcome', '4 repeated', 'current, 0 errors, version 2')) t(part, key, value)""".replace("25 errors", "' || (SELECT count(*) + 1 FROM kept WHERE 4000000003 IN (subject_id, object_id)) || ' errors"))
def migration_apply(spark, sf_dir):
    """A decision for an unknown class, which is refused; the same for a known one, seen first, then applied, then repeated; and the graph that is published in the end."""
    store = Snapshots(spark, f"{shared_folder(spark)}/migration-{uuid.uuid4().hex}")
    store.publish(_state(spark, sf_dir), "former names")
    steps = []
    for name, decisions, apply in (("1 refused", _decisions(spark, "Gadget"), True), ("2 preview", _decisions(spark), False), ("3 applied", _decisions(spark), True), ("4 repeated", _decisions(spark), True)):
        outcome, _, _, errors = migrate(store, G.ONTOLOGY, decisions, apply)
        steps.append(("outcome", name, f"{outcome}, {errors.count()} errors, version {store.version()}"))
    after = store.tables()
    parts = [
        after["entities"].select(F.lit("entity").alias("part"), F.col("id").cast("string").alias("key"), F.concat("type", F.lit("|"), _pairs("properties")).alias("value")),
        after["triples"].select(F.lit("triple").alias("part"), F.col("id").cast("string").alias("key"), F.col("predicate").alias("value")),
        spark.createDataFrame(steps, "part string, key string, value string"),
    ]
    return reduce(DataFrame.unionByName, parts)
