"""Types that meet, and the plan of a change of vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.graph import KEY, closure, validated


def type_meet(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """`pairs` (id, type, incoming) with `met` and `outcome`: keep the narrower type, refine to a narrower incoming one, or conflict."""
    up = closure(classes)
    of = lambda a, b, c: up.select(F.col("class").alias(a), F.col("ancestor").alias(b), F.lit(True).alias(c))
    both = pairs.join(of("type", "incoming", "_keep"), ["type", "incoming"], "left").join(of("incoming", "type", "_refine"), ["incoming", "type"], "left")
    keep = F.col("_keep").isNotNull() | (F.col("type") == F.col("incoming"))
    outcome = F.when(keep, "keep").when(F.col("_refine").isNotNull(), "refine").otherwise("conflict")
    return both.withColumn("outcome", outcome).select("id", "type", "incoming", F.when(F.col("outcome") == "keep", F.col("type")).when(F.col("outcome") == "refine", F.col("incoming")).alias("met"), "outcome")


def renamed(names: Column, changes: dict[str, str]) -> Column:
    if not changes:
        return names
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in changes.items() for x in kv)), names), names)


def migration_plan(triples: DataFrame, entities: DataFrame, classes: DataFrame, signatures: DataFrame, class_names: dict[str, str], relation_names: dict[str, str]) -> DataFrame:
    """(id, predicate, new_predicate, error) of each triple under new names of classes and relations: relation, domain, range, then duplicate; null where the change holds."""
    new = triples.withColumns({"was": F.col("predicate"), "predicate": renamed(F.col("predicate"), relation_names)})
    again = F.count("*").over(Window.partitionBy(*KEY)) > 1
    checked = validated(new.withColumn("again", again), entities.withColumn("type", renamed(F.col("type"), class_names)), classes, signatures)
    return checked.select("id", F.col("was").alias("predicate"), F.col("predicate").alias("new_predicate"), F.coalesce("error", F.when(F.col("again"), "duplicate")).alias("error"))


def retypings(entities: DataFrame, class_names: dict[str, str]) -> DataFrame:
    """(type, new_type, n) over all entities."""
    return entities.select("type", renamed(F.col("type"), class_names).alias("new_type")).groupBy("type", "new_type").agg(F.count("*").alias("n"))
