"""Forward chaining over facts: one wide frame, where a field that a fact lacks is null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.store import checkpointed

_TESTS = {
    "gte": lambda c, v: F.coalesce(c >= v, F.lit(False)),
    "lte": lambda c, v: F.coalesce(c <= v, F.lit(False)),
    "gt": lambda c, v: F.coalesce(c > v, F.lit(False)),
    "lt": lambda c, v: F.coalesce(c < v, F.lit(False)),
    "eq": lambda c, v: c.eqNullSafe(v),
    "ne": lambda c, v: ~c.eqNullSafe(v),
    "in": lambda c, v: F.coalesce(c.isin(v), F.lit(False)),
    "contains": lambda c, v: F.coalesce(F.contains(c, F.lit(v)), F.lit(False)),
}


@dataclass(frozen=True)
class Rule:
    """The first pattern triggers and binds "$field"; the others only have to hold for some fact. `then`: (action, its parameters)."""

    name: str
    when: list[dict[str, Any]]
    then: list[tuple[str, dict[str, Any]]]


def matches(pattern: dict[str, Any], columns: list[str]) -> Column:
    """A pattern as a condition; unknown tests hold, and a field that no fact has is null."""
    held = [F.lit(True)]
    for field, test in pattern.items():
        value = F.col(field) if field in columns else F.lit(None).cast("string")
        tests = test if isinstance(test, dict) else {"eq": test}
        held += [_TESTS[op](value, v) for op, v in tests.items() if op in _TESTS]
    return reduce(lambda a, b: a & b, held)


def facts(entities: DataFrame, triples: DataFrame, contents: DataFrame) -> DataFrame:
    """Entities (name, type, degree), named triples (subject, predicate, object, source) and contents (id, relevance, top_topic) as one frame."""
    kind = lambda df, k, *c: df.select(F.lit(k).alias("kind"), *c)
    rows = kind(entities, "entity", "name", "type", "degree").unionByName(kind(triples, "triple", "subject", "predicate", "object", "source"), True)
    return rows.unionByName(kind(contents, "content", "id", "relevance", "top_topic"), True)


def top_relevance(relevance: Column) -> Column:
    """struct(top_topic, relevance) of a map: the first entry with the highest value, else (null, 0)."""
    entries = F.coalesce(F.map_entries(relevance), F.array().cast("array<struct<key:string,value:double>>"))
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    first = F.get(F.filter(entries, lambda e: e["value"] == best), F.lit(0))
    return F.struct(first["key"].alias("top_topic"), F.coalesce(first["value"], F.lit(0.0)).alias("relevance"))


def fire(given: DataFrame, rules: list[Rule], rounds: int = 10) -> DataFrame:
    """(action, rule, parameters): what the rules derive until a round derives nothing new.

    A derived fact is seen in the next round. One of equal action and parameters
    stays, that of the first rule. A rule whose guards held before is tried on
    the new facts only.
    """
    params = sorted({p for r in rules for _, values in r.then for p in values})
    shown = ["action", "rule", *params]
    known = delta = given
    seen: DataFrame | None = None
    open_rules: set[str] = set()
    for _ in range(rounds):
        found = []
        for place, rule in enumerate(rules):
            if any(known.filter(matches(g, known.columns)).isEmpty() for g in rule.when[1:]):
                continue
            base = delta if rule.name in open_rules else known
            open_rules.add(rule.name)
            hit = base.filter(matches(rule.when[0], base.columns))
            for action, values in rule.then:
                bound = {p: (F.col(v[1:]) if v[1:] in base.columns else F.lit(None)) if isinstance(v, str) and v.startswith("$") else F.lit(v) for p, v in values.items()}
                found.append(hit.select(F.lit(place).alias("_place"), F.lit(action).alias("action"), F.lit(rule.name).alias("rule"), *(bound.get(p, F.lit(None)).cast("string").alias(p) for p in params)))
        if not found:
            break
        new = reduce(DataFrame.unionByName, found).groupBy("action", *params).agg(F.min_by("rule", "_place").alias("rule")).select(shown)
        if seen is not None:
            same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("action", *params)])
            new = new.alias("n").join(seen.alias("s"), same, "left_anti")
        new = checkpointed(new)
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        delta = new.withColumn("kind", F.lit("action"))
        known = known.unionByName(delta, True)
    if seen is None:
        return given.select(*(F.lit(None).cast("string").alias(c) for c in shown)).filter("false")
    return seen


def ranked(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")
