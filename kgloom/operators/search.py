"""Search of names and aliases, and the graph around what it finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import folded
from kgloom.operators.graph import with_names


def query_terms(query: str, mode: str = "terms", expand: bool = False, variants: dict[str, str] | None = None, most: int = 64) -> list[str]:
    """Terms of a query: its words, or the whole as a phrase, which `expand` follows by its words; each spelling once, at its first place, whatever its case or width.

    `variants` lists the characters that may stand for one, itself included; a term has at most `most` spellings.
    """
    if mode not in ("terms", "phrase"):
        raise ValueError("mode must be terms or phrase")
    words = query.split()
    terms = ([query.strip()] if mode == "phrase" and words else words) + (words if expand else [])

    def spellings(term: str) -> list[str]:
        return reduce(lambda begun, char: [b + c for b in begun for c in (variants or {}).get(char, char)][:most], term, [""])

    kept: dict[str, str] = {}
    for term in terms:
        for s in spellings(term):
            kept.setdefault(folded(s), s)
    return list(kept.values())


def search_entities(entities: DataFrame, aliases: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, name, matches) of entities (id, name, norm_name, aliases) whose name, alias or list of aliases as JSON text holds a term.

    matches are distinct (term, matched_by, matched_value), by term and leg. Each leg of a term is cut to `limit` by name and id before the union.
    """
    escaped = F.transform("aliases", lambda a: F.regexp_replace(a, r'(["\\])', r"\\$1"))
    as_json = F.when(F.size("aliases") == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join(escaped, '", "'), F.lit('"]')))
    named = entities.select("id", "name", "norm_name", as_json.alias("json"))
    legs = []
    for n, term in enumerate(terms):
        pattern = "%" + folded(term).replace("\\", "\\\\") + "%"
        found = (
            named.filter(F.col("norm_name").like(pattern) | F.lower("name").like(pattern)).select("id", "name", F.col("name").alias("value")),
            aliases.filter(F.col("norm_alias").like(pattern)).join(named, aliases["entity_id"] == named["id"]).select("id", "name", F.col("norm_alias").alias("value")),
            named.filter(F.lower("json").like(pattern)).select("id", "name", F.col("json").alias("value")),
        )
        for k, (leg, by) in enumerate(zip(found, ("name", "alias", "alias_json"))):
            match = F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(term).alias("term"), F.lit(by).alias("matched_by"), F.col("value").alias("matched_value"))
            legs.append(leg.orderBy("name", "id", "value").limit(limit).select("id", "name", match.alias("m")))
    if not legs:
        return entities.select("id", "name", F.expr("CAST(array() AS array<struct<term:string,matched_by:string,matched_value:string>>)").alias("matches")).limit(0)
    whole = reduce(DataFrame.union, legs).groupBy("id", "name").agg(F.array_sort(F.collect_set("m")).alias("m"))
    matches = F.transform("m", lambda x: F.struct(x["term"].alias("term"), x["matched_by"].alias("matched_by"), x["matched_value"].alias("matched_value")))
    return whole.select("id", "name", matches.alias("matches")).orderBy(F.lower("name"), "id").limit(limit)


def edges_of(triples: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The first `limit` triples, by id, with an end in `ids` (at most some hundreds): one pass with two existence tests."""
    hit = lambda end: F.col(end).isin([r["id"] for r in found])
    found = ids.select("id").distinct().collect()
    return triples.filter(hit("subject_id") | hit("object_id")).orderBy("id").limit(limit)


def related(matched: DataFrame, entities: DataFrame, triples: DataFrame, evidence: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """(kind, key, text, detail): the matched entities, their first `limit` edges with evidence in order of original_id, all related entities and the contents of the edges' sources.

    `matched` is a search's result, so that it and the edges are bounded by its limit.
    """
    edges = with_names(edges_of(triples, matched, limit), entities)
    records = evidence.join(edges.select(F.col("id").alias("triple_id")), "triple_id", "left_semi").groupBy("triple_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("original_id", "quote"))), lambda x: x["quote"]), " | ").alias("detail"))
    relation = F.concat(F.col("subject"), F.lit(" -- "), F.col("predicate"), F.lit(" -> "), F.col("object"))
    key = lambda c="id": F.col(c).cast("string").alias("key")
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).union(matched.select("id")).distinct()
    parts = [
        matched.select(F.lit("matched").alias("kind"), key(), F.col("name").alias("text"), F.lit(None).cast("string").alias("detail")),
        edges.join(records, edges["id"] == records["triple_id"], "left").select(F.lit("edge"), key(), relation, "detail"),
        entities.join(ends, "id", "left_semi").select(F.lit("entity"), key(), "name", "type"),
        contents.join(edges.filter("source <> ''").select(F.col("source").alias("id")), "id", "left_semi").select(F.lit("source"), key(), "title", F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.union, parts)


def named_in(entities: DataFrame, aliases: DataFrame, question: str, most: int = 20) -> DataFrame:
    """(id, name) of entities whose name or alias, of two letters at least, stands in the question; longest names first."""
    asked = F.lit(folded(question))
    spelled = entities.select("id", F.col("norm_name").alias("norm")).union(aliases.select("entity_id", "norm_alias"))
    ids = spelled.filter((F.char_length("norm") >= 2) & F.contains(asked, F.col("norm"))).select("id").distinct()
    return entities.join(ids, "id", "left_semi").select("id", "name").orderBy(F.desc(F.char_length("name")), "id").limit(most)


def chat_matches(entities: DataFrame, aliases: DataFrame, question: str, earlier: list[str], limit: int) -> DataFrame:
    """What a question is about: what the search of its words finds, else of the names that stand in it, else of those in the newest earlier question that holds any."""
    found = search_entities(entities, aliases, query_terms(question), limit)
    if not found.isEmpty():
        return found
    for asked in (question, *reversed(earlier)):
        names = [r["name"] for r in named_in(entities, aliases, asked).collect()]
        if names:
            return search_entities(entities, aliases, query_terms(" ".join(names)), limit)
    return found
