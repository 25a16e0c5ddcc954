"""A change of vocabulary, planned over the whole graph and published as one new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import normalize
from kgloom.ontology import Ontology
from kgloom.operators import graph
from kgloom.operators.graph import KEY, counted, resolve
from kgloom.operators.ingest_run import CATEGORIES
from kgloom.store import Snapshots, written

# Classes of contents by medium; a content of another medium is a CreativeWork.
MEDIA = {"video": "VideoObject", "article": "Article"}


def _with(properties: Column, keep: bool, **values: Column) -> Column:
    """`properties` with the values that are not null; `keep` leaves what is there."""
    new = F.map_filter(F.create_map(*(x for key, value in values.items() for x in (F.lit(key), value))), lambda k, v: v.isNotNull())
    return F.map_zip_with(properties, new, lambda k, old, now: F.coalesce(old, now) if keep else F.coalesce(now, old))


def entity_plan(entities: DataFrame, ontology: Ontology, decisions: DataFrame) -> DataFrame:
    """id, name, before, after (classes), properties, reason, changed and error of each entity (id, name, type, properties).

    A class follows from its alias, for a Content from its medium, and from a decision (name, from_type, to_type, reason,
    properties; one a name) where that names the class before. reason: kept, renamed, medium or the decision's; error:
    class, where the new class is unknown. Properties gain what a class brings: URI and version, the class before,
    the category of a former term, a claim's text and check, and the mark that a bare Thing needs a review.
    """
    return _planned(entities, ontology, decisions).select("id", "name", "before", "after", F.col("now").alias("properties"), "reason", "changed", "error")


def _planned(entities: DataFrame, ontology: Ontology, decisions: DataFrame) -> DataFrame:
    """The entities with what `entity_plan` says of each: before, after, now (properties), reason, changed, error. No entity moves where decisions are few."""
    chosen = decisions.select("name", "from_type", "to_type", F.col("reason").alias("why"), F.col("properties").alias("given"))
    rows = entities.join(counted(chosen), "name", "left")
    medium = F.try_element_at(F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair)), F.try_element_at("properties", F.lit("kind")))
    old, content = F.col("type"), F.col("type") == "Content"
    decided = F.coalesce(F.col("from_type") == old, F.lit(False))
    after = F.when(decided, F.col("to_type")).when(content, F.coalesce(medium, F.lit("CreativeWork"))).otherwise(ontology.canonical_class(old))
    reason = F.when(decided, F.col("why")).when(content, "medium").when(after == old, "kept").otherwise("renamed")
    rows = rows.withColumns({"before": old, "after": after, "reason": reason})
    given = F.when(decided & F.col("given").isNotNull(), F.col("given")).otherwise(F.expr("CAST(map() AS map<string,string>)"))
    rows = rows.withColumn("now", F.map_zip_with("properties", given, lambda k, a, b: F.coalesce(b, a)))
    uris = F.create_map(*(F.lit(x) for name in ontology.parents for x in (name, ontology.uris.get(name, ""))))
    moved, to = F.col("before") != F.col("after"), F.col("after")
    rows = rows.withColumn("uri", F.try_element_at(uris, to))
    rows = rows.withColumn("now", _with(F.col("now"), False, ontologyUri=F.col("uri"), ontologyVersion=F.lit(ontology.version), classificationReason=F.when(moved, F.col("reason")), reviewStatus=F.when(to == "Thing", "needs_review")))
    category = F.try_element_at(F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair)), F.col("before"))
    claim = to == "Claim"
    rows = rows.withColumn("now", _with(F.col("now"), True, legacyType=F.when(moved, F.col("before")), termCategory=F.when(to == "DefinedTerm", category), text=F.when(claim, F.col("name")), verificationStatus=F.when(claim, "unverified"), reviewReason=F.when(to == "Thing", "no class is certain")))
    same = F.array_sort(F.map_entries("now")) == F.array_sort(F.map_entries("properties"))
    return rows.select(*entities.columns, "before", "after", "now", "reason", (moved | ~same).alias("changed"), F.when(F.col("uri").isNull(), "class").alias("error"))


def _renamed(triples: DataFrame, ontology: Ontology) -> DataFrame:
    return triples.withColumns({"before": F.col("predicate"), "predicate": ontology.canonical_relation(F.col("predicate"))})


def _relation(ontology: Ontology) -> Column:
    """The predicate where the ontology has it; all others are alike."""
    known = F.create_map(*(F.lit(x) for name in ontology.relations for x in (name, name))) if ontology.relations else F.expr("CAST(map() AS map<string,string>)")
    return F.coalesce(F.try_element_at(known, F.col("predicate")), F.lit(""))


def triple_ends(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """(end, side, relation), each once: what stands at an end of which relation."""
    ends = F.explode(F.array(*(F.struct(F.col(f"{side}_id").alias("end"), F.lit(side).alias("side")) for side in ("subject", "object")))).alias("e")
    return _renamed(triples, ontology).select(ends, _relation(ontology).alias("relation")).select("e.end", "e.side", "relation").filter("end IS NOT NULL").distinct()


def first_keys(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """(KEY, first): the keys that several triples get, and the least id of each."""
    return graph.repeated(_renamed(triples, ontology)).groupBy(*KEY).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(*KEY, "first")


def end_faults(ends: DataFrame, plan: DataFrame, ontology: Ontology) -> DataFrame:
    """(end, side, relation, fault) of the `triple_ends` that break their relation: missing, class, or domain and range; names do not move."""
    spark = ends.sparkSession
    up = graph.ancestors(ontology.classes(spark))
    sides = {"subject": "domain", "object": "range"}
    fit = sorted({(side, r["predicate"], c, True) for r in graph.small_rows(ontology.signatures(spark)) for side, kind in sides.items() for c, line in up.items() if r[kind] in line})
    rows = ends.join(plan.select(F.col("id").alias("end"), F.col("after").alias("type"), F.lit(True).alias("found")), "end", "left")
    rows = rows.join(F.broadcast(spark.createDataFrame(fit, "side string, relation string, type string, fits boolean")), ["side", "relation", "type"], "left")
    rows = rows.join(F.broadcast(spark.createDataFrame([(c, True) for c in up], "type string, listed boolean")), "type", "left")
    breach = F.when(F.col("fits").isNull(), F.when(F.col("side") == "subject", sides["subject"]).otherwise(sides["object"]))
    return rows.select("end", "side", "relation", F.when(F.col("found").isNull(), "missing").when(F.col("relation") == "", None).when(F.col("listed").isNull(), "class").otherwise(breach).alias("fault")).filter("fault IS NOT NULL").distinct()


def _related(triples: DataFrame, faults: DataFrame, firsts: DataFrame, ontology: Ontology) -> DataFrame:
    """The triples with before, predicate (after), held (both ends are there) and error; no triple moves where faults and repeated keys are few."""
    rows = _renamed(triples, ontology).withColumn("relation", _relation(ontology)).join(counted(firsts), KEY, "left")
    for side in ("subject", "object"):
        of = faults.filter(F.col("side") == side).select(F.col("end").alias(f"{side}_id"), "relation", F.col("fault").alias(f"{side}_fault"))
        rows = rows.join(counted(of), [f"{side}_id", "relation"], "left")
    s, o = F.col("subject_fault"), F.col("object_fault")
    gone = F.col("subject_id").isNull() | F.col("object_id").isNull() | s.eqNullSafe("missing") | o.eqNullSafe("missing")
    unlisted = s.eqNullSafe("class") | o.eqNullSafe("class")
    error = F.when(F.col("relation") == "", "relation").when(unlisted, "class").when(s.isNotNull(), s).when(o.isNotNull(), o).when(F.col("first") < F.col("id"), "duplicate")
    return rows.select(*triples.columns, "before", (~gone).alias("held"), error.alias("error"))


def relation_plan(triples: DataFrame, plan: DataFrame, ontology: Ontology) -> DataFrame:
    """id, before, after (predicates) and error of each triple under the planned classes: relation, class, domain, range, or duplicate where a triple of a lower id gets the same key."""
    faults, firsts = written(end_faults(triple_ends(triples, ontology), plan, ontology)), written(first_keys(triples, ontology))
    return _judged(_related(triples, faults, firsts, ontology))


def _judged(related: DataFrame) -> DataFrame:
    return related.filter("held").select("id", "before", F.col("predicate").alias("after"), "error")


def alias_errors(entities: DataFrame, former: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, alias) of aliases in an entity's list that do not lead back to it.

    Who asks for a name and who owns it meet once, by name; only names that do not lead all who ask to themselves are resolved and joined.
    """
    listed = entities.select("id", F.explode("aliases").alias("alias"))
    plain = F.coalesce(F.rlike("alias", F.lit(r"\A[\x21-\x7E]+( [\x21-\x7E]+)*\z")), F.lit(False))
    said = listed.filter(plain).withColumn("norm", F.lower("alias")).unionByName(listed.filter(~plain).withColumn("norm", normalize("alias")))
    owners = entities.select(F.col("norm_name").alias("norm"), "id").unionByName(former.select("norm", F.col("entity_id").alias("id"))).unionByName(aliases.select(F.col("norm_alias").alias("norm"), F.col("entity_id").alias("id")))
    both = said.select("norm", "id", F.lit(True).alias("asks")).unionByName(owners.select("norm", "id", F.lit(False).alias("asks"))).repartition("norm")
    asks, owns = F.when(F.col("asks"), F.col("id")), F.when(~F.col("asks"), F.col("id"))
    met = both.groupBy("norm").agg(F.min(asks).alias("a"), F.max(asks).alias("b"), F.min(owns).alias("c"), F.max(owns).alias("d"))
    doubted = counted(written(met.filter("a IS NOT NULL AND NOT coalesce(a = b AND b = c AND c = d, false)").select("norm")))
    few = lambda rows, norm: rows.join(doubted.withColumnRenamed("norm", norm), norm, "left_semi").select(rows.columns)
    open_ = few(said, "norm")
    resolved = resolve(open_.select("norm").distinct(), few(entities, "norm_name"), few(former, "norm"), few(aliases, "norm_alias"))
    return open_.unionByName(said.filter("norm IS NULL")).join(resolved, "norm", "left").filter("NOT (entity_id <=> id)").select("id", "alias").distinct()


def migrate(store: Snapshots, ontology: Ontology, decisions: DataFrame, apply: bool = False) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """What became of the migration of the store's newest version: blocked (by errors), current (nothing changes), planned, or with `apply` applied.

    Also the plans of entities and relations, and the errors (kind, id, error). Applying publishes one version, after
    all of it is written; a migration that is repeated finds nothing to change, and a blocked one publishes nothing.
    """
    state = store.tables()
    former = state["merged_entities"].select(F.col("former").alias("norm"), F.col("target_id").alias("entity_id"))
    # What decisions do not change is found once for tables that are as they were.
    lost = store.derived("alias errors", ("entities", "merged_entities", "aliases"), lambda: alias_errors(state["entities"], former, state["aliases"]))
    ends = store.derived(f"ends {ontology}", ("triples",), lambda: triple_ends(state["triples"], ontology))
    firsts = store.derived(f"first keys {ontology}", ("triples",), lambda: first_keys(state["triples"], ontology))
    entities = entity_plan(state["entities"], ontology, decisions)
    related = _related(state["triples"], written(end_faults(ends, entities, ontology)), firsts, ontology)
    relations = _judged(related)
    wrong = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", "error")
    lost = lost.select("id", F.concat(F.lit("alias "), "alias").alias("error"))
    errors = written(wrong("entity", entities.filter("error IS NOT NULL")).unionByName(wrong("triple", relations.filter("error IS NOT NULL"))).unionByName(wrong("entity", lost)))
    if not errors.isEmpty():
        return "blocked", entities, relations, errors
    if entities.filter("changed").isEmpty() and relations.filter("before <> after").isEmpty():
        return "current", entities, relations, errors
    if not apply:
        return "planned", entities, relations, errors
    now = lambda new, old: F.when(F.col("changed"), F.coalesce(new, old)).otherwise(F.col(old))
    rows = _planned(state["entities"], ontology, decisions).withColumns({"type": now("after", "type"), "properties": now("now", "properties")}).select(state["entities"].columns)
    lines = related.withColumn("predicate", F.when(F.col("held"), F.coalesce("predicate", "before")).otherwise(F.col("before"))).select(state["triples"].columns)
    store.publish({"entities": rows, "triples": lines}, f"migration to vocabulary {ontology.version}")
    return "applied", entities, relations, errors
