"""Knowledge-graph operators over entities (id, name, norm_name, type) and triples (id, subject_id, predicate, object_id, confidence, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.store import written

KEY = ["subject_id", "predicate", "object_id", "source"]


def degree(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples that touch each entity; a self-loop counts once, an isolated entity has 0."""
    ends = triples.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id"))
    return entities.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def display_degree(triples: DataFrame) -> DataFrame:
    """(id, degree) over distinct (subject, predicate, object); a self-loop counts twice."""
    edges = triples.select("subject_id", "predicate", "object_id").distinct()
    return edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def incident_edges(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples with an end in `ids`: two semi-joins on one key each, never a join on a disjunction."""
    by_subject = triples.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").select(triples.columns)
    by_object = triples.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(triples.columns)
    return by_subject.unionByName(by_object).dropDuplicates(["id"])


#: From so many triples on an end is a hub.
HUB = 256


def hubs(triples: DataFrame, least: int = HUB) -> DataFrame:
    """(id): ends of at least `least` triples; of all ends there are two for every `least` triples at most."""
    ends = triples.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id")


def with_names(triples: DataFrame, entities: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Triples with the names and types of both ends.

    Names of `hubs` (id) are broadcast: triples between two hubs move nowhere, and those of one hub do not meet in one
    task but are dealt by their own ids.
    """
    side = lambda rows, c: rows.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c), F.col("type").alias(f"{c}_type"))
    if hubs is None:
        return triples.join(side(entities, "subject"), "subject_id").join(side(entities, "object"), "object_id")
    ends, columns = ("subject", "object"), [*triples.columns, "subject", "subject_type", "object", "object_type"]
    known = entities.join(F.broadcast(hubs), "id", "left_semi")
    rows = triples
    for c in ends:
        rows = rows.join(F.broadcast(side(known, c).withColumn(f"{c}_hub", F.lit(True))), f"{c}_id", "left").withColumn(f"{c}_hub", F.coalesce(f"{c}_hub", F.lit(False)))
    rest = rows.filter("NOT (subject_hub AND object_hub)")
    for c in ends:
        # A hub's rows find nothing here, and its key is the triple's, so that they are spread.
        far = side(entities, c).toDF("key", f"far_{c}", f"far_{c}_type").withColumns({f"{c}_hub": F.lit(False), f"{c}_found": F.lit(True)})
        rest = rest.withColumn("key", F.when(F.col(f"{c}_hub"), F.col("id")).otherwise(F.col(f"{c}_id"))).join(far, [f"{c}_hub", "key"], "left").filter(F.col(f"{c}_hub") | F.col(f"{c}_found")).drop("key")
        rest = rest.withColumns({c: F.coalesce(c, f"far_{c}"), f"{c}_type": F.coalesce(f"{c}_type", f"far_{c}_type")})
    return rows.filter("subject_hub AND object_hub").select(columns).unionByName(rest.select(columns))


def search(entities: DataFrame, aliases: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, norm_name, reasons): entities whose name or alias holds a term; % and _ in a term are wildcards.

    Each leg is limited by name for each term before the union, and the whole after it.
    """
    legs = None
    for term in terms:
        pattern = "%" + term.lower().replace("\\", "\\\\") + "%"
        by_name = entities.filter(F.col("norm_name").like(pattern)).select("id", "norm_name", F.lit("name").alias("reason")).orderBy("norm_name", "id").limit(limit)
        by_alias = aliases.filter(F.col("norm_alias").like(pattern)).join(entities, aliases["entity_id"] == entities["id"]).select("id", "norm_name", F.lit("alias").alias("reason")).orderBy("norm_name", "id").limit(limit)
        leg = by_name.unionByName(by_alias)
        legs = leg if legs is None else legs.unionByName(leg)
    return legs.groupBy("id", "norm_name").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")).orderBy("norm_name", "id").limit(limit)


def resolve(norms: DataFrame, entities: DataFrame, former: DataFrame, aliases: DataFrame) -> DataFrame:
    """(norm, entity_id, status): canonical name, then former name of a merged entity, then alias; several owners of an alias are ambiguous."""
    candidates = (
        entities.select(F.col("norm_name").alias("norm"), F.col("id").alias("entity_id"), F.lit(0).alias("rank"))
        .unionByName(former.select("norm", "entity_id", F.lit(1).alias("rank")))
        .unionByName(aliases.select(F.col("norm_alias").alias("norm"), "entity_id", F.lit(2).alias("rank")))
    )
    ends = lambda f: [f(F.when(F.col("rank") == k, F.col("entity_id"))) for k in range(3)]
    owners = candidates.groupBy("norm").agg(F.coalesce(*ends(F.min)).alias("least"), F.coalesce(*ends(F.max)).alias("most"))
    status = F.when(F.col("least").isNull(), "missing").when(F.col("least") < F.col("most"), "ambiguous").otherwise("found")
    return norms.join(owners, "norm", "left").select("norm", F.when(F.col("least") == F.col("most"), F.col("least")).alias("entity_id"), status.alias("status"))


def small_rows(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a part of an ontology, which has `most` at most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"an ontology has over {most:,} rows")
    return rows


def ancestors(classes: DataFrame) -> dict[str, list[str]]:
    """Each class of a (class, parent) tree with its ancestors, itself first."""
    parents = {r["class"]: r["parent"] for r in small_rows(classes)}
    out = {}
    for name in parents:
        line = [name]
        while (up := parents.get(line[-1])) is not None:
            if up in line:
                raise ValueError(f"the class tree has a cycle at {up}")
            line.append(up)
        out[name] = line
    return out


def closure(classes: DataFrame) -> DataFrame:
    """(class, ancestor), reflexive, of a (class, parent) tree."""
    return classes.sparkSession.createDataFrame([(c, a) for c, line in ancestors(classes).items() for a in line], "class string, ancestor string")


def validated(triples: DataFrame, entities: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Named triples with `error`, as `checked` finds it."""
    return checked(with_names(triples, entities), classes, signatures)


def checked(named: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows (predicate, subject_type, object_type, ...) with `error`: unknown relation, then unknown class of either end, then domain, then range; null where the triple holds.

    What an ontology allows is bounded by it, and joined by broadcast.
    """
    up, allowed = ancestors(classes), small_rows(signatures.select("predicate", "domain", "range"))
    table = lambda rows, *names: F.broadcast(named.sparkSession.createDataFrame(sorted(rows), ", ".join(f"{n} {'boolean' if n.endswith(('_ok', 'listed', 'known')) else 'string'}" for n in names)))
    side = lambda kind, end: table({(r["predicate"], c, True) for r in allowed for c, line in up.items() if r[kind] in line}, "predicate", f"{end}_type", f"{kind}_ok")
    rows = named.join(table({(r["predicate"], True) for r in allowed}, "predicate", "known"), "predicate", "left")
    for kind, end in (("domain", "subject"), ("range", "object")):
        rows = rows.join(side(kind, end), ["predicate", f"{end}_type"], "left").join(table({(c, True) for c in up}, f"{end}_type", f"{end}_listed"), f"{end}_type", "left")
    return rows.withColumn("error", F.when(F.col("known").isNull(), "relation").when(F.col("subject_listed").isNull() | F.col("object_listed").isNull(), "class").when(F.col("domain_ok").isNull(), "domain").when(F.col("range_ok").isNull(), "range"))


def repeated(triples: DataFrame) -> DataFrame:
    """The triples whose key others may have too, and all that do have one: of a key only a hash moves, and no triple where few are repeated."""
    return triples.join(counted(_shared_hashes(triples)), F.xxhash64(*KEY) == F.col("key_hash"), "left_semi")


def _shared_hashes(triples: DataFrame) -> DataFrame:
    return written(triples.groupBy(F.xxhash64(*KEY).alias("key_hash")).agg(F.count("*").alias("n")).filter("n > 1").select("key_hash"))


def first_wins(triples: DataFrame) -> DataFrame:
    """The first triple, by id and then confidence, of each subject, predicate, object and source; those that share no hash of a key stay where they are."""
    shared, key_hash = counted(_shared_hashes(triples)), F.xxhash64(*KEY) == F.col("key_hash")
    order = Window.partitionBy(*KEY).orderBy("id", "confidence")
    firsts = triples.join(shared, key_hash, "left_semi").withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")
    return triples.join(shared, key_hash, "left_anti").unionByName(firsts)


def fold_sources(rows: DataFrame) -> DataFrame:
    """(key, sources, first_added): sources in order of first appearance, and the first non-empty added_time, of rows (key, ord, source, added_time)."""
    firsts = rows.groupBy("key", "source").agg(F.min("ord").alias("ord"))
    listed = firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]).alias("sources"))
    added = rows.filter("added_time <> ''").groupBy("key").agg(F.min_by("added_time", "ord").alias("first_added"))
    return listed.join(added, "key", "left")


def suppress(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Triples whose key is not a manual tombstone."""
    return triples.join(keys, KEY, "left_anti").select(triples.columns)


#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 1_000_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast in joins where it has `most` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remapped(triples: DataFrame, redirects: DataFrame) -> DataFrame:
    """Triples with redirected ends (source_id to target_id), and whether they touched a merged entity."""
    redirects = counted(redirects)
    s, o = (redirects.select(F.col("source_id").alias(f"{c}_id"), F.col("target_id").alias(f"{c}_to")) for c in ("subject", "object"))
    both = triples.join(s, "subject_id", "left").join(o, "object_id", "left")
    touched = F.col("subject_to").isNotNull() | F.col("object_to").isNotNull()
    return both.withColumns({"touched": touched, "subject_id": F.coalesce("subject_to", "subject_id"), "object_id": F.coalesce("object_to", "object_id")}).drop("subject_to", "object_to")


def merge_impact(triples: DataFrame, redirects: DataFrame) -> DataFrame:
    """One row: relations before and after a merge, duplicates and self-relations that it makes."""
    rows = remapped(triples, redirects)
    return rows.agg(F.count("*").alias("relations_before"), F.countDistinct(*KEY).alias("relations_after"), F.count_if((F.col("subject_id") == F.col("object_id")) & F.col("touched")).alias("self_relations")).withColumn("duplicates", F.col("relations_before") - F.col("relations_after"))


def merged(triples: DataFrame, redirects: DataFrame) -> DataFrame:
    """Remapped triples without duplicates: one that the merge did not touch stays before one that it did, then the lowest id."""
    order = Window.partitionBy(*KEY).orderBy("touched", "id", "confidence")
    return remapped(triples, redirects).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "touched")
