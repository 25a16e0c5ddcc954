"""Edits by people: each batch is judged against the snapshot it was made from, and gives a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import slug
from kgloom.operators.graph import KEY, checked, closure
from kgloom.store import written

# What a claim's check may say.
REVIEWS = ("unverified", "verified", "disputed", "refuted")


def revision(*columns: str) -> Column:
    """24 hex digits of a row's JSON with sorted keys."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), F.lit(24))


def judged_triple_edits(edits: DataFrame, triples: DataFrame, entities: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """`edits` (id, revision, deleted, to_subject, to_predicate, to_object, to_confidence; one an id, a null keeps the value) with the old row, the new one and outcome.

    Outcomes, in the order they are found: missing, stale, end, confidence, an error of the ontology, duplicate (another
    triple of the source has the new key, or an edit of a lower id takes it), done.
    """
    columns = ["id", *KEY, "confidence"]
    rows = edits.join(triples.select(*columns).withColumn("here", F.lit(True)), "id", "left")
    rows = rows.withColumn("is_now", F.when(F.col("here"), revision(*columns)))  # of edited triples alone
    for to, old in (("to_subject", "subject_id"), ("to_object", "object_id"), ("to_predicate", "predicate"), ("to_confidence", "confidence")):
        rows = rows.withColumn(to, F.when(F.col("deleted"), F.col(old)).otherwise(F.coalesce(to, old)))
    for end in ("subject", "object"):
        rows = rows.join(entities.select(F.col("id").alias(f"to_{end}"), F.col("type").alias(f"{end}_type"), F.lit(True).alias(f"{end}_here")), f"to_{end}", "left")
    c = F.col("to_confidence")
    early = F.when(F.col("is_now").isNull(), "missing").when(F.col("is_now") != F.col("revision"), "stale")
    early = early.when(~F.col("deleted") & (F.col("subject_here").isNull() | F.col("object_here").isNull()), "end").when(~F.col("deleted") & (F.isnan(c) | ~c.between(0, 1)), "confidence")
    rows = checked(rows.withColumnsRenamed({"predicate": "old_predicate", "to_predicate": "predicate"}), classes, signatures).withColumnsRenamed({"predicate": "to_predicate", "old_predicate": "predicate"})
    early = F.coalesce(early, F.when(~F.col("deleted"), F.col("error"))).alias("early")
    rows = written(rows.select(*edits.columns, *KEY, "confidence", early))
    good = rows.filter("early IS NULL AND NOT deleted").select("id", F.col("to_subject").alias("subject_id"), F.col("to_predicate").alias("predicate"), F.col("to_object").alias("object_id"), "source")
    firsts = good.groupBy(*KEY).agg(F.min("id").alias("first"))
    held = triples.join(firsts.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    clash = good.join(firsts.join(held, KEY, "left"), KEY).filter("first <> id OR least <> id OR most <> id").select("id", F.lit("duplicate").alias("clash"))
    return rows.join(clash, "id", "left").withColumn("outcome", F.coalesce("early", "clash", F.lit("done"))).drop("early", "clash")


def edited_triples(triples: DataFrame, judged: DataFrame) -> DataFrame:
    """The snapshot after the edits that are done."""
    done = judged.filter("outcome = 'done'").select("id", "deleted", "to_subject", "to_predicate", "to_object", "to_confidence")
    rows = triples.join(done, "id", "left").filter(~F.coalesce("deleted", F.lit(False)))
    new = {"subject_id": "to_subject", "predicate": "to_predicate", "object_id": "to_object", "confidence": "to_confidence"}
    return rows.withColumns({old: F.coalesce(to, old) for old, to in new.items()}).select(triples.columns)


def suppressed_keys(judged: DataFrame) -> DataFrame:
    """(triple_id, key): the old and the new key of every triple that was edited; extraction may not bring them back."""
    done = judged.filter("outcome = 'done'")
    new = done.select(F.col("id").alias("triple_id"), F.col("to_subject").alias("subject_id"), F.col("to_predicate").alias("predicate"), F.col("to_object").alias("object_id"), "source")
    return done.select(F.col("id").alias("triple_id"), *KEY).unionByName(new).distinct()


def undo_newest(triples: DataFrame, history: DataFrame) -> tuple[DataFrame, str]:
    """The snapshot with the newest change that is not undone taken back, and what came of it: none, conflict (the row is no longer as the change left it) or done.

    `history` is (change_id, id, undone, after_revision, and the columns of triples before the change as `before`); only its newest row comes to the driver.
    """
    last = history.filter("NOT undone").orderBy(F.desc("change_id")).limit(1).collect()
    if not last:
        return triples, "none"
    change, columns = last[0], ["id", *KEY, "confidence"]
    now = triples.filter(F.col("id") == change["id"]).select(revision(*columns).alias("r")).collect()
    if [r["r"] for r in now] != ([change["after_revision"]] if change["after_revision"] else []):
        return triples, "conflict"
    before = triples.sparkSession.createDataFrame([tuple(change["before"][c] for c in triples.columns)], triples.schema)
    return triples.filter(F.col("id") != change["id"]).unionByName(before), "done"


def judged_entity_edits(edits: DataFrame, entities: DataFrame, triples: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """`edits` (id, revision, name, norm, type, aliases, status; one an id) with outcome.

    Outcomes, in the order they are found: missing, stale, name (1 to 500 characters, no control characters), taken
    (another entity's canonical name), note (another entity's file name), class, aliases (over 100, or one that is no
    name), edge (a triple that would no longer hold), status (only of claims), done.
    """
    now = entities.select("id", F.col("name").alias("old_name"), F.lit(True).alias("here"), revision("id", "name", "type").alias("is_now"))
    rows = edits.join(now, "id", "left")
    wrong = lambda n: ~F.char_length(F.trim(n)).between(1, 500) | F.rlike(n, F.lit(r"[\x00-\x1f]"))
    owners = lambda key, name: entities.groupBy(key.alias(name)).agg(F.min("id").alias(f"{name}_least"), F.max("id").alias(f"{name}_most"))
    rows = rows.withColumn("note", F.lower(slug(F.col("name")))).join(owners(F.col("norm_name"), "norm"), "norm", "left").join(owners(F.lower(slug(F.col("name"))), "note"), "note", "left")
    other = lambda k: (F.col(f"{k}_least") != F.col("id")) | (F.col(f"{k}_most") != F.col("id"))
    rows = rows.join(classes.select(F.col("class").alias("type"), F.lit(True).alias("listed")), "type", "left")
    retyped = edits.select("id", F.col("type").alias("new_type"))
    typed = entities.select("id", "name", "type").join(retyped, "id", "left").select("id", "name", "type", F.coalesce("new_type", "type").alias("t"), F.col("new_type").isNotNull().alias("edited"))
    bad = []
    for mine, theirs in (("subject_id", "object_id"), ("object_id", "subject_id")):
        side = triples.select("id", *KEY).join(retyped.select(F.col("id").alias(mine)), mine, "left_semi")
        # each edit is judged against the snapshot: the other end keeps its stored type, unless it is the same entity
        new, old = typed.select(F.col("id").alias(mine), F.col("t").alias("mine")), typed.select(F.col("id").alias(theirs), F.col("type").alias("theirs"), F.col("t").alias("theirs_new"))
        ends = side.join(new, mine).join(old, theirs)
        same = F.col("subject_id") == F.col("object_id")
        bad.append(ends.select(F.col(mine).alias("id"), "predicate", (F.col("mine") if mine == "subject_id" else F.when(same, F.col("theirs_new")).otherwise(F.col("theirs"))).alias("s"), (F.col("mine") if mine == "object_id" else F.when(same, F.col("theirs_new")).otherwise(F.col("theirs"))).alias("o")))
    shapes = bad[0].union(bad[1]).distinct()
    up = closure(classes)
    holds = lambda kind, end: signatures.select("predicate", F.col(kind).alias("ancestor")).distinct().join(up, "ancestor").select("predicate", F.col("class").alias(end)).distinct()
    broken = shapes.join(shapes.join(holds("domain", "s"), ["predicate", "s"], "left_semi").join(holds("range", "o"), ["predicate", "o"], "left_semi"), ["id", "predicate", "s", "o"], "left_anti").select("id").distinct().withColumn("edge", F.lit(True))
    rows = rows.join(broken, "id", "left")
    outcome = F.when(F.col("here").isNull(), "missing").when(F.col("is_now") != F.col("revision"), "stale").when(wrong(F.col("name")), "name").when(other("norm"), "taken").when(other("note"), "note")
    outcome = outcome.when(F.col("listed").isNull(), "class").when((F.size("aliases") > 100) | F.exists("aliases", wrong), "aliases").when(F.col("edge"), "edge")
    outcome = outcome.when(F.col("status").isNotNull() & ((F.col("type") != "Claim") | ~F.col("status").isin(*REVIEWS)), "status").otherwise("done")
    return rows.withColumn("outcome", outcome).select(*edits.columns, "old_name", "outcome")


def edited_entities(entities: DataFrame, judged: DataFrame) -> DataFrame:
    """The snapshot (id, name, norm_name, type, aliases, ...) after the edits that are done; aliases are the edit's, each once."""
    done = judged.filter("outcome = 'done'").select("id", *(F.col(c).alias(f"to_{c}") for c in ("name", "norm", "type", "aliases")))
    rows = entities.join(done, "id", "left")
    return rows.withColumns({"name": F.coalesce(F.trim("to_name"), "name"), "norm_name": F.coalesce("to_norm", "norm_name"), "type": F.coalesce("to_type", "type"), "aliases": F.coalesce(F.array_distinct("to_aliases"), "aliases")}).select(entities.columns)


def kept_spellings(entities: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, spelling): the former name and aliases of each edited entity, which stay searchable."""
    done = judged.filter("outcome = 'done'").select("id")
    return entities.join(done, "id", "left_semi").select("id", F.explode(F.array_union(F.array("name"), "aliases")).alias("spelling")).distinct()


def editor_list(rows: DataFrame, text: str, limit: int = 250, **equal: str) -> DataFrame:
    """The first `limit` rows (id, label, ...), by id, whose label holds `text` in any case and whose columns have the given values."""
    out = rows.filter(F.contains(F.lower("label"), F.lit(text.lower())))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out.orderBy("id").limit(limit)


# The fields of which a history tells the changes.
TOLD = ("name", "type", "aliases", "subject_id", "predicate", "object_id", "confidence", "verificationStatus")


def history_page(history: DataFrame, entities: DataFrame, most: int = 50) -> DataFrame:
    """The newest `most` changes of `history` (change_id, kind, target_id, undone, before, after: maps of fields as texts; after is null for a removal), newest first, as people read them.

    label: the name before, or the relation's number; changes: 'field: old \u2192 new' for each field of TOLD that differs, ends
    by name; a check that is missing is unverified. can_undo: whether it is the newest change that is not undone.
    """
    newest = history.filter("NOT undone").agg(F.max("change_id").alias("c")).first()["c"]
    page = history.orderBy(F.desc("change_id")).limit(most)
    ends = page.select("change_id", F.explode(F.array(*(F.struct(F.lit(f"{side}:{c}").alias("at"), F.col(side)[c].cast("long").alias("id")) for side in ("before", "after") for c in ("subject_id", "object_id")))).alias("x")).select("change_id", "x.at", "x.id").filter("id IS NOT NULL")
    names = ends.join(entities.select("id", "name"), "id").groupBy("change_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("names"))

    def told(field: str) -> Column:
        plain = lambda side: F.col(side)[field]
        if field == "verificationStatus":
            had = F.map_contains_key("before", F.lit("type"))
            old, new = (F.when(had, F.coalesce(plain(side), F.lit("unverified"))) for side in ("before", "after"))
        else:
            old, new = plain("before"), plain("after")
        shown = lambda side, value: F.coalesce(F.try_element_at("names", F.lit(f"{side}:{field}")), value) if field.endswith("_id") else value
        return F.when(old.isNotNull() & ~old.eqNullSafe(new), F.concat(F.lit(f"{field}: "), shown("before", old), F.lit(" \u2192 "), F.coalesce(shown("after", new), F.lit(""))))

    changes = F.when(F.col("kind") == "entity_merge", F.array(F.concat(F.lit("merged into: "), F.col("after")["name"]))).when(F.col("after").isNull(), F.array(F.lit("removed"))).otherwise(F.array_compact(F.array(*map(told, TOLD))))
    label = F.coalesce(F.col("before")["name"], F.concat(F.lit("relation #"), F.col("target_id").cast("string")))
    rows = page.join(names, "change_id", "left")
    return rows.select("change_id", "kind", "target_id", "undone", F.coalesce(F.col("change_id") == F.lit(newest), F.lit(False)).alias("can_undo"), label.alias("label"), changes.alias("changes")).orderBy(F.desc("change_id"))
