"""Edge cases of search, ingest, edits and clips on small fixtures."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kgloom.operators import clips, editing, ingest, judgments, search, segments
from kgloom.plans import editing as editing_plans

CLASSES = [("Thing", None), ("Person", "Thing"), ("Work", "Thing"), ("Claim", "Work")]
ENTITY = "id long, name string, norm_name string, type string, aliases array<string>, properties map<string,string>, sources array<string>, added_time string, manual boolean"
ROW = "ord long, name string, norm string, type string, aliases array<string>, properties map<string,string>, source string, added_time string"


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_query_terms():
    assert search.query_terms("  a  b ") == ["a", "b"]
    assert search.query_terms(" A b ", "phrase", expand=True) == ["A b", "A", "b"]
    assert search.query_terms("Ab aB") == ["Ab"]
    assert search.query_terms("   ", "phrase", expand=True) == []
    assert len(search.query_terms("x" * 7, variants={"x": "yz"})) == 64
    with pytest.raises(ValueError):
        search.query_terms("a", "other")


def test_class_paths():
    assert ingest.class_paths(CLASSES)["Claim"] == "/Thing/Work/Claim/"
    with pytest.raises(ValueError):
        ingest.class_paths([("a", "b"), ("b", "a")])


def test_upsert(spark):
    none = spark.createDataFrame([], "norm string, entity_id long")
    aliases = spark.createDataFrame([("al", 1)], "norm_alias string, entity_id long")
    stored = spark.createDataFrame([(1, "One", "one", "Thing", ["z"], {"k": "0"}, ["s0"], "", False), (2, "Two", "two", "Person", ["q"], {}, ["s0"], "t", True)], ENTITY)
    rows = [(10, "AL", "al", "Person", ["b"], {"k": "1"}, "s1", "t1"), (11, "One", "one", "Work", [], {}, "s2", "t2"), (12, "Two", "two", "Work", ["n"], {"k": "9"}, "s1", "t1"), (13, "New", "new", "Claim", ["y", "x"], {"verificationStatus": "verified"}, "s1", "t1"), (14, "", "", "Thing", [], {}, "s1", ""), (15, "Odd", "odd", "Ghost", [], {}, "s1", "")]
    batch = spark.createDataFrame(rows, ROW)
    errors = {r["ord"]: r["error"] for r in ingest.judged_entities(batch, stored, none, aliases, CLASSES).collect()}
    assert errors == {10: None, 11: "conflict", 12: None, 13: None, 14: "name", 15: "class"}
    after = {r["name"]: r for r in ingest.upsert_entities(batch, stored, none, aliases, CLASSES, {"Claim": "u:c"}, "2").collect()}
    assert set(after) == {"One", "Two", "New"}
    one, two, new = after["One"], after["Two"], after["New"]
    assert (one["type"], one["aliases"], one["sources"], one["added_time"], one["properties"]["k"]) == ("Person", ["b", "z"], ["s0", "s1"], "t1", "1")
    assert (two["type"], two["aliases"], two["sources"], two["properties"]) == ("Person", ["q"], ["s0", "s1"], {})
    assert (new["id"], new["aliases"]) == (3, ["y", "x"])
    assert new["properties"] == {"text": "New", "verificationStatus": "unverified", "ontologyUri": "u:c", "ontologyVersion": "2"}
    empty = ingest.upsert_entities(batch.limit(0), stored, none, aliases, CLASSES, {"Claim": "u:c"}, "2").orderBy("id").collect()
    assert [(r["id"], r["aliases"], r["added_time"]) for r in empty] == [(1, ["z"], ""), (2, ["q"], "t")]


def test_undo(spark):
    t = spark.createDataFrame([(1, 5, "p", 6, 0.5, "s")], "id long, subject_id long, predicate string, object_id long, confidence double, source string")
    was = F.struct(*(F.lit(9.0).alias(c) if c == "confidence" else F.col(c) for c in t.columns)).alias("before")
    change = lambda after: t.select(F.lit(3).alias("change_id"), "id", F.lit(False).alias("undone"), after.alias("after_revision"), was)
    after, what = editing.undo_newest(t, change(editing.revision("id", "subject_id", "predicate", "object_id", "source", "confidence")))
    assert what == "done" and after.first()["confidence"] == 9.0
    assert editing.undo_newest(t, change(F.lit("x")))[1] == "conflict"
    assert editing.undo_newest(t, change(F.lit("x")).withColumn("undone", F.lit(True)))[1] == "none"


def test_fitted(spark):
    cues = spark.createDataFrame([(d, 10.0 * k, 10.0 * k + 10, f"c{k}") for d in ("a", "b", "n") for k in range(10)], "doc string, start double, end double, text string")
    chosen = spark.createDataFrame([("a", 1, 40.0, 50.0), ("b", 2, 10.0, 20.0), ("b", 1, 80.0, 90.0), ("n", 1, 40.0, 50.0)], "doc string, rank int, start double, end double")
    docs = spark.createDataFrame([("a", 30.0, 100.0), ("b", 40.0, 100.0), ("n", 0.0, 100.0)], "doc string, target double, duration double")
    got = [tuple(r) for r in clips.fitted(chosen, cues, docs).select("doc", "idx", "start", "end", "text").orderBy("doc", "idx").collect()]
    assert got == [("a", 0, 30.0, 60.0, "c3 c4 c5"), ("b", 0, 0.0, 20.0, "c0 c1"), ("b", 1, 70.0, 90.0, "c7 c8")]


def test_active_at_long_cue(spark):
    cues = spark.createDataFrame([("d", 0.0, 5000.0), ("d", 700.0, 800.0)], "doc string, start double, end double")
    times = spark.createDataFrame([("d", 750.0), ("d", 800.0), ("d", 5000.0), ("e", 1.0)], "doc string, t double")
    got = {(r["doc"], r["t"]): r["cue_start"] for r in segments.active_at(times, cues).collect()}
    assert got == {("d", 750.0): 700.0, ("d", 800.0): 0.0, ("d", 5000.0): None, ("e", 1.0): None}


def test_judged_updates_nulls(spark):
    schema = "key long, revision int, reviewed boolean, included boolean, stance string, note string"
    records = spark.createDataFrame([(1, "triple", 0, False, False, "unset", "")], "key long, kind string, revision int, reviewed boolean, included boolean, stance string, note string")
    rows = spark.createDataFrame([(1, None, True, True, "agree", ""), (2, 0, True, True, None, "")], schema)
    assert {r["key"]: r["outcome"] for r in judgments.judged_updates(rows, records).collect()} == {1: "stale", 2: "stance"}


def test_revisions_of_edited_triples_alone(spark):
    """All triples are compared by id and key; only an edited one's revision is made, and its ends are looked up once."""
    entities = spark.createDataFrame([(1, "a", "Person"), (2, "b", "Person")], "id long, name string, type string")
    triples = spark.createDataFrame([(7, 1, "knows", 2, "s", 0.5), (8, 2, "knows", 1, "s", 0.5)], "id long, subject_id long, predicate string, object_id long, source string, confidence double")
    now = triples.select("id", editing.revision("id", "subject_id", "predicate", "object_id", "source", "confidence").alias("r"))
    stamps = {r["id"]: r["r"] for r in now.collect()}
    rows = [(7, stamps[7], False, 2, None, 1, None), (8, stamps[8], False, None, "hates", None, None), (9, "x", False, None, None, None, None)]
    edits = spark.createDataFrame(rows, "id long, revision string, deleted boolean, to_subject long, to_predicate string, to_object long, to_confidence double")
    classes, signatures = spark.createDataFrame([("Person", None)], "class string, parent string"), spark.createDataFrame([("knows", "Person", "Person")], "predicate string, domain string, range string")
    out = editing.judged_triple_edits(edits, triples, entities, classes, signatures)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {7: "duplicate", 8: "relation", 9: "missing"}
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_searched_entities_need_no_join(spark):
    """An entity's aliases come from its own row, so that a search does not sort all entities to bring them together."""
    named, aliases = editing_plans._named(spark, "/root/testdata/sf0.001")
    assert "Join" not in named._jdf.queryExecution().optimizedPlan().toString()
    assert aliases.count() == named.filter("size(aliases) = 1").count() > 0
