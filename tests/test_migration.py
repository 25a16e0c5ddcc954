"""A change of vocabulary on a small graph: plan, refusal, publication, repetition."""

from kgloom.ontology import parse_ontology
from kgloom.operators import graph
from kgloom.operators.migration import alias_errors, entity_plan, migrate, relation_plan
from kgloom.store import Snapshots

ONTOLOGY = parse_ontology("""
version: 2
classes: {Thing: {}, Organization: {parent: Thing, uri: 'urn:org'}, DefinedTerm: {parent: Thing}, CreativeWork: {parent: Thing}, VideoObject: {parent: CreativeWork}, Book: {parent: CreativeWork}, Claim: {parent: CreativeWork}, Person: {parent: Thing}}
relations: {worksFor: {domain: Person, range: Organization}, about: {domain: CreativeWork, range: Thing}}
class_aliases: {Content: CreativeWork, Topic: DefinedTerm, Technology: DefinedTerm}
relation_aliases: {worksAt: worksFor}
""")
DECISIONS = "name string, from_type string, to_type string, reason string, properties map<string,string>"


def rows(spark):
    return spark.createDataFrame([(1, "Film", "film", "Content", ["yt:1"], {"kind": "video"}), (2, "AI", "ai", "Topic", [], {}), (3, "Ann", "ann", "Person", [], {"ontologyUri": "", "ontologyVersion": "2"}), (4, "Org", "org", "Organization", ["O"], {}), (5, "Tome", "tome", "Content", [], {"kind": "page"}), (6, "Says", "says", "Claim", [], {"text": "own"}), (7, "River", "river", "Thing", [], {})], "id bigint, name string, norm_name string, type string, aliases array<string>, properties map<string,string>")


def decisions(spark, *more):
    return spark.createDataFrame([("Tome", "Content", "Book", "it is one", {}), ("River", "Thing", "Thing", "unsure", {"reviewReason": "title only"}), ("Ann", "Robot", "Book", "stale", {}), *more], DECISIONS)


def test_entities(spark):
    got = {r["id"]: r for r in entity_plan(rows(spark), ONTOLOGY, decisions(spark)).collect()}
    assert {i: (r["before"], r["after"], r["reason"], r["changed"], r["error"]) for i, r in got.items()} == {1: ("Content", "VideoObject", "medium", True, None), 2: ("Topic", "DefinedTerm", "renamed", True, None), 3: ("Person", "Person", "kept", False, None), 4: ("Organization", "Organization", "kept", True, None), 5: ("Content", "Book", "it is one", True, None), 6: ("Claim", "Claim", "kept", True, None), 7: ("Thing", "Thing", "unsure", True, None)}
    assert got[2]["properties"] == {"ontologyUri": "", "ontologyVersion": "2", "classificationReason": "renamed", "legacyType": "Topic", "termCategory": "research_topic"}
    assert got[4]["properties"]["ontologyUri"] == "urn:org"
    assert got[6]["properties"] == {"ontologyUri": "", "ontologyVersion": "2", "text": "own", "verificationStatus": "unverified"}
    assert (got[7]["properties"]["reviewStatus"], got[7]["properties"]["reviewReason"]) == ("needs_review", "title only")


def test_migration(spark, tmp_path):
    triples = lambda *more: spark.createDataFrame([(1, 3, "worksAt", 4, "a", 0.9), (2, 1, "about", 2, "a", 0.8), *more], "id bigint, subject_id bigint, predicate string, object_id bigint, source string, confidence double")
    aliases = spark.createDataFrame([("yt:1", 1), ("o", 4)], "norm_alias string, entity_id bigint")
    none = spark.createDataFrame([], "source_id bigint, target_id bigint, former string")
    store = Snapshots(spark, f"file://{tmp_path}/kg")
    state = {"entities": rows(spark), "triples": triples((3, 3, "worksFor", 4, "a", 0.1), (4, 4, "worksAt", 3, "a", 1.0)), "aliases": aliases, "merged_entities": none}
    store.publish(state, "old")
    outcome, _, _, errors = migrate(store, ONTOLOGY, decisions(spark, ("AI", "Topic", "Gadget", "odd", {})), apply=True)
    assert (outcome, store.version()) == ("blocked", 1)
    assert sorted((r["kind"], r["id"], r["error"]) for r in errors.collect()) == [("entity", 2, "class"), ("triple", 2, "class"), ("triple", 3, "duplicate"), ("triple", 4, "domain")]
    store.publish({"triples": triples(), "aliases": aliases.union(spark.createDataFrame([("o", 2)], aliases.schema))}, "an alias of two")
    outcome, _, _, errors = migrate(store, ONTOLOGY, decisions(spark), apply=True)
    assert outcome == "blocked" and [tuple(r) for r in errors.collect()] == [("entity", 4, "alias O")]
    store.publish({"aliases": aliases}, "repaired")
    assert migrate(store, ONTOLOGY, decisions(spark))[0] == "planned" and store.version() == 3
    assert migrate(store, ONTOLOGY, decisions(spark), apply=True)[0] == "applied" and store.version() == 4
    after = store.tables()
    assert sorted((r["id"], r["predicate"], r["confidence"]) for r in after["triples"].collect()) == [(1, "worksFor", 0.9), (2, "about", 0.8)]
    assert {r["id"]: r["type"] for r in after["entities"].collect()}[1] == "VideoObject"
    assert migrate(store, ONTOLOGY, decisions(spark), apply=True)[0] == "current" and store.version() == 4


def test_relations_move_no_triple(spark):
    """Ends that are missing or null drop a triple, the rest are judged as before; few faults move only to the triples."""
    plan = spark.createDataFrame([(1, "Film", "VideoObject"), (2, "AI", "DefinedTerm"), (3, "Ann", "Person"), (4, "Org", "Organization"), (5, "Odd", "Gadget")], "id bigint, name string, after string")
    said = [(1, 3, "worksAt", 4, "a"), (2, 3, "worksFor", 4, "a"), (3, 4, "worksAt", 3, "a"), (4, 3, "worksAt", 2, "a"), (5, 3, "worksAt", 9, "a"), (6, None, "about", 2, "a"), (7, 1, "likes", 5, "a"), (8, 1, "about", 5, "a"), (9, 1, "about", 2, None), (10, 1, "about", 2, None), (11, 9, "likes", 1, "a"), (12, 1, None, 2, "a"), (13, 5, "about", 2, "b")]
    got = relation_plan(spark.createDataFrame(said, "id bigint, subject_id bigint, predicate string, object_id bigint, source string"), plan, ONTOLOGY)
    want = {1: None, 2: "duplicate", 3: "domain", 4: "range", 7: "relation", 8: "class", 9: None, 10: None, 12: "relation", 13: "class"}
    assert {r["id"]: r["error"] for r in got.collect()} == want and got.count() == len(want)
    assert {r["id"]: (r["before"], r["after"]) for r in got.collect()}[1] == ("worksAt", "worksFor")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_of_a_key_moves_few(spark):
    said = [(i, i % 40, "p", 1, None if i % 3 else "s", float(-i)) for i in range(100)] + [(5, 5, "p", 1, None, -9.0), (200, 200, "p", 1, "s", 1.0)]
    triples = spark.createDataFrame(said, "id bigint, subject_id bigint, predicate string, object_id bigint, source string, confidence double")
    want = {}
    for r in sorted(said, key=lambda r: (r[0], r[5])):
        want.setdefault(r[1:5], r)
    got = graph.first_wins(triples)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want.values(), key=repr)
    assert "LeftAnti" in got._jdf.queryExecution().executedPlan().toString()  # what is not repeated passes by the window


def test_alias_errors(spark):
    listed = [(1, "a", ["One", "b"]), (2, "b", ["ＯＮＥ", "two"]), (3, "c", ["  three  x", None, "lost"]), (4, "d", ["old"]), (5, "e", ["É"])]
    entities = spark.createDataFrame(listed, "id bigint, norm_name string, aliases array<string>")
    former = spark.createDataFrame([("old", 4), ("two", 7)], "norm string, entity_id bigint")
    aliases = spark.createDataFrame([("one", 1), ("two", 2), ("three x", 3), ("old", 9), ("é", 5), ("é", 6)], "norm_alias string, entity_id bigint")
    got = {tuple(r) for r in alias_errors(entities, former, aliases).collect()}
    assert got == {(1, "b"), (2, "ＯＮＥ"), (2, "two"), (3, None), (3, "lost"), (5, "É")}
