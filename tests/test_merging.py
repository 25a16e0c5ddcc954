"""Merges: chains, archives, the way back; ontologies from files; versions of tables."""

import pytest
from pyspark.sql import functions as F

from kgloom.operators import graph, merging
from kgloom.ontology import OntologyError, parse_ontology, read_ontology
from kgloom.store import Snapshots

TRIPLE = "struct<id:bigint,subject_id:bigint,predicate:string,object_id:bigint,confidence:double,source:string,evidence:string>"


def state_of(spark):
    """Two spellings of a company and a third, a claim each, relations that become one and one that ends on itself."""
    t = [(1, 1, "makes", 3, 0.9, "a", "first quote"), (2, 2, "makes", 3, 0.8, "a", "second quote"), (3, 1, "relatedTo", 2, 0.7, "b", "x"), (4, 3, "uses", 6, 0.6, "b", ""), (5, 6, "uses", 2, 0.5, "c", "y")]
    make = spark.createDataFrame
    return {
        "entities": make([(1, "NVIDIA", "nvidia", "Organization", ["Nvidia Corp"], {"seat": "US", "kind": "chips"}, ["a", "b"]), (2, "Ying", "ying", "Organization", ["NV"], {"seat": "USA"}, ["b", "c"]), (3, "GPU", "gpu", "Product", [], {}, ["a"]), (4, "C1", "c1", "Claim", ["said"], {"verificationStatus": "verified", "text": "C1"}, ["a"]), (5, "C2", "c2", "Claim", [], {"text": "C2"}, ["b"]), (6, "User", "user", "Person", [], {}, ["a"])], "id bigint, name string, norm_name string, type string, aliases array<string>, properties map<string,string>, sources array<string>"),
        "aliases": make([("nvidia corp", 1), ("nv", 2), ("said", 4)], "norm_alias string, entity_id bigint"),
        "triples": make(t, "id bigint, subject_id bigint, predicate string, object_id bigint, confidence double, source string, evidence string"),
        "manual_entities": make([(1, ["Old NVIDIA"]), (6, ["U"])], "entity_id bigint, original_names array<string>"),
        "manual_triples": make([(5, t[4], False)], f"triple_id bigint, original {TRIPLE}, deleted boolean"),
        "manual_triple_keys": make([(9, 1, "develops", 3, "z"), (5, 6, "uses", 2, "c")], "triple_id bigint, subject_id bigint, predicate string, object_id bigint, source string"),
        "triple_evidence": make([(1, 77, t[3]), (4, 78, t[3])], f"triple_id bigint, original_id bigint, original {TRIPLE}"),
        "merged_entities": make([(8, 1, "once nvidia")], "source_id bigint, target_id bigint, former string"),
        "memory_redirects": make([("k0", "entity", 1), ("k1", "triple", 1)], "key string, target_kind string, target_id bigint"),
    }


def merges_of(spark, *pairs):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "source_id bigint, target_id bigint, ord bigint")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merge_keeps_all(spark):
    personal = spark.createDataFrame([("p1", "entity", 1), ("p2", "triple", 1), ("p3", "triple", 4), ("p4", "claim", 4)], "key string, kind string, target_id bigint")
    state = state_of(spark)
    changes = merging.merge_changes(state, merges_of(spark, (1, 2), (5, 4)), personal)
    after = merging.merged_tables(state, changes)
    entities = {r["id"]: r for r in after["entities"].collect()}
    assert sorted(entities) == [2, 3, 4, 6]
    assert (entities[2]["name"], entities[2]["aliases"], entities[2]["sources"]) == ("Ying", ["NV", "NVIDIA", "Nvidia Corp"], ["b", "c", "a"])
    assert entities[2]["properties"] == {"seat": "USA", "kind": "chips"}
    assert entities[4]["properties"] == {"verificationStatus": "disputed", "text": "C1"}
    assert rows(after["aliases"], "norm_alias", "entity_id") == sorted([("c1", 4), ("c2", 4), ("said", 4), ("nv", 2), ("nvidia", 2), ("nvidia corp", 2), ("old nvidia", 2), ("ying", 2)], key=repr)
    # Relation 2 had no merged end, so it stays for 1; 3 is a relation to itself and is kept for people to see.
    assert rows(after["triples"], "id", "subject_id", "object_id", "confidence") == [(2, 2, 3, 0.8), (3, 2, 2, 0.7), (4, 3, 6, 0.6), (5, 6, 2, 0.5)]
    assert rows(after["triple_evidence"], "triple_id", "original_id") == [(2, 1), (2, 2), (2, 77), (3, 3), (4, 78), (5, 5)]
    quotes = {r["original_id"]: r["original"]["evidence"] for r in after["triple_evidence"].collect()}
    assert (quotes[1], quotes[2]) == ("first quote", "second quote")
    keys = rows(after["manual_triple_keys"], "triple_id", "subject_id", "predicate", "object_id", "source")
    assert {(9, 1, "develops", 3, "z"), (9, 2, "develops", 3, "z"), (2, 1, "makes", 3, "a"), (2, 2, "makes", 3, "a"), (5, 6, "uses", 2, "c")} <= set(keys)
    assert rows(after["manual_triples"], "triple_id") == [(2,), (3,), (5,)]
    assert rows(after["manual_entities"], "entity_id", "original_names") == sorted([(2, ["NVIDIA", "Ying", "Nvidia Corp", "NV", "Old NVIDIA"]), (4, ["C2", "C1", "said"]), (6, ["U"])], key=repr)
    assert rows(after["merged_entities"], "source_id", "target_id", "former") == [(1, 2, "nvidia"), (5, 4, "c2"), (8, 2, "once nvidia")]
    assert rows(after["memory_redirects"], "key", "target_kind", "target_id") == [("k0", "entity", 2), ("k1", "triple", 2), ("p1", "entity", 2), ("p2", "triple", 2), ("p4", "claim", 4)]


def test_merge_and_back(spark):
    state, none = state_of(spark), spark.createDataFrame([], "key string, kind string, target_id bigint")
    changes = merging.merge_changes(state, merges_of(spark, (1, 2), (5, 4)), none)
    after = merging.merged_tables(state, changes)
    left = merging.fingerprint(after)
    restored, outcome = merging.restored_tables(after, changes, left)
    assert outcome == "done"
    for name, df in state.items():
        image = lambda x: sorted(r["i"] for r in x.select(merging.row_image(x).alias("i")).collect())
        assert image(restored[name]) == image(df), name
    changed = after | {"triples": after["triples"].withColumn("confidence", F.when(F.col("id") == 4, 0.61).otherwise(F.col("confidence")))}
    same, outcome = merging.restored_tables(changed, changes, left)
    assert outcome == "conflict" and same is changed


def test_chains(spark):
    links = lambda *pairs: spark.createDataFrame(list(pairs), "source_id bigint, target_id bigint")
    assert rows(merging.flat_redirects(links(*((k, k - 1) for k in range(1, 12)))), "source_id", "target_id") == sorted([(k, 0) for k in range(1, 12)], key=repr)
    assert merging.flat_redirects(links()).count() == 0
    for bad in (links((1, 2), (2, 3), (3, 1), (5, 6)), links((1, 1)), links((1, 2), (1, 3)), links((1, 2), (2, 1))):
        with pytest.raises(ValueError):
            merging.flat_redirects(bad)


GOOD = """
version: 3
classes:
  Thing:
  Person: {parent: Thing, uri: 'urn:p'}
  Organization: {parent: Thing, description: A firm}
relations:
  worksFor: {domain: Person, range: [Organization, Person], symmetric: false}
  knows: {domain: [Person], range: Person, symmetric: true, description: Met them}
class_aliases: {Company: Organization}
relation_aliases: {worksAt: worksFor}
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.yaml").write_text(GOOD)
    onto = read_ontology(spark, f"file://{tmp_path}/o.yaml")
    assert onto == parse_ontology(GOOD)
    assert (onto.version, onto.parents, onto.uris) == ("3", {"Thing": None, "Person": "Thing", "Organization": "Thing"}, {"Person": "urn:p"})
    assert rows(onto.signatures(spark), "predicate", "domain", "range") == [("knows", "Person", "Person"), ("worksFor", "Person", "Organization"), ("worksFor", "Person", "Person")]
    names = spark.createDataFrame([("Company", "worksAt"), ("Person", "knows"), (None, "odd")], "c string, r string")
    assert rows(names, onto.canonical_class(F.col("c")), onto.canonical_relation(F.col("r"))) == sorted([("Organization", "worksFor"), ("Person", "knows"), (None, "odd")], key=repr)
    assert "knows: Person -> Person (symmetric). Met them" in onto.prompt()
    assert parse_ontology("").parents == {}


@pytest.mark.parametrize(
    ("old", "new", "fault"),
    [
        ("Person: {parent: Thing", "Person: {parent: Nobody", "class Person: unknown parent Nobody"),
        ("  Thing:\n", "  Thing: {parent: Person}\n", "class Thing: its parents form a cycle"),
        ("domain: Person, range", "domain: Robot, range", "relation worksFor: unknown domain Robot"),
        ("range: Person, sym", "range: [Person, Robot], sym", "relation knows: unknown range Robot"),
        ("domain: [Person]", "domain: []", "relation knows: no domain"),
        ("Company: Organization", "Person: Organization", "class alias Person: it is a class"),
        ("Company: Organization", "Company: Company", "class alias Company: unknown class Company"),
        ("worksAt: worksFor", "worksAt: gone", "relation alias worksAt: unknown relation gone"),
        ("worksAt: worksFor", "knows: knows", "relation alias knows: it is a relation"),
    ],
)
def test_faults_of_ontologies(old, new, fault):
    assert old in GOOD
    with pytest.raises(OntologyError, match=fault):
        parse_ontology(GOOD.replace(old, new))


def test_class_trees(spark):
    tree = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B")], "class string, parent string")
    assert rows(graph.closure(tree), "class", "ancestor") == [("A", "A"), ("B", "A"), ("B", "B"), ("C", "A"), ("C", "B"), ("C", "C")]
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(spark.createDataFrame([("A", "B"), ("B", "A")], "class string, parent string"))


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/kg")
    assert (store.version(), store.tables()) == (0, {})
    one = spark.range(3)
    assert store.publish({"a": one, "b": one}, "first") == 1
    assert store.publish({"a": store.tables()["a"].filter("id > 0"), "b": one}, "second") == 2
    assert store.version() == 2
    assert {n: df.count() for n, df in store.tables().items()} == {"a": 2, "b": 3}

    def fails(x):
        raise RuntimeError

    with pytest.raises(Exception):  # noqa: B017
        store.publish({"a": one, "b": one.select(F.udf(fails, "int")("id").alias("x"))}, "dies while it writes")
    assert store.version() == 2 and store.tables()["a"].count() == 2


def test_what_was_archived_before_stays(spark):
    """Relation 1 is in the archive already, once of its own and once of another: each pair of ids is there once, as it was first."""
    state, none = state_of(spark), spark.createDataFrame([], "key string, kind string, target_id bigint")
    first = spark.createDataFrame([(2, 1, (1, 1, "makes", 3, 0.1, "a", "older")), (1, 1, (1, 1, "makes", 3, 0.2, "a", "newer"))], state["triple_evidence"].schema)
    changes = merging.merge_changes(state | {"triple_evidence": first}, merges_of(spark, (1, 2)), none)
    new = {(r["triple_id"], r["original_id"]): r["original"]["evidence"] for r in changes["triple_evidence"][1].collect()}
    assert new == {(2, 1): "older", (2, 2): "second quote", (3, 3): "x", (5, 5): "y"}
    assert changes["triple_evidence"][1].count() == 4
    # A relation is archived from its own row: no relation is looked up by its id again.
    plan = changes["manual_triple_keys"][1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("original_id") == 0
