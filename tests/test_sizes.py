"""Steps that were rewritten for large tables, against their plain forms."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kgloom.operators import documents, graph, judgments
from kgloom.plans import testgraph

NAMES = "id bigint, name string, type string"
EDGES = "id bigint, subject_id bigint, predicate string, object_id bigint, source string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names_of_hubs(spark):
    triples = spark.createDataFrame([(i, 1 + i % 5, "p", 9 if i % 3 else 1 + i % 7, "s") for i in range(60)] + [(98, None, "p", 9, "s"), (99, 9, "p", 9, None)], EDGES)
    entities = spark.createDataFrame([(i, f"n{i}", "T") for i in (1, 2, 3, 4, 9)], NAMES)
    hubs = graph.hubs(triples, 12)
    assert {r["id"] for r in hubs.collect()} == {1, 2, 3, 4, 5, 9}
    plain = graph.with_names(triples, entities)
    for few in (hubs, hubs.filter("id = 9"), hubs.limit(0)):
        named = graph.with_names(triples, entities, few)
        assert rows(named.select(plain.columns)) == rows(plain) and named.count() > 40


def test_walk_in_arrays_and_rows(spark):
    docs = spark.createDataFrame([("a", "Ann met Bob。Bob said Cee！Dee alone\nnobody"), ("b", "Ann and Ann"), ("c", None)], "doc string, summary string")
    scope = spark.createDataFrame([("a", 1, "Ann", "P"), ("a", 2, "Bob", "P"), ("a", 3, "Cee", "Claim"), ("a", 4, "Dee", "P"), ("a", 1, "Ann", "P"), ("b", 1, "Ann", "P")], f"doc string, {NAMES}")
    edges = spark.createDataFrame([("a", 10 + i, s, p, o) for i, (s, p, o) in enumerate([(1, "knows", 2), (2, "makesClaim", 3), (2, "knows", 4), (4, "likes", 4), (7, "knows", 1), (1, "knows", 4), (2, "knows", 7), (1, "likes", 4)])] + [("a", 10, 1, "knows", 2)], "doc string, id bigint, subject_id bigint, predicate string, object_id bigint")
    arrays, mixed, large = (documents.summary_walk(docs, scope, edges, most=3, small=n) for n in (1000, 5, 0))
    assert rows(arrays) == rows(mixed) == rows(large)
    got = {(r["doc"], r["step"]): (r["direct"], r["neighbours"], r["edge_ids"]) for r in arrays.collect()}
    assert got == {("a", 0): (["Ann", "Bob"], ["Dee"], [10, 12, 14]), ("a", 1): (["Bob"], ["Ann", "Dee"], [10, 12, 16]), ("a", 2): (["Dee"], ["Bob", "Ann"], [13, 12, 15]), ("a", 3): ([], [], []), ("b", 0): (["Ann"], [], [])}


def test_walk_moves_nothing(spark):
    docs = spark.createDataFrame([], "doc string, summary string, scope array<struct<id:bigint,name:string,type:string>>, edges array<struct<id:bigint,subject_id:bigint,predicate:string,object_id:bigint>>")
    assert "Exchange" not in documents.walked(docs)._jdf.queryExecution().executedPlan().toString()


def test_targets_from_what_is_said(spark):
    said = [("a", "b", "c", "s"), ("a", "b", "c", "s"), ("a", "b", "c", None), ("", "b", "c", "s"), (None, "b", "\U0001f600 é", "s"), ("x y", "b", "", "")]
    got = judgments.triple_targets(spark.createDataFrame(said, "subject string, predicate string, object string, source string"))
    key = lambda r: hashlib.sha256("\x1f".join(["triple", *(v or "" for v in r)]).encode()).hexdigest()
    title = lambda r: " ".join(v for v in r[:3] if v is not None)
    assert rows(got) == sorted({(key(r), "triple", title(r), r[3] or "") for r in said}, key=repr)
    # The key is made of what moved, so that no hash is shuffled.
    exchanges = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not any("key#" in line for line in exchanges)
    assert got.agg(F.max(F.length("key"))).first()[0] == 64


def test_hot_pieces_do_not_meet(spark):
    """Pieces of many names find the same mentions as before, and only rarer ones move with their names."""
    entities = spark.createDataFrame([(i, f"Order#{i}") for i in range(50)] + [(100, "Order"), (101, "order red"), (102, "red"), (103, "Red Order"), (104, "Éa"), (105, "#")], "id bigint, name string")
    docs = spark.createDataFrame([(1, "order#7 and ORDER RED"), (2, "reds, order#77 #"), (3, "éa red order"), (4, None)], "doc_id bigint, text string")
    want = [(1, 7), (1, 100), (1, 101), (1, 102), (2, 100), (2, 105), (3, 100), (3, 102), (3, 103), (3, 104)]
    for least in (1, 3, 1000):
        assert sorted(tuple(r) for r in documents.mentions(docs, entities, least).collect()) == want
    # The counts of hot pieces are written, and joined by broadcast.
    plan = documents.mentions(docs, entities, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_ids_beyond_64_bits(spark):
    """Ids are the keys side by side while these fit, and follow the keys in any case."""
    number = lambda o, n, p, s: ((o * 10 + n) * 1_000_000 + p) * 100_000 + s
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    ids = lambda keys: {tuple(r)[:4]: r["makes_id"] for r in testgraph.with_makes_id(spark.createDataFrame(keys, schema)).collect()}
    fit = [(1, 1, 5, 7), (9_223_371, 7, 999_999, 99_999), (9_223_372, 0, 368_547, 75_807)]
    assert ids(fit) == {k: number(*k) for k in fit} and number(*fit[-1]) == 2**63 - 1
    far = [(9_223_372, 0, 368_547, 75_808), (9_223_372, 1, 3, 4), (9_223_372, 1, 3, 5), (54_000_000, 2, 7_200_000, 359_999), (54_000_000, 2, 7_200_000, 360_000), (54_000_000, 7, 1, 1)]
    got = ids([*far, *fit, far[2]])
    assert list(map(got.get, sorted(got))) == sorted(set(got.values())) and len(got) == 9 and max(got.values()) < 2**63
    assert all(got[k] == number(*k) for k in fit[:2])
    assert ids([]) == {}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with keys as those of 360 times sf0.1, and some as they are."""
    folder, base = tmp_path_factory.mktemp("far"), "/root/testdata/sf0.001"
    for f in os.listdir(base):
        os.symlink(f"{base}/{f}", folder / f) if f[:-8] not in ("orders", "lineitem") else None
    con = duckdb.connect()
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {key} % 3 = 0 THEN {key} ELSE {key} + 54000000 END AS {key}) FROM '{base}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    # The same SQL, with keys wide enough for its ids.
    for f in os.listdir(folder):
        wide = "* REPLACE (l_orderkey::HUGEINT AS l_orderkey)" if f == "lineitem.parquet" else "*"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT {wide} FROM '{folder}/{f}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["content_notes", "kg_ingest", "memory_baselines", "reading_steps", "rules_fire"])
def test_queries_of_far_keys(spark, far, name):
    folder, con = far
    got = __spark_entry__.queries()[name](spark, folder)
    columns = [c for c in got.columns if c != "ord"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert plain(got.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("name", ["memory_all_targets", "merge_archive", "merge_undo", "notes_refreshed"])
def test_far_keys_run(spark, far, name):
    assert __spark_entry__.queries()[name](spark, far[0]).count() > 0
