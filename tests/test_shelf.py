"""Requests, lists, histories, document states and cuts on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kgloom.functions import requests
from kgloom.functions.language import stamp
from kgloom.operators import judgments, shelf

RECORD = "key string, place int, title string, note string, kind string, reviewed boolean, included boolean"


def test_requests(spark):
    texts = [None, "", " 7 ", "+7", "-7", "1_0", "1__0", "7.0", "x", "0", "200", "201", "9" * 60, "　5\t"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", requests.bounded(F.col("t"), *requests.TOP).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [20, None, 7, 7, None, 10, None, None, None, None, 200, None, None, 5]
    flags = [None, "", "1", " YES", "On", "true", "0", "No", "oFF", "false ", "2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(flags)], "i int, t string").select("i", requests.flag(F.col("t"), True).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [True, None, True, True, True, True, False, False, False, False, None]
    asked = spark.createDataFrame([(1, None, None, None, None), (2, "x", "x", "x", "x"), (3, " PHRASE", "x", "x", None), (4, "terms", "0", "0", None), (5, "terms", "0", "9", "501")], "id int, mode string, expand string, top string, limit string")
    got = requests.judged_requests(asked).orderBy("id").collect()
    assert [r["fault"] for r in got] == [None, "mode", "expand", "top", "limit"]
    assert (got[0]["mode"], got[0]["expand"], got[0]["top"], got[0]["limit"], got[2]["mode"]) == ("terms", True, 20, 50, "phrase")
    assert requests.judged_requests(asked.limit(0)).count() == 0


def test_cache_key(spark):
    odd = "".join(map(chr, range(33))) + '"\\/\x7f é 汉 😀 \\n \\u000b'
    docs = [("a", odd, odd, [odd, "b"], odd), ("a", None, None, None, None), ("", "", "", [], "")]
    got = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i int, id string, url string, summary string, key_points array<string>, source_sha256 string").select("i", requests.cache_key(4, F.lit("video")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [hashlib.sha256(json.dumps([4, "video", *d], ensure_ascii=False).encode()).hexdigest() for d in docs]


def test_lists(spark):
    held = [("a", 2, "Red fox", None, "claim", True, True), ("b", 1, "x", "a RED hen", "entity", False, True), ("c", 3, None, "red", "claim", False, False), ("d", 0, "blue", "n", "triple", None, None)]
    records = spark.createDataFrame(held, RECORD)
    keys = lambda *a, **k: [r["key"] for r in shelf.listed_records(records, *a, **k).collect()]
    assert keys(" Red ") == ["b", "a", "c"]
    assert keys() == ["d", "b", "a", "c"] and keys(most=2) == ["d", "b"]
    assert keys("red", "claim") == ["a", "c"] and keys("red", "claim", "unreviewed") == ["c"]
    assert keys(scope="included") == ["b", "a"] and keys(scope="reviewed") == ["a"]
    assert keys("x a") == ["b"] and keys("fox n") == []
    with pytest.raises(ValueError):
        shelf.listed_records(records, scope="odd")
    history = spark.createDataFrame([(1, "a"), (2, "c"), (3, "gone"), (4, "a")], "id int, memory_key string")
    ids = lambda *a: sorted(r["id"] for r in shelf.matching_history(history, records, *a).collect())
    assert (ids(), ids("FOX"), ids("", "claim"), ids("x")) == ([1, 2, 3, 4], [1, 4], [1, 2, 4], [1, 4])


def test_judgments_of_rows(spark):
    shown = spark.createDataFrame([("claim", 1), ("entity", 2), ("triple", 1), ("entity", 9)], "kind string, id long")
    kept = [("z", "claim", True, 1, None, True, True), ("y", "claim", True, 1, None, False, True), ("m", "entity", True, 7, 2, True, None), ("old", "triple", False, 1, None, True, True)]
    records = spark.createDataFrame(kept, "key string, kind string, current boolean, target_id long, current_target_id long, reviewed boolean, included boolean")
    got = {(r["kind"], r["id"]): (r["key"], r["reviewed"], r["included"]) for r in shelf.with_judgment(shown, records).collect()}
    assert got == {("claim", 1): ("y", False, True), ("entity", 2): ("m", True, False), ("triple", 1): (None, False, False), ("entity", 9): (None, False, False)}


def test_history_of_updates(spark):
    fields = "reviewed boolean, included boolean, stance string, note string"
    records = spark.createDataFrame([("a", "claim", 3, False, True, "unset", "n"), ("b", "entity", 0, False, False, "unset", "")], f"key string, kind string, revision int, {fields}")
    updates = spark.createDataFrame([("a", 3, True, True, "agree", "m", "d"), ("b", 0, True, False, "unset", "", "lost")], f"key string, revision int, {fields}, source_id string")
    judged = shelf.known_sources(judgments.judged_updates(updates, records), spark.createDataFrame([("d",)], "id string"))
    assert {r["key"]: r["outcome"] for r in judged.collect()} == {"a": "changed", "b": "source"}
    (row,) = shelf.memory_history(judged, F.lit("now")).collect()
    assert (row["memory_key"], row["source_id"], row["created_at"]) == ("a", "d", "now")
    assert tuple(row["before_state"]) == (False, True, "unset", "n", 3) and tuple(row["after_state"]) == (True, True, "agree", "m", 4)


def test_document_status(spark):
    text = spark.createDataFrame([("v", "x" * 150_001), ("n", ""), ("s", "new"), ("u", "t")], "id string, text string")
    made = text.withColumn("stamped", stamp(F.when(F.col("id") == "s", "old").otherwise(F.col("text")), 2)).select("id", "stamped")
    rest = spark.createDataFrame([("v", "V", "youtube", "sum", "s"), ("n", "", "web", "", "s"), ("s", "S", "web", None, "s"), ("u", "U", "web", "su", None), ("w", "W", "web", "q", None)], "id string, title string, source string, summary string, snapshot string")
    notes = spark.createDataFrame([("v", "# V sum"), ("u", "none")], "id string, note string")
    got = {r["id"]: r for r in shelf.document_status(rest.join(made, "id", "left"), text, notes, spark.createDataFrame([("v",), ("v",), (None,)], "source string"), 2).collect()}
    v = got["v"]
    assert (v["analysis_current"], v["source_characters"], v["analyzed_characters"], v["transcript_truncated"], len(v["source_transcript"])) == (True, 150_001, 150_000, True, 150_000)
    assert (v["note_matches_summary"], v["source_relations"], v["reanalyze"], v["sync"]) == (True, 2, "fetch", "ready")
    assert [(got[k]["sync"], got[k]["reanalyze"], got[k]["analyzed_characters"], got[k]["note_matches_summary"]) for k in "nsuw"] == [("stale", None, 0, False), ("stale", "text", 3, False), ("snapshot", "text", 1, False), ("stale", None, None, False)]


def test_targets_and_partitions(spark):
    contents = spark.createDataFrame([("yt:" + "a" * 11, "processed"), ("d", "new"), ("d", "processed")], "id string, status string")
    asked = ["see https://youtu.be/" + "a" * 11, " d ", "", None, "y" * 2001, "https://youtu.be/" + "b" * 11]
    got = shelf.resolved_targets(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, target string"), contents, "d").orderBy("i").collect()
    assert [(r["id"], r["fault"]) for r in got] == [("yt:" + "a" * 11, None), ("d", None), ("d", None), (None, "invalid"), (None, "invalid"), (None, "missing")]
    stored = shelf.processed(shelf.by_status(contents))
    assert sorted(r["id"] for r in stored.collect()) == ["d", "yt:" + "a" * 11]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_cuts(spark):
    slides = [("d", 0, 1.0, 3.5, "", None), ("d", 1, 5.0, 6.0, 'a "b", c', 10.0), ("d", 2, 7.0, 9.0, None, None), ("e", 0, 1.0, 1.0, "x", None), ("f", 0, float("nan"), 2.0, "x", None), ("g", 0, None, 2.0, "x", None)]
    rows_ = spark.createDataFrame(slides, "doc string, idx int, start double, end double, title string, timeline_start double")
    got = {r["doc"]: (r["plan"], r["fault"]) for r in shelf.clip_plan(rows_).collect()}
    assert got["d"] == ('start,end,title\r\n1.000,3.500,片段 1\r\n5.000,6.000,"a ""b"", c"\r\n7.000,9.000,片段 3\r\n', None)
    assert [got[k] for k in "efg"] == [(None, "times")] * 3
    captions = spark.createDataFrame([("d", i, 0.5, 1.0, f"c{i}") for i in range(3)], "doc string, idx int, start double, end double, text string")
    cues = shelf.slide_cues(rows_.filter("doc = 'd'"), captions).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in cues] == [(0.5, 1.0, "c0"), (10.5, 11.0, "c1"), (11.5, 12.0, "c2")]
    logs = ["a Duration: 01:02:03.5, b", "Duration:  0:0:7", "Duration: 0:0:0", "Duration: N/A", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(logs)], "i int, t string").select("i", shelf.probed_duration(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [3723.5, 7.0, None, None, None, None]
