"""The reading library, manifests, evidence, histories and notes on small fixtures."""

from pyspark.sql import functions as F

from kgloom.operators import documents, editing, judgments, manifests
from kgloom.sinks import projections

CAPTION = "struct<start:double,end:double,text:string,summary_index:int>"
MANIFEST = f"id int, version int, subtitle_language string, status string, mode string, backend string, duration double, summary_steps array<string>, slides array<struct<start:double,end:double,text:string,captions:array<{CAPTION}>>>"


def test_manifests(spark):
    good, nan = [(0.0, 5.0, "a", [(0.0, 5.004, "x", 1), (1.0, 2.0, "y", None)]), (5.0, 9.0, "b", [(0.0, 1.0, "z", 0)])], float("nan")
    slide = lambda *captions, start=0.0, end=5.0, text="a": [(start, end, text, list(captions))]
    base = {"version": 1, "subtitle_language": "zh", "status": "ready", "mode": "video", "backend": "h", "duration": 9.0, "summary_steps": ["p", "q"], "slides": good}
    cases = [
        ({}, None, None, "ready"),
        ({"version": None}, ("version", None, None), None, "to be aligned"),
        ({"subtitle_language": "en"}, ("language", None, None), None, "to be aligned"),
        ({"summary_steps": None}, ("steps", None, None), None, "to be aligned"),
        ({"summary_steps": ["p", None]}, ("steps", None, None), None, "to be aligned"),
        ({"slides": None}, ("slides", None, None), ("slides", None), "to be made"),
        ({"slides": []}, ("slides", None, None), ("slides", None), "to be made"),
        ({"slides": [good[0], None]}, ("times", 1, None), ("times", 1), "to be made"),
        ({"slides": slide((0.0, 1.0, "x", None), end=nan)}, ("times", 0, None), ("times", 0), "to be made"),
        ({"slides": slide((0.0, 1.0, "x", None), start=-1.0)}, ("times", 0, None), ("times", 0), "to be made"),
        ({"slides": slide()}, ("captions", 0, None), None, "to be aligned"),
        ({"slides": [(0.0, 5.0, "a", None)]}, ("captions", 0, None), None, "to be aligned"),
        ({"slides": slide((0.0, 1.0, "x", None), text="　")}, ("text", 0, None), None, "to be made"),
        ({"slides": slide((0.0, 1.0, "x", None), (0.0, 1.0, None, 0))}, ("caption text", 0, 1), None, "to be aligned"),
        ({"slides": slide((0.0, 5.1, "x", None))}, ("caption times", 0, 0), None, "to be aligned"),
        ({"slides": slide((0.0, None, "x", None))}, ("caption times", 0, 0), None, "to be aligned"),
        ({"slides": [good[1], *slide((0.0, 1.0, "x", 2))]}, ("caption index", 1, 0), None, "to be aligned"),
        ({"slides": slide((0.0, 1.0, "x", -1))}, ("caption index", 0, 0), None, "to be aligned"),
        ({"slides": [good[0], good[0]]}, None, None, "to be made"),
        ({"slides": slide((0.0, 0.5, "x", None), end=1.0, text="w" * 501)}, None, None, "to be made"),
        ({"status": "failed"}, None, ("status", None), "to be made"),
        ({"mode": "audio"}, None, ("mode", None), "ready"),
        ({"duration": nan}, None, ("duration", None), "ready"),
        ({"duration": 0.0}, None, ("duration", None), "ready"),
        ({"backend": None}, None, None, "to be aligned"),
    ]
    rows = spark.createDataFrame([(i, *(base | c[0]).values()) for i, c in enumerate(cases)], MANIFEST)
    got = {r["id"]: r for r in manifests.checked(rows, "video", "h").collect()}
    for i, (_, alignment, playable, cached) in enumerate(cases):
        assert (got[i]["alignment"] and tuple(got[i]["alignment"])) == alignment, cases[i]
        assert (got[i]["playable"] and tuple(got[i]["playable"])[:2]) == playable, cases[i]
        assert got[i]["cached"] == cached, cases[i]


def test_step_places(spark):
    stored = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "c"), ("d", 3, "c"), ("d", 4, None), ("e", 0, "a")], "doc string, step int, text string")
    shown = spark.createDataFrame([("d", 0, "a"), ("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("d", 5, "c")], "doc string, place int, text string")
    got = {(r["doc"], r["step"]): r["place"] for r in manifests.step_places(stored, shown).collect()}
    # c stands twice, so only the step that has it at its own place finds it.
    assert got == {("d", 0): 0, ("d", 1): 2, ("d", 2): None, ("d", 3): 3, ("d", 4): None, ("e", 0): None}


def test_targets(spark):
    entities = spark.createDataFrame([(1, 'A "q"', "Person", ["s"]), (2, "Says", "Claim", ["s", "t"]), (3, "Alone", "Thing", [])], "id bigint, name string, type string, sources array<string>")
    triples = spark.createDataFrame([(9, 1, "p", 2, "t", "late"), (4, 1, "p", 2, "s", "first"), (5, 2, "p", 2, "s", "first"), (6, 1, "r", 3, "", ""), (7, 2, "p", 1, "t", None)], "id bigint, subject_id bigint, predicate string, object_id bigint, source string, evidence string")
    got = {(r["kind"], r["target_id"]): r for r in judgments.targets(entities, triples).collect()}
    import hashlib

    key = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got["entity", 1]["key"] == key(r'["entity", 1, "A \"q\"", "Person"]')
    assert got["triple", 6]["key"] == key(r'["triple", 1, "A \"q\"", "r", 3, "Alone", "", ""]')
    assert [tuple(e) for e in got["claim", 2]["evidence"]] == [("s", "first"), ("t", "late")]
    assert got["entity", 3]["evidence"] == [] and got["triple", 6]["sources"] == []
    assert got["triple", 7]["title"] == 'Says → p → A "q"' and len(got) == 8
    of = {(r["kind"], r["target_id"]): [tuple(e) for e in r["evidence"]] for r in judgments.assertions_of(judgments.targets(entities, triples), "t").collect()}
    assert of == {("claim", 2): [("t", "late")], ("triple", 9): [("t", "late")], ("triple", 7): [("t", "")]}


def test_library(spark):
    contents = spark.createDataFrame([("d", "u:d", "Open AI开发软件。Other也出现了。没有实体的句子。", ["k"], 2), ("e", "", " ", [" ", "see model", "C++ and Open AI."], 0), ("f", "", None, [], 0)], "id string, url string, summary string, key_points array<string>, rejections int")
    entities = spark.createDataFrame([(1, "OpenAI", "Organization", ["Open AI"], {}, ["d", "e"]), (2, "Model", "Thing", [], {}, []), (3, "Other", "Thing", [], {}, ["d"]), (4, "Doc", "Article", ["d"], {}, ["d"]), (5, "Said", "Claim", ["Other"], {}, ["d"]), (6, "Link", "Article", [], {"url": "u:d"}, ["d"]), (7, "C++", "Thing", [], {}, ["e"])], "id bigint, name string, type string, aliases array<string>, properties map<string,string>, sources array<string>")
    aliases = spark.createDataFrame([("open ai", 1), ("model", 2)], "norm_alias string, entity_id bigint")
    triples = spark.createDataFrame([(1, 1, "makes", 2, "d"), (2, 4, "about", 1, "d"), (3, 1, "makes", 2, "e"), (4, 1, "makes", 3, "x"), (5, 6, "about", 3, "d")], "id bigint, subject_id bigint, predicate string, object_id bigint, source string")
    counts, steps = documents.library(contents, entities, aliases, triples)
    assert sorted(tuple(r) for r in counts.collect()) == [("d", 3, 1, 2), ("e", 3, 1, 0), ("f", 0, 0, 0)]
    assert sorted((tuple(r) for r in steps.collect()), key=repr) == [("d", 0, "Open AI开发软件。", "OpenAI"), ("d", 1, "Other也出现了。", "Other"), ("d", 2, "没有实体的句子。", None), ("e", 0, "see model", "Model"), ("e", 1, "C++ and Open AI.", "C++"), ("e", 1, "C++ and Open AI.", "OpenAI")]
    assert documents.library(contents.limit(0), entities, aliases, triples)[1].count() == 0


def test_history(spark):
    entities = spark.createDataFrame([(1, "One"), (2, "Two")], "id bigint, name string")
    rows = [
        (1, "entity", 1, False, {"name": "A", "type": "T", "aliases": "x"}, {"name": "A", "type": "T", "aliases": "y", "verificationStatus": "disputed"}),
        (2, "triple", 8, False, {"subject_id": "1", "object_id": "9", "predicate": "p"}, {"subject_id": "2", "object_id": "8", "predicate": "p"}),
        (3, "triple", 9, False, {"subject_id": "1", "predicate": "p"}, None),
        (4, "entity_merge", 2, True, {"name": "B"}, {"name": "A"}),
    ]
    history = spark.createDataFrame(rows, "change_id bigint, kind string, target_id bigint, undone boolean, before map<string,string>, after map<string,string>")
    got = [(r["change_id"], r["can_undo"], r["label"], r["changes"]) for r in editing.history_page(history, entities).collect()]
    assert got == [(4, False, "B", ["merged into: A"]), (3, True, "relation #9", ["removed"]), (2, False, "relation #8", ["subject_id: One → Two", "object_id: 9 → 8"]), (1, False, "A", ["aliases: x → y", "verificationStatus: unverified → disputed"])]
    assert len(editing.history_page(history, entities, 2).collect()) == 2
    assert editing.history_page(history.filter("undone"), entities).first()["can_undo"] is False


def test_notes(spark):
    notes = spark.createDataFrame([(0, f"t\n{projections.SECTION}\nold\n## Mine\nkept"), (1, "plain \n"), (2, f"{projections.SECTION}\n- [[old]]"), (3, None)], "id int, note string")
    of = lambda lines, names=(): {r["id"]: r["n"] for r in notes.select("id", projections.spliced(F.col("note"), lines, names).alias("n")).collect()}
    section = projections.SECTION
    assert of(F.lit("- x")) == {0: f"t\n{section}\n- x\n\n## Mine\nkept", 1: f"plain\n\n{section}\n- x\n", 2: f"{section}\n- x\n", 3: None}
    assert of(F.lit(None).cast("string"), [("old", "new")]) == {0: f"t\n{section}\n\n\n## Mine\nkept", 1: "plain \n", 2: f"{section}\n\n", 3: None}
    named = spark.createDataFrame([(1, "A", "p", "B"), (2, "B", "p", "C"), (3, "C", "p", "C"), (4, "D", "p", "E")], "id bigint, subject string, predicate string, object string")
    old = projections.entity_notes(named)
    left = named.filter("id <> 2")
    got = projections.refreshed_notes(old, left, spark.createDataFrame([("B",), ("C",), ("gone",)], "name string"))
    plain = lambda df: sorted(tuple(r) for r in df.select("name", "part", "note").collect())
    assert plain(got) == plain(projections.entity_notes(left))


def test_words_of_sentences_are_no_rows(spark):
    steps = spark.createDataFrame([("a", 0, "Old ACME sells, acmes do not"), ("a", 1, "acmes"), ("b", 0, "acme"), ("a", 2, None)], "doc string, step int, text string")
    names = spark.createDataFrame([("a", 1, "Acme"), ("a", 1, "old acme"), ("a", 2, " "), ("b", 3, "sells")], "doc string, entity bigint, spelling string")
    found = documents.scoped_mentions(steps, names)
    assert [tuple(r) for r in found.collect()] == [("a", 0, 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_library_counts_meet_once(spark):
    """Names shared by several entities, ends that are null or no entities, a url of two, strangers: each row of a document moves once."""
    contents = spark.createDataFrame([("d", "u", 1), ("e", "", 2), ("f", None, 0)], "id string, url string, rejections int")
    none = {}
    listed = [(1, "Node", "Article", ["d"], ["d"], none), (2, "Node", "Person", [], ["d", "e", "d"], none), (3, "Web", "Article", [], [], {"url": "u"}), (4, "Cee", "Claim", [], ["d", "e", "x"], none), (5, "Dee", "Person", ["e"], [], {"url": ""}), (6, "Web", "Thing", [], ["e"], {"url": "u"}), (7, None, "Person", ["e"], ["e"], none)]
    entities = spark.createDataFrame(listed, "id bigint, name string, type string, aliases array<string>, sources array<string>, properties map<string,string>")
    edges = [(10, 1, 4, "d"), (11, 4, 4, "d"), (12, 2, 6, "d"), (13, 6, 4, "d"), (14, 3, 3, "d"), (15, 99, 4, "d"), (16, None, 4, "e"), (17, 5, 7, "e"), (18, 2, 7, "e"), (19, 1, 2, "x"), (20, 2, 99, "f")]
    triples = spark.createDataFrame([(i, s, "p", o, d) for i, s, o, d in edges], "id bigint, subject_id bigint, predicate string, object_id bigint, source string")
    got = documents.library_counts(contents, entities, triples)
    assert {r["doc"]: tuple(r)[1:] for r in got.collect()} == {"d": (0, 2, 1), "e": (3, 2, 2), "f": (1, 1, 0)}
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 3


def test_notes_of_one_part_move_once(spark):
    """Names with as many lines as a part has, one more, and very many; no note is made of uncompressed rows."""
    named = spark.createDataFrame([(i, "A", "p", f"o{i % 3}") for i in range(10)] + [(20 + i, "B", "p", "C") for i in range(4)] + [(30, "D", "p", "D")], "id bigint, subject string, predicate string, object string")
    notes = projections.entity_notes(named, 4)
    got = {(r["name"], r["part"]): r["note"].split("\n")[2:] for r in notes.collect()}
    sizes = {key: len(lines) for key, lines in got.items()}
    assert sizes == {("A", 1): 4, ("A", 2): 4, ("A", 3): 2, ("o0", 1): 4, ("o1", 1): 3, ("o2", 1): 3, ("B", 1): 4, ("C", 1): 4, ("D", 1): 2}
    assert got["A", 2] == [f"- p [[o{i % 3}]]" for i in range(4, 8)] and got["D", 1] == ["- [[D]] p", "- p [[D]]"]
    assert {r["name"] for r in projections.entity_notes(named, 4, spark.createDataFrame([("B",), ("none",)], "name string")).collect()} == {"B"}
    assert "ExistingRDD" not in notes._jdf.queryExecution().executedPlan().toString()
