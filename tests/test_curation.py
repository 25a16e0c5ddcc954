"""Small fixtures for rules, walks, segments, captions, articles and projections."""

import pytest
from pyspark.sql import functions as F

from kgloom.functions.text import normalize
from kgloom.operators import documents, judgments, rules, schema_changes, search, segments
from kgloom.plans import curation
from kgloom.plans import testgraph as G
from kgloom.sinks import projections
from kgloom.sources import articles, captions, routing, takeout
from tests.test_queries import spark  # noqa: F401


def _fired(frame, given=curation.DEFAULT_RULES, rounds=10):
    return sorted((r["action"], r["entity"] or r["topic"]) for r in rules.fire(frame, given, rounds).collect())


def test_rules(spark):  # noqa: F811
    facts = spark.createDataFrame([("entity", "A", "DefinedTerm", 7), ("entity", "B", "DefinedTerm", 1), ("entity", "A", "DefinedTerm", 9)], "kind string, name string, type string, degree bigint")
    assert _fired(facts) == [("create_wiki_page", "A"), ("queue_report", "A")]
    assert _fired(facts, rounds=1) == [("create_wiki_page", "A")]
    guarded = [rules.Rule("g", [{"kind": "entity"}, {"kind": "absent"}], [("create_wiki_page", {"entity": "$name", "topic": "x"})])]
    assert _fired(facts, guarded) == []
    held = facts.filter(rules.matches({"missing": None, "degree": {"ne": 7, "unheard": 1}, "name": {"contains": "A", "in": ["A"]}}, facts.columns))
    assert [r["degree"] for r in held.collect()] == [9]
    top = spark.range(1).select(rules.top_relevance(F.from_json(F.lit('{"b":0.5,"a":0.5}'), "map<string,double>")).alias("x"), rules.top_relevance(F.lit(None).cast("map<string,double>")).alias("y")).first()
    assert (tuple(top["x"]), tuple(top["y"])) == (("b", 0.5), (None, 0.0))


def test_walk(spark):  # noqa: F811
    docs = spark.createDataFrame([("a", "Open AI开发软件。Other也出现了。没有实体的句子。")], "doc string, summary string")
    scope = spark.createDataFrame([("a", 1, "Open AI", "Organization"), ("a", 2, "Model", "Technology"), ("a", 3, "Other", "Thing")], "doc string, id bigint, name string, type string")
    edges = spark.createDataFrame([("a", 10, 1, "develops", 2), ("b", 11, 3, "uses", 2)], "doc string, id bigint, subject_id bigint, predicate string, object_id bigint")
    got = documents.summary_walk(docs, scope, edges).orderBy("step").collect()
    assert [(r["direct"], r["neighbours"], r["edge_ids"]) for r in got] == [(["Open AI"], ["Model"], [10]), (["Other"], [], []), ([], [], [])]


def test_type_meet(spark):  # noqa: F811
    pairs = spark.createDataFrame([(1, "CreativeWork", "Article"), (2, "Article", "Thing"), (3, "Person", "Organization"), (4, "Unknown", "Unknown")], "id int, type string, incoming string")
    got = schema_changes.type_meet(pairs, spark.createDataFrame(G.CLASSES, "class string, parent string")).orderBy("id").collect()
    assert [(r["met"], r["outcome"]) for r in got] == [("Article", "refine"), ("Article", "keep"), (None, "conflict"), ("Unknown", "keep")]


def test_segments(spark):  # noqa: F811
    clips = spark.createDataFrame([("d", 0.0, 10.0, 1.0), ("d", 5.0, 15.0, 3.0), ("d", 15.0, 20.0, 2.0), ("d", 30.0, 30.5, 9.0)], "doc string, start double, end double, score double")
    assert sorted(r["start"] for r in segments.best_apart(clips, 6).collect()) == [5.0, 15.0]
    assert [r["start"] for r in segments.best_apart(clips, 1).collect()] == [5.0]
    cues = spark.createDataFrame([("d", float(i), i + 1.0, "x" * 100) for i in range(14)], "doc string, start double, end double, text string")
    assert [r["batch"] for r in segments.batches(cues).orderBy("start").collect()] == [0] * 12 + [1] * 2
    assert [r["batch"] for r in segments.batches(cues, chars=250).orderBy("start").collect()] == [i // 2 for i in range(14)]
    text = projections.srt(cues.limit(1)).first()["srt"]
    assert text == "1\n00:00:00,000 --> 00:00:01,000\n" + "x" * 100


def test_captions(spark):  # noqa: F811
    vtt = "WEBVTT\n\n00:01.250 --> 00:03.500 align:start\n<c>Hello</c> &amp; welcome\n\n7\n00:00:05.000 --> 00:00:07.000\nHello &amp; welcome\n"
    bad = '{"events":[{"tStartMs":1200,"dDurationMs":2400,"segs":[{"utf8":"a"},{"utf8":"b"}]},{"segs":[{"utf8":"c"}]}]}'
    frame = spark.createDataFrame([(vtt, bad)], "vtt string, json string")
    row = frame.select(captions.vtt_segments("vtt").alias("v"), captions.vtt_text(F.col("vtt")).alias("t"), captions.json3_segments(F.col("json")).alias("j")).first()
    assert [tuple(x) for x in row["v"]] == [(1.25, 3.5, "Hello & welcome"), (5.0, 7.0, "Hello & welcome")]
    assert row["t"] == "Hello & welcome" and [tuple(x) for x in row["j"]] == [(1.2, 3.6, "ab")]
    texts = spark.createDataFrame([(0, "hi\nhttp://x.y/z"), (1, " "), (2, "#EXTM3U\na"), (3, '{"a":1}'), (4, "<html>"), (5, "https://a.b/c\n\nhttps://d.e"), (6, None)], "k int, t string")
    assert [r["k"] for r in texts.filter(captions.valid_transcript(F.col("t"))).collect()] == [0]


def test_transcript_payloads(spark):  # noqa: F811
    bad = ["[Music] hello", "#EXT-X-STREAM a", "<error>x</error>", "<BODY\n>", "https://a.b/c see this\u2028http://x", "\ufeff {", "\x0b", ""]
    good = ["<errors>", "http:/x", "say [Music]", "https://a.b\x85then speech", "\x0b{"]
    rows = spark.createDataFrame([(t,) for t in bad + good], "t string").withColumn("v", captions.valid_transcript(F.col("t"))).collect()
    assert [r["t"] for r in rows if r["v"]] == good


def test_caption_edges(spark):  # noqa: F811
    vtt = {
        "X-TIMESTAMP-MAP=LOCAL:00:00:01.000,MPEGTS:0\n00:01 --> 00:02\na": [],
        "X-TIMESTAMP-MAP=MPEGTS:0\n00:01 --> 00:02\na": [],
        "X-TIMESTAMP-MAP=LOCAL:00:00,MPEGTS:0\n00:01 --> 00:02\na\n b <i\n>c\n\nd": [(1.0, 2.0, "a\nb c")],
        "00:01 --> 00:02\na\nb --> c\nd\n00:03 --> 00:04\ne\n1.2.3:0 --> 00:05\nf": [(1.0, 2.0, "a"), (3.0, 4.0, "e")],
        "": [],
    }
    for text, cues in vtt.items():
        row = spark.createDataFrame([(text,)], "t string").select(captions.vtt_segments("t").alias("v")).first()
        assert [tuple(c) for c in row["v"]] == cues
    json = '{"events":[{"tStartMs":0,"dDurationMs":500,"segs":[{"utf8":"&lt;a"},{},{"utf8":" &amp;amp; "}]}]}'
    got = spark.createDataFrame([(json,), ("{",), (None,)], "t string").select(captions.json3_segments(F.col("t")).alias("v")).collect()
    assert [r["v"] and [tuple(c) for c in r["v"]] for r in got] == [[(0.0, 0.5, "<a &amp;")], None, None]


def test_sentences_and_mentions(spark):  # noqa: F811
    import re

    from kgloom.functions import text

    texts = ["a!\n\tb\n\t\nc", "\u3000one。\u3000 two. three?!", "", "x\x1c\n\x85y ", "。。a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", text.sentences(F.col("t"))).collect()
    for r in rows:
        assert r["s"] == [s.strip() for s in re.split(r"(?<=[。！？!?])\s*|\n+", r["t"]) if s.strip()], repr(r["t"])
    names = ["Open AI", "C++", "++", "a\\Ed", "東京", "Zoë", "é", "open", " ", "b"]
    docs = ["we like OPEN ai, c++ and a\\ed", "opened zoë東京都", "É ++", "c++x b_ _b", "", None]
    entities = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in documents.mentions(frame, entities).collect())
    word = lambda n, t: re.search(r"(?<![A-Za-z0-9_])" + re.escape(n) + r"(?![A-Za-z0-9_])", t, re.I | re.A) if n.isascii() else n.casefold() in t.casefold()
    assert got == sorted((d, e) for d, t in enumerate(docs) for e, n in enumerate(names) if t and n.strip() and word(n, t))


def test_articles_and_takeout(spark):  # noqa: F811
    page = '<html><head><title> News_site </title></head><body><article><p>no</p></article><div class="a post_body"><p>One <b>two</b></p><script>var t="</p>"</script><p> </p><p>three</p></div></body></html>'
    rows = spark.createDataFrame([(page,), (None,), ("<article><p>x</p></article>",)], "html string")
    assert [tuple(r["a"]) for r in rows.select(articles.extract_article("html").alias("a")).collect()] == [("News", "One two\nthree"), ("", ""), ("", "x")]
    lines = spark.createDataFrame([(0, "Video ID,Time"), (1, "abcdefghij1,x"), (2, "https://youtu.be/abcdefghij2"), (3, "https://a/watch?v=abcdefghij1")], "ord int, line string")
    assert sorted((r["id"], r["ord"]) for r in takeout.takeout_ids(lines).collect()) == [("yt:abcdefghij1", 1), ("yt:abcdefghij2", 2)]


def test_articles_without_container_text(spark):  # noqa: F811
    pages = {
        '<title>T_s</title><body><p>one\n <b>two</b></p><div><p class="x"> three </p></div><p> </p></body>': "one two\nthree",
        '<p>before</p><div id="content"><span>no paragraph</span></div><article><p>after</p></article>': "before\nafter",
        '<div class="a post_body"><p> </p></div><p>outside</p>': "outside",
        '<article></article><p>outside</p>': "outside",
        '<p>outside</p><div class="post_body"><span>x</span></div>': "",
        '<p>outside</p><div id="content"><p>inside</p></div>': "inside",
        "<span>none</span>": "",
    }
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select("html", articles.extract_article("html").alias("a")).collect()
    assert {r["html"]: r["a"]["body"] for r in rows} == pages


def test_judgments(spark):  # noqa: F811
    rows = spark.createDataFrame([("a", "triple", "t1", ["x"], True, True, "agree"), ("b", "triple", "t2", ["y"], True, True, "agree"), ("c", "entity", "t3", ["y"], True, True, "agree"), ("d", "claim", "t4", ["y"], True, False, "agree"), ("e", "claim", "t5", ["y"], True, True, "unset"), ("f", "claim", "long", ["y"], True, True, "agree")], "key string, kind string, title string, sources array<string>, reviewed boolean, included boolean, stance string")
    assert [r["key"] for r in judgments.baseline(rows, "x").collect()] == ["b", "f"]
    with pytest.raises(ValueError, match="6 characters"):
        judgments.baseline(rows, "x", chars=3)
    history = spark.createDataFrame([(1, "k", "old"), (2, "k", "new"), (3, "m", "one")], "id int, memory_key string, after_state string")
    assert sorted((r["memory_key"], r["after_state"]) for r in judgments.latest(history).collect()) == [("k", "new"), ("m", "one")]


def _notes(named, size):
    lines = {}
    for r in named:
        lines.setdefault(r["subject"], []).append((r["id"], f"- {r['predicate']} [[{r['object']}]]"))
        lines.setdefault(r["object"], []).append((r["id"], f"- [[{r['subject']}]] {r['predicate']}"))
    return {(name, k // size + 1): f"# {name}{f' ({k // size + 1})' if k else ''}\n\n" + "\n".join(x for _, x in sorted(all_)[k : k + size]) for name, all_ in lines.items() for k in range(0, len(all_), size)}


def test_entity_notes(spark):  # noqa: F811
    named = spark.createDataFrame([(i * 37 % 500, "Hot" if i % 50 else "Cold", "makes" if i % 3 else "relatedTo", f"P{i % 9}") for i in range(500)], "id bigint, subject string, predicate string, object string")
    for size in (1, 7, 1000):
        got = projections.entity_notes(named, size).collect()
        assert len(got) == len({(r["name"], r["part"]) for r in got})
        assert {(r["name"], r["part"]): r["note"] for r in got} == _notes(named.collect(), size)
    whole = curation._named(spark, "/root/testdata/sf0.001")
    got = {(r["name"], r["part"]): r["note"] for r in curation.entity_notes(spark, "/root/testdata/sf0.001").collect()}
    assert got == _notes(whole.collect(), projections.PART_LINES) and any("] makes" in note for note in got.values())


def test_rows_only_queries(spark):  # noqa: F811
    for name in ("reading_walk", "entity_notes", "seg_topk_nonoverlap", "seg_batches", "srt_subtitles", "page_extract_article"):
        assert not curation.query.__globals__["QUERIES"][name](spark, "/root/testdata/sf0.001").isEmpty(), name


def test_speech_of_vtt(spark):  # noqa: F811
    texts = ["WEBVTT\n\n00:01.0 --> 00:02.0\na < b\n\n00:02.0 --> 00:03.0\nc > d", "REGION x\nSTYLE\n<c>12</c>\n12\nhi\nhi <b>\n&amp;amp;\r\n<i></i>", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", captions.vtt_text(F.col("t")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in rows} == {0: "a < b\nc > d", 1: "12\nhi\nhi <b>\n&amp;".replace("hi <b>", "hi "), 2: "", 3: None}


def test_articles_first_container(spark):  # noqa: F811
    pages = {
        "<article><p>one</p></article><article><p>two</p></article>": ("", "one"),
        "<title>A &amp; B_c</title><article><p>one<b>two</b> three</p></article>": ("A &amp; B", "one two three"),
        "<title>open<p>x</p>": ("", "x"),
        "<p>a<p>b</p>c</p><p>d": ("", "a b".replace(" ", "")),
    }
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select("html", articles.extract_article("html").alias("a")).collect()
    assert {r["html"]: tuple(r["a"]) for r in rows} == pages


def test_links_and_formats(spark):  # noqa: F811
    ids = {"https://youtu.be/abcdefghijk": "abcdefghijk", "see https://www.youtube.com/watch?a=1&v=abcdefghijk&t=2。 more": "abcdefghijk", "http://m.youtube.com/shorts/abcdefghij-/x": "abcdefghij-", "https://evil.com/youtube.com/watch?v=abcdefghijk": None, "https://youtube.com.evil.org/watch?v=abcdefghijk": None, "https://youtube.com/watch?v=short": None, "https://youtube.com/other?v=abcdefghijk https://youtu.be/kjihgfedcba": "kjihgfedcba", "none": None, "https://YouTube.com/live/abcdefghijk": "abcdefghijk", "https://youtube.com/watch?v=abcdefghijkl": None}
    rows = spark.createDataFrame([(t,) for t in ids], "t string").select("t", routing.video_in(F.col("t")).alias("i")).collect()
    assert {r["t"]: r["i"] for r in rows} == ids
    kinds = {"﻿ #EXTM3U": "hls", "{": "json3", "WEBVTT": "vtt", "x --> y": "vtt", "hello world": None, "": None}
    rows = spark.createDataFrame([(t,) for t in kinds], "t string").select("t", routing.caption_format(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == kinds


def test_baseline_is_whole_or_refused(spark):  # noqa: F811
    rows = spark.createDataFrame([(str(k), "triple", "t" * 10, ["s"] if k < 5 else ["o"], True, True, "agree") for k in range(20)], "key string, kind string, title string, sources array<string>, reviewed boolean, included boolean, stance string")
    assert judgments.baseline(rows, "s", most=15).count() == 15
    for limits in ({"most": 14}, {"chars": 149}):
        with pytest.raises(ValueError):
            judgments.baseline(rows, "s", **limits)
    got = judgments.baselines(rows, spark.createDataFrame([("s",), ("o",), ("x",)], "source string"), 15, 149).collect()
    assert sorted((r["source"], r["judgments"], r["characters"], r["outcome"]) for r in got) == [("o", 5, 50, "ready"), ("s", 15, 150, "long"), ("x", 20, 200, "many")]


def test_search_folds(spark):  # noqa: F811
    assert search.query_terms("x y x") == ["x", "y"]
    assert search.query_terms("Ａ a Straße STRASSE") == ["Ａ", "Straße"]
    entities = spark.createDataFrame([(1, "Ｓtraße"), (2, "other")], "id bigint, name string").withColumn("norm_name", normalize("name")).withColumn("aliases", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "norm_alias string, entity_id bigint")
    for asked in ("STRASSE", "ＳＴＲＡßE"):
        assert [r["id"] for r in search.search_entities(entities, none, search.query_terms(asked), 5).collect()] == [1]
    assert [r["id"] for r in search.named_in(entities, none, "Wo ist die ＳTRASSE?").collect()] == [1]
