"""Each operator against brute force, on small tables with nulls, repeats, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import math
import re
import struct
import time
import warnings
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kgloom.llm import decontaminate, jaccard_join, language_id, license_scan, lm_score, mixing, quality, queries, simhash, substring_dedup, token_blocks
from kgloom.llm.common import byte_shards, connected_components, id_range
from kgloom.llm.words import BY_SPACE, Words, utf8

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    base = draw(120).split()
    rows = [None, "", " \n", "One", "one two", "The MIT, license", base and " ".join(base)]
    for _ in range(12):  # near copies
        copy = list(base)
        for at in rng.integers(0, len(base), rng.integers(1, 5)):
            copy[at] = "edited"
        rows.append(" ".join(copy))
    rows += [" ".join(base), " ".join(base).upper(), "a " * 400, "a\n" * 30]
    passage = draw(60)
    rows += [f"{draw(40)} {passage} {draw(40)}" for _ in range(6)]
    rows += [draw(20_000), f"Released under the MIT License. {draw(30)} Apache License, Version 2.0 cc-by-nc under the mit license", "x\U0001f600y 中文字 z"]
    rows += [draw(int(n)) for n in rng.integers(5, 200, 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = [("en", "fr", None)[i % 3] for i in range(len(texts))]
    return spark.createDataFrame([(3 * i, t, langs[i], f"s{i % 2}", None, "clash", 0.5) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_simhash(docs, texts, empty, spark):
    def fingerprint(text):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in spaced(text)]
        two = lambda p, q: xxhash.xxh64(struct.pack("<Q", q), seed=xxhash.xxh64(struct.pack("<Q", p), seed=42).intdigest()).intdigest()
        h = [two(p, q) for p, q in itertools.pairwise(h)] if len(h) > 1 else h
        value = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        return value - (1 << 64) if value >> 63 else value

    got = by_id(simhash.edited_fingerprints(docs))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[3 * i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["f"], row["g"], row["next_f"]) == (fingerprint(text), fingerprint(edited), fingerprint(following))
    assert simhash.edited_fingerprints(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z"), (None, "q")], "doc_id bigint, text string")
    assert simhash.edited_fingerprints(again).count() == 4


def test_near_fingerprints(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    values += [v ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for v, k in zip(values, itertools.cycle([0, 1, 2, 3, 4]), strict=False)]
    got = {(r["a"], r["b"]) for r in simhash.near_fingerprints(spark.createDataFrame([(v,) for v in [*values, None]], "fingerprint bigint"), 3).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(set(values), 2) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontaminate(docs, texts, empty, spark, block_bytes):
    items = [("b", " ".join(texts[24].split()[45:75])), ("a", texts[24].split()[50] + " " + texts[24].split()[51]), ("c", "mit license"), ("d", None), (None, "one two"), ("e", "!"), ("c", "one two")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 9) if w and item else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    got = by_id(decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes))
    for i, text in enumerate(texts):
        w, hit, named = alnum(text), set(), set()
        for p, of in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    named |= of
        row = got[3 * i]
        assert (row["n_words"], row["items"]) == (len(w), sorted(named))
        assert sorted(x for s in row["spans"] for x in range(s["first"], s["end"])) == sorted(hit)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert not any(r["spans"] for r in decontaminate.decontaminate(docs, benchmark.limit(0)).collect())


def test_decontaminate_writes_between_blocks(spark, monkeypatch):
    done, blocks, write = [], decontaminate.benchmark_blocks, getattr(decontaminate, "materialize", None)

    def noted(*args):
        for block in blocks(*args):
            done.append("block")
            yield block

    monkeypatch.setattr(decontaminate, "benchmark_blocks", noted)
    monkeypatch.setattr(decontaminate, "materialize", lambda *args: (done.append("written"), write(*args))[1], raising=False)
    texts = [f"alpha{i} beta{i} gamma{i}" for i in range(40)]
    benchmark = spark.createDataFrame([("one", t) for t in texts], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(f"x {t} y" for t in texts)), "doc_id bigint, text string")
    got = decontaminate.decontaminate(docs, benchmark, block_bytes=300).collect()
    assert sorted((r["doc_id"], [tuple(s) for s in r["spans"]], r["items"]) for r in got) == [(i, [(1, 4)], ["one"]) for i in range(40)]
    assert len(done) > 2 and done == ["block", "written"] * (len(done) // 2) + ["block"]


def test_cut_spans(spark):
    rows = spark.createDataFrame([(1, "Aé, b c. D", 10, [(1, 3)]), (2, None, None, []), (3, "x", 1, [(0, 1)])], "doc_id bigint, text string, n_chars bigint, spans array<struct<first:bigint,end:bigint>>")
    assert [(r["text"], r["n_chars"]) for r in decontaminate.cut_spans(rows).orderBy("doc_id").collect()] == [("Aé, . D", 7), (None, None), ("", 0)]


def test_license_scan(docs, texts, empty):
    assert len(license_scan.rules()) > 200
    got = by_id(license_scan.scan_licenses(docs))
    for i, text in enumerate(texts):
        w = alnum(text)
        base = sorted((k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert got[3 * i]["n_words"] == len(w)
        assert sorted((b["first"], b["label"]) for b in got[3 * i]["base"]) == base
    found = next(r for i, r in got.items() if texts[i // 3] and texts[i // 3].startswith("Released under"))
    assert [(d["first"], d["end"], d["label"]) for d in found["detections"]][0] == (0, 5, "mit")
    for r in got.values():
        spans = [(d["first"], d["end"], d["priority"]) for d in r["detections"]]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] and a[2] <= b[2] for a in spans for b in spans)
    assert license_scan.scan_licenses(empty).count() == 0


def spelled(parsed):
    """All strings of a parsed regex without its lookarounds; * stands for up to two."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                each = [chr(arg)]
            case "IN":
                each = [chr(c) for kind, x in arg for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])]
            case "SUBPATTERN":
                each = spelled(arg[3])
            case "BRANCH":
                each = [s for branch in arg[1] for s in spelled(branch)]
            case "MAX_REPEAT":
                each = ["".join(x) for n in range(arg[0], min(arg[1], 2) + 1) for x in itertools.product(spelled(arg[2]), repeat=n)]
            case "ASSERT":
                each = [""]
        out = [a + b for a in out for b in each]
    return out


def test_license_keywords():
    gate = re.compile(license_scan._GATE)
    for r in license_scan.rules():
        forms = spelled(re._parser.parse(r["regex"]))
        assert re.search(r["regex"], f" {forms[-1]} ")
        assert [s for s in forms if r["keyword"] not in f" {s} " or not gate.search(s)] == [], r


def test_license_glued_versions(spark):
    said = {"SPDX-License-Identifier: GPLv2": "gpl-2", "licensed under the GPLv3 license": "gpl-3", "LGPLv3 license": "lgpl-3", "AGPLv3 license": "agpl-3", "license: apache2": "apache-2", "FreeBSD license": "bsd-2-clause", "OpenRAIL-M license": "openrail", "University of Illinois open source license": "ncsa", "under the GNU Library General Public License": "lgpl", "Artistic2 license": "artistic-2", "PHP3 license": "php-3", "OSL3 license": "osl-3", "CDDL1 license": "cddl-1", "EUPL1.2 license": "eupl", "Elastic2 license": "elastic-2"}
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")))
    assert {text: label in {d["label"] for d in got[i]["detections"]} for i, (text, label) in enumerate(said.items())} == dict.fromkeys(said, True)


def components(sets):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("least", [8, 2])
def test_jaccard_join(docs, texts, empty, spark, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "LEAST", least)
    sets = {}
    for i, text in enumerate(texts):
        w = spaced(lowered(text))
        sets[3 * i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    expected = components(sets)
    got = by_id(jaccard_join.jaccard_classes(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), expected[i]) for i in sets}
    assert jaccard_join.jaccard_classes(empty).count() == 0
    assert len({r["component_id"] for r in got.values() if texts[r["doc_id"] // 3] is None or not spaced(texts[r["doc_id"] // 3])}) == 3


def test_byte_shards(spark):
    rows = [(i, "x" * (i % 7)) for i in range(400)] + [(77, f"{i:03}" * 30) for i in range(100)] + [(None, "y" * 50), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (50, 700, 10**6):
        shard, n = byte_shards(docs, limit)
        had = docs.groupBy(shard.alias("s")).agg({"*": "count"}).collect()
        assert all(0 <= r["s"] < n for r in had) and sum(r["count(1)"] for r in had) == len(rows)
    shard, n = byte_shards(docs, 700)
    assert docs.filter("doc_id = 77").select(shard.alias("s")).distinct().count() > 5
    assert byte_shards(docs.limit(0), 700)[1] <= 1
    ids = spark.createDataFrame([(i,) for i in (*range(-5, 300), None)], "doc_id bigint")
    for splits in ([], [3], [0, 10, 11], list(range(0, 250, 3))):
        assert {r[0]: r[1] for r in ids.select("doc_id", id_range(splits)).collect()} == {i: sum(s < i for s in splits) for i in range(-5, 300)} | {None: 0}


def test_long_words():
    text = ["a" * 400_000, "b c", "x" * 700_000 + " " + "x" * 700_000 + " y", "c"]
    data, offsets = utf8(pa.array(text))
    h = Words(data, offsets, BY_SPACE, lower=False).hashes()
    assert len(h) == 7 and h[3] == h[4] and h[2] == h[6] and len(set(h.tolist())) == 5


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (40, 42), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 42: 40}


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50))
    rows = [(i, good() if i % 4 else good().upper() + "!!") for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 1)], "doc_id bigint, quality int, toxic int")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    model = quality.train_quality(docs, labels, "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    right = [(got[i] >= 0.3) == (i % 4 > 0) for i in held if i < 1000]
    assert len(got) == 402 and np.mean(right) > 0.9
    none = quality.train_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def _risk(w, p, u, prior):
    """The non-negative risk, row by row."""
    g = lambda x: np.c_[x, np.ones(len(x))] @ w
    bracket = ((1 + g(u)) ** 2).mean() / 4 - prior * ((1 + g(p)) ** 2).mean() / 4
    return prior * ((1 - g(p)) ** 2).mean() / 4 + max(0.0, bracket), bracket


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_quality_risk(prior):
    """The weights from moments against small steps away from them on rows, and the bracket, which is not below zero."""
    rng = np.random.default_rng(5)
    draw = lambda n, at: quality.on_grid(rng.normal(at, 1, (n, quality.FEATURES)), 0.0, 1.0)
    p, u = draw(500, 0.1), np.concatenate([draw(500, 0.1), draw(300, -0.1)])
    sums = [quality.Moments.none(), quality.Moments.none()]
    for m, x in zip(sums, (p, u), strict=True):
        m.add(x[:100])
        m.add(x[100:])
    assert sums[1].n == 800 and (sums[1].sums[-1, :-1] == u.sum(0) * quality.GRID).all() and (sums[0].sums[:-1, :-1] == p.T @ p).all()
    w = quality.non_negative_weights(*sums, prior, ridge=0.2)
    full = lambda w: _risk(w, p / quality.GRID, u / quality.GRID, prior)[0] + 0.1 * (w[:-1] ** 2).sum()
    assert _risk(w, p / quality.GRID, u / quality.GRID, prior)[1] > -1e-6
    for _ in range(200):
        step = rng.normal(0, 1, len(w))
        assert full(w + 1e-3 * step / np.linalg.norm(step)) > full(w) - 1e-8


def test_quality_prior(spark):
    """The share of good texts among all, of which labels mark some; counts of scores against the scores themselves."""
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    for share in (0.3, 0.8):
        rows = [(i, good() if i < 1500 * share else good().upper() + "!!") for i in range(1500)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        labels = spark.createDataFrame([(i, 1) for i in range(0, int(1500 * share), 2)], "doc_id bigint, quality int")
        model = quality.train_quality(docs, labels)
        assert abs(model.prior - share) < 0.1
        got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
        assert np.mean([(got[i] >= 0.5) == (i < 1500 * share) for i in got]) > 0.98
    p, u = rng.normal(1, 1, 200), rng.normal(0, 1, 999)
    cuts = np.unique(p)
    counts = np.bincount(np.searchsorted(cuts, u, side="right"), minlength=len(cuts) + 1)
    error = 1.01 * sum(np.sqrt(np.log(40) / 2 / n) for n in (200, 999))
    pairs = [((u >= c).mean(), (p >= c).mean()) for c in cuts]
    best = min(pairs, key=lambda x: (x[0] + error) / x[1])
    assert quality.least_ratio(p, counts) == pytest.approx(best[0] / best[1])


def test_quality_repeats(spark):
    """Whatever the order of rows, a repeated doc_id gives the same model."""
    rows = [(i % 40, f"{'word ' * (i % 7 + 1)}{i}", "x") for i in range(200)] + [(None, "null id", "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    frames = [spark.createDataFrame(r, "doc_id bigint, text string, score string") for r in (rows, rows[::-1])]
    models = [quality.train_quality(f, labels) for f in frames]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all() and models[0].prior == models[1].prior
    assert quality.score_quality(frames[0], models[0]).count() == 201
    assert quality.score_quality(frames[0].limit(0), models[0]).count() == 0


def test_language_blocks(monkeypatch):
    """Bundles over blocks of trigrams against letter by letter, on an alphabet of many letters."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 300, 200))), "", "ab Ba, \U00010400x", "".join(map(chr, rng.integers(0x4E00, 0x9000, 100)))]
    monkeypatch.setattr(language_id, "_BLOCK", 37)
    got = language_id._sums(*language_id._trigrams(texts), len(texts))
    for text, bundle in zip(texts, got, strict=True):
        want = np.zeros(language_id.DIMENSIONS)
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        for i in range(1, len(padded) - 1):
            if padded[i] != " ":
                a, b, c = (language_id._letter_vector(0 if x == " " else ord(x)).astype(int) for x in padded[i - 1 : i + 2])
                want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (bundle == want).all()


def test_kept_columns_with_result_names(docs, texts):
    """A result column takes the place of a kept one of its name; internal names never clash."""
    named = docs.withColumns({c: docs["source"] for c in ("n_words", "n_tokens", "shard", "train", "norm", "hits", "runs", "lang_pred", "score", "detections")})
    keep = tuple(c for c in named.columns if c != "text")
    model = quality.QualityModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros(quality.FEATURES), 0.0, 0.5)
    learned = language_id.train_language_profiles(docs)
    results = {
        "score": quality.score_quality(named, model, keep=keep), "n_words": license_scan.scan_licenses(named, keep=keep), "spans": substring_dedup.dedup_substrings(named, keep=keep),
        "n_tokens": lm_score.score_texts(named, "true", keep=keep), "lang_pred": language_id.predict_language(named, *learned, keep=keep),
    }
    for column, found in results.items():
        assert len(set(found.columns)) == len(found.columns) and set(keep) <= set(found.columns)
        rows = found.collect()
        assert len(rows) == len(texts)
        assert column == "lang_pred" or not any(r[column] in ("s0", "s1", "clash") for r in rows), column
        if column != "n_words":
            assert {r["hits"] for r in rows} == {"s0", "s1"}


def test_substring_dedup(docs, texts, empty):
    first = {}
    words = [spaced(t) for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = by_id(substring_dedup.dedup_substrings(docs))
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        row = got[3 * i]
        assert (row["n_words"], row["n_removed"], row["kept_text"]) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
        assert sorted(x for s in row["spans"] for x in range(s["first"], s["end"])) == sorted(gone)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(3)
    words = {"good": list("abc"), "low": list("def"), "toxic": list("ghi")}
    rows = [(i, " ".join(rng.choice(words[d], 30))) for i, d in enumerate(["good"] * 60 + ["low"] * 30 + ["toxic"] * 10)] + [(200, None), (201, ""), (None, "a b"), (3, "a b c"), (202, "a " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1.0, 7) for i, t in rows], "doc_id bigint, text string, rate double, n_tokens bigint")
    labels = spark.createDataFrame([(i, int(i < 60 or i > 89), int(i > 89)) for i in range(0, 100, 2)], "doc_id bigint, quality int, toxic int")
    shares = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    domains = mixing.quality_domains(labels)
    got = mixing.mixing_rates(docs, domains, shares, keep=("doc_id", "rate", "n_tokens")).collect()
    n = [r["n_tokens"] for r in got]
    total = [sum(r["n_tokens"] * r["rate"] * r["posteriors"][k] for r in got) for k in range(3)]
    assert len(got) == 105 and min(r["rate"] for r in got) >= 0
    assert sorted(n) == sorted(len(spaced(t)) for _, t in rows)
    assert np.allclose(np.array(total) / sum(n), [0.8, 0.15, 0.05], atol=0.003)
    assert all(r["posteriors"][(0 if r["doc_id"] < 60 else 1 if r["doc_id"] < 90 else 2)] > 0.8 for r in got if r["n_tokens"] == 30)
    assert mixing.mixing_rates(docs.limit(0), domains, shares).count() == 0
    none = mixing.mixing_rates(docs, mixing.quality_domains(labels.limit(0)), shares).collect()
    assert len(none) == 105 and all(np.allclose(r["posteriors"], 1 / 3) for r in none)


def test_mixing_rates_are_least_squares(spark):
    """Against a dense solver, within reach and out of it."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4, 0.2, 0.1], 300)
    n = rng.integers(0, 200, 300)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens bigint, posteriors array<double>")
    for targets, near in (([0.7, 0.25, 0.05], 0.002), ([0.3, 0.3, 0.4], 0.002), ([1.0, 0.0, 0.0], 0.2)):
        goal = np.array(targets) * n.sum()
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            column, totals = mixing.fit_rates(rows, goal.tolist())
        rates = np.array([r["r"] for r in rows.select(column.alias("r")).collect()])
        assert rates.min() >= 0 and np.allclose((rates * n) @ p, totals, rtol=1e-6)
        r = np.ones(300)
        for _ in range(20_000):  # plain projected gradient
            r = np.maximum(0, r - 0.2 * p @ (((r * n) @ p - goal) / n.sum()))
        best = np.abs((r * n) @ p - goal).sum() / n.sum()
        assert np.abs(np.array(totals) - goal).sum() / n.sum() <= max(near, 1.2 * best)
        assert any("out of reach" in str(w.message) for w in said) == (np.abs(np.array(totals) - goal).sum() / n.sum() > mixing.TOLERANCE)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 30_000])
def test_lm_score(docs, texts, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_score, "SHARD_BYTES", shard_bytes)
    train = [i for i in range(len(texts)) if zlib.crc32(str(3 * i).encode()) % 7 != 2]
    tokens = [[*spaced(lowered(t)), None] for t in texts]
    one, two = Counter(w for i in train for w in tokens[i]), Counter(p for i in train for p in itertools.pairwise(tokens[i]))
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] - lm_score.DISCOUNT) / n if one[w] else lm_score.DISCOUNT * v / n
    mass = lm_score.MASS
    arc = lambda h, w: (two[h, w] + mass * root(w)) / (one[h] + mass) if two[h, w] else mass / (one[h] + mass) * root(w)
    got = by_id(lm_score.score_texts(docs, "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2"))
    for i, t in enumerate(tokens):
        row = got[3 * i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(row["base_score"], sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(row["score"], math.log10(root(t[0])) + sum(math.log10(arc(*p)) for p in itertools.pairwise(t)), rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(map(root, one)) + lm_score.DISCOUNT * v / n, 1)
    often = max((w for w in one if w), key=one.get)
    assert math.isclose(sum(arc(often, w) for w in one) + mass / (one[often] + mass) * lm_score.DISCOUNT * v / n, 1)
    assert lm_score.score_texts(empty, "true").count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": "abcdefg", "bb": "defghij", "cc": "中文字国"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(30)), lang) for i in range(120) for lang in [list(letters)[i % 3]]]
    rows += [(500, None, "aa"), (501, "12 %", "aa"), (502, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.train_language_profiles(docs.filter("doc_id % 3 < 3 AND doc_id < 90 OR doc_id >= 500"))
    got = by_id(language_id.predict_language(docs, *learned))
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i < 500]) > 0.95
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert {r["lang_pred"] for r in language_id.predict_language(docs, *language_id.train_language_profiles(docs.limit(0))).collect()} == {"und"}


def test_token_blocks(docs, texts, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    got = by_id(token_blocks.token_blocks(docs, path))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        row = got[3 * i]
        assert (row["start"], row["n_tokens"], row["ids_crc32"], bytes(row["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert token_blocks.token_blocks(empty, path).count() == 0


def test_token_encoder_white_space():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, rng = token_blocks._Encoder(path), np.random.default_rng(11)
    parts = ["a", "the", "\u4e2d", "1", ".", "'s", *" " * 6, *"\xa0" * 4, *"\t\n\r\x0b\x1c\x85\u2003\u2028\u3000\u200b\ufeff"]
    texts = ["x \xa0 \xa0 y", "a\xa0 b \xa0c", "\xa0 \xa0", " \xa0 \xa0 \xa0 \xa0 ", "x \xa0 y z \xa0\xa0 w", "a \n b\n c \n", *("".join(rng.choice(parts, rng.integers(1, 24))) for _ in range(4000))]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 500):
        assert [x.tolist() for x in encode(pa.array(texts[at : at + 500]))] == want[at : at + 500]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).choice([3, 50_000, 4_000_000_000, 17, 18], n, p=[0.6, 0.1, 0.02, 0.2, 0.08]).astype(np.uint32)
    starts, data = token_blocks.encode_blocks(ids)
    assert (token_blocks.decode_blocks(starts, data, n) == ids).all()


def test_queries_have_contract_columns(spark):
    for name, columns in {"op2_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_quality": "doc_id held_out score predicted"}.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns.split()


def clashing(spark, *names):
    """Texts with kept columns of all these names, each with a value of its own."""
    schema = ", ".join(["doc_id bigint", "text string", *(f"`{n}` string" for n in names)])
    texts = ["under the mit license a b c d e f g h", None, "", "word " * 40, "under the mit license a b c d e f g h"]
    return spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)], schema), names


@pytest.mark.parametrize(
    ("names", "run"),
    [
        (("x", "z", "e", "chosen", "sums", "r", "p0", "_kept_0"), lambda d, k: mixing.mixing_rates(d, d.selectExpr("doc_id", "CASE WHEN doc_id < 3 THEN 'a' ELSE 'b' END AS domain"), {"a": 0.5, "b": 0.5}, keep=k)),
        (("_hits", "_norm", "first", "a.b"), lambda d, k: license_scan.scan_licenses(d, keep=k)),
        (("_runs", "key", "mask", "bucket"), lambda d, k: substring_dedup.dedup_substrings(d, keep=k)),
        (("_shard", "_train", "shard", "kind", "blob"), lambda d, k: lm_score.score_texts(d, "true", keep=k)),
        (("names", "at", "part"), lambda d, k: decontaminate.decontaminate(d, d.selectExpr("doc_id AS item_id", "text").limit(1), keep=k)),
    ],
)
def test_kept_columns_may_have_any_name(spark, names, run):
    docs, names = clashing(spark, *names)
    got = run(docs, ("doc_id", *names)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(5))
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_fingerprints_keep_any_name(spark):
    docs, names = clashing(spark, "pos", "h", "of", "rows", "row", "same_text", "weight", "v0", "end_0", "_")
    got = simhash.fingerprints(docs, ["text"]).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(5)) and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_results_replace_kept_columns(spark):
    docs, _ = clashing(spark, "spans", "items")
    got = decontaminate.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text").limit(1), keep=("doc_id", "spans", "items")).collect()
    assert {r["doc_id"]: r["items"] for r in got} == {0: ["0"], 1: [], 2: [], 3: [], 4: ["0"]}


def test_repeated_ids_of_token_files_are_ordered_by_text(spark, tmp_path):
    import public_tokenizers

    texts = [f"{'same beginning ' * (i % 3) * 3}{i % 50:03}" for i in range(400)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "z"), (1, None), (9, "a")], "doc_id bigint, text string").repartition(6)
    path = f"file://{tmp_path}/tokens"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(token_blocks.token_blocks(docs, tokenizer, end_id=2, path=path).collect(), key=lambda r: r["start"])
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer).encode
    wanted = [(None, "z"), (1, ""), *((7, t) for t in sorted(texts, key=str.encode)), (9, "a")]
    assert [(r["doc_id"], r["ids_crc32"]) for r in got] == [(i, zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in wanted]


def test_windows_of_a_large_block():
    """Windows by number are those by words, in little time and memory."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)) for n in (3, 3, 40, 12, 9, 10, 0, 300)]
    rows = [(f"i{k % 5}", t) for k, t in enumerate(texts)]
    p = decontaminate.phrases(rows, 10)
    got = {}
    for length, begins, starts, of in p.windows:
        for w, b in enumerate(begins.tolist()):
            got[tuple(p.symbols[b : b + length].tolist())] = {p.items[i] for i in of[starts[w] : starts[w + 1]]}
    known = sorted({int(h): None for h in Words(*utf8(pa.array(texts)), decontaminate.BY_ALNUM, lower=True).hashes()})
    words = {w: known.index(int(Words(*utf8(pa.array([w])), decontaminate.BY_ALNUM, lower=True).hashes()[0])) + 2 for w in " ".join(texts).split()}
    wanted = {}
    for item, text in rows:
        w = [words[x] for x in text.split()]
        for i in range(max(1, len(w) - 9) if w else 0):
            wanted.setdefault(tuple(w[i : i + 10]), set()).add(item)
    assert got == wanted
    large = [(str(k), " ".join(map(str, rng.integers(0, 50_000, 1000)))) for k in range(1400)]
    began = time.time()
    p = decontaminate.phrases(large, 10)
    held = sum(a.nbytes for a in (p.vocabulary, p.symbols, *(x for _, *arrays in p.windows for x in arrays)))
    assert time.time() - began < 20 and held < 60 << 20 and sum(len(t) for _, t in large) > 7 << 20
