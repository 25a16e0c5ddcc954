"""The stages of the corpus pipeline against brute force, with nulls, repeats, empty tables and clashing columns."""

import zlib

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, score double, spans string, n_tokens int, rate double, posteriors string, runs int"


def row(i, text):
    return (i, text, "en", "s", len(text or ""), 0.25, "clash", 5, 2.0, "p", 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(500)]
    good = lambda n: " ".join(rng.choice(words, n))
    texts = {i: good(80) for i in range(240)}
    for i in range(240, 300):
        texts[i] = good(60).upper().replace(" ", "!! ")
    for i in range(300, 340):
        texts[i] = " ".join(x if k % 6 else "idiot" for k, x in enumerate(good(70).split()))
    passage = good(12)
    texts[5], texts[6] = f"{good(40)} {passage} {good(40)}", f"{texts[7]} tail"
    texts |= {400: None, 401: "", 402: texts[8], 403: good(5000)}
    docs = [row(i, t) for i, t in texts.items()] + [row(None, good(30)), row(9, texts[9])]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 240 <= i < 300), int(300 <= i < 340)) for i in range(0, 340, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_filter(spark, docs, path)
    assert kept.columns == columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert np.mean([i in ids for i in range(240)]) > 0.97 and np.mean([i in ids for i in range(241, 300, 2)]) < 0.1

    left = corpus_pipeline.near_duplicates(spark, docs, path)
    assert left.columns == columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids, key=lambda i: (i is not None, i)) == [None, *sorted([*texts, 9])][:1] + sorted(i for i in [*texts, 9] if i not in (7, 402))

    clean = corpus_pipeline.decontamination(spark, docs, path)
    assert clean.columns == columns and clean.schema["n_chars"] == docs.schema["n_chars"]
    got = {r["doc_id"]: r for r in clean.collect()}
    for i, text in texts.items():
        wanted = text.replace(passage, "") if i == 5 else text
        assert (got[i]["text"], got[i]["spans"]) == (wanted, "clash")
        assert got[i]["n_chars"] == len(wanted or "")

    mixed = corpus_pipeline.mixture(spark, docs, path)
    assert mixed.columns == columns and mixed.schema == docs.schema
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["rate"] == 2.0 and r["posteriors"] == "p"
    assert np.mean([times.get(i, 0) >= 1 for i in range(240)]) > 0.97
    assert np.mean([times.get(i, 0) for i in range(300, 340)]) < 0.3

    pytest.importorskip("public_tokenizers")
    from public_tokenizers import path as tokenizer
    from tokenizers import Tokenizer

    encode, start = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode, 0
    rows = {r["start"]: r for r in corpus_pipeline.token_files(spark, docs, path).collect()}
    ordered = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, text in ordered:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[start]["doc_id"], rows[start]["n_tokens"], rows[start]["ids_crc32"]) == (i, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(ordered)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0
