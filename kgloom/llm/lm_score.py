"""LM scoring (8): a weighted backoff automaton over smoothed n-grams.

States are the root and one for each training word. An arc leads from a state by
each bigram seen in training; where a state has no arc for a word, its failure arc
is taken to the root, whose arcs are the words and one for unknown words:
    root(w)    = (c(w) - DISCOUNT) / N,  unknown: DISCOUNT * V / N
    arc(h, w)  = (c(h w) + MASS * root(w)) / (c(h) + MASS)
    failure(h) = MASS / (c(h) + MASS)
so that each state's arcs, and its failure arc times the rest of the root, add up
to 1 (a Dirichlet prior of weight MASS about the root). One traversal of a text
from left to right carries the state and adds up log10 probabilities; a text begins
in the root and ends with one end token.

Counts come from every training text. Documents fall into shards of about
SHARD_BYTES; a task asks for each n-gram of a shard once, with its own count;
buckets of n-gram hashes add the counts up and answer the shards where the sum is
not their own. No n-gram is capped or pruned, and no table is whole on one machine.

Defined cases: a null text is empty, its only token is the end; without training
texts N and V are 0 and every probability is 1; a null doc_id trains and is not
held out; rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import byte_shards, hidden, lean, materialize, others, shuffle_partitions
from kgloom.llm.words import BY_SPACE, Words, mix, word_slices

DISCOUNT, MASS = 0.75, 1000.0
#: Text of a shard; a task gathers twice as much before it asks.
SHARD_BYTES = 6 << 20
_U = np.uint64
#: The end token's hash, and what tells the hashes of bigrams from those of words.
_END, _PAIR = _U(0x51ED270B8A2C3F15), _U(0xC2B2AE3D27D4EB4F)
_WORDS, _PAIRS, _STATS = 0, 1, 2
_ROWS = "kind int, bucket int, shard int, blob binary, n bigint, v bigint"
_ASKED = "bucket int, kinds array<int>, shards array<int>, blobs array<binary>"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each document's words and its end, one after another; where each document begins)."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(len(words.start) + n, _U)
    ends = first[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words.hashes(), _END
    return out, first


def _pairs(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second token, hash) of each bigram inside a document."""
    inside = np.ones(len(tokens), bool)
    inside[first[:-1]] = False
    second = np.flatnonzero(inside)
    return second, mix(tokens[second - 1] * _U(0x9E3779B97F4A7C15) + tokens[second] + _PAIR)


def _counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how many of each are of training texts."""
    order = np.argsort(keys)
    keys, trained = keys[order], trained[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[begins], np.add.reduceat(trained.astype(np.int64), begins) if len(begins) else begins


def _pack(kind: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Words keep 64 bits of their hash, bigrams 48 besides their bucket; a count over 254 follows in full."""
    size = 8 if kind == _WORDS else 6
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join((np.array([len(keys)], "<u4").tobytes(), keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()))


def _unpack(kind: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 8 if kind == _WORDS else 6
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :size] = np.frombuffer(blob, np.uint8, n * size, 4).reshape(n, size)
    counts = np.frombuffer(blob, np.uint8, n, 4 + n * size).astype(np.int64)
    large = np.flatnonzero(counts == 255)
    counts[large] = np.frombuffer(blob, "<i8", len(large), 4 + n * size + n)
    return raw.view("<u8")[:, 0], counts


def _short(kind: int, keys: np.ndarray) -> np.ndarray:
    return keys if kind == _WORDS else keys & _U(0xFFFFFFFFFFFF)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _asked(got: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]], buckets: int) -> pa.RecordBatch:
    """One row a bucket: what each shard has of its n-grams, by kind."""
    sent: dict[int, list[tuple[int, int, bytes]]] = {}
    for (kind, shard), parts in got.items():
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        if len(parts) > 1:
            keys, counts = _counted(keys, counts)
        bucket = (mix(keys) % _U(buckets)).astype(np.int32 if buckets >> 15 else np.int16)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sent.setdefault(int(bucket[a]), []).append((kind, shard, _pack(kind, keys[a:b], counts[a:b])))
    columns = [list(sent), *([[row[i] for row in rows] for rows in sent.values()] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())), strict=True)], names=["bucket", "kinds", "shards", "blobs"])


def _ask(buckets: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            shards, train = batch.column("shard").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for i, j, words in word_slices(batch, BY_SPACE, lower=True):
                tokens, first = _tokens(words)
                doc = np.repeat(np.arange(i, j), np.diff(first))
                second, pairs = _pairs(tokens, first)
                for shard in np.unique(shards[i:j]).tolist():
                    for kind, keys, at in ((_WORDS, tokens, doc), (_PAIRS, pairs, doc[second])):
                        own = shards[at] == shard
                        got.setdefault((kind, shard), []).append(_counted(keys[own], train[at[own]]))
                size += len(words.data)
                if size >= 2 * SHARD_BYTES:
                    yield _asked(got, buckets)
                    got, size = {}, 0
        if got:
            yield _asked(got, buckets)

    return asked


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total counts that differ from a shard's own, for the shards that asked, and the number of training tokens and distinct ones."""
    asked: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for batch in batches:
        for bucket, *listed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kinds", "shards", "blobs")), strict=True):
            for kind, shard, blob in zip(*listed, strict=True):
                asked.setdefault((kind, bucket), []).append((shard, blob))
    n = v = 0
    replies: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for (kind, _), rows in asked.items():
        parts = [_unpack(kind, blob) for _, blob in rows]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        shard = np.repeat([s for s, _ in rows], [len(k) for k, _ in parts])
        order = np.argsort(keys)
        fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        sums = np.add.reduceat(counts[order], np.flatnonzero(fresh))
        if kind == _WORDS:
            n, v = n + int(sums.sum()), v + int((sums > 0).sum())
        totals = np.empty(len(keys), np.int64)
        totals[order] = sums[np.cumsum(fresh) - 1]
        other = totals != counts
        keys, totals, shard = keys[other], totals[other], shard[other]
        order = np.lexsort((keys, shard))
        keys, totals, shard = keys[order], totals[order], shard[order]
        once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1]))) if len(keys) else np.empty(0, bool)
        keys, totals, shard = keys[once], totals[once], shard[once]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            replies.setdefault((kind, int(shard[a])), []).append((keys[a:b], totals[a:b]))
    for (kind, shard), parts in replies.items():
        yield _batch([(kind, None, shard, _pack(kind, *(np.concatenate(x) for x in zip(*parts, strict=True))), None, None)])
    yield _batch([(_STATS, None, None, None, n, v)])


def _lookup(kind: int, asked: np.ndarray, trained: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """The total count of each key of a shard."""
    distinct, inverse = np.unique(_short(kind, asked), return_inverse=True)
    totals = np.bincount(inverse, weights=trained, minlength=len(distinct))
    for blob in answers:
        keys, counts = _unpack(kind, blob)
        at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
        there = distinct[at] == keys
        totals[at[there]] = counts[there]
    return totals[inverse]


def score_texts(docs: DataFrame, train: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of each row; rows with the SQL condition `train` teach. Result columns take the place of those in `keep` of their names."""
    carry, keep, back = hidden(others(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    spark = docs.sparkSession
    shard, shards = byte_shards(docs, SHARD_BYTES)
    shards = max(1, shards)
    parts = max(shuffle_partitions(spark), shards // 2)
    rows = docs.select(*carry, *(["text"] if "text" not in keep else []), shard.alias("_shard"), F.coalesce(F.expr(train), F.lit(True)).alias("_train"))
    asked = rows.select(F.col("_shard").alias("shard"), F.col("_train").alias("train"), "text").mapInArrow(lean(_ask(3 * parts)), _ASKED)
    answers = materialize(asked.repartition(parts, "bucket").mapInArrow(lean(_answer), _ROWS), "lm-counts")
    stats = answers.filter(F.col("kind") == _STATS).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = stats["n"] or 0, stats["v"] or 0
    unknown = DISCOUNT * v / n if n else 1.0

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = {kind: [b for k, b in zip(right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True) if k == kind] for kind in (_WORDS, _PAIRS)}
        batch = left.combine_chunks().to_batches()
        tokens, firsts, at = [], [np.zeros(1, np.int64)], 0
        for b in batch:
            for _, _, words in word_slices(b, BY_SPACE, lower=True):
                t, first = _tokens(words)
                tokens.append(t)
                firsts.append(first[1:] + at)
                at += len(t)
        token, first = np.concatenate([np.empty(0, _U), *tokens]), np.concatenate(firsts)
        trained = np.repeat(left.column("_train").to_numpy(), np.diff(first)).astype(float)
        count = _lookup(_WORDS, token, trained, blobs[_WORDS])
        root = np.where(count > 0, (count - DISCOUNT) / n, unknown) if n else np.ones(len(token))
        p = root.copy()
        second, pairs = _pairs(token, first)
        state = count[second - 1]  # 0: a word without a state leads back to the root
        arc = _lookup(_PAIRS, pairs, trained[second], blobs[_PAIRS])
        failed = MASS / (state + MASS) * root[second]  # of weight 1 from the root itself
        p[second] = np.where(arc > 0, (arc + MASS * root[second]) / (state + MASS), failed)
        total = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else np.empty(0)
        columns = {c: left.column(c) for c in keep} | {"n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(total((count > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(left.num_rows, n), pa.int64()), "base_score": pa.array(total(np.log10((count + 1) / (n + v + 1))), pa.float64()), "score": pa.array(total(np.log10(p)), pa.float64())}
        return pa.table(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    replies = answers.filter(F.col("kind") != _STATS).select("shard", "kind", "blob")
    table = rows.repartition(shards, "_shard").groupBy("_shard").cogroup(replies.repartition(shards, "shard").groupBy("shard"))
    scored = table.applyInArrow(traverse, f"{fields}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.select(*back, "n_tokens", "n_known", "train_tokens", "base_score", "score")
