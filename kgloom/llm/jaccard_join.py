"""N-gram Jaccard join (4): token-combination prefixes, then exact verification.

A document's tokens are its distinct shingles. Rare tokens come first, by hash,
then the frequent ones, by frequency. Two documents with Jaccard similarity of at
least PERCENT share at least two tokens of their prefixes of
    n - ceil(PERCENT n) + 2
tokens: one that is rare, or else two frequent ones. So each rare token of the
prefix is indexed alone, and the frequent ones in combinations of two. Where a
document has more than COMBINED frequent tokens in its prefix (it consists of
them), they are indexed alone; other documents meet such dense ones there too, but
not each other.

Documents with equal sets are one class. In a bucket each document is compared
with its leader first; what links is one component, and only pairs of different
components are looked at after that, so that a large group of near copies does not
give all its pairs. Two documents must share m tokens of their prefixes, as many as
    ceil(PERCENT (n_a + n_b) / (100 + PERCENT)) - max(n_a - prefix_a, n_b - prefix_b).
A document's tokens are put in order of how many documents meet at them, the most
crowded last: the first that two share has m - 1 more behind it in both, so
they are a candidate only where that many are left. Thus crowded tokens, which come
last, hardly make any; each document's last one makes none. Candidates are verified
on their whole sets; none is dropped. Within a bucket the test of two counts and
two sizes is still made for each pair of different components.

A task sends each bucket one document, the leader of those it has itself. The
leader is the document with the fewest rare tokens: of edited copies, the least edited.
Which tokens are frequent only decides their order. They come from counts of all
tokens, in 24 bits of the hash besides the bucket: the FREQUENT most frequent, if
they occur in at least LEAST documents. Buckets also have 24 bits besides
their number; a collision only adds a candidate.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing; with fewer words than a shingle the whole sequence is one; a null
doc_id has a null component; rows that share a doc_id share its component; every
row is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import connected_components, hinted, lean, materialize, shuffle_partitions
from kgloom.llm.words import BY_SPACE, Words, grams, mix, word_slices

SHINGLE, PERCENT = 5, 75
#: Which tokens are frequent, and how many of them are combined: these change the index and its size, never the links.
FREQUENT, LEAST = 200_000, 8
COMBINED = 12
_U = np.uint64
_SHORT = _U(0x5851F42D4C957F2D)
_RARE, _LIGHT, _DENSE, _PAIR = range(4)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each document, ascending, one document after another; where each begins)."""
    h, counts = words.hashes(), words.counts
    doc = words.doc
    n = len(h) - SHINGLE + 1
    full = np.flatnonzero(words.left[:n] >= SHINGLE) if n > 0 else np.empty(0, np.int64)
    token, of = (grams(h, SHINGLE)[full], doc[full]) if len(full) else (np.empty(0, _U), full)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [mix(grams(h[words.first[d] : words.first[d + 1]], int(counts[d])) + _SHORT) for d in short]
        token, of = np.concatenate((token, *whole)), np.concatenate((of, short))
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[fresh], of[fresh]
    return token, np.searchsorted(of, np.arange(len(counts) + 1))


def _slot(token: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 24 bits besides it."""
    return (token >> _U(24)) % _U(buckets), token & _U(0xFFFFFF)


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots (bucket * 2^24 + 24 bits), ascending, and document counts, of frequent tokens; the number of buckets."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = 16 * parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_slices(batch, BY_SPACE, lower=True):
                token, _ = shingle_sets(words)
                bucket, low = _slot(token, buckets)
                slot, count = np.unique(bucket << _U(24) | low, return_counts=True)
                bucket = (slot >> _U(24)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(slot) else np.zeros(1, np.int64)
                low, count = slot.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], np.minimum(count, 0xFFFF).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "low", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for b, low, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "n")), strict=True):
                got.setdefault(b, []).append((low, n))
        for b, rows in got.items():
            wide = np.zeros((sum(len(x) for x, _ in rows) // 3, 4), np.uint8)
            wide[:, :3] = np.frombuffer(b"".join(x for x, _ in rows), np.uint8).reshape(-1, 3)
            low, of = np.unique(wide.view("<u4")[:, 0], return_inverse=True)
            n = np.bincount(of, weights=np.frombuffer(b"".join(x for _, x in rows), "<u2")).astype(np.int64)
            often = n >= LEAST
            yield pa.RecordBatch.from_arrays([pa.array(low[often].astype(np.int64) + (b << 24)), pa.array(n[often])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(lean(counted), "bucket int, low binary, n binary").repartition(parts, "bucket").mapInArrow(lean(summed), "slot bigint, n bigint")
    top = rows.orderBy(F.desc("n"), "slot").limit(FREQUENT).toArrow()
    slot, n = top.column("slot").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(slot)
    return slot[order], n[order], buckets


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and two longs that equal sets share, of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_slices(batch, BY_SPACE, lower=True):
                token, first = shingle_sets(words)
                size = np.diff(first)
                sums = [np.add.reduceat(np.append(mix(token ^ _U(s)), _U(0)), first[:-1]) * (size > 0).astype(_U) for s in (0x1234567, 0x89ABCDEF01)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(size, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums)], names=["doc_id", "n", "sig_a", "sig_b"])

    return docs.select("doc_id", "text").mapInArrow(lean(signed), "doc_id bigint, n bigint, sig_a bigint, sig_b bigint")


def _prefix(own: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a document is indexed, and their kinds."""
    n = len(own)
    wide = min(n, n - -(-PERCENT * n // 100) + 2)
    rare = own[df == 0][:wide]
    if len(rare) == wide:
        return rare, np.full(wide, _RARE, np.uint8)
    often, f = own[df > 0], df[df > 0]
    often = often[np.lexsort((often, f))[: wide - len(rare)]]
    dense = len(often) > COMBINED
    x, y = np.triu_indices(0 if dense else len(often), 1)
    pairs = mix(np.minimum(often[x], often[y]) * _U(0x9E3779B97F4A7C15) + np.maximum(often[x], often[y]))
    kinds = np.repeat(np.array([_RARE, _DENSE if dense else _LIGHT, _PAIR], np.uint8), [len(rare), len(often), len(pairs)])
    return np.concatenate((rare, mix(often + _U(7)), pairs)), kinds


_MET = "bucket int, slot bigint, kind int, doc_id bigint, leader bigint, blob binary"
_MET_ARROW = pa.schema([("bucket", pa.int32()), ("slot", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("leader", pa.int64()), ("blob", pa.binary())])


def _grouped(slot: np.ndarray, kind: np.ndarray, rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by slot with leaders (of least rank) first, each one's leader (the first of its slot; -1 if that is light), and the slot's size."""
    order = np.lexsort((doc, rank, kind == _LIGHT, slot))
    fresh = np.concatenate(([True], slot[order][1:] != slot[order][:-1]))
    begins = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    first = order[begins][of]
    return order, np.where(kind[first] == _LIGHT, -1, first), np.diff(np.append(begins, len(order)))[of]


def _met(slot: np.ndarray, kind: np.ndarray, doc: np.ndarray, leader: np.ndarray) -> Iterator[pa.RecordBatch]:
    """leader: row of each one's leader, or -1."""
    for k in range(0, len(slot), 100_000):
        at = slice(k, k + 100_000)
        n = len(slot[at])
        heads = pa.array(np.where(leader[at] < 0, 0, leader[at]), mask=leader[at] < 0)
        yield pa.RecordBatch.from_arrays([pa.array((slot[at] >> 24).astype(np.int32)), pa.array(slot[at]), pa.array(kind[at].astype(np.int32)), pa.array(doc[at]), heads, pa.nulls(n, pa.binary())], schema=_MET_ARROW)


def _meetings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """slot, kind, doc_id, leader: documents that share a bucket with others; leader is null where only light ones meet."""
    slots, counts, buckets = frequent
    parts = shuffle_partitions(docs.sparkSession)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for i, j, words in word_slices(batch, BY_SPACE, lower=True):
                token, first = shingle_sets(words)
                bucket, low = _slot(token, buckets)
                slot = (bucket << _U(24) | low).astype(np.int64)
                at = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
                df = np.where(slots[at] == slot, counts[at], 0) if len(slots) else np.zeros(len(slot), np.int64)
                found = [_prefix(token[a:b], df[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                doc = np.repeat(ids[i:j], [len(k) for k, _ in found])
                bucket, low = _slot(mix(np.concatenate([k for k, _ in found])), buckets)
                slot, kind = (bucket << _U(24) | low).astype(np.int64), np.concatenate([k for _, k in found])
                if not len(slot):
                    continue
                alone = np.add.reduceat(np.append(df == 0, False), first[:-1]) * (np.diff(first) > 0)
                rank = np.repeat(np.minimum(alone, 0xFFFF), [len(k) for k, _ in found])
                order, leader, size = _grouped(slot, kind, rank, doc)
                slot, kind, rank, by = slot[order], kind[order], rank[order], doc[order]
                here = (size > 1) | (kind == _LIGHT) | (kind == _DENSE)
                yield from _met(slot[here], kind[here], by[here], np.where(leader[here] < 0, -1, doc[leader[here]]))
                sent = np.flatnonzero(leader == order)
                slot, kind, rank, by = slot[sent], kind[sent], rank[sent], by[sent]
                cuts = np.flatnonzero(np.concatenate(([True], slot[1:] >> 24 != slot[:-1] >> 24, [True]))) if len(slot) else np.zeros(1, np.int64)
                low3 = (slot & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                blobs = [b"".join((np.array([b - a], "<u4").tobytes(), by[a:b].astype("<i8").tobytes(), low3[a:b].tobytes(), kind[a:b].tobytes(), rank[a:b].astype("<u2").tobytes())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array((slot[cuts[:-1]] >> 24).astype(np.int32)), *(pa.nulls(n, t) for t in _MET_ARROW.types[1:5]), pa.array(blobs, pa.binary())], schema=_MET_ARROW)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[int, bytes]] = []
        for batch in batches:
            yield batch.filter(batch.column("blob").is_null())
            sent = batch.filter(batch.column("blob").is_valid())
            got += zip(sent.column("bucket").to_pylist(), sent.column("blob").to_pylist(), strict=True)
        if not got:
            return
        docs_, lows, kinds, ranks, sizes = [], [], [], [], []
        for _, blob in got:
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            docs_.append(np.frombuffer(blob, "<i8", n, 4))
            lows.append(np.frombuffer(blob, np.uint8, 3 * n, 4 + 8 * n).reshape(n, 3))
            kinds.append(np.frombuffer(blob, np.uint8, n, 4 + 11 * n))
            ranks.append(np.frombuffer(blob, "<u2", n, 4 + 12 * n))
            sizes.append(n)
        wide = np.zeros((sum(sizes), 4), np.uint8)
        wide[:, :3] = np.concatenate(lows)
        slot = np.repeat(np.array([b for b, _ in got], np.int64), sizes) << 24 | wide.view("<u4")[:, 0]
        doc, kind = np.concatenate(docs_), np.concatenate(kinds)
        order, leader, size = _grouped(slot, kind, np.concatenate(ranks), doc)
        some = size > 1
        yield from _met(slot[order][some], kind[order][some], doc[order][some], doc[leader[some]])

    rows = docs.select("doc_id", "text").mapInArrow(lean(indexed), _MET).repartition(parts, "bucket").mapInArrow(lean(led), _MET)
    return rows.select("slot", "kind", "doc_id", "leader")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, tokens of the documents in `ids`."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_slices(batch, BY_SPACE, lower=True):
                token, first = shingle_sets(words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(token.view(np.int64)))], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").join(hinted(ids), "doc_id", "left_semi").mapInArrow(lean(sets), "doc_id bigint, tokens array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets reach the similarity."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"t_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.select("a", "b", shared.alias("o"), (F.size("t_a") + F.size("t_b")).alias("s")).filter(F.expr(f"100L * o >= {PERCENT}L * (s - o)")).select("a", "b")


def _width(n: Column) -> Column:
    return F.least(n, n - F.ceil(n * PERCENT / F.lit(100)) + 2)


def _alike(n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def _needed(n_a: Column, n_b: Column) -> Column:
    """How many tokens of both prefixes sets of these sizes share at least if they reach the similarity."""
    least = F.ceil((n_a + n_b) * PERCENT / F.lit(100 + PERCENT))
    return least - F.greatest(n_a - _width(n_a), n_b - _width(n_b))


def _able(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, c, n_a, n_b) whose sizes, and c shared tokens of the prefixes, allow the similarity."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return pairs.filter(_alike(n_a, n_b) & (F.col("c") >= _needed(n_a, n_b))).select("a", "b")


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """`pairs` with n_a and n_b."""
    x, y = (sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b")


def _verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    pairs = materialize(pairs, f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(_sets(docs, ids).dropDuplicates(["doc_id"]), f"{name}-sets")
    return materialize(_linked(pairs, sets), f"{name}-links")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reached by links) of each row."""
    index = materialize(_signatures(docs), "signatures")
    classes = index.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    several = materialize(classes.filter("members > 1"), "classes")
    copies = index.select("doc_id", "sig_a", "sig_b").join(hinted(several), ["sig_a", "sig_b"]).filter("doc_id <> rep").select("doc_id", "rep")
    copies = materialize(copies.distinct(), "copies")

    alone = docs.filter("doc_id IS NOT NULL").join(hinted(copies.select("doc_id")), "doc_id", "left_anti")
    met = materialize(_meetings(alone, frequent_tokens(docs)), "meetings")
    sizes = index.groupBy("doc_id").agg(F.max("n").alias("n"))

    own = met.filter("leader <> doc_id").groupBy("doc_id", "leader").agg(F.count("*").alias("c"))
    own = own.groupBy("doc_id").agg(F.max_by(F.struct("leader", "c"), F.struct("c", -F.col("leader"))).alias("best"))
    # Other shared tokens have other leaders, so the bound is eased here; what it passes over is looked at below.
    first = own.select(F.col("best.leader").alias("a"), F.col("doc_id").alias("b"), (F.col("best.c") * 3 + 10).alias("c"))
    first = materialize(first, "leaders")
    over = first.join(first.select(F.col("b").alias("a"), F.col("a").alias("above")), "a").filter("above <> b").select(F.col("above").alias("a"), "b", "c")
    star = _verified(_able(_sized(first.unionByName(over).dropDuplicates(["a", "b"]), sizes)), docs, "star")

    found = connected_components(star)
    single = met.filter(F.col("kind") != _PAIR).select("slot", "doc_id").distinct()
    placed = single.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(sizes, "doc_id").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialize(placed, "placed")
    open_slots = placed.groupBy("slot").agg(F.count("*").alias("members"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("slot", "members")
    # tail: how many of the document's slots are left from this one on, the most crowded last
    last = Window.partitionBy("doc_id").orderBy(F.desc("members"), F.desc("slot"))
    still = placed.join(open_slots, "slot").withColumn("tail", F.row_number().over(last)).filter("tail > 1").select("slot", "doc_id", "component", "n", "tail")
    still = materialize(still, "open")
    left, right = (still.select("slot", F.col("doc_id").alias(c), F.col("component").alias(f"c_{c}"), F.col("n").alias(f"n_{c}"), F.col("tail").alias(f"t_{c}")) for c in "ab")
    able = (F.col("c_a") < F.col("c_b")) & _alike(F.col("n_a"), F.col("n_b")) & (F.least("t_a", "t_b") >= _needed(F.col("n_a"), F.col("n_b")))
    rest = _verified(left.join(right, "slot").filter(able).select("a", "b").distinct(), docs, "rest")

    found = connected_components(star.unionByName(rest)).withColumnRenamed("component", "of")
    rows = index.select("doc_id", "n").join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = rows.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of", "rep").alias("component_id"))
