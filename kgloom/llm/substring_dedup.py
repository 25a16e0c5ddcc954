"""Substring dedup (6): seed and extend.

Every window of LENGTH words selects one anchor, the least hash of its WIDTH
consecutive SEED-word seeds (winnowing), so equal windows select equal anchors.
Occurrences of an anchor in different documents are joined by its hash; each
carries the windows that selected it, the match extended as far both ways as the
length threshold needs, and a window that also occurs in a document with a
smaller doc_id is a repeat. Overlapping repeats join to maximal spans.

An occurrence that a task has already seen in a document with a smaller id is a
repeat at once and is not sent, so a common passage goes to its bucket at most
once per slice of text. Windows are compared by the 64-bit hash of their anchor
and 48 bits of their own.

Defined cases: a null text has no words; texts of equal doc_id never remove each
other's words; a row with a null doc_id neither loses words nor counts as an
earlier document; rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import carries, lean, shuffle_partitions
from kgloom.llm.words import BY_SPACE, Words, grams, mix, word_slices

LENGTH, SEED = 13, 5
WIDTH = LENGTH - SEED + 1
_STEP = 0x9E3779B97F4A7C15
_U = np.uint64
_STEPS = np.array([pow(_STEP, i + 1, 1 << 64) for i in range(WIDTH)], _U)
_ROWS = "bucket int, doc_id bigint, key bigint, mask int, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("mask", pa.int32()), ("blob", pa.binary())])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + count[i] - 1 of all i, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


class _Runs:
    """Windows of some documents, in runs that selected the same anchor occurrence."""

    def __init__(self, words: Words) -> None:
        h = words.hashes()
        n = len(h) - LENGTH + 1
        valid = np.flatnonzero(words.left[:n] >= LENGTH) if n > 0 else np.empty(0, np.int64)
        self.first = self.count = self.doc = valid[:0]
        self.anchor = self.windows = self.key = np.empty(0, _U)
        if not len(valid):
            return
        seeds, whole = grams(h, SEED), grams(h, LENGTH)
        best, at = seeds[:n].copy(), np.arange(n)
        for j in range(1, WIDTH):
            better = seeds[j : j + n] < best
            best[better] = seeds[j : j + n][better]
            at[better] = np.flatnonzero(better) + j
        chosen = at[valid]
        begins = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        self.count = np.diff(np.concatenate((begins, [len(valid)])))
        self.first = valid[begins]
        self.doc = np.searchsorted(words.first, self.first, "right") - 1
        self.anchor = best[valid[begins]]
        self.windows = whole[valid] & _U(0xFFFFFFFFFFFF)
        self.key = run_keys(self.anchor, self.count, self.windows)


def run_keys(anchor: np.ndarray, count: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """One hash of an anchor and its windows for each run."""
    if not len(anchor):
        return np.empty(0, _U)
    place = spread(np.zeros(len(count), np.int64), count)
    sums = np.add.reduceat(windows * _STEPS[place], np.cumsum(count) - count)
    return mix(anchor + sums)


def _pack(anchor: np.ndarray, doc: np.ndarray, count: np.ndarray, windows: np.ndarray) -> bytes:
    base = int(doc.min())
    narrow = int(doc.max()) - base < 1 << 32
    docs = (doc - base).astype("<u4" if narrow else "<i8") if narrow else doc.astype("<i8")
    head = np.array([len(anchor), base, narrow], "<i8").tobytes()
    return b"".join((head, anchor.astype("<u8").tobytes(), docs.tobytes(), count.astype(np.uint8).tobytes(), windows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base, narrow = np.frombuffer(blob, "<i8", 3).tolist()
    p = 24
    anchor, p = np.frombuffer(blob, "<u8", n, p), p + 8 * n
    size = 4 if narrow else 8
    doc, p = np.frombuffer(blob, f"<{'u' if narrow else 'i'}{size}", n, p).astype(np.int64) + (base if narrow else 0), p + size * n
    count, p = np.frombuffer(blob, np.uint8, n, p).astype(np.int64), p + n
    raw = np.zeros((int(count.sum()), 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * len(raw), p).reshape(-1, 6)
    return anchor, doc, count, raw.view("<u8")[:, 0]


def _flags(doc: np.ndarray, key: np.ndarray, mask: np.ndarray, buckets: int) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array((key % _U(buckets)).astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(mask.astype(np.int32)), pa.nulls(n, pa.binary())], schema=_ARROW)


def _seeds(buckets: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for i, _, words in word_slices(batch, BY_SPACE, lower=False):
                runs = _Runs(words)
                if not len(runs.key):
                    continue
                doc = ids[i + runs.doc]
                order = np.lexsort((doc, runs.key))
                key, by = runs.key[order], doc[order]
                fresh = np.concatenate(([True], key[1:] != key[:-1]))
                least = by[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                later = (by > least) & (fresh | np.concatenate(([True], by[1:] != by[:-1])))
                if later.any():
                    yield _flags(by[later], key[later], (1 << runs.count[order][later]) - 1, buckets)
                sent = order[fresh]
                bucket = (mix(runs.anchor[sent]) % _U(buckets)).astype(np.int64)
                sent, bucket = sent[np.argsort(bucket, kind="stable")], np.sort(bucket)
                starts = np.cumsum(runs.count) - runs.count
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                blobs = [_pack(runs.anchor[s], doc[s], runs.count[s], runs.windows[spread(starts[s], runs.count[s])]) for s in (sent[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(blobs, pa.binary())], schema=_ARROW)

    return found


def _extend(buckets: int):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            sent = batch.column("blob").is_valid()
            yield batch.filter(batch.column("blob").is_null())
            blobs += batch.column("blob").filter(sent).to_pylist()
        if not blobs:
            return
        anchor, doc, count, windows = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        del blobs
        starts = np.cumsum(count) - count
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        often = np.zeros(len(anchor), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        runs = np.flatnonzero(often)
        if not len(runs):
            return
        place = spread(starts[runs], count[runs])
        run = np.repeat(np.arange(len(runs)), count[runs])
        bit = spread(np.zeros(len(runs), np.int64), count[runs])
        wide, by = mix(anchor[runs][run] + windows[place] * _U(_STEP)), doc[runs][run]
        order = np.lexsort((by, wide))
        fresh = np.concatenate(([True], wide[order][1:] != wide[order][:-1]))
        least = np.empty(len(order), np.int64)
        least[order] = by[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        mask = np.bitwise_or.reduceat(np.where(by > least, 1 << bit, 0), np.cumsum(count[runs]) - count[runs])
        some = np.flatnonzero(mask)
        keys = run_keys(anchor[runs], count[runs], windows[place])
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield _flags(doc[runs][part], keys[part], mask[part], buckets)

    return matched


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, _runs (array of key and mask): the runs of windows of a document of which some occur in an earlier one."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = 16 * parts
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(_seeds(buckets)), _ROWS).repartition(parts, "bucket").mapInArrow(lean(_extend(buckets)), _ROWS)
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "mask")).alias("_runs"))


@carries("n_words", "n_removed", "spans", "kept_text")
def dedup_substrings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_removed, spans (removed words, [first, end)) and kept_text (kept words, joined by one space) of each row; result columns take the place of those in `keep` of their names."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("_runs")
            sizes = listed.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = listed.flatten()
            keys, masks = flat.field("key").to_numpy().view(np.uint64), flat.field("mask").to_numpy()
            ends = np.cumsum(sizes)
            for i, j, words in word_slices(batch, BY_SPACE, lower=False):
                n = j - i
                runs = _Runs(words)
                a, b = int(ends[i] - sizes[i]), int(ends[j - 1])
                gone = np.zeros(len(words.start) + 1, np.int64)
                if b > a:
                    salt = lambda x: mix(x.astype(_U) + _U(1))
                    known = keys[a:b] ^ salt(np.repeat(np.arange(n), sizes[i:j]))
                    order = np.argsort(known, kind="stable")
                    known, of = known[order], masks[a:b][order]
                    wanted = runs.key ^ salt(runs.doc)
                    hit = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    for step in range(int(np.unique(known, return_counts=True)[1].max())):  # a key may have masks from tasks and from its bucket
                        place = hit + step
                        inside = np.minimum(place, len(known) - 1)
                        same = (known[inside] == wanted) & (place < len(known))
                        mask = np.where(same, of[inside], 0)
                        for bit in range(WIDTH):
                            at = runs.first[(mask >> bit) & 1 == 1] + bit
                            np.add.at(gone, at, 1)
                            np.add.at(gone, at + LENGTH, -1)
                drop = np.cumsum(gone[:-1]) > 0
                removed_words = np.bincount(words.doc[drop], minlength=n)
                left = np.flatnonzero(~drop)
                length = words.end[left] - words.start[left] + 1
                data = np.append(words.data, np.uint8(32))[np.minimum(spread(words.start[left], length), len(words.data))]
                closing = np.cumsum(length) - 1
                data[closing] = 32
                kept = np.bincount(words.doc[left], weights=length, minlength=n).astype(np.int64)
                raw, stops = data.tobytes(), np.cumsum(kept)
                texts = [raw[e - k : max(e - k, e - 1)].decode() for e, k in zip(stops.tolist(), kept.tolist(), strict=True)]
                edge = np.zeros(len(drop) + 1, np.int64)
                if len(drop):
                    edge[:-1] = drop & np.concatenate(([True], ~drop[:-1] | (words.doc[1:] != words.doc[:-1])))
                span_first = np.flatnonzero(edge[:-1])
                close = drop & np.concatenate((~drop[1:] | (words.doc[1:] != words.doc[:-1]), [True])) if len(drop) else drop
                span_end = np.flatnonzero(close) + 1
                spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
                for d, x, y in zip(words.doc[span_first].tolist(), span_first.tolist(), span_end.tolist(), strict=True):
                    spans[d].append({"first": x - int(words.first[d]), "end": y - int(words.first[d])})
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in keep), pa.array(words.counts, pa.int64()), pa.array(removed_words, pa.int64()), pa.array(spans, spans_type), pa.array(texts, pa.string())], names=[*keep, "n_words", "n_removed", "spans", "kept_text"])

    rows = docs.select(*dict.fromkeys((*keep, "doc_id", "text"))).join(repeated_runs(docs), "doc_id", "left")
    return rows.select(*dict.fromkeys((*keep, "text")), "_runs").mapInArrow(lean(removed), f"{fields}, n_words bigint, n_removed bigint, spans array<struct<first:bigint,end:bigint>>, kept_text string")
