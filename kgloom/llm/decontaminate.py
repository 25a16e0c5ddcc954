"""Benchmark decontamination (2): an FM-index over each training shard.

A shard is one Arrow batch of documents. Its words that occur in the benchmark
become symbols; a run of them at least as long as the shortest phrase is kept
with a separator after it (no phrase can occur anywhere else). The suffix array
of that sequence gives the Burrows-Wheeler transform, a wavelet matrix over it
answers rank, all phrases are searched backwards at once, and occurrences are
located by walking to sampled suffix positions. Hits become word spans, which
are merged.

The benchmark is collected in blocks of about BLOCK_BYTES of text by a hash of
its rows; a block's windows are made once, on the driver, and sent to the workers
as arrays; each block is one pass over the documents, without a shuffle.

Defined cases: a null text has no words; an item with a null id or without words
is no item; items that share an id are one; documents are kept row for row,
whatever repeats; with an empty benchmark nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import carries, lean, materialize
from kgloom.llm.words import BY_ALNUM, Words, slices, utf8, word_slices

BLOCK_BYTES = 8 << 20
#: Windows that are sought at once.
_ASKED = 1 << 18
#: Text of a training shard, which has an index of its own.
PIECE_BYTES = 8 << 20
#: One suffix in so many has its position stored.
SAMPLE_RATE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while n and rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.diff(key[order]) > 0
        rank[order] = np.cumsum(fresh)
        k *= 2
        if k >= n:
            break
    return order


class FMIndex:
    """Symbols are 0 to `top`; the text ends with the only 0."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        order = suffix_array(text)
        bwt = text[order - 1]  # index -1: the symbol before the first is the last
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.before[1:])
        self.bits = max(1, int(top).bit_length())
        self.levels, row = [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.zeros(len(row) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((bit, ones, len(row) - int(ones[-1])))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        sampled = order % SAMPLE_RATE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - sampled
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        low, i = np.zeros_like(i), i.copy()
        for b, (_, ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> b) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        i = i.copy()
        for bit, ones, zeros in self.levels:
            b = bit[i]
            out = out << 1 | b
            i = np.where(b == 1, zeros + ones[i], i - ones[i])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the rows of `patterns`, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.before[-1])
        left = np.arange(len(patterns))
        for step in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[left, step]
            low[left], high[left] = self.before[c] + self.rank(c, low[left]), self.before[c] + self.rank(c, high[left])
            left = left[high[left] > low[left]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to a sampled one, and as many steps forward."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.sampled[rows])
        while len(left):
            at = rows[left]
            c = self.access(at)
            rows[left] = self.before[c] + self.rank(c, at)
            steps[left] += 1
            left = left[~self.sampled[rows[left]]]
        return self.samples[self.sample_rank[rows]] + steps


@dataclass
class Phrases:
    """Distinct windows of a benchmark block, by length, and the items that have each; at most some 50 bytes for each word of the block."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 2; 1 separates runs, 0 ends the text
    symbols: np.ndarray  # all words of the block
    windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length, first words of windows in `symbols`, items of each window as CSR: starts, items
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((length for length, *_ in self.windows), default=0)


def _names(symbols: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal sequences of `length` symbols, by first symbol: numbers of twice the length from pairs of them."""
    names, have = symbols.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        names = np.unique(names[:-step] * (int(names.max(initial=0)) + 1) + names[step:], return_inverse=True)[1]
        have += step
    return names


def phrases(rows: list[tuple[str, str]], width: int) -> Phrases:
    """Windows of `width` words of the texts of rows (item, text), and whole texts of fewer."""
    items = sorted({i for i, _ in rows})
    place = {x: k for k, x in enumerate(items)}
    words = Words(*utf8(pa.array([t for _, t in rows], pa.string())), BY_ALNUM, lower=True)
    vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
    symbols = (symbols + 2).astype(np.int32)
    item, size = np.array([place[i] for i, _ in rows], np.int64)[words.doc], np.repeat(words.counts, words.counts)
    first = np.arange(len(symbols)) == words.first[:-1][words.doc]
    found = []
    for length in np.unique(np.minimum(words.counts[words.counts > 0], width)).tolist():
        at = np.flatnonzero((words.left >= width) if length == width else first & (size == length))
        names = _names(symbols, length)[at]
        pairs = np.unique(names * len(items) + item[at])
        distinct, where = np.unique(names, return_index=True)
        starts = np.searchsorted(pairs, np.append(distinct * len(items), np.iinfo(np.int64).max))
        found.append((length, at[where].astype(np.int32), starts.astype(np.int32), (pairs % len(items)).astype(np.int32)))
    return Phrases(vocabulary, symbols, found, items)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + count[i] - 1 of all i, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


class _Shard:
    """What a batch has of the benchmark's words."""

    def __init__(self, p: Phrases) -> None:
        self.p = p
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(p.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.words = 0

    def add(self, words: Words) -> None:
        h, short = words.hashes(), self.p.shortest
        symbol = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self.gate[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.p.vocabulary, h[may]), len(self.p.vocabulary) - 1)
        symbol[may] = np.where(self.p.vocabulary[at] == h[may], at + 2, 0)
        inside = symbol > 0
        begins, ends = inside.copy(), inside.copy()
        if len(h):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = words.first[(words.first > 0) & (words.first < len(h))]
            begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = end - start >= short
        start, end = start[long], end[long]
        if len(start):
            place = _spread(start, end - start + 1)  # with the word after the run, where the separator goes
            last = np.cumsum(end - start + 1) - 1
            run = symbol[np.minimum(place, len(h) - 1)]
            run[last] = 1
            self.symbols.append(run)
            self.places.append(place + self.words)
        self.words += len(h)

    def hits(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """First words of occurrences, their lengths, and (first words, items) of each length."""
        firsts, lengths, items = [], [], []
        if self.symbols:
            place = np.concatenate(self.places)
            index = FMIndex(np.concatenate((*self.symbols, [0])), len(self.p.vocabulary) + 1)
            here = np.diff(index.before) > 0
            for length, begins, starts, of in self.p.windows:
                for k in range(0, len(begins), _ASKED):
                    begin = begins[k : k + _ASKED].astype(np.int64)
                    asked = np.arange(len(begin))
                    for i in range(length):  # windows with a word that the shard lacks are not sought
                        asked = asked[here[self.p.symbols[begin[asked] + i]]]
                    low, high = index.search(self.p.symbols[begin[asked][:, None] + np.arange(length)].astype(np.int64))
                    there = np.flatnonzero(high > low)
                    n = high[there] - low[there]
                    first = place[index.locate(_spread(low[there], n))]
                    window = np.repeat(asked[there] + k, n)
                    count = (starts[window + 1] - starts[window]).astype(np.int64)
                    firsts.append(first)
                    lengths.append(np.full(len(first), length))
                    items.append((np.repeat(first, count), of[_spread(starts[window].astype(np.int64), count)]))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return join(firsts), join(lengths), items


def _scan(batch: pa.RecordBatch, p: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words, merged spans and items of each row."""
    shard, firsts = _Shard(p), [np.zeros(1, np.int64)]
    for _, _, words in word_slices(batch, BY_ALNUM, lower=True):
        firsts.append(words.first[1:] + shard.words)
        if p.windows:
            shard.add(words)
        else:
            shard.words += len(words.start)
    first = np.concatenate(firsts)
    at, length, pairs = shard.hits()
    doc_of = lambda x: np.searchsorted(first, x, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
    items: list[list[str]] = [[] for _ in range(batch.num_rows)]
    order = np.argsort(at, kind="stable")
    for a, n, d in zip(at[order].tolist(), length[order].tolist(), doc_of(at[order]).tolist(), strict=True):
        a -= int(first[d])
        _extend(spans[d], a, a + n)
    for a, of in pairs:
        for d, i in np.unique(np.stack((doc_of(a), of), 1), axis=0).tolist():
            items[d].append(p.items[i])
    return np.diff(first), spans, items


def _extend(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Add [a, b) to merged spans; a does not descend."""
    if spans and spans[-1][1] >= a:
        spans[-1] = (spans[-1][0], max(spans[-1][1], b))
    else:
        spans.append((a, b))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most PIECE_BYTES of text, or one row."""
    for batch in batches:
        for i, j in slices(utf8(batch.column("text"))[1], PIECE_BYTES):
            yield batch.slice(i, j - i)


_SPANS = "array<struct<first:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """(item id, text) of each block, and whether it is the last; cut by row, so that an item's rows may be in several. Each block is collected when it is asked for."""
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], k == n - 1


@carries("n_words", "spans", "items")
def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """`keep` (with the spans taken out of text if `cut`), n_words, spans (hit words, merged, [first, end)) and items (sorted) of each row.

    The result of each block but the last is written before the next is collected.
    """
    spark = docs.sparkSession
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    for k, (block, last) in enumerate(benchmark_blocks(benchmark, block_bytes)):
        carry = not last and "text" not in keep

        sought = spark.sparkContext.broadcast(phrases(block, width))  # bounded by block_bytes

        def scan(batches: Iterator[pa.RecordBatch], sought=sought, k=k, carry=carry, last=last) -> Iterator[pa.RecordBatch]:
            p = sought.value
            for batch in _pieces(batches):
                n_words, spans, items = _scan(batch, p)
                if k:
                    for d, (old, named) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                        merged: list[tuple[int, int]] = []
                        for a, b in sorted([*((s["first"], s["end"]) for s in old), *spans[d]]):
                            _extend(merged, a, b)
                        spans[d], items[d] = merged, items[d] + named
                if cut and last and any(spans):
                    batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([_without(t, [{"first": a, "end": b} for a, b in s]) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)], pa.string()))
                columns = {c: batch.column(c) for c in keep} | ({"text": batch.column("text")} if carry else {})
                columns |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], _ARROW_SPANS), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        rows = rows.mapInArrow(lean(scan), f"{fields}{', text string' if carry else ''}, n_words bigint, spans {_SPANS}, items array<string>")
        if not last:
            rows = materialize(rows, "decontaminated")
    return rows


def _without(text: str, spans: list[dict[str, int]]) -> str:
    """`text` without the spans' words, each from its first word's first byte to its last word's last."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), BY_ALNUM, lower=True)
    keep, at = [], 0
    for s in spans:
        keep.append(raw[at : int(words.start[s["first"]])])
        at = int(words.end[s["end"] - 1])
    return b"".join([*keep, raw[at:]]).decode()


def cut_spans(rows: DataFrame) -> DataFrame:
    """`rows` with the spans' words taken out of text, from the first word's first byte to the last word's last; n_chars, where there is one, counts anew."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = batch.column("text").to_pylist()
            for d in (d for d, s in enumerate(spans) if s):
                texts[d] = _without(texts[d], spans[d])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = rows.mapInArrow(lean(cut), rows.schema)
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in rows.columns else out
