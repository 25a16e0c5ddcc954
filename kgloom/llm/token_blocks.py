"""Token-ID / binary output (10): patched frame-of-reference blocks.

A segment is one binary value: documents in ascending doc_id order, their ids in
blocks of 256. Each block stores its minimum, the residuals packed at a width
that fits a chosen percentile of them, and an exception list for the rest; an
index holds where each block starts, so any block can be read alone. Segments
are written by Spark's Parquet writer (one row a segment, uncompressed pages),
so that writing is atomic, survives lost executors and works on any store.

Layout of a segment, little-endian:
    magic "PFB1", n_docs u32, n_ids u64, n_blocks u32
    doc ids i64[n_docs] (null flags u8[n_docs]), ids of each document u32[n_docs]
    block starts u64[n_blocks + 1], counted from the first block
    blocks: minimum u32, width u8, exceptions u16, packed bits,
            exception places u8[], exception residuals u32[]

Defined cases: a null text is empty and has the end id alone; equal doc_ids are
ordered by text, then kept each; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import CACHE, give_back, lean, shared_dir, shuffle_partitions, small_batches
from kgloom.llm.words import slices, utf8

BLOCK = 256
#: Residuals up to this share of a block are packed; larger ones become exceptions.
PERCENTILE = 0.9
#: A segment is closed at so many ids.
SEGMENT_IDS = 1 << 20
#: A space beside other white space: a tokenizer may join pieces across it, as byte_bpe_50k does for spaces and U+00A0 by turns.
_RUNS = r"[{0}] | [{0}]".format(r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
#: Words whose ids a worker keeps; when full it drops those met once.
CACHE_WORDS = 1 << 19
#: Parts of 500 words that are encoded at once, and bytes of text that are worked on at once.
_AT_ONCE, _SLICE = 16, 3 << 20
_MAGIC = b"PFB1"


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(where each block starts, with the end; the blocks' bytes)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint64), b""
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    pivot = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.int64)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(1)
    size = 7 + BLOCK // 8 * width + 5 * exceptions
    starts = np.zeros(blocks + 1, np.uint64)
    np.cumsum(size, out=starts[1:])
    out = bytearray(int(starts[-1]))
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        low_bits = (rest[at] & np.uint32((1 << int(w)) - 1)).astype("<u4")
        bits = np.unpackbits(low_bits.view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        rows = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        for i, row in zip(at.tolist(), rows, strict=True):
            packed[i] = row.tobytes()
    for i in range(blocks):
        places = np.flatnonzero(over[i])
        out[int(starts[i]) : int(starts[i + 1])] = struct.pack("<IBH", int(low[i]), int(width[i]), len(places)) + packed[i] + places.astype(np.uint8).tobytes() + rest[i, places].astype("<u4").tobytes()
    return starts, bytes(out)


def decode_blocks(starts: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """The ids of encode_blocks."""
    blocks = len(starts) - 1
    if not blocks:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    at = starts[:-1].astype(np.int64)
    low = sum(raw[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    width, exceptions = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64) | raw[at + 6].astype(np.int64) << 8
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = raw[(at[rows] + 7)[:, None] + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
        wide[:, :, :w] = bits
        rest[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i in np.flatnonzero(exceptions):
        k, p = int(exceptions[i]), int(at[i] + 7 + BLOCK // 8 * width[i])
        rest[i, raw[p : p + k]] = np.frombuffer(data, "<u4", k, p + k)
    return (rest + low[:, None]).reshape(-1)[:n]


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join((_MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(starts) - 1), numbers.tobytes(), nulls.tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), blocks))


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each document, all ids)."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks = struct.unpack_from("<IQI", data, 4)
    p = 20
    numbers, p = np.frombuffer(data, "<i8", n_docs, p), p + 8 * n_docs
    nulls, p = np.frombuffer(data, np.uint8, n_docs, p), p + n_docs
    lengths, p = np.frombuffer(data, "<u4", n_docs, p), p + 4 * n_docs
    starts, p = np.frombuffer(data, "<u8", n_blocks + 1, p), p + 8 * (n_blocks + 1)
    return [None if z else x for x, z in zip(numbers.tolist(), nulls.tolist(), strict=True)], lengths, decode_blocks(starts, data[p:], n_ids)


class _Encoder:
    """The tokenizers library with the ids of words it has seen.

    A byte-level tokenizer without normalizer never joins pieces across a space
    that stands between characters other than white space, so each space-led word
    can be encoded alone; texts where a space touches other white space (`_RUNS`)
    are encoded whole, as are all texts with other kinds of tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
        #: By id: whether the token begins with a space, as the first of each space-led word does.
        self.leads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self._clear()

    def _clear(self) -> None:
        """Words as they follow a space; where each one's ids are, and whether a later slice had it too."""
        self.words = pa.array([], pa.large_string())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.starts, self.again = np.zeros(0, np.int64), np.zeros(0, bool)

    def _trim(self) -> None:
        """Only words that were met again stay; none do if those are many."""
        keep, words, starts, sizes, ids = self.again, self.words, self.starts, self.sizes, self.ids
        self._clear()
        if 2 * keep.sum() > CACHE_WORDS:
            return
        self.words, self.sizes, self.again = words.filter(pa.array(keep)), sizes[keep], np.zeros(int(keep.sum()), bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids[np.arange(self.sizes.sum()) + np.repeat(starts[keep] - self.starts, self.sizes)]

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct `words`. Encodes many new ones as one text, and cuts its ids where a token begins with a space."""
        if len(self.starts) + len(words) > CACHE_WORDS:
            self._trim()
        rows = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.again[rows[rows >= 0]] = True
        gone = np.flatnonzero(rows < 0)
        if not len(gone):
            return rows
        new = words.take(pa.array(gone))
        texts = new.to_pylist()
        parts = [texts[k : k + 500] for k in range(0, len(texts), 500)]
        # An empty word is a space alone, which the next one would join; it stands at the end of a part.
        blank = [p.index("") if "" in p else None for p in parts]
        ids = []
        for k in range(0, len(parts), _AT_ONCE):  # what the library returns is many times as large as the ids
            joined = [" " + " ".join(w for w in p if w) if any(p) else "" for p in parts[k : k + _AT_ONCE]]
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat, lone = np.concatenate(ids), np.array(self.tokenizer.encode(" ", add_special_tokens=False).ids, np.uint32)
        sizes = np.diff(np.append(np.flatnonzero(self.leads[flat]), len(flat)))
        for k in (k for k, at in enumerate(blank) if at is not None):
            at = 500 * k + blank[k]
            flat = np.insert(flat, int(sizes[:at].sum()), lone)
            sizes = np.insert(sizes, at, len(lone))
        if len(sizes) != len(texts):
            raise ValueError("a word's first token does not begin with a space")
        rows[gone] = np.arange(len(self.starts), len(self.starts) + len(gone))
        self.words = pa.concat_arrays([self.words, new])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, flat))
        self.again = np.concatenate((self.again, np.zeros(len(gone), bool)))
        return rows

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null one has none."""
        texts = pc.fill_null(texts, "")
        runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(runs).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        rest = np.flatnonzero(~runs)
        if len(rest):
            split = pc.split_pattern(texts.take(pa.array(rest)).cast(pa.large_string()), " ")
            first = split.offsets.to_numpy()[:-1].astype(np.int64)
            flat = split.flatten()
            heads = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(flat.take(pa.array(first)).to_pylist(), add_special_tokens=False)]
            follows = np.ones(len(flat), bool)
            follows[first] = False
            coded = flat.filter(pa.array(follows)).dictionary_encode()
            row = self._rows(coded.dictionary)[coded.indices.to_numpy()]
            size = self.sizes[row]
            end = np.cumsum(size)
            total = int(end[-1]) if len(end) else 0
            ids = self.ids[np.arange(total) + np.repeat(self.starts[row] - end + size, size)]
            ends = np.append(0, end)[np.cumsum(np.diff(np.append(first, len(flat))) - 1)]
            for i, head, x in zip(rest.tolist(), heads, np.split(ids, ends[:-1]), strict=True):
                out[i] = np.concatenate((head, x))
        return out


def _encoder(path: str) -> _Encoder:
    """The encoder that this worker has kept, if it is for the same tokenizer."""
    kept = CACHE.get("tokens")
    if kept is None or kept[0] != path:
        kept = CACHE["tokens"] = (path, _Encoder(path))
        give_back()
    return kept[1]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text, append `end_id`, and write segments to the folder `path` in ascending doc_id order.

    Rows: part (files of ascending doc_id), place (of the segment in its part),
    start (ids of earlier segments of the part), n_ids, segment (bytes).
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, got, n, place, start = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in got], np.uint32)
            data = encode_segment(doc_ids, lengths, np.frombuffer(b"".join(got), "<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "start": start, "n_ids": n, "segment": data}], schema=pa.schema([("part", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())]))

        for batch in batches:
            for i, j in slices(utf8(batch.column("text"))[1], _SLICE):
                rows = batch.slice(i, j - i)
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text")), strict=True):
                    doc_ids.append(doc)
                    got.append(ids.astype("<u4").tobytes() + end)
                    n += len(ids) + 1
                    if n >= SEGMENT_IDS:
                        yield closed()
                        doc_ids, got, n, place, start = [], [], 0, place + 1, start + n
        if doc_ids:
            yield closed()

    in_order = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")  # bounds go to the driver, so only a beginning
    coded = in_order.mapInArrow(lean(segments, "tokens"), "part int, place bigint, start bigint, n_ids bigint, segment binary")
    with small_batches(spark):
        coded.write.option("compression", "none").parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids of all earlier parts; as many rows as the writer had partitions."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    rows, before = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "part int, before bigint")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of segments: doc_id, start, n_tokens, ids_crc32 of each document, and its ids as little-endian u32 bytes."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("segment"), strict=True):
                doc_ids, lengths, ids = decode_segment(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([part] * len(doc_ids), pa.int32()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "part", "inner", "n_tokens", "ids_crc32", "ids"])

    rows = spark.read.parquet(path).select("part", "start", "segment").mapInArrow(lean(documents), "doc_id bigint, part int, inner bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write `docs` as token segments (to `path`, else a new folder in the shared one) and read them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
