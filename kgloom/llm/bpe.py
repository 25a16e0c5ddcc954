"""BPE encoding and decoding (12): a segment tree over the ranks of adjacent pairs.

Each piece of a text starts as one symbol a byte, the last one marked as a word
end. A segment tree over the pairs of neighbours holds the least (rank, place) of
each range: its root is the leftmost pair of the lowest rank. A merge changes
three leaves, so a piece of n bytes takes O(n log n), however long it is; the
tree is empty of ranks when nothing can be merged. Pieces that occur again are
looked up, not merged again.

Reads tokenizer files of one kind: BPE with word ends over bytes; NFC, white
space as one space, lower case; special tokens that are matched in the raw text.

Defined cases: a null or empty text has no ids, and no ids decode to an empty
text; each row is encoded alike, whatever its id and however often it occurs; an
id that the vocabulary lacks is left out by the decoder; null ids decode to null;
columns in `keep` stay as they are, but one that has the name of the result
column gives way to it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import CACHE, lean, others

#: Pieces that a worker remembers before those that it has not met since are forgotten.
CACHE_PIECES = 1 << 18
#: Text bytes, or ids, that are worked on at once.
_SLICE = 1 << 20
#: Characters that all versions of Unicode since 13 class and lower alike; texts with others are normalised and split by the tokenizer's own parts.
_SETTLED = regex.compile(r"[\x00-\u0557\u2010-\u205e\u3000-\u312e\u3131-\u318e\u4e00-\u9ffc\uac00-\ud7a3]*")
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PairTree:
    """Symbols in a row, and a segment tree over the ranks of neighbours."""

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], int]) -> None:
        n = len(symbols)
        self.symbols, self.ranks = symbols, ranks
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.size = 1 << (n - 1).bit_length()
        self.tree = [_NONE] * (2 * self.size)
        for i in range(n - 1):
            self.tree[self.size + i] = self._leaf(i, i + 1)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _leaf(self, i: int, j: int) -> int:
        """(rank, place) of a pair as one number."""
        rank = self.ranks.get((self.symbols[i], self.symbols[j]))
        return _NONE if rank is None else rank << 32 | i

    def _put(self, i: int, value: int) -> None:
        tree, k = self.tree, self.size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                return
            tree[k] = least

    def merged(self, results: list[int]) -> list[int]:
        """The symbols when no pair is left that has a rank; `results` has the symbol of each rank."""
        symbols, after, n = self.symbols, self.after, len(self.symbols)
        while n > 1 and (least := self.tree[1]) != _NONE:
            i = least & _PLACE
            gone = after[i]
            symbols[i], after[i] = results[least >> 32], after[gone]
            self._put(gone, _NONE)
            if after[i] < n:
                self.before[after[i]] = i
                self._put(i, self._leaf(i, after[i]))
            else:
                self._put(i, _NONE)
            if self.before[i] >= 0:
                self._put(self.before[i], self._leaf(self.before[i], i))
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out


class WordBpe:
    """A tokenizer file: pieces of a text, ids of a piece, tokens of ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (pre or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != _NORMALIZERS or splits != ["Split", "ByteLevel"] or spec["decoder"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no BPE of words with ends over lowered text")
        split = pre["pretokenizers"][0]
        if not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError(f"{path} keeps what stands between its pieces")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + model["end_of_word_suffix"]] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.results = [vocabulary[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        tokens = {i: t for t, i in (vocabulary | self.special).items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())
        self.known = _Known(self, {})

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        return PairTree([*(self.inner[b] for b in piece[:-1]), self.final[piece[-1]]], self.ranks).merged(self.results)

    def _plain(self, text: str) -> list[str | bytes]:
        """Pieces of a text without special tokens; those that the tokenizer's own parts made, as bytes."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if not _SETTLED.fullmatch(text):
            return [bytes(self.byte[c] for c in p) for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())  # sigma is lowered alike at a word's end

    def pieces(self, text: str) -> list[str | bytes | int]:
        """Pieces of a text; a special token as its id."""
        if not (self.specials and (found := list(self.specials.finditer(text)))):
            return self._plain(text)
        ends = [0, *(m.end() for m in found)]
        between = (self._plain(text[i : m.start()]) + [self.special[m[0]]] for i, m in zip(ends, found, strict=False))
        return [*chain.from_iterable(between), *self._plain(text[ends[-1] :])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids."""
        if len(self.known) > CACHE_PIECES:
            self.known = _Known(self, self.known)
        known, rows, counts = self.known, array("q"), []
        for text in texts:
            had = len(rows)
            if text:
                rows.extend(map(known.__getitem__, self.pieces(text)))
            counts.append(len(rows) - had)
        row = np.array(rows, np.int64)
        size, start, ids = (np.array(x, np.int64) for x in (known.sizes, known.starts, known.ids))
        size, start = size[row], start[row]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        return np.diff(ends[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]), flat


class _Known(dict):
    """Rows of pieces; a new piece is merged, unless `before` has it."""

    def __init__(self, bpe: WordBpe, before: dict) -> None:
        super().__init__()
        self.bpe, self.before = bpe, before
        if before:
            before.before = {}
        self.starts, self.sizes, self.ids = array("q"), array("q"), array("q")

    def __missing__(self, piece: str | bytes | int) -> int:
        if piece in self.before:
            row = self.before[piece]
            ids = self.before.ids[self.before.starts[row] : self.before.starts[row] + self.before.sizes[row]]
        elif isinstance(piece, int):
            ids = [piece]
        else:
            ids = self.bpe.ids_of(piece if isinstance(piece, bytes) else piece.encode())
        row = self[piece] = len(self.sizes)
        self.starts.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        return row


def _loaded(path: str) -> WordBpe:
    """The tokenizer that this worker has kept, if it is of the same file."""
    kept = CACHE.get("bpe")
    if kept is None or kept[0] != path:
        kept = CACHE["bpe"] = (path, WordBpe(path))
    return kept[1]


def _parts(sizes: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` in all, or one row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def _mapped(rows: DataFrame, column: str, result: str, kind: str, f) -> DataFrame:
    """`rows` with `column` replaced by `result`, which `f` makes of parts of it."""
    keep = others(tuple(c for c in rows.columns if c != column), result)
    named = rows.select(F.col(column).alias("x"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    schema = ", ".join([f"x {kind}", *(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            length = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)
            for i, j in _parts(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([f(part.column("x")), *part.columns[1:]], names=part.schema.names)

    return named.mapInArrow(lean(task, "bpe"), schema).select(F.col("x").alias(result), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def bpe_encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids (array of int) of each whole text, and the columns of `keep`."""

    def ids(texts: pa.Array) -> pa.Array:
        sizes, flat = _loaded(path).encode(texts.to_pylist())
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), flat.astype(np.int32))

    return _mapped(docs.select("text", *dict.fromkeys(c for c in keep if c != "text")), "text", "ids", "array<int>", ids)


def bpe_decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """`rows` with `column` (array of int) replaced by decoded_text: its tokens, joined by spaces."""

    def texts(ids: pa.Array) -> pa.Array:
        tokens = _loaded(path).tokens
        flat = ids.flatten()
        known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), flat, None)
        offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, tokens.take(known))
        return pc.if_else(pc.is_valid(ids), _joined(lists), None).cast(pa.string())

    return _mapped(rows, column, "decoded_text", "string", texts)


def _joined(lists: pa.ListArray) -> pa.Array:
    """Each list's tokens joined by spaces, unknown ones left out."""
    if lists.flatten().null_count:
        return pa.array([" ".join(t for t in x if t is not None) for x in lists.to_pylist()], pa.large_string())
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
