"""Language ID (9): hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1; a letter trigram binds its three
vectors, permuted once for each place, by elementwise product; a text bundles
its trigrams by sum. The prototype of a language is the bundle of all its
training texts, and a text gets the language whose prototype has the highest cosine.

Defined cases: a null text, or one without a letter, is `und` with score 0, and
so is every text where there is nothing to learn from; equal cosines go to the
language that sorts first; rows are kept one for one, whatever repeats; columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import lean, others
from kgloom.llm.words import slices

DIMENSIONS = 1024
#: Prototypes are held on the driver; more languages than this are refused.
MAX_LANGUAGES = 4096
_DOCS = 64
_CHARS = 1 << 20
#: Trigrams whose vectors are held at a time; an alphabet of thousands of letters has many.
_BLOCK = 8192


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])


@lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    """code 0: the edge of a word."""
    return (np.random.Generator(np.random.PCG64(90_000 + code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each trigram, its number, the trigrams by number as digits in base n, the vectors of the n letters)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        letter[i] = chr(codes[i]).isalpha()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(codes)]
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge after each word
    codes, doc = np.concatenate(([0], codes[keep], [0])), np.concatenate(([0], doc[keep], [0]))
    used, codes = np.unique(codes, return_inverse=True)
    middle = np.flatnonzero(used[codes[1:-1]] > 0) + 1
    n = len(used)
    key = (codes[middle - 1] * n + codes[middle]) * n + codes[middle + 1]
    if n**3 <= 1 << 22:
        there = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.zeros(n**3, np.int64)
        number[there] = np.arange(len(there))
        number = number[key]
    else:
        there, number = np.unique(key, return_inverse=True)
    base = np.stack([_letter_vector(int(c)) for c in used]) if n else np.zeros((0, DIMENSIONS), np.int8)
    return doc[middle], number, there, base


def _sums(group: np.ndarray, number: np.ndarray, there: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
    """Bundles of n groups (ascending in `group`), over blocks of trigrams."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    first, second, letters = np.roll(base, 2, 1), np.roll(base, 1, 1), len(base)
    for at in range(0, len(there), _BLOCK):
        part = there[at : at + _BLOCK]
        wide = (first[part // (letters * letters)] * second[part // letters % letters] * base[part % letters]).astype(np.float32)
        inside = slice(None) if len(there) <= _BLOCK else np.flatnonzero((number >= at) & (number < at + len(part)))
        owner, place = group[inside], number[inside] - at
        for k in range(0, n, _DOCS):
            a, b = np.searchsorted(owner, (k, k + _DOCS))
            if a < b:
                m = min(_DOCS, n - k)
                counts = np.bincount((owner[a:b] - k) * len(part) + place[a:b], minlength=m * len(part))
                out[k : k + m] += counts.reshape(m, -1).astype(np.float32) @ wide
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column("text").to_pylist()
    offsets = np.cumsum([0, *(len(t or "") + 1 for t in column)])
    for i, j in slices(offsets, _CHARS):
        yield i, j, [t or "" for t in column[i:j]]


def train_language_profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from rows with text and lang."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, texts in _texts(batch):
                names = sorted(set(langs[i:j]))
                place = np.array([names.index(x) for x in langs[i:j]])
                doc, number, there, base = _trigrams(texts)
                group = place[doc]
                order = np.argsort(group, kind="stable")
                for name, sums in zip(names, _sums(group[order], number[order], there, base, len(names)), strict=True):
                    total[name] = total.get(name, 0) + sums.astype(np.float64)
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(lean(bundles), "lang string, bundle array<double>")
    sums = rows.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r["lang"] for r in found], np.array([[c["x"] for c in r["v"]] for r in found]).reshape(len(found), DIMENSIONS)


def predict_language(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score (the cosine, 0 where it is negative) of each row; result columns take the place of those in `keep` of their names."""
    keep = others(keep, "lang_pred", "score")
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i, j, texts in _texts(batch) if languages else ():
                doc, number, there, base = _trigrams(texts)
                sums = _sums(doc, number, there, base, j - i)
                cosines = sums @ unit.T / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(1)
                for k in np.flatnonzero(np.bincount(doc, minlength=j - i)):
                    langs[i + k], scores[i + k] = languages[best[k]], min(1.0, max(0.0, float(cosines[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(lean(predict), f"{fields}, lang_pred string, score double")
