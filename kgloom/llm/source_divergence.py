"""Source divergence audit (13): joint count histograms of the sources of a language.

Each (lang, source) group and each lang smooths its term counts into integer
shares of 10^9. Two sources differ by the sum of f over all kept terms; f depends
on the two counts alone, so per pair of sources the distinct (count, count)
combinations are tallied, and f is evaluated once for each, times its
multiplicity. Cells with a zero count are never listed term by term: they are
implied, what the marginal histogram of one source has over the joint one.

Terms are counted in slices of text by Arrow dictionaries, so that a hot source
or a common term is summed before any shuffle. The result has a row for each
ordered pair of sources of a language; a term's list of sources is as long as
the square root of that at most.

Defined cases: a null text, lang or source counts as ''; each row is a document,
repeated ids and texts too; a group without terms still takes part, with zero
counts; a language that keeps no term has pairs of value 0 and no terms; a
language of one source has no pairs; an empty table gives no rows; equal values
are ranked by the bytes of the item; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import hinted, lean, materialize
from kgloom.llm.words import slices, utf8

#: A language keeps the terms that so many of its documents have.
LEAST_DOCUMENTS = 10
#: Terms of a group that the report shows.
TOP_TERMS = 10
#: Pairs of counts that a task holds before it tallies them.
_HELD = 1 << 20

#: Bytes of terms as they are, A-Z lowered; all others a space.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def _sums(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct combinations of `keys`, and the sums of `values` over each."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of each slice of text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in slices(offsets):
            cut = offsets[i : j + 1]
            letters = _LETTERS[data[cut[0] : cut[-1]]]
            texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer((cut - cut[0]).astype(np.int64)), pa.py_buffer(letters)])
            split = pc.split_pattern(texts, " ")
            row = np.repeat(np.arange(j - i), np.diff(split.offsets.to_numpy()))
            coded = split.flatten().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            blank = pc.index(coded.dictionary, "").as_py()
            row, code = row[code != blank], code[code != blank]
            langs, sources = (batch.column(c).slice(i, j - i).dictionary_encode() for c in ("lang", "source"))
            lang, source = langs.indices.to_numpy(), sources.indices.to_numpy()
            (row, code), (n,) = _sums((row, code), np.ones(len(row), np.int64))
            (a, b, code), (n, documents) = _sums((lang[row], source[row], code), n, np.ones(len(row), np.int64))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(a)), sources.dictionary.take(pa.array(b)), coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(n), pa.array(documents)], names=["lang", "source", "term", "n", "documents"])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n (occurrences in the language) and by (source and n of each source that has it, by source) of the terms in at least `least` documents of a language."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = named.mapInArrow(lean(_count_terms), "lang string, source string, term string, n bigint, documents bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
    return terms.filter(F.col("documents") >= least).drop("documents")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms and lang_total of each group that occurs."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x")["source"].alias("source")).agg(F.sum(F.col("x")["n"]).alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    return groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, na, nb, m): how many terms have na > 0 in source a and nb > 0 in source b, a before b."""
    for batch in batches:
        by = batch.column("by")
        ends = by.offsets.to_numpy().astype(np.int64)
        ends, flat = ends - ends[0], by.flatten()
        sources = flat.field("source").dictionary_encode()
        source, n = sources.indices.to_numpy(), flat.field("n").to_numpy()
        langs = batch.column("lang").dictionary_encode()
        size = np.diff(ends)
        lang, left = np.repeat(langs.indices.to_numpy(), size), np.repeat(ends[1:], size) - np.arange(len(n))
        held: list[tuple[np.ndarray, ...]] = []

        def tallied(held: list[tuple[np.ndarray, ...]], langs=langs.dictionary, sources=sources.dictionary) -> pa.RecordBatch:
            columns = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            (of, a, b, na, nb), (m,) = _sums(columns[:5], columns[5])
            return pa.RecordBatch.from_arrays([langs.take(pa.array(of)), sources.take(pa.array(a)), sources.take(pa.array(b)), pa.array(na), pa.array(nb), pa.array(m)], names=["lang", "a", "b", "na", "nb", "m"])

        for step in range(1, int(size.max(initial=0))):  # a term's sources at a distance of `step` in its list
            at = np.flatnonzero(left > step)
            held.append((lang[at], source[at], source[at + step], n[at], n[at + step], np.ones(len(at), np.int64)))
            if sum(len(h[0]) for h in held) > _HELD:
                yield tallied(held)
                held.clear()
        if held:
            yield tallied(held)


def joint_histograms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, a, b, na, nb, m: of each pair of sources a < b of a language, the combinations of counts that its kept terms have, zeros included, and how many terms have each."""
    both = kept.filter(F.size("by") > 1).select("lang", "by").mapInArrow(lean(_tallies), "lang string, a string, b string, na bigint, nb bigint, m bigint")
    joint = both.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))
    cell = lambda na, nb, m: F.struct(na.cast("long").alias("na"), nb.cast("long").alias("nb"), m.cast("long").alias("m"))
    none, na, nb, m = F.lit(0), F.col("na"), F.col("nb"), F.col("m")
    listed = joint.select("lang", "a", "b", F.explode(F.array(cell(na, nb, m), cell(na, none, -m), cell(none, nb, -m), cell(none, none, m))).alias("x"))
    names = sizes.select("lang", "source", "terms")
    pairs = hinted(names.select("lang", F.col("source").alias("a"), "terms").join(names.select("lang", F.col("source").alias("b")), "lang").filter("a < b"))
    margin = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x")["source"].alias("source"), F.col("x")["n"].alias("n")).agg(F.count("*").alias("m"))
    one = margin.withColumnsRenamed({"source": "a"}).join(pairs, ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell(F.col("n"), none, m), cell(none, none, -m))).alias("x"))
    two = margin.withColumnsRenamed({"source": "b"}).join(pairs, ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(none, F.col("n"), m), cell(none, none, -m))).alias("x"))
    whole = pairs.select("lang", "a", "b", cell(none, none, F.col("terms")).alias("x"))
    signed = listed.unionByName(one).unionByName(two).unionByName(whole)
    return signed.groupBy("lang", "a", "b", F.col("x")["na"].alias("na"), F.col("x")["nb"].alias("nb")).agg(F.sum(F.col("x")["m"]).alias("m"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact in 64 bits for totals below 9 * 10^13."""
    whole = lambda x: F.call_function("div", x, total + 2 * terms)
    high = (n + 2) * 100_000
    return 1 + whole(high) * 10_000 + whole(high % (total + 2 * terms) * 10_000)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exact."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source of a language is from each other one, and the `top` terms that it has more often than its language."""
    kept = materialize(kept_terms(docs, least), "terms")
    sizes = hinted(materialize(group_sizes(docs, kept), "groups"))
    cells = joint_histograms(kept, sizes)
    size = lambda s: sizes.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["terms"] if s == "a" else []))
    counted = cells.join(size("a"), ["lang", "a"]).join(size("b"), ["lang", "b"])
    terms = F.col("terms")
    f = divergence(share(F.col("na"), F.col("total_a"), terms), share(F.col("nb"), F.col("total_b"), terms))
    value = F.sum(F.when((F.col("m") > 0) & (terms > 0), f * F.col("m")).otherwise(0))
    pair = counted.groupBy("lang", "a", "b").agg(value.cast("long").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = pair.select("lang", ends.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    each = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("by").alias("x")).select("lang", "item", "lang_n", F.col("x")["source"].alias("source"), F.col("x")["n"].alias("n"))
    shares = each.join(sizes, ["lang", "source"]).select("lang", "source", "item", share(F.col("n"), F.col("total"), terms).alias("p"), share(F.col("lang_n"), F.col("lang_total"), terms).alias("q"))
    more = shares.filter("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    shown = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair.select("*", F.lit("pair").alias("part"), rank).select(shown)
    return pairs.unionByName(more.select("*", F.lit("term").alias("part"), rank).filter(F.col("rank") <= top).select(shown))
