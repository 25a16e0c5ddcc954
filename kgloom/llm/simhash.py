"""Document fingerprints (1): SimHash, and permuted block tables to search them.

A term is two consecutive words (or the only one); its weight is how often it
occurs. Each bit of a term's hash votes for or against that bit of the
fingerprint with its weight; a bit is set where more than half of the weight is
for it. The 64 votes are added in 32 longs, a vote in each half, so that
the sums stay in generated code.

Defined cases: a null text is empty, and an empty text's fingerprint is 0; equal
texts have equal fingerprints; rows that repeat a doc_id are each kept, in order
of text; a null doc_id comes last; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import SPACES, id_range, id_splits, materialize, shuffle_partitions

BITS = 64
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def terms(text: Column) -> Column:
    """Hashes of a text's terms, one for each occurrence."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    two = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    return F.when(n < 2, words).otherwise(two)


def fingerprints(rows: DataFrame, texts: list[str]) -> DataFrame:
    """`rows` without the text columns `texts`, each replaced by the fingerprint (a long) of its text."""
    kept = [c for c in rows.columns if c not in texts]
    others = [f"_kept_{i}" for i in range(len(kept))]
    rows = rows.select(*texts, *(F.col(f"`{c}`").alias(o) for c, o in zip(kept, others, strict=True)))
    hashed = rows.select(*others, *(F.xxhash64(t).alias(f"same_{t}") for t in texts), *(terms(F.col(t)).alias(t) for t in texts))
    hashed = hashed.withColumns({t: _pairs(F.col(t)) for t in texts})
    ends = [sum((F.size(t) for t in texts[: k + 1]), F.lit(0)) for k in range(len(texts))]
    keys = [*others, *(f"same_{t}" for t in texts)]
    # Two empty terms a row, of no weight, keep rows without terms and count repeated rows.
    one = hashed.select(*keys, *(e.alias(f"end_{k}") for k, e in enumerate(ends)), F.posexplode_outer(F.concat(*texts)).alias("pos", "h"))
    of = F.lit(len(texts) - 1)
    for k in range(len(texts) - 2, -1, -1):
        of = F.when(F.col("pos") < F.col(f"end_{k}"), k).otherwise(of)
    one = one.select(*keys, of.alias("of"), "h", F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0).alias("row"))
    voted = one.groupBy(*keys, "of").agg(F.sum("row").alias("rows"), F.count("h").alias("weight"), *(F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))), F.lit(0)).alias(f"v{i}") for i in range(BITS // 2)))
    bit = lambda votes, i: F.when(votes * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    value = F.lit(0).cast("long")
    for i in range(BITS // 2):
        value = value.bitwiseOR(bit(F.col(f"v{i}").bitwiseAND(F.lit(_LOW)), i)).bitwiseOR(bit(F.shiftrightunsigned(f"v{i}", 32), i + BITS // 2))
    each = voted.select(*keys, "of", "rows", value.alias("f"))
    wide = each.groupBy(*keys).agg(F.sum("rows").alias("rows"), *(F.coalesce(F.max(F.when(F.col("of") == k, F.col("f"))), F.lit(0).cast("long")).alias(t) for k, t in enumerate(texts)))
    return wide.select(*(F.col(o).alias(c) for o, c in zip(others, kept, strict=True)), *texts, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy_")).drop("_copy_")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next(rows: DataFrame, splits: list[int], columns: list[str]) -> DataFrame:
    """`rows` with next_<column>: the values of the next row in descending doc_id; after the last comes the first.

    Rows meet in ranges of doc_id; each range also gets the first row of the range below it.
    """
    ranged = rows.withColumn("_range", id_range(splits).cast("int"))
    tops = {r["_range"]: r["top"] for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    present = sorted(tops)
    by = [F.desc_nulls_last("doc_id"), *(F.asc_nulls_first(c) for c in columns)]
    below = {present[k - 1]: present[k] for k in range(len(present))}  # whose first row goes where; the topmost's to the lowest
    if not present:
        return ranged.drop("_range").withColumns({f"next_{c}": F.col(c) for c in columns})
    wanted = F.create_map(*(F.lit(x) for r, to in below.items() for x in (r, to)))
    wanted_by = F.element_at(wanted, F.col("_range"))
    heads = ranged.filter(F.col("doc_id").isin([t for t in tops.values() if t is not None]) | (F.col("doc_id").isNull() & F.lit(None in tops.values())))
    first = heads.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*by))).filter("_k = 1").drop("_k")
    guests = first.withColumns({"_range": wanted_by, "_guest": F.lit(1)})
    both = ranged.withColumn("_guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("_range").orderBy("_guest", *by)
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("_guest = 0").drop("_guest", "_range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (its last half replaced by the beginning of the next document's) and of the next text."""
    splits = id_splits(docs, 4 * shuffle_partitions(docs.sparkSession))
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), splits, ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = fingerprints(rows, ["text", "edited"]).withColumnsRenamed({"text": "f", "edited": "g"})
    # f comes before the other columns, as equal doc_ids are ordered by it here
    return with_next(materialize(found, "fingerprints"), splits, ["f"])


def near_fingerprints(rows: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints in column `fingerprint` (long) within the radius.

    Of `blocks` blocks of bits at least blocks - radius are equal, so one table
    for each choice of that many blocks, keyed by them, holds every such pair.
    Rows with equal fingerprints are one entry; join back for their documents.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = rows.select(F.col("fingerprint").alias("f")).filter("f IS NOT NULL").distinct()
    keyed = distinct.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(F.lit(m)) for m in signed))).alias("table", "key"))
    left, right = keyed.withColumnRenamed("f", "a"), keyed.withColumnRenamed("f", "b")
    pairs = left.join(right, ["table", "key"]).filter("a < b")
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()
