"""A corpus pipeline: quality, near duplicates, contamination, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of documents, whatever these are called:
a stage works on doc_id and text and carries the others under names of its own.

Defined cases of every stage: an empty table stays empty; a null text counts as an
empty one and stays null; rows that repeat are each judged alike; a row with a null
doc_id is judged by its text and stays in the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import decontaminate, jaccard_join, mixing, quality, token_blocks
from kgloom.llm.common import hinted, materialize, table
from kgloom.llm.queries import MIX, QUALITY_THRESHOLD


def _hidden(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """`docs` with columns besides doc_id and text renamed, all its names, and expressions that bring `docs` back."""
    names = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), tuple(names.values()), [F.col(new).alias(old) for old, new in names.items()]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels none does."""
    rows, keep, back = _hidden(docs)
    model = quality.train_quality(rows, table(spark, sf_dir, "labels"))
    return quality.score_quality(rows, model, keep=keep).filter(F.col("score") >= QUALITY_THRESHOLD).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows of one doc_id are one document."""
    found = jaccard_join.jaccard_classes(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(hinted(materialize(found, "near-duplicates")), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts; n_chars, where there is one, counts anew."""
    rows, keep, back = _hidden(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=keep, cut=True)
    cut = F.size("spans") > 0
    counted = {"n_chars": lambda c: F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(c)}
    return found.select(*(counted.get(c, lambda x: x)(b).alias(c) for c, b in zip(docs.columns, back, strict=True)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their rate says.

    Good text gets 1.05 times its tokens, so that a document that is surely good
    stays at least once; low and toxic text is lowered to its share of MIX, or stays
    as it is where it has less.
    """
    rows, keep, back = _hidden(docs)
    rated = mixing.mixing_rates(rows, mixing.quality_domains(table(spark, sf_dir, "labels")), MIX, lead="good", keep=keep)
    times = F.explode(F.array_repeat(F.lit(0), mixing.copies(F.col("rate"), F.col("doc_id"))))
    return rated.select(*back, times.alias("_times")).drop("_times")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens and ids_crc32 of each document."""
    import public_tokenizers

    return token_blocks.token_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: The classifiers and the tokenizer cannot be put in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
