"""Chat histories: rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_history(rows: DataFrame, most: int = 20, chars: int = 32_000) -> DataFrame:
    """conv_id, valid: an even number of at most `most` messages, user and assistant in turn, none blank, `chars` characters at most."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    expected = F.when(F.col("_p") % 2 == 0, "user").otherwise("assistant")
    fine = F.coalesce((F.col("role") == expected) & (F.trim("text") != ""), F.lit(False))
    got = rows.withColumn("_p", place).groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(fine).alias("fine"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("c"))
    return got.select("conv_id", ((F.col("n") % 2 == 0) & (F.col("n") <= most) & F.col("fine") & (F.col("c") <= chars)).alias("valid"))


def trim_history(rows: DataFrame, most: int = 20, chars: int = 32_000) -> DataFrame:
    """The longest suffix of whole pairs within both limits."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pair = rows.withColumn("_pair", F.floor((F.row_number().over(order) - 1) / 2))
    sums = pair.groupBy("conv_id", "_pair").agg(F.count("*").alias("_n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("_c"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("_pair")).rowsBetween(Window.unboundedPreceding, 0)
    kept = sums.withColumns({"_n": F.sum("_n").over(back), "_c": F.sum("_c").over(back)}).filter((F.col("_n") <= most) & (F.col("_c") <= chars))
    return pair.join(kept.select("conv_id", "_pair"), ["conv_id", "_pair"], "left_semi").select(rows.columns)
