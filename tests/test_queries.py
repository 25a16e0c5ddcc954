"""Each graph query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__
from kgloom.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_greedy_windows(spark):
    from kgloom.operators.segments import greedy_windows

    cues = [("d", 0.0, 4.0), ("d", 3.0, 8.0), ("d", 6.0, 9.5), ("d", 11.0, 12.0), ("d", 30.0, 90.0)]
    got = greedy_windows(spark.createDataFrame(cues, 'doc string, start double, end double'), 9.0).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n"]) for r in got] == [(0.0, 8.0, 2), (6.0, 12.0, 2)]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from kgloom.functions import text

    row = spark.range(1).select(text.normalize(F.lit("  ＡＢ  Straße ")).alias("n"), text.slug(F.lit('a/b:"c"')).alias("s"), text.slug(F.lit("//")).alias("u"), text.timestamp_seconds(F.lit("1:02,5")).alias("t"), text.timestamp_seconds(F.lit("x")).alias("x"), text.srt_stamp(F.lit(3661.0005)).alias("r"), text.mentioned(F.lit("Open AI, x"), F.lit("open ai")).alias("m"), text.mentioned(F.lit("OpenAIs"), F.lit("openai")).alias("m2")).first()
    assert tuple(row) == ("ab strasse", "abc", "untitled", 62.5, None, "01:01:01,001", True, False)
