"""What the operators share: the shared folder, written intermediate tables, id ranges."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of `[^\x20\x09-\x0D]+` in Java's regex syntax.
SPACES = r"[\x20\x09-\x0D]+"
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for texts that still have A-Z.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='kgloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_splits(docs: DataFrame, n: int, column: str = "doc_id") -> list[int]:
    """At most n-1 ascending split points that cut the ids into ranges of about equal row counts."""
    steps = [i / n for i in range(1, n)]
    if not steps:
        return []
    got = docs.select(F.percentile_approx(column, steps, 10 * n).alias("p")).first()["p"]
    return sorted(set(got or []))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def id_range(splits: list[int], column: str = "doc_id") -> Column:
    """Number of the id's range (0 to len(splits)); a null id goes to range 0. Looks among sqrt(n) groups of points, then in one of them."""
    if not splits:
        return F.lit(0)
    size = max(1, round(len(splits) ** 0.5))
    groups = [splits[k : k + size] for k in range(0, len(splits), size)]
    below = lambda points: F.size(F.filter(points, lambda s: s < F.col(column)))
    group = below(_numbers([g[-1] for g in groups]))
    listed = F.from_json(F.lit(str(groups)), "array<array<bigint>>")  # a constant of the plan, as are _numbers
    return F.coalesce(F.least(group * size + F.coalesce(below(F.get(listed, group)), F.lit(0)), F.lit(len(splits))), F.lit(0))


def byte_shards(docs: DataFrame, limit: int, column: str = "doc_id") -> tuple[Column, int]:
    """A number of each row's shard, and how many shards: ranges of ids with about `limit` bytes of text, or a part by hash of text of one range that has more."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
    splits = id_splits(docs, max(1, -(-2 * total // limit)), column)
    had = {r["k"]: r["n"] for r in docs.groupBy(id_range(splits, column).alias("k")).agg(F.sum(size).alias("n")).collect()}
    first, parts, shard, filled = [], [], -1, limit
    for k in range(len(splits) + 1):
        n = had.get(k, 0)
        if n > limit or filled + n > limit:
            shard, filled = shard + 1, 0
        first.append(shard)
        parts.append(max(1, -(-n // limit)))
        shard, filled = shard + parts[-1] - 1, limit if n > limit else filled + n
    at = id_range(splits, column)
    return (F.get(_numbers(first), at) + F.pmod(F.xxhash64("text"), F.get(_numbers(parts), at))).cast("int"), shard + 1


def fold(name: str, remainder: int, of: int, column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False)).alias(name)


def others(keep: tuple[str, ...], *results: str) -> tuple[str, ...]:
    """`keep` without the names of result columns: those replace what the input calls so."""
    return tuple(c for c in dict.fromkeys(keep) if c not in results)


def hidden(keep: tuple[str, ...]) -> tuple[list[Column], tuple[str, ...], list[Column]]:
    """Columns that carry `keep` through an operator, their names, and columns that bring `keep` back.

    doc_id and text, which operators read, stay as they are; all others get names that no operator uses.
    """
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    names = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(keep)}
    return [named(c).alias(n) for c, n in names.items()], tuple(names.values()), [F.col(n).alias(c) for c, n in names.items()]


def carries(*results: str) -> Callable:
    """For an operator with parameters docs and keep: whatever the kept columns are called, no name clashes with its own; a result column takes the place of a kept one of its name."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        given = inspect.signature(f)

        @functools.wraps(f)
        def carried(*args, **named) -> DataFrame:
            call = given.bind(*args, **named)
            call.apply_defaults()
            docs = call.arguments["docs"]
            carry, names, back = hidden(others(call.arguments["keep"], *results))
            read = [c for c in ("doc_id", "text") if c in docs.columns and c not in names]
            call.arguments |= {"docs": docs.select(*read, *carry), "keep": names}
            out = f(*call.args, **call.kwargs)
            return out.select(*back, *(c for c in out.columns if c not in names))

        return carried

    return wrap


#: What tasks of one kind keep in a Python worker from one task to the next; a task of another kind drops it.
CACHE: dict[str, object] = {}


def give_back() -> None:
    """Free memory goes back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` for mapInArrow, in a worker that keeps no cache but `cache` and no free memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [k for k in CACHE if k != cache]:
            del CACHE[name]
        give_back()
        try:
            yield from f(batches)
        finally:
            give_back()

    return task


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """What is written within it hands tasks Arrow batches of at most `rows` rows: JVM and worker each hold one. The session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that may be broadcast; beyond them a join shuffles.
BROADCAST_ROWS = 1_000_000


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (the least id reached) of every id in `links` (a, b).

    Alternates large-star and small-star steps, each a minimum by node and a
    join back, so that no node's neighbours meet in one place.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("v")).filter("v <> m")
        edges = materialize(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(now):
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
