"""The folder that driver and executors share: cut lineage, and versions of a set of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode one of our own where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="kgloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder as Parquet and read back: columns that are not asked for are not read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Versions of a set of tables in a folder, for one writer at a time.

    A version's changed tables are written first; then one row (version, paths of all
    tables, note) is added to the table of versions. Readers follow its newest row, so
    they see all of a version or nothing of it, and a writer that dies leaves none.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._derived: dict[tuple, DataFrame] = {}

    def _newest(self):
        try:
            rows = self.spark.read.parquet(f"{self.folder}/versions").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return rows[0] if rows else None

    def version(self) -> int:
        """The newest version; 0 before the first."""
        row = self._newest()
        return row["version"] if row else 0

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the newest version."""
        row = self._newest()
        return {name: self.spark.read.parquet(path) for name, path in row["paths"].items()} if row else {}

    def derived(self, what: str, names: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        """`what` follows from the newest version's tables of these names: made and written once while their paths stay, as a written table never changes."""
        key = (what, *(self._newest()["paths"][name] for name in names))
        if key not in self._derived:
            self._derived[key] = written(make())
        return self._derived[key]

    def publish(self, tables: dict[str, DataFrame], note: str) -> int:
        """Write `tables` and switch to a version that has them, and the other tables as they were."""
        row, folder = self._newest(), f"{self.folder}/data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        version = (row["version"] if row else 0) + 1
        paths = (row["paths"] if row else {}) | {name: f"{folder}/{name}" for name in tables}
        self.spark.createDataFrame([(version, paths, note)], "version bigint, paths map<string,string>, note string").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return version
