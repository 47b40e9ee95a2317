"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (a local test) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: list[str] = []


def stored(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor then costs the tasks that it ran, and row ids, once written, stay. by: a column of few
    values, whose rows are read apart from others.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class Rounds:
    """A stored table that grows by rounds, whose rows lie apart by round (and by the values of a column `by`)."""

    def __init__(self, first: DataFrame, name: str, by: str | None = None):
        self.spark, self.by, self.n, self.schema = first.sparkSession, by, 0, first.schema
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _written.append(self.path)
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes the rows of a new round and gives them back."""
        writer = rows.select(self.schema.names).write
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.path}/round={self.n}")
        self.n += 1
        return self.last()

    def _read(self, *rounds: int) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/round={n}" for n in rounds]).select(self.schema.names)

    def last(self) -> DataFrame:
        return self._read(self.n - 1)

    def all(self) -> DataFrame:
        """The rows of all rounds, in one scan; to be freed as one table."""
        out = self._read(*range(self.n))
        out._stored_at = self.path
        return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame | None) -> None:
    """Deletes stored tables of which no plan that is still to run reads: all that came of them is stored itself."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Deletes all tables that this program has stored; for the end of a job, when its results are written."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
