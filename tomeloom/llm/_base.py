"""Shared plumbing of the training-data operators.

Intermediate results that several later plans read are written as Parquet in
the folder that all executors share (``spark.checkpoint.dir``), so a lost
executor costs only the re-read of a file.  Nothing is kept in executor-local
storage.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Settings of the jobs that write intermediate tables: shuffle files go at once, and Arrow batches are bounded by bytes.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written intermediate tables of one operator call.

    ``put`` writes a table and returns it as read back; the shuffle files of
    the job that made it are removed at once, since its result is now on shared
    storage.  ``drop`` removes a table that nothing reads any more.  Tables that
    the returned DataFrame still reads go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tomeloom-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.observed = None
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame, name: str, observe: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """df as written, in folders by the given columns, and read back; ``observe``, an aggregate, is computed on the way and left in ``observed``."""
        path, schema = f"{self.root}/{name}", df.schema
        seen = None
        if observe is not None:
            seen = Observation()
            df = df.observe(seen, observe.alias("seen"))
        before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        self.paths[name] = path
        self.observed = seen.get["seen"] if seen is not None else None
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.paths.pop(name, f"{self.root}/{name}"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, n_rows: int, per_task: int = 5_000) -> DataFrame:
    """df in as many parts as its number of rows asks for, and no more than it has."""
    return df.coalesce(max(1, -(-n_rows // per_task)))


def whole_text(col: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, rows without an id left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).where("doc_id IS NOT NULL")
