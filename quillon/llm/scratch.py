"""Scratch tables shared by the operators.

Intermediate results that are read more than once are written as Parquet below
the folder in ``spark.checkpoint.dir``, which driver and executors share.  They
cut the lineage, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..runtime import shared_dir, ship

_COUNT = itertools.count()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{next(_COUNT):04d}-{name}-{uuid.uuid4().hex[:8]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to a new table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    jvm, path = spark.sparkContext._jvm, shared_dir(spark)
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows and bytes of a batch that a Python worker gets at once, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the batches of texts, whose default bound is 10,000 rows of any length."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``_c0``, ``_c1``, ..., which no name of an operator's own can clash with, and the new name of each old one."""
    names = {c: f"_c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
