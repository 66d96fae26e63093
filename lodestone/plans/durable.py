"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_held: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing and driver and tasks share one machine (tests, a laptop)
    a temporary folder of this machine is named once and kept in the session's
    configuration; on a cluster it has to be set.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """All intermediate tables of this application; may go once it has ended."""
    return f"{shared_dir(spark)}/lodestone-scratch/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage to its inputs, so a lost executor costs a file read
    and not a recomputation, non-deterministic columns are fixed, and Catalyst
    knows its real size. ``keep``: the table outlives ``temporary_tables``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if (held := _held.get()) is not None and not keep:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``durable`` writes inside of the block, except those to be kept.

    What the block hands out must be kept tables or not depend on the others.
    """
    held: list[str] = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        for path in held:
            delete(spark, path)
