"""Intermediate tables that several plans read, written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str] | None] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset and all executors run in this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracefold-"))
        found = sc.getCheckpointDir()
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and
    row numbers given before the write stay as they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = getattr(_scopes, "tables", None)
    (_staged if own is None else own).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Delete at its end what this thread has staged in it; for work whose result is not a table."""
    outer, _scopes.tables = getattr(_scopes, "tables", None), []
    try:
        yield
    finally:
        own, _scopes.tables = _scopes.tables, outer
        _delete(own)


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``df`` in this order with each row's place from 1.

    Rows are sorted by ranges; places are numbers within a range plus the rows of
    the ranges before, a table of one row for each task.
    """
    ordered = stage(df.orderBy(*order).withColumn("placed_id", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("placed_id", 33), F.col("placed_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = ordered.groupBy(part.alias("placed_part")).agg(F.count("*").alias("n")).select("placed_part", F.expr("sum(n) over (order by placed_part) - n").alias("placed_before"))
    return ordered.withColumn("placed_part", part).join(F.broadcast(before), "placed_part").withColumn(name, within + F.col("placed_before") + 1).drop("placed_id", "placed_part", "placed_before")


def mark() -> int:
    """The point up to which ``release`` keeps what there is."""
    return len(_staged)


def release(since: int = 0, until: int | None = None) -> None:
    """Delete the tables staged between two marks."""
    tables = _staged[since:until]
    # the places stay, so that marks stay right
    _staged[since:until] = [None] * len(tables)
    _delete(tables)


def _delete(tables: list[tuple[SparkSession, str] | None]) -> None:
    for found in filter(None, tables):
        spark, path = found
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


atexit.register(release)
