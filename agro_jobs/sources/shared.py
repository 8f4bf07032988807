"""Folders that the driver and all executors see, for rows that are written and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str = "job") -> str:
    """A new folder under spark.checkpoint.dir; that is set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written once and read back: cuts lineage."""
    path = shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores, where their files come in fewer pieces: a file of one row group is one task, however long each row takes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(3 * cores)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores whatever their plan, for rows that become many times as many: not by a column, or a shuffle by it before would count as this one and be coalesced."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def dealt_by(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows dealt by the columns `by` over all cores at least: what is then grouped by them, and by more, is shuffled no more, however many rows each has become."""
    n = max(3 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *by)


def once_each(rows: DataFrame, by: Sequence[str], **made: Column) -> DataFrame:
    """rows with the columns `made`, which depend on the columns `by` alone and are worked out once for each of their values."""
    values = spread(written(rows.select(*by).distinct(), "values"))
    told = written(values.select(*[F.col(c).alias(f"_{c}") for c in by], *[m.alias(name) for name, m in made.items()]), "told")
    same = reduce(and_, [rows[c].eqNullSafe(told[f"_{c}"]) for c in by])
    return rows.join(told, same, "left").drop(*[f"_{c}" for c in by])
