"""Globally ordered slices of a table, and a dense row index built on them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import as_list, quoted

#: Spark's switch for removing the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query run inside has shuffled is removed when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def removed(df: DataFrame, path: str) -> None:
    """Delete a table of this run's own at ``path``, which ``df`` read and nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder the cluster names.

    Slice numbers must not change when a lost task is run again, so they are
    written once.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    The warehouse is shared by driver and executors too, so no machine writes where others cannot read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None)
                            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-row Python work on a table that arrives in fewer partitions than there are cores.

    Few partitions mean little data, so the shuffle is small; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ordered_chunks(df: DataFrame, order, parts: int) -> DataFrame:
    """Add ``__chunk``: rows of a lower chunk precede rows of a higher one in ``order``."""
    return reliable(df.repartitionByRange(int(parts), *order).withColumn("__chunk", F.spark_partition_id()))


def with_row_index(df: DataFrame, order_by, name: str = "row_index", parts: int | None = None) -> DataFrame:
    """Dense 0-based position in the total order ``order_by``.

    Rows are range-partitioned, numbered inside their slice, and shifted by the
    number of rows in earlier slices (one count per slice).
    """
    keys = [quoted(c) if isinstance(c, str) else c for c in (as_list(order_by) if isinstance(order_by, (str, list))
                                                             else [order_by])]
    if parts is None:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = ordered_chunks(df, keys, parts)
    counts = sliced.groupBy("__chunk").count()
    upto = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__chunk", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__chunk").orderBy(*keys))
    # one offset per slice: the broadcast side has ``parts`` rows
    return (sliced.withColumn("__nth", inside).join(F.broadcast(offsets), "__chunk")
            .withColumn(name, (F.col("__nth") - 1 + F.col("__offset")).cast("long"))
            .drop("__nth", "__offset", "__chunk"))
