"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder, but only if Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that Spark sends to a Python worker at a time, unless the session says otherwise: its default of ten thousand texts of some
#: kilobytes is held several times over by the executor and its workers.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS for the session where Spark's default still holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


class Store:
    """Writes tables below one folder of a run and reads them back, so that a lost executor costs a read, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this run that no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in whatever case Spark compares names."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, name: str = "row_") -> DataFrame:
    """docs with a number that tells repeated rows apart, in a column of the given name (see :func:`unused_name`).

    docs must be a stored table, which reads the same each time: the number is made of a row's split and place in it. Spark
    cuts files by the cores it sees when a query is planned, so that figure is fixed for the session before the first
    number is given (``spark.sql.files.minPartitionNum``, where unset): executors that come or go change no number.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return docs.withColumn(name, F.monotonically_increasing_id())


def numbered(store: Store, df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds the row number from 0 in a total order, with no task that sees all rows.

    Rows are range-partitioned and stored; each partition numbers its own and adds the sum of the partitions before it
    (one row per partition, so the broadcast is bounded by the partition count).
    """
    from pyspark.sql import Window as W

    parts = store.put(
        df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()).sortWithinPartitions(*order), name
    )
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select(
        "part_", (F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")).alias("before_")
    )
    own = F.row_number().over(W.partitionBy("part_").orderBy(*order)) - 1
    return (
        parts.withColumn("own_", own)
        .join(F.broadcast(before), "part_")
        .withColumn(name, (F.col("own_") + F.col("before_")).cast("long"))
        .drop("part_", "own_", "n_", "before_")
    )
