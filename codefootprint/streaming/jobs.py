"""Streams of finished analyses and of arriving files.

Both jobs keep their progress and state in the checkpoint folder, so a lost executor or a restarted driver
continues where the stream was and no input counts twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog.rules import DEFAULT_RULES, Rule
from ..plans.scan import scan_files


def usage_totals(analyses: DataFrame) -> DataFrame:
    """Analysed repositories and the sum of their non-negative kWh, for a table or a stream.

    Input: ``kind`` (``repository`` or ``snippet``) and ``kwh``. Snippets do not count. Zeros before the first.
    """
    return analyses.filter(F.col("kind") == "repository").groupBy().agg(
        F.count(F.lit(1)).alias("repos"),
        F.coalesce(F.sum(F.greatest(F.col("kwh"), F.lit(0.0))), F.lit(0.0)).alias("kwh"),
    )


def start_usage_totals(analyses: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Runs the totals over what has arrived. Each batch writes its row to a folder of its own below ``output``, so a batch
    that runs again replaces its own row only, and readers always find the last complete one (:func:`current_totals`).
    Zeros stand there before the first event."""
    spark = analyses.sparkSession
    zeros = spark.range(1).select(F.lit(0).cast("bigint").alias("repos"), F.lit(0.0).alias("kwh"))
    zeros.coalesce(1).write.mode("ignore").parquet(f"{output}/batch=-1")

    def publish(totals: DataFrame, batch: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return (
        usage_totals(analyses).writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_totals(spark: SparkSession, output: str) -> DataFrame:
    """The row of the highest complete batch that :func:`start_usage_totals` wrote."""
    rows = spark.read.schema("repos bigint, kwh double, batch bigint").parquet(output)
    return rows.orderBy(F.desc("batch")).limit(1).drop("batch")


def scan_stream(files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The scan of :func:`scan_files` on arriving files. It is a projection, so the stream keeps no state."""
    return scan_files(files, rules)


def start_scan(
    files: DataFrame, output: str, checkpoint: str, rules: Iterable[Rule] = DEFAULT_RULES
) -> StreamingQuery:
    """Appends the scan of newly arrived files to the Parquet table ``output``."""
    return (
        scan_stream(files, rules).writeStream.outputMode("append").format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
