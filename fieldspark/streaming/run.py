"""Running a stream over what is there now, and reading its results as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str, per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream, at most `per_batch` files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def settled(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The newest row of each key once all that is there has been read.

    Each batch writes its own folder, named by the batch, so that a batch that
    is run again after a failure replaces what it wrote before.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def observed(stream: DataFrame, name: str, metrics: Sequence[Column], updates: Sequence[Callable[[DataFrame, int], None]], every: int = 90) -> list[dict]:
    """Runs the updates, in their order, on each batch until all that is there has been read; the metrics of every `every`th batch.

    Metrics are gathered while the batch runs, by the tasks that read it anyway;
    one batch is in flight at a time. Returning is what a waiter waits for.
    """

    def run(batch: DataFrame, number: int) -> None:
        for update in updates:
            update(batch, number)

    path = f"{shared_dir(stream.sparkSession)}/observed-{uuid.uuid4().hex}"
    query = stream.observe(name, *metrics).writeStream.option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()
    found = []
    for progress in query.recentProgress:
        if progress["batchId"] % every == 0 and progress["observedMetrics"].get(name):
            row = progress["observedMetrics"][name]
            found.append({"batch": progress["batchId"], **(row if isinstance(row, dict) else row.asDict())})
    return found
