"""Papers as they arrive: the batch plan on each micro-batch, with progress rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of new Parquet files of a folder; what was read stays in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Process all that is there and stop.

    A document delivered again within a batch counts once. Each batch writes
    its results and one progress row to folders named by the batch, replacing
    what a failed attempt left, so a repeated batch changes nothing.
    """

    def one(batch: DataFrame, n: int) -> None:
        done = plan(batch.dropDuplicates([key]))
        done.write.mode("overwrite").parquet(f"{out}/results/batch={n}")
        rows = batch.sparkSession.read.parquet(f"{out}/results/batch={n}").agg(F.count("*").alias("rows"))
        rows.select(F.lit("progress").alias("event"), "rows").write.mode("overwrite").json(f"{out}/progress/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
