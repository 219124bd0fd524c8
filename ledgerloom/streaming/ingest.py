"""Statement texts as they arrive: each micro-batch runs the batch job and adds to its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import stored_bank_job


def bank_stream(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reads Parquet files of (doc_id, text) as they appear in source; appends results, statements, lines, checks and issues
    under target, each batch in a folder of its own so that a batch that runs twice is written once. A batch is parsed once:
    the tables are read off its results."""

    def write(batch: DataFrame, number: int) -> None:
        done, _ = stored_bank_job(batch, f"{target}/results/batch={number}", "overwrite")
        for name in ("statements", "lines", "checks", "issues"):
            done[name].write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    docs = spark.readStream.schema("doc_id string, text string").parquet(source)
    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
