"""Capture results ingested as their files arrive."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.arrival import located
from vitrine.sources.captures import identified, outcome_counts, rejects_of, route_captures, snapshots_of

#: Lines of one batch take the bits below this one.
BATCH_SHIFT = 40


def ingest_capture_stream(
    spark: SparkSession, inbox: str, candidates: DataFrame, snapshots_path: str, checkpoint: str
) -> StreamingQuery:
    """Append the snapshots of every result file not ingested before, then stop.

    Rejected lines and the counts of outcomes go beside them, to ``_rejects`` and
    ``_counts`` with the same batch numbers.

    The batch job runs on each micro-batch. The checkpoint, in shared storage,
    remembers the files already read, and a batch that is retried after a failure
    replaces its own partition, so nothing is added twice. Snapshot ids count up: the batch
    number stands above the number of the line within the batch, so a retry gives the same ids.
    """
    lines = located(spark.readStream.text(inbox))

    def load(batch: DataFrame, batch_id: int) -> None:
        routed = route_captures(identified(batch, (batch_id + 1) << BATCH_SHIFT), candidates).persist()
        parts = {"": snapshots_of, "_rejects": rejects_of, "_counts": outcome_counts}
        for suffix, part in parts.items():
            part(routed).write.mode("overwrite").parquet(f"{snapshots_path}{suffix}/batch={batch_id}")
        routed.unpersist()

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
