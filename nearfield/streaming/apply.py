"""A change log as a stream: micro-batches append to the store, and snapshots follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import CHANGES
from ..operators.store import Store


def changes_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(path)


def apply(stream: DataFrame, store: Store, checkpoint: str, every: str | None = None):
    """Starts the query: each micro-batch is appended once (its id is in the manifest) and becomes a version.

    ``every``: a processing-time interval such as "300 seconds"; without it all that is there is taken and the query ends.
    """

    def batch(df: DataFrame, n: int) -> None:
        now = store.current()
        if now and now.get("batch") is not None and n <= now["batch"]:
            return  # seen before a restart
        store.append(df)
        store.snapshot(batch=n)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
