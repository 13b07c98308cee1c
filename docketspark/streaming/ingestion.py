"""Ingestion as a stream: JSON batches in a folder, each micro-batch committed as a new snapshot together with its cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.operators import ingest
from docketspark.sources.snapshots import Merge, SnapshotStore


def read_batches(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the rows in JSON-lines files; a batch is a number of files, not of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def commit_cases(store: SnapshotStore, batch: DataFrame, modified: str = "modified") -> int:
    """Upsert one batch of cases (id, ..., modified), append their change events and move the cursor on, in one commit.

    Of both tables only the buckets that the batch's keys lie in are read and written. Repeating a batch changes nothing but the version: rows are
    replaced by id, events kept by their source id.
    """
    rows = ingest.last_wins(batch, ["id"], modified)
    batches = {"cases": Merge(rows, ["id"])}
    if "cases" in store.manifest()["tables"]:
        old = store.read("cases", store.touched("cases", rows))
        diff = ingest.differences(old, rows).join(rows.select("id", F.col(modified).cast("string").alias("__m")), "id")
        batches["events"] = Merge(ingest.change_events(diff, F.col("__m")), ["source_id"], replace=False)
    reached = ingest.greatest_cursor(rows, modified, "id").first()["cursor"]  # one row
    return store.merge(batches, {"cases": ingest.next_cursor("always", store.cursor("cases"), reached or None)})


def run(stream: DataFrame, store: SnapshotStore, checkpoint: str):
    """Take in everything that is there, then stop; the checkpoint remembers which files are done."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            commit_cases(store, batch)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query
