"""Change events on a stream with keyed state: the last image of every case is held in the state store and compared with each batch's row.

A micro-batch reads no snapshot: its cost follows its own rows. The state lives in RocksDB beside the checkpoint, so it may be larger than the
executors' memory and survives them. The checkpoint restores it after a restart, and events are kept once by their source id, so a batch
that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketspark.operators.ingest import contract_signed
from docketspark.schema import DIFF_FIELDS
from docketspark.sources.snapshots import Merge, SnapshotStore

OUT = "project_id long, source string, source_id string, field string, before string, after string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Images(StatefulProcessor):
    """State of a case: its fields as text and the time of the row that they are from."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", ", ".join(["modified string", *(f"f{i} string" for i in range(len(self.names)))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max((tuple(r) for pdf in rows for r in pdf[["modified", *self._columns()]].astype(object).itertuples(index=False)), key=lambda r: r[0] or "")
        last = tuple(None if pd.isna(v) else v for v in last)
        before = self.image.get()
        if before is not None and (last[0] or "") < (before[0] or ""):
            return  # a row of an earlier state of the case
        self.image.update(last)
        if before is None:
            return  # a new case is no change
        changed = [(n, b, a) for n, b, a in zip(self.names, before[1:], last[1:], strict=True) if a != b]
        if changed:
            yield pd.DataFrame([(key[0], "status" if n == "status" else "change", f"{key[0]}:{n}:{last[0]}", n, b, a) for n, b, a in changed], columns=["project_id", "source", "source_id", "field", "before", "after"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState[["modified", *self._columns()]].astype(object).iloc[0]
        self.image.update(tuple(None if pd.isna(v) else v for v in row))

    def _columns(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.names))]


def _texts(rows: DataFrame, used: dict[str, str], modified: str) -> DataFrame:
    return rows.select("id", F.col(modified).cast("string").alias("modified"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(used)])


def changes(cases: DataFrame, modified: str = "modified", known: DataFrame | None = None, fields: dict[str, str] = DIFF_FIELDS) -> DataFrame:
    """The change events of a stream of case rows (id, fields, modified), as change_events() gives them for a batch against the snapshot before.

    Of several rows of a case in a batch the latest counts; a row older than the image held is left out; fields absent from the stream are not compared.
    known: cases whose images the state starts from, with the same columns. Needs RocksDB as the state store's provider.
    """
    used = {c: n for c, n in fields.items() if c in cases.columns}
    first = _texts(known, used, modified).groupBy("id") if known is not None else None
    grouped = _texts(cases, used, modified).groupBy("id")
    return grouped.transformWithStateInPandas(Images(list(used.values())), outputStructType=OUT, outputMode="Append", timeMode="None", initialState=first)


def signed(events: DataFrame) -> DataFrame:
    """Of a stream or batch of change events those by which a contract came about."""
    return contract_signed(events)


def run(stream: DataFrame, store: SnapshotStore, checkpoint: str, modified: str = "modified", known: DataFrame | None = None):
    """Take in everything that is there, keep its change events in the store's table `events` and stop."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def each(batch: DataFrame, _: int) -> None:
        store.merge({"events": Merge(batch, ["source_id"], replace=False)})

    query = changes(stream, modified, known).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query
