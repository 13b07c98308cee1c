"""Change events on a stream against those of batches and snapshots, over restarts and replays."""

import json
import random

import pytest

from docketspark.operators import ingest
from docketspark.sources.snapshots import SnapshotStore
from docketspark.streaming import cdc, ingestion

SCHEMA = "id long, status string, budget long, inspection_manager string, modified string"


def batches(n):
    rng = random.Random(5)
    out = []
    for b in range(n):
        rows = [{"id": i, "status": rng.choice(["모집", "계약", "진행"]), "budget": rng.choice([None, 1, 2]), "inspection_manager": rng.choice([None, "m"]), "modified": f"t{b}"} for i in rng.sample(range(40), 15)]
        out.append(rows + [dict(rows[0], budget=9, modified=f"t{b}+")])
    return out


def write(folder, number, rows):
    (folder / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))


def events(store):
    return sorted((r.source_id, r.source, r.field, str(r.before), str(r.after)) for r in store.read("events").collect())


@pytest.fixture(scope="module")
def wanted(spark, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("batches")))
    for rows in batches(4):
        ingestion.commit_cases(store, spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    return events(store)


def test_stream_equals_batches_over_restarts(spark, tmp_path, wanted):
    (tmp_path / "in").mkdir()
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for number, rows in enumerate(batches(4)):  # every call is a restart from the checkpoint
        write(tmp_path / "in", number, rows)
        cdc.run(ingestion.read_batches(spark, str(tmp_path / "in"), SCHEMA), store, str(tmp_path / "cp"))
    assert events(store) == wanted and len(wanted) > 20
    signed = cdc.signed(store.read("events"))
    assert {(r.before, r.after) for r in signed.collect()} <= {("모집", "계약"), ("모집", "진행")} and signed.count() == ingest.contract_signed(store.read("events")).count() > 0
    write(tmp_path / "in", 9, batches(4)[3])  # the last batch again, and an old one
    write(tmp_path / "in", 10, batches(4)[0])
    cdc.run(ingestion.read_batches(spark, str(tmp_path / "in"), SCHEMA), store, str(tmp_path / "cp"))
    assert events(store) == wanted


def test_state_starts_from_a_snapshot(spark, tmp_path, wanted):
    (tmp_path / "in").mkdir()
    first, *later = batches(4)
    before = ingest.last_wins(spark.createDataFrame([tuple(r.values()) for r in first], SCHEMA), ["id"], "modified")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for number, rows in enumerate(later):
        write(tmp_path / "in", number, rows)
        cdc.run(ingestion.read_batches(spark, str(tmp_path / "in"), SCHEMA), store, str(tmp_path / "cp"), known=before)
    assert events(store) == wanted
