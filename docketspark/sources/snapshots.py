"""Table snapshots: versioned folders behind one manifest, and shared folders for intermediate rows.

A commit writes every table's new rows into a folder of its own and then replaces the manifest, through Hadoop's file system, so that readers see
all tables of a version or none. The store must create a file only if it is not there, and rename over a file, each in one step, as HDFS and
local file systems do; a plain object store does not.

Tables that grow are kept in buckets of a hash of their key: the manifest names the folder of each bucket, and merge() writes anew
only those buckets that a batch touches. Replaced folders stay for readers of earlier versions until expire() deletes them.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table; a batch of rows at random keys rewrites at most one bucket a row.
BUCKETS = 64
#: The bucket's number in files while they are written.
BUCKET = "__bucket"

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this process in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docketspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: later uses don't run it again, and a lost executor doesn't matter."""
    path = f"{shared_root(df.sparkSession)}/docketspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ConcurrentCommit(RuntimeError):
    """Another writer has taken the next version; read again and repeat the commit."""


@dataclass
class Merge:
    """A batch for a bucketed table: rows replace those of the same keys (upsert), or are left out where the keys are there (replace=False)."""

    rows: DataFrame
    keys: list[str]
    replace: bool = True
    buckets: int = BUCKETS


class SnapshotStore:
    """Tables under one root; manifest.json names each table's current folder and the cursors.

    A writer takes a version by creating a file that must not exist yet, so of two writers from the same version one fails and nothing of
    the other's commit is lost. A failed commit gives its version back; after a crash in between, release() does.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        at = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(at):
            return {"version": 0, "tables": {}, "cursors": {}}
        rows = self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def manifest_at(self, version: int) -> dict:
        """The manifest of an earlier version; its tables can be read until expire() has passed it."""
        if version == 0:
            return {"version": 0, "tables": {}, "cursors": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first().value)

    def feed(self, table: str, since: int) -> DataFrame:
        """What has changed in a bucketed table after version `since`: rows (before, after), null before an insert and after a delete.

        Only the buckets that were written since are read, on both sides, so the cost follows the changes. The table must exist now.
        """
        now, then = self.manifest()["tables"][table], self.manifest_at(since)["tables"].get(table)
        old = then["folders"] if then and then["buckets"] == now["buckets"] and then["keys"] == now["keys"] else None
        if then and old is None:  # dealt anew in between
            buckets, before = None, self._rows({"tables": {table: then}}, table)
        else:
            buckets = {int(b) for b, path in now["folders"].items() if (old or {}).get(b) != path}
            before = self._rows({"tables": {table: (then or now) | {"folders": old or {}}}}, table, buckets)
        after = self._rows({"tables": {table: now}}, table, buckets)
        keys, columns = now["keys"], after.columns
        left = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*columns).alias("before"))
        right = after.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*columns).alias("after"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}"))
        return left.join(right, same, "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        """The table's rows, or those of some of its buckets; None if there is no such table."""
        return self._rows(self.manifest(), table, buckets)

    def _rows(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        at = manifest["tables"].get(table)
        if at is None:
            return None
        if isinstance(at, str):
            return self.spark.read.parquet(at)
        paths = [path for b, path in at["folders"].items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(at["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], at["schema"])

    @staticmethod
    def _bucket(keys: list[str], n: int):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def touched(self, table: str, rows: DataFrame) -> set[int]:
        """The buckets of a bucketed table that rows' keys lie in: at most as many numbers as there are buckets."""
        at = self.manifest()["tables"][table]
        return {r[0] for r in rows.select(self._bucket(at["keys"], at["buckets"])).distinct().collect()}

    def cursor(self, source: str) -> str | None:
        """The stored cursor; None asks for a full load."""
        return self.manifest()["cursors"].get(source)

    def merge(self, batches: dict[str, Merge], cursors: dict[str, str | None] | None = None) -> int:
        """Bring a batch into each of some bucketed tables and publish all with the cursors; only the buckets that a batch touches are read and written.

        A table that is not there yet is made with Merge.buckets. Rows of a batch that repeat a key count once (any of them).
        """
        return self.commit({}, cursors, batches)

    def commit(self, tables: dict[str, DataFrame], cursors: dict[str, str | None] | None = None, batches: dict[str, Merge] | None = None) -> int:
        """Write the tables, then publish them and the cursors together; a failure before the last step leaves the old version."""
        old = self.manifest()
        return self._claimed(old, lambda version: self._publish(old, version, tables, cursors, batches or {}))

    def release(self, version: int) -> None:
        """Give a version back that a crashed writer has taken and not published."""
        if version > self.manifest()["version"]:
            self._fs.delete(self._path(f"{self.root}/commits/{version}"), False)

    def _merged(self, old: dict, version: int, name: str, batch: Merge) -> tuple[dict, list[str]]:
        """A bucketed table's new entry, and the folders that it gives up."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.rows.schema.fields)
        at = old["tables"].get(name) or {"keys": batch.keys, "buckets": batch.buckets, "schema": schema, "folders": {}}
        bucket = self._bucket(at["keys"], at["buckets"])
        rows = keep(batch.rows.dropDuplicates(at["keys"]).withColumn(BUCKET, bucket), f"merge-{name}")
        touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # at most as many numbers as buckets
        before = self._rows(old | {"tables": {name: at}}, name, touched).withColumn(BUCKET, bucket)
        same = [BUCKET, *at["keys"]]
        if batch.replace:
            after = before.join(rows.select(*same), same, "left_anti").unionByName(rows)
        else:
            after = before.unionByName(rows.join(before.select(*same), same, "left_anti"))
        folder = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex}"
        after.repartition(len(touched) or 1, BUCKET).write.partitionBy(BUCKET).parquet(folder)
        given_up = [at["folders"][str(b)] for b in touched if str(b) in at["folders"]]
        return at | {"folders": at["folders"] | {str(b): f"{folder}/{BUCKET}={b}" for b in touched}}, given_up

    def rebucket(self, table: str, keys: list[str], buckets: int) -> int:
        """Deal a table, bucketed or not, into a number of buckets: for tables that have grown, whose buckets take long to write."""
        rows = self.read(table)
        old = self.manifest()
        given_up = self._folders(old["tables"][table])
        emptied = old | {"tables": {k: v for k, v in old["tables"].items() if k != table}}
        return self._claimed(old, lambda version: self._replace(emptied, version, {table: Merge(rows, keys, buckets=buckets)}, given_up))

    def expire(self, keep_versions: int = 1) -> list[str]:
        """Delete folders that no version needs but those more than keep_versions behind; gives their paths. Readers of such versions fail from now on."""
        old = self.manifest()
        gone = [path for version, paths in old.get("retired", {}).items() if int(version) <= old["version"] - keep_versions for path in paths]
        # this commit changes no table, so it does not bring earlier versions nearer to their end
        left = {str(int(v) + 1): p for v, p in old.get("retired", {}).items() if int(v) > old["version"] - keep_versions}
        if gone:
            self._claimed(old, lambda version: self._write(old | {"version": version, "retired": left}, version))
        for path in gone:
            self._fs.delete(self._path(path), True)
        return gone

    @staticmethod
    def _folders(at: str | dict) -> list[str]:
        return [at] if isinstance(at, str) else list(at["folders"].values())

    def _publish(self, old: dict, version: int, tables: dict[str, DataFrame], cursors: dict[str, str | None] | None, batches: dict[str, Merge]) -> int:
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        given_up = [path for name in tables if name in old["tables"] for path in self._folders(old["tables"][name])]
        new = old | {"tables": old["tables"] | paths, "cursors": old["cursors"] | {k: v for k, v in (cursors or {}).items() if v is not None}}
        return self._replace(new, version, batches, given_up)

    def _replace(self, old: dict, version: int, batches: dict[str, Merge], given_up: list[str]) -> int:
        tables, given_up = dict(old["tables"]), list(given_up)
        for name, batch in batches.items():
            tables[name], more = self._merged(old, version, name, batch)
            given_up += more
        retired = old.get("retired", {}) | ({str(version): given_up} if given_up else {})
        return self._write(old | {"version": version, "tables": tables, "retired": retired}, version)

    def _claimed(self, old: dict, publish: Callable[[int], int]) -> int:
        """Take the next version, publish, and give it back if that fails."""
        version = old["version"] + 1
        claim = self._path(f"{self.root}/commits/{version}")
        if not self._fs.createNewFile(claim):
            raise ConcurrentCommit(f"version {version} is taken")
        try:
            return publish(version)
        except BaseException:
            self._fs.delete(claim, False)
            raise

    def _write(self, new: dict, version: int) -> int:
        copy = self._fs.create(self._path(f"{self.root}/manifests/{version}.json"), True)
        copy.write(json.dumps(new).encode())
        copy.close()
        draft, final = self._path(f"{self.root}/manifest.json.{version}"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(new).encode())
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(draft, final, array)
        return version
