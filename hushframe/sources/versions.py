"""A keyed table in a shared folder that is changed by upserts: copy on write by bucket, and a manifest that switches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table by a hash of its key; an upsert writes anew those that it touches.
BUCKETS = 64


class _Folder:
    """Small files of a folder in any store that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.root)) if self.fs.exists(self.root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.root, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call made the file: written beside it first, then renamed, which replaces nothing."""
        part = self.jvm.org.apache.hadoop.fs.Path(self.root, f".{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.jvm.org.apache.hadoop.fs.Path(self.root, name)
        done = not self.fs.exists(target) and self.fs.rename(part, target)
        if not done:
            self.fs.delete(part, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.root, name), True)


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class KeyedTable:
    """One row for each key. Readers see the last manifest's files only, so that a write that fails changes nothing, and
    one that succeeds changes all at once.

    manifest/<number> lists for each bucket the folder that holds its rows, and the last batch that each stream has
    written; data/<id>/bucket=<k> holds rows. Rows of one key merge by ``order``: the greatest stays (nulls are least),
    of equal ones the later written. Without ``order`` the later written stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, list(order), buckets
        self.manifests = _Folder(spark, f"{self.path}/manifest")

    def _manifest(self) -> tuple[int, dict]:
        names = [n for n in self.manifests.names() if n.isdigit()]
        if not names:
            return 0, {"buckets": {}, "batches": {}}
        return int(names[-1]), json.loads(self.manifests.read(names[-1]))

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f for k, f in manifest["buckets"].items() if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._rows(self._manifest()[1])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_later", F.lit(0)).unionByName(new.withColumn("_later", F.lit(1)))
        rank = [*(F.col(c).desc_nulls_last() for c in self.order), F.desc("_later")]
        if not self.order:
            # Of rows of one batch that share a key any may stay, but always the same one.
            rank += [F.xxhash64(*self.schema.names).asc()]
        w = Window.partitionBy(*self.keys).orderBy(*rank)
        return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_later")

    def upsert(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Merges rows in, and says whether it did: a batch of a stream that was written before changes nothing.

        Only the buckets that rows fall into are read and written again. Raises Conflict if another writer was faster.
        """
        number, manifest = self._manifest()
        if batch is not None and manifest["batches"].get(stream, -1) >= batch:
            return False
        rows = rows.select(*self.schema.names)
        # At most as many as there are buckets.
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            merged = self._merged(self._rows(manifest, touched), rows).withColumn("bucket", self._bucket())
            merged.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return self._commit(number, manifest, {k: f"{folder}/bucket={k}" for k in touched}, stream, batch)

    def _commit(self, number: int, manifest: dict, buckets: dict[int, str], stream: str, batch: int | None) -> bool:
        after = {"buckets": {**manifest["buckets"], **{str(k): f for k, f in buckets.items()}}, "batches": dict(manifest["batches"])}
        if batch is not None:
            after["batches"][stream] = batch
        if not self.manifests.create(f"{number + 1:012d}", json.dumps(after)):
            raise Conflict(f"{self.path}: version {number + 1} is there")
        return True

    def remove(self, condition) -> int:
        """Removes the rows for which a condition holds (such as ``expires_at < now``); returns how many."""
        number, manifest = self._manifest()
        hit = self.read().withColumn("_b", self._bucket()).where(condition).groupBy("_b").count().collect()
        touched = [r["_b"] for r in hit]
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            rest = self._rows(manifest, touched).where(~F.coalesce(condition, F.lit(False))).withColumn("bucket", self._bucket())
            rest.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            left = {r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()} if rest.limit(1).count() else set()
            kept = {k: f for k, f in manifest["buckets"].items() if int(k) not in touched}
            self._commit(number, {**manifest, "buckets": kept}, {k: f"{folder}/bucket={k}" for k in sorted(left)}, "", None)
        return sum(r["count"] for r in hit)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the last ``keep``, and data that none of these names: no reader may be older."""
        names = [n for n in self.manifests.names() if n.isdigit()]
        used = {f.split("/")[1] for n in names[-keep:] for f in json.loads(self.manifests.read(n))["buckets"].values()}
        for n in names[:-keep]:
            self.manifests.delete(n)
        data = _Folder(self.spark, f"{self.path}/data")
        for n in data.names():
            if n not in used:
                data.delete(n)
