"""A table of rows by key that keeps its versions: copy on write by bucket.

Rows lie in buckets by the hash of their key. A change reads and rewrites only the buckets
that its keys fall into; the new files go to a folder of their own, beside the old ones. A
small commit file then names, for each bucket, the folder that is live. It appears in one
step and only if no other writer has taken its number, so a write that fails or is overtaken
leaves the version before it in force, and a reader that holds a version keeps it until
``forget`` removes old files. A commit may carry a tag; a change with a tag that is already
committed does nothing, which makes a replayed micro-batch harmless.

Changes may name a key more than once: the last by ``order`` counts. Null keys are keys like
any other. The driver handles one entry a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.relational import first_per_key, join_null_safe


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str

    # --- versions -------------------------------------------------------------------

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _commit_path(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{version:012d}.json")

    def versions(self) -> list[int]:
        fs, place = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, version: int | None = None) -> dict:
        """What is live in a version, the newest by default."""
        version = max(self.versions()) if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}.json", wholetext=True).first().value)

    def _publish(self, entry: dict) -> None:
        fs, _ = self._files()
        target, draft = self._commit_path(entry["version"]), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"version {entry['version']} of {self.path} is taken")

    # --- reading --------------------------------------------------------------------

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, or of some of its buckets."""
        entry = self.commit(version)
        return self._rows(entry, buckets)

    def _rows(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        live = [(int(b), folder) for b, folder in entry["live"].items() if buckets is None or int(b) in set(buckets)]
        if not live:
            return self.spark.createDataFrame([], entry["schema"])
        return self.spark.read.schema(entry["schema"]).parquet(*[f"{self.path}/{folder}/_bucket={b}" for b, folder in live])

    # --- writing --------------------------------------------------------------------

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, keys: list[str], buckets: int) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _buckets_in(self, folder: str) -> list[int]:
        fs, _ = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))]
        return [int(n.split("=")[1]) for n in names if n.startswith("_bucket=")]

    def change(
        self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None, note: dict | None = None
    ) -> KeyedTable:
        """Replace the rows of the touched buckets by ``merge(old rows, changes)``; ``note`` is kept with the version."""
        entry = self.commit()
        if tag is not None and tag in entry["tags"]:
            return self
        keys, buckets = entry["keys"], entry["buckets"]
        touched = [r.b for r in changes.select(self._bucket(keys, buckets).alias("b")).distinct().collect()]
        live = {b: f for b, f in entry["live"].items() if int(b) not in set(touched)}
        if touched:
            folder = self._written(merge(self._rows(entry, touched), changes), keys, buckets)
            live |= {str(b): folder for b in self._buckets_in(folder)}
        tags = ([*entry["tags"], tag] if tag is not None else entry["tags"])[-1000:]
        self._publish({**entry, "version": entry["version"] + 1, "live": live, "tags": tags, "note": entry["note"] | (note or {})})
        return self

    def _last(self, changes: DataFrame, order: list[str]) -> DataFrame:
        return first_per_key(changes, self.commit()["keys"], [F.col(c) for c in order])

    def upsert(self, changes: DataFrame, order: list[str], tag: str | None = None) -> KeyedTable:
        """The last row per key by ``order`` wins, among stored rows and changes alike."""
        keys = self.commit()["keys"]
        return self.change(changes, lambda old, new: first_per_key(old.unionByName(new), keys, [F.col(c) for c in order]), tag)

    def update(self, changes: DataFrame, order: list[str], tag: str | None = None) -> KeyedTable:
        """Non-null columns of a key's last change replace stored ones; unknown keys change nothing."""
        keys = self.commit()["keys"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            fields = [c for c in new.columns if c not in keys and c in old.columns]
            last = self._last(new, order).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
            joined = join_null_safe(old, last, keys, "left")
            return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])

        return self.change(changes, merge, tag)

    def delete(self, gone: DataFrame, tag: str | None = None) -> KeyedTable:
        keys = self.commit()["keys"]
        return self.change(gone, lambda old, new: old.join(new.select(*[F.col(k).alias(f"_g_{k}") for k in keys]).distinct(), self._equal(keys), "left_anti"), tag)

    @staticmethod
    def _equal(keys: list[str]) -> Column:
        same = F.col(keys[0]).eqNullSafe(F.col(f"_g_{keys[0]}"))
        for k in keys[1:]:
            same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        return same

    def insert_new(self, rows: DataFrame, order: list[str], tag: str | None = None) -> KeyedTable:
        """Add rows whose key isn't stored; of several with one key, the last by ``order``."""
        keys = self.commit()["keys"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            stored = old.select(*[F.col(k).alias(f"_g_{k}") for k in keys])
            return old.unionByName(self._last(new, order).join(stored, self._equal(keys), "left_anti"))

        return self.change(rows, merge, tag)

    def forget(self, keep: int = 2) -> None:
        """Delete commit files before the newest ``keep``, and folders that no kept version names."""
        fs, _ = self._files()
        kept = self.versions()[-keep:]
        named = {folder for v in kept for folder in self.commit(v)["live"].values()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for v in self.versions():
            if v not in kept:
                fs.delete(self._commit_path(v), False)
        for status in fs.listStatus(hadoop(f"{self.path}/data")):
            if f"data/{status.getPath().getName()}" not in named:
                fs.delete(status.getPath(), True)


def create(rows: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 32) -> KeyedTable:
    """A new table at version 0; of several rows with one key the last by ``order`` is stored."""
    table = KeyedTable(rows.sparkSession, path)
    if table.versions():
        raise Conflict(f"{path} holds a table")
    first = {"version": 0, "keys": keys, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "tags": [], "note": {}}
    folder = table._written(first_per_key(rows, keys, [F.col(c) for c in order]), keys, buckets)
    table._publish({**first, "live": {str(b): folder for b in table._buckets_in(folder)}})
    return table
