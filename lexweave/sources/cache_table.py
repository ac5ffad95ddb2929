"""The cache as a table in a shared folder: merges by key, snapshots, and imports of JSON files that count once.

Entries are dealt by their keys to buckets, each a folder of Parquet files that is never changed. A merge reads the buckets that the new
keys fall in, writes them anew, and publishes a version: a small file that names the folder of every bucket. Readers go by the latest
version, so they see a merge whole or not at all, and what a killed job has written is named by nothing. Of two writers one publishes
first; the other takes over the other's buckets where they aren't its own, and otherwise merges again with what is there now.

The number of buckets is set when the table is made and bounds the version file. Keys are unique, so buckets are even.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import cache
from lexweave.sources import files
from lexweave.storage import dropped, stored

KEY = ["cache_type", "cache_key"]
LOADS = "path string, cache_type string, fingerprint string"
FILES = "path string, fingerprint string, seq int, cache_key string, translated_text string, payload_json string, error string"


def read_json(found: DataFrame) -> DataFrame:
    """(path, fingerprint, seq, cache_key, translated_text, payload_json, error) of binary files (path, fingerprint, content), each a JSON object from key to text or object.

    A file that is no JSON object gives one row with an error. One file is parsed by one task, in whole.
    """
    def rows(path: str, fingerprint: str, content: bytes) -> Iterator[tuple]:
        try:
            root = json.loads(content.decode())
            if not isinstance(root, dict):
                raise ValueError("the root is no object")
        except ValueError as e:
            yield path, fingerprint, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for k, (key, value) in enumerate(root.items()):
            said = value if isinstance(value, str) else str((value.get("translation") or "") if isinstance(value, dict) else "")
            yield path, fingerprint, k, key, said, json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None, None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file in part.itertuples(index=False):
                yield pd.DataFrame(rows(*file), columns=[c.split()[0] for c in FILES.split(", ")]).astype({"seq": "Int32"})

    return found.select("path", "fingerprint", "content").mapInPandas(run, FILES)


class CacheTable:
    """A cache in a folder; it is made when first written to, with the number of buckets given then."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.empty = {"version": 0, "count": buckets, "buckets": {}, "loads": None}

    # --- versions

    def versions(self) -> list[int]:
        """Published versions that are still there."""
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the latest, consists of."""
        known = self.versions()
        if version is None and not known:
            return self.empty
        return files.load_json(self.spark, self._file(known[-1] if version is None else version))

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}.json"

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(count)).cast("int")

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{own}/bucket={b}" for b, own in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(cache.ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], cache.ENTRY)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All entries of a version."""
        return self._read(self.manifest(version))

    def loads(self, manifest: dict | None = None) -> DataFrame:
        """(path, cache_type, fingerprint) of the JSON files that have been imported."""
        own = (manifest or self.manifest())["loads"]
        return self.spark.read.schema(LOADS).parquet(f"{self.folder}/loads/{own}") if own else self.spark.createDataFrame([], LOADS)

    def _changed(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], loads: DataFrame | None = None, attempts: int = 20) -> int:
        """Publish the table with the buckets of `keys` put through `change`; the version, or the present one if there are no such buckets."""
        for _ in range(attempts):
            base = self.manifest()
            touched = sorted(r[0] for r in keys.select(self._bucket(base["count"]).alias("b")).distinct().collect())  # at most one a bucket
            if not touched and loads is None:
                return base["version"]
            own, new = uuid.uuid4().hex, dict(base["buckets"])
            if touched:
                after = change(self._read(base, touched)).withColumn("bucket", self._bucket(base["count"]))
                after.repartition(min(len(touched), 1000), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{own}")
                filled = {n.split("=")[1] for n in files.names(self.spark, f"{self.folder}/data/{own}") if n.startswith("bucket=")}
                new = {b: v for b, v in new.items() if int(b) not in touched} | dict.fromkeys(filled, own)
            log = base["loads"]
            if loads is not None:
                log = own
                self.loads(base).join(loads.select("path", "cache_type"), ["path", "cache_type"], "left_anti").select(*loads.columns).unionByName(loads).write.parquet(f"{self.folder}/loads/{own}")
            while True:
                version = base["version"] + 1
                if files.write_json(self.spark, self._file(version), {"version": version, "count": base["count"], "buckets": new, "loads": log}, replace=False):
                    return version
                theirs = self.manifest()
                moved = {int(b) for b in {*theirs["buckets"], *base["buckets"]} if theirs["buckets"].get(b) != base["buckets"].get(b)}
                if moved & set(touched) or theirs["loads"] != base["loads"] and loads is not None:
                    break  # what was read has changed: once more
                new = {b: v for b, v in theirs["buckets"].items() if int(b) not in touched} | {b: v for b, v in new.items() if int(b) in touched}
                log, base = (log if loads is not None else theirs["loads"]), theirs
        raise RuntimeError(f"other writers came first {attempts} times")

    # --- changes

    def upsert(self, entries: DataFrame) -> int:
        """Merge entries, as cache.entries() makes them, into the table."""
        own = stored(cache.last_of_each(entries), "cache-entries")
        version = self._changed(own, partial(cache.merged, new=own))
        dropped(own)
        return version

    def delete(self, keys: DataFrame) -> int:
        """Remove the entries of keys (cache_type, cache_key)."""
        own = keys.select(*KEY).distinct()
        return self._changed(own, lambda old: old.join(own, KEY, "left_anti"))

    def touch(self, usage: DataFrame) -> int:
        """Count uses (cache_type, cache_key, used_at)."""
        return self._changed(usage, lambda old: cache.with_usage(old, usage).select(*old.columns))

    def get(self, asked: DataFrame) -> DataFrame:
        """asked (cache_type, cache_key) with value: the entry's JSON value where it has a valid one, else its text; null where there is none.

        Only the buckets of the keys asked for are read. What was found is for touch() to count.
        """
        base = self.manifest()
        wanted = sorted(r[0] for r in asked.select(self._bucket(base["count"]).alias("b")).distinct().collect())
        value = F.when(F.try_parse_json("payload_json").isNotNull(), F.col("payload_json")).otherwise(F.col("translated_text"))
        return asked.join(self._read(base, wanted).select(*KEY, value.alias("value")), KEY, "left")

    def migrate(self, path: str, cache_type: str, now: int) -> DataFrame:
        """Import the JSON files under a path: (path, imported, error) of those that were not imported before as they are now."""
        found = self.spark.read.format("binaryFile").load(path)
        fresh = cache.unseen_files(found, self.loads().where(F.col("cache_type") == cache_type))
        rows = stored(read_json(fresh), "cache-files")
        loads = rows.where("error is null").select("path", F.lit(cache_type).alias("cache_type"), "fingerprint").distinct()
        named = stored(loads.unionByName(stored_empty(fresh, rows, cache_type)), "cache-loads")
        good = rows.where("error is null").withColumn("cache_type", F.lit(cache_type)).withColumn("seq", F.struct("path", "seq"))
        entries = stored(cache.last_of_each(cache.entries(good, now)), "cache-entries")
        if not named.isEmpty():
            self._changed(entries, partial(cache.merged, new=entries), named)
        counted = F.count_if(F.col("cache_key").isNotNull() & (F.col("translated_text") != ""))
        return rows.groupBy("path").agg(counted.alias("imported"), F.max("error").alias("error"))

    # --- room

    def expire(self, keep: int) -> None:
        """Forget all but the last `keep` versions, and delete what no version left names.

        To be run while no other job writes or reads older versions.
        """
        known = self.versions()
        for v in known[: max(0, len(known) - keep)]:
            files.removed(self.spark, self._file(v))
        left = [self.manifest(v) for v in self.versions()]
        used = {own for m in left for own in m["buckets"].values()} | {m["loads"] for m in left}
        for part in ("data", "loads"):
            for own in files.names(self.spark, f"{self.folder}/{part}"):
                if own not in used:
                    files.removed(self.spark, f"{self.folder}/{part}/{own}")


def stored_empty(fresh: DataFrame, rows: DataFrame, cache_type: str) -> DataFrame:
    """The load log's rows of files that hold an empty object, and so no rows."""
    return fresh.select("path", F.lit(cache_type).alias("cache_type"), "fingerprint").join(rows.select("path").distinct(), "path", "left_anti")
