"""Keyed tables that are merged, expired and compacted: a base in key buckets, deltas, and a manifest a version.

Every write makes new files first and becomes visible with its manifest, a small JSON document that is renamed into place.
A rename onto an existing version fails, so of two writers one begins again, and a write that dies leaves the old
version and files that no manifest names, which vacuum removes. The file system must rename without overwriting, as
HDFS and local disks do.

A row's version is the last by the order column, and by time of writing on ties. Rows are found by key alone: a merge
writes only the rows it is given, and reading picks the newest with an aggregate that is combined before its shuffle, so
a key with many versions is no hot spot. Null keys are equal to each other. compact rewrites the buckets that deltas
or expiry touch, and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import delete

#: Versions of a row: the number of the write, and the bucket of its key.
WRITTEN, BUCKET = "_written", "_bucket"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    # -- files and manifests ---------------------------------------------------------------------------------------

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def versions(self) -> list[int]:
        fs, folder = self._file(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, base (bucket -> folder), deltas (folders), cuts ([written, value]) and marks of a version."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version not in found:
            return {"version": 0, "schema": None, "base": {}, "deltas": [], "cuts": [], "marks": {}}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{version:012d}.json").values().first()
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        """Write the next manifest under another name and rename it, which only one writer can."""
        version = manifest["version"] + 1
        fs, target = self._file(f"{self.path}/manifests/{version:012d}.json")
        _, made = self._file(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Write rows by bucket in a new folder: bucket -> its folder."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self._bucketed(df).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        fs, at = self._file(folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    # -- reading ---------------------------------------------------------------------------------------------------

    def _rows(self, m: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """All versions of all rows of the buckets, without those that a cut has expired."""
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        chosen = set(range(self.buckets) if buckets is None else buckets)
        paths = [p for layer in (m["base"], *m["deltas"]) for b, p in layer.items() if int(b) in chosen]
        full = T.StructType([*schema.fields, T.StructField(WRITTEN, T.LongType())])
        rows = self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        for written, value in m["cuts"]:
            rows = rows.where((F.col(WRITTEN) > written) | F.coalesce(F.col(self.order) >= F.lit(value).cast(schema[self.order].dataType), F.lit(False)))
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != WRITTEN]
        rank = F.struct(*([F.col(self.order)] if self.order else []), F.col(WRITTEN))
        best = rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).agg(F.max_by(F.struct(*names, WRITTEN), rank).alias("_row"))
        return best.select("_row.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version of each row as of a version of the store."""
        m = self.manifest(version)
        if not m["schema"]:
            raise LookupError(f"{self.path} has no version yet")
        return self._newest(self._rows(m)).drop(WRITTEN)

    # -- writing ---------------------------------------------------------------------------------------------------

    def _changed(self, change, tries: int = 5) -> int:
        for i in range(tries):
            m = self.manifest()
            try:
                new = change(m)
                return m["version"] if new is None else self._commit(new)
            except Conflict:
                if i + 1 == tries:
                    raise
        raise AssertionError

    def merge(self, rows: DataFrame, only_new: bool = False, mark: tuple[str, int] | None = None) -> int:
        """Add rows: as newer versions of their keys, or with only_new those whose keys the store lacks, the first by order
        of each. mark: (writer, number); a number not above the writer's last is a repetition and changes nothing."""

        def change(m: dict) -> dict | None:
            if mark and m["marks"].get(mark[0], -1) >= mark[1]:
                return None
            new = rows
            if only_new:
                first = F.min_by(F.struct(*rows.columns), F.struct(*([self.order] if self.order else []), *rows.columns))
                new = rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).agg(first.alias("_row")).select("_row.*")
                if m["schema"]:
                    there = self._rows(m).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).distinct()
                    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(self.keys)]
                    new = new.join(there, same, "left_anti")
            written = self._write(new.withColumn(WRITTEN, F.lit(m["version"] + 1).cast("long")))
            marks = m["marks"] | ({mark[0]: mark[1]} if mark else {})
            return m | {"schema": m["schema"] or rows.schema.json(), "deltas": [*m["deltas"], written], "marks": marks}

        return self._changed(change)

    def expire(self, before) -> int:
        """Rows whose order value is null or below `before` are gone; what is merged later isn't touched.

        Only the order column can expire rows: a row whose newest version is gone has no older one that isn't.
        """
        if not self.order:
            raise ValueError("a store without an order column can't expire rows")
        return self._changed(lambda m: m | {"cuts": [*m["cuts"], [m["version"], str(before)]]})

    def compact(self) -> int:
        """One base file set for each bucket that has deltas, or all buckets after a cut; the same rows as before."""

        def change(m: dict) -> dict | None:
            touched = set(range(self.buckets)) if m["cuts"] else {int(b) for d in m["deltas"] for b in d}
            if not touched:
                return None
            made = self._write(self._newest(self._rows(m, touched)))
            base = {int(b): p for b, p in m["base"].items() if int(b) not in touched} | made
            return m | {"base": base, "deltas": [], "cuts": []}

        return self._changed(change)

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but for the last `keep`, and folders that none of those names. Returns how many folders went."""
        found = self.versions()
        kept = [self.manifest(v) for v in found[-keep:]]
        named = {p.rsplit("/", 1)[0] for m in kept for layer in (m["base"], *m["deltas"]) for p in layer.values()}
        for v in found[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{v:012d}.json")
        fs, folder = self._file(f"{self.path}/data")
        gone = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = [n for n in gone if not any(p.endswith(f"/{n}") for p in named)]
        for n in gone:
            delete(self.spark, f"{self.path}/data/{n}")
        return len(gone)


def stream_into(store: Store, stream: DataFrame, checkpoint: str, name: str, mode: str = "append", only_new: bool = False, **options):
    """Start a stream whose batches are merged into the store, each once: a batch that is run again finds its mark."""

    def put(batch: DataFrame, number: int) -> None:
        store.merge(batch, only_new, (name, number))

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()
