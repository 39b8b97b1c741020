"""Tables in versions: data files of bounded size, and a manifest that says which of them are the table.

A change writes new files for the buckets that it touches and then a manifest with the next number; readers take
the manifest with the greatest number, so they see a change whole or not at all, and a writer that dies
leaves files that no manifest names.  A manifest has each file's bucket, rows and least and greatest values
of chosen columns, by which readers leave files out; it also has the last batch of every stream that
wrote to the table, so a batch that comes again changes nothing.  The last ``keep`` versions stay, for readers that
are under way.  There is one writer at a time.

The manifest is held by the driver: some hundred bytes a file of ``FILE_MB``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import size_of

FILE_MB = 128


class Table:
    """A table of one row a ``key``, in hash buckets of it, each cut into files by ranges of ``order``.

    ``stats``: columns whose least and greatest values the manifest keeps (numbers, texts or booleans).
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", order: str | None = None, stats: tuple[str, ...] = (), buckets: int = 64, keep: int = 2, file_mb: int = FILE_MB) -> None:
        self.spark, self.folder, self.key, self.order, self.buckets, self.keep, self.file_mb = spark, folder.rstrip("/"), key, order or key, buckets, keep, file_mb
        self.stats = tuple(dict.fromkeys([self.order, *stats]))

    # ---- files ------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._files(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """The newest manifest, or that of a version; None before the first write."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        stream = self._files().open(self._path(f"_manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, Any]) -> None:
        fs = self._files()
        draft, final = self._path(f"_manifests/.draft-{uuid.uuid4().hex}"), self._path(f"_manifests/{manifest['version']:012d}.json")
        out = fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.folder} was written by someone else")

    def _tidy(self) -> None:
        """Deletes versions before the last ``keep``, and data that no kept manifest names."""
        fs, known = self._files(), self.versions()
        named = {f["file"].split("/")[1] for v in known[-self.keep :] for f in self.manifest(v)["files"]}
        for v in known[: -self.keep]:
            fs.delete(self._path(f"_manifests/{v:012d}.json"), False)
        for name in self._names("data"):
            if name not in named and not name.startswith("."):
                fs.delete(self._path(f"data/{name}"), True)

    # ---- reading ----------------------------------------------------------------------------------

    def _of(self, manifest: dict[str, Any], files: list[dict[str, Any]]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f['file']}" for f in files])

    def read(self, **between: tuple[Any, Any]) -> DataFrame | None:
        """The newest version; of ``column=(least, greatest)`` (None: open) only files that may have such rows, and of those only such rows."""
        manifest = self.manifest()
        if manifest is None:
            return None
        return self._within(self._of(manifest, [f for f in manifest["files"] if _may_hold(f, between)]), between)

    @staticmethod
    def _within(rows: DataFrame, between: dict[str, tuple[Any, Any]]) -> DataFrame:
        for column, (low, high) in between.items():
            rows = rows.where(F.col(column) >= F.lit(low)) if low is not None else rows
            rows = rows.where(F.col(column) <= F.lit(high)) if high is not None else rows
        return rows

    # ---- writing ----------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int, parts: int) -> list[dict[str, Any]]:
        """Writes files in ranges of (bucket, order) and returns what the manifest has of them."""
        rows, folder = rows.select("*"), f"data/{version:012d}-{uuid.uuid4().hex[:8]}"
        cut = rows.withColumn("_bucket", self._bucket()).repartitionByRange(parts, "_bucket", self.order).sortWithinPartitions("_bucket", self.order)
        cut.write.partitionBy("_bucket").parquet(f"{self.folder}/{folder}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{folder}")
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(_bucket=-?\d+/[^/]+)$", 1)
        ends = [f(c).alias(f"{c}_{n}") for c in self.stats for n, f in (("min", F.min), ("max", F.max))]
        found = back.groupBy(name.alias("_file")).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.col("_metadata.file_size")).alias("_bytes"), *ends).collect()  # a row a file
        return [
            {"file": f"{folder}/{r['_file']}", "bucket": int(r["_file"].split("/")[0].split("=")[1]), "rows": r["_rows"], "bytes": r["_bytes"], "ends": {c: [r[f"{c}_min"], r[f"{c}_max"]] for c in self.stats}}
            for r in found
        ]

    def _parts(self, size: int, buckets: int) -> int:
        return max(1, min(buckets, 8), -(-size // (self.file_mb << 20)))

    def replace(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Makes ``rows`` the whole table."""
        old = self.manifest()
        version = old["version"] + 1 if old else 1
        files = self._written(rows, version, self._parts(size_of(rows), self.buckets))
        seen = (old["batches"] if old else {}) | ({stream: batch} if stream is not None else {})
        self._publish({"version": version, "schema": rows.schema.jsonValue(), "batches": seen, "files": files})
        self._tidy()

    def merge(self, changes: DataFrame, combined: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None) -> bool:
        """Puts ``combined(rows of the touched buckets, changes)`` in place of those buckets; False where the batch was merged before.

        ``combined`` returns rows of the buckets that it was given only, in the table's columns.
        """
        old = self.manifest()
        if old is None:
            raise ValueError(f"{self.folder} has no version yet")
        if stream is not None and old["batches"].get(stream, -1) >= batch:
            return False
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}  # as many as buckets
        mine = [f for f in old["files"] if f["bucket"] in touched]
        schema = StructType.fromJson(old["schema"])
        files = []
        if touched:
            rows = combined(self._of(old, mine), changes).select(*schema.names)
            files = self._written(rows, old["version"] + 1, self._parts(sum(f["bytes"] for f in mine) + size_of(changes), len(touched)))
        seen = old["batches"] | ({stream: batch} if stream is not None else {})
        self._publish({"version": old["version"] + 1, "schema": old["schema"], "batches": seen, "files": [f for f in old["files"] if f["bucket"] not in touched] + files})
        self._tidy()
        return True


def _may_hold(file: dict[str, Any], between: dict[str, tuple[Any, Any]]) -> bool:
    for column, (low, high) in between.items():
        if column not in file["ends"]:
            continue
        least, greatest = file["ends"][column]
        if least is None:  # nulls only, which no range holds
            return False
        if (high is not None and least > high) or (low is not None and greatest < low):
            return False
    return True
