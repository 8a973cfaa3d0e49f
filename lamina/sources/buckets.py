"""A table kept in buckets by a hash of its keys, of which only touched ones are rewritten and switched at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
COLUMN = "bucket_no"


class BucketedTable:
    """Rows under ``folder``/gen=<id>/bucket_no=<n>; a manifest names the generation that each bucket is read from.

    A replacement writes a new generation beside the old ones and then renames the new manifest over the old
    in one step, so readers see the old rows or the new ones, never a mixture. What a replacement makes stale is
    removed by the next one, so a read that began before a switch can end. The rename goes through Hadoop's
    file system, so any shared folder will do. ``buckets`` is fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.buckets = self._manifest().get("buckets", buckets)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _manifest(self) -> dict:
        path = self._path("manifest.json")
        return json.loads(self.spark.read.text(str(path.toString()), wholetext=True).first()[0]) if self.fs.exists(path) else {}

    def _switch(self, manifest: dict) -> None:
        pending, current = self._path(f"pending-{uuid.uuid4().hex}.json"), self._path("manifest.json")
        out = self.fs.create(pending, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.fs.makeQualified(pending), self.fs.makeQualified(current), options)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def numbers(self, rows: DataFrame) -> list[int]:
        """Buckets that rows with the keys fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def generations(self) -> dict[int, str]:
        return {int(b): g for b, g in self._manifest().get("current", {}).items()}

    def read(self, only: Iterable[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None before anything was written."""
        told = self._manifest()
        if not told:
            return None
        schema = StructType.fromJson(told["schema"])
        wanted = set(map(int, told["current"])) if only is None else set(only)
        paths = [f"{self.folder}/gen={g}/{COLUMN}={b}" for b, g in told["current"].items() if int(b) in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def replace(self, rows: DataFrame, touched: Iterable[int] | None = None) -> None:
        """``rows`` instead of all that the ``touched`` buckets hold (without ``touched``: instead of all)."""
        told, gen = self._manifest(), uuid.uuid4().hex
        rows.withColumn(COLUMN, self.bucket()).repartition(COLUMN).write.partitionBy(COLUMN).parquet(f"{self.folder}/gen={gen}")
        written = {p.getPath().getName().split("=")[1] for p in self.fs.listStatus(self._path(f"gen={gen}")) if "=" in p.getPath().getName()}
        old = told.get("current", {})
        gone = set(old) if touched is None else {str(b) for b in touched}
        assert touched is None or written <= gone, "rows outside the touched buckets"
        stale = [f"gen={old[b]}/{COLUMN}={b}" for b in gone if b in old]
        kept = {b: g for b, g in old.items() if b not in gone}
        self._switch({"buckets": self.buckets, "schema": rows.schema.jsonValue(), "current": kept | {b: gen for b in written}, "stale": stale})
        for name in told.get("stale", []):
            self.fs.delete(self._path(name), True)

    def upsert(self, fresh: DataFrame, order: str) -> None:
        """``fresh`` rows put in: of equal keys the greatest ``order`` stays. Only buckets that they fall into are rewritten."""
        touched = self.numbers(fresh)
        if not touched and self._manifest():
            return
        old = self.read(touched)
        rows = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
        w = W.partitionBy(*self.keys).orderBy(F.desc(order))
        self.replace(rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), touched)
