"""An index on disk: bucketed, sorted files under numbered manifests; a new build appears all at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: Builds that stay after a newer one, for readers that still use them.
KEPT = 1


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class DiskIndex:
    """Rows of one schema by one key in a folder that all executors reach (any Hadoop file system).

    ``build`` writes files nobody reads yet and then a manifest under the next number; a manifest is moved into place, and
    moving fails where the number is taken, so readers see whole builds only and of two builders one loses. ``load`` gives
    the newest build, or no rows if there is none. Files of older builds go, but for ``KEPT``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{version}.json", wholetext=True).first().value)

    def build(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        """Writes a new build and returns its number. Keys are sorted within a bucket's files, so their ranges tell readers
        which parts to skip. Rows without key are left out."""
        files = f"build-{uuid.uuid4().hex}"
        data = rows.select(*self.schema.names).where(F.col(self.key).isNotNull()).withColumn("bucket", bucket_of(F.col(self.key), buckets))
        data.repartition(buckets, "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.folder}/{files}")
        version = max(self.versions(), default=0) + 1
        new, fs = self._path(f"{files}.json")
        out = fs.create(new, False)
        out.write(json.dumps({"files": files, "buckets": buckets}).encode())
        out.close()
        place, _ = self._path(f"manifests/{version}.json")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(new, place):
            raise RuntimeError(f"another build took number {version}")
        for old in self.versions()[: -1 - KEPT]:
            gone = self.manifest(old)["files"]
            for name in (f"manifests/{old}.json", gone):
                path, fs = self._path(name)
                fs.delete(path, True)
        return version

    def load(self) -> tuple[DataFrame, int]:
        """The newest build's rows with their bucket, and how many buckets it has."""
        kinds = StructType(list(self.schema.fields)).add("bucket", "integer")
        if not self.versions():
            return self.spark.createDataFrame([], kinds), BUCKETS
        newest = self.manifest(self.versions()[-1])
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/{newest['files']}"), newest["buckets"]

    def some(self, keys: list) -> DataFrame:
        """Rows of a few keys: only their buckets' files are opened, and in them only parts whose range holds a key."""
        rows, buckets = self.load()
        held = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]])).select(bucket_of(F.col(self.key), buckets)).distinct().collect()] if keys else []
        return rows.where(F.col("bucket").isin(held) & F.col(self.key).isin(keys)).drop("bucket")

    def probe(self, asked: DataFrame) -> DataFrame:
        """Rows of the index for every row of ``asked`` (with the key), by a join on bucket and key."""
        rows, buckets = self.load()
        return asked.withColumn("bucket", bucket_of(F.col(self.key), buckets)).join(rows, ["bucket", self.key]).drop("bucket")
