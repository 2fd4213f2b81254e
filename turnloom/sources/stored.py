"""Stored tables that take upserts by key: buckets are rewritten whole, and a log of commits says which files count.

``data/<name>/_bucket=<n>`` holds the rows of a bucket as one write left them; ``commits`` is a log of JSON rows
(version, batch, bucket, folder), one file for each commit, that a rename makes visible in one step. The newest row of a bucket names its folder.
Whatever is cut off before the commit leaves files that nothing names; whatever is repeated after it finds its batch in the log.
A table has one writer at a time and any number of readers, who see the last commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


COMMIT = "version long, batch string, bucket int, folder string"


class StoredTable:
    """Rows by key; ``order`` (never NULL) says which of two rows of a key is the later one, ``keep_first`` comes from the earliest, ``counters`` add up.

    In whatever order batches arrive, the table ends the same.
    ``keys`` may hold NULL, which is a key like any other. ``buckets`` is fixed for the life of a table: some hundred MB of rows to a bucket
    is a fair measure, as an upsert rewrites the buckets it touches and no others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str,
                 keep_first: list[str] = (), counters: list[str] = (), buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, list(keys), order
        self.keep_first, self.counters, self.buckets = list(keep_first), list(counters), buckets
        fields = T.StructType.fromDDL(schema).fields
        self._columns = [f.name for f in fields]
        kind = next(f.dataType.simpleString() for f in fields if f.name == order)
        # A row carries the least order it was ever written with, so that late rows do not change what was first.
        self._stored = f"{schema}, _first {kind}"

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commits(self) -> DataFrame:
        """The log; empty before the first commit."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits")

    def version(self) -> int:
        return self._commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folders(self, touched: list[int] | None = None) -> dict[int, str]:
        """The folder of each bucket that holds rows: at most ``buckets`` names."""
        rows = self._commits().where("bucket IS NOT NULL")
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(touched))
        return {r.bucket: r.folder for r in rows.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()}

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows of the last commit, or those of some buckets."""
        return self._rows(touched).drop("_first")

    def _rows(self, touched: list[int] | None) -> DataFrame:
        names = [f"{self.path}/data/{folder}/_bucket={bucket}" for bucket, folder in sorted(self._folders(touched).items()) if folder]
        return self.spark.read.schema(self._stored).parquet(*names) if names else self.spark.createDataFrame([], self._stored)

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        wanted = wanted.select(*self.keys).distinct()
        touched = [r.b for r in wanted.select(self._bucket().alias("b")).distinct().collect()]
        same, asked = F.lit(True), wanted.select(*[F.col(k).alias(f"_asked_{k}") for k in self.keys])
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_asked_{k}"))
        return self.read(touched).join(asked, same, "left_semi")

    def _seen(self, batch: str | None) -> bool:
        return batch is not None and not self._commits().where(F.col("batch") == batch).isEmpty()

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, touched: list[int], folder: str, held: set[int], batch: str | None) -> None:
        version = self.version() + 1
        rows = [(version, batch, b, folder if b in held else "") for b in touched] or [(version, batch, None, "")]
        # One file, so that the commit is one rename; at most a row for each bucket.
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def _replace(self, rows: DataFrame, touched: list[int], batch: str | None) -> None:
        folder = self._write(rows.select(*self._columns, "_first"))
        held = {r.b for r in self.spark.read.schema(f"{self._stored}, _bucket int").option("basePath", f"{self.path}/data/{folder}").parquet(
            f"{self.path}/data/{folder}").select(F.col("_bucket").alias("b")).distinct().collect()} if touched else set()
        self._commit(touched, folder, held, batch)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, updates: DataFrame, batch: str | None = None) -> bool:
        """Merge rows into the table; False if a batch of this name is in it already."""
        if self._seen(batch):
            return False
        updates = updates.select(*self._columns, F.col(self.order).alias("_first"))
        touched = self._touched(updates)
        rows = self._rows(touched).unionByName(updates)
        latest = [c for c in self._columns if c not in (*self.keys, *self.keep_first, *self.counters, self.order)]
        merged = rows.groupBy(*self.keys).agg(
            F.max(self.order).alias(self.order), F.min("_first").alias("_first"), *[F.max_by(c, self.order).alias(c) for c in latest],
            *[F.min_by(c, "_first").alias(c) for c in self.keep_first], *[F.sum(c).alias(c) for c in self.counters])
        self._replace(merged, touched, batch)
        return True

    def delete(self, doomed: DataFrame, batch: str | None = None) -> bool:
        """Take out the rows of these keys; False if a batch of this name is in the table already."""
        if self._seen(batch):
            return False
        doomed = doomed.select(*[F.col(k).alias(f"_gone_{k}") for k in self.keys]).distinct()
        touched = self._touched(doomed.select(*[F.col(f"_gone_{k}").alias(k) for k in self.keys]))
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
        self._replace(self._rows(touched).join(doomed, same, "left_anti"), touched, batch)
        return True
