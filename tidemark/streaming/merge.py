"""A keyed store that a stream merges into batch by batch: bucketed files under a manifest, so that a batch that runs again changes nothing.

Layout under the store's folder: data/<batch>-<unique>/bucket=<b>/ holds rows, manifest/version=<batch>/ one row a bucket: the folder of its files. A batch
reads and rewrites the buckets that its keys hash to, and its manifest makes them visible at once; what a failed attempt has left is named by no manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists


class KeyedStore:
    """Last write of each key, by batch, then by `seq` within it; first_batch and batch tell when a key came and when it last changed."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.seq, self.buckets = spark, path, keys, seq, buckets

    def version(self) -> int:
        """The last batch that was merged, -1 before the first."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return -1
        return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version").cast("long").alias("v")).first().v

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of a version: a row a bucket."""
        version = self.version() if version is None else version
        return {} if version < 0 else {r.bucket: r.folder for r in self.spark.read.parquet(f"{self.path}/manifest").where(F.col("version") == version).collect()}

    def merge(self, batch: DataFrame, number: int) -> None:
        """Upserts a batch; one that the manifest knows already, or an older one, is left as it is. Rows with a null key are rows of that key."""
        if number <= self.version():
            return
        held = self.folders()
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).withColumn("first_batch", F.lit(number).cast("long")).withColumn("batch", F.lit(number).cast("long"))
        folder = f"{self.path}/data/{number:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}-in")  # the batch is read twice, and a stream's source only once
        rows = self.spark.read.schema(rows.schema).parquet(f"{folder}-in")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most the number of buckets
        old = [f"{held[b]}/bucket={b}" for b in touched if b in held]
        both = rows
        if old:
            before = self.spark.read.parquet(*old)
            both = rows.unionByName(before.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), allowMissingColumns=True)
        w = Window.partitionBy("bucket", *self.keys)
        first = F.min("first_batch").over(w)
        newest = F.row_number().over(w.orderBy(F.desc("batch"), F.desc(self.seq)))
        kept = both.withColumn("first_batch", first).withColumn("__rn", newest).where("__rn = 1").drop("__rn")
        if touched:
            kept.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        now = held | {b: folder for b in touched}
        lines = self.spark.createDataFrame(list(now.items()), "bucket int, folder string")
        lines.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")  # one file: it is there or it isn't

    def read(self, schema=None, version: int | None = None) -> DataFrame:
        """The store's rows as of a version; an empty store needs a schema."""
        found = [f"{f}/bucket={b}" for b, f in sorted(self.folders(version).items())]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("mergeSchema", True).parquet(*found)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names; returns how many."""
        fs_path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        if not exists(self.spark, f"{self.path}/data"):
            return 0
        last = [r.version for r in self.spark.read.parquet(f"{self.path}/manifest").select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        used = {f.rstrip("/").rpartition("/")[2] for v in last for f in self.folders(v).values()}
        top = fs_path(f"{self.path}/data")
        system = top.getFileSystem(conf)
        gone = [x.getPath() for x in system.listStatus(top) if x.getPath().getName() not in used]
        for p in gone:
            system.delete(p, True)
        return len(gone)
