"""Incremental scans: recompute what changed, keep the rest, and the same detectors over streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CACHE_DAYS
from ..operators.relate import cache_split
from ..plans.session import cut, shared_folder

KEYS = ["key", "stamp", "version"]


class Store:
    """Results by (key, stamp, version) as Parquet.

    A run adds a folder with the results that it computed and one with the keys that it saw again,
    so a warm run writes little more than keys. A folder counts from when Spark's mark of a finished
    write is in it, so a run that dies adds nothing. ``compact`` puts what is still in use into
    one folder and deletes those that it read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[str]:
        root = self._path(f"{self.folder}/{kind}")
        found = [f"{self.folder}/{kind}/{f.getPath().getName()}" for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(f for f in found if self._fs.exists(self._path(f"{f}/_SUCCESS")))

    def runs(self) -> int:
        """How many folders there are."""
        return len(self._finished("runs")) + len(self._finished("seen"))

    def load(self, now, days: int = CACHE_DAYS) -> DataFrame | None:
        """What was computed, or seen again, in the last days, of each key the latest."""
        runs, seen = self._finished("runs"), self._finished("seen")
        if not runs:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*runs)
        every = F.struct(*[F.col(c) for c in rows.columns])
        rows = rows.groupBy(*KEYS).agg(F.max_by(every, "last_seen").alias("_r")).select("_r.*")
        if seen:
            again = self.spark.read.parquet(*seen).groupBy(*KEYS).agg(F.max("last_seen").alias("_again"))
            rows = rows.join(again, KEYS, "left").withColumn("last_seen", F.greatest("last_seen", "_again")).drop("_again")
        return rows.where(F.col("last_seen") >= F.lit(now) - F.make_dt_interval(F.lit(days)))

    def add(self, rows: DataFrame, kind: str = "runs") -> None:
        rows.write.parquet(f"{self.folder}/{kind}/{uuid.uuid4().hex}")

    def run(self, current: DataFrame, version: str, compute: Callable[[DataFrame], DataFrame], now) -> tuple[DataFrame, int]:
        """Results for ``current`` (key, stamp, ...): stored ones where nothing changed, computed ones elsewhere, and how many were computed.

        ``compute`` gets the rows to compute and returns one row for each key.
        """
        current = current.withColumn("version", F.lit(version))
        stored = self.load(now)
        fresh = current if stored is None else cache_split(current, stored, KEYS)[1]
        done = cut(fresh.select(*KEYS).join(compute(fresh), "key").withColumn("last_seen", F.lit(now)))
        n = done.count()
        if stored is None:
            self.add(done)
            return done, n
        reused = cut(current.select(*KEYS).join(stored, KEYS).withColumn("last_seen", F.lit(now)))
        if n:
            self.add(done)
        self.add(reused.select(*KEYS, "last_seen"), "seen")
        return done.unionByName(reused, allowMissingColumns=True), n

    def compact(self, now, days: int = CACHE_DAYS) -> None:
        """Put what is in use into one folder. No other run may be at work."""
        old = self._finished("runs") + self._finished("seen")
        rows = self.load(now, days)
        if rows is not None:
            self.add(rows)
            for folder in old:
                self._fs.delete(self._path(folder), True)


def tool_counts(events: DataFrame) -> DataFrame:
    """A session's calls and failures."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("tool_count"), F.count_if(F.col("value") > 60).alias("errors"), F.max("ts").alias("last_seen"))


def merged(parts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    return parts.groupBy("user_id").agg(F.sum("tool_count").alias("tool_count"), F.sum("errors").alias("errors"), F.max("last_seen").alias("last_seen"))


def stream_counts(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there; each batch's counts go to a folder of the batch's number, so a batch that runs again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        tool_counts(batch).write.mode("overwrite").parquet(f"{folder}/batches/{number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.parquet(f"{folder}/batches/*"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream that ends when it has read what is there; the counts equal a batch's."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = cut(stream_counts(spark, stream, folder))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out
