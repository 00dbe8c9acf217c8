"""Scans that score again only what has changed: session facts are kept by file, stamp and rules."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import datasource
from ..sources.transcripts import read_events, source
from ..streaming.incremental import Store
from .scan import Pack, session_facts

#: Up to so many changed files are named to the reader, which then opens no other; of more, all are read and the others' events dropped.
NAMED = 5_000
#: Folders of runs after which a store is compacted.
RUNS = 16


def version_of(pack: Pack) -> str:
    """What facts depend on besides their file: a pack's rules."""
    return hashlib.sha256(repr(pack).encode()).hexdigest()[:16]


def changed_events(spark: SparkSession, path: str, fmt: str, keys: DataFrame) -> DataFrame:
    """Events of the files whose paths are given (key)."""
    named = [r.key for r in keys.select("key").limit(NAMED + 1).collect()] if fmt in datasource.KINDS else None
    if named is not None and len(named) <= NAMED:
        return datasource.events(spark, path, fmt, only=F.col("path").isin(named) if named else F.lit(False))
    return read_events(spark, path, fmt).join(keys.select(F.col("key").alias("path")), "path", "left_semi")


def rescan(spark: SparkSession, path: str, folder: str, fmt: str = "claude", pack: Pack = Pack(), now: datetime | None = None) -> tuple[DataFrame, int]:
    """The facts of all sessions in files below a path, and how many files were scored; the rest is from the store in ``folder``.

    A file that holds no event has no facts and is looked at again each time.
    """
    stamps = source(fmt).stamp(spark, path).select(F.col("handle").alias("key"), "stamp")
    store = Store(spark, folder)
    if store.runs() > RUNS:
        store.compact(now or datetime.now())
    facts = lambda fresh: session_facts(changed_events(spark, path, fmt, fresh), pack).withColumn("key", F.col("path"))
    rows, n = store.run(stamps, version_of(pack), facts, now or datetime.now())
    return rows.drop("key", "stamp", "version", "last_seen"), n
