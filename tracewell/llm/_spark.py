"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, at most, that a Python worker gets at once (a longer row comes alone).
BATCH = 8 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and see to a folder for checkpoints.

    The folder is the one that ``spark.checkpoint.dir`` names. Only where a session
    names none, as in tests, a temporary one is made.
    """
    sc = spark.sparkContext
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` as a Parquet table, which takes less room where rows hold texts."""
    spark = prepare(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(*cuts: DataFrame) -> None:
    """Delete the files of frames from ``cut`` that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *cuts: DataFrame) -> None:
    """Delete the files of frames from ``cut`` that nothing reads any more, and let Spark delete shuffled files that nothing refers to."""
    forget(*cuts)
    gc.collect()  # what Python doesn't hold any more, the JVM can let go
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def range_bits(df: DataFrame, least: int, each: int, most: int) -> int:
    """Into how many ranges of hashes (as bits) to deal what a table's texts hold: about ``each`` bytes of input a range.

    The table's size is the optimiser's estimate, which costs no job; where it has none, ``least``.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return least
    return min(most, max(least, (size // each).bit_length()))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal digits, mod 5: the split between learning and held-out rows.

    A null id gives the fold of the empty string.
    """
    digits = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return (F.crc32(digits.cast("binary")) % 5).cast("int")
