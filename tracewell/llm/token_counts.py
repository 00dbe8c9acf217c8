"""Token counts as delta-maintained rollups.

A change record says that a document was inserted, deleted or recounted under a tokenizer
version, with its token count (and the count before, for recounts). A batch of records becomes
signed sums by source, language and tokenizer, and is added to the totals once, however often it
is sent; the corpus is never recounted.

A batch's sums are written to a folder named after the batch and the attempt, and it counts from
when Spark's mark of a finished write is there. Of several finished attempts at one batch, which
two writers at once may make, readers take the first by name. So nothing is renamed or
overwritten, which object stores can't do atomically, and a job that dies half-way leaves nothing
that a reader sees. Totals are kept in a base: every ``FOLD`` batches the base and the sums since
are folded into a new base, which lists the batches in it; what readers add up is the newest
finished base and fewer than ``FOLD`` batches or so, however many were committed. ``vacuum``
deletes what a base has replaced.

Edge cases: null sources, languages and tokenizers are groups of their own; a null text has no
tokens; a null count adds 0; an unknown operation fails the batch; an empty batch commits and
adds nothing; repeated records count each; groups whose totals return to 0 stay, at 0. A hot
source is summed within its partitions first, so its shuffled rows don't grow with its documents.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, table

KEYS = ["source", "lang", "tokenizer"]
_WORD = r"[^\x20\x09-\x0D]+"

#: Unfolded batches from which a commit folds them.
FOLD = 16

#: Tokenizer versions that are counted without Python.
COUNTERS = {
    "space/1": lambda text: F.regexp_count(text, F.lit(_WORD)).cast("long"),
    "bytes/1": lambda text: F.octet_length(text).cast("long"),
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return COUNTERS[tokenizer](F.coalesce(text, F.lit("")))


def count_bpe(rows: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``rows`` with the number of byte-level BPE tokens of each whole text, by the ranks in ``path``."""
    from .bpe import counted

    return counted(rows, path, pattern, text, out)


def change(rows: DataFrame, op: str, tokenizer: str, n_tokens: Column, before: Column | None = None) -> DataFrame:
    """Change records for documents (doc_id, source, lang)."""
    was = F.lit(None) if before is None else before
    return rows.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens.cast("long").alias("n_tokens"), was.cast("long").alias("before"))


def signed(changes: DataFrame) -> DataFrame:
    """The sums that a batch adds to each group's totals."""
    n, was = F.coalesce("n_tokens", F.lit(0)), F.coalesce("before", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    docs = F.coalesce(docs, F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - was)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("docs"), F.sum(tokens).alias("tokens"))


_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, fold: int = FOLD):
        self.spark, self.folder, self.fold_at = prepare(spark), folder.rstrip("/"), fold
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _named(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()[:32]

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _finished(self, folder: str, mark: str = "") -> list[str]:
        """The attempts in a folder whose write has finished."""
        return [n for n in self._names(folder) if self._fs.exists(self._path(f"{folder}/{n}{mark}/_SUCCESS"))]

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest finished base (its number comes first in its name), and the batches in it."""
        done = self._finished(f"{self.folder}/bases", "/batches")
        if not done:
            return None, set()
        newest = min((n for n in done if n[:12] == done[-1][:12]))
        folder = f"{self.folder}/bases/{newest}"
        return newest, {r.value for r in self.spark.read.text(f"{folder}/batches").collect()}

    def _loose(self, folded: set[str]) -> dict[str, str]:
        """The committed batches that are in no base, and the folder of each one's sums."""
        found = {}
        for name in self._names(f"{self.folder}/batches"):
            if name not in folded:
                done = self._finished(f"{self.folder}/batches/{name}")
                if done:
                    found[name] = f"{self.folder}/batches/{name}/{done[0]}"
        return found

    def committed(self, batch: str) -> bool:
        name = self._named(batch)
        return bool(self._finished(f"{self.folder}/batches/{name}")) or name in self._base()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if a batch of this id has been added before."""
        if self.committed(batch):
            return False
        signed(changes).write.parquet(f"{self.folder}/batches/{self._named(batch)}/{uuid.uuid4().hex}")
        if len(self._loose(self._base()[1])) >= self.fold_at:
            self.fold()
        return True

    def _sums(self, base: str | None, loose: dict[str, str]) -> DataFrame:
        folders = [*([f"{self.folder}/bases/{base}/sums"] if base else []), *loose.values()]
        rows = self.spark.read.schema(_SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], _SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def fold(self) -> None:
        """Write a new base that holds the newest one and the batches since."""
        base, folded = self._base()
        loose = self._loose(folded)
        if not loose:
            return
        number = int(base[:12]) + 1 if base else 0
        target = f"{self.folder}/bases/{number:012d}-{uuid.uuid4().hex}"
        self._sums(base, loose).write.parquet(f"{target}/sums")
        # The list comes last: without it the base isn't finished.
        self.spark.createDataFrame([(n,) for n in sorted(folded | set(loose))], "value string").write.text(f"{target}/batches")

    def vacuum(self) -> None:
        """Delete the sums of folded batches and all but the newest base. No reader may be at work."""
        base, folded = self._base()
        for name in self._names(f"{self.folder}/batches"):
            if name in folded:
                self._fs.delete(self._path(f"{self.folder}/batches/{name}"), True)
        for name in self._names(f"{self.folder}/bases"):
            if base and name != base and name[:12] <= base[:12]:
                self._fs.delete(self._path(f"{self.folder}/bases/{name}"), True)

    def totals(self) -> DataFrame:
        base, folded = self._base()
        return self._sums(base, self._loose(folded))

    def delete(self) -> None:
        self._fs.delete(self._path(self.folder), True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, send the load again, fold, recount one tokenizer with an end token, retire documents without text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}")
    text = F.col("text")
    inserts = lambda kind: change(docs, "insert", kind, count_tokens(text, kind))
    for kind in COUNTERS:
        rollup.commit(f"load {kind}", inserts(kind))
    rollup.commit("load space/1", inserts("space/1"))
    rollup.fold()
    n = count_tokens(text, "space/1")
    rollup.commit("end tokens", change(docs, "revise", "space/1", n + 1, n))
    empty = docs.where(F.coalesce(text, F.lit("")) == "")
    rollup.commit("retire", change(empty, "delete", "space/1", F.lit(1)).unionByName(change(empty, "delete", "bytes/1", F.lit(0))))
    out = cut(rollup.totals())
    rollup.delete()
    return out


ORACLE = {
    "op8_token_counts": r"""
SELECT source, lang, 'space/1' AS tokenizer, CAST(count(*) FILTER (WHERE coalesce(text, '') <> '') AS BIGINT) AS docs,
  CAST(sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 END) AS BIGINT) AS tokens
FROM documents GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes/1', CAST(count(*) FILTER (WHERE coalesce(text, '') <> '') AS BIGINT), CAST(sum(strlen(coalesce(text, ''))) AS BIGINT)
FROM documents GROUP BY source, lang""",
}
