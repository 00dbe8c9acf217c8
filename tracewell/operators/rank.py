"""Ranking, deduplication, sampling, scope and facets of the session table."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Sessions that a view shows, and by which it grows.
PAGE = 25


def dedupe_richest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of rows of one key the first in ``order``; rows without key all stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = rows.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")
    return best.unionByName(rows.where(F.col(key).isNull()))


def ranked(rows: DataFrame, by: list[str], tie: list[str], top: int | None = None) -> DataFrame:
    """Rows by ``by`` from the largest, ties by ``tie`` from the smallest; with ``top`` a bounded sort."""
    out = rows.orderBy(*[F.desc_nulls_last(c) for c in by], *[F.asc(c) for c in tie])
    return out.limit(top) if top else out


#: Bytes of rows, as the optimiser knows them, in one range of an order.
RANGE_BYTES = 64 << 20


def ranges_for(rows: DataFrame) -> int:
    """Into how many ranges to deal rows: as many as their size asks for, and no fewer than there are cores."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = rows.sparkSession.sparkContext.defaultParallelism
    if size >= 1 << 60:  # unknown
        return max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(-(-size // RANGE_BYTES), 100_000))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row``, their place from 0 in ``order``, and how many there are.

    Rows are dealt by ranges and numbered within them; only one row count for each range meets
    in one place.
    """
    many = ranges_for(rows)
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(many, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, bases = 0, []
    for part, n in sizes:
        bases.append((part, total))
        total += n
    base = rows.sparkSession.createDataFrame(bases or [(-1, 0)], "_part long, _base long")
    out = dealt.join(F.broadcast(base), "_part").withColumn("row", F.col("_base") + F.col("_at"))  # one row a partition
    return out.drop("_part", "_base", "_at"), total


def even_spread(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """``most`` rows spread evenly over ``order``: those at floor(i * n / most)."""
    placed, n = numbered(rows, order)
    if not most or most <= 0 or most >= n:
        return placed.drop("row")
    up = lambda r: F.floor((r * most + (n - 1)) / n)
    return placed.where(up(F.col("row")) < up(F.col("row") + 1)).drop("row")


def every_nth(rows: DataFrame, order: list[str], step: int, most: int) -> DataFrame:
    """Every ``step``-th row, of those the first ``most``."""
    placed, _ = numbered(rows, order)
    return placed.where(F.col("row") % step == 0).orderBy("row").limit(most).drop("row")


def at_position(rows: DataFrame, by: list[str], tie: list[str], position: int) -> DataFrame:
    """The row at a position (from 1) of the ranking: none beyond its ends."""
    if position < 1:
        return rows.limit(0)
    return ranked(rows, by, tie).offset(position - 1).limit(1)


def page(rows: DataFrame, by: list[str], tie: list[str], pages: int = 1, cap: int = PAGE) -> DataFrame:
    """The first rows of a view, which shows ``cap`` more with each page."""
    return ranked(rows, by, tie, cap * max(pages, 1))


def with_bars(shown: DataFrame, value: str) -> DataFrame:
    """Rows of a page with ``bar``: each value's share of the page's largest in whole per cent, 0 where none is above 0."""
    most = shown.agg(F.max(value).alias("_most"))  # one row
    share = F.when((F.col("_most") > 0) & F.col(value).isNotNull(), F.round(F.col(value) / F.col("_most") * 100)).otherwise(0)
    return shown.join(F.broadcast(most)).withColumn("bar", share.cast("int")).drop("_most")


def first_with_hazard(rows: DataFrame, by: list[str], tie: list[str], kind: str) -> DataFrame:
    """The first ranked session that carries a hazard of a kind."""
    return ranked(rows.where(F.coalesce(F.exists("hazards", lambda h: h["kind"] == kind), F.lit(False))), by, tie, 1)


def split_limit(limit: int | None, scoped: bool, narrowed: bool) -> tuple[int | None, int | None]:
    """Where a limit applies: before scoring as a sample, or, for a project that couldn't be narrowed, after ranking."""
    return (None, limit) if scoped and not narrowed else (limit, None)


def clamp_limit(limit: int | None, least: int = 1, most: int = 50, default: int = 10) -> int:
    return default if limit is None else max(least, min(most, int(limit)))


def clamped(limit: Column, least: int = 1, most: int = 50, default: int = 10) -> Column:
    """``clamp_limit`` of a column."""
    return F.when(limit.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), limit)))


def facets(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values; None wants anything."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def facet_values(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col(name).isNotNull() & (F.col(name) != "")).select(name).distinct().orderBy(name)


@dataclass(frozen=True)
class Scope:
    """Which sessions a scan covers: all, or those of the project at ``root``."""

    root: str | None = None
    narrowed: bool = False
    base: str | None = None
    reason: str | None = None

    def member(self, cwd: Column | str) -> Column:
        c = F.col(cwd) if isinstance(cwd, str) else cwd
        return F.lit(True) if self.root is None else F.when(c.isNull(), F.lit(self.narrowed)).otherwise(c == self.root)


def project_folder(base: str, cwd: str) -> str:
    """Where transcripts of a working directory lie: its path with every other sign a dash."""
    import re

    return f"{base.rstrip('/')}/{re.sub('[^A-Za-z0-9]', '-', os.path.abspath(os.path.expanduser(cwd)))}"


def project_folder_of(base: str, cwd: Column | str) -> Column:
    """``project_folder`` of a column of absolute paths."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.col(cwd) if isinstance(cwd, str) else cwd, "[^A-Za-z0-9]", "-"))


def folder_exists(spark: SparkSession, local=os.path.isdir):
    """Whether a folder is there, on the file system that its path names. Working directories, without a scheme, are on this machine; their transcripts may be anywhere."""

    def exists(path: str) -> bool:
        if "://" not in path and not path.startswith("file:"):
            return local(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(folder) and files.getFileStatus(folder).isDirectory()

    return exists


def resolve_scope(base: str, cwd: str | None, everything: bool = False, exists=os.path.isdir) -> Scope:
    """The project of ``cwd``: the nearest folder, up to the repository's root, that has transcripts. Where these lie elsewhere than on this disk, ``exists`` is ``folder_exists``."""
    if everything or not cwd:
        return Scope()
    here = os.path.abspath(os.path.expanduser(cwd))
    while True:
        folder = project_folder(base, here)
        if exists(folder):
            return Scope(root=here, narrowed=True, base=folder)
        parent = os.path.dirname(here)
        if exists(f"{here}/.git") or parent == here:
            return Scope(root=os.path.abspath(os.path.expanduser(cwd)), reason="unknown_cwd")
        here = parent


def newest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    out = rows.groupBy(key).agg(F.max_by(every, F.struct(at, tie)).alias("_row"))
    return out.select("_row.*")


def prune(rows: DataFrame, at: str, tie: str, keep: int) -> DataFrame:
    """All but the ``keep`` newest rows: those that a cleanup deletes."""
    top = rows.orderBy(F.desc(at), F.desc(tie)).limit(keep).select(tie)
    return rows.join(top, tie, "left_anti")
