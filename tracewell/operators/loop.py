"""The improvement loop: keep what is better, stop when nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import filled

STATE = "struct<best: double, kept: array<int>, discards: int, iterations: int, status: string>"


def ratchet(scores: Column, vetoed: Column | None = None, target: float = C.LOOP_TARGET, most: int = C.LOOP_ITERATIONS, patience: int = C.LOOP_PATIENCE, margin: float = C.LOOP_MARGIN, seed: float = 0.0) -> Column:
    """A fold over scores in order: keep a score only above the best by more than the margin and without veto.

    Before each step it stops: complete at the target or after ``most`` iterations, stuck after
    ``patience`` discards in a row. The result has best, kept (places from 0), discards,
    iterations and status (running if scores ran out).
    """
    veto = F.transform(scores, lambda x: F.lit(False)) if vetoed is None else vetoed
    steps = F.transform(F.arrays_zip(scores.alias("s"), veto.alias("v")), lambda x, i: F.struct(x["s"].alias("s"), F.coalesce(x["v"], F.lit(False)).alias("v"), i.alias("i")))
    start = F.struct(F.lit(seed).alias("best"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("discards"), F.lit(0).alias("iterations"), F.lit("running").alias("status")).cast(STATE)

    def status(a: Column) -> Column:
        return F.when((a["best"] >= target) | (a["iterations"] >= most), "complete").when(a["discards"] >= patience, "stuck").otherwise("running")

    def step(a: Column, x: Column) -> Column:
        better = F.coalesce(~x["v"] & (x["s"] > a["best"] + margin), F.lit(False))
        moved = F.struct(
            F.when(better, x["s"]).otherwise(a["best"]).alias("best"),
            F.when(better, F.concat(a["kept"], F.array(x["i"]))).otherwise(a["kept"]).alias("kept"),
            F.when(better, 0).otherwise(a["discards"] + 1).alias("discards"), (a["iterations"] + 1).alias("iterations"), F.lit("running").alias("status"),
        ).cast(STATE)
        return F.when(status(a) == "running", moved).otherwise(a)

    last = F.aggregate(steps, start, step)
    return last.withField("status", status(last))


def ratchet_by(rows: DataFrame, key: str, order: list[str], score: str, most: int = C.LOOP_ITERATIONS, **options) -> DataFrame:
    """The fold for each key. It ends after ``most`` rows, so no more of a key are gathered."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.select(key, F.col(score).cast("double").alias("_s"), place.alias("_i")).where(F.col("_i") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"])
    out = first.groupBy(key).agg(listed.alias("_scores")).withColumn("_r", ratchet(F.col("_scores"), most=most, **options))
    return out.select(key, F.col("_r.best").alias("best"), F.size("_r.kept").alias("kept"), F.col("_r.discards").alias("discards"), F.col("_r.iterations").alias("iterations"), F.col("_r.status").alias("status"))


def running_best(rows: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """Without margin, veto or stop the fold is a running maximum: best so far, and whether a row raised it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(score).over(before)
    return rows.withColumn("kept", F.col(score) > F.coalesce(best, F.lit(0.0))).withColumn("best", F.greatest(F.coalesce(best, F.lit(0.0)), F.col(score)))


def halves(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Alternating training and validation rows of each key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("part", F.when(at % 2 == 0, "train").otherwise("validation"))


def holdout(rows: DataFrame, key: str, polarity: str, order: list[str]) -> DataFrame:
    """``halves`` of each key's fixtures of either polarity; only keys that have two of both can be held out."""
    w = Window.partitionBy(key)
    enough = (F.count_if(F.col(polarity)).over(w) >= 2) & (F.count_if(~F.col(polarity)).over(w) >= 2)
    at = F.row_number().over(Window.partitionBy(key, polarity).orderBy(*order)) - 1
    return rows.withColumn("_enough", enough).where("_enough").withColumn("part", F.when(at % 2 == 0, "train").otherwise("validation")).drop("_enough")


def pinned(candidates: DataFrame, seeds: DataFrame, key: str, fixtures: list[str]) -> DataFrame:
    """Candidates with their seed's fixtures in place of their own, so that none can choose what it is judged by."""
    return candidates.drop(*fixtures).join(seeds.select(key, *fixtures), key, "left")


def weakest(dimensions: DataFrame, key: str, name: str, score: str, failed: str | None = None) -> DataFrame:
    """The dimension of the lowest score, of equal ones the first by name, and on demand what failed in it."""
    place = F.struct(score, name)
    more = [F.min_by(failed, place).alias("failed")] if failed else []
    return dimensions.groupBy(key).agg(F.min_by(name, place).alias("weakest"), F.min(score).alias("score"), *more)


def weakest_first(dimensions: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """All dimensions of each key, from the lowest score up, ties by name."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(score).alias("score"), F.col(name).alias("dimension"))))
    return dimensions.groupBy(key).agg(listed.alias("weakest_first"))


def clamp_rollouts(wanted: int | None, least: int = 1, most: int = 40, default: int = 8) -> int:
    return default if wanted is None else max(least, min(most, int(wanted)))


def metric_text(dimensions: DataFrame, key: str, name: str, score: str, failed: str, composite: str) -> DataFrame:
    """What an optimiser is told of a candidate: its composite, and its dimensions from the weakest up, each with the checks that failed."""
    each = F.struct(F.col(score).alias("s"), F.col(name).alias("n"), F.array_join(failed, ", ").alias("f"))
    line = lambda x: F.concat(F.lit("- "), x["n"], F.lit(": "), F.format_number(x["s"], 3), F.when(x["f"] != "", F.concat(F.lit(" (failed: "), x["f"], F.lit(")"))).otherwise(""))
    out = dimensions.groupBy(key, composite).agg(F.array_sort(F.collect_list(each)).alias("_d"))
    told = F.concat(F.lit("composite "), F.format_number(composite, 3), F.lit("; weakest first:\n"), F.array_join(F.transform("_d", line), "\n"))
    return out.select(key, F.col(composite).alias("composite"), told.alias("told"))


def sound(content: Column, kind: str | Column = "skill", lines: int = 535) -> Column:
    """What must hold before an artifact is scored: no conflict marks; a skill has name and description and is not too long, a hook isn't empty."""
    named = content.rlike(r"(?m)^name:\s*\S") & content.rlike(r"(?m)^description:\s*\S") & (F.size(F.split(content, "\n")) <= lines)
    hook = (kind if isinstance(kind, Column) else F.lit(kind)) == "hook"
    return F.when(hook, filled(content)).otherwise(named) & ~content.rlike(r"(?m)^(<<<<<<<|=======|>>>>>>>)")
