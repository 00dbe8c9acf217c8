"""Joins between sessions, skills, proposals and stores, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..plans.session import cut
from .rank import ranges_for


def after_install(session_time: Column, installed_at: Column) -> Column:
    """Sessions of unknown time and skills of unknown installation count as after it."""
    return F.coalesce(session_time >= installed_at, F.lit(True))


def uses_skill(used: Column, name: Column) -> Column:
    """Whether a session's skills hold a name, whatever the case of its letters."""
    return F.coalesce(F.exists(used, lambda s: F.lower(s) == F.lower(name)), F.lit(False))


def _later(skills: DataFrame, sessions: DataFrame, skill: str, installed_at: str, session_time: str, score: str) -> DataFrame:
    """For each skill the number of sessions since its installation, of those with a score, and the scores' sum.

    Both tables are put in one order of time, from the latest, by ranges; a skill's sums are those of
    the ranges before its own, of which one row each meets in one place, and those before it in its own.
    """
    at, last = F.col(session_time), F.lit(None).cast("timestamp")
    marks = skills.select(F.col(skill).alias("_skill"), F.col(installed_at).cast("timestamp").alias("_at"), F.lit(1).alias("_mark"), *[F.lit(0).cast(t).alias(c) for c, t in (("_n", "long"), ("_c", "long"), ("_s", "double"))])
    rows = sessions.select(last.cast("string").alias("_skill"), at.cast("timestamp").alias("_at"), F.lit(0).alias("_mark"), F.lit(1).cast("long").alias("_n"), F.col(score).isNotNull().cast("long").alias("_c"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"))
    # Sessions of unknown time are after everything, and skills of unknown installation before everything.
    both = rows.withColumn("_first", F.col("_at").isNull().cast("int")).unionByName(marks.withColumn("_first", -F.col("_at").isNull().cast("int")))
    # The row's number, last in the order, lets ranges part sessions of one time, or of none.
    order = [F.desc("_first"), F.desc_nulls_last("_at"), F.asc("_mark"), F.asc("_row")]
    dealt = both.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges_for(both), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = cut(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_i", place))
    sums = [F.sum(c).alias(c) for c in ("_n", "_c", "_s")]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = dealt.groupBy("_part").agg(*sums).select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_c", "_s")])
    run = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("_skill", "_at", "_mark", "_part", *[F.sum(c).over(run).alias(c) for c in ("_n", "_c", "_s")]).where("_mark = 1")
    return inside.join(bases, "_part").select(F.col("_skill").alias(skill), "_at", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in ("_n", "_c", "_s")])


def sessions_after(skills: DataFrame, sessions: DataFrame, skill: str, installed_at: str, session_time: str, alias: str = "sessions") -> DataFrame:
    """Of each skill how many sessions came at its installation or later: the join on ``after_install`` counted by running sums, without a pair of both tables."""
    counted = _later(skills, sessions.withColumn("_score", F.lit(None).cast("double")), skill, installed_at, session_time, "_score")
    return counted.select(skill, F.col("_n").alias(alias))


def feedback(skills: DataFrame, sessions: DataFrame, skill: str, installed_at: str, session_time: str, used: str, score: str) -> DataFrame:
    """For each skill the sessions since its installation, how many used it, and mean friction with and without it.

    ``used`` is a session's list of skills, which are matched whatever their letters' case. Rates and
    means have three digits, and are null where there is nothing to divide by. Sessions that used a
    skill are found by an equality join, all others by running sums over time, so no side is broadcast
    and no pairs of both tables are made.
    """
    every = _later(skills, sessions, skill, installed_at, session_time, score)
    named = sessions.select(F.explode(F.array_distinct(F.transform(used, F.lower))).alias("_name"), F.col(session_time).alias("_time"), F.col(score).cast("double").alias("_score"))
    hits = named.join(skills.select(F.lower(skill).alias("_name"), F.col(skill).alias("_skill"), F.col(installed_at).cast("timestamp").alias("_from")), "_name").where(after_install(F.col("_time"), F.col("_from")))
    hits = hits.groupBy("_skill", "_from").agg(F.count(F.lit(1)).alias("_un"), F.count("_score").alias("_uc"), F.sum("_score").alias("_us"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("_un", "_uc", "_us")}
    out = every.join(hits, (F.col(skill) == F.col("_skill")) & F.col("_at").eqNullSafe(F.col("_from")), "left").withColumns(zero)
    n, n_used = F.col("_n"), F.col("_un")
    mean = lambda s, c: F.when(c > 0, F.round(s / F.nullif(c, F.lit(0)), 3))
    verdict = F.when(n == 0, "no_sessions").when(n_used == 0, "unused").when(n_used * 10 < n, "low_usage").otherwise("active")
    return out.select(
        skill, n.alias("sessions"), n_used.alias("used"), mean(n_used.cast("double"), n).alias("usage_rate"), mean(F.col("_us"), F.col("_uc")).alias("friction_with"),
        mean(F.col("_s") - F.col("_us"), F.col("_c") - F.col("_uc")).alias("friction_without"), verdict.alias("verdict"),
    )


def first_installed(sessions: DataFrame, skills: DataFrame, key: str, source: str, skill: str) -> DataFrame:
    """Sessions with the skill that was installed from each, of several the first by name; null if there is none."""
    first = skills.where(F.col(source).isNotNull()).groupBy(F.col(source).alias(key)).agg(F.min(skill).alias("installed_skill"))
    return sessions.join(first, key, "left")


def with_installed(proposals: DataFrame, skills: DataFrame, name: str, skill: str) -> DataFrame:
    """Proposals with ``installed``: whether a skill of that name is there."""
    there = skills.select(F.col(skill).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return proposals.join(there, name, "left").withColumn("installed", F.coalesce("_there", F.lit(False))).drop("_there")


def confusion(rows: DataFrame, expected: Column, actual: Column, keys: list[str] = ()) -> DataFrame:
    """Counts, accuracy, precision and recall; an actual that is null is an error: wrong, and no positive."""
    hit = F.coalesce(actual, F.lit(False))
    tp, fp = F.count_if(expected & hit), F.count_if(~expected & hit)
    fn, tn = F.count_if(expected & ~hit), F.count_if(~expected & ~hit)
    right = F.count_if(F.coalesce(actual == expected, F.lit(False)))
    precision = F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0))).when(fn > 0, 0.0).otherwise(1.0)
    recall = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0))).otherwise(1.0)
    return rows.groupBy(*keys).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(right, F.count(F.lit(1))).alias("accuracy"), precision.alias("precision"), recall.alias("recall")
    )


def pooled(runs: DataFrame) -> DataFrame:
    """Several runs' confusion rows as one, with the deviation of their accuracies; shares to four digits."""
    s = {k: F.sum(k) for k in ("tp", "fp", "fn", "tn")}
    precision = F.when(s["tp"] + s["fp"] > 0, s["tp"] / F.nullif(s["tp"] + s["fp"], F.lit(0))).when(s["fn"] > 0, 0.0).otherwise(1.0)
    recall = F.when(s["tp"] + s["fn"] > 0, s["tp"] / F.nullif(s["tp"] + s["fn"], F.lit(0))).otherwise(1.0)
    four = {"accuracy": ratio(s["tp"] + s["tn"], s["tp"] + s["fp"] + s["fn"] + s["tn"]), "precision": precision, "recall": recall, "accuracy_stdev": F.stddev_pop("accuracy")}
    return runs.agg(*[v.alias(k) for k, v in s.items()], *[F.round(v, 4).alias(k) for k, v in four.items()], F.count(F.lit(1)).alias("runs"))


def folded(composite: Column, weight: Column, accuracy: Column, precision: Column, recall: Column, share: float) -> Column:
    """A composite with the mean of trigger accuracy, precision and recall as one more dimension, to four digits."""
    return F.round((composite * weight + (accuracy + precision + recall) / 3.0 * share) / (weight + share), 4)


def fold_behavioral(rows: DataFrame, weight: Column, threshold: float, share: float) -> DataFrame:
    """Scored artifacts (composite, vetoed) with their trigger's accuracy, precision and recall folded in.

    Whether one passes follows from the new composite, but what was vetoed stays refused.
    """
    out = rows.withColumn("composite", folded(F.col("composite"), weight, F.col("accuracy"), F.col("precision"), F.col("recall"), share))
    return out.withColumn("passed", (F.col("composite") >= threshold) & ~F.col("vetoed"))


def cache_split(current: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a store has under the same key, stamp and version, and what has to be computed."""
    stored = stored.select(*keys).distinct()
    return current.join(stored, keys, "left_semi"), current.join(stored, keys, "left_anti")


def missing(refs: Column, known: Column) -> Column:
    """References that aren't known; where nothing is known to compare with, none are missing."""
    return F.when(known.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(refs, known)))


def stale(recorded: Column, current: Column) -> Column:
    return F.coalesce(recorded != current, F.lit(False))


def drifted(content: Column, recorded: Column) -> Column:
    return F.coalesce(F.sha2(content.cast("binary"), 256) != recorded, F.lit(False))


def agreement(left: DataFrame, right: DataFrame, key: str, values: dict[str, float]) -> DataFrame:
    """Of rows in both tables the share whose values differ by less than their tolerance."""
    both = left.select(key, *[F.col(v).alias(f"_{v}") for v in values]).join(right.select(key, *values), key)
    return both.agg(F.count(F.lit(1)).alias("compared"), *[F.avg(F.when(F.abs(F.col(f"_{v}") - F.col(v)) <= eps, 1.0).otherwise(0.0)).alias(f"{v}_agreement") for v, eps in values.items()])
