"""Signals of one session: what went wrong in its tool calls and messages.

Every function takes DataFrames and column names and returns one row for each session, so plans
hold one exchange on the session key; sequence operators add a window over the same key, which
reuses that exchange. A session's events have to fit one task's sort, which spills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COMPACT_SUBTYPES, COMPACT_TEXT, INTERRUPT, SIGMOID_K, SIGMOID_MID, WEIGHTS
from ..functions.text import col, command_key, filled, first_words, is_correction, ratio


def human_turn(kind: Column | str, text: Column | str, meta: Column | None = None, synthetic: Column | None = None) -> Column:
    """A message that a person wrote."""
    no = lambda c: F.lit(True) if c is None else ~F.coalesce(c, F.lit(False))
    return F.coalesce((col(kind) == "user") & filled(text) & no(meta) & no(synthetic), F.lit(False))


def is_message(kind: Column | str) -> Column:
    return F.coalesce(col(kind).isin("user", "assistant"), F.lit(False))


def message_counts(events: DataFrame, session: str, kind: str, text: str) -> DataFrame:
    human = human_turn(kind, text)
    return events.groupBy(session).agg(
        F.count_if(is_message(kind)).alias("message_count"), F.count_if(human).alias("human_turns"), F.count_if(human & is_correction(text)).alias("user_corrections")
    )


def interrupts(kind: Column | str, text: Column | str, marker: str = INTERRUPT) -> Column:
    """Events of users, human turns or not, that hold the marker; each counts once."""
    return F.count_if(F.coalesce((col(kind) == "user") & F.contains(col(text), F.lit(marker)), F.lit(False)))


def compactions(text: Column | str, summary: Column | None = None, subtype: Column | None = None, phrase: str = COMPACT_TEXT) -> Column:
    said = F.coalesce(F.contains(F.lower(col(text)), F.lit(phrase)), F.lit(False))
    if summary is not None:
        said = said | F.coalesce(summary, F.lit(False))
    if subtype is not None:
        said = said | F.coalesce(subtype.isin(*COMPACT_SUBTYPES), F.lit(False))
    return F.count_if(said)


def errored_calls(calls: DataFrame, results: DataFrame, session: str, call_id: str, is_error: str) -> DataFrame:
    """``calls`` with ``errored``: whether any result of the call's id is an error. Results without id match nothing."""
    flags = results.where(F.col(call_id).isNotNull()).groupBy(session, call_id).agg(F.bool_or(F.coalesce(F.col(is_error), F.lit(False))).alias("errored"))
    return calls.join(flags, [session, call_id], "left").withColumn("errored", F.coalesce("errored", F.lit(False)))


def retry_loops(calls: DataFrame, session: str, order: list[str], command: Column | str, errored: Column | str, least: int = 3) -> DataFrame:
    """Runs of at least three equal commands, one of which failed, by session. Blank commands don't part runs."""
    rows = calls.select(session, *order, command_key(command).alias("_cmd"), col(errored).alias("_err")).where("_cmd IS NOT NULL")
    w = Window.partitionBy(session).orderBy(*order)
    rows = rows.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(session, "_cmd").orderBy(*order)))
    runs = rows.groupBy(session, "_cmd", "_run").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_err").alias("_err"))
    return runs.groupBy(session).agg(F.count_if((F.col("_n") >= least) & F.col("_err")).alias("retry_loops"))


def repeated_start(calls: DataFrame, session: str, order: list[str], command: Column | str) -> DataFrame:
    """Whether three commands in a row begin with the same two words (failed or not; a blank one parts a run)."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = calls.select(session, *order, F.array_join(first_words(command), " ").alias("_two"))
    same = (F.col("_two") != "") & (F.lag("_two", 1).over(w) == F.col("_two")) & (F.lag("_two", 2).over(w) == F.col("_two"))
    return rows.withColumn("_hit", F.coalesce(same, F.lit(False))).groupBy(session).agg(F.bool_or("_hit").alias("repeated"))


def approach_changes(calls: DataFrame, session: str, order: list[str], name: str) -> DataFrame:
    """How often the leading tool differs between neighbouring chunks of a session; 0 below ten calls."""
    w = Window.partitionBy(session)
    rows = calls.select(session, *order, name).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("_chunk", F.floor(F.col("_i") / F.greatest(F.floor(F.col("_n") / 4), F.lit(5))))
    tools = rows.groupBy(session, "_n", "_chunk", name).agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))
    lead = tools.groupBy(session, "_n", "_chunk").agg(F.max_by(name, F.struct("_c", -F.col("_first"))).alias("_lead"))
    lead = lead.withColumn("_was", F.lag("_lead").over(w.orderBy("_chunk")))
    changed = (F.col("_was") != F.col("_lead")) & (F.col("_n") >= 10)
    return lead.groupBy(session).agg(F.count_if(F.coalesce(changed, F.lit(False))).alias("approach_changes"))


CATEGORIES = ("read", "edit", "bash", "grep", "mcp", "other")


def category(name: Column | str) -> Column:
    n = col(name)
    return (
        F.when(n.isin("Read", "Glob"), "read").when(n.isin("Edit", "Write", "NotebookEdit"), "edit").when(n == "Bash", "bash")
        .when(n == "Grep", "grep").when(n.startswith("mcp__"), "mcp").otherwise("other")
    )


def tool_profile(calls: DataFrame, session: str, tool_category: Column, categories=CATEGORIES) -> DataFrame:
    """Each category's share of a session's calls."""
    rows = calls.select(session, tool_category.alias("_cat"))
    n = F.count(F.lit(1))
    return rows.groupBy(session).agg(n.alias("tool_count"), *[ratio(F.count_if(F.col("_cat") == c), n).alias(f"{c}_share") for c in categories])


def raw_score(signals: dict[str, Column] | None = None) -> Column:
    """The weighted sum of the signals, added in a fixed order."""
    columns = signals or {k: F.col(k) for k in WEIGHTS}
    return reduce(lambda a, b: a + b, [F.coalesce(columns[k].cast("double"), F.lit(0.0)) * w for k, w in WEIGHTS.items()])


def sigmoid(raw: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-SIGMOID_K * (col(raw) - SIGMOID_MID)))


def dominant_signal(signals: dict[str, Column] | None = None) -> Column:
    """The signal that adds most, of equal ones the alphabetically last; null if none adds anything."""
    columns = signals or {k: F.col(k) for k in WEIGHTS}
    parts = [F.struct((F.coalesce(columns[k].cast("double"), F.lit(0.0)) * w).alias("v"), F.lit(k).alias("k")) for k, w in WEIGHTS.items()]
    top = F.array_max(F.array(*parts))
    return F.when(top["v"] > 0, top["k"])
