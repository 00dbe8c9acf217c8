"""What kind of session it was, which automation it missed, what was hazardous, how full its context got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import col, excerpt, namespaced, rounded_share, short_name, whole_words


def opening_text(turns: DataFrame, session: str, order: list[str], text: str, first: int = C.FIRST_TURNS, chars: int = C.TURN_CHARS) -> DataFrame:
    """The first human turns of each session, cut and joined. ``turns`` holds human turns only."""
    rows = turns.withColumn("_i", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("_i") <= first)
    said = F.sort_array(F.collect_list(F.struct("_i", F.substring(text, 1, chars).alias("_t"))))
    return rows.groupBy(session).agg(F.array_join(F.transform(said, lambda x: x["_t"]), " ").alias("opening"))


def fingerprint(scores: dict[str, Column], order: list[str] | None = None) -> tuple[Column, Column]:
    """The type with the highest score (of equal ones the first in order) and its rounded share of all scores."""
    names = order or list(scores)
    halves = {k: (scores[k] * 2).cast("long") for k in names}  # bonuses are multiples of a half
    best = F.array_max(F.array(*[F.struct(halves[k].alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(names)]))
    total = sum((halves[k] for k in names[1:]), halves[names[0]])
    none = total <= 0
    return F.when(none, "unknown").otherwise(best["k"]), F.when(none, 0.0).otherwise(rounded_share(best["s"], F.greatest(total, F.lit(1)), 2))


def type_scores(text: Column | str, words: dict[str, str] = C.TYPE_WORDS, profile: dict[str, Column] | None = None, rules: list[tuple[str, Column, float]] = ()) -> dict[str, Column]:
    """Scores by type: 2 for each keyword match, bonuses for how tools were used (``profile``: reads, edits, bash, files, tools) and for rules."""
    out = {k: F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(whole_words(w))) * 2.0 for k, w in words.items()}
    add = lambda k, when, x: out.__setitem__(k, out.get(k, F.lit(0.0)) + F.when(F.coalesce(when, F.lit(False)), float(x)).otherwise(0.0))
    if profile:
        n = F.greatest(profile["tools"], F.lit(1))
        add("exploration", (profile["reads"] / n > 0.5) & (profile["edits"] / n < 0.1), 3)
        add("feature", profile["edits"] / n > 0.3, 2)
        add("bug-fix", profile["bash"] / n > 0.3, 2)
        add("refactoring", profile["files"] > 10, 2)
        add("feature", profile["files"] > 5, 1)
    for kind, when, bonus in rules:
        add(kind, when, bonus)
    return out


def matches_rule(commands: Column, tools: Column, needles: list[str], prefixes: list[str]) -> Column:
    """Whether a command holds a needle or a tool's name begins with a prefix."""
    out = F.lit(False)
    if needles:
        out = out | F.exists(commands, lambda c: sum((F.contains(c, F.lit(n)).cast("int") for n in needles), F.lit(0)) > 0)
    if prefixes:
        out = out | F.exists(tools, lambda t: sum((t.startswith(p).cast("int") for p in prefixes), F.lit(0)) > 0)
    return F.coalesce(out, F.lit(False))


def missed(rules: list[dict], facts: dict[str, Column], used: Column) -> tuple[Column, Column]:
    """Skills that rules suggest, in the rules' order, and the opportunity score.

    A rule has ``skill``, ``when`` (a fact's name: a boolean, or a number to compare), ``threshold``,
    ``least`` (compare with >= instead of >) and ``unless_used``.
    """
    options = []
    for rule in rules:
        fact = facts[rule["when"]]
        if rule.get("threshold") is not None:
            fact = fact >= rule["threshold"] if rule.get("least") else fact > rule["threshold"]
        if rule.get("unless_used", True):
            fact = fact & ~F.coalesce(F.array_contains(used, rule["skill"].lower()), F.lit(False))
        options.append(F.struct(F.coalesce(fact, F.lit(False)).alias("on"), F.lit(rule["skill"]).alias("skill")))
    skills = F.transform(F.filter(F.array(*options), lambda x: x["on"]), lambda x: x["skill"])
    return skills, F.least(F.size(skills) * 2, F.lit(10)) / 10.0


DEFAULT_RULES = [
    {"skill": "investigate", "when": "retry_loops", "unless_used": False},
    {"skill": "plan", "when": "tool_count", "threshold": 50},
    {"skill": "review", "when": "edit_count", "threshold": 10},
]


def used_skills(texts: Column, namespaces: list[str], attributed: Column | None = None, named: Column | None = None) -> Column:
    """Skills that a session used, lower-cased and sorted: named in its text, attributed, or called."""
    empty = F.array().cast("array<string>")
    parts = [F.transform(namespaced(texts, namespaces), F.lower)]
    parts += [F.transform(F.coalesce(x, empty), lambda s: F.lower(short_name(s))) for x in (attributed, named) if x is not None]
    return F.sort_array(F.array_distinct(F.filter(F.concat(*parts), lambda s: s != "")))


def is_masked_exit(command: Column | str) -> Column:
    """A gate command piped into a filter without pipefail."""
    c = col(command)
    return F.coalesce(c.rlike(C.PIPE_MASKS_EXIT) & ~c.rlike(C.PIPEFAIL), F.lit(False))


def _masked_exit_told(c: Column) -> Column:
    return F.concat(F.lit("`"), excerpt(c), F.lit(f"` — {C.PIPE_EXPLAINED}"), F.when(c.rlike(C.STATUS_READ), F.lit(f", {C.STATUS_EXPLAINED}")).otherwise(F.lit("")))


#: Kinds of hazards: what a command of the kind is, and what is said about it.
HAZARDS = {"pipe_masks_exit": (is_masked_exit, _masked_exit_told)}


def hazards(calls: DataFrame, command: Column | str, kinds: dict = HAZARDS) -> DataFrame:
    """The calls that are hazardous, one row for each kind, with kind and evidence. They never add to friction."""
    c = col(command)
    found = F.filter(F.array(*[F.when(fits(c), F.struct(F.lit(kind).alias("kind"), told(c).alias("evidence"))) for kind, (fits, told) in kinds.items()]), lambda h: h.isNotNull())
    rows = calls.withColumn("_hazard", F.explode(found))
    return rows.select(*calls.columns, "_hazard.kind", "_hazard.evidence")


def hazard_summary(found: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """By kind the first evidence and the number of hazards."""
    return found.groupBy(*keys, "kind").agg(F.min_by("evidence", col(order)).alias("evidence"), F.count(F.lit(1)).alias("count"))


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def window_of(model: Column | str) -> Column:
    """A model's context window: by its name, by the name without the large-window mark, or by a known name within it."""
    m, known = col(model), _literal_map(C.WINDOWS)
    out = F.coalesce(F.try_element_at(known, m), F.try_element_at(known, F.regexp_replace(m, r"\[1m\]$", "")))
    within = F.coalesce(*[F.when(F.contains(m, F.lit(k)), F.lit(w)) for k, w in sorted(C.WINDOWS.items())])
    return F.coalesce(out, within)


def large_window_of(model: Column | str) -> Column:
    m, known = col(model), _literal_map(C.WINDOWS)
    undated = F.regexp_replace(m, r"-\d{8}$", "")
    large = [k for k in sorted(C.WINDOWS) if k.endswith("[1m]")]
    within = F.coalesce(*[F.when(F.contains(m, F.lit(k.removesuffix("[1m]"))), F.lit(C.WINDOWS[k])) for k in large])
    return F.coalesce(F.try_element_at(known, F.concat(m, F.lit("[1m]"))), F.try_element_at(known, F.concat(undated, F.lit("[1m]"))), within)


def context_percent(peak: Column | str, window: Column | str) -> Column:
    """The peak's share of the window in percent, at most 100, one digit."""
    return F.least(rounded_share(col(peak) * 100, col(window), 1), F.lit(100.0))


def message_window(model: Column | str, peak: Column | str) -> Column:
    base = window_of(model)
    return F.when(col(peak) > base, F.coalesce(large_window_of(model), base)).otherwise(base)


def mode_of(rows: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The most frequent value by key, of equally frequent ones the greatest."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", value)).alias(alias))


def tier_two(score: Column, opportunity: Column, used: Column, messages: Column, context: Column) -> Column:
    return (score > 0.35) | (opportunity > 0.5) | (F.size(used) > 0) | (messages > 50) | F.coalesce(context >= 90, F.lit(False))
