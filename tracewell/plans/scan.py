"""The scan: events of all transcripts to one ranked row for each session."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import base_name, clipped, dir_name, glob_pattern, grouped_digits, is_correction, ratio, rounded
from ..operators import classify, rank, signals
from ..sources.transcripts import CALL, distinct_in_order, first_known
from .session import cut_by


@dataclass(frozen=True)
class Pack:
    """A stack's rules: session types by command or tool, missed automation, skill namespaces, file globs."""

    name: str = "default"
    fingerprints: tuple = ()
    opportunities: tuple = tuple(classify.DEFAULT_RULES)
    namespaces: tuple = ()
    globs: tuple = ()
    laws: tuple = ()
    playbooks: tuple = ()
    evaluation: dict | None = None
    templates: dict = field(default_factory=dict)

    def drafting(self, laws: int = 12, playbooks: int = 8) -> tuple[tuple, tuple]:
        """The laws and playbooks that go into a draft: the first of each."""
        return self.laws[:laws], self.playbooks[:playbooks]

    def gate(self, paths: Column, force: bool | Column = False) -> Column:
        """Whether a session may be drafted from: it is of the stack, or the caller insists."""
        return (force if isinstance(force, Column) else F.lit(force)) | self.matches(paths)

    def matches(self, paths: Column) -> Column:
        """Whether a session touched a file of the stack."""
        if not self.globs:
            return F.lit(False)
        pattern = "|".join(f"(?:{glob_pattern(g)})" for g in self.globs)
        return F.coalesce(F.exists(paths, lambda p: p.rlike(pattern)), F.lit(False))


#: What the two packs know.
ELIXIR = Pack(
    "elixir",
    ({"type": "maintenance", "commands": ["mix deps", "mix hex"], "bonus": 3.0}, {"type": "review", "commands": ["gh pr", "gh issue"], "bonus": 3.0}, {"type": "bug-fix", "tools": ["mcp__tidewave"], "bonus": 1.5}),
    (
        {"skill": "investigate", "when": "retry_loops", "unless_used": False}, {"skill": "plan", "when": "tool_count", "threshold": 50},
        {"skill": "verify", "when": "commands", "commands": ["mix test", "mix compile"], "threshold": 3, "least": True}, {"skill": "pr-review", "when": "commands", "commands": ["gh pr"], "threshold": 2, "least": True},
        {"skill": "review", "when": "edit_count", "threshold": 10},
    ),
    ("phx", "ecto", "lv"), ("**/*.ex", "**/*.exs"),
)
PYTHON = Pack(
    "python",
    ({"type": "maintenance", "commands": ["pip install", "poetry add", "uv add", "pip-compile", "pipenv install", "pip uninstall"], "bonus": 3.0}, {"type": "review", "commands": ["gh pr", "gh issue"], "bonus": 3.0}),
    (
        {"skill": "investigate", "when": "retry_loops", "unless_used": False}, {"skill": "plan", "when": "tool_count", "threshold": 50},
        {"skill": "verify", "when": "commands", "commands": ["pytest", "ruff check", "mypy", "python -m pytest"], "threshold": 3, "least": True}, {"skill": "pr-review", "when": "commands", "commands": ["gh pr"], "threshold": 2, "least": True},
        {"skill": "review", "when": "edit_count", "threshold": 10},
    ),
    ("py",), ("**/*.py",),
)
PACKS = {p.name: p for p in (Pack(), ELIXIR, PYTHON)}


@dataclass(frozen=True)
class Options:
    pack: Pack = field(default_factory=Pack)
    scope: rank.Scope = field(default_factory=rank.Scope)
    min_messages: int = C.MIN_MESSAGES
    rank_by: str = "raw"
    dedupe: bool = True
    limit: int | None = None


def tool_calls(events: DataFrame) -> DataFrame:
    """One row for each tool call, with its place in the session."""
    return exploded(events, "tool_uses", "session_key", "seq").select("session_key", "seq", "pos", "_c.*")


def exploded(events: DataFrame, calls: str, *columns: str) -> DataFrame:
    """One row (columns, pos, _c) for each element of a list that a parser made.

    Of a plain ``posexplode`` Spark infers a filter on the list's size and moves it below the parser, where the
    steps of parsing are written out again for each place that uses them. The outer form infers none.
    """
    return events.select(*columns, F.posexplode_outer(calls).alias("pos", "_c")).where("pos IS NOT NULL")


def checked_calls(events: DataFrame) -> DataFrame:
    """Tool calls with whether any result of their id is an error, of events that are parsed only once for both."""
    calls = F.transform("tool_uses", lambda c: F.struct(c["id"].alias("id"), F.lit(None).cast("boolean").alias("bad"), c.alias("call"), F.lit(True).alias("is_call")))
    results = F.transform("tool_results", lambda r: F.struct(r["tool_use_id"].alias("id"), r["is_error"].alias("bad"), F.lit(None).cast(CALL).alias("call"), F.lit(False).alias("is_call")))
    rows = exploded(events.select("session_key", F.concat(calls, results).alias("_both")), "_both", "session_key")
    bad = F.bool_or("_c.bad").over(Window.partitionBy("session_key", "_c.id"))
    rows = rows.withColumn("errored", F.coalesce(F.col("_c.id").isNotNull() & bad, F.lit(False)))
    return rows.where("_c.is_call").select("session_key", "_c.call.*", "errored")


FACTS = (
    "session_key", "path", "seq", "session_id", "cwd", "err", "type", "text", "is_meta", "synthetic", "is_compact_summary", "subtype", "tool_uses", "tool_results", "msg_model", "msg_prompt_tokens", "usage", "attribution_skill",
)


def session_facts(events: DataFrame, pack: Pack = Pack()) -> DataFrame:
    """The session table.

    Transcripts are parsed once: the events are dealt by session and written to the shared folder, and
    so are the calls with whether they failed. Everything else is windows, aggregates and joins by
    session over these two, which need no further exchange.
    """
    key, order = "session_key", ["seq", "pos"]
    events = cut_by(events.select(*FACTS), key)
    results = exploded(events, "tool_results", key).select(key, F.col("_c.tool_use_id").alias("id"), F.col("_c.is_error").alias("is_error"))
    calls = cut_by(signals.errored_calls(tool_calls(events), results, key, "id", "is_error"), key)
    human = signals.human_turn("type", "text", F.col("is_meta"), F.col("synthetic"))
    fine = F.col("err").isNull()
    base = events.groupBy(key).agg(
        F.first("path").alias("path"), first_known("session_id", ["seq"]).alias("session_id"), first_known("cwd", ["seq"]).alias("cwd"),
        F.count_if(fine & signals.is_message("type")).alias("message_count"), F.count_if(human).alias("human_turns"), F.count_if(human & is_correction("text")).alias("user_corrections"),
        signals.interrupts("type", "text").alias("interrupted_requests"), signals.compactions("text", F.col("is_compact_summary"), F.col("subtype")).alias("context_compactions"),
        F.coalesce(F.sum(F.size("tool_uses")), F.lit(0)).alias("tool_count"), F.coalesce(F.sum(F.size(F.filter("tool_results", lambda r: r["is_error"]))), F.lit(0)).alias("error_count"),
        F.count_if(~fine).alias("parse_errors"), F.max("msg_prompt_tokens").alias("_peak"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.struct("usage.prompt_tokens", -F.col("seq")))).alias("_usage"),
        F.collect_set("attribution_skill").alias("_attributed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(human, F.struct("seq", "text")))), lambda x: x["text"]), "\n").alias("_said"),
    )
    bash = calls.where(F.col("name") == "Bash")
    errored = bash.where("command_is_string")
    command = F.when(F.col("name") == "Bash", F.coalesce("command", F.lit("")))
    edited = F.when(F.col("name").isin("Edit", "Write", "NotebookEdit"), F.col("file_path"))
    by_call = calls.groupBy(key).agg(
        F.collect_list(command).alias("_commands"), F.collect_set("name").alias("_tools"), F.count_if(F.col("name").isin("Read", "Grep", "Glob")).alias("_reads"), F.count_if(F.col("name").isin("Edit", "Write")).alias("_edits"),
        F.count_if(F.col("name") == "Bash").alias("_bash"), F.countDistinct(edited).alias("_files"), F.collect_set(F.when(F.col("name") == "Skill", F.col("skill"))).alias("_called"),
    )
    paths = calls.select(key, *order, F.posexplode(F.array("file_path", "path", "notebook_path")).alias("_k", "_p")).where("_p IS NOT NULL AND _p <> ''")
    paths = paths.groupBy(key).agg(distinct_in_order("_p", [*order, "_k"]).alias("file_paths"))
    opening = classify.opening_text(events.where(human), key, ["seq"], "text")
    model = classify.mode_of(events, [key], "msg_model", "model")
    found = classify.hazards(calls.where((F.col("name") == "Bash") & F.col("command_is_string")), "command")
    summary = classify.hazard_summary(found, [key], F.struct(*order)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "evidence", "count"))).alias("hazards"))
    out = base
    for part in (
        signals.retry_loops(errored, key, order, "command", "errored"), signals.repeated_start(bash, key, order, "command"), signals.approach_changes(calls, key, order, "name"), by_call, paths, opening, model, summary,
    ):
        out = out.join(part, key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("retry_loops", "approach_changes", "_reads", "_edits", "_bash", "_files")}
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("_commands", "_tools", "_called", "file_paths")}
    none = F.array().cast("array<struct<kind: string, evidence: string, count: bigint>>")
    out = out.withColumns(zero | lists | {"repeated": F.coalesce("repeated", F.lit(False)), "hazards": F.coalesce("hazards", none)})
    out = out.withColumn("error_tool_ratio", ratio("error_count", "tool_count"))
    out = out.withColumn("raw", signals.raw_score()).withColumn("friction", signals.sigmoid("raw"))
    rules = [(r["type"], classify.matches_rule(F.col("_commands"), F.col("_tools"), r.get("commands", []), r.get("tools", [])), r["bonus"]) for r in pack.fingerprints]
    profile = {"reads": F.col("_reads"), "edits": F.col("_edits"), "bash": F.col("_bash"), "files": F.col("_files"), "tools": F.col("tool_count")}
    scores = classify.type_scores("opening", profile=profile, rules=rules)
    kind, confidence = classify.fingerprint(scores, [*C.TYPES, *sorted(set(scores) - set(C.TYPES))])
    used = classify.used_skills(F.coalesce("_said", F.lit("")), list(pack.namespaces), F.col("_attributed"), F.col("_called"))
    out = out.withColumns({"fingerprint": kind, "fingerprint_confidence": confidence, "skills_used": used})
    facts = {"retry_loops": F.col("repeated"), "tool_count": F.col("tool_count"), "edit_count": F.col("_edits")}
    options = []
    for k, rule in enumerate(pack.opportunities):
        if rule["when"] == "commands":
            needles = rule["commands"]
            facts[f"commands{k}"] = F.size(F.filter("_commands", lambda c: sum((F.contains(c, F.lit(n)).cast("int") for n in needles), F.lit(0)) > 0))
            rule = rule | {"when": f"commands{k}"}
        options.append(rule)
    missed, opportunity = classify.missed(options, facts, F.col("skills_used"))
    by_usage = F.when(F.col("_usage.context_window").isNotNull(), classify.context_percent("_usage.prompt_tokens", "_usage.context_window"))
    window = classify.message_window("model", "_peak")
    by_message = F.when(window.isNotNull() & F.col("_peak").isNotNull(), classify.context_percent("_peak", window))
    out = out.withColumns({"missed": missed, "opportunity": opportunity, "max_ctx_pct": F.when(F.col("_usage").isNotNull(), by_usage).otherwise(by_message)})
    tier = classify.tier_two(F.col("friction"), F.col("opportunity"), F.col("skills_used"), F.col("message_count"), F.col("max_ctx_pct"))
    return out.select(
        "path", "session_id", "cwd", "friction", "raw", ratio("raw", "message_count").alias("rate"), signals.dominant_signal().alias("dominant_signal"), *C.WEIGHTS, "fingerprint", "fingerprint_confidence",
        "opportunity", "missed", "skills_used", "tool_count", "error_count", "message_count", "human_turns", "parse_errors", "max_ctx_pct", "file_paths", tier.alias("tier2"), "hazards",
    )


def select_sessions(facts: DataFrame, options: Options = Options(), top: int | None = None) -> DataFrame:
    """Session rows: enough messages, in scope, richest of each session id, ranked, cut."""
    rows = facts.where((F.col("message_count") >= options.min_messages) & options.scope.member("cwd"))
    if options.dedupe:
        rows = rank.dedupe_richest(rows, "session_id", [F.desc("message_count"), F.desc("raw"), F.asc("path")])
    return rank.ranked(rows, [options.rank_by, "message_count"], ["path"], top)


def scan(events: DataFrame, options: Options = Options()) -> DataFrame:
    """The ranked sessions of some events. A limit samples sessions before they are scored, or cuts the ranking."""
    before, after = rank.split_limit(options.limit, options.scope.root is not None, options.scope.narrowed)
    if before:
        kept = rank.even_spread(events.select("session_key").distinct(), ["session_key"], before)
        events = events.join(kept, "session_key", "left_semi")
    return select_sessions(session_facts(events, options.pack), options, after)


def project(cwd: Column | str, path: Column | str) -> Column:
    return F.coalesce(F.nullif(base_name(cwd), F.lit("")), base_name(dir_name(path)))


def summary(rows: DataFrame) -> DataFrame:
    """Aggregates of sessions that hold no content: what may leave the host."""
    two = lambda c: rounded(c, 2).alias(c)
    return rows.select(
        project("cwd", "path").alias("project"), F.substring("session_id", 1, 8).alias("session"), two("friction"), two("raw"), two("rate"), "dominant_signal", "fingerprint", two("fingerprint_confidence"), two("opportunity"),
        "missed", "tool_count", "error_count", "message_count", "human_turns", "max_ctx_pct", "tier2", F.transform("hazards", lambda h: F.struct(h["kind"].alias("kind"), h["count"].alias("count"))).alias("hazards"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """The line under a scan: sessions, distinct projects, and sessions of the second tier."""
    return rows.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct(project("cwd", "path")).alias("projects"), F.count_if("tier2").alias("tier2"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each session, unknown values as null."""
    signals_ = F.struct(*[F.col(k) for k in C.WEIGHTS])
    rest = [c for c in rows.columns if c not in C.WEIGHTS]
    return rows.select(F.to_json(F.struct(*rest, signals_.alias("signals")), {"ignoreNullFields": "false"}).alias("json"))


LEGEND = "raw: weighted friction; score: 0 to 1; rate: raw by message; ctx%: the fullest context"


def render(rows: DataFrame, most: int = 20, scope: rank.Scope = rank.Scope(), wide: int = 24) -> str:
    """A text table of the first sessions, with what it covers above and what it counts below."""
    head = ("#", "session", "raw", "score", "rate", "signal", "type", "miss", "tools", "msgs", "ctx%", "project")
    left = {"session", "signal", "type", "miss", "project"}
    none = F.lit("—")
    shown = rows.withColumn("project", project("cwd", "path")).limit(most)
    cells = [
        F.coalesce(F.substring("session_id", 1, 8), none), F.format_number("raw", 2), F.format_number("friction", 2), F.format_number("rate", 2), F.coalesce("dominant_signal", none), F.col("fingerprint"),
        F.when(F.size("missed") > 0, F.array_join("missed", ",")).otherwise(none), grouped_digits("tool_count"), grouped_digits("message_count"), F.coalesce(F.round("max_ctx_pct").cast("long").cast("string"), none), F.coalesce("project", none),
    ]
    table = [head, *[(str(k), *r) for k, r in enumerate(shown.select(*[clipped(c, wide).alias(n) for c, n in zip(cells, head[1:], strict=True)]).collect(), 1)]]
    widths = [max(len(row[c]) for row in table) for c in range(len(head))]
    lines = ["  ".join(cell.ljust(w) if n in left else cell.rjust(w) for cell, w, n in zip(row, widths, head, strict=True)).rstrip() for row in table]
    n = totals(rows).first()
    covered = "all projects" if scope.root is None else f"project {scope.root}" + ("" if scope.narrowed else " (not narrowed)")
    return "\n".join([f"scope: {covered}", *lines, f"{n.sessions} sessions in {n.projects} projects, {n.tier2} of the second tier", LEGEND])


__all__ = ["ELIXIR", "PACKS", "PYTHON", "Options", "Pack", "as_json", "checked_calls", "exploded", "project", "render", "scan", "select_sessions", "session_facts", "summary", "tool_calls", "totals"]
