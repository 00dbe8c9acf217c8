"""Scoring of text artifacts: matchers, weighted dimensions, the gate and its veto.

A matcher is a function from the artifact's parts and parameters to a boolean column, of built-in
expressions alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import AFTER, base_name, col, filled, rounded_share, whole_words
from ..plans.session import spread
from .relate import missing

HEADING = r"(?md)^##+[^\S\n]+(.*)$"


@dataclass(frozen=True)
class Artifact:
    """The parts of an artifact, as columns."""

    content: Column
    fields: Column
    frontmatter: Column
    body: Column
    lines: Column
    headings: Column
    regions: Column

    @staticmethod
    def of(content: Column | str) -> Artifact:
        c = F.coalesce(col(content), F.lit(""))
        every = F.split(c, "\n")
        rest = F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))
        close = F.when(F.element_at(every, 1) == "---", F.array_position(F.transform(rest, lambda x: F.trim(x)), "---")).otherwise(F.lit(0))
        head = F.when(close > 0, F.slice(rest, F.lit(1), F.greatest(close.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        tail = F.slice(rest, F.greatest(close.cast("int") + 1, F.lit(1)), F.size(rest) + 1)
        body = F.when(close > 0, F.regexp_replace(F.array_join(tail, "\n"), r"\A\n+", "")).otherwise(c)
        return Artifact(c, head, F.array_join(head, "\n"), body, F.split(body, "\n"), F.transform(F.regexp_extract_all(body, F.lit(HEADING), F.lit(1)), lambda x: F.trim(x)), F.split(body, HEADING))

    def field(self, name: str) -> Column:
        """A frontmatter field's value without quotes (of several lines the last); null if there is none."""
        pattern = r"^([A-Za-z0-9_-]+):\s*(.*)$"
        value = F.trim(F.regexp_extract(F.try_element_at(F.filter(self.fields, lambda x: F.regexp_extract(x, pattern, 1) == name), F.lit(-1)), pattern, 2))
        return F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")

    def description(self) -> Column:
        return F.coalesce(self.field("description"), F.lit(""))

    def named_regions(self) -> Column:
        """(heading, text) of each section."""
        return F.zip_with(self.headings, F.slice(self.regions, 2, F.greatest(F.size(self.regions), F.lit(1))), lambda h, r: F.struct(h.alias("heading"), r.alias("text")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _count(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, keep))


def _bounded(part: Column, whole: Column, least: float) -> Column:
    return F.coalesce((whole > 0) & (part >= whole * least), F.lit(False))


def compiles(pattern: object) -> bool:
    try:
        return isinstance(pattern, str) and bool(re.compile(pattern) or True)
    except re.error:
        return False


def section_exists(a: Artifact, p: dict) -> Column:
    return F.exists(a.headings, lambda h: F.contains(F.lower(h), F.lit(str(p.get("section", "")).lower())))


def max_section_lines(a: Artifact, p: dict) -> Column:
    return ~F.exists(a.named_regions(), lambda s: _count(_lines(s["text"]), filled) > p.get("max", 40))


def line_count(a: Artifact, p: dict) -> Column:
    return F.size(a.lines) <= p.get("target", 100) + p.get("tolerance", 85)


def words_of(a: Artifact) -> Column:
    return F.regexp_count(a.content, F.lit(r"\S+"))


def token_estimate(a: Artifact, p: dict) -> Column:
    return F.floor(words_of(a) / 0.75 + 0.5) <= p.get("max_tokens", 2000)


def frontmatter_field(a: Artifact, p: dict) -> Column:
    value = a.field(str(p.get("field", "")))
    return value.isNotNull() if not p.get("expected") else F.coalesce(value == str(p["expected"]), F.lit(False))


def description_length(a: Artifact, p: dict) -> Column:
    return F.length(a.description()).between(p.get("min", 50), p.get("max", 250))


def description_keywords(a: Artifact, p: dict) -> Column:
    words = p.get("keywords")
    if not isinstance(words, list) or not words:
        return F.lit(True)
    said = F.lower(a.description())
    hits = sum((F.contains(said, F.lit(w.lower())).cast("int") for w in words if isinstance(w, str)), F.lit(0))
    return hits >= p.get("min", 3)


def description_no_vague(a: Artifact, p: dict) -> Column:
    words = p.get("forbidden") or C.VAGUE
    if not isinstance(words, list) or not all(isinstance(w, str) for w in words):
        return F.lit(False)
    return ~F.lower(a.description()).rlike(whole_words("|".join(map(re.escape, words)), ignore_case=False))


def description_structure(a: Artifact, p: dict) -> Column:
    said = a.description()
    return said.rlike(C.WHAT) & said.rlike(whole_words(C.WHEN, ignore_case=False))


def content_present(a: Artifact, p: dict) -> Column:
    return a.content.rlike(p["pattern"]) if compiles(p.get("pattern")) else F.lit(False)


def content_absent(a: Artifact, p: dict) -> Column:
    return ~a.content.rlike(p["pattern"]) if compiles(p.get("pattern")) else F.lit(False)


def has_iron_laws(a: Artifact, p: dict) -> Column:
    laws = F.filter(a.named_regions(), lambda s: F.contains(F.lower(s["heading"]), F.lit("iron law")))
    items = F.transform(laws, lambda s: _count(_lines(s["text"]), lambda x: x.rlike(C.ITEM)))
    return F.coalesce(F.array_max(items) >= p.get("min_count", 1), F.lit(False))


def spliced(text: Column) -> Column:
    """Lines that a backslash continues, joined."""
    return F.regexp_replace(text, r"\\\n[ \t]*", " ")


def no_dangerous_patterns(a: Artifact, p: dict) -> Column:
    patterns = p.get("patterns")
    patterns = patterns if isinstance(patterns, list) and patterns else C.DANGEROUS
    if not all(map(compiles, patterns)):
        return F.lit(False)
    if p.get("exempt_safe_sections", True):
        safe = lambda h: sum((F.contains(F.lower(h), F.lit(x)).cast("int") for x in C.SAFE_HEADINGS), F.lit(0)) > 0
        open_ = F.concat(F.slice(a.regions, 1, 1), F.transform(F.filter(a.named_regions(), lambda s: ~safe(s["heading"])), lambda s: s["text"]))
        body = F.array_join(F.filter(F.flatten(F.transform(open_, _lines)), lambda x: ~F.trim(x).startswith("|")), "\n")
    else:
        body = spliced(a.body)
    return ~F.concat(a.frontmatter, F.lit("\n"), body).rlike("|".join(f"(?:{x})" for x in patterns))


def has_examples(a: Artifact, p: dict) -> Column:
    blocks = F.regexp_extract_all(a.body, F.lit(C.FENCE), F.lit(1))
    return _count(blocks, lambda b: _count(_lines(b), filled) >= p.get("min_lines", 2)) >= p.get("min_blocks", 1)


ACTIONABLE = "|".join([r"^\s*(?:" + C.IMPERATIVES + ")" + AFTER, *C.ACTION_FORMS])


def action_lines(a: Artifact) -> tuple[Column, Column]:
    prose = F.filter(a.lines, lambda x: filled(x) & ~F.trim(x).startswith("#") & ~F.trim(x).startswith("```"))
    return _count(prose, lambda x: x.rlike(ACTIONABLE)), F.size(prose)


def action_density(a: Artifact, p: dict) -> Column:
    return _bounded(*action_lines(a), p.get("min_ratio", 0.25))


def concrete_lines(a: Artifact) -> tuple[Column, Column]:
    said = F.filter(a.lines, filled)
    return _count(said, lambda x: x.rlike("|".join(C.CONCRETE))), F.size(said)


def specificity_ratio(a: Artifact, p: dict) -> Column:
    return _bounded(*concrete_lines(a), p.get("min_ratio", 0.15))


def _known(p: dict, name: str) -> Column:
    names = p.get(name)
    return F.lit(None).cast("array<string>") if names is None else F.array(*map(F.lit, names)).cast("array<string>")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def file_refs(text: Column) -> Column:
    own = _found(text, C.OWN_FILE)
    others = F.filter(F.regexp_extract_all(text, F.lit(C.OTHER_FILE), F.lit(0)), lambda x: ~x.startswith("CLAUDE_SKILL_DIR/"))
    return F.array_except(F.array_distinct(own), F.transform(others, base_name))


def skill_refs(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_found(text, p) for p in C.SKILL_NAMES]))


def agent_refs(text: Column, builtin: list[str]) -> Column:
    refs = F.concat(*[_found(text, p) for p in C.AGENT_NAMES])
    return F.array_except(F.array_distinct(refs), F.array(*map(F.lit, builtin)))


def known_files(p: dict) -> Column:
    return _known({"known_files": None if p.get("known_files") is None else [x.rsplit("/", 1)[-1] for x in p["known_files"]]}, "known_files")


def valid_file_refs(a: Artifact, p: dict) -> Column:
    return F.size(missing(file_refs(a.content), known_files(p))) == 0


def valid_skill_refs(a: Artifact, p: dict) -> Column:
    return F.size(missing(skill_refs(a.content), _known(p, "known_skills"))) == 0


def valid_agent_refs(a: Artifact, p: dict) -> Column:
    return F.size(missing(agent_refs(a.content, p.get("builtin_agents") or C.BUILTIN_AGENTS), _known(p, "known_agents"))) == 0


def hook_shebang(a: Artifact, p: dict) -> Column:
    return a.content.startswith("#!")


def hook_no_format_chars(a: Artifact, p: dict) -> Column:
    return ~a.content.rlike(r"\p{Cf}") if p.get("kind") == "hook" else F.lit(True)


#: What a shell line is made of where a ``#`` is no comment: an escaped sign, and quoted text, which may not end on its line. Then a comment.
SHELL = r"""(?s)(\\.|'[^']*(?:'|\z)|"[^"]*(?:"|\z))|(?<![^ \t])#.*\z"""


def without_comment(line: Column) -> Column:
    """A shell line without its trailing comment, a ``#`` outside quotes after white space or at the start, and without the white space before that.

    One pass of one alternation: what is quoted or escaped is put back, a comment isn't.
    """
    kept = F.regexp_replace(line, SHELL, "$1")
    return F.when(F.length(kept) < F.length(line), F.regexp_replace(kept, r"(?U)\s+\z", "")).otherwise(line)


def code(script: Column) -> Column:
    """A script without comments, continued lines joined."""
    kept = F.filter(_lines(script), lambda x: ~x.rlike(r"(?U)^\s*#"))
    return spliced(F.array_join(F.transform(kept, without_comment), "\n"))


def hook_reads_stdin(a: Artifact, p: dict) -> Column:
    event = p.get("event")
    event = event if isinstance(event, Column) else F.lit(event)
    reads = code(a.content).rlike("|".join(f"(?:{x})" for x in C.STDIN_READS))
    return F.when(event.isNotNull() & ~event.isin(*C.TOOL_CALL_EVENTS), True).otherwise(reads)


def hook_pointer(a: Artifact, p: dict) -> Column:
    event, matcher = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (p.get("event"), p.get("matcher")))
    good = event.isNotNull() & (event != "")
    if p.get("known_events"):
        good = good & event.isin(*p["known_events"])
    return F.coalesce(good & filled(matcher) & ~matcher.rlike(r"[\p{Cc}\p{Cf}]"), F.lit(False))


MATCHERS: dict[str, Callable[[Artifact, dict], Column]] = {
    f.__name__: f
    for f in (
        section_exists, max_section_lines, line_count, token_estimate, frontmatter_field, description_length, description_keywords, description_no_vague,
        description_structure, content_present, content_absent, has_iron_laws, no_dangerous_patterns, has_examples, action_density, specificity_ratio,
        valid_file_refs, valid_skill_refs, valid_agent_refs, hook_shebang, hook_no_format_chars, hook_reads_stdin, hook_pointer,
    )
}
VETOES = ("no_dangerous_patterns", "hook_no_format_chars")


def check(name: str, artifact: Artifact, params: dict | None = None) -> Column:
    """A matcher by its name; an unknown one fails."""
    return MATCHERS[name](artifact, params or {}) if name in MATCHERS else F.lit(False)


def _weighted(checks: list, passed: list[Column]) -> Column:
    """The weighted share of checks that passed, in ten thousandths; 1 where nothing weighs anything."""
    weights = [round(float(p.get("weight", 1.0)) * 10_000) for _, p in checks]
    total = sum(weights)
    if total <= 0:
        return F.lit(10_000).cast("long")
    won = sum((F.when(ok, F.lit(w)).otherwise(F.lit(0)).cast("long") for w, ok in zip(weights, passed, strict=True)), F.lit(0).cast("long"))
    return F.floor((won * 20_000 + total) / (2 * total)).cast("long")


def score(rows: DataFrame, content: str, eval_set: str | list = "default", params: dict | None = None, kind: str = "skill", threshold: float | None = None, evidence: bool = False) -> DataFrame:
    """``rows`` with a score for each dimension, composite, vetoed and passed, and on demand ``assertions``.

    ``params`` go to every check (known references, a hook's event and matcher); a check's own
    ``weight`` says how much it counts in its dimension. Dimension scores and the composite, which
    is that of the rounded scores, have four digits and are rounded in integers. A veto overrides the
    composite and is worked out on the artifact itself. Assertions say of each check its dimension,
    id, type, whether it passed, and the evidence.
    """
    from .evidence import evidence_of

    artifact, dims = Artifact.of(content), C.EVAL_SETS[eval_set] if isinstance(eval_set, str) else eval_set
    limit = threshold if threshold is not None else C.HOOK_THRESHOLD if kind == "hook" else C.THRESHOLD
    flags = {f"_{name}_{i}": F.coalesce(check(c, artifact, (params or {}) | p), F.lit(False)) for name, _, checks in dims for i, (c, p) in enumerate(checks)}
    veto_params = {"kind": kind, "exempt_safe_sections": kind != "hook"}
    vetoed = ~F.coalesce(check(VETOES[0], artifact, veto_params) & check(VETOES[1], artifact, veto_params), F.lit(False))
    out = spread(rows).withColumns(flags | {"vetoed": vetoed})
    out = out.withColumns({f"dim_{name}": _weighted(checks, [F.col(f"_{name}_{i}") for i in range(len(checks))]) for name, _, checks in dims})
    weights = {k: round(w * 10_000) for k, w, _ in dims}
    total = sum((F.col(f"dim_{k}") * w for k, w in weights.items()), F.lit(0))
    composite = rounded_share(total, F.lit(sum(weights.values()) * 10_000), 4) if sum(weights.values()) else F.lit(0.0)
    out = out.withColumn("composite", composite).withColumns({f"dim_{name}": F.col(f"dim_{name}") / 10_000.0 for name, _, _ in dims})
    if evidence:
        told = [
            F.struct(F.lit(name).alias("dimension"), F.lit(f"{name}-{i}").alias("id"), F.lit(c).alias("check_type"), F.col(f"_{name}_{i}").alias("passed"), evidence_of(c, artifact, (params or {}) | p, F.col(f"_{name}_{i}")).alias("evidence"))
            for name, _, checks in dims for i, (c, p) in enumerate(checks)
        ]
        out = out.withColumn("assertions", F.array(*told))
    return out.withColumn("passed", (F.col("composite") >= limit) & ~F.col("vetoed")).drop(*flags)


def failed_evidence(assertions: Column, dimension: Column) -> Column:
    """What the checks of a dimension that failed have to say."""
    return F.transform(F.filter(assertions, lambda a: (a["dimension"] == dimension) & ~a["passed"]), lambda a: a["evidence"])


def route(explicit: list | None = None, pack_eval: dict | None = None, runner: Callable | None = None) -> tuple[str | list, str]:
    """Which dimensions judge an artifact, and the name of the engine that does.

    Dimensions given by the caller come first, then a pack's own. A pack that wants an outside
    program to judge gets one only through ``runner``; without it the default dimensions judge, and
    the engine's name says that they stand in.
    """
    if explicit:
        return explicit, "native"
    if pack_eval is None:
        return "default", "native"
    if pack_eval.get("mode") == "exec-in-place":
        return ("default", "native:fallback") if runner is None else (runner(pack_eval), "adapter:exec-in-place")
    dims = [(d["name"], float(d.get("weight", 1.0)), [(c["type"], {k: v for k, v in c.items() if k != "type"}) for c in d.get("checks", [])]) for d in pack_eval.get("dimensions") or []] if pack_eval.get("mode") == "vendored" else []
    return dims or "default", "native"


def long_scores(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """One row for each dimension of ``score``'s result."""
    return rows.unpivot(keys, [f"dim_{d}" for d in dims], "dimension", "score").withColumn("dimension", F.substring("dimension", 5, 100))
