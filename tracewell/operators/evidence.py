"""What a check saw: a line of text for every matcher, passed or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import BEFORE, filled
from . import artifacts as A


def _said(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _number(c: Column) -> Column:
    return c.cast("string")


def _list(items: Column) -> Column:
    return _said("[", F.array_join(items, ", "), "]")


def _counted(what: str, n: Column, wanted: object) -> Callable[[Column], Column]:
    return lambda ok: F.when(ok, _said(what, " ", _number(n))).otherwise(_said(what, " ", _number(n), f" (want {wanted})"))


def _share(what: str, part: Column, whole: Column, least: float) -> Callable[[Column], Column]:
    ratio = F.format_number(F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(0.0), 2)
    return lambda ok: F.when(ok, _said(what, " ", ratio)).otherwise(_said(what, " ", ratio, f" (want {least})"))


def _references(refs: Column, known: Column, label: str) -> Callable[[Column], Column]:
    lost = A.missing(refs, known)
    none = F.when(known.isNull(), f"no {label} index to compare with").when(F.size(refs) == 0, f"no {label} references")
    return lambda ok: F.coalesce(none, F.when(ok, _said("all ", _number(F.size(refs)), f" {label} references known")).otherwise(_said(f"unknown {label}s: ", _list(lost))))


def _over(a: A.Artifact, most: int) -> Column:
    lines = lambda s: F.size(F.filter(F.split(s["text"], "\n"), filled))
    return F.transform(F.filter(a.named_regions(), lambda s: lines(s) > most), lambda s: s["heading"])


def _words(a: A.Artifact, p: dict, name: str) -> Column:
    """The words of a list that a description holds."""
    words = [w for w in p.get(name) or (C.VAGUE if name == "forbidden" else []) if isinstance(w, str)]
    if not words:
        return F.array().cast("array<string>")
    said = F.lower(a.description())
    inside = lambda w: F.contains(said, w) if name == "keywords" else F.regexp_like(said, F.concat(F.lit(BEFORE), w, F.lit("(?![A-Za-z0-9_])")))
    return F.filter(F.array(*[F.lit(w.lower()) for w in words]), inside)


def evidence_of(name: str, a: A.Artifact, p: dict, ok: Column) -> Column:
    """The evidence of a check; ``ok``: whether it passed."""
    either = lambda yes, no: F.when(ok, yes if isinstance(yes, Column) else F.lit(yes)).otherwise(no if isinstance(no, Column) else F.lit(no))
    pattern = p.get("pattern")
    event, matcher = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (p.get("event"), p.get("matcher")))
    known = lambda n: A._known(p, n)
    options: dict[str, Callable[[], Column]] = {
        "section_exists": lambda: either(f"section '{p.get('section')}' found", _said(f"no section '{p.get('section')}' among ", _list(a.headings))),
        "max_section_lines": lambda: either(f"sections have at most {p.get('max', 40)} lines", _said(f"over {p.get('max', 40)} lines: ", _list(_over(a, p.get("max", 40))))),
        "line_count": lambda: _counted("lines", F.size(a.lines), f"<= {p.get('target', 100) + p.get('tolerance', 85)}")(ok),
        "token_estimate": lambda: _counted("tokens, about", F.floor(A.words_of(a) / 0.75 + 0.5), f"<= {p.get('max_tokens', 2000)}")(ok),
        "frontmatter_field": lambda: either(_said(f"{p.get('field')}: ", F.coalesce(a.field(str(p.get("field", ""))), F.lit(""))), f"frontmatter has no {p.get('field')}" if not p.get("expected") else f"{p.get('field')} isn't {p.get('expected')}"),
        "description_length": lambda: _counted("characters of description:", F.length(a.description()), f"{p.get('min', 50)}-{p.get('max', 250)}")(ok),
        "description_keywords": lambda: either(_said("keywords: ", _list(_words(a, p, "keywords"))), _said("keywords: ", _list(_words(a, p, "keywords")), f" (want {p.get('min', 3)})")),
        "description_no_vague": lambda: either("no vague words", _said("vague words: ", _list(_words(a, p, "forbidden")))),
        "description_structure": lambda: either("says what and when", "doesn't begin with what it does, or doesn't say when to use it"),
        "content_present": lambda: F.lit(f"invalid pattern: {pattern}") if not A.compiles(pattern) else either(f"pattern present: {pattern}", f"pattern absent: {pattern}"),
        "content_absent": lambda: F.lit(f"invalid pattern: {pattern}") if not A.compiles(pattern) else either(f"pattern absent: {pattern}", _said("forbidden: ", F.regexp_extract(a.content, f"({pattern})", 0))),
        "has_iron_laws": lambda: either(f"at least {p.get('min_count', 1)} laws", f"too few laws (want {p.get('min_count', 1)})"),
        "no_dangerous_patterns": lambda: either("no dangerous patterns", "a dangerous pattern"),
        "has_examples": lambda: either(f"at least {p.get('min_blocks', 1)} example blocks", f"too few example blocks (want {p.get('min_blocks', 1)})"),
        "action_density": lambda: _share("action density", *A.action_lines(a), p.get("min_ratio", 0.25))(ok),
        "specificity_ratio": lambda: _share("specificity", *A.concrete_lines(a), p.get("min_ratio", 0.15))(ok),
        "valid_file_refs": lambda: _references(A.file_refs(a.content), A.known_files(p), "file")(ok),
        "valid_skill_refs": lambda: _references(A.skill_refs(a.content), known("known_skills"), "skill")(ok),
        "valid_agent_refs": lambda: _references(A.agent_refs(a.content, p.get("builtin_agents") or C.BUILTIN_AGENTS), known("known_agents"), "agent")(ok),
        "hook_shebang": lambda: either(_said("shebang: ", F.trim(F.element_at(F.split(a.content, "\n"), 1))), _said("no shebang: ", F.substring(F.element_at(F.split(a.content, "\n"), 1), 1, 40))),
        "hook_no_format_chars": lambda: either("no format characters", "a format character, which changes what is displayed"),
        "hook_reads_stdin": lambda: either("reads its input, or needs none", "never reads its input"),
        "hook_pointer": lambda: either(_said("pointer: ", F.coalesce(event, F.lit("")), " / ", F.coalesce(matcher, F.lit(""))), _said("no usable pointer: ", F.coalesce(event, F.lit("no event")), " / ", F.coalesce(matcher, F.lit("no matcher")))),
    }
    return options[name]() if name in options else F.lit(f"unknown check: {name}")
