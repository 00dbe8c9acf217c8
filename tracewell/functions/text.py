"""Text expressions with the semantics that byte-wise regular expressions give.

Java's word boundary looks at Unicode letters; results here have to treat only ASCII letters,
digits and underscores as word characters, so boundaries are spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CD_PREFIX, CORRECTION_CHARS, CORRECTION_NO, CORRECTION_WORDS, EXCERPT_CHARS, HARNESS_TAGS, SCAFFOLDING

BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

CORRECTION = BEFORE + f"(?:{CORRECTION_NO}(?=[A-Za-z0-9_])|(?:{CORRECTION_WORDS}){AFTER})"
#: White space at which words split: all of Unicode's but the non-breaking ones.
BREAKS = r"[\s\x0B\x85\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_words(alternatives: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + BEFORE + f"(?:{alternatives})" + AFTER


def filled(text: Column | str) -> Column:
    """Whether a text has more than white space."""
    return F.coalesce(col(text).rlike("[^" + BREAKS[1:-1]), F.lit(False))


def is_correction(text: Column | str) -> Column:
    return F.coalesce(F.substring(col(text), 1, CORRECTION_CHARS).rlike(CORRECTION), F.lit(False))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), BREAKS, " "))


def command_key(command: Column | str) -> Column:
    """A command without leading changes of directory, its white space collapsed; null if blank."""
    out = collapse(F.regexp_replace(col(command), CD_PREFIX, ""))
    return F.when(out != "", out)


def first_words(command: Column | str, n: int = 2) -> Column:
    out = collapse(F.coalesce(col(command), F.lit("")))
    return F.when(out == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(out, " "), 1, n))


def excerpt(text: Column | str, n: int = EXCERPT_CHARS) -> Column:
    out = collapse(text)
    return F.when(F.length(out) > n, F.concat(F.substring(out, 1, n), F.lit("…"))).otherwise(out)


def without_harness(text: Column | str) -> Column:
    """The text without blocks and phrases that the harness adds."""
    out = F.regexp_replace(col(text), rf"(?s)<({'|'.join(HARNESS_TAGS)})(?:\s[^>]*)?>.*?</\1>", "")
    for phrase in SCAFFOLDING:
        out = F.regexp_replace(out, phrase, "")
    return out


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression that fits at a path's end."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "{" and "}" in glob[k:]:
            out, k, depth = out + "(?:", k + 1, depth + 1
        elif glob[k] == "}" and depth:
            out, k, depth = out + ")", k + 1, depth - 1
        elif glob[k] == "," and depth:
            out, k = out + "|", k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"(^|/){out}$"


def short_name(skill: Column | str) -> Column:
    """What follows the last colon, without one leading slash."""
    return F.regexp_replace(F.coalesce(F.element_at(F.split(col(skill), ":"), -1), F.lit("")), "^/", "")


def namespaced(text: Column | str, namespaces: list[str]) -> Column:
    """Names that follow ``ns:`` for one of the namespaces."""
    if not namespaces:
        return F.array().cast("array<string>")
    pattern = rf"(?i)(?:{'|'.join(map(re.escape, namespaces))}):([a-z][a-z0-9_-]*)"
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def short_hash(text: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(col(text).cast("binary"), 256), 1, n)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), "/+$", ""), "([^/]*)$", 1)


def dir_name(path: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), "/+$", ""), "^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """From the last dot of the last path element; empty without one or for a leading dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def word_tokens(text: Column | str, least: int = 3) -> Column:
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def one_line(text: Column | str) -> Column:
    r"""Control and format characters as spaces, white space collapsed."""
    return collapse(F.regexp_replace(col(text), r"[\p{Cc}\p{Cf}]", " "))


def ratio(part: Column | str, whole: Column | str, empty: float | None = 0.0) -> Column:
    """part / whole, and ``empty`` where whole is 0."""
    return F.when(col(whole) == 0, F.lit(empty)).otherwise(col(part).cast("double") / F.nullif(col(whole), F.lit(0)))


def rounded_share(part: Column | str, whole: Column | str, digits: int) -> Column:
    """part / whole rounded half up in integers, so that no binary fraction decides."""
    scale = 10**digits
    return F.floor((col(part) * (2 * scale) + col(whole)) / F.nullif(col(whole) * 2, F.lit(0))) / float(scale)


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as SQL engines do it: scaled, rounded, scaled back. Spark's own rounding goes by the decimal digits that it prints, so 1.025 becomes 1.03."""
    scale = float(10**digits)
    return F.round(col(value) * scale) / scale


def titled(name: Column | str) -> Column:
    """A dashed or underscored name as words that begin with capitals."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
    return F.array_join(F.transform(F.split(F.coalesce(col(name).cast("string"), F.lit("")), "[-_]"), capital), " ")


def fence_safe(text: Column | str) -> Column:
    """A text that can't close the fence around it: three or more backticks become one."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), "`{3,}", "`"), f"^{BREAKS}|{BREAKS}$", "")


def quote_safe(text: Column | str) -> Column:
    """One line that can stand between double quotes."""
    return collapse(F.replace(F.coalesce(col(text), F.lit("")), F.lit('"'), F.lit("'")))


def bold_pattern(text: Column | str) -> Column:
    """A line with its name, which is what comes before the first colon, or all of it, in bold."""
    line = collapse(F.coalesce(col(text), F.lit("")))
    at = F.instr(line, ":")
    name, rest = F.trim(F.substring(line, F.lit(1), at - 1)), F.substring(line, at, F.length(line))
    return F.when(at > 0, F.concat(F.lit("**"), name, F.lit("**"), rest)).otherwise(F.concat(F.lit("**"), line, F.lit("**")))


def clipped(text: Column | str, wide: int) -> Column:
    """A text of at most so many characters; a cut one ends with an ellipsis."""
    t = col(text)
    return F.when(F.length(t) <= wide, t).otherwise(F.concat(F.substring(t, 1, max(wide - 1, 0)), F.lit("…")))


def padded(text: Column | str, wide: int, right: bool = False) -> Column:
    """A text filled up with blanks, on its left side if it is to stand right; longer texts stay whole."""
    t = col(text)
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(wide) - F.length(t), F.lit(0)))
    return F.concat(blanks, t) if right else F.concat(t, blanks)


def grouped_digits(n: Column | str) -> Column:
    """A whole number with a comma before every three digits."""
    return F.format_number(col(n).cast("long"), 0)


def percent(share: Column | str) -> Column:
    return F.when(col(share).isNull(), F.lit("—")).otherwise(F.concat(F.round(col(share) * 100).cast("long").cast("string"), F.lit("%")))
