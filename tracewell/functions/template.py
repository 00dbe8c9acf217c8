"""Templates with values and sections, and JSON out of a model's answer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_SECTION = re.compile(r"\{\{#\s*([\w.]+)\s*\}\}(.*?)\{\{/\s*\1\s*\}\}", re.S)
_VALUE = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def fill(template: str, values: dict) -> str:
    """``{{x}}`` is a value; ``{{#x}}...{{/x}}`` repeats for a list, stands for true and goes for what is empty or false."""

    def section(m: re.Match) -> str:
        held = values.get(m[1])
        if isinstance(held, list):
            return "".join(fill(m[2], values | (x if isinstance(x, dict) else {"." : x, "item": x})) for x in held)
        return fill(m[2], values) if held else ""

    def value(m: re.Match) -> str:
        held = values.get(m[1])
        return "" if held is None else str(held)

    return _VALUE.sub(value, _SECTION.sub(section, template))


def json_in(answer: Column | str) -> Column:
    """The JSON object in an answer, between its first and last brace; null if it doesn't parse."""
    return F.try_parse_json(F.regexp_extract(col(answer), r"(?s)(\{.*\})", 1))
