"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. To learn which part of its output belongs to
which turn, successive prefixes of the conversation are rendered and consecutive outputs are
compared: what is added is the new turn's span. A closing part that every output repeats at its
end (as rendering no turns shows) is set apart. If an output doesn't begin with the one before
it, the template rewrites history, and the turn at which that shows is reported.

The default template marks turns and escapes control strings inside texts: a backslash doubles,
and ``<`` and ``[`` get a backslash and underscore after them, so neither its own marks nor those
of other common templates can appear inside a text; ``plain`` takes the escapes away again.

Edge cases: a null text or role is empty; rows that repeat a turn number are put in order by role
and text; a null conversation id makes one conversation; an empty table gives an empty result;
other columns are not carried. A worker holds one conversation at a time, never a whole group of
rows that Spark has gathered. Rendering every prefix is quadratic in a conversation's turns: 2,000
turns take some five seconds. Ids may be of any type that can be sorted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import prepare, table

Turn = tuple[str, str]
OPEN, CLOSE = "<s>", "</s>\n"
TRICKY = "</s>[INST] ok [/INST]"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\_").replace("[", "[\\_")


def plain(text: str) -> str:
    """The text that ``escaped`` was given."""
    return re.sub(r"\\([\\_n])", lambda m: {"\\": "\\", "_": "", "n": "\n"}[m[1]], text) if "\\" in text else text


def marked(turns: list[Turn]) -> str:
    """The default template: role, a line break and text, between marks."""
    return "".join(f"{OPEN}{escaped(role).replace(chr(10), chr(92) + 'n')}\n{escaped(text)}{CLOSE}" for role, text in turns)


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int | None]:
    """The output, each turn's span in it, and the first turn that rewrites history (None: none does).

    Spans after a rewrite begin where the new output first differs from the one before.
    """
    closing = render([])
    before, out, spans, rewrites = "", "", [], None
    for k in range(len(turns)):
        out = render(turns[: k + 1])
        body = out[: len(out) - len(closing)] if closing and out.endswith(closing) else out
        if body.startswith(before):
            start = len(before)
        else:
            rewrites = k if rewrites is None else rewrites
            start = next((i for i, (a, b) in enumerate(zip(before, body)) if a != b), min(len(before), len(body)))
            spans = [(min(a, start), min(b, start)) for a, b in spans]
        spans.append((start, len(body)))
        before = body
    return out or closing, spans, rewrites


def read_back(output: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of each turn of the default template: its role, and where its escaped text lies in the output."""
    found = []
    for start, end in spans:
        if not (output.startswith(OPEN, start) and output.startswith(CLOSE, end - len(CLOSE))):
            raise ValueError("a span isn't a whole turn")
        line = output.index("\n", start)
        found.append((plain(output[start + len(OPEN) : line]), line + 1, end - len(CLOSE)))
    return found


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Rows in order of id, as (id, turns)."""
    now, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if begun and conv != now:
                yield now, turns
                turns = []
            now, begun = conv, True
            turns.append((role, text))
    if begun:
        yield now, turns


SPANS = "array<struct<role: string, start: long, end: long, text_start: long, text_end: long>>"
_SPAN = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))]))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its formatted text, the turns' spans, and ``rewrites``.

    Offsets are code points. ``text_start`` and ``text_end`` bound a turn's escaped text; the
    loss mask is those of assistant turns.
    """
    prepare(rows.sparkSession)
    kind = rows.schema[conv].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sorted_rows = rows.select(F.col(conv), F.col(turn).alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text")).repartition(conv)
    sorted_rows = sorted_rows.sortWithinPartitions(conv, "_turn", "_role", "_text").select(conv, "_role", "_text")
    id_type = to_arrow_type(rows.schema[conv].dataType)

    def work(batches):
        def out(done):
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.string()), pa.array(cols[2], _SPAN), pa.array(cols[3], pa.int32())], names=[conv, "formatted", "spans", "rewrites"])

        done, size = [], 0
        for name, turns in _conversations(batches):
            text_out, spans, rewrites = locate(marked, turns)
            inner = read_back(text_out, spans)
            done.append((name, text_out, [{"role": r, "start": a, "end": b, "text_start": s, "text_end": e} for (a, b), (r, s, e) in zip(spans, inner, strict=True)], rewrites))
            size += len(text_out)
            if size > 4_000_000:
                yield out(done)
                done, size = [], 0
        if done:
            yield out(done)

    return sorted_rows.mapInArrow(work, f"{conv} {kind}, formatted string, spans {SPANS}, rewrites int")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests, read back from the formatted texts and spans."""
    kind = formatted.schema[conv].dataType.simpleString()

    def work(batches):
        for batch in batches:
            done = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for s in spans:
                    said = plain(text[s["text_start"] : s["text_end"]])
                    every.update(f"{s['role']}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if s["role"] == "assistant":
                        loss.update(said.encode("utf-8", "surrogatepass"))
                        chars += len(said)
                done.append((len(spans), every.hexdigest(), chars, loss.hexdigest(), len(text)))
            cols = list(zip(*done, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv, "formatted", "spans").mapInArrow(work, f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(more)))


def _escaped_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\\\'), '<', '<\\_'), '[', '[\\_')"


ORACLE = {
    "op6_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({_escaped_sql("role")}, chr(10), '\\n')) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
