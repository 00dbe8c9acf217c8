"""Edits of texts: line diffs with collapsed context, and blocks that a program keeps in a file of someone else's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: Equal lines that a collapsed diff keeps on either side of a change.
CONTEXT = 3


# --- diffs


def script(old: list[str], new: list[str]) -> Iterator[tuple[str, str]]:
    """A shortest edit script: ("eq" | "del" | "ins", line), deletions before insertions.

    Equal ends are set apart; between them the furthest reaching paths of 0, 1, 2, ... edits are
    followed until one gets to the end, so the work is lines times edits.
    """
    head = next((k for k, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
    tail = next((k for k, (a, b) in enumerate(zip(reversed(old[head:]), reversed(new[head:]))) if a != b), min(len(old), len(new)) - head)
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    yield from (("eq", x) for x in old[:head])
    steps: list[tuple[str, str]] = []
    if not a or not b:
        steps = [("del", x) for x in a] + [("ins", x) for x in b]
    else:
        reach, trace = {1: 0}, []
        for edits in range(len(a) + len(b) + 1):
            trace.append(reach.copy())
            for k in range(-edits, edits + 1, 2):
                down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
                x = reach[k + 1] if down else reach[k - 1] + 1
                while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                    x += 1
                reach[k] = x
                if x >= len(a) and x - k >= len(b):
                    break
            else:
                continue
            break
        x, y = len(a), len(b)
        for edits in range(len(trace) - 1, -1, -1):
            reach, k = trace[edits], x - y
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            k_was = k + 1 if down else k - 1
            x_was = reach[k_was] if edits else 0
            y_was = x_was - k_was if edits else 0
            while x > x_was + (not down and edits > 0) and y > y_was + (down and edits > 0):
                x, y = x - 1, y - 1
                steps.append(("eq", a[x]))
            if edits:
                steps.append(("ins", b[y_was]) if down else ("del", a[x_was]))
                x, y = x_was, y_was
        steps.reverse()
    waiting: list[tuple[str, str]] = []
    for step in steps:  # within a change what goes stands before what comes
        if step[0] == "ins":
            waiting.append(step)
            continue
        if step[0] == "eq":
            yield from waiting
            waiting = []
        yield step
    yield from waiting
    yield from (("eq", x) for x in old[len(old) - tail :])


def line_diff(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, pos, op, line): a shortest edit script of each pair of texts, line by line. A null text is empty; keys are not null."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for k, was, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                steps = list(script((was or "").split("\n"), (now or "").split("\n")))
                at = pa.array([k] * len(steps), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([at, pa.array(range(len(steps)), pa.int64()), pa.array([o for o, _ in steps], pa.string()), pa.array([x for _, x in steps], pa.string())], names=[key, "pos", "op", "line"])

    return rows.select(key, old, new).mapInArrow(work, f"`{key}` {kind}, pos long, op string, line string")


def collapsed(diff: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """A diff whose runs of more than ``2 * context + 1`` equal lines keep their first and last ones, and a note (``skip``) of how many lie between."""
    w = Window.partitionBy(key).orderBy("pos")
    same = (F.col("op") == "eq").cast("int")
    rows = diff.withColumn("_new", F.coalesce((F.lag("op").over(w) == "eq") != (F.col("op") == "eq"), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(key, "_run").orderBy("pos")))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "_run")))
    long_run = (same == 1) & (F.col("_n") > 2 * context + 1)
    hidden = F.col("_n") - 2 * context
    note = long_run & (F.col("_i") == context + 1)
    kept = rows.where(~long_run | (F.col("_i") <= context + 1) | (F.col("_i") > F.col("_n") - context))
    said = F.concat(F.lit("⋯ "), hidden.cast("string"), F.when(hidden == 1, " unchanged line").otherwise(" unchanged lines"))
    return kept.select(key, "pos", F.when(note, "skip").otherwise(F.col("op")).alias("op"), F.when(note, said).otherwise(F.col("line")).alias("line"))


def told(diff: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines of a diff with their marks."""
    mark = F.when(F.col("op") == "del", "- ").when(F.col("op") == "ins", "+ ").otherwise("  ")
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(mark, "line").alias("l"))))
    return diff.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


# --- managed blocks

#: The name in a block's marks, and how much of the body's digest they hold.
OWNER, DIGEST = "TRACEWELL", 12


def _begin(owner: str) -> str:
    return rf"<!-- {owner}:BEGIN sha256:([0-9a-f]+) -->"


def _block(owner: str) -> str:
    return rf"(?s){_begin(owner)}\n(.*?)\n?<!-- {owner}:END -->"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def digest(body: Column | str) -> Column:
    return F.substring(F.sha2(_trimmed(col(body)).cast("binary"), 256), 1, DIGEST)


def managed(body: Column | str, owner: str = OWNER) -> Column:
    """A block with its marks; the body without white space around it."""
    return F.concat(F.lit(f"<!-- {owner}:BEGIN sha256:"), digest(body), F.lit(" -->\n"), _trimmed(col(body)), F.lit(f"\n<!-- {owner}:END -->"))


def has_block(content: Column | str, owner: str = OWNER) -> Column:
    return F.coalesce(col(content).rlike(_begin(owner)), F.lit(False))


def block_body(content: Column | str, owner: str = OWNER) -> Column:
    """What lies in the first block; null if there is none that ends."""
    return F.when(col(content).rlike(_block(owner)), F.regexp_extract(col(content), _block(owner), 2))


def upserted(content: Column | str, body: Column | str, owner: str = OWNER) -> Column:
    """A file with the block: in its place where there is one, else at the end after a blank line. Nothing else in the file changes, and doing it again changes nothing."""
    c, block = F.coalesce(col(content), F.lit("")), managed(body, owner)
    literal = F.regexp_replace(block, r"([\\$])", r"\\$1")
    ended = F.regexp_replace(c, r"(?U)\s+\z", "")
    appended = F.when(c == "", F.concat(block, F.lit("\n"))).otherwise(F.concat(ended, F.lit("\n\n"), block, F.lit("\n")))
    return F.when(has_block(c, owner), F.regexp_replace(c, F.lit(_block(owner)), literal)).otherwise(appended)


def in_sync(content: Column | str, body: Column | str, owner: str = OWNER) -> Column:
    """Whether the block holds this body, whatever its mark says."""
    return F.coalesce(digest(block_body(content, owner)) == digest(body), F.lit(False))


def tampered(content: Column | str, owner: str = OWNER) -> Column:
    """Whether someone has changed the block's body since its mark was written."""
    marked = F.regexp_extract(col(content), _block(owner), 1)
    return F.coalesce(digest(block_body(content, owner)) != marked, F.lit(False))
