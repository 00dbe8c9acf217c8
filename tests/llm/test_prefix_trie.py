import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import prefix_trie as P

ROWS = "conv_id long, turn int, role string, text string, depth int, p1 long, chars string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "clash") for r in rows], ROWS)


def brute(rows, block=100, heads=6):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    made = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = original.get(c - int(math.fmod(c, block)), [])[:h] + own[h:]
    return brute_trie(made)


def brute_trie(made):
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, held in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(held) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(held), len(node), parent, len(held), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def check(df, wanted):
    got = [tuple(r) for r in df.collect()]
    assert set(got) == wanted[0] and len(got) == wanted[1]


@pytest.mark.parametrize("block", [2, 4096])
def test_equal_to_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "RANGE_ROWS", 40)
    monkeypatch.setattr(P, "SHARES", 20)
    monkeypatch.setattr(P, "JOINED", 64)
    draw = random.Random(block)
    rows = []
    for c in [*range(0, 60), *range(100, 150), 250, 299, 1000]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["a", "bb", "ccc"])))
    rows += [(3, None, "system", "first"), (3, 2, None, None), (3, 2, None, None), (4, 0, "user", ""), (None, 0, "user", "nobody"), (None, None, None, None), (-7, 0, "user", "x"), (5, 1, "user", "é" * 50_000)]
    rows += [(40, 50 + t, "user", "same") for t in range(37)] + [(41, 50 + t, "user", "same") for t in range(37)]  # long ones
    rows += [(7, 9, "user", "tie")] * 60  # one turn number, again and again
    check(P.trie(*P.rebuilt(P.numbered(table(spark, rows)))), brute(rows))


def test_copies_and_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 50)
    monkeypatch.setattr(P, "JOINED", 64)
    rows = [(c, t, "user", f"{t}") for c in range(100, 400) for t in range(3)] + [(c, t, "user", "hi" if t == 0 else f"{c}") for c in range(400, 520) for t in range(2)]
    made = {}
    for c, t, role, text in rows:
        made.setdefault(c, []).append((role, text))
    turns = P.numbered(table(spark, rows))
    check(P.trie(turns, turns.select("conv").distinct()), brute_trie(made))


def test_light_edges_in_many_levels(spark):
    """A binary tree of depth 6, and a chain of 300 turns beside it."""
    rows = [(c, t, "user", f"{(c >> t) & 1}") for c in range(64) for t in range(6)] + [(1000, t, "user", "deep") for t in range(300)]
    made = {}
    for c, t, role, text in rows:
        made.setdefault(c, []).append((role, text))
    turns = P.numbered(table(spark, rows))
    nodes = P.nodes_of(P.named(turns), turns.select("conv").distinct())
    paths = P.heavy_paths(nodes)
    sizes = [r.n for r in paths.groupBy("h1", "h2").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 65 and max(sizes) in (7, 300)
    check(P.trie(turns, turns.select("conv").distinct()), brute_trie(made))


def test_turnless_conversations_and_no_rows(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its lender is absent and its turn is replaced
    rows = [(lone, 0, "user", "gone")]
    check(P.trie(*P.rebuilt(P.numbered(table(spark, rows)))), brute(rows))
    assert P.trie(*P.rebuilt(P.numbered(table(spark, [])))).count() == 0
    assert P.trie(*P.rebuilt(P.numbered(table(spark, [(None, 1, "user", "x")])))).count() == 0
