"""Spelling variant grouping with forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point makes one the other. A single
edit leaves a word's first or its second half untouched. So a word is looked up twice: in an
automaton of words, along its first half exactly and from there with one error, and in an
automaton of reversed words, along its second half exactly. States of the automata hold how many
words follow, so a path's sum is the word's number in sorted order, by which its count is found.
A pair that both directions find is counted by the forward one alone: the length of the words'
common beginning tells which direction owns it.

Words are dealt by the half that has to match exactly, so no word list is ever broadcast or in one
task: a word goes to the two halves that words of its own length or one more or less would look
for, in each direction. A half that more than ``HOT`` words share is split again: of the part that
may differ, one half has to match exactly too, and so on, down to single code points. Each task
builds automata of some ``EACH`` words, with numpy, level by level.

Edge cases: a null text has no words; a null id is the empty string before the colon; empty texts
and tables give empty results; very long texts and words are scanned once (an automaton takes one
step for each code point of its longest word); ties go to the smaller word in code-point order;
other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, table
from .sharding import sql_crc32

#: Dictionary rows of a task, about, and the most that may share one half before it is split.
EACH = 100_000
HOT = 20_000
#: Queries that are completed at a time.
BLOCK = 10_000
#: How often a shared half may be split: beyond, what may differ is a code point or two.
DEEPEST = 12

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-z\\u00C0-\\u00FF"


# --- words and their counts


def runs(docs: DataFrame, least: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, run) of every maximal run of letters with at least ``least`` of them, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(key).cast("string").alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))


def misspelt(key: Column, run: Column, every: int = 31) -> Column:
    """The run, or without one code point where ``every`` divides the checksum of key and run."""
    h = F.crc32(F.concat(F.coalesce(key, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, word: str = "word", least: int = 7, copies: int = 2) -> DataFrame:
    """(word, n) of words with at least ``least`` code points and ``copies`` occurrences."""
    long_enough = words.select(F.col(word).alias("word")).where(F.char_length("word") >= least)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= copies)


# --- halves


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for each half of the part that may differ which words near it would look for.

    ``a`` code points at the word's beginning and ``b`` at its end match exactly. A query (asks)
    owns the near words that share at least ``low`` and less than ``high`` first code points.
    """
    free = F.char_length("word") - F.col("a") - F.col("b")
    steps = []
    for way in ("f", "b"):
        half = (lambda x: F.floor(x / 2)) if way == "f" else (lambda x: F.ceil(x / 2))
        own = half(free)
        for taken in (half(free - 1), half(free + 1)):
            first = taken if way == "f" else F.lit(0)
            last = taken if way == "b" else F.lit(0)
            split = F.col("a") + F.floor(free / 2)
            steps.append(
                F.struct(
                    F.concat("path", F.lit(way)).alias("path"), (F.col("a") + first).cast("int").alias("a"), (F.col("b") + last).cast("int").alias("b"),
                    (F.col("asks") & (taken == own)).alias("asks"), (taken >= 0).alias("fits"),
                    (F.greatest("low", split) if way == "f" else F.col("low")).cast("int").alias("low"),
                    (F.least("high", split) if way == "b" else F.col("high")).cast("int").alias("high"),
                )
            )
    out = rows.select("word", "n", F.explode(F.array(*steps)).alias("s")).select("word", "n", "s.*").where("fits").drop("fits")
    begin, end = F.col("word").substr(F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.col("word").substr(F.char_length("word") - F.col("b") + 1, F.col("b"))).otherwise("")
    return out.withColumn("half", F.xxhash64("path", "a", "b", begin, end))


def dealt(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Words (word, n) under the halves by which they are looked up; none is shared by more than ``hot`` words, unless it can't be split."""
    whole = words.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(True).alias("asks"), F.lit(0).alias("low"), F.lit(1 << 30).alias("high"))
    rows, done = _halves(whole), []
    for _ in range(DEEPEST):
        heavy = cut(rows.groupBy("half").count().where(F.col("count") > hot).select("half"))
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, "half", "left_anti"))
        rows = _halves(rows.join(heavy, "half", "left_semi").drop("half"))
    for more in done:
        rows = rows.unionByName(more)
    return rows


# --- automata


def _mixed(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    h = (x * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F + 4 * seed) + np.uint64(seed))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Automaton:
    """The minimal acyclic automaton of sorted words, with the number of each word.

    Edges lie in order of (state, label) under ``code``; ``skip`` is how many words come before
    those that take the edge. ``state[starts[w] + d]`` is where word w is after d code points.
    """

    chars: np.ndarray
    starts: np.ndarray
    code: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    first: np.ndarray
    final: np.ndarray
    state: np.ndarray
    before: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts) - 1

    def follow(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The edge of each state with this label, or -1."""
        wanted = (states.astype(np.int64) << 21) | labels
        at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        return np.where(self.code[at] == wanted, at, -1)


def automaton(words: list[str]) -> Automaton:
    """From sorted, distinct, non-empty words: a trie level by level, then equal states made one from the shortest futures up."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lens + 1, out=starts[1:])  # every word has a closing 0
    chars = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    node = np.zeros(len(words), np.int64)
    at_depth = np.zeros(len(chars), np.int64)  # the trie node of every word after every code point
    parents, labels, depth_of, ends, made, depth = [], [], [np.zeros(1, np.int64)], [], 1, 0
    active = np.arange(len(words))
    while len(active):
        label = chars[starts[active] + depth]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (node[active][1:] != node[active][:-1]) | (label[1:] != label[:-1])
        child = made - 1 + np.cumsum(fresh)
        parents.append(node[active][fresh])
        labels.append(label[fresh])
        made += int(fresh.sum())
        node[active] = child
        depth += 1
        at_depth[starts[active] + depth] = child
        over = lens[active] == depth
        ends.append(child[over])
        active = active[~over]
    parent, label = np.concatenate(parents), np.concatenate(labels)
    child = np.arange(1, made)
    final = np.zeros(made, bool)
    final[np.concatenate(ends)] = True
    height = np.zeros(made, np.int64)
    for level in reversed([np.arange(c - len(p), c) for p, c in zip(parents, np.cumsum([len(p) for p in parents]))]):  # edges of each depth
        np.maximum.at(height, parent[level], height[child[level]] + 1)
    # equal states: same end mark, and the same labels to equal states
    kind = np.zeros(made, np.int64)
    kinds, chosen = 0, []
    by_height = np.argsort(height[parent], kind="stable")
    edge_from = np.searchsorted(height[parent][by_height], np.arange(height.max() + 2))
    nodes_by = np.argsort(height, kind="stable")
    node_from = np.searchsorted(height[nodes_by], np.arange(height.max() + 2))
    for h in range(int(height.max()) + 1):
        here = nodes_by[node_from[h] : node_from[h + 1]]
        sign = np.zeros((made if h == 0 else 0, 2), np.uint64)
        if h:
            edges = by_height[edge_from[h] : edge_from[h + 1]]
            owners, begin = np.unique(parent[edges], return_index=True)
            order = np.argsort(parent[edges], kind="stable")
            edges, begin = edges[order], np.searchsorted(parent[edges][order], owners)
            to, on = kind[child[edges]].astype(np.uint64), label[edges].astype(np.uint64)
            sign = np.stack([np.add.reduceat(_mixed(to, on, k), begin) for k in (1, 2)], axis=1)
            here = owners
        else:
            sign = np.zeros((len(here), 2), np.uint64)
        sign[:, 0] += final[here].astype(np.uint64)
        key = np.ascontiguousarray(sign).view([("a", np.uint64), ("b", np.uint64)]).ravel()
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        kind[here] = kinds + which.ravel()
        chosen.append(here[one])
        kinds += len(one)
    chosen = np.concatenate(chosen)  # one trie node of each state
    state_of = np.full(made, -1, np.int64)
    state_of[chosen] = np.arange(kinds)
    kept = state_of[parent] >= 0
    source, target, on = state_of[parent[kept]], kind[child[kept]], label[kept]
    order = np.lexsort((on, source))
    source, target, on = source[order], target[order], on[order]
    first = np.searchsorted(source, np.arange(kinds + 1))
    ends_here = final[chosen]
    # how many words follow: states lie in order of height, so targets are done before sources
    follow = ends_here.astype(np.int64)
    heights = height[chosen]
    begin = np.searchsorted(heights[source] if len(source) else np.zeros(0), np.arange(heights.max() + 2))
    for h in range(1, int(heights.max()) + 1):
        edges = np.arange(begin[h], begin[h + 1])
        np.add.at(follow, source[edges], follow[target[edges]])
    before = np.cumsum(follow[target]) - follow[target] if len(target) else np.zeros(0, np.int64)
    skip = before - before[np.minimum(first[source], max(len(before) - 1, 0))] + ends_here[source] if len(before) else before
    # the number of every word's beginning along its own path
    state = kind[at_depth]
    passed = np.zeros(len(chars), np.int64)
    out = Automaton(chars, starts, (source << 21) | on, target, skip, first, ends_here, state, passed)
    inner = np.ones(len(chars), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    gained = np.zeros(len(chars) + 1, np.int64)
    gained[at + 1] = skip[out.follow(state[at], chars[at])]
    total = np.cumsum(gained)[:-1]
    out.before = total - np.repeat(total[starts[:-1]], lens + 1)
    return out


def completed(a: Automaton, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words one edit away from those ``asked`` (numbers of words in ``a``), with the edit at a place from low up to high.

    Returns, of each pair found: position in ``asked``, number of the word found, place of the
    edit and its kind (0 replaced, 1 inserted, 2 deleted). The place is the first that gives the
    word, which is where the two words part.
    """
    lens = a.lengths[asked]
    top = np.minimum(high, lens + 1)
    many = np.maximum(top - low, 0)
    who = np.repeat(np.arange(len(asked)), many)
    place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + low[who]
    base = a.starts[asked][who]
    here, own = a.state[base + place], a.chars[base + place]
    passed = a.before[base + place]
    inside = place < lens[who]
    # a deleted code point: only the last of a run
    dropped = inside & (a.chars[base + np.minimum(place + 1, lens[who])] != own)
    # another code point, by every edge that the word itself doesn't take
    fan = a.first[here + 1] - a.first[here]
    origin = np.repeat(np.arange(len(who)), fan)
    edge = np.arange(len(origin)) - np.repeat(np.cumsum(fan) - fan, fan) + a.first[here][origin]
    other = (a.code[edge] & ((1 << 21) - 1)) != own[origin]
    origin, edge = origin[other], edge[other]
    swap = inside[origin]
    parts = [  # who, state, number so far, next position of the word, place, kind
        (who[origin[swap]], a.target[edge[swap]], (passed[origin] + a.skip[edge])[swap], place[origin[swap]] + 1, place[origin[swap]], 0),
        (who[origin], a.target[edge], passed[origin] + a.skip[edge], place[origin], place[origin], 1),
        (who[dropped], here[dropped], passed[dropped], place[dropped] + 1, place[dropped], 2),
    ]
    w, s, number, pos, at = (np.concatenate([p[k] for p in parts]) for k in range(5))
    kind = np.concatenate([np.full(len(p[0]), p[5]) for p in parts])
    found = []
    while len(w):
        over = pos == lens[w]
        hit = over & a.final[s]
        found.append((w[hit], number[hit], at[hit], kind[hit]))
        go = np.flatnonzero(~over)
        e = a.follow(s[go], a.chars[a.starts[asked[w[go]]] + pos[go]])
        on = e >= 0
        go, e = go[on], e[on]
        w, s, number, pos, at, kind = w[go], a.target[e], number[go] + a.skip[e], pos[go] + 1, at[go], kind[go]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))


def _parting(a: Automaton, asked: np.ndarray, who: np.ndarray, found: np.ndarray, place: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of pairs found among reversed words: how many first code points the two words share, read forward.

    What is dropped or inserted within a run of equal code points parts the words at the run's
    end, read forward, wherever in the run it was found.
    """
    lens, base = a.lengths[asked[who]], a.starts[asked[who]]
    forward = lens - place - (kind != 1)
    # the code point that was dropped, or was put in
    c = np.where(kind == 1, a.chars[a.starts[found] + place], a.chars[base + np.minimum(place, lens)])
    moving = np.flatnonzero(kind != 0)
    while len(moving):  # step along the run, which lies before this place among reversed words
        p = forward[moving]
        nxt = np.where(kind[moving] == 1, p, p + 1)  # index, read forward, of the code point that has to equal c
        ok = nxt < lens[moving]
        ok[ok] = a.chars[base[moving[ok]] + lens[moving[ok]] - 1 - nxt[ok]] == c[moving[ok]]
        moving = moving[ok]
        forward[moving] += 1
    return forward


def _search(way: str, word: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray, asks: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    """(row, near words, greatest count, its word) of each row that asks, from one direction's rows of a task."""
    back = way == "b"
    spelt = [w[::-1] for w in word] if back else word
    order = sorted(set(spelt))
    number = {w: i for i, w in enumerate(order)}
    of = np.fromiter((number[w] for w in spelt), np.int64, len(spelt))
    count = np.zeros(len(order), np.int64)
    count[of] = n
    # forward order decides ties
    rank = np.empty(len(order), np.int64)
    rank[np.array(sorted(range(len(order)), key=lambda i: order[i][::-1]) if back else range(len(order)), np.int64)] = np.arange(len(order))
    machine = automaton(order)
    ask = np.flatnonzero(asks)
    for start in range(0, len(ask), BLOCK):
        rows = ask[start : start + BLOCK]
        lens = machine.lengths[of[rows]]
        # the far half isn't a bound: within a run of equal code points the place that is found may lie in it
        who, hit, place, kind = completed(machine, of[rows], (b if back else a)[rows], lens + 1 if back else high[rows])
        part = _parting(machine, of[rows], who, hit, place, kind) if back else place
        owned = (part >= low[rows][who]) & (part < high[rows][who])
        who, hit = who[owned], hit[owned]
        near = np.bincount(who, minlength=len(rows))
        best = np.lexsort((rank[hit], -count[hit], who))
        who_first, at = np.unique(who[best], return_index=True)
        top = hit[best][at]
        names = [order[i][::-1] if back else order[i] for i in top]
        yield rows[who_first], near[who_first], count[top], names


def _near_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows: one automaton for each direction that its last step took, and its queries."""
    held = pa.Table.from_batches(list(batches))
    for way in ("f", "b"):
        rows = held.filter(pa.compute.equal(held.column("way"), way))
        if not rows.num_rows:
            continue
        word = rows.column("word").to_pylist()
        cols = {c: rows.column(c).to_numpy() for c in ("n", "a", "b", "asks", "low", "high")}
        for at, near, top, names in _search(way, word, **{k: v.astype(np.int64) if k != "asks" else v.astype(bool) for k, v in cols.items()}):
            yield pa.RecordBatch.from_arrays(
                [pa.array([word[i] for i in at], pa.string()), pa.array(near, pa.int64()), pa.array(top, pa.int64()), pa.array(names, pa.string())], names=["word", "near", "top", "name"]
            )


def near_words(words: DataFrame, hot: int = HOT, each: int = EACH) -> DataFrame:
    """Of each word (word, n) that has near words: how many, and the one with the greatest count (ties: the smaller word)."""
    rows = dealt(words, hot)
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-4 * words.count() // each))
    placed = rows.select("half", "word", "n", F.substring("path", -1, 1).alias("way"), "a", "b", "asks", "low", "high").repartition(tasks, "half").drop("half")
    found = placed.mapInArrow(_near_in_task, "word string, near long, top long, name string")
    best = F.min(F.struct((-F.col("top")).alias("less"), "name")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("top"), F.col("best.name").alias("name"))


def grouped(words: DataFrame, ratio: int = 10, hot: int = HOT, each: int = EACH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n).

    A form's count is at least ``ratio`` times that of the word, so chains of forms are short: as
    many doublings reach their ends as the greatest count allows, and no round needs a check.
    """
    if ratio < 2:
        raise ValueError("a form has to be at least twice as frequent")
    words = cut(words)
    near = near_words(words, hot, each)
    with_form = F.col("top") >= F.col("n") * ratio
    out = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(with_form, F.col("name")).alias("form"), F.when(with_form, F.col("top")).alias("form_n")))
    most = out.agg(F.max("form_n")).first()[0] or 1
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(1 + math.log(most, ratio)))):
        roots = cut(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 7, copies: int = 2, ratio: int = 10, every: int | None = None, text: str = "text", key: str = "doc_id", hot: int = HOT, each: int = EACH) -> DataFrame:
    """Words of whole texts, grouped. With ``every``, one of so many runs (by checksum of key and run) loses a code point before it is counted."""
    prepare(docs.sparkSession)
    found = runs(docs, least, text, key)
    word = F.col("run") if every is None else misspelt(F.col("key"), F.col("run"), every)
    return grouped(vocabulary(found.select(word.alias("word")), "word", least, copies), ratio, hot, each)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"), every=31)


ORACLE = {
    "op12_spelling": f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
  unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
p AS (SELECT k, run, count(*) AS m, {sql_crc32("(k || ':' || run)")} AS h FROM r GROUP BY k, run),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, m FROM p),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS name, max(v.n) AS top FROM e JOIN v ON v.word = e.b GROUP BY a),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN name END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN f USING (word)),
t(word, top) AS (SELECT word, word FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.top WHERE g.form IS NOT NULL)
SELECT g.word, g.form, t.top AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n
FROM g JOIN t USING (word) JOIN g z ON z.word = t.top WHERE z.form IS NULL""",
}
