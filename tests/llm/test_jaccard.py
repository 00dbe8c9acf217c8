import random
import re

import numpy as np
import pytest

from tracewell.llm import jaccard
from tracewell.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, n long, sig string"


def set_of(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=3, percent=90):
    sets = [set_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted((str(i), len(s), str(low.get(root(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "en", 0, "clash") for i, t in rows], DOC)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df, **more).collect())


def corpus(seed, bases, copies, words=lambda rnd: rnd.choice([5, 12, 30, 33, 70, 140])):
    rnd = random.Random(seed)
    say = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(12)) for _ in range(n)]
    shared = [say(12) for _ in range(3)]
    rows = []
    for _ in range(bases):
        base = say(words(rnd)) + rnd.choice(shared) * rnd.choice([0, 1, 1, 3])
        for _ in range(rnd.randint(1, copies)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                text[rnd.randrange(len(text))] = say(1)[0]
            if rnd.random() < 0.3:
                text = text + say(rnd.randint(1, 3))
            rows.append((len(rows) * 3 % 997, " ".join(text) if rnd.random() < 0.8 else "\n".join(text).upper()))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 40, 8) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a"), (2004, "A"), (2005, "a b"), (2006, "a  b"), (5, "x y z"), (5, "x y z"), (None, "x y z"), (2007, "w " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_large_groups_of_near_copies(spark):
    rows = corpus(2, 3, 90, lambda rnd: 60)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shingle=5, percent=80) == brute(rows, 5, 80)


def test_copies_of_copies(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows, now = [], base
    for i in range(120):
        now = list(now if i % 3 else rnd.choice([base, now]))
        for _ in range(rnd.choice([1, 1, 2, 3])):
            now[rnd.randrange(len(now))] = rnd.choice(["zig", "zag"]) + str(rnd.randrange(40))
        rows.append((i, " ".join(now)))
    assert run(spark, rows) == brute(rows)


def test_pairs_of_one_hub_that_link_share_a_place_in_their_differences():
    rnd = np.random.default_rng(11)
    for _ in range(3000):
        n = int(rnd.integers(20, 90))
        universe = np.unique(rnd.integers(0, 2**63, n + 60).astype(np.uint64))
        level = rnd.integers(0, 4, len(universe)).astype(np.uint8)
        picks = []
        for _ in range(3):
            drop = int(rnd.integers(0, n // 6))
            more = rnd.choice(np.arange(n, n + 20), int(rnd.integers(0, n // 6)), replace=True)
            picks.append(np.unique(np.concatenate([np.delete(np.arange(n), rnd.choice(n, drop, replace=False)), more])))
        hub, x, y = picks
        level[np.intersect1d(x, y)] = np.maximum(level[np.intersect1d(x, y)], 1)
        both = len(np.intersect1d(x, y))
        (near_x, dx, tx, px), (near_y, dy, ty, py) = (jaccard.difference(universe[k], level[k], universe[hub]) for k in (x, y))
        assert near_x == (100 * len(np.intersect1d(x, hub)) >= 90 * len(np.union1d(x, hub)))
        if 100 * both >= 90 * len(np.union1d(x, y)) and not (near_x and near_y) and dx and dy:
            need = -((jaccard.allowed(len(x) + len(y)) - dx - dy) // 2)
            assert any(a == b and p + need <= dx and q + need <= dy for a, p in zip(tx, px) for b, q in zip(ty, py))


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [("1", 0, "1"), ("2", 0, "2")]


def test_chunks_and_ranges_change_nothing(spark, monkeypatch):
    rows = corpus(5, 20, 8)
    monkeypatch.setattr(jaccard, "CHUNK", 400)
    assert run(spark, rows, ranges=3) == brute(rows)


@pytest.mark.parametrize("percent", [30, 50, 100])
def test_other_thresholds(spark, percent):
    rows = corpus(6, 15, 8)
    assert run(spark, rows, percent=percent) == brute(rows, percent=percent)


def test_thresholds_that_prefixes_cannot_keep_are_errors(spark):
    for percent in (0, 10, 29, 101):
        with pytest.raises(ValueError, match="per cent"):
            run(spark, [(1, "a")], percent=percent)


@pytest.mark.parametrize("percent", [30, 50, 80, 90])
def test_linked_sets_share_a_signature_whatever_the_levels(percent):
    rnd = np.random.default_rng(7)
    most = min(100 - percent, 60) / 100
    for _ in range(4000):
        n = int(rnd.integers(1, 120))
        universe = rnd.integers(0, 2**63, n + 40).astype(np.uint64)
        universe = np.unique(universe)
        level = rnd.choice(4, len(universe), p=rnd.dirichlet([0.5, 0.3, 0.3, 1.0])).astype(np.uint8)
        x = np.arange(len(universe))[:n]
        drop = int(rnd.integers(0, int(n * most) + 1))
        y = np.concatenate([np.delete(x, rnd.choice(len(x), drop, replace=False)), np.arange(n, min(n + int(rnd.integers(0, int(n * most) + 1)), len(universe)))])
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            level[np.setxor1d(x, y)] = rnd.integers(0, 4, len(np.setxor1d(x, y)))
            level[np.intersect1d(x, y)] = np.maximum(level[np.intersect1d(x, y)], 1)  # two sets hold them
            a, b = (jaccard.signatures(universe[k], level[k], percent) for k in (x, y))
            assert len(np.intersect1d(a, b)), (n, drop)


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (None, 5), (7, 7)]
    got = dict(components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[300] == 299


@pytest.mark.parametrize("order", ["ascending", "least last", "zigzag", "random"])
def test_components_of_long_chains_take_few_rounds(spark, monkeypatch, order):
    from tracewell.llm import components as module

    n = 4096
    chain = {"ascending": list(range(n)), "least last": [*range(1, n), 0], "zigzag": [x for i in range(n // 2) for x in (i, n - 1 - i)], "random": [int(x) for x in np.random.default_rng(1).permutation(n)]}[order]
    cuts = []
    monkeypatch.setattr(module, "cut", lambda df, real=module.cut: cuts.append(real(df)) or cuts[-1])
    out = components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long"))
    assert out.count() == n and out.where("root <> 0").isEmpty() and len(cuts) - 1 <= 15
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = [df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get() for df in cuts]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert [path(f).getFileSystem(conf).exists(path(f)) for f in files] == [False] * (len(files) - 1) + [True]
