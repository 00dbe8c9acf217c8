import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import brown
from tracewell.llm._spark import fold
from tracewell.llm._text import word_hash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, n long, chunk string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]


def trains(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], DOC)
    return brown.score_texts(df, fold("doc_id") != 1, **more).collect()


def corpus(n=300):
    rnd = random.Random(4)
    kinds = [["the", "of", "and"], ["der", "die", "und"], ["les", "et", "pour"]]
    rows = []
    for i in range(n):
        k = rnd.randrange(3)
        text = " ".join(rnd.choice(kinds[k]) if rnd.random() < 0.5 else f"w{k}x{rnd.randrange(300)}" for _ in range(rnd.randint(5, 80)))
        rows.append((i, text if i % 3 else text.upper()))
    return rows


def test_base_scores_match_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "wholly-new words " * 20_000), (5, "the the"), (5, "the the"), (None, "the é\x0bÉ")]
    count = Counter(t for i, text in rows if trains(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, text in rows:
        said = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in said)
        want[(i, len(said), sum(count[t] > 0 for t in said), n, round(base, 4))] += 1
    got = run(spark, rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    got = [r for r in run(spark, corpus(600), share=1 / 100) if not trains(r.doc_id)]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 50


def brute_classes(texts, share, classes):
    """Word to class and the number of classes, by loops over the training texts' tokens."""
    count = Counter(t for said in texts for t in said)
    n = sum(count.values())
    known = sorted((t for t, c in count.items() if t is not None and c >= max(share * n, 2)), key=word_hash)
    place = {t: k for k, t in enumerate(known)}
    number = lambda t: len(known) + 1 if t is None else place.get(t, len(known))
    pairs = np.zeros((len(known) + 2,) * 2)
    for said in texts:
        for a, b in zip([None, *said], said):
            pairs[number(a), number(b)] += 1
    of = brown.exchange(pairs, classes).tolist()
    k = max(of) + 1
    rare, end = k, k + 1
    fixed = {t: of[place[t]] for t in known} | {None: end}
    tail = [t for t, c in count.items() if t not in fixed and c >= 2]
    cls = dict(fixed)

    def between():
        out = np.zeros((k + 2, k + 2))
        for said in texts:
            for a, b in zip([None, *said], said):
                out[cls.get(a, rare), cls.get(b, rare)] += 1
        return out

    def moved(words, g):
        beside = {t: [] for t in words}
        for said in texts:
            for a, t, b in zip([None, *said], said, said[1:]):
                if t in beside:
                    beside[t].append((cls.get(a, rare), cls.get(b, rare)))
        g = g + 0.5
        size = g.sum(1)
        fit = {t: [round(sum(math.log(g[a, c]) + math.log(g[c, b]) - 2 * math.log(size[c]) for a, b in near), 6) for c in range(k)] for t, near in beside.items()}
        return {t: cls[t] if t in cls and f[cls[t]] >= max(f) else f.index(max(f)) for t, f in fit.items()}

    cls |= moved(tail, between())
    told, best, at, r = [len(tail)], -math.inf, 0, 0
    states = [dict(cls)]
    while tail and not (r >= brown.TURNS and sum(told[-brown.TURNS :]) <= brown.FEW * len(tail)):
        g = between()
        now = sum(x * math.log(x) for x in g.flat if x) - sum(x * math.log(x) for x in [*g.sum(0), *g.sum(1)] if x)
        if now > best:
            best, at = now, r
        elif r - at >= brown.TURNS:
            cls = states[at]
            break
        new = moved([t for t in tail if word_hash(t) % brown.TURNS == r % brown.TURNS], g)
        told.append(sum(cls[t] != c for t, c in new.items()))
        cls |= new
        states.append(dict(cls))
        r += 1
    return cls, k, count, r


def test_scores_match_brute_force(spark):
    rows = corpus(150) + [(1000, None), (1001, "never seen"), (5, "the the"), (None, "the é\x0bÉ")]
    texts = [tokens(t) for i, t in rows if trains(i)]
    cls, k, count, rounds = brute_classes(texts, 1 / 100, 6)
    assert rounds > 2
    wide = k + 2
    of = lambda t: cls.get(t, k)
    three, members, total = Counter(), Counter({k: 1}), Counter()
    for said in texts:
        c = [k + 1, k + 1, *map(of, said)]
        three.update(zip(c, c[1:], c[2:]))
        total.update(c[2:])
    for t in count:
        members[of(t)] += 1
    two, one = Counter(), Counter()
    for (a, b, c), n in three.items():
        two[b, c] += n
        one[c] += n
    first, before = Counter(), Counter()
    for (b, c), n in two.items():
        first[b] += n
    for (a, b, c), n in three.items():
        before[a, b] += n
    whole = sum(one.values())

    def p(a, b, c):
        p1 = (one[c] + 1) / (whole + wide)
        p2 = (two[b, c] + brown.LOWER[0] * p1) / (first[b] + brown.LOWER[0])
        return (three[a, b, c] + brown.LOWER[1] * p2) / (before[a, b] + brown.LOWER[1])

    want = Counter()
    for i, text in rows:
        said, score = tokens(text), 0.0
        c = [k + 1, k + 1, *map(of, said)]
        for t, (x, y, z) in zip(said, zip(c, c[1:], c[2:])):
            score += math.log10(p(x, y, z)) + math.log10((count[t] + 0.5) / (total[z] + 0.5 * max(members[z], 1)))
        want[(i, len(said), round(score, 3))] += 1
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 3)) for r in run(spark, rows, share=1 / 100, classes=6)) == want


def test_chunks_and_ranges_change_nothing(spark, monkeypatch):
    rows = corpus(120)
    key = lambda out: sorted((r.doc_id, round(r.score, 6), round(r.base_score, 6)) for r in out)
    whole = key(run(spark, rows))
    monkeypatch.setattr(brown, "CHUNK", 300)
    assert key(run(spark, rows, ranges=3)) == whole


def test_words_without_frequent_neighbours_get_classes_of_their_own(spark):
    rnd = random.Random(2)
    often = lambda k: [f"often{c}{k}" for c in "abcde"]
    rare = lambda k, draw: [often(k)[0], *(f"rare{c}{k}x{draw()}" for c in "bcd"), often(k)[-1]]
    rows = [(i, " ".join(often(i % 2) if i % 4 < 2 else rare(i % 2, lambda: rnd.randrange(20)))) for i in range(4000)]
    # The words rarec have rare neighbours only: those of the same kind of text, or of the other one.
    own = [(10_000 + i, " ".join(rare(i % 2, lambda: 1))) for i in range(40)]
    mixed = [(20_000 + i, t.replace(f"rarec{i % 2}", f"rarec{1 - i % 2}")) for i, (_, t) in enumerate(own)]
    got = {r.doc_id: r.score - r.base_score for r in run(spark, rows + own + mixed, share=1 / 50, classes=10) if not trains(r.doc_id)}
    assert min(got[i] for i, _ in own if i in got) > max(got[i] for i, _ in mixed if i in got) + 0.5


def test_nothing_to_learn_from(spark):
    assert run(spark, []) == []
    out = [r for i in range(40) if not trains(i) for r in [i]][:2]
    got = run(spark, [(out[0], "a b"), (out[1], None)])
    assert [r.train_tokens for r in got] == [0, 0] and all(r.n_known == 0 and r.base_score == 0 and r.score <= 0 for r in got)


def likelihood(pairs, of):
    wide = of.max() + 3
    every = np.append(of, [wide - 2, wide - 1])
    g = np.zeros((wide, wide))
    np.add.at(g, (every[:, None], every[None, :]), pairs)
    h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return h(g) - h(g.sum(1)) - h(g.sum(0))


@pytest.mark.parametrize("seed", range(4))
def test_exchange_ends_where_no_single_move_helps(seed):
    rnd = np.random.default_rng(seed)
    pairs = rnd.poisson(rnd.gamma(0.5, 4, (14, 14))).astype(float)
    of = brown.exchange(pairs, 4)
    best = likelihood(pairs, of)
    for w in range(12):
        for k in range(4):
            other = of.copy()
            other[w] = k
            if other.max() == of.max():
                assert likelihood(pairs, other) <= best + 1e-6


def test_an_exchange_that_does_not_end_is_an_error():
    with pytest.raises(RuntimeError, match="sweeps"):
        brown.exchange(np.random.default_rng(0).poisson(3.0, (14, 14)).astype(float), 4, sweeps=1)


def test_the_model_is_a_distribution():
    counts = np.random.default_rng(1).poisson(0.3, (5, 5, 5)).astype(float)
    assert np.allclose((10 ** brown.transitions(counts)).sum(2), 1)
