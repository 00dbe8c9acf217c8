import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import spelling as S

DOC = "doc_id long, text string, word string, n int, half long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        around = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = around[0][1] if around and -around[0][0] >= ratio * n else None
        forms[w], out[w] = form, [len(around), counts[form] if form else None]
    rows = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, counts[w], *out[w]))
    return rows


def some_words(draw, letters, most, many):
    return {"".join(draw.choice(letters) for _ in range(draw.randint(1, most))) for _ in range(many)}


def test_automata_number_words_and_complete_them_once_with_one_error():
    draw = random.Random(2)
    for t in range(120):
        words = sorted(some_words(draw, "ab" if t % 2 else "abcé", 7, draw.randint(1, 60)))
        for back in (False, True):
            listed = sorted(w[::-1] for w in words) if back else words
            a = S.automaton(listed)
            assert [a.before[a.starts[i] + len(w)] for i, w in enumerate(listed)] == list(range(len(listed)))
            prefixes = {w[:k] for w in listed for k in range(len(w) + 1)}
            assert len(a.final) == len({frozenset(w[len(p) :] for w in listed if w.startswith(p)) for p in prefixes})
            asked = np.arange(len(listed))
            who, hit, place, kind = S.completed(a, asked, asked * 0, asked * 0 + 100)
            assert sorted(zip(who, hit)) == [(i, j) for i, x in enumerate(listed) for j, y in enumerate(listed) if near(x, y)]
            part = S._parting(a, asked, who, hit, place, kind) if back else place
            for i, j, p in zip(who, hit, part):
                x, y = (listed[i][::-1], listed[j][::-1]) if back else (listed[i], listed[j])
                assert x[:p] == y[:p] and x[p : p + 1] != y[p : p + 1]


@pytest.mark.parametrize(("hot", "deepest"), [(6, 3), (25, 12), (20_000, 12)])
def test_groups_equal_brute_force_however_often_halves_are_split(spark, monkeypatch, hot, deepest):
    monkeypatch.setattr(S, "DEEPEST", deepest)
    draw = random.Random(hot)
    words = some_words(draw, "ab", 9, 150) | some_words(draw, "abcdé", 6, 150) | {"x", "xy", "z" * 3000, "z" * 2999}
    counts = {w: draw.choice([1, 1, 2, 15, 30, 200, 2500]) for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    out = S.grouped(rows, hot=hot, each=100)
    assert {tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(counts)
    assert out.count() == len(counts)


def test_texts_to_groups(spark):
    draw = random.Random(4)
    base = ["straßen", "forward", "Église", "recueil", "spelling", "hundreds", "ÀÉÎÕÜÿß"]
    texts = []
    for i in range(600):
        said = [draw.choice(base) for _ in range(draw.randint(0, 30))]
        texts.append((i, "--".join(said) + " x1short9y"))
    texts += [(None, "forward spelling"), (None, None), (7, ""), (601, "a" * 30_000), (602, "a" * 30_000), (5, texts[5][1])]
    texts.append((603, "spelling " * 20_000))
    counts = Counter()
    upper = str.maketrans(S.UPPER, S.LOWER)
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in texts], DOC)
    out = S.variants(docs, every=31).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute(counts) and len(out) == len(counts)
    assert any(r.form for r in out)


def test_chains_end_at_the_last_form(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000}
    out = S.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.word: r.root for r in out} == dict.fromkeys(counts, "aabbbbb")
    with pytest.raises(ValueError):
        S.grouped(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_no_texts(spark):
    out = S.variants(spark.createDataFrame([], DOC), every=31)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert S.variants(spark.createDataFrame([(1, None, "", 0, 0), (2, "short 123", "", 0, 0)], DOC)).count() == 0
