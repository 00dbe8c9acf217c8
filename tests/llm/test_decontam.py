import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontam
from tracewell.llm._text import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    out = []
    windows = []
    for item, text in items:
        w = tokens(text)
        n = min(10, len(w))
        windows += [(str(item), w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    for doc, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def case(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, item_id string, spans string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(str, map(tuple, decontam.report(decontam.find_items(d, b)).collect())))


def random_case():
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(["a", "B", "é", "c1", "D"]) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 3, 9, 10, 11, 14, 25]))) for i in range(30)] + [(30, None), (31, ""), (3, say(12)), (32, "!!")]
    docs = [(i, say(rnd.randrange(40))) for i in range(60)]
    docs += [(100 + i, say(7) + "-" + t.upper() + "." + say(5)) for i, t in items if t] + [(200, None), (201, ""), (1, docs[1][1]), (202, say(9) + " " + items[6][1] * 40)]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = random_case()
    assert case(spark, docs, items) == sorted(map(str, brute(docs, items)))


def test_items_beyond_what_is_broadcast_are_joined(spark, monkeypatch):
    docs, items = random_case()
    monkeypatch.setattr(decontam, "PART_BYTES", 300)
    assert case(spark, docs, items) == sorted(map(str, brute(docs, items)))
    assert case(spark, [(1, "a b")], [(k, "! " * 200) for k in range(3)]) == [str((1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False))]
    assert case(spark, [], items) == []


@pytest.mark.parametrize("most", [300, 8 << 20])
def test_clean_documents_stay_with_all_their_columns(spark, monkeypatch, most):
    docs, items = random_case()
    monkeypatch.setattr(decontam, "PART_BYTES", most)
    d = spark.createDataFrame([(i, t, "clash", [k]) for k, (i, t) in enumerate(docs)], "doc_id long, text string, items string, spans array<int>")
    kept = decontam.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(r.spans[0] for r in kept.collect()) == [k for k, b in enumerate(brute(docs, items)) if not b[-1]]


def test_equal_hashes_are_told_apart():
    w, v = (words(pa.array([t]), "alnum") for t in ("aa Bb cc aa", "AA bb xx"))
    w.hashes[:] = 7
    v.hashes[:] = 7
    start, first, n = (np.array(x) for x in ([0, 3, 1, 2], [0, 0, 1, 2], [2, 1, 2, 1]))
    assert decontam.same_words(w, start, v, first, n).tolist() == [True, True, False, False]


def test_no_items_and_no_documents(spark):
    assert case(spark, [(1, "a b")], []) == [str((1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False))]
    assert case(spark, [], [(1, "a b")]) == []
