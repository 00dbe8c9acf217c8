import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import toxicity as tox
from tracewell.llm._spark import fold

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("dense", [0.05, 0.3, 2.0])
def test_block_max_search_is_exact(dense):
    rnd = np.random.default_rng(3)
    x = (rnd.random((300, 60)) < rnd.random(60) ** 3) * rnd.choice([0.5, 1.0, 2.0, 3.5], (300, 60))
    x[7] = 0
    example, term = np.nonzero(x)
    index = tox.Index(example, term, x[example, term], len(x), x.shape[1], block=8, dense=dense)
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    for queries, skip in ((x, np.arange(300)), (rnd.permuted(x, axis=1)[:100], None)):
        q, t = np.nonzero(queries)
        got = index.nearest(q, t, queries[q, t], len(queries), 7, skip)
        cosines = np.round(queries / np.maximum(np.sqrt((queries * queries).sum(1, keepdims=True)), 1e-300) @ unit.T, 9)
        if skip is not None:
            np.fill_diagonal(cosines, 0)
        for near, c in zip(got, cosines, strict=True):
            want = sorted([(s, e) for e, s in enumerate(c.tolist()) if s > 0], key=lambda p: (-p[0], p[1]))[:7]
            assert [s for s, _ in near] == pytest.approx([s for s, _ in want], abs=2e-9)
            assert all(c[e] == pytest.approx(s, abs=2e-9) for s, e in near)


def corpus(spark, n=400):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        said = [rnd.choice("abcdefghij") * rnd.randint(2, 5) for _ in range(30)] + ["Vilest" + rnd.choice("aeiou")] * bad
        rnd.shuffle(said)
        rows.append((i, " ".join(said), "en", "s", 0, "clash"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", "s", 0, ""), (1001, "", "en", "s", 0, ""), (1002, "vilestx " * 60_000, "en", "s", 0, ""), (1002, "vilestx", "en", "s", 0, ""), (None, "aa", "en", "s", 0, "")]
    labels += [(3, 1, None), (None, 1, 1), (5000, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def terms_of(text):
    out = Counter()
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)):
        raw = w.encode()
        out[("word", raw)] += 1
        for n in (4, 5, 6):
            if len(raw) > n:
                out[(n, raw[:n])] += 1
    return out


def brute(rows, labels):
    """Scores, and what distinguishes neighbours, by plain loops over all pairs."""
    marked = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            marked[i] = max(marked.get(i, 0), y)
    shares = [sum(y == k for y in marked.values()) for k in (0, 1)]
    texts = {}
    for i, text in rows:
        if i in marked:
            low, y = texts.get(text or "", (i, 0))
            texts[text or ""] = min(low, i), max(y, marked[i])
    ids, y = [i for i, _ in texts.values()], [y for _, y in texts.values()]
    vectors = [terms_of(t) for t in texts]
    every, bad = Counter(t for v in vectors for t in v), Counter(t for v, k in zip(vectors, y) for t in v if k)
    df = Counter(t for _, text in rows for t in terms_of(text))
    share, n = sum(y) / len(y), len(every)
    weight = {}
    for t, e in every.items():
        b, p = bad[t], bad[t] / e
        g = (b * math.log(p / share) if b else 0) + ((e - b) * math.log((1 - p) / (1 - share)) if b < e else 0)
        weight[t] = math.log((len(rows) + 1) / (df[t] + 0.5) + 1) * (max(g, 0) / (max(g, 0) + math.log(n / 0.01))) ** 2

    def unit(counts):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in counts.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    index = [unit(v) for v in vectors]

    def share_of(v, skip=None):
        near = sorted(((sum(x * w.get(t, 0) for t, x in v.items()), e) for e, w in enumerate(index) if e != skip), reverse=True)[:15]
        near = [(s, e) for s, e in near if round(s, 9) > 0]
        prior = (shares[1] + 0.5) / (sum(shares) + 1.5)
        return (sum(s for s, e in near if y[e]) + 0.05 * prior) / (sum(s for s, _ in near) + 0.05), [ids[e] for _, e in near]

    own = [share_of(v, e)[0] for e, v in enumerate(index)]
    each = np.array([shares[k] / max(y.count(k), 1) for k in y])
    x = [math.log(min(max(s, 1e-6), 1 - 1e-6) / (1 - min(max(s, 1e-6), 1 - 1e-6))) for s in own]
    good, a, b = sum(y), 1.0, 0.0
    target = [(good + 1) / (good + 2) if k else 1 / (len(y) - good + 2) for k in y]
    for _ in range(20_000):  # plain gradient steps on the same penalised loss
        p = [1 / (1 + math.exp(-(a * xi + b))) for xi in x]
        ga = sum(w * (pi - ti) * xi for w, pi, ti, xi in zip(each, p, target, x)) + 1e-3 * (a - 1)
        gb = sum(w * (pi - ti) for w, pi, ti in zip(each, p, target)) + 1e-3 * b
        a, b = a - 0.05 * ga / len(y), b - 0.2 * gb / len(y)
    out = {}
    for i, text in rows:
        s, near = share_of(unit(terms_of(text)))
        s = min(max(s, 1e-6), 1 - 1e-6)
        out[(i, text)] = 1 / (1 + math.exp(-(a * math.log(s / (1 - s)) + b))), near
    return out


def test_scores_and_evidence_match_brute_force(spark):
    rnd = random.Random(21)
    say = lambda: [rnd.choice("bcdfgklmnprst") + rnd.choice("aeiouä") * rnd.randint(1, 3) + rnd.choice("bcdfgklmnprst") * rnd.randint(1, 4) for _ in range(rnd.randint(6, 40))]
    rows, labels = [], []
    for i in range(200):
        bad = rnd.random() < 0.3
        text = say() + [rnd.choice(["Rotten", "rottener", "VILE", "Scoundrels"]) for _ in range(rnd.randint(1, 2))] * bad
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad != (rnd.random() < 0.05))))
    rows += [(500, None), (501, ""), (7, rows[9][1]), (502, rows[11][1])]
    want = brute(rows, labels)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], DOC)
    got = tox.score_documents(docs, spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")).join(docs.select("doc_id", "text").distinct().withColumnRenamed("doc_id", "_i"), F.col("doc_id") == F.col("_i")).collect()
    assert {(r.doc_id, r.text) for r in got} == set(want)
    singles = Counter(i for i, _ in rows)
    for r in got:
        if singles[r.doc_id] == 1:
            score, near = want[(r.doc_id, r.text)]
            assert r.score == pytest.approx(score, abs=2e-3), r
            assert abs(score - 0.5) < 5e-3 or r.predicted == (score >= 0.5)
            assert set(r.evidence) == set(near[: len(r.evidence)])


def test_held_out_documents_are_told_apart(spark):
    docs, labels, rows = corpus(spark)
    got = tox.score_documents(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        want = r.doc_id == 1002 or (r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 5 == 0)
        assert r.predicted == want, r
        if want and r.doc_id < 1000:
            assert all(e % 5 == 0 and zlib.crc32(str(e).encode()) % 5 for e in r.evidence)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((str(r.doc_id), r.score) for r in df.collect())
    assert key(tox.score_documents(docs, labels)) == key(tox.score_documents(docs, flipped))


def test_clean_documents_stay_with_all_their_columns(spark):
    docs, labels, rows = corpus(spark)
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in tox.score_documents(docs, labels).collect() if r.predicted}
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where(F.col("doc_id").isNull() | ~F.col("doc_id").isin(*bad)).collect()))


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(spark, 20)
    assert all(r.predicted == 0 for r in tox.score_documents(docs, labels.limit(0)).collect())
    assert tox.score_documents(docs.limit(0), labels).collect() == []
    assert tox.drop_toxic(docs.limit(0), labels).collect() == []
