import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import artifacts, classify, loop, rank, relate, signals, similar
from tracewell.plans.session import cut
from tracewell.sources import stores
from tracewell.streaming.incremental import Store, tool_counts


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def calls(spark, seed=1, sessions=30):
    rnd = random.Random(seed)
    out = []
    for s in range(sessions):
        for i in range(rnd.randrange(1, 45)):
            out.append((s, i, rnd.choice(["a", "a", "b", "  ", None, "cd x && a", "cd 'y z'; a"]), rnd.random() < 0.3, rnd.choice(["Read", "Edit", "Bash"])))
    return rows(spark, out, "session int, i int, command string, bad boolean, name string"), out


def test_retry_loops_match_a_walk(spark):
    df, data = calls(spark)
    want = {}
    for s in {r[0] for r in data}:
        run, found = [], 0
        keyed = [(c.replace("cd x && ", "").replace("cd 'y z'; ", ""), bad) for q, _, c, bad, _ in data if q == s and c and c.strip()]
        for k, (c, bad) in enumerate(keyed):
            run = run + [bad] if run and keyed[k - 1][0] == c else [bad]
            if (k + 1 == len(keyed) or keyed[k + 1][0] != c) and len(run) >= 3 and any(run):
                found += 1
        if keyed:
            want[s] = found
    assert dict(signals.retry_loops(df, "session", ["i"], "command", "bad").collect()) == want


def test_approach_changes_match_a_walk(spark):
    df, data = calls(spark, 2)
    want = {}
    for s in {r[0] for r in data}:
        names = [r[4] for r in data if r[0] == s]
        size = max(len(names) // 4, 5)
        chunks = [names[k : k + size] for k in range(0, len(names), size)]
        lead = [max(dict.fromkeys(c), key=lambda n: (c.count(n), -c.index(n))) for c in chunks]
        want[s] = sum(a != b for a, b in zip(lead, lead[1:])) if len(names) >= 10 else 0
    assert dict(signals.approach_changes(df, "session", ["i"], "name").collect()) == want


@pytest.mark.parametrize("n,most", [(1, 1), (7, 3), (50, 49), (64, 10), (10, 0), (10, 99)])
def test_even_spread(spark, n, most):
    got = sorted(r.k for r in rank.even_spread(rows(spark, [(i,) for i in range(n)], "k int"), ["k"], most).collect())
    assert got == (sorted({i * n // most for i in range(most)}) if 0 < most < n else list(range(n)))


def test_ratchet_and_weakest(spark):
    rnd = random.Random(4)
    data = [(s, i, round(rnd.random() * 0.97, 3)) for s in range(20) for i in range(rnd.randrange(1, 60))]
    got = {r.s: tuple(r)[1:] for r in loop.ratchet_by(rows(spark, data, "s int, i int, x double"), "s", ["i"], "x", margin=0.05, patience=6, most=30).collect()}
    for s in range(20):
        best, kept, out, it, status = 0.0, 0, 0, 0, "running"
        for x in [x for q, _, x in data if q == s] + [None]:
            status = "complete" if best >= 0.95 or it >= 30 else "stuck" if out >= 6 else "running"
            if status != "running" or x is None:
                break
            it += 1
            best, kept, out = (x, kept + 1, 0) if x > best + 0.05 else (best, kept, out + 1)
        assert got[s] == (best, kept, out, it, status)


def test_greedy_clusters_are_first_fit(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice("xy"), " ".join(rnd.sample(["red", "blue", "green", "black", "white", "grey"], 3))) for i in range(60)]
    df = rows(spark, data, "id int, kind string, name string").withColumn("tokens", T.word_tokens("name"))
    pairs = similar.similar_pairs(df, "id", "kind", "tokens", 0.5)
    got = {r.id: r.cluster for r in similar.greedy_clusters(df, pairs, "id", "kind").collect()}
    clusters = {}
    for i, kind, name in data:
        a = set(name.split())
        own = next((c for c, m in clusters.items() if m[0][0] == kind and any(len(a & t) / len(a | t) >= 0.5 for _, t in m)), i)
        clusters.setdefault(own, []).append((kind, a))
        assert got[i] == own


GOOD = """---
name: deploy-check
description: "Verify releases before they ship. Use when a deploy is near and checks must run."
---

# Deploy check

## Usage
Run `make check` first.
- **Check** the log at /var/log/app.log

## Iron Laws
1. Never skip tests
2. Always read the log
3. Stop on errors

## Examples
```bash
make check
make deploy --dry-run
```

## Anti-patterns
Never `rm -rf /` anything.

## References
See references/guide.md and [[other-skill]], and `code-reviewer`.
"""
BAD = GOOD.replace("Run `make check` first.", "sudo rm -rf / now")
HOOK = "#!/bin/bash\n# jq is great\nx=$(cat) # read\necho \"# no comment\"\n"


def test_skill_scores_and_vetoes(spark):
    df = rows(spark, [("good", GOOD), ("bad", BAD), ("empty", ""), ("null", None)], "k string, md string")
    got = {r.k: r for r in artifacts.score(df, "md").collect()}
    good = got["good"]
    assert good.composite == 1.0 and good.passed and not good.vetoed
    assert got["bad"].vetoed and not got["bad"].passed and got["bad"].composite >= 0.75 and got["bad"].dim_safety == 0.5
    assert not got["empty"].passed and got["null"].composite == got["empty"].composite
    full = artifacts.score(df.where("k = 'good'"), "md", "full", {"known_files": ["x/guide.md"], "known_skills": ["missing"], "known_agents": ["code-reviewer"]}).first()
    assert full.dim_accuracy == 0.6667


def test_hook_scores(spark):
    df = rows(spark, [(1, HOOK), (2, HOOK.replace("$(cat)", "1")), (3, HOOK + "rm -rf \\\n /"), (4, HOOK + "\u200b"), (5, HOOK[1:])], "k int, sh string")
    got = {r.k: (r.composite, r.vetoed, r.passed) for r in artifacts.score(df, "sh", "hook", {"event": "PreToolUse", "matcher": "Bash", "known_events": ["PreToolUse"]}, kind="hook").collect()}
    assert got == {1: (1.0, False, True), 2: (0.85, False, False), 3: (0.6, True, False), 4: (1.0, True, False), 5: (0.85, False, False)}
    assert spark.range(1).select(artifacts.code(F.lit("a # b\n'# c' \"#\" \\# d#e\n#x\nf \\\n  g"))).first()[0] == "a\n'# c' \"#\" \\# d#e\nf  g"
    checks = {n: artifacts.check(n, artifacts.Artifact.of("sh"), p) for n, p in (("unknown", {}), ("content_present", {"pattern": "("}), ("hook_pointer", {}), ("description_no_vague", {"forbidden": [42]}))}
    assert not any(df.select(*checks.values()).first())


def test_sections_and_fields(spark):
    md = "---\nname: 'x'\nname: y\nlist:\n - z\n---\n\n\npre\n##Not\n## One\na\n\n### Two \nb\nc\n"
    a = artifacts.Artifact.of("md")
    r = rows(spark, [(md,)], "md string").select(a.field("name").alias("n"), a.field("none").alias("m"), a.headings.alias("h"), artifacts.max_section_lines(a, {"max": 1}).alias("one"), artifacts.max_section_lines(a, {"max": 2}).alias("two"), a.body.alias("b")).first()
    assert (r.n, r.m, r.h, r.one, r.two) == ("y", None, ["One", "Two"], False, True) and r.b.startswith("pre\n")


def test_text_functions(spark):
    data = [("éstop it",), ("nonstop",), ("no, thanks",), ("no",), ("I said so",), ("x" * 499 + " wrong",), (None,)]
    got = [r[0] for r in rows(spark, data, "t string").select(T.is_correction("t")).collect()]
    assert got == [True, False, True, False, True, False, False]
    one = rows(spark, [("a/b.c/.x", "phx:Plan then ecto:/q", "<system-reminder>a</x></system-reminder> <command-args>keep</command-args>")], "p string, s string, h string")
    r = one.select(T.extension("p").alias("e"), T.namespaced("s", ["phx"]).alias("n"), T.collapse(T.without_harness("h")).alias("h"), T.short_name(F.lit("a:b:/c")).alias("k"), T.one_line(F.lit("a\n\u200bb")).alias("o")).first()
    assert (r.e, r.n, r.h, r.k, r.o) == ("", ["Plan"], "<command-args>keep</command-args>", "c", "a b")
    import re

    for glob, path, fits in [("**/*.ex", "lib/a.ex", True), ("*.{ts,tsx}", "/w/a.tsx", True), ("src/**/x?.py", "src/a/b/x1.py", True), ("src/*.py", "src/a/b.py", False), ("a.b", "axb", False)]:
        assert bool(re.search(T.glob_pattern(glob), path)) == fits


def test_ties(spark):
    r = rows(spark, [(1,)], "x int").select(signals.dominant_signal({k: F.lit(1.0 if k in ("error_tool_ratio", "approach_changes") else 0) for k in signals.WEIGHTS}).alias("d")).first()
    assert r.d == "error_tool_ratio"
    kind, share = classify.fingerprint({"bug-fix": F.lit(2.0), "feature": F.lit(2.0)})
    assert tuple(rows(spark, [(1,)], "x int").select(kind, share).first()) == ("bug-fix", 0.5)
    pct = [("claude-opus-4-5", 190_000, 95.0), ("claude-opus-4-8[1m]", 366_745, 36.7), ("claude-opus-4-5-20250101", 150_000, 75.0), ("claude-opus-4-7", 1_500_000, 100.0), ("unknown", 5, None)]
    got = rows(spark, pct, "m string, p long, want double").select("want", F.when(classify.message_window("m", "p").isNotNull(), classify.context_percent("p", classify.message_window("m", "p"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_confusion_counts_errors_as_wrong(spark):
    df = rows(spark, [(True, True), (True, None), (False, None), (False, True)], "e boolean, a boolean")
    r = relate.confusion(df, F.col("e"), F.col("a")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.precision, r.recall) == (1, 1, 1, 1, 0.25, 0.5, 0.5)
    r = relate.confusion(df.where("false"), F.col("e"), F.col("a")).first()
    assert r.precision == 1.0 and r.recall == 1.0


def test_stores(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jsonl").write_text('{"iteration":1,"kept":true}\nnot json\n{"format":9,"iteration":2}\n{"format":1,"iteration":3}\n')
    assert sorted(r.iteration for r in stores.read_journal(spark, str(tmp_path / "j")).collect()) == [1, 3]
    p = tmp_path / "p"
    p.mkdir()
    (p / "1.json").write_text(json.dumps({"id": "a1", "name": "n", "md": "#!/bin/sh", "created_at": "2026-01-01", "session_key": "s", "format": 1}))
    (p / "2.json").write_text(json.dumps({"id": "a2", "name": "n", "md": "# x", "created_at": "2026-02-01", "session_key": "s", "format": 3, "kind": "skill"}))
    (p / "3.json").write_text("{")
    got = stores.read_proposals(spark, str(p))
    assert [(r.id, r.kind) for r in got.collect()] == [("a2", "skill"), ("a1", "hook")] and stores.find(got, "a") == ["a1", "a2"]
    s = rows(spark, [("s",), ("t",)], "session_key string")
    assert sorted((r.session_key, r.id or "") for r in stores.latest_for(s, got).collect()) == [("s", "a2"), ("t", "")]
    skill = tmp_path / "skills" / "one"
    skill.mkdir(parents=True)
    (skill / "SKILL.md").write_text("---\ndescription: d\n---\nx")
    (skill / ".mark.json").write_text(json.dumps({"installed_by": "t", "installed_at": "2026-01-01T00:00:00Z", "skill_sha256": "0"}))
    r = stores.installed_skills(spark, str(tmp_path / "skills")).first()
    assert (r.skill, r.description, r.ours, r.drifted) == ("one", "d", True, True)


def test_incremental_store(spark, tmp_path):
    now = datetime(2026, 1, 1)
    store = Store(spark, str(tmp_path / "c"))
    current = rows(spark, [("a", "1", 5), ("b", "1", 6)], "key string, stamp string, v int")
    compute = lambda df: df.select("key", (F.col("v") * 2).alias("twice"))
    assert store.run(current, "v1", compute, now)[1] == 2
    changed = rows(spark, [("a", "1", 50), ("b", "2", 7)], "key string, stamp string, v int")
    out, n = store.run(changed, "v1", compute, now)
    assert n == 1 and sorted((r.key, r.twice) for r in out.collect()) == [("a", 10), ("b", 14)]
    assert store.run(changed, "v2", compute, now)[1] == 2 and store.run(changed, "v2", compute, datetime(2026, 3, 1))[1] == 2


def test_stream_equals_batch(spark, tmp_path):
    from tracewell.streaming.incremental import stream_sessions

    data = [(i % 3, float(i * 10), datetime(2026, 1, 1, 0, i)) for i in range(20)]
    events = rows(spark, data, "user_id int, value double, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, stream_sessions(spark, str(tmp_path)).collect())) == sorted(map(tuple, tool_counts(events).collect()))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from tracewell.streaming.incremental import stream_counts

    events = rows(spark, [(i % 3, float(i * 10), datetime(2026, 1, 1, 0, i)) for i in range(12)], "user_id int, value double, ts timestamp")
    source = str(tmp_path / "in")
    run = lambda: stream_counts(spark, spark.readStream.schema(events.schema).parquet(source), str(tmp_path / "out"))
    events.where("value < 60").write.parquet(source)
    assert sum(r.tool_count for r in run().collect()) == 6
    events.where("value >= 60").write.mode("append").parquet(source)
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, tool_counts(events).collect()))


def folded(order, links):
    """Greedy clusters, row by row: each row joins the oldest cluster that holds a linked one."""
    of, opened = {}, []
    for row in order:
        known = [of[x] for x in links.get(row, ()) if x in of]
        of[row] = min(known, key=opened.index) if known else row
        if of[row] == row:
            opened.append(row)
    return of


def test_greedy_clusters_in_rounds_equal_the_fold(spark):
    import random

    from tracewell.operators import similar

    rnd = random.Random(3)
    for dense in (0.5, 1.0, 2.5):
        rows = [(i, "ab"[i % 2], rnd.randint(0, 20)) for i in range(160)]
        pairs = [(k, a, b) for k in "ab" for a, b in [rnd.sample([r[0] for r in rows if r[1] == k], 2) for _ in range(int(80 * dense))]]
        pairs = sorted({(k, min(a, b), max(a, b)) for k, a, b in pairs})
        near = {}
        for _, a, b in pairs:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        df, links = spark.createDataFrame(rows, "id int, kind string, made int"), spark.createDataFrame(pairs, "kind string, a int, b int")
        by_key = {r.id: r.cluster for r in similar.greedy_clusters(df, links, "id", "kind").collect()}
        assert by_key == folded([r[0] for r in rows], near)
        by_time = {r.id: r.cluster for r in similar.greedy_clusters(df, links, "id", "kind", ("made",)).collect()}
        assert by_time == folded([r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))], near)
    assert similar.greedy_clusters(df.limit(0), links.limit(0), "id", "kind").count() == 0


def test_clusters_from_fewer_pairs_are_the_same(spark):
    """Copies, sets that differ by words of their own, sets whose like don't link with one another, empty ones: pairs between classes give the clusters of all pairs."""
    import random

    from tracewell.operators import similar

    rnd = random.Random(5)
    for least in (0.3, 0.5, 0.8):
        rows = []
        for i in range(240):
            words = rnd.sample("abcdefgh", rnd.randint(0, 4)) + [f"own{i}-{j}" for j in range(rnd.choice([0, 0, 1, 2]))]
            rows.append((f"r{i:03}", "xy"[i % 2], rnd.randint(0, 40), words))
        df = spark.createDataFrame(rows, "id string, kind string, made int, tokens array<string>")
        near, every = {}, set()
        for a in rows:
            for b in rows:
                x, y = set(a[3]), set(b[3])
                if a[0] != b[0] and a[1] == b[1] and x | y and len(x & y) / len(x | y) >= least:
                    near.setdefault(a[0], []).append(b[0])
                    every.add((a[0], b[0]))
        pairs = cut(similar.reaching_pairs(df, "id", "kind", "tokens", least, ("made",)))
        assert {(r.a, r.b) for r in pairs.collect()} <= every
        out = {r.id: r.cluster for r in similar.greedy_clusters(df, pairs, "id", "kind", ("made",)).collect()}
        assert out == folded([r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))], near)


def test_copies_need_pairs_in_proportion_to_their_number(spark):
    from tracewell.operators import similar

    rows = spark.range(3000).select("id", F.lit("k").alias("kind"), F.array(F.lit("alpha"), F.lit("beta"), F.concat(F.lit("own"), (F.col("id") % 1500).cast("string"))).alias("tokens"))
    pairs = cut(similar.reaching_pairs(rows.withColumn("tokens", F.slice("tokens", 1, F.when(F.col("id") < 1500, 3).otherwise(2))), "id", "kind", "tokens", 0.5))
    assert 0 < pairs.count() < 4 * 3000  # all pairs are four and a half million


def test_greedy_clusters_of_one_large_kind(spark):
    """100,000 rows of one kind: chains of 500 rows, each linked with the one before, and groups that all link with one row."""
    from tracewell.operators import similar

    n = 100_000
    rows = spark.range(n).select("id", F.lit("k").alias("kind"))
    chains = spark.range(n).where("id < 50000 AND id % 500 <> 0").select(F.lit("k").alias("kind"), (F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    stars = spark.range(n).where("id >= 50000 AND id % 1000 <> 0").select(F.lit("k").alias("kind"), (F.col("id") - F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
    out = similar.greedy_clusters(rows, chains.unionByName(stars), "id", "kind")
    wrong = out.where(F.col("cluster") != F.when(F.col("id") < 50000, F.col("id") - F.col("id") % 500).otherwise(F.col("id") - F.col("id") % 1000))
    assert out.count() == n and wrong.isEmpty()


def scanned(line):
    """A shell line without its comment, sign by sign."""
    quote, k = "", 0
    while k < len(line):
        sign = line[k]
        if quote:
            quote = "" if sign == quote else quote
        elif sign == "\\":
            k += 1
        elif sign in "'\"":
            quote = sign
        elif sign == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
        k += 1
    return line


def test_comments_of_100_000_random_lines(spark):
    import random

    rnd = random.Random(11)
    lines = ["".join(rnd.choice("ab#'\"\\ \t#é") for _ in range(rnd.randint(0, 14))) for _ in range(100_000)]
    lines += ["x " * 50_000 + "'q' " * 50_000 + "# gone", "'" * 9 + " # kept", "\\", "# all"]
    rows = spark.createDataFrame([(i, x, scanned(x)) for i, x in enumerate(lines)], "i int, line string, wanted string")
    got = rows.select("i", "line", "wanted", artifacts.without_comment(F.col("line")).alias("got"))
    assert got.where("got <> wanted").limit(3).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sessions_after_an_installation_equal_the_join(spark):
    from datetime import datetime, timedelta

    from tracewell.operators import relate

    at = lambda h: None if h is None else datetime(2026, 1, 1) + timedelta(hours=h)
    skills = spark.createDataFrame([("a", at(0)), ("b", at(5)), ("c", at(5)), ("d", at(99)), ("e", None)], "skill string, installed timestamp")
    sessions = spark.createDataFrame([(at(h),) for h in [None] * 40 + [5] * 50 + list(range(12))], "time timestamp")
    joined = skills.join(sessions, relate.after_install(F.col("time"), F.col("installed")), "left").groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    assert dict(relate.sessions_after(skills, sessions, "skill", "installed", "time").collect()) == dict(joined.collect())
