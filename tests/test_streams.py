import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.operators import signals
from tracewell.sources.transcripts import forward_fill
from tracewell.streaming import sessions, stateful
from tracewell.streaming.incremental import Store


def written(spark, tmp_path, parts=4):
    """Calls of some sessions in files that follow one another in time, and all of them as one table."""
    rnd = random.Random(5)
    rows = [(i % 7, i, rnd.choice(["a", "a", "b", None]), rnd.random() < 0.4, i if rnd.random() < 0.2 else None) for i in range(600)]
    schema = "session int, i int, command string, bad boolean, mark int"
    for k in range(parts):
        spark.createDataFrame(rows[k * 150 : (k + 1) * 150], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, schema), stream


def test_state_carries_over_batches(spark, tmp_path):
    every, stream = written(spark, tmp_path)
    loops = stateful.gathered(spark, stateful.retry_loops(stream, "session", ["i"], "command", "bad"), "update", "session")
    assert dict(loops.collect()) == dict(signals.retry_loops(every, "session", ["i"], "command", "bad").collect())


def test_values_are_filled_forward_over_batches(spark, tmp_path):
    every, stream = written(spark, tmp_path)
    got = stateful.gathered(spark, stateful.filled_forward(stream, "session", ["i"], "mark", "since"), "append", "session")
    want = forward_fill(every, "session", ["i"], "mark", "since")
    key = lambda df: sorted((r.i, r.since) for r in df.collect())
    assert key(got.select("i", "since")) == key(want.select("i", "since"))


def test_a_warm_run_writes_keys_and_compaction_keeps_results(spark, tmp_path):
    now = datetime(2026, 1, 2)
    rows = spark.createDataFrame([(str(k), "a", k) for k in range(50)], "key string, stamp string, n int")
    compute = lambda df: df.select("key", (F.col("n") * 2).alias("twice"))
    store = Store(spark, str(tmp_path / "c"))
    assert store.run(rows, "1", compute, now)[1] == 50 and store.run(rows, "1", compute, now)[1] == 0
    assert len(list((tmp_path / "c" / "runs").iterdir())) == 1 and len(list((tmp_path / "c" / "seen").iterdir())) == 1
    changed = rows.withColumn("stamp", F.when(F.col("n") < 5, "b").otherwise("a"))
    out, n = store.run(changed, "1", compute, now)
    assert n == 5 and sorted(r.twice for r in out.collect()) == [2 * k for k in range(50)]
    store.compact(datetime(2026, 1, 3))
    assert len(list((tmp_path / "c" / "runs").iterdir())) == 1 and store.run(changed, "1", compute, now)[1] == 0
    # A run that died leaves a folder without a mark, which nobody reads.
    store.add(out.withColumn("twice", F.lit(-1)).withColumn("last_seen", F.lit(datetime(2026, 1, 9))))
    newest = max((tmp_path / "c" / "runs").iterdir(), key=lambda p: p.stat().st_mtime)
    (newest / "_SUCCESS").unlink()
    assert store.load(now).where("twice < 0").isEmpty()
    # What has not been seen for long is computed again.
    assert store.run(changed, "1", compute, datetime(2026, 9, 1))[1] == 50


def in_parts(spark, rows, folder, at, bounds, closing):
    """Rows in files that follow one another in time, and a last row without key that moves the watermark."""
    parts = [rows.where(F.col(at).between(a, b - 1)) for a, b in zip([0, *bounds], [*bounds, 1 << 40])]
    for part in [*parts, closing]:
        part.coalesce(1).write.mode("append").parquet(folder)


def test_sessions_are_told_when_they_end(spark, tmp_path):
    from datetime import timedelta

    from tracewell.operators.signals import approach_changes, errored_calls, retry_loops
    from tracewell.streaming import sessions

    rnd, rows = random.Random(8), []
    for s in range(12):
        ids = []
        for seq in range(rnd.choice([3, 30, 61])):
            calls = [(rnd.choice(["Bash", "Bash", "Read", "Edit"]), rnd.choice(["a", "a", "a", "b", None]), f"c{s}-{seq}-{k}" if rnd.random() < 0.9 else None) for k in range(rnd.choice([0, 1, 1, 2]))]
            calls = [(n, c if n == "Bash" else None, i) for n, c, i in calls]
            ids += [i for _, _, i in calls if i]
            results = [(rnd.choice(ids), rnd.random() < 0.4)] if ids and rnd.random() < 0.6 else []
            rows.append((f"s{s}", seq, bool(seq % 2), rnd.random() < 0.5, False, rnd.random() < 0.1, rnd.random() < 0.1, calls, results))
    schema = "session_key string, seq long, message boolean, human boolean, corrected boolean, interrupted boolean, compacted boolean, calls array<struct<name: string, command: string, id: string>>, results array<struct<id: string, bad: boolean>>"
    events = spark.createDataFrame(rows, schema).select("session_key", "seq", F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("at"), "message", "human", "corrected", "interrupted", "compacted", "calls", "results")
    closing = events.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "at" else F.timestamp_seconds(F.lit(1_800_000_000)).alias("at") for f in events.schema])
    in_parts(spark, events, str(tmp_path / "in"), "seq", [7, 20, 41], closing)
    session = sessions.stateful_session(spark)
    stream = session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.session_key: r for r in stateful.drained(spark, sessions.friction(stream, timedelta(days=1)), "append", str(tmp_path / "out")).collect()}
    calls = events.select("session_key", "seq", F.posexplode("calls").alias("pos", "c")).select("session_key", "seq", "pos", "c.*")
    results = events.select("session_key", F.explode("results").alias("r")).select("session_key", F.col("r.id").alias("id"), F.col("r.bad").alias("is_error"))
    flagged = errored_calls(calls, results, "session_key", "id", "is_error")
    loops = dict(retry_loops(flagged.where("name = 'Bash'"), "session_key", ["seq", "pos"], "command", "errored").collect())
    changed = dict(approach_changes(calls, "session_key", ["seq", "pos"], "name").collect())
    assert len(got) == 12 and any(loops.values()) and any(changed.values())
    for s, r in got.items():
        own = [x for x in rows if x[0] == s]
        assert (r.retry_loops, r.approach_changes) == (loops.get(s, 0), changed.get(s, 0))
        assert (r.message_count, r.human_turns, r.interrupted_requests, r.context_compactions) == tuple(sum(x[k] for x in own) for k in (2, 3, 5, 6))
        assert (r.tool_count, r.error_count) == (sum(len(x[7]) for x in own), sum(b for x in own for _, b in x[8]))


def test_what_is_not_seen_for_long_is_forgotten(spark, tmp_path):
    from tracewell.streaming import sessions

    day = 86_400
    seen = [("h", "a", "1", 0), ("h", "b", "1", 1), ("h", "a", "1", 20), ("h", "a", "2", 21), ("h", "b", "1", 45), ("h", "c", "1", 46), ("g", "a", "1", 46), ("h", "a", "2", 60), ("h", "c", "1", 70)]
    rows = spark.createDataFrame([(h, s, x, d, 1_700_000_000 + d * day) for h, s, x, d in seen], "host string, source string, stamp string, day long, sec long").withColumn("at", F.timestamp_seconds("sec")).drop("sec")
    closing = rows.limit(1).select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("stamp"), F.lit(None).cast("long").alias("day"), F.timestamp_seconds(F.lit(1_700_000_000 + 95 * day)).alias("at"))
    in_parts(spark, rows, str(tmp_path / "in"), "day", [10, 40, 46, 65], closing)
    stream = sessions.stateful_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("day")
    told = stateful.drained(spark, sessions.aged_stamps(stream, 30), "append", str(tmp_path / "out")).collect()
    days = lambda r: (int(r.at.timestamp()) - 1_700_000_000) // day
    assert sorted((r.host, r.source, days(r), r.decision) for r in told if r.decision != "forgotten") == sorted(
        [("h", "a", 0, "computed"), ("h", "b", 1, "computed"), ("h", "a", 20, "reused"), ("h", "a", 21, "computed"), ("h", "b", 45, "computed"), ("h", "c", 46, "computed"), ("g", "a", 46, "computed"), ("h", "a", 60, "computed"), ("h", "c", 70, "reused")]
    )
    assert {("h", "b", 45), ("g", "a", 46), ("h", "a", 60)} <= {(r.host, r.source, days(r)) for r in told if r.decision == "forgotten"}
    assert ("h", "c", 70) not in {(r.host, r.source, days(r)) for r in told if r.decision == "forgotten"}


def test_time_to_live_by_the_clock(spark, tmp_path):
    import time

    from tracewell.streaming import sessions

    schema = "host string, source string, stamp string, at timestamp"
    session = sessions.stateful_session(spark, by_clock=True)
    seen = []
    for wait, days in ((0, 1.0), (0, 1.0), (0, 3 / 86_400), (4, 3 / 86_400)):
        time.sleep(wait)
        folder = str(tmp_path / f"in{days}")
        spark.createDataFrame([("h", "a", "1", datetime(2026, 1, 1))], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = session.readStream.schema(schema).parquet(folder)
        rows = stateful.drained(spark, sessions.aged_stamps(stream, days, by_clock=True), "append", str(tmp_path / f"out{days}")).orderBy(F.desc("_batch"))
        seen.append(rows.first().decision)
    assert seen == ["computed", "reused", "computed", "computed"]


def test_a_batch_reads_and_writes_each_source_once():
    """Calls to the state are in proportion to sources, not to rows; one timer stands for all sources and forgets each when it is due."""
    from pyspark.sql import Row

    calls, state, timers = [], {}, []

    class Seen:
        def getValue(self, key):  # noqa: N802
            calls.append("get")
            return state.get(key)

        def updateValue(self, key, value):  # noqa: N802
            calls.append("update")
            state[key] = value

        def removeKey(self, key):  # noqa: N802
            del state[key]

        def iterator(self):
            return iter(list(state.items()))

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Seen()

        def registerTimer(self, at):  # noqa: N802
            timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    aging = sessions.Aging(1, False)
    aging.init(Handle())
    start, day = datetime(2024, 1, 1), 86_400_000
    rows = [Row(host="h", source="ab"[k % 2], stamp="s", at=start + timedelta(hours=k)) for k in range(20)]
    out = list(aging.handleInputRows(("h",), iter(rows), None))
    assert [r.decision for r in out] == ["computed"] * 2 + ["reused"] * 18
    assert sorted(calls) == ["get"] * 2 + ["update"] * 2 and len(timers) == 1
    last = {k[0]: v[1] for k, v in state.items()}
    assert timers == [last["a"] + day + 1]
    assert [(r.source, r.decision) for r in aging.handleExpiredTimer(("h",), Now(timers[-1]), Now(timers[-1]))] == [("a", "forgotten")]
    assert timers[1:] == [last["b"] + day + 1]
    assert [r.source for r in aging.handleExpiredTimer(("h",), Now(timers[-1]), Now(timers[-1]))] == ["b"] and not state and len(timers) == 2
