import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tracewell.__main__ import _parser, main
from tracewell.plans import packs, reports
from tracewell.sources import stores
from tracewell.sources import transcripts as tr


def message(kind, content, **more):
    return {"type": kind, "message": {"role": kind, "content": content}} | more


@pytest.fixture
def host(spark, tmp_path):
    """Two sessions, the later of which uses a skill, two skills, of which one is ours, and three proposals."""
    logs, skills = tmp_path / "logs", tmp_path / "skills"
    logs.mkdir()
    for k, said in enumerate(["wrong again", "py:Ship it"]):
        rows = [message("user", said, sessionId=f"s{k}", cwd="/w/app"), message("assistant", "x"), message("user", "y"), message("assistant", "z")]
        (logs / f"s{k}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        os.utime(logs / f"s{k}.jsonl", (k * 1000 + 1_700_000_000,) * 2)
    for name, ours in (("ship", True), ("other", False)):
        (skills / name).mkdir(parents=True)
        (skills / name / "SKILL.md").write_text(f"---\nname: {name}\n---\n")
        if ours:
            (skills / name / ".mark.json").write_text(json.dumps({"installed_by": "x", "installed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(1_700_000_500))}))
    drafts = spark.createDataFrame([(f"s{k}", f"---\ndescription: check tests of parsers {k}\n---\n# body {k}" if k < 2 else "# deploy", f"2026-01-0{k + 1}", 1, ["ship", "check", "deploy"][k]) for k in range(3)], "session_key string, md string, created_at string, format int, name string")
    stores.put_proposals(spark, drafts, str(tmp_path / "store"))
    return str(logs), str(skills), str(tmp_path / "store")


def test_feedback_counts_sessions_since_the_installation(spark, host):
    logs, skills, _ = host
    (r,) = reports.feedback(spark, skills, logs, options=reports.scan.Options(pack=reports.scan.PYTHON)).collect()
    assert (r.skill, r.sessions, r.used, r.usage_rate, r.friction_without, r.verdict) == ("ship", 1, 1, 1.0, None, "active") and r.friction_with < 0.1


def test_proposals_are_listed_shown_and_grouped(spark, host):
    _, skills, store = host
    rows = reports.proposals(spark, store, skills).collect()
    assert [(r["name"], r.installed) for r in rows] == [("deploy", False), ("check", False), ("ship", True)]
    assert "# deploy" in reports.show(spark, store, rows[0].id[:20])
    with pytest.raises(ValueError, match="no proposal"):
        reports.show(spark, store, "zzz")
    with pytest.raises(ValueError, match="several"):
        reports.show(spark, store, "")
    groups = reports.consolidation(spark, store).collect()
    assert [(r["size"], r.outcome, r.merged_from, r.session_ids) for r in groups] == [(2, "originals", ["ship", "check"], ["s0", "s1"]), (1, "kept", ["deploy"], ["s2"])]


def test_ordinary_reads_and_writes_never_lose_a_record(spark, tmp_path):
    store = tmp_path / "store"
    draft = lambda n, at, **more: spark.createDataFrame([(f"s{n}", f"# {n}", at, 1, f"n{n}")], "session_key string, md string, created_at string, format int, name string")
    for n in range(4):
        stores.put_proposals(spark, draft(n, f"2026-01-0{n + 1}"), str(store))
    (store / "new.json").write_text(json.dumps({"format": 9, "id": "future", "session_key": "s", "md": "later"}, indent=1))
    (store / "broken.json").write_text('{"format": 1, "id": "x')
    mixed = [{"format": 1, "id": "old-1", "session_key": "a", "md": "# a", "created_at": "2025-01-01"}, {"format": 9, "id": "future-2", "md": "kept\nas it is"}]
    (store / "mixed.json").write_text(json.dumps(mixed, indent=2))
    held = lambda: sorted(p.name for p in store.iterdir() if p.is_file())
    rows = stores.put_proposals(spark, draft(9, "2026-02-01"), str(store)).collect()
    assert [r["name"] or r.id for r in rows] == ["n9", "n3", "n2", "n1", "n0", "old-1"] and held() == ["broken.json", "mixed.json", "new.json"]
    # what is stored again is there once, as it was stored last
    again = stores.put_proposals(spark, draft(9, "2026-02-02"), str(store)).collect()
    assert [(r["name"], r.created_at) for r in again][:2] == [("n9", "2026-02-02"), ("n3", "2026-01-04")] and len(again) == 6
    # only what prune names goes, and from the files too
    kept = stores.prune_proposals(spark, str(store), 2).collect()
    assert [r["name"] for r in kept] == ["n9", "n3"] and held() == ["broken.json", "new.json"]
    raw = "".join(f.read_text() for f in store.rglob("*") if f.suffix in (".json", ".txt"))
    assert "future-2" in raw and "kept\\nas it is" in raw and '"later"' in raw and "old-1" not in raw and "# 0" not in raw and "# 3" in raw
    assert len(stores.prune_proposals(spark, str(store), 50).collect()) == 2


def test_a_write_that_dies_leaves_the_store_as_it_was(spark, tmp_path):
    store = str(tmp_path / "store")
    stores.put_proposals(spark, spark.createDataFrame([("s", "# a", "2026-01-01", 1)], "session_key string, md string, created_at string, format int"), store)
    boom = spark.createDataFrame([("t", "# b", "2026-01-02", 1)], "session_key string, md string, created_at string, format int").withColumn("name", F.raise_error(F.lit("died")).cast("string"))
    with pytest.raises(Exception, match="died"):
        stores.put_proposals(spark, boom, store)
    assert [r.session_key for r in stores.read_proposals(spark, store).collect()] == ["s"]


def test_merged_artifacts_have_to_pass_the_gate(spark, host):
    _, _, store = host
    outcomes = lambda merge, bar: [(r["size"], r.outcome, r.merged_from) for r in reports.consolidation(spark, store, merge=merge, bar=bar).collect()]
    weak = lambda rows: rows.groupBy("cluster").agg(F.lit("does stuff").alias("md"))
    alone = (1, "kept", ["deploy"])
    assert outcomes(weak, 0.99) == [(2, "originals", ["ship", "check"]), alone]
    assert outcomes(weak, 0.01) == [(2, "merged", ["ship", "check"]), alone]
    assert outcomes(lambda rows: rows.where("false").select("cluster", "md"), None) == [(2, "error", ["ship", "check"]), alone]
    assert [r.composite is None for r in reports.consolidation(spark, store).collect()] == [True, True]


def test_verbs_print(spark, host, capsys):
    logs, skills, store = host
    main(["scan", logs, "--pack", "python"])
    told = capsys.readouterr().out
    assert told.startswith("scope: all projects") and "2 sessions in 1 projects" in told
    main(["feedback", skills, logs, "--pack", "python"])
    assert "100%" in capsys.readouterr().out
    main(["proposals", store, "--json"])
    listed = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert [x["name"] for x in listed] == ["deploy", "check", "ship"] and listed[0]["eval"] == {"composite": None, "engine": None, "dimensions": {}} and listed[2]["source_sessions"] == ["s0"]
    main(["show", store, listed[0]["id"], "--json"])
    assert json.loads(capsys.readouterr().out)["md"] == "# deploy"
    main(["feedback", skills, logs, "--pack", "python", "--json"])
    assert json.loads(capsys.readouterr().out) | {"friction_with": 0} == {"skill": "ship", "installed_at": "2023-11-14T22:21:40Z", "sessions": 1, "sessions_used": 1, "usage_rate": 1.0, "friction_with": 0, "friction_without": None, "verdict": "active"}
    main(["scan", logs, "--pack", "python", "--json"])
    first = json.loads(capsys.readouterr().out.strip().split("\n")[0])
    assert first["counts"]["events"] == 4 and set(first["friction"]) == {"raw", "score", "rate", "dominant_signal", "signals"} and first["opportunity"]["missed"] == []
    main(["consolidate", store])
    main(["prune", store, "--keep", "1"])
    assert capsys.readouterr().out.strip().endswith("1 kept")
    assert _parser().parse_args(["show", "s", "i"]).id == "i"


def test_a_pack_is_read_from_a_folder(tmp_path):
    for name, text in {
        "x.adapter.json": '{"name": "x", "file_globs": ["**/*.x"]}', "detect/signatures.json": '{"fingerprints": [{"type": "review", "commands": ["gh"], "bonus": 1.5}], "skill_namespaces": ["x"]}',
        "laws/laws.json": json.dumps({"laws": [{"id": f"l{k}", "statement": "s"} for k in range(15)]}), "investigate/playbooks.json": json.dumps({"playbooks": [{"id": f"p{k}", "body": "b"} for k in range(10)]}),
        "eval/eval.json": '{"mode": "vendored", "dimensions": [{"name": "a", "weight": 2, "checks": [{"type": "line_count", "target": 3}]}]}',
        "templates/manifest.json": '{"templates": [{"file": "s.md", "produces": "skill"}, {"file": "../x.adapter.json", "produces": "stolen"}, {"file": "gone.md", "produces": "hook"}]}', "templates/s.md": "hi {{name}}",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    pack = packs.read_pack(str(tmp_path))
    assert pack.name == "x" and pack.namespaces == ("x",) and pack.templates == {"skill": "hi {{name}}"} and len(pack.opportunities) == 3
    assert [len(x) for x in pack.drafting()] == [12, 8]
    (tmp_path / "laws/laws.json").write_text('{"laws": [{"id": "a", "statement": "s"}, {"id": "a", "statement": ""}]}')
    (tmp_path / "eval/eval.json").write_text('{"mode": "odd", "dimensions": [{"name": "a", "checks": [{"type": "nothing"}]}]}')
    with pytest.raises(ValueError, match=r"laws\[0\].*laws\[1\].*mode is.*dimensions\[0\]"):
        packs.read_pack(str(tmp_path))
    (tmp_path / "laws/laws.json").write_text("[]")
    with pytest.raises(ValueError, match="mapping"):
        packs.read_pack(str(tmp_path))


def test_stamps_of_a_store_change_with_what_it_has_not_merged(spark, tmp_path):
    handles = spark.createDataFrame([("db#1", "1"), ("db#2", "2")], "handle string, _id string")
    (tmp_path / "x.db").write_text("a")
    (tmp_path / "x.db-wal").write_text("b")
    stamps = lambda: dict(tr.store_stamps(handles, tr.file_stamps(spark, str(tmp_path))).collect())
    before = stamps()
    assert before["db#1"] != before["db#2"] and before == stamps()
    (tmp_path / "x.db-wal").write_text("bb")
    assert stamps()["db#1"] != before["db#1"]


def test_session_stamps_of_a_cluster_need_a_shared_folder(spark):
    from tracewell.plans import session

    class Context:
        master = "spark://x"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())


def test_stamps_of_many_files_do_not_depend_on_their_order(spark):
    files = spark.createDataFrame([(f"f{k}", str(k)) for k in range(500)], "path string, stamp string")
    assert tr.fingerprint(files) == tr.fingerprint(files.orderBy(F.desc("path")).repartition(7)) != tr.fingerprint(files.where("path <> 'f3'"))
    assert tr.fingerprint(files.limit(0)).startswith("0:") and tr.fingerprint(files.union(files.limit(1))) != tr.fingerprint(files)


def test_a_relational_store_is_read_by_ranges_with_conditions(spark, tmp_path):
    """A database in this process: eight ranges, of numbers and of texts, and conditions that reach it."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    say = lambda k: json.dumps({"role": "user", "content": f"it's {k}"})
    sessions = spark.createDataFrame([(k, f"s{k}", f"/p{k}", "claude" if k % 2 else "codex") for k in range(40)], "id int, session_id string, project_path string, provider string")
    messages = spark.createDataFrame([(k, k % 40, "user", say(k), "u", None, None, 0, k) for k in range(800)], "id int, session_id int, type string, content string, uuid string, parent_uuid string, timestamp string, is_sidechain int, sequence int")
    types = {"createTableColumnTypes": "session_id VARCHAR(20), project_path VARCHAR(20), provider VARCHAR(20)"}
    sessions.coalesce(1).write.options(**types).jdbc(url, "sessions", properties=options)
    messages.coalesce(1).write.jdbc(url, "messages", properties=options)
    spark.createDataFrame([(f"m'{k:03d}", f"s{k % 3}", k, '{"role":"user"}') for k in range(90)], "id string, session_id string, time_created int, data string").coalesce(1).write.option("createTableColumnTypes", "id VARCHAR(20), session_id VARCHAR(20)").jdbc(url, "message", properties=options)
    part = lambda k: json.dumps({"type": "text", "text": "x" * (2000 if k == 1 else 5)})
    spark.createDataFrame([(f"p{k}", f"m'{k:03d}", k, part(k % 3)) for k in range(90)], "id string, message_id string, time_created int, data string").coalesce(1).write.option("createTableColumnTypes", "id VARCHAR(20), message_id VARCHAR(20)").jdbc(url, "part", properties=options)
    rows = tr.relation(spark, url, "message", "id", 8, **options)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.count() == 90 and rows.rdd.getNumPartitions() == 8 == len(sizes) and max(r["count"] for r in sizes) <= 30
    events = tr.read_store(spark, url, "index", parts=4, **options)
    assert events.count() == 400 and events.where("text = 'it''s 41'").count() == 1
    one = tr.read_store(spark, url, "index", session="s5", parts=4, **options)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 20 and "EqualTo(provider,claude)" in plan and "EqualTo(session_id,s5)" in plan and "numPartitions=4" in plan
    told = tr.read_store(spark, url, "opencode", parts=3, cap=1000, **options)
    assert {(r.path, r.err): r["count"] for r in told.groupBy("path", "err").count().collect()} == {("s0", None): 30, ("s1", "too_large"): 1, ("s2", None): 30}
    assert tr.ranges(rows.limit(0), "id", 4) == ["1 = 1"]


def test_a_scope_on_another_file_system(spark, tmp_path):
    from tracewell.operators import rank

    (tmp_path / "-w-app").mkdir()
    base = f"file://{tmp_path}"
    exists = rank.folder_exists(spark, local=lambda p: p == "/w/other/.git")
    assert rank.resolve_scope(base, "/w/app/src", exists=exists) == rank.Scope("/w/app", True, f"{base}/-w-app")
    assert rank.resolve_scope(base, "/w/other/src", exists=exists).reason == "unknown_cwd"
    (tmp_path / "-w-file").write_text("no folder")
    assert not exists(f"{base}/-w-file")
    assert spark.range(1).select(rank.project_folder_of("/base/", F.lit("/w/my.app"))).first()[0] == rank.project_folder("/base/", "/w/my.app")
