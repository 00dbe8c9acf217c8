import json
import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions.constants import STATUS_EXPLAINED
from tracewell.operators import rank
from tracewell.plans import scan
from tracewell.plans.session import cut
from tracewell.sources import transcripts as tr


def message(kind, content, **more):
    return {"type": kind, "message": {"role": kind, "content": content}} | more


def use(name, call_id, **arguments):
    return {"type": "tool_use", "id": call_id, "name": name, "input": arguments}


def done(call_id, bad=False):
    return {"type": "tool_result", "tool_use_id": call_id, "is_error": bad, "content": "ignored"}


FRICTION = [
    message("user", "fix what the nightly run broke", sessionId="s1", cwd="/work/app"),
    message("assistant", [{"type": "text", "text": "running"}, use("Bash", "a", command="mix test")]),
    message("user", [done("a", True)]),
    message("assistant", [use("Bash", "b", command="cd /work/app && mix test")]),
    message("user", [done("b", True)]),
    message("assistant", [use("Bash", "c", command="cd x; cd y && mix test")]),
    message("user", [done("c")]),
    message("user", "no, that's wrong"),
    message("user", "[Request interrupted by user]"),
    message("assistant", [use("Edit", "d", file_path="/work/app/lib/a.ex")]),
    message("user", "<system-reminder>stop, actually</system-reminder>"),
    {"type": "system", "subtype": "compact_boundary", "content": "Context compacted"},
]
SMOOTH = [message("user", "what is this project", sessionId="s2"), message("assistant", [use("Read", "r", file_path="README.md")]), message("assistant", "done"), message("user", "thanks")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("claude")
    write = lambda name, rows: (d / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    (d / "p").mkdir()
    write("p/friction.jsonl", FRICTION)
    write("p/smooth.jsonl", SMOOTH)
    write("broken.jsonl", [message("user", "hi", sessionId="s3"), "{oops", "", "[1]", message("user", 5), {"type": "user", "message": "no object"}, message("assistant", "yes"), message("user", "a"), message("user", "b")])
    write("copy.jsonl", [message("user", "sub", sessionId="s1"), message("assistant", "x")] * 2)
    return str(d)


@pytest.fixture(scope="module")
def facts(spark, folder):
    return cut(scan.session_facts(tr.read_events(spark, folder)))


def named(rows):
    return {r.path.rsplit("/", 1)[-1]: r for r in rows.collect()}


def test_session_facts(facts):
    got = named(scan.select_sessions(facts))
    r = got["friction.jsonl"]
    assert (r.tool_count, r.error_count, r.message_count, r.human_turns, r.parse_errors) == (4, 2, 11, 3, 0)
    assert (r.retry_loops, r.user_corrections, r.error_tool_ratio, r.approach_changes, r.context_compactions, r.interrupted_requests) == (1, 1, 0.5, 0, 1, 1)
    assert r.raw == 9.0 and r.dominant_signal == "retry_loops" and math.isclose(r.friction, 1 / (1 + math.exp(-3 * 7.5)))
    assert (r.session_id, r.cwd, r.file_paths) == ("s1", "/work/app", ["/work/app/lib/a.ex"])
    assert r.missed == [] and r.opportunity == 0.0
    smooth = got["smooth.jsonl"]
    assert smooth.raw == 0.0 and smooth.friction < 0.15 and smooth.dominant_signal is None and smooth.fingerprint == "exploration"
    assert "copy.jsonl" not in got and got["broken.jsonl"].parse_errors == 2


def test_options(facts):
    pick = lambda **o: set(named(scan.select_sessions(facts, scan.Options(**o))))
    assert "copy.jsonl" in pick(dedupe=False)
    assert pick(scope=rank.Scope("/work/app")) == {"friction.jsonl"}
    assert pick(min_messages=5) == {"friction.jsonl", "broken.jsonl"}
    assert set(named(facts.where(scan.ELIXIR.matches(F.col("file_paths"))))) == {"friction.jsonl"}
    assert rank.split_limit(5, True, False) == (None, 5) and rank.split_limit(5, False, False) == (5, None) and rank.clamp_limit(99) == 50


def test_whole_scan_with_a_pack(spark, folder):
    r = named(scan.scan(tr.read_events(spark, folder), scan.Options(pack=scan.ELIXIR, limit=50)))["friction.jsonl"]
    assert r.missed == ["verify"] and r.opportunity == 0.2


def test_sinks(facts):
    rows = scan.select_sessions(facts)
    assert scan.render(rows).split("\n")[2].split()[1:3] == ["s1", "9.00"]
    loaded = [json.loads(r.json) for r in scan.as_json(rows).collect()]
    assert loaded[0]["signals"]["retry_loops"] == 1 and loaded[-1]["max_ctx_pct"] is None
    assert "evidence" not in json.dumps([r.asDict(True) for r in scan.summary(rows).collect()])


def test_hazards_and_context(spark, tmp_path):
    big = {"model": "claude-opus-4-5-20250101", "usage": {"input_tokens": 100_000, "cache_read_input_tokens": 50_000}}
    rows = [message("user", "go", sessionId="h")] + [
        {"type": "assistant", "message": {"role": "assistant", "content": [use("Bash", str(i), command=c)]} | big}
        for i, c in enumerate(["mix test | tail -5; echo $?", "mix test |\n head", "set -o pipefail; pytest | cat", "mix test > log; git log | head", "pytest \\\n | tail"])
    ]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, rows)))
    r = named(scan.session_facts(tr.read_events(spark, str(tmp_path))))["h.jsonl"]
    assert [(h.kind, h["count"]) for h in r.hazards] == [("pipe_masks_exit", 2)] and r.hazards[0].evidence.endswith(STATUS_EXPLAINED)
    assert r.max_ctx_pct == 75.0 and r.raw == 0.0


def test_codex(spark, tmp_path):
    line = lambda t, **p: json.dumps({"timestamp": "2026-01-02T03:04:05Z", "type": t, "payload": p})
    (tmp_path / "c.jsonl").write_text("\n".join([
        line("session_meta", id="cx", cwd="/w"), line("event_msg", type="user_message", message="hello"), line("event_msg", type="token_count", info=None),
        line("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 50}, "model_context_window": 200}),
        line("response_item", type="function_call", name="exec_command", arguments=json.dumps({"cmd": "ls"}), call_id="1"), line("response_item", type="function_call_output", call_id="1", output="Process exited with code 2"),
        line("response_item", type="custom_tool_call", name="apply_patch", input="*** Begin\n*** Add File: a.py\n*** Update File: b.py\n", call_id="2"),
        line("response_item", type="custom_tool_call_output", call_id="2", output=json.dumps({"metadata": {"exit_code": 0}, "output": "x failed: y"})),
        line("response_item", type="function_call_output", call_id="3", output="exec failed: no"), line("other", type="x"),
    ]))
    rows = tr.read_events(spark, str(tmp_path), "codex").orderBy("seq").collect()
    assert {r.session_id for r in rows} == {"cx"} and [r.type for r in rows] == ["other", "user", "other", "other", "assistant", "user", "assistant", "user", "user", "other"]
    assert rows[3].usage.prompt_tokens == 50 and rows[2].usage is None and rows[4].tool_uses[0].command == "ls"
    assert [(u.name, u.file_path, u.id) for u in rows[6].tool_uses] == [("Edit", "a.py", "2#0"), ("Edit", "b.py", "2#1")]
    assert [r.tool_results[0].is_error for r in rows if r.tool_results] == [True, False, True]
    fact = scan.session_facts(tr.read_events(spark, str(tmp_path), "codex")).first()
    assert fact.max_ctx_pct == 25.0 and fact.error_count == 2


def test_cline_gemini(spark, tmp_path):
    task = tmp_path / "tasks" / "task-1"
    task.mkdir(parents=True)
    (task / "api_conversation_history.json").write_text(json.dumps([
        {"role": "user", "content": "do it"}, {"role": "assistant", "content": [use("execute_command", "1", command="ls"), use("replace_in_file", "2", path="a.ts")]}, {"role": "user", "content": [done("1", True)]}, 7,
    ]))
    rows = tr.read_events(spark, str(tmp_path), "cline").orderBy("seq").collect()
    assert [r.session_id for r in rows][0] == "task-1" and [(u.name, u.command, u.file_path) for u in rows[1].tool_uses] == [("Bash", "ls", None), ("Edit", None, "a.ts")]
    assert rows[2].tool_results[0].is_error and rows[3].err == "not_an_object"
    assert tr.cline(tr.cline_files(spark, str(tmp_path), cap=10)).first().err == "too_large"
    g = tmp_path / "g"
    g.mkdir()
    messages = [
        {"role": "user", "parts": [{"text": "hi"}]}, {"type": "gemini", "content": "yes", "toolCalls": [{"id": "1", "name": "run_shell_command", "args": {"command": "ls"}, "status": "error"}]},
        {"role": "model", "parts": [{"functionCall": {"id": "2", "name": "replace", "args": {"absolute_path": "/x.py"}}}]}, {"role": "user", "parts": [{"functionResponse": {"id": "2", "response": {"error": "bad"}}}]},
    ]
    (g / "session-a.json").write_text(json.dumps({"sessionId": "ga", "messages": messages}))
    (g / "bare.json").write_text(json.dumps(messages[:1]))
    (g / "lines.jsonl").write_text("\n".join([json.dumps({"messages": messages[:1]}), "oops", json.dumps({"session_id": "gl", "messages": messages[:2]})]))
    (g / "odd.json").write_text("{}")
    rows = tr.read_events(spark, str(g), "gemini").orderBy("path", "seq").collect()
    by = {n: [r for r in rows if r.path.endswith(n)] for n in ("session-a.json", "bare.json", "lines.jsonl", "odd.json")}
    a = by["session-a.json"]
    assert [r.type for r in a] == ["user", "assistant", "assistant", "user"] and a[0].session_id == "ga" and [r.text for r in a[:2]] == ["hi", "yes"]
    assert a[1].tool_uses[0].command == "ls" and a[1].tool_results[0].is_error and a[2].tool_uses[0].file_path == "/x.py" and a[3].tool_results[0].is_error
    assert by["bare.json"][0].session_id == "bare" and [r.session_id for r in by["lines.jsonl"]] == ["gl", "gl"] and by["odd.json"][0].err == "unexpected_shape"


def test_relational_stores(spark):
    m = spark.createDataFrame([("m1", "s", 1, '{"role":"user"}'), ("m2", "s", 2, '{"role":"assistant"}'), ("m3", "s", 3, '{"role":"user"}')], "id string, session_id string, time_created long, data string")
    p = spark.createDataFrame([
        ("p1", "m1", "s", 1, '{"type":"text","text":"hi"}'), ("p3", "m2", "s", 3, '{"type":"patch","files":["a.py","b.py"]}'),
        ("p2", "m2", "s", 2, '{"type":"tool","tool":"bash","callID":"c","state":{"status":"error","input":{"command":"ls"}}}'), ("p4", "m2", "s", 4, "oops"),
    ], "id string, message_id string, session_id string, time_created long, data string")
    rows = tr.opencode(m, p).orderBy("seq").collect()
    assert rows[0].text == "hi" and [(u.name, u.command, u.file_path, u.id) for u in rows[1].tool_uses] == [("Bash", "ls", None, "c"), ("Edit", None, "a.py", None), ("Edit", None, "b.py", None)]
    assert rows[1].tool_results[0].is_error and rows[2].text is None
    s = spark.createDataFrame([(1, "sid", "/p", "claude"), (2, "x", "/p", "codex")], "id long, session_id string, project_path string, provider string")
    messages = spark.createDataFrame([
        (2, 1, "assistant", '{"role":"assistant","content":[{"type":"text","text":"two"}]}', "u2", None, "2026-01-01T00:00:00Z", 0, 2), (1, 1, "user", '{"role":"user","content":"one"}', "u1", None, None, 1, 1), (3, 1, "user", "", "u3", None, None, 0, 3), (4, 2, "user", "{}", "u4", None, None, 0, 1),
    ], "id long, session_id long, type string, content string, uuid string, parent_uuid string, timestamp string, is_sidechain int, sequence long")
    rows = tr.claude(tr.session_index(s, messages)).orderBy("seq").collect()
    assert [(r.type, r.text, r.session_id, r.err) for r in rows] == [("user", "one", "sid", None), ("assistant", "two", "sid", None), (None, None, None, "unparseable_content")]


def test_registry():
    with pytest.raises(ValueError, match="unknown format"):
        tr.read_events(None, "x", "nothing")
    assert tr.split_handle("a.db#b#c", lambda p: False) == ("a.db#b", "c") and tr.split_handle("a#b", lambda p: True) == ("a#b", None)


def test_a_file_beyond_the_cap_is_never_opened(spark, tmp_path):
    """One of 3 GiB, which no reader of whole files could hold, stands beside a small one."""
    (tmp_path / "small.json").write_text('{"messages": [{"role": "user", "content": "é"}]}')
    with (tmp_path / "large.json").open("wb") as f:
        f.truncate(3 << 30)
    rows = {r.path.rsplit("/", 1)[1]: (r.value, r.err) for r in tr.read_files(spark, str(tmp_path), "*.json").collect()}
    assert rows == {"small.json": ('{"messages": [{"role": "user", "content": "é"}]}', None), "large.json": (None, "too_large")}
    plan = tr.read_files(spark, str(tmp_path), "*.json")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan
    events = tr.read_events(spark, str(tmp_path), "gemini").select("text", "err").collect()
    assert sorted((r.text, r.err) for r in events if r.err is None) == [("é", None)] and [r.err for r in events if r.err] == ["too_large"]


def test_only_changed_files_are_scored_again(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from tracewell.plans import rescan as R  # noqa: N812

    logs, store, read = tmp_path / "logs", str(tmp_path / "store"), []
    monkeypatch.setattr(R, "changed_events", lambda spark, path, fmt, keys, real=R.changed_events: read.append(sorted(r.key.rsplit("/", 1)[1] for r in keys.collect())) or real(spark, path, fmt, keys))
    logs.mkdir()
    write = lambda k, n: (logs / f"s {k}.jsonl").write_text("\n".join(json.dumps(message("user" if i % 2 == 0 else "assistant", f"wrong {i}", sessionId=f"s{k}", cwd="/w")) for i in range(n)))
    for k in range(4):
        write(k, 5 + k)
    now = datetime(2026, 1, 1)
    run = lambda day: R.rescan(spark, str(logs), store, now=now + timedelta(days=day))
    counts = lambda rows: {r.session_id: (r.message_count, r.human_turns) for r in rows.collect()}
    first, n = run(0)
    want = {f"s{k}": (5 + k, (6 + k) // 2) for k in range(4)}
    assert n == 4 and counts(first) == want == counts(scan.session_facts(tr.read_events(spark, str(logs))))
    again, n = run(1)
    assert n == 0 and counts(again) == want and set(again.columns) == set(first.columns)
    write(2, 20)
    write(4, 3)
    later, n = run(2)
    assert n == 2 and counts(later) == want | {"s2": (20, 10), "s4": (3, 2)} and read == [[f"s%20{k}.jsonl" for k in range(4)], [], ["s%202.jsonl", "s%204.jsonl"]]
    monkeypatch.setattr(R, "NAMED", 0)
    assert run(40)[1] == 5  # not seen for 30 days
    assert R.rescan(spark, str(logs), store, pack=scan.PYTHON, now=now + timedelta(days=41))[1] == 5  # other rules
