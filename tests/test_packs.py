import pytest

from tracewell.functions.template import fill, json_in
from tracewell.operators import rank
from tracewell.plans.packs import faults, pack_from


def test_templates():
    assert fill("a {{x}} {{#l}}<{{item}}>{{/l}}{{#t}}yes{{/t}}{{#f}}no{{/f}}{{y}}", {"x": 1, "l": ["p", "q"], "t": True, "f": []}) == "a 1 <p><q>yes"
    assert fill("{{#l}}{{n}}{{/l}}", {"l": [{"n": 1}, {"n": 2}]}) == "12"


def test_json_in_answers(spark):
    df = spark.createDataFrame([('text ```json\n{"a": {"b": 1}}\n``` more',), ("none",), ("{oops}",)], "t string").select(json_in("t").alias("v"))
    assert [r.b for r in df.selectExpr("try_variant_get(v, '$.a.b', 'int') AS b").collect()] == [1, None, None]


def test_packs():
    good = {"name": "x", "fingerprints": [{"type": "maintenance", "commands": ["npm i"], "bonus": 3}], "opportunities": [{"skill": "verify", "when": "commands", "commands": ["npm test"], "threshold": 3}], "globs": ["**/*.ts"]}
    assert pack_from(good).opportunities[0]["least"] and not faults({"name": "y"})
    bad = {"fingerprints": [{"type": 1}], "opportunities": [{"skill": "a", "when": "never"}, {"skill": "a", "when": "tool_count"}], "globs": [1]}
    assert len(faults(bad)) == 8
    with pytest.raises(ValueError, match="a threshold is needed"):
        pack_from(bad)


def test_scopes():
    there = {"/base/-w-app", "/w/app/.git"}
    narrowed = rank.resolve_scope("/base", "/w/app/src", exists=there.__contains__)
    assert (narrowed.root, narrowed.base, narrowed.narrowed) == ("/w/app", "/base/-w-app", True)
    lost = rank.resolve_scope("/base", "/w/other", exists=lambda p: p == "/w/other/.git")
    assert (lost.root, lost.reason) == ("/w/other", "unknown_cwd") and rank.resolve_scope("/base", "/w", everything=True) == rank.Scope()


def test_rules_that_the_driver_decides():
    from tracewell.operators import loop
    from tracewell.plans import packs, scan
    from tracewell.sources import transcripts as tr

    assert [rank.split_limit(7, *x) for x in ((False, False), (True, False), (True, True))] == [(7, None), (None, 7), (7, None)]
    assert [rank.clamp_limit(x) for x in (99, 0, None)] == [50, 1, 10] and [loop.clamp_rollouts(x) for x in (99, 0, None)] == [40, 1, 8]
    there = {"/base/-w-app", "/w/app/.git", "/x/.git"}.__contains__
    scopes = [rank.resolve_scope("/base", x, exists=there) for x in (None, "/w/app", "/w/app/lib/deep", "/x")]
    assert [(s.root, s.narrowed, s.reason) for s in scopes] == [(None, False, None), ("/w/app", True, None), ("/w/app", True, None), ("/x", False, "unknown_cwd")]
    assert rank.project_folder("/base/", "/w/my.app") == "/base/-w-my-app"
    assert len(packs.faults({"name": "", "fingerprints": [{"type": "x", "commands": ["a"]}], "opportunities": [{"skill": "s", "when": "never"}], "globs": [1]})) == 4
    assert [len(x) for x in scan.Pack(laws=tuple(range(20)), playbooks=tuple(range(20))).drafting()] == [12, 8]
    assert tr.split_handle("a#b.db#s", lambda p: False) == ("a#b.db", "s")
    with pytest.raises(ValueError, match="unknown format"):
        tr.source("nothing")


def test_whose_dimensions_judge():
    from tracewell.functions import constants as C  # noqa: N812
    from tracewell.operators import artifacts as A  # noqa: N812

    own = [{"name": "a", "weight": 0.5, "checks": [{"type": "line_count", "target": 5}]}, {"name": "b", "checks": []}]
    options = [([("x", 1.0, [])], {"mode": "vendored", "dimensions": own}), (None, {"mode": "vendored", "dimensions": own}), (None, {"mode": "vendored"}), (None, {"mode": "exec-in-place"}), (None, None)]
    found = [(engine, len(C.EVAL_SETS[dims] if isinstance(dims, str) else dims)) for dims, engine in (A.route(*o) for o in options)]
    assert found == [("native", 1), ("native", 2), ("native", 6), ("native:fallback", 6), ("native", 6)]
