import random

from pyspark.sql import functions as F

from tracewell.operators import edits as E


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_scripts_are_shortest_and_give_both_texts():
    rnd = random.Random(9)
    for _ in range(3000):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        steps = list(E.script(a, b))
        assert [x for o, x in steps if o != "ins"] == a and [x for o, x in steps if o != "del"] == b
        assert sum(o == "eq" for o, _ in steps) == common(a, b)
        assert not any(x[0] == "ins" and y[0] == "del" for x, y in zip(steps, steps[1:]))


def test_long_runs_of_equal_lines_collapse(spark):
    lines = [str(k) for k in range(40)]
    changed = [*lines[:10], "new", *lines[11:20], *lines[21:]]
    rows = spark.createDataFrame([(1, "\n".join(lines), "\n".join(changed)), (2, "same\n" * 9, "same\n" * 9), (3, None, "x"), (4, "a\nb", "a\nb"), (5, "a\n" * 7, "a\n" * 7 + "b")], "k int, old string, new string")
    told = {r.k: r.text.split("\n") for r in E.told(E.collapsed(E.line_diff(rows, "k", "old", "new"), "k"), "k").collect()}
    note = "  ⋯ {} unchanged lines".format
    assert told[1] == ["  0", "  1", "  2", note(4), "  7", "  8", "  9", "- 10", "+ new", "  11", "  12", "  13", note(3), "  17", "  18", "  19", "- 20", "  21", "  22", "  23", note(13), "  37", "  38", "  39"]
    assert told[2] == ["  same"] * 3 + [note(4)] + ["  same"] * 2 + ["  "]
    assert told[3] == ["- ", "+ x"] and told[4] == ["  a", "  b"] and told[5] == ["  a"] * 7 + ["- ", "+ b"]
    one = spark.createDataFrame([(1, "\n".join("a" * 8), "\n".join("a" * 8))], "k int, old string, new string")
    assert "  ⋯ 2 unchanged lines" in E.told(E.collapsed(E.line_diff(one, "k", "old", "new"), "k"), "k").first().text
    assert E.line_diff(one.limit(0), "k", "old", "new").count() == 0


def test_a_managed_block_is_kept_in_its_place(spark):
    at = lambda *columns: spark.range(1).select(*columns).first()
    body, other = F.lit("\n use $1 and \\2 \n"), F.lit("other")
    first = at(E.upserted(F.lit("# mine\n\n"), body))[0]
    assert first.startswith("# mine\n\n<!-- TRACEWELL:BEGIN sha256:") and first.endswith(" -->\nuse $1 and \\2\n<!-- TRACEWELL:END -->\n")
    assert at(E.upserted(F.lit(first), body))[0] == first
    around = "before\n" + first + "after\n"
    second = at(E.upserted(F.lit(around), other))[0]
    assert second.startswith("before\n# mine") and second.endswith("after\n") and "use $1" not in second and at(E.upserted(F.lit(second), body))[0] == around
    state = lambda text, b: tuple(at(E.has_block(F.lit(text)), E.in_sync(F.lit(text), b), E.tampered(F.lit(text)), E.block_body(F.lit(text))))
    assert state(first, body) == (True, True, False, "use $1 and \\2") and state(first, other) == (True, False, False, "use $1 and \\2")
    edited = first.replace("use", "never use")
    assert state(edited, body) == (True, False, True, "never use $1 and \\2") and at(E.upserted(F.lit(edited), body))[0] == first
    assert state("nothing", body) == (False, False, False, None)
    assert at(E.upserted(F.lit(""), other))[0] == at(E.upserted(F.lit(None).cast("string"), other))[0] == at(F.concat(E.managed(other), F.lit("\n")))[0]
    assert state("<!-- TRACEWELL:BEGIN sha256:ab -->\nno end", body) == (True, False, False, None)
