import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

from tracewell.sources import datasource as ds
from tracewell.sources import transcripts as tr


def claude_line(role, text, session):
    return json.dumps({"type": role, "message": {"role": role, "content": text}, "sessionId": session}, ensure_ascii=False)


@pytest.fixture
def logs(tmp_path):
    """Three projects of four sessions; blank, broken and long lines; hidden files."""
    for p in range(3):
        (tmp_path / f"p{p}").mkdir()
        for s in range(4):
            lines = [claude_line("user" if k % 2 == 0 else "assistant", f"turn {k} é" * (1 if k else 300), f"s{s}") for k in range(9)]
            lines[3:3] = ["", "   ", "{oops"]
            file = tmp_path / f"p{p}" / f"s{s} x.jsonl"
            file.write_text("\n".join(lines) + ("\n" if s % 2 else ""))
            os.utime(file, (1_700_000_000 + 1000 * s,) * 2)
    (tmp_path / "p0" / "_hidden.jsonl").write_text(claude_line("user", "no", "x"))
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "a.jsonl").write_text(claude_line("user", "no", "x"))
    return tmp_path


def same(a, b):
    key = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())
    return key(a) == key(b.select(*a.columns))


@pytest.mark.parametrize("split", [ds.SPLIT, 700, 37])
def test_events_equal_those_of_the_reader_of_files(spark, logs, split):
    want = tr.read_events(spark, str(logs)).where(~F.col("path").contains("hidden"))
    assert same(want, ds.events(spark, str(logs), split=split)) and want.count() == 3 * 4 * 10


def test_only_matching_files_are_listed_and_opened(spark, logs, monkeypatch):
    opened = []
    monkeypatch.setattr(ds, "opened", lambda path, inner, real=ds.opened: opened.append(path.rsplit("/", 2)[1:]) or real(path, inner))

    def read(*filters, **options):
        opened.clear()
        reader = ds.Transcripts({"path": str(logs), **options}).reader(None)
        left = list(reader.pushFilters(list(filters)))
        rows = sum(batch.num_rows for piece in reader.partitions() for batch in reader.read(piece))
        return left, rows, sorted({tuple(x) for x in opened})

    assert read(EqualTo(("project",), "p1"), EqualTo(("session",), "s2 x")) == ([], 10, [("p1", "s2%20x.jsonl")])
    assert read(In(("project",), ("p0", "none")), Not(StringStartsWith(("session",), "s0")))[1:] == (30, [("p0", f"s{s}%20x.jsonl") for s in (1, 2, 3)])
    assert read(GreaterThan(("modified",), datetime.fromtimestamp(1_700_002_500, timezone.utc)))[1:] == (30, [(f"p{p}", "s3%20x.jsonl") for p in range(3)])
    kept = [EqualTo(("value",), "x"), IsNull(("path",))]
    assert read(*kept, EqualTo(("size",), -1)) == (kept, 0, [])


def test_filters_reach_the_source(spark, logs):
    rows = ds.register(spark).read.format("transcripts").load(str(logs)).where("project = 'p2' AND session IN ('s1 x', 's3 x') AND size > 10 AND value LIKE '%turn 8%'")
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "BatchScan" in x)
    assert "project" not in plan.replace(scan, "").split("Filter")[-1] or "isnotnull(project" in plan
    later = F.col("modified") > F.lit(datetime.fromtimestamp(1_700_001_500, timezone.utc))
    assert same(tr.read_events(spark, str(logs)).where(F.col("path").rlike("p1/s[23]")), ds.events(spark, str(logs), only=later & (F.col("project") == "p1")))


def test_long_files_are_cut_and_whole_files_capped(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("\n".join(claude_line("user", "x" * n, "s") for n in range(0, 3000, 7)))
    rows = ds.register(spark).read.format("transcripts").option("split", 10_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20 and rows.count() == 429 and rows.select("offset").distinct().count() == 429
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "small.json").write_text('[{"role": "user", "content": "é"}]')
    with (whole / "large.json").open("wb") as f:
        f.truncate(3 << 30)
    assert same(tr.read_events(spark, str(whole), "gemini"), ds.events(spark, str(whole), "gemini"))
    reader = ds.Transcripts({"path": str(whole), "kind": "gemini"}).reader(None)
    assert [len(p.ranges) for p in reader.partitions()] == [2]


def test_an_empty_folder_and_an_unknown_kind(spark, tmp_path):
    assert ds.events(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        ds.register(spark).read.format("transcripts").option("kind", "none").load(str(tmp_path)).count()
