"""Queries over readers of files, over further shapes of the dialects, over scopes and JSON.

Transcripts are written from the tables to the session's shared folder and read by path, as a scan does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .catalogue import _called, _files, _lines, _summed, _tool, query
from .catalogue_scan import FACTS_SQL, facts
from .catalogue_stores import _folder
from .operators import loop, rank
from .plans import scan, shapes
from .plans.rescan import rescan
from .plans.session import cut, table
from .sources import datasource
from .sources import transcripts as tr

_KIND = "CASE WHEN turn % 7 = 5 THEN 'undecodable' WHEN turn % 7 = 6 THEN 'not_an_object' END"


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS lines, count(*) FILTER (WHERE {_KIND} = 'undecodable') AS undecodable, count(*) FILTER (WHERE {_KIND} = 'not_an_object') AS no_object,
  CAST(coalesce(sum(length(text)) FILTER (WHERE {_KIND} IS NULL), 0) AS BIGINT) AS chars, string_agg(CASE WHEN {_KIND} IS NULL THEN role ELSE 'odd' END, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def read_line_files(spark, d):
    """Line files with blank lines, broken ones and ones that are no object, in file order."""
    rows = table(spark, d, "conversations")
    good = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.col("conv_id").cast("string").alias("sessionId")))
    line = F.when(F.col("turn") % 7 == 5, F.concat(F.substring(good, 1, 15), F.lit("\n"))).when(F.col("turn") % 7 == 6, "[1]").otherwise(F.concat(good, F.lit("\n  ")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    with _folder(spark) as folder:
        rows.groupBy("conv_id").agg(whole.alias("value")).repartition("conv_id").write.partitionBy("conv_id").text(folder)
        fs = spark._jvm.org.apache.hadoop.fs
        files = fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.globStatus(fs.Path(f"{folder}/*/*.txt")):  # a file for each conversation, named as transcripts are
            files.rename(status.getPath(), fs.Path(status.getPath().toString().replace(".txt", ".jsonl")))
        events = tr.read_events(spark, folder, "claude").withColumn("session", F.regexp_extract("path", r"conv_id=(\d+)", 1))
        roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("err").isNull(), F.col("type")).otherwise("odd").alias("r")))), lambda x: x["r"]), ",")
        named = lambda e: F.count_if(F.col("err") == e)
        return cut(events.groupBy("session").agg(F.count(F.lit(1)).alias("lines"), named("undecodable").alias("undecodable"), named("not_an_object").alias("no_object"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), roles.alias("roles")))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'too_large' WHEN n_nationkey % 3 = 1 THEN 'unexpected_shape' END AS err, CASE WHEN n_nationkey % 3 = 2 THEN n_name END AS text FROM nation")
def read_capped_files(spark, d):
    """Whole-file transcripts: some beyond the cap, some of another shape."""
    rows = table(spark, d, "nation")
    k = F.col("n_nationkey")
    fine = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("n_name").alias("content"))))
    with _folder(spark) as folder:
        text = F.when(k % 3 == 0, F.concat(fine, F.repeat(F.lit(" "), F.lit(500)))).when(k % 3 == 1, "{}").otherwise(fine)
        rows.select(k.alias("k"), text.alias("value")).repartition("k").write.partitionBy("k").text(folder)
        files = tr.read_files(spark, folder, "*.txt", cap=300)
        return cut(tr.cline(tr.cline_rows(files)).select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("k"), "err", "text"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS events, count(*) FILTER (WHERE role = 'user') AS users, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations GROUP BY conv_id""")
def data_source_events(spark, d):
    """Transcripts through the data source, long files in ranges of bytes."""
    return _through_source(spark, d, None)


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS events, count(*) FILTER (WHERE role = 'user') AS users, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations WHERE conv_id % 7 IN (1, 4) GROUP BY conv_id""")
def data_source_projects(spark, d):
    """Transcripts of two projects: a filter on the file's folder, which reaches the source, so that no other file is opened."""
    return _through_source(spark, d, F.col("project").isin("project=1", "project=4"))


def _through_source(spark, d, only):
    rows = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.col("conv_id").cast("string").alias("sessionId")))
    with _folder(spark) as folder:
        lines = rows.select((F.col("conv_id") % 7).alias("project"), "conv_id", "turn", line.alias("value")).repartition("conv_id").sortWithinPartitions("project", "conv_id", "turn")
        lines.select("project", "value").write.partitionBy("project").text(folder)
        events = datasource.events(spark, folder, only=only, glob="*.txt", split=1 << 20)
        roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role"))), lambda x: x["role"]), ",")
        out = events.groupBy(F.col("session_id").alias("session")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("role") == "user").alias("users"), F.sum(F.length("text")).alias("chars"), roles.alias("roles"))
        return cut(out)


_SHAPE = "event_id % 6"


@query(f"""SELECT CAST(user_id AS VARCHAR) AS session, 'c' || event_id AS id, CASE {_SHAPE} WHEN 0 THEN 'WriteStdin' WHEN 1 THEN 'Read' WHEN 2 THEN 'other_tool' WHEN 3 THEN 'CustomTool' WHEN 4 THEN 'UnknownTool' END AS name,
  CASE {_SHAPE} WHEN 1 THEN 'a.png' WHEN 2 THEN 'f.py' END AS file_path, CASE {_SHAPE} WHEN 3 THEN value > 60 ELSE value > 80 END AS errored FROM events WHERE {_SHAPE} < 5""")
def parse_dialect_b_tools(spark, d):
    """Every name a call of dialect B may have, its own argument names, and output that says it failed."""
    rows = table(spark, d, "events")
    k, call_id = F.col("event_id") % 6, F.concat(F.lit("c"), F.col("event_id").cast("string"))
    kind = F.when(k == 3, "custom_tool_call").when(k == 5, "reasoning").otherwise("function_call")
    name = F.when(k == 0, "write_stdin").when(k == 1, "view_image").when(k == 2, "other_tool")
    arguments = F.when(k == 1, '{"path": "a.png"}').when(k == 2, '{"file_path": "f.py"}').when(k == 4, "{oops").otherwise("{}")
    use = F.struct(kind.alias("type"), name.alias("name"), arguments.alias("arguments"), call_id.alias("call_id"))
    out = F.when(k == 3, F.when(F.col("value") > 60, "apply failed: x").otherwise("ok")).otherwise(F.when(F.col("value") > 80, "a SandboxDenied").otherwise("Process exited with code 0"))
    done = F.struct(F.when(k == 3, "custom_tool_call_output").when(k == 5, "reasoning").otherwise("function_call_output").alias("type"), call_id.alias("call_id"), out.alias("output"))
    line = lambda payload, n: _lines(rows, "user_id", F.col("event_id") * 2 + n, F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    return _called(tr.codex(line(use, 0).unionByName(line(done, 1)))).select("session", "id", "name", "file_path", "errored")


@query("""SELECT CASE user_id % 3 WHEN 0 THEN 'own' || user_id WHEN 1 THEN 'f' || user_id ELSE 'line' || user_id END AS session, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS bash, count(*) FILTER (WHERE event_type = 'view') AS reads,
  count(*) FILTER (WHERE value > 60) AS errors FROM events GROUP BY user_id""")
def parse_dialect_d_parts(spark, d):
    """Calls and answers in the parts of a message, in files of all three forms: an object, a bare list, lines of which the last with messages counts."""
    name = _tool("run_shell_command", "read_file")
    call = F.struct(F.struct(F.col("event_id").cast("string").alias("id"), name.alias("name"), F.struct(F.col("props").alias("command")).alias("args")).alias("functionCall"), F.lit(None).cast("struct<id: string, response: struct<error: string>>").alias("functionResponse"))
    answer = F.struct(F.lit(None).cast("struct<id: string, name: string, args: struct<command: string>>").alias("functionCall"), F.struct(F.col("event_id").cast("string").alias("id"), F.struct(F.when(F.col("value") > 60, "bad").alias("error")).alias("response")).alias("functionResponse"))
    files = _files(table(spark, d, "events"), F.struct(F.lit("model").alias("role"), F.array(call, answer).alias("parts")))
    user = F.regexp_extract("path", r"/t(\d+)/", 1)
    value = (
        F.when(user.cast("int") % 3 == 0, F.concat(F.lit('{"sessionId": "own'), user, F.lit('", "messages": '), "value", F.lit("}"))).when(user.cast("int") % 3 == 1, F.col("value"))
        .otherwise(F.concat(F.lit('{"messages": []}\n{oops\n{"session_id": "line'), user, F.lit('", "messages": '), "value", F.lit("}")))
    )
    return _summed(tr.gemini(tr.gemini_rows(files.select(F.concat(F.lit("/chats/f"), user, F.lit(".json")).alias("path"), value.alias("value"), "err"))))


@query(f"SELECT session, raw, retry_loops, CASE WHEN dominant_signal IS NULL THEN 'null' ELSE dominant_signal END AS dominant_signal, tool_count FROM ({FACTS_SQL}) WHERE message_count >= 4")
def scan_json(spark, d):
    """The JSON of a scan, read again: signals are nested and what is unknown is there as null."""
    text = scan.as_json(scan.select_sessions(facts(spark, d), scan.Options(pack=scan.PYTHON)))
    v = text.select(F.parse_json("json").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    unknown = F.when(F.is_variant_null(get("$.dominant_signal", "variant")), "null")
    return v.select(get("$.session_id", "string").alias("session"), F.round(get("$.raw", "double"), 6).alias("raw"), get("$.signals.retry_loops", "long").alias("retry_loops"), F.coalesce(get("$.dominant_signal", "string"), unknown).alias("dominant_signal"), get("$.tool_count", "long").alias("tool_count"))


@query("SELECT doc_id, lang AS own, CASE WHEN source IN ('src0', 'src1', 'src2') THEN upper(source) END AS fixtures FROM documents")
def pinned_fixtures(spark, d):
    """Candidates are judged by their seed's fixtures, whatever they bring."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("own"), F.col("lang").alias("fixtures"))
    seeds = spark.createDataFrame([(f"src{k}", f"SRC{k}") for k in range(3)], "source string, fixtures string")
    return loop.pinned(rows, seeds, "source", ["fixtures"]).select("doc_id", "own", "fixtures")


@query("""WITH f AS (SELECT conv_id % 40 AS k, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n FROM conversations GROUP BY 1)
SELECT k, n + CAST(k % 5 = 0 AS INTEGER) AS message_count, (SELECT count(*) FROM f WHERE k % 5 = 0) AS scored FROM f""")
def rescanned_sessions(spark, d):
    """A second scan of forty long transcripts, of which a fifth has one more message: only these are read and scored again."""
    rows = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = rows.select((F.col("conv_id") % 40).alias("k"), "conv_id", "turn", line.alias("value"))
    one = lines.select("k").distinct().select("k", F.lit(1 << 40).alias("conv_id"), F.lit(0).alias("turn"), F.lit('{"type": "user", "message": {"role": "user", "content": "one more"}}').alias("value"))
    fs = spark._jvm.org.apache.hadoop.fs

    def write(df, folder: str, there: str) -> None:
        df.repartition("k").sortWithinPartitions("k", "conv_id", "turn").select("k", "value").write.partitionBy("k").text(folder)
        files = fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(fs.Path(there))
        for status in files.globStatus(fs.Path(f"{folder}/k=*/*.txt")):  # forty files
            to = fs.Path(f"{there}/{status.getPath().getParent().getName()}.jsonl")
            files.delete(to, False)
            files.rename(status.getPath(), to)

    with _folder(spark) as folder:
        logs = f"{folder}/logs"
        write(lines, f"{folder}/first", logs)
        rescan(spark, logs, f"{folder}/store", now=datetime(2026, 1, 1))
        write(lines.unionByName(one).where("k % 5 = 0"), f"{folder}/later", logs)
        facts, n = rescan(spark, logs, f"{folder}/store", now=datetime(2026, 1, 2))
        return cut(facts.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("long").alias("k"), "message_count", F.lit(n).cast("long").alias("scored")))


def _scoped(spark, d, folder: str):
    """Transcripts in a folder for each project, as agents name them, and the events of the project that a scope resolves to."""
    rows = table(spark, d, "conversations")
    cwd = F.concat(F.lit("/w/my.app"), (F.col("conv_id") % 5).cast("string"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.col("conv_id").cast("string").alias("sessionId"), cwd.alias("cwd")))
    named = F.substring_index(rank.project_folder_of("", cwd), "/", -1)
    rows.select(named.alias("p"), "conv_id", "turn", line.alias("value")).repartition("conv_id").sortWithinPartitions("p", "conv_id", "turn").select("p", "value").write.partitionBy("p").text(folder)
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(fs.Path(f"{folder}/p=*")):  # five folders
        files.rename(status.getPath(), fs.Path(status.getPath().toString().replace("p=", "")))


@query("""SELECT 'of the project' AS scope, '/w/my.app3' AS root, count(DISTINCT conv_id) AS sessions, count(*) AS events FROM conversations WHERE conv_id % 5 = 3 UNION ALL
SELECT 'within the project', '/w/my.app3', count(DISTINCT conv_id), count(*) FROM conversations WHERE conv_id % 5 = 3 UNION ALL
SELECT 'all', NULL, count(DISTINCT conv_id), count(*) FROM conversations UNION ALL SELECT 'unknown', '/x', 0, 0""")
def scoped_events(spark, d):
    """The events that a scope covers: only the folder of the project is listed; an unknown project's sessions are looked for by their working directory."""
    with _folder(spark) as folder:
        base = f"{folder}/logs"
        _scoped(spark, d, base)
        exists = rank.folder_exists(spark, local=lambda p: p == "/x/.git")
        found = []
        for name, cwd in (("of the project", "/w/my.app3"), ("within the project", "/w/my.app3/lib/deep"), ("all", None), ("unknown", "/x")):
            scope = rank.resolve_scope(base if "://" in base or base.startswith("file:") else f"file:{base}", cwd, exists=exists)
            events = datasource.events(spark, scope.base or base, glob="*.txt")
            kept = events.where(scope.member("cwd"))
            found.append(kept.agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("events")).select(F.lit(name).alias("scope"), F.lit(scope.root).cast("string").alias("root"), "sessions", "events"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return cut(out)


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'store#' || user_id ELSE 'store' END AS path, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE '' END AS session,
  least(greatest(user_id % 90 - 10, 1), 50) AS most FROM (SELECT DISTINCT user_id FROM events)""")
def handles_and_limits(spark, d):
    """Handles of stores and of files, and limits as they are asked for: what a handle names, and what a limit is allowed to be."""
    users = table(spark, d, "events").select("user_id").distinct()
    handle = F.concat(F.lit("store#"), F.when(F.col("user_id") % 3 == 2, "").otherwise(F.col("user_id").cast("string")))
    name = tr.handle_parts(handle, F.col("user_id") % 3 == 0)
    return users.select("user_id", name["path"].alias("path"), name["session"].alias("session"), rank.clamped(F.col("user_id") % 90 - 10).cast("long").alias("most"))


@query("""SELECT n_nationkey AS k, 'skill' || n_nationkey AS name, n_nationkey % 2 = 0 AS installed, 's' || n_nationkey AS source, n_nationkey % 10 AS composite, '# ' || n_name AS md, n_name AS feedback_skill, n_nationkey * 3 AS used FROM nation""")
def json_shapes(spark, d):
    """The JSON of proposals, of a shown one and of feedback, read again."""
    rows = table(spark, d, "nation")
    k = F.col("n_nationkey")
    stored = rows.select(
        k.cast("string").alias("id"), F.concat(F.lit("skill"), k.cast("string")).alias("name"), F.lit("proposed").alias("outcome"), F.lit(None).cast("string").alias("adapter"), F.lit("2026-01-01").alias("created_at"), F.array(F.concat(F.lit("s"), k.cast("string"))).alias("source_sessions"),
        (k % 2 == 0).alias("installed"), F.struct((k % 10).cast("double").alias("composite"), F.lit(None).cast("map<string,double>").alias("dimensions")).alias("eval"), F.concat(F.lit("# "), "n_name").alias("md"),
    )
    report = rows.select(F.col("n_name").alias("skill"), k.alias("sessions"), (k * 3).alias("used"), F.lit(0.5).alias("usage_rate"), F.lit(None).cast("double").alias("friction_with"), F.lit(1.0).alias("friction_without"), F.concat(F.lit("v"), k.cast("string")).alias("verdict"))
    get = lambda path, kind: F.try_variant_get(F.parse_json("json"), path, kind)
    null = lambda path: F.is_variant_null(get(path, "variant"))
    shown = shapes.proposals(stored, whole=True).where(null("$.adapter") & null("$.eval.engine")).select(get("$.id", "long").alias("k"), get("$.name", "string").alias("name"), get("$.installed", "boolean").alias("installed"), get("$.source_sessions[0]", "string").alias("source"), get("$.eval.composite", "long").alias("composite"), get("$.md", "string").alias("md"))
    told = shapes.feedback(report).where(null("$.installed_at") & null("$.friction_with")).select(F.substring(get("$.verdict", "string"), 2, 9).cast("long").alias("k"), get("$.skill", "string").alias("feedback_skill"), get("$.sessions_used", "long").alias("used"))
    return shown.join(told, "k")
