"""Queries over what the engine keeps (journals, proposals, skills, cached results), over relational sources and streams.

Stores are written from the tables to the session's shared folder and read back; their files go
when the result has been taken.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import LOOPS_SQL, ORDER, PARTS_SQL, _proposals, _summed, query
from .functions import template
from .functions import text as T
from .operators import loop, relate, similar
from .plans.session import cut, shared_folder, table
from .sources import stores
from .sources.transcripts import source
from .streaming import stateful
from .streaming.incremental import Store


@contextmanager
def _folder(spark: SparkSession):
    """A folder in the shared one, deleted afterwards."""
    name = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    try:
        yield name
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@query("""SELECT p_partkey AS iteration, 'part-' || p_brand AS skill, p_size / 50 AS new_composite, p_size > 25 AS kept, coalesce(NULLIF(p_partkey % 4, 0), 1) AS format FROM part WHERE p_partkey % 4 IN (0, 1) AND p_partkey % 10 <> 3""")
def journal_lines(spark, d):
    """A journal with lines of other formats, without one, and broken ones."""
    rows = table(spark, d, "part")
    line = F.to_json(F.struct(F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 4).alias("format"), F.col("p_partkey").alias("iteration"), F.concat(F.lit("part-"), "p_brand").alias("skill"), (F.col("p_size") / 50).alias("new_composite"), (F.col("p_size") > 25).alias("kept")))
    broken = F.when(F.col("p_partkey") % 10 == 3, F.concat(line, F.lit("{oops"))).otherwise(line)
    with _folder(spark) as folder:
        rows.select(F.when(F.col("p_partkey") % 10 == 3, F.substring(broken, 1, 12)).otherwise(broken).alias("value")).write.text(folder)
        return cut(stores.read_journal(spark, folder).select("iteration", "skill", "new_composite", "kept", "format"))


PROPOSED = "SELECT p_partkey, 's' || p_size AS session_key, '# ' || p_brand || p_type || chr(10) || (p_partkey % 40) AS md, '2026-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS created_at, p_name AS name FROM part"
PROPOSAL_ID = "substr(sha256(session_key), 1, 12) || '-' || substr(sha256(md), 1, 12)"


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.select(
        F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("session_key"), F.concat(F.lit("# "), "p_brand", "p_type", F.lit("\n"), (F.col("p_partkey") % 40).cast("string")).alias("md"),
        F.concat(F.lit("2026-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("created_at"), F.lit(1).alias("format"),
    )


@query(f"SELECT {PROPOSAL_ID} AS id, any_value(session_key) AS session_key, 'proposed' AS outcome, 'skill' AS kind, max(created_at) AS created_at FROM ({PROPOSED}) GROUP BY 1")
def proposals_put(spark, d):
    """Proposals stored twice over are there once, with later fields' defaults."""
    with _folder(spark) as folder:
        for _ in range(2):
            out = stores.put_proposals(spark, _drafts(spark, d), folder)
        return cut(out.select("id", "session_key", "outcome", "kind", "created_at"))


@query(f"SELECT id, created_at FROM (SELECT DISTINCT {PROPOSAL_ID} AS id, created_at FROM ({PROPOSED})) ORDER BY created_at DESC, id DESC LIMIT 40")
def proposals_pruned(spark, d):
    with _folder(spark) as folder:
        stores.put_proposals(spark, _drafts(spark, d), folder)
        return cut(stores.prune_proposals(spark, folder, 40).select("id", "created_at"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'hook' WHEN 1 THEN 'skill' WHEN 2 THEN 'hook' ELSE 'skill' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'kept' ELSE 'proposed' END AS outcome, CASE WHEN p_partkey % 3 = 0 THEN 'a,b' ELSE 'k' || p_partkey END AS sources FROM part WHERE p_partkey % 7 <> 6")
def proposals_of_all_formats(spark, d):
    """Records of formats 1 to 3 and of an unknown one; an old record's kind is read from its first signs."""
    rows = table(spark, d, "part")
    k = F.col("p_partkey")
    record = F.struct(
        k.cast("string").alias("id"), F.when(k % 7 == 6, 9).when(k % 7 == 5, F.lit(None)).otherwise(k % 3 + 1).alias("format"), F.concat(F.lit("k"), k.cast("string")).alias("session_key"),
        F.when(k % 4 == 0, "hook").when(k % 4 == 1, "skill").alias("kind"), F.when(k % 4 == 2, "#!/bin/sh").otherwise("# x").alias("md"), F.when(k % 5 == 0, "kept").alias("outcome"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("source_sessions"),
    )
    with _folder(spark) as folder:
        rows.groupBy((k % 50).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value")).write.partitionBy("part").text(folder)
        out = stores.read_proposals(spark, folder)
        return cut(out.select(F.col("id").cast("long").alias("id"), "kind", "outcome", F.array_join("source_sessions", ",").alias("sources")))


@query(f"""WITH p AS (SELECT DISTINCT {PROPOSAL_ID} AS id, session_key, created_at FROM ({PROPOSED})) SELECT s.session_key, arg_max(id, {{'c': created_at, 'i': id}}) AS id FROM (SELECT DISTINCT 's' || p_size AS session_key FROM part UNION ALL SELECT 'none') s LEFT JOIN p ON p.session_key = s.session_key GROUP BY s.session_key""")
def proposals_latest(spark, d):
    drafts = _drafts(spark, d).withColumn("id", stores.proposal_id()).select("id", "session_key", "created_at", F.lit("n").alias("name"), F.lit("x").alias("session_stamp"))
    sessions = drafts.select("session_key").distinct().unionByName(spark.createDataFrame([("none",)], "session_key string"))
    return stores.latest_for(sessions, drafts).select("session_key", "id")


def _installed(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """A skill for each nation, with markers for some, of which some aren't ours, are of another format or can't be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(name: str, text: str) -> None:
        out = files.create(path(f"{folder}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    for r in table(spark, d, "nation").collect():  # 25 rows
        k, body = r.n_nationkey, f"---\n{'name: ' + r.n_name if r.n_nationkey % 2 else 'title: x'}\ndescription: of region {r.n_regionkey}\n---\nbody"
        write(f"f{k}/SKILL.md", body)
        marker = {"installed_by": "x", "name": r.n_name, "installed_at": f"2026-01-{k + 1:02d}T00:00:00Z", "source_session": f"s{k % 4}", "skill_sha256": "other" if k % 3 else hashlib.sha256(body.encode()).hexdigest()}
        if k % 5 == 1:
            write(f"f{k}/.mark.json", "{oops")
        elif k % 5 == 2:
            write(f"f{k}/.mark.json", json.dumps(marker | {"format": 7}))
        elif k % 5:
            write(f"f{k}/.mark.json", json.dumps(marker | ({"format": 1} if k % 2 else {})))
    return stores.installed_skills(spark, folder)


INSTALLED = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN n_name ELSE 'f' || n_nationkey END AS skill, 'of region ' || n_regionkey AS description, n_nationkey % 5 >= 3 AS ours, CASE WHEN n_nationkey % 5 >= 3 THEN 's' || n_nationkey % 4 END AS source_session FROM nation"


@query(f"SELECT skill, description, ours, source_session, ours AND k % 3 <> 0 AS drifted, CASE WHEN ours THEN '2026-01-' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') END AS installed FROM ({INSTALLED})")
def installed_skills(spark, d):
    with _folder(spark) as folder:
        out = _installed(spark, d, folder)
        return cut(out.select("skill", "description", "ours", "source_session", "drifted", F.date_format("installed_at", "yyyy-MM-dd").alias("installed")))


@query(f"SELECT s AS session, min(skill) AS installed_skill FROM (SELECT 's' || r_regionkey AS s FROM region) LEFT JOIN ({INSTALLED}) ON source_session = s GROUP BY s")
def skill_of_session(spark, d):
    """The skill that was installed from a session, of several the first by name."""
    with _folder(spark) as folder:
        sessions = table(spark, d, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("session"))
        return cut(relate.first_installed(sessions, _installed(spark, d, folder), "session", "source_session", "skill"))


@query(f"SELECT n_name AS name, n_name IN (SELECT skill FROM ({INSTALLED})) AS installed FROM nation")
def proposals_installed(spark, d):
    with _folder(spark) as folder:
        names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
        return cut(relate.with_installed(names, _installed(spark, d, folder), "name", "skill"))


@query("""SELECT c_nationkey AS cluster, string_agg(c_name, ',' ORDER BY c_custkey) AS merged_from, (SELECT string_agg(s, ',' ORDER BY f) FROM (SELECT 's' || i.c_custkey % 5 AS s, min(i.c_custkey) AS f FROM customer i WHERE i.c_nationkey = customer.c_nationkey AND i.c_custkey % 5 <> 3 GROUP BY 1)) AS session_ids
FROM customer GROUP BY c_nationkey""")
def merged_provenance(spark, d):
    """Names and sessions that merged artifacts came from, in order; some have no session."""
    rows = table(spark, d, "customer").withColumn("session", F.when(F.col("c_custkey") % 5 != 3, F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string"))))
    out = similar.merged_provenance(rows, "c_nationkey", ["c_custkey"], "c_name", "session")
    return out.select(F.col("c_nationkey").alias("cluster"), F.array_join("merged_from", ",").alias("merged_from"), F.nullif(F.array_join("session_ids", ","), F.lit("")).alias("session_ids"))


@query("""WITH c AS (SELECT c_nationkey AS cluster, count(*) AS size FROM customer GROUP BY 1)
SELECT CASE WHEN size = 1 THEN 'kept' WHEN cluster % 2 = 0 THEN 'merged' ELSE 'originals' END AS outcome, count(*) AS count FROM c GROUP BY 1""")
def outcome_counts(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_nationkey", "cluster")
    passed = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") % 2 == 0).alias("passed"))
    return similar.outcome_counts(similar.merge_outcomes(rows, passed))


@query(f"""WITH RECURSIVE p AS ({PARTS_SQL}), e AS (SELECT b.id AS b, a.id AS a FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) >= 0.5 * len(list_distinct(list_concat(a.t, b.t)))),
n AS (SELECT p.id, p.p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p.id) AS i, coalesce(list(e.a) FILTER (WHERE e.a IS NOT NULL), []) AS near FROM p LEFT JOIN e ON e.b = p.id GROUP BY p.id, p.p_brand),
f AS (SELECT p_brand, 0::BIGINT AS i, []::STRUCT(id BIGINT, c BIGINT)[] AS done FROM (SELECT DISTINCT p_brand FROM p) UNION ALL
  SELECT f.p_brand, n.i, list_append(f.done, {{'id': n.id::BIGINT, 'c': coalesce(list_min(list_transform(list_filter(f.done, lambda x: list_contains(n.near, x.id)), lambda x: x.c)), n.id)::BIGINT}}) FROM f JOIN n ON n.p_brand = f.p_brand AND n.i = f.i + 1),
l AS (SELECT p_brand, arg_max(done, i) AS done FROM f GROUP BY p_brand)
SELECT x.id AS id, p_brand, x.c AS cluster FROM (SELECT p_brand, unnest(done) AS x FROM l)""")
def greedy_clusters(spark, d):
    """First-fit clusters in order of keys; a cluster's name is its first key, so the oldest is the one of the least name."""
    rows = _proposals(spark, d)
    return similar.greedy_clusters(rows, similar.similar_pairs(rows, "id", "p_brand", "tokens", 0.5), "id", "p_brand")


GREEDY_SQL = """f AS (SELECT kind, 0::BIGINT AS i, []::STRUCT(id VARCHAR, c BIGINT)[] AS done FROM (SELECT DISTINCT kind FROM n) UNION ALL
  SELECT f.kind, n.i, list_append(f.done, {'id': n.id, 'c': coalesce(list_min(list_transform(list_filter(f.done, lambda x: list_contains(n.near, x.id)), lambda x: x.c)), n.i)::BIGINT}) FROM f JOIN n ON n.kind = f.kind AND n.i = f.i + 1),
l AS (SELECT kind, arg_max(done, i) AS done FROM f GROUP BY kind), g AS (SELECT kind, unnest(done) AS x FROM l)"""


@query(f"""WITH RECURSIVE p AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'skill' ELSE 'hook' END AS kind, lpad(CAST(s_suppkey * 7919 % 1000 AS VARCHAR), 4, '0') AS at,
  list_distinct(list_filter(regexp_split_to_array(lower('of ' || n_name || ' ' || s_name || ' ' || s_nationkey % 3 || ' tries'), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.kind = b.kind AND (a.at, a.id) < (b.at, b.id) AND len(list_intersect(a.t, b.t)) >= 0.5 * len(list_distinct(list_concat(a.t, b.t)))),
n AS (SELECT p.id, kind, row_number() OVER (PARTITION BY kind ORDER BY p.at, p.id) AS i, coalesce(list(e.a) FILTER (WHERE e.a IS NOT NULL), []) AS near FROM p LEFT JOIN e ON e.b = p.id GROUP BY p.id, kind, p.at),
{GREEDY_SQL}
SELECT x.id AS id, g.kind AS kind, n.id AS cluster FROM g JOIN n ON n.kind = g.kind AND n.i = x.c""")
def greedy_clusters_of_two_kinds(spark, d):
    """First-fit clusters, the oldest first: of skills and hooks, by the words of name, description and triggers."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    drafts = rows.select(
        key.cast("string").alias("id"), F.when(key % 2 == 0, "skill").otherwise("hook").alias("kind"), F.lpad((key * 7919 % 1000).cast("string"), 4, "0").alias("at"), F.concat(F.lit("of "), "n_name").alias("name"),
        F.col("s_name").alias("description"), F.array((F.col("s_nationkey") % 3).cast("string"), F.lit("tries")).alias("should_trigger"),
    )
    tokens = drafts.select("id", "kind", "at", similar.routing_tokens("name", "description", "should_trigger").alias("tokens"))
    return similar.greedy_clusters(tokens, similar.reaching_pairs(tokens, "id", "kind", "tokens", 0.5, order=("at",)), "id", "kind", order=("at",))


@query(f"""WITH p AS (SELECT DISTINCT {PROPOSAL_ID} AS id, created_at FROM ({PROPOSED})), k AS (SELECT id FROM p ORDER BY created_at DESC, id DESC LIMIT 40)
SELECT 'of format 9' AS record, count(*) AS records FROM part WHERE p_partkey % 10 = 9 UNION ALL SELECT 'broken', count(*) FROM part WHERE p_partkey % 10 = 8 UNION ALL SELECT 'proposal', count(*) FROM k""")
def proposals_kept_unread(spark, d):
    """Records that can't be read here, in files of their own and beside others, are still there after proposals have been stored and pruned."""
    rows = table(spark, d, "part")
    k = F.col("p_partkey")
    drafts = _drafts(spark, d).withColumn("id", stores.proposal_id()).dropDuplicates(["id"])
    known = drafts.select(F.to_json(F.struct(*drafts.columns)).alias("value"))
    other = rows.where(k % 10 >= 8).select(F.when(k % 10 == 9, F.to_json(F.struct(F.concat(F.lit("new"), k.cast("string")).alias("id"), F.lit(9).alias("format")))).otherwise(F.concat(F.lit('{"format": 1, "id": "broken'), k.cast("string"))).alias("value"))
    with _folder(spark) as folder:
        known.unionByName(other).repartition(8).write.text(folder)
        stores.put_proposals(spark, _drafts(spark, d), folder)
        stores.prune_proposals(spark, folder, 40)
        lines = spark.read.option("recursiveFileLookup", "true").text(folder)
        of_kind = F.when(F.col("value").contains('"format":9'), "of format 9").when(F.col("value").contains('"id": "broken'), "broken").otherwise("proposal")
        return cut(lines.select(of_kind.alias("record"), F.coalesce(F.get_json_object("value", "$.id"), "value").alias("id")).groupBy("record").agg(F.countDistinct("id").alias("records")))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'computed' ELSE 'reused' END AS source, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS result FROM orders")
def cached_runs(spark, d):
    """A second run over orders of which a fifth has changed: the others come from the store."""
    now = datetime(2026, 1, 2)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("a").alias("stamp"), F.floor("o_totalprice").alias("price"), F.lit(0).alias("more"))
    changed = F.col("key").cast("long") % 5 == 0
    later = rows.withColumns({"stamp": F.when(changed, "b").otherwise("a"), "more": F.when(changed, 1).otherwise(0)})
    compute = lambda df: df.select("key", (F.col("price") + F.col("more")).cast("long").alias("result"), F.col("stamp").alias("of"))
    with _folder(spark) as folder:
        store = Store(spark, folder)
        store.run(rows, "1", compute, now)
        store.compact(now)
        out, _ = store.run(later, "1", compute, now)
        return cut(out.select(F.col("key").cast("long").alias("key"), F.when(F.col("of") == "b", "computed").otherwise("reused").alias("source"), "result"))


@query("SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS bash, count(*) FILTER (WHERE event_type = 'view') AS reads, count(*) FILTER (WHERE value > 60) AS errors FROM events GROUP BY user_id")
def relational_message_parts(spark, d):
    """A store of sessions, messages and parts, read through the registry."""
    rows = table(spark, d, "events")
    session, key = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    tool = F.when(F.col("event_type") == "click", "bash").when(F.col("event_type") == "view", "read").otherwise(F.col("event_type"))
    state = F.struct(F.when(F.col("value") > 60, "error").otherwise("completed").alias("status"), F.struct(F.col("props").alias("command")).alias("input"))
    with _folder(spark) as folder:
        rows.select(session.alias("id"), F.lit("/w").alias("directory")).distinct().write.parquet(f"{folder}/session.parquet")
        rows.select(key.alias("id"), session.alias("session_id"), F.col("event_id").alias("time_created"), F.lit('{"role":"assistant"}').alias("data")).write.parquet(f"{folder}/message.parquet")
        rows.select(key.alias("id"), key.alias("message_id"), F.col("event_id").alias("time_created"), F.to_json(F.struct(F.lit("tool").alias("type"), tool.alias("tool"), key.alias("callID"), state.alias("state"))).alias("data")).write.parquet(f"{folder}/part.parquet")
        return cut(_summed(source("opencode").parse(spark, folder)))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, '#' || conv_id AS handle, '/p' || conv_id % 3 AS label, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE turn % 5 = 4) AS errors, CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE length(text) END) AS BIGINT) AS chars
FROM conversations WHERE conv_id % 4 <> 1 GROUP BY conv_id""")
def relational_session_index(spark, d):
    """An index of sessions of several providers and their messages, some of which don't parse."""
    rows = table(spark, d, "conversations")
    sessions = rows.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("/p"), (F.col("conv_id") % 3).cast("string")).alias("project_path"), F.when(F.col("conv_id") % 4 == 1, "codex").otherwise("claude").alias("provider"))
    content = F.when(F.col("turn") % 5 == 4, "{oops").otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    messages = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("role").alias("type"), content.alias("content"), F.lit("u").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.lit(None).cast("string").alias("timestamp"), F.lit(0).alias("is_sidechain"), F.col("turn").alias("sequence"))
    with _folder(spark) as folder:
        sessions.write.parquet(f"{folder}/sessions.parquet")
        messages.write.parquet(f"{folder}/messages.parquet")
        found = source("index").discover(spark, folder).select(F.regexp_extract("handle", "(#.*)$", 1).alias("handle"), "label")
        events = source("index").parse(spark, folder)
        kept = events.join(messages.select((F.col("id")).alias("_id"), F.col("session_id").cast("string").alias("path"), (F.row_number().over(Window.partitionBy("session_id").orderBy("sequence", "id"))).cast("long").alias("seq"), F.col("type").alias("_type")), ["path", "seq"])
        out = kept.groupBy(F.col("path").alias("session")).agg(F.count_if(F.col("_type") == "user").alias("users"), F.count_if(F.col("err").isNotNull()).alias("errors"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
        return cut(out.withColumn("handle", F.concat(F.lit("#"), "session")).join(found, "handle").select("session", "handle", "label", "users", "errors", "chars"))


@query("SELECT p_partkey, 'Part ' || p_partkey || ':' || CASE WHEN p_size % 2 = 0 THEN ' even' ELSE '' END || ' -' || p_brand || ' -' || p_type || '.' AS filled, CASE WHEN p_size % 3 = 0 THEN p_size END AS inside FROM part")
def templates_and_json(spark, d):
    """Templates with values, sections and lists (filled on the driver once for each shape), and JSON inside a model's answer."""
    rows = table(spark, d, "part")
    shape = lambda even: template.fill("Part {{n}}:{{#even}} even{{/even}}{{#items}} -{{item}}{{/items}}.", {"n": "@n", "even": even, "items": ["@a", "@b"]})
    told = F.when(F.col("p_size") % 2 == 0, shape(True)).otherwise(shape(False))
    for mark, column in (("@n", F.col("p_partkey").cast("string")), ("@a", F.col("p_brand")), ("@b", F.col("p_type"))):
        told = F.replace(told, F.lit(mark), column)
    answer = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('Sure:\n```json\n{"size": '), F.col("p_size").cast("string"), F.lit("}\n```\n"))).when(F.col("p_size") % 3 == 1, "no object").otherwise('{"size": }')
    return rows.select("p_partkey", told.alias("filled"), F.try_variant_get(template.json_in(answer), "$.size", "int").alias("inside"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events""")
def stream_forward_fill(spark, d):
    """The last known value so far, with state for each session."""
    stream = stateful.events_stream(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("mark"))
    out = stateful.filled_forward(stream, "user_id", ORDER, "mark", "since")
    return stateful.gathered(spark, out, "append", "user_id").select("user_id", "event_id", "since")


@query(LOOPS_SQL)
def stream_retry_loops(spark, d):
    """The strongest signal over a stream."""
    stream = stateful.events_stream(spark, d).withColumn("errored", F.col("value") > 60)
    return stateful.gathered(spark, stateful.retry_loops(stream, "user_id", ORDER, "event_type", "errored"), "update", "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'phx' WHEN c_custkey % 4 = 1 THEN 'name' WHEN c_custkey % 4 = 2 THEN '' ELSE 'x' END AS short, CASE WHEN c_custkey % 3 = 0 THEN '2026-01-02 03:04:05' END AS parsed FROM customer")
def names_and_times(spark, d):
    """Short names of skills, and times of which some don't parse."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "a:b:/phx").when(k % 4 == 1, "name").when(k % 4 == 2, "ns:").otherwise("/x")
    time = F.when(k % 3 == 0, "2026-01-02T03:04:05Z").when(k % 3 == 1, "yesterday").otherwise("")
    return table(spark, d, "customer").select("c_custkey", T.short_name(name).alias("short"), F.date_format(F.try_to_timestamp(time), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT doc_id, lang IN ('en', 'fr') AS kept, CASE WHEN position % 2 = 0 THEN 'train' ELSE 'validation' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY source, lang IN ('en', 'fr') ORDER BY doc_id) - 1 AS position, count(*) FILTER (WHERE lang IN ('en', 'fr')) OVER (PARTITION BY source) AS yes, count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) OVER (PARTITION BY source) AS no FROM documents) WHERE yes >= 2 AND no >= 2")
def holdout_fixtures(spark, d):
    """Fixtures of both polarities dealt to training and validation, where a source has two of each."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").isin("en", "fr").alias("kept"))
    return loop.holdout(rows, "source", "kept", ["doc_id"]).select("doc_id", "kept", "part")
