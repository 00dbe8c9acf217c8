"""Queries over the test tables, with the SQL they are held against.

Sessions are ``conversations`` (conv_id, turn, role, text); their tool calls are the ``events`` of
the user with the same id, in order of time, an event's type standing for the tool and a value
above 60 for a failed call. Ranking, joining and sampling use the other tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import text as T
from .operators import artifacts, classify, loop, rank, relate, signals, similar
from .plans.session import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", "props", (F.col("value") > 60).alias("errored"), F.round(F.col("value") * 100).cast("long").alias("cents"))


ORDER = ["ts", "event_id"]
HUMAN = "(role = 'user' AND regexp_matches(coalesce(text, ''), '[^\\s]'))"
CORRECTED = r"regexp_matches(substr(text, 1, 500), '\b(no[,.]?\s|wrong|instead|actually|that''s not|not what I|I meant|I said|please don''t|stop|undo|revert)\b')"

MESSAGES_SQL = f"""SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS message_count, count(*) FILTER (WHERE {HUMAN}) AS human_turns,
  count(*) FILTER (WHERE {HUMAN} AND {CORRECTED}) AS user_corrections FROM conversations GROUP BY conv_id"""


@query(MESSAGES_SQL)
def human_turns_per_session(spark, d):
    return signals.message_counts(talk(spark, d), "conv_id", "role", "text")


@query(f"SELECT conv_id, turn, {CORRECTED} AS corrects FROM conversations WHERE {HUMAN}")
def correction_signal(spark, d):
    return talk(spark, d).where(signals.human_turn("role", "text")).select("conv_id", "turn", T.is_correction("text").alias("corrects"))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user' AND contains(text, '[Request interrupted by user]')) AS interrupts,
  count(*) FILTER (WHERE role = 'user' AND contains(text, ' la ')) AS marked,
  count(*) FILTER (WHERE contains(lower(text), 'context compact')) AS compactions, count(*) FILTER (WHERE contains(lower(text), ' and ')) AS phrased FROM conversations GROUP BY conv_id""")
def interrupt_compaction_signals(spark, d):
    return talk(spark, d).groupBy("conv_id").agg(
        signals.interrupts("role", "text").alias("interrupts"), signals.interrupts("role", "text", " la ").alias("marked"),
        signals.compactions("text").alias("compactions"), signals.compactions("text", phrase=" and ").alias("phrased"),
    )


E_SQL = "SELECT *, value > 60 AS errored FROM events"
LOOPS_SQL = f"""SELECT user_id, count(*) FILTER (WHERE n >= 3 AND bad) AS retry_loops FROM (
  SELECT user_id, event_type, run, count(*) AS n, bool_or(errored) AS bad FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM ({E_SQL}))
  GROUP BY user_id, event_type, run) GROUP BY user_id"""


@query(LOOPS_SQL)
def retry_loops_islands(spark, d):
    return signals.retry_loops(calls(spark, d), "user_id", ORDER, "event_type", "errored")


TWO_SQL = """SELECT user_id, bool_or(coalesce(event_type = lag1 AND event_type = lag2, false)) AS repeated FROM (
  SELECT user_id, event_type, lag(event_type, 1) OVER w AS lag1, lag(event_type, 2) OVER w AS lag2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id"""


@query(TWO_SQL)
def retry_two_lag(spark, d):
    return signals.repeated_start(calls(spark, d), "user_id", ORDER, "event_type")


CHANGES_SQL = """WITH i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT user_id, n, i // greatest(n // 4, 5) AS chunk, event_type, count(*) AS c, min(i) AS first FROM i GROUP BY ALL),
l AS (SELECT user_id, n, chunk, event_type FROM k QUALIFY row_number() OVER (PARTITION BY user_id, chunk ORDER BY c DESC, first) = 1),
w AS (SELECT user_id, n, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY chunk) AS was FROM l)
SELECT user_id, count(*) FILTER (WHERE was <> event_type AND n >= 10) AS approach_changes FROM w GROUP BY user_id"""


@query(CHANGES_SQL)
def approach_changes(spark, d):
    return signals.approach_changes(calls(spark, d), "user_id", ORDER, "event_type")


KINDS = ("view", "click", "error", "other")


def kind_of(name: str) -> Column:
    return F.when(F.col(name).isin(*KINDS[:3]), F.col(name)).otherwise("other")


@query("""SELECT user_id, count(*) AS tool_count, count(*) FILTER (WHERE event_type = 'view') / count(*) AS view_share, count(*) FILTER (WHERE event_type = 'click') / count(*) AS click_share,
  count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_share, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'error')) / count(*) AS other_share FROM events GROUP BY user_id""")
def tool_profile(spark, d):
    return signals.tool_profile(calls(spark, d), "user_id", kind_of("event_type"), KINDS)


@query(f"SELECT user_id, count(*) FILTER (WHERE errored) AS errors, count(*) AS tool_count, count(*) FILTER (WHERE errored) / count(*) AS error_tool_ratio FROM ({E_SQL}) GROUP BY user_id")
def error_ratio_by_session(spark, d):
    n, bad = F.count(F.lit(1)), F.count_if("errored")
    return calls(spark, d).groupBy("user_id").agg(bad.alias("errors"), n.alias("tool_count"), T.ratio(bad, n).alias("error_tool_ratio"))


def session_signals(spark: SparkSession, d: str) -> DataFrame:
    """One row for each conversation with its six signals."""
    rows, events = talk(spark, d), calls(spark, d)
    said = signals.message_counts(rows, "conv_id", "role", "text").join(interrupt_compaction_signals(spark, d), "conv_id")
    done = error_ratio_by_session(spark, d).join(signals.retry_loops(events, "user_id", ORDER, "event_type", "errored"), "user_id", "left")
    done = done.join(signals.approach_changes(events, "user_id", ORDER, "event_type"), "user_id", "left").withColumnRenamed("user_id", "conv_id")
    out = said.join(done, "conv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "conv_id", "message_count", "human_turns", zero("retry_loops").alias("retry_loops"), "user_corrections", F.coalesce("error_tool_ratio", F.lit(0.0)).alias("error_tool_ratio"),
        zero("approach_changes").alias("approach_changes"), F.col("phrased").alias("context_compactions"), F.col("marked").alias("interrupted_requests"),
    )


SIGNALS_SQL = f"""SELECT m.conv_id, message_count, human_turns, coalesce(retry_loops, 0) AS retry_loops, user_corrections, coalesce(error_tool_ratio, 0) AS error_tool_ratio,
  coalesce(approach_changes, 0) AS approach_changes, phrased AS context_compactions, marked AS interrupted_requests
FROM ({MESSAGES_SQL}) m JOIN ({ORACLE["interrupt_compaction_signals"]}) p ON m.conv_id = p.conv_id
LEFT JOIN ({ORACLE["error_ratio_by_session"]}) e ON e.user_id = m.conv_id LEFT JOIN ({LOOPS_SQL}) l ON l.user_id = m.conv_id LEFT JOIN ({CHANGES_SQL}) c ON c.user_id = m.conv_id"""
RAW_SQL = "retry_loops * 3.0::DOUBLE + user_corrections * 2.5::DOUBLE + error_tool_ratio * 2.0::DOUBLE + approach_changes * 2.0::DOUBLE + context_compactions * 1.5::DOUBLE + interrupted_requests * 1.0::DOUBLE"
SCORED_SQL = f"SELECT *, round({RAW_SQL}, 9) AS raw FROM ({SIGNALS_SQL})"


@query(SIGNALS_SQL)
def friction_signals(spark, d):
    return session_signals(spark, d)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return session_signals(spark, d).withColumn("raw", F.round(signals.raw_score(), 9))


@query(f"SELECT conv_id, raw, round(1 / (1 + exp(-3.0 * (raw - 1.5))), 9) AS score, CASE WHEN message_count = 0 THEN 0 ELSE round(raw / message_count, 9) END AS rate FROM ({SCORED_SQL})")
def friction_score(spark, d):
    return scored(spark, d).select("conv_id", "raw", F.round(signals.sigmoid("raw"), 9).alias("score"), F.round(T.ratio("raw", "message_count"), 9).alias("rate"))


@query(f"""SELECT conv_id, CASE WHEN top.v > 0 THEN top.k END AS dominant FROM (SELECT conv_id, list_max([{", ".join(f"{{'v': {k} * {w}::DOUBLE, 'k': '{k}'}}" for k, w in C.WEIGHTS.items())}]) AS top FROM ({SIGNALS_SQL}))""")
def dominant_signal(spark, d):
    return session_signals(spark, d).select("conv_id", signals.dominant_signal().alias("dominant"))


@query(f"SELECT conv_id, raw, message_count, row_number() OVER (ORDER BY raw DESC, message_count DESC, conv_id) AS place FROM ({SCORED_SQL}) WHERE message_count >= 4")
def friction_ranking(spark, d):
    """The flagship: score every session, keep those with enough messages, rank them."""
    rows = scored(spark, d).where(F.col("message_count") >= C.MIN_MESSAGES).select("conv_id", "raw", "message_count", (-F.col("raw")).alias("_r"), (-F.col("message_count")).alias("_m"))
    placed, _ = rank.numbered(rows, ["_r", "_m", "conv_id"])
    return placed.select("conv_id", "raw", "message_count", (F.col("row") + 1).alias("place"))


@query(f"SELECT conv_id, round(raw / message_count, 9) AS rate, message_count FROM ({SCORED_SQL}) ORDER BY rate DESC, message_count DESC, conv_id LIMIT 10")
def rank_by_rate(spark, d):
    rows = scored(spark, d).select("conv_id", F.round(T.ratio("raw", "message_count"), 9).alias("rate"), "message_count")
    return rank.ranked(rows, ["rate", "message_count"], ["conv_id"], 10)


@query(f"SELECT conv_id, raw, message_count FROM ({SCORED_SQL}) ORDER BY raw DESC, message_count DESC, conv_id LIMIT 10")
def rank_by_raw(spark, d):
    return rank.ranked(scored(spark, d).select("conv_id", "raw", "message_count"), ["raw", "message_count"], ["conv_id"], 10)


MODELS = {"click": "claude-opus-4-5", "view": "claude-opus-4-8[1m]", "purchase": "claude-haiku-4-5-20251001", "signup": "claude-opus-4-6-20260101", "error": "unheard-of"}


@query("""WITH p AS (SELECT user_id, max(CAST(round(value * 100) AS BIGINT) * 10) AS peak FROM events GROUP BY user_id),
m AS (SELECT user_id, arg_max(event_type, {'n': n, 'e': event_type}) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id),
j AS (SELECT p.user_id, peak, CASE event_type WHEN 'click' THEN 'claude-opus-4-5' WHEN 'view' THEN 'claude-opus-4-8[1m]' WHEN 'purchase' THEN 'claude-haiku-4-5-20251001' WHEN 'signup' THEN 'claude-opus-4-6-20260101' ELSE 'unheard-of' END AS model,
  CASE event_type WHEN 'click' THEN 200000 WHEN 'view' THEN 1000000 WHEN 'purchase' THEN 200000 WHEN 'signup' THEN 200000 END AS base,
  CASE event_type WHEN 'click' THEN 1000000 WHEN 'view' THEN 1000000 WHEN 'signup' THEN 1000000 END AS large FROM p JOIN m ON p.user_id = m.user_id),
w AS (SELECT *, CASE WHEN peak > base THEN coalesce(large, base) ELSE base END AS w FROM j)
SELECT user_id, model, peak, CASE WHEN w IS NOT NULL THEN least(floor((peak * 100 * 20 + w) / (2 * w)) / 10, 100.0) END AS max_ctx_pct FROM w""")
def peak_context(spark, d):
    rows = calls(spark, d)
    peak = rows.groupBy("user_id").agg(F.max(F.col("cents") * 10).alias("peak"))
    names = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    out = peak.join(classify.mode_of(rows, ["user_id"], "event_type", "kind"), "user_id").withColumn("model", names[F.col("kind")])
    pct = classify.context_percent("peak", classify.message_window("model", "peak"))
    return out.select("user_id", "model", "peak", F.when(classify.message_window("model", "peak").isNotNull(), pct).alias("max_ctx_pct"))


@query("SELECT user_id, arg_max(event_type, {'n': n, 'e': event_type}) AS favourite FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def primary_value_mode(spark, d):
    return classify.mode_of(calls(spark, d), ["user_id"], "event_type", "favourite")


VOCABULARY = {"bug-fix": "the|and|that", "feature": "der|die|und", "exploration": "que|les|la", "maintenance": "de|en|el", "review": "of|to", "refactoring": "ou|est"}
_hits = {k: rf"len(regexp_extract_all(opening, '(?i)\b(?:{w})\b'))" for k, w in VOCABULARY.items()}
OPENING_SQL = f"""SELECT conv_id, string_agg(substr(text, 1, 2000), ' ' ORDER BY i) AS opening FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE {HUMAN}) WHERE i <= 10 GROUP BY conv_id"""


@query(f"""WITH s AS (SELECT conv_id, list_max([{", ".join(f"{{'s': {h} * 4 + {4 if k == 'review' else 0} * CAST(contains(opening, 'ing ') AS INTEGER), 'i': -{i}, 'k': '{k}'}}" for i, (k, h) in enumerate(_hits.items()))}]) AS best,
  ({" + ".join(_hits.values())}) * 4 + 4 * CAST(contains(opening, 'ing ') AS INTEGER) AS total FROM ({OPENING_SQL}))
SELECT conv_id, CASE WHEN total > 0 THEN best.k ELSE 'unknown' END AS kind, CASE WHEN total > 0 THEN floor((best.s * 200 + total) / (2 * total)) / 100 ELSE 0 END AS confidence FROM s""")
def fingerprint_session(spark, d):
    opening = classify.opening_text(talk(spark, d).where(signals.human_turn("role", "text")), "conv_id", ["turn"], "text")
    scores = classify.type_scores("opening", VOCABULARY, rules=[("review", F.contains("opening", F.lit("ing ")), 2.0)])
    kind, confidence = classify.fingerprint(scores)
    return opening.select("conv_id", kind.alias("kind"), confidence.alias("confidence"))


@query(f"""SELECT t.user_id, concat_ws(',', CASE WHEN repeated THEN 'investigate' END, CASE WHEN n > 60 THEN 'plan' END, CASE WHEN edits > 8 THEN 'review' END) AS missed,
  least((CAST(repeated AS INTEGER) + CAST(n > 60 AS INTEGER) + CAST(edits > 8 AS INTEGER)) * 2, 10) / 10 AS opportunity
FROM ({TWO_SQL}) t JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS edits FROM events GROUP BY user_id) c ON t.user_id = c.user_id""")
def opportunity_rules(spark, d):
    rows = calls(spark, d)
    facts = signals.repeated_start(rows, "user_id", ORDER, "event_type").join(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("edits")), "user_id")
    rules = [classify.DEFAULT_RULES[0], classify.DEFAULT_RULES[1] | {"threshold": 60}, classify.DEFAULT_RULES[2] | {"threshold": 8}]
    skills, share = classify.missed(rules, {"retry_loops": F.col("repeated"), "tool_count": F.col("n"), "edit_count": F.col("edits")}, F.array().cast("array<string>"))
    return facts.select("user_id", F.array_join(skills, ",").alias("missed"), share.alias("opportunity"))


@query(r"""SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url, '(?i)(?:http|https)://(?:www\.)?', 0), lambda x: lower(x)))), ','), '') AS schemes,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(url, '://', ':'), '(?i)(?:http|https):([a-z][a-z0-9_-]*)', 1), lambda x: lower(x)))), ','), '') AS used FROM pages""")
def used_skills_extract(spark, d):
    names = classify.used_skills(F.replace(F.col("url"), F.lit("://"), F.lit(":")), ["http", "https"])
    schemes = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("url", F.lit(r"(?i)(?:http|https)://(?:www\.)?"), F.lit(0)), F.lower)))
    return table(spark, d, "pages").select("page_id", F.array_join(schemes, ",").alias("schemes"), F.array_join(names, ",").alias("used"))


COMMAND_SQL = "CASE event_type WHEN 'click' THEN 'mix test test/a_test.exs | tail -' || event_id WHEN 'view' THEN 'set -o pipefail; mix  test | tail' WHEN 'error' THEN 'pytest  -q 2>&1 |' || chr(10) || ' grep x; echo $?' WHEN 'purchase' THEN 'git log | head' ELSE 'make all > log; cat log | wc' END"


def with_command(rows: DataFrame) -> DataFrame:
    k = F.col("event_type")
    command = (
        F.when(k == "click", F.concat(F.lit("mix test test/a_test.exs | tail -"), F.col("event_id").cast("string"))).when(k == "view", "set -o pipefail; mix  test | tail")
        .when(k == "error", "pytest  -q 2>&1 |\n grep x; echo $?").when(k == "purchase", "git log | head").otherwise("make all > log; cat log | wc")
    )
    return rows.withColumn("command", command)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HAZARD_SQL = f"""SELECT event_id, user_id, ts, 'pipe_masks_exit' AS kind, '`' || trim(regexp_replace(command, '\\s+', ' ', 'g')) || '` — ' || {_sql_text(C.PIPE_EXPLAINED)} ||
  CASE WHEN regexp_matches(command, {_sql_text(C.STATUS_READ)}) THEN ', ' || {_sql_text(C.STATUS_EXPLAINED)} ELSE '' END AS evidence
FROM (SELECT *, {COMMAND_SQL} AS command FROM events) WHERE regexp_matches(command, {_sql_text(C.PIPE_MASKS_EXIT)}) AND NOT regexp_matches(command, {_sql_text(C.PIPEFAIL)})"""


@query(f"SELECT event_id, user_id, kind, evidence FROM ({HAZARD_SQL})")
def hazard_scan(spark, d):
    return classify.hazards(with_command(calls(spark, d)), "command").select("event_id", "user_id", "kind", "evidence")


@query(f"SELECT user_id, kind, arg_min(evidence, {{'t': ts, 'e': event_id}}) AS evidence, count(*) AS count FROM ({HAZARD_SQL}) GROUP BY user_id, kind")
def hazard_summary(spark, d):
    return classify.hazard_summary(classify.hazards(with_command(calls(spark, d)), "command"), ["user_id"], F.struct("ts", "event_id"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'cd /a && cd "b c";  mix   test' ELSE event_type END AS command, CASE WHEN event_type = 'click' THEN 'mix test' ELSE event_type END AS cleaned,
  CASE WHEN event_type = 'click' THEN 'cd /a' ELSE event_type END AS two FROM events""")
def command_cleaning(spark, d):
    rows = calls(spark, d).withColumn("command", F.when(F.col("event_type") == "click", 'cd /a && cd "b c";  mix   test').otherwise(F.col("event_type")))
    return rows.select("event_id", "command", T.command_key("command").alias("cleaned"), F.array_join(T.first_words("command"), " ").alias("two"))


def _untagged(sql: str) -> str:
    for tag in C.HARNESS_TAGS:
        sql = f"regexp_replace({sql}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', '', 'g')"
    return f"regexp_replace({sql}, '(?m)^[ \\t]*Another Claude session sent a message:[ \\t]*$', '', 'g')"


_TAG = f"{C.HARNESS_TAGS}[CAST(doc_id % 7 AS INTEGER) + 1]"
HARNESSED = f"""'<' || {_TAG} || ' a="b">' || text || '</' || {_TAG} || '>' || chr(10) || lang || ' <command-name>x</command-name><note>' || source || '</note>' || chr(10) || '  Another Claude session sent a message: ' || chr(10) || 'so'"""


@query(f"SELECT doc_id, trim(regexp_replace({_untagged(HARNESSED)}, '\\s+', ' ', 'g')) AS kept FROM documents")
def strip_harness(spark, d):
    """Each of the tags around a text, one more within it, and a line that the harness adds."""
    tag = F.element_at(F.array(*map(F.lit, C.HARNESS_TAGS)), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.concat(
        F.lit("<"), tag, F.lit(' a="b">'), "text", F.lit("</"), tag, F.lit(">\n"), "lang", F.lit(" <command-name>x</command-name><note>"), "source", F.lit("</note>\n  Another Claude session sent a message: \nso"),
    )
    return table(spark, d, "documents").select("doc_id", T.collapse(T.without_harness(text)).alias("kept"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT o_orderkey FROM o, n WHERE r IN (SELECT i * n // 100 FROM range(100) t(i), n)""")
def even_spread_sample(spark, d):
    return rank.even_spread(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 37 = 0 ORDER BY r LIMIT 50")
def stride_sample(spark, d):
    return rank.every_nth(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 37, 50)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_n_after_rank(spark, d):
    return rank.ranked(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], ["c_custkey"], 25)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) = 1")
def dedupe_richest(spark, d):
    rows = table(spark, d, "orders")
    return rank.dedupe_richest(rows, "o_custkey", [F.desc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def scope_filter(spark, d):
    return table(spark, d, "customer").where(rank.Scope(root="BUILDING", narrowed=True).member("c_mktsegment")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'MACHINERY'")
def facet_filter(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rank.facets(rows, r_name="ASIA", c_mktsegment="MACHINERY", n_name=None).select("c_custkey", "n_name", "r_name")


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND lang <> ''")
def facet_values(spark, d):
    return rank.facet_values(table(spark, d, "documents"), "lang")


GLOBS = ["**/en/*.html", "fr/**", "{de,es}/?[0-9]*"]


@query(r"SELECT page_id, regexp_matches(url, '(^|/)(?:.*/)?en/[^/]*\.html$') AS en_html, regexp_matches(url, '(^|/)fr/.*$') AS fr, regexp_matches(url, '(^|/)(?:de|es)/[^/][^/]*$') AS other FROM pages")
def glob_match(spark, d):
    return table(spark, d, "pages").select("page_id", *[F.col("url").rlike(T.glob_pattern(g)).alias(n) for g, n in (("**/en/*.html", "en_html"), ("fr/**", "fr"), ("{de,es}/?*", "other"))])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_session(spark, d):
    return rank.newest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 500)")
def prune_all_but_newest(spark, d):
    return rank.prune(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 500)


def _stamps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    current = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("stamp"))
    stored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("at"))
    return current, stored.join(current, "key").select("key", F.when(F.col("at") > F.col("stamp"), F.col("stamp")).otherwise(F.col("at")).alias("stamp"))


@query("""WITH s AS (SELECT l_orderkey AS key, least(l_shipdate, o_orderdate) AS stamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey AS key, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.key = o_orderkey AND s.stamp = o_orderdate) THEN 'reused' ELSE 'computed' END AS source FROM orders""")
def cache_semi_anti(spark, d):
    reused, fresh = relate.cache_split(*_stamps(spark, d), ["key", "stamp"])
    return reused.select("key", F.lit("reused").alias("source")).unionByName(fresh.select("key", F.lit("computed").alias("source")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def missing_parts(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT p_brand, coalesce(array_to_string(list_sort(list_filter(list_distinct(array_agg(p_type)), lambda x: x NOT IN ('ECONOMY', 'SMALL', 'LARGE'))), ','), '') AS missing FROM part GROUP BY p_brand""")
def missing_refs(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("refs"))
    return rows.select("p_brand", F.array_join(relate.missing(F.col("refs"), F.array(*map(F.lit, ["ECONOMY", "SMALL", "LARGE"]))), ",").alias("missing"))


@query("""WITH r AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(bad, false) AS errored FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def left_join_error_index(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("session"))
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("session"), (F.col("l_returnflag") == "R").alias("bad"))
    return signals.errored_calls(orders, results, "session", "id", "bad").select(F.col("id").alias("o_orderkey"), "errored")


INSTALLS = "(SELECT n_nationkey, n_name, CAST('1995-01-01' AS TIMESTAMP) + to_days(n_nationkey * 60) AS installed FROM nation)"


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name", F.expr("timestamp'1995-01-01' + make_dt_interval(n_nationkey * 60)").alias("at"))


@query(f"SELECT n_name, count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS later_orders FROM {INSTALLS} s LEFT JOIN orders ON o_orderdate >= installed GROUP BY n_name")
def theta_after_install(spark, d):
    return relate.sessions_after(_skills(spark, d), table(spark, d, "orders"), "n_name", "at", "o_orderdate", "later_orders")


FEEDBACK = """SELECT n_name, count(o_orderkey) AS sessions, count(*) FILTER (WHERE used) AS used, CASE WHEN count(o_orderkey) > 0 THEN round(count(*) FILTER (WHERE used) / count(o_orderkey), 3) END AS usage_rate,
  round(avg(price) FILTER (WHERE used), 3) AS friction_with, round(avg(price) FILTER (WHERE NOT used), 3) AS friction_without,
  CASE WHEN count(o_orderkey) = 0 THEN 'no_sessions' WHEN count(*) FILTER (WHERE used) = 0 THEN 'unused' WHEN count(*) FILTER (WHERE used) * 10 < count(o_orderkey) THEN 'low_usage' ELSE 'active' END AS verdict
FROM (SELECT n_name, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS price, n_nationkey IN (o_custkey % 25, o_custkey % 7) AS used FROM """ + INSTALLS + """ s LEFT JOIN orders ON o_orderdate >= installed) GROUP BY n_name"""


@query(FEEDBACK)
def feedback_report(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    used = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.col("o_custkey") % 25, F.col("o_custkey") % 7)).alias("n_nationkey")).join(names, "n_nationkey").groupBy("o_orderkey").agg(F.collect_list(F.lower("n_name")).alias("used_skills"))
    sessions = table(spark, d, "orders").join(used, "o_orderkey", "left").select("o_orderdate", "used_skills", F.round("o_totalprice").cast("long").alias("price"))
    return relate.feedback(_skills(spark, d), sessions, "n_name", "at", "o_orderdate", "used_skills", "price")


CONFUSION = """SELECT {k} count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, count(*) FILTER (WHERE NOT e AND NOT a) AS tn,
  count(*) FILTER (WHERE e = a) / count(*) AS accuracy,
  CASE WHEN count(*) FILTER (WHERE a) > 0 THEN count(*) FILTER (WHERE e AND a) / count(*) FILTER (WHERE a) WHEN count(*) FILTER (WHERE e) > 0 THEN 0 ELSE 1 END AS "precision",
  CASE WHEN count(*) FILTER (WHERE e) > 0 THEN count(*) FILTER (WHERE e AND a) / count(*) FILTER (WHERE e) ELSE 1 END AS recall FROM ({t})"""
LABELS = "SELECT lang, quality = 1 AS e, toxic = 0 AS a FROM labels JOIN documents USING (doc_id)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query(CONFUSION.format(k="lang,", t=LABELS) + " GROUP BY lang")
def confusion_metrics(spark, d):
    return relate.confusion(_labelled(spark, d), F.col("quality") == 1, F.col("toxic") == 0, ["lang"])


@query(f"""WITH r AS ({CONFUSION.format(k="lang,", t=LABELS)} GROUP BY lang)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, round(sum(tp + tn) / sum(tp + fp + fn + tn), 4) AS accuracy,
  round(sum(tp) / sum(tp + fp), 4) AS "precision", round(sum(tp) / sum(tp + fn), 4) AS recall, round(stddev_pop(accuracy), 4) AS accuracy_stdev, count(*) AS runs FROM r""")
def pooled_trigger(spark, d):
    return relate.pooled(confusion_metrics(spark, d))


FOLDED = f"""SELECT lang, 0.8 AS old, lang = 'fr' AS vetoed, round((0.8 * 0.9 + (accuracy + "precision" + recall) / 3.0 * 0.1) / (0.9 + 0.1), 4) AS composite FROM ({CONFUSION.format(k="lang,", t=LABELS)} GROUP BY lang)"""


@query(f"SELECT lang, vetoed, composite, composite >= 0.79 AND NOT vetoed AS passed FROM ({FOLDED})")
def behavioral_fold(spark, d):
    rows = confusion_metrics(spark, d).withColumn("composite", F.lit(0.8)).withColumn("vetoed", F.col("lang") == "fr")
    return relate.fold_behavioral(rows, F.lit(0.9), 0.79, C.BEHAVIORAL_WEIGHT).select("lang", "vetoed", "composite", "passed")


LINES_SQL = "SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents"
_ACT = r"^\s*(?:" + C.IMPERATIVES + r")\b|^\s*\d+[.)]\s+|^\s*[-*]\s+\*\*|^\s*\|[^|]*\|"
_CON = "|".join(C.CONCRETE)
COUNTS_SQL = f"""SELECT doc_id, len(lines) AS lines, len(regexp_extract_all(text, '\\S+')) AS words,
  len(list_filter(lines, lambda x: regexp_matches(x, '\\S') AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '```') AND regexp_matches(x, '{_ACT}'))) AS actionable,
  len(list_filter(lines, lambda x: regexp_matches(x, '\\S') AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '```'))) AS prose,
  len(list_filter(lines, lambda x: regexp_matches(x, '\\S') AND regexp_matches(x, '{_CON}'))) AS concrete, len(list_filter(lines, lambda x: regexp_matches(x, '\\S'))) AS filled,
  regexp_matches(text, '{"|".join(f"(?:{x})" for x in C.DANGEROUS)}') AS dangerous FROM ({LINES_SQL})"""


@query(f"SELECT doc_id, lines, words, actionable, prose, concrete, filled FROM ({COUNTS_SQL})")
def matcher_counts(spark, d):
    a = artifacts.Artifact.of("text")
    (act, prose), (con, every) = artifacts.action_lines(a), artifacts.concrete_lines(a)
    wanted = {"lines": F.size(a.lines), "words": artifacts.words_of(a), "actionable": act, "prose": prose, "concrete": con, "filled": every}
    return spread(table(spark, d, "documents")).select("doc_id", *[v.cast("long").alias(k) for k, v in wanted.items()])


TEXT_SET = [
    ("conciseness", 0.4, [("line_count", {"target": 5, "tolerance": 1}), ("token_estimate", {"max_tokens": 600})]),
    ("clarity", 0.3, [("action_density", {"min_ratio": 0.05})]),
    ("specificity", 0.3, [("specificity_ratio", {"min_ratio": 0.15}), ("no_dangerous_patterns", {"exempt_safe_sections": False})]),
]


@query(f"""WITH c AS ({COUNTS_SQL}),
s AS (SELECT doc_id, dangerous, (CAST(lines <= 6 AS INTEGER) + CAST(floor(words / 0.75 + 0.5) <= 600 AS INTEGER)) * 5000 AS d1, CAST(prose > 0 AND actionable >= prose * 0.05 AS INTEGER) * 10000 AS d2,
  (CAST(filled > 0 AND concrete >= filled * 0.15 AS INTEGER) + CAST(NOT dangerous AS INTEGER)) * 5000 AS d3 FROM c),
t AS (SELECT doc_id, d1 / 10000 AS dim_conciseness, d2 / 10000 AS dim_clarity, d3 / 10000 AS dim_specificity, dangerous AS vetoed, floor(((d1::BIGINT * 4000 + d2 * 3000 + d3 * 3000) * 20000 + 100000000) / 200000000) / 10000 AS composite FROM s)
SELECT *, composite >= 0.75 AND NOT vetoed AS passed FROM t""")
def weighted_composite_gate(spark, d):
    out = artifacts.score(table(spark, d, "documents").select("doc_id", "text"), "text", TEXT_SET)
    return out.drop("text")


@query(r"""SELECT p_partkey, 'part-' || p_partkey AS name, length('Handles ' || p_name || ' of ' || p_brand || '. Use when ' || lower(p_type)) AS description_chars,
  length('Handles ' || p_name || ' of ' || p_brand || '. Use when ' || lower(p_type)) BETWEEN 40 AND 48 AS fits, p_size >= 10 AS has_laws, 'Usage,' || CASE WHEN p_size >= 10 THEN 'Iron Laws' ELSE 'Notes' END AS headings FROM part""")
def frontmatter_and_sections(spark, d):
    p = table(spark, d, "part")
    md = F.concat(
        F.lit("---\nname: \"part-"), F.col("p_partkey").cast("string"), F.lit("\"\ndescription: Handles "), "p_name", F.lit(" of "), "p_brand", F.lit(". Use when "), F.lower("p_type"),
        F.lit("\n---\n\n# Title\n## Usage\nRun it.\n### "), F.when(F.col("p_size") >= 10, "Iron Laws").otherwise("Notes"), F.lit("\n1. one\n- two\nplain"),
    )
    a = artifacts.Artifact.of("md")
    return p.withColumn("md", md).select(
        "p_partkey", a.field("name").alias("name"), F.length(a.description()).cast("long").alias("description_chars"), artifacts.description_length(a, {"min": 40, "max": 48}).alias("fits"),
        artifacts.has_iron_laws(a, {"min_count": 2}).alias("has_laws"), F.array_join(a.headings, ",").alias("headings"),
    )


PARTS_SQL = "SELECT min(p_partkey) AS id, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda t: length(t) >= 3)) AS t FROM part GROUP BY p_brand, p_name, p_type"


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy("p_brand", "p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    return rows.select("id", "p_brand", T.word_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"))


@query(f"""WITH p AS ({PARTS_SQL}) SELECT a.p_brand, a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) >= 0.5 * len(list_distinct(list_concat(a.t, b.t)))""")
def token_jaccard_pairs(spark, d):
    out = similar.similar_pairs(_proposals(spark, d), "id", "p_brand", "tokens", 0.5)
    return out.select("p_brand", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, least(value, 94) / 100 AS v FROM events),
f AS (SELECT user_id, 0 AS i, n, 0::DOUBLE AS best, 0 AS kept, 0 AS discards FROM s WHERE i = 1 UNION ALL
  SELECT f.user_id, s.i, f.n, CASE WHEN s.v > f.best + 0.02 THEN s.v ELSE f.best END, f.kept + CAST(s.v > f.best + 0.02 AS INTEGER), CASE WHEN s.v > f.best + 0.02 THEN 0 ELSE f.discards + 1 END
  FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1 WHERE f.best < 0.95 AND f.i < 50 AND f.discards < 15)
SELECT user_id, best, kept, discards, i AS iterations, CASE WHEN best >= 0.95 OR i >= 50 THEN 'complete' WHEN discards >= 15 THEN 'stuck' ELSE 'running' END AS status FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def ratchet_fold(spark, d):
    rows = calls(spark, d).withColumn("score", F.least(F.col("value"), F.lit(94.0)) / 100)
    return loop.ratchet_by(rows, "user_id", ORDER, "score", margin=0.02, patience=15)


@query("""SELECT user_id, event_id, value > coalesce(best, 0) AS kept, greatest(coalesce(best, 0), value) AS best FROM (
  SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)""")
def running_best(spark, d):
    return loop.running_best(table(spark, d, "events"), "user_id", ORDER, "value").select("user_id", "event_id", "kept", "best")


@query("SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 2 = 0 THEN 'train' ELSE 'validation' END AS part FROM documents")
def train_validation_split(spark, d):
    return loop.halves(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "part")


@query(f"SELECT doc_id, dim AS weakest, score FROM (SELECT doc_id, unnest(['conciseness', 'clarity', 'specificity']) AS dim, unnest([dim_conciseness, dim_clarity, dim_specificity]) AS score FROM ({ORACLE['weighted_composite_gate']})) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, dim) = 1")
def weakest_dimension(spark, d):
    return loop.weakest(artifacts.long_scores(weighted_composite_gate(spark, d), ["doc_id"], [k for k, _, _ in TEXT_SET]), "doc_id", "dimension", "score")


@query(r"SELECT ext, count(*) AS count FROM (SELECT regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext FROM pages) WHERE ext <> '' GROUP BY ext")
def ext_histogram(spark, d):
    rows = table(spark, d, "pages").select(T.extension("url").alias("ext"))
    return rows.where("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT doc_id, substr(sha256(source), 1, 12) || '-' || substr(sha256(text), 1, 12) AS id FROM documents")
def content_hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(T.short_hash("source"), F.lit("-"), T.short_hash("text")).alias("id"))


@query("SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@query("SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS base, regexp_extract(rtrim(url, '/'), '^(.*)/[^/]*$', 1) AS dir, substr(url, 1, 8) AS short FROM pages")
def path_parts(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", T.base_name("url").alias("base"), T.dir_name("url").alias("dir"), F.substring("url", 1, 8).alias("short"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events""")
def session_forward_fill(spark, d):
    from .sources.transcripts import forward_fill

    rows = table(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return forward_fill(rows, "user_id", ORDER, "mark", "since").select("user_id", "event_id", "since")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS seen, arg_min(event_id, {'t': ts, 'e': event_id}) AS first FROM (SELECT user_id, event_type, min({'t': ts, 'e': event_id}) AS i, min(ts) AS ts, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def referenced_in_order(spark, d):
    from .sources.transcripts import distinct_in_order, first_known

    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(distinct_in_order("event_type", ORDER), ",").alias("seen"), first_known("event_id", ORDER).alias("first"))


@query("""SELECT count(*) AS compared, avg(CAST(abs(l_quantity - (l_quantity + l_discount)) <= 0.05 AS INTEGER)) AS quantity_agreement, avg(CAST(abs(l_tax - l_discount) <= 0.01 AS INTEGER)) AS tax_agreement
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)""")
def parity_agreement(spark, d):
    rows = rank.dedupe_richest(table(spark, d, "lineitem"), "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    left = rows.select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    right = rows.select("l_orderkey", (F.col("l_quantity") + F.col("l_discount")).alias("quantity"), F.col("l_discount").alias("tax"))
    return relate.agreement(left, right, "l_orderkey", {"quantity": 0.05, "tax": 0.01})


@query("SELECT doc_id, sha256(text) <> sha256(lang || text) AS drifted, n_chars <> length(text) AS stale FROM documents")
def drift_and_stale(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", relate.drifted(F.col("text"), F.sha2(F.concat("lang", "text").cast("binary"), 256)).alias("drifted"), relate.stale(F.col("n_chars").cast("string"), F.length("text").cast("string")).alias("stale")
    )


@query(f"""SELECT s.conv_id, (score > 0.35 OR coalesce(opportunity, 0) > 0.5 OR message_count > 50) AS tier2, CASE WHEN message_count >= 4 THEN 'kept' ELSE 'short' END AS gate
FROM ({ORACLE["friction_score"]}) s JOIN ({MESSAGES_SQL}) m ON s.conv_id = m.conv_id LEFT JOIN ({ORACLE["opportunity_rules"]}) o ON o.user_id = s.conv_id""")
def tier_and_gate(spark, d):
    rows = friction_score(spark, d).join(human_turns_per_session(spark, d), "conv_id").join(opportunity_rules(spark, d).withColumnRenamed("user_id", "conv_id"), "conv_id", "left")
    tier = classify.tier_two(F.col("score"), F.coalesce("opportunity", F.lit(0.0)), F.array().cast("array<string>"), F.col("message_count"), F.lit(None).cast("double"))
    return rows.select("conv_id", tier.alias("tier2"), F.when(F.col("message_count") >= C.MIN_MESSAGES, "kept").otherwise("short").alias("gate"))


@query("""WITH c AS (SELECT n_regionkey AS cluster, count(*) AS size FROM nation GROUP BY 1)
SELECT cluster, size, CASE WHEN size = 1 THEN 'kept' WHEN cluster % 2 = 0 THEN 'merged' ELSE 'originals' END AS outcome FROM c""")
def merge_outcomes(spark, d):
    rows = table(spark, d, "nation").withColumnRenamed("n_regionkey", "cluster")
    passed = table(spark, d, "region").select(F.col("r_regionkey").alias("cluster"), (F.col("r_regionkey") % 2 == 0).alias("passed"))
    return similar.merge_outcomes(rows, passed)


@query("SELECT user_id, count(*) AS tool_count, count(*) FILTER (WHERE value > 60) AS errors, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_incremental_scan(spark, d):
    from .streaming.incremental import stream_sessions

    return stream_sessions(spark, d)


# --- dialects: transcripts made of the tables, parsed again


def _lines(rows: DataFrame, path: str, seq: Column, value: Column) -> DataFrame:
    from .sources.transcripts import decoded

    return decoded(rows.select(F.col(path).cast("string").alias("path"), seq.alias("seq"), F.to_json(value).alias("value")))


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS session, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS message_count, count(*) FILTER (WHERE {HUMAN}) AS human_turns,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(min(turn) AS BIGINT) AS first FROM conversations GROUP BY conv_id""")
def parse_dialect_a_messages(spark, d):
    from .sources.transcripts import claude

    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    rows = talk(spark, d)
    plain = _lines(rows.where("turn % 2 = 0"), "conv_id", F.col("turn"), F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.col("conv_id").cast("string").alias("sessionId")))
    blocks = _lines(rows.where("turn % 2 <> 0"), "conv_id", F.col("turn"), F.struct(F.col("role").alias("type"), F.struct("role", block.alias("content")).alias("message"), F.col("conv_id").cast("string").alias("sessionId")))
    events = claude(plain.unionByName(blocks))
    return events.groupBy(F.col("session_id").alias("session")).agg(
        F.count_if(signals.is_message("type")).alias("message_count"), F.count_if(signals.human_turn("type", "text", F.col("is_meta"), F.col("synthetic"))).alias("human_turns"),
        F.sum(F.length("text")).cast("long").alias("chars"), F.min("seq").alias("first"),
    )


def _called(events: DataFrame) -> DataFrame:
    """Calls of parsed events with whether they failed."""
    from .plans.scan import checked_calls

    return checked_calls(events).select(F.col("session_key").alias("session"), "id", "name", "command", "file_path", "errored")


@query("""SELECT CAST(user_id AS VARCHAR) AS session, 'c' || event_id AS id, event_type AS name, props AS command, CASE WHEN event_type = 'view' THEN 'src/a.py' END AS file_path, value > 60 AS errored FROM events""")
def parse_dialect_a_calls(spark, d):
    from .sources.transcripts import claude

    call_id = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    inputs = F.struct(F.col("props").alias("command"), F.when(F.col("event_type") == "view", "src/a.py").alias("file_path"))
    use = F.array(F.struct(F.lit("tool_use").alias("type"), call_id.alias("id"), F.col("event_type").alias("name"), inputs.alias("input")))
    done = F.array(F.struct(F.lit("tool_result").alias("type"), call_id.alias("tool_use_id"), (F.col("value") > 60).alias("is_error")))
    rows = table(spark, d, "events")
    line = lambda role, content, k: _lines(rows, "user_id", F.col("event_id") * 2 + k, F.struct(F.lit(role).alias("type"), F.struct(content.alias("content")).alias("message")))
    return _called(claude(line("assistant", use, 0).unionByName(line("user", done, 1))))


@query("""SELECT CAST(user_id AS VARCHAR) AS session, 'c' || event_id AS id, 'Bash' AS name, 'run ' || event_type AS command, CAST(NULL AS VARCHAR) AS file_path, CAST(floor(value) AS BIGINT) % 3 <> 0 AS errored FROM events""")
def parse_dialect_b_calls(spark, d):
    from .sources.transcripts import codex

    call_id = F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id")
    use = F.struct(F.lit("function_call").alias("type"), F.lit("exec_command").alias("name"), F.to_json(F.struct(F.concat(F.lit("run "), "event_type").alias("cmd"))).alias("arguments"), call_id)
    done = F.struct(F.lit("function_call_output").alias("type"), call_id, F.concat(F.lit("Process exited with code "), (F.floor("value") % 3).cast("string"), F.lit("\nok")).alias("output"))
    rows = table(spark, d, "events")
    line = lambda payload, k: _lines(rows, "user_id", F.col("event_id") * 2 + k, F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    return _called(codex(line(use, 0).unionByName(line(done, 1))))


def _files(rows: DataFrame, message: Column) -> DataFrame:
    """One list of messages for each user, as a file's text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", message.alias("m")))), lambda x: x["m"])
    return rows.groupBy("user_id").agg(listed.alias("_m")).select(F.concat(F.lit("/tasks/t"), F.col("user_id").cast("string"), F.lit("/f.json")).alias("path"), F.to_json("_m").alias("value"), F.lit(None).cast("string").alias("err"))


CALLS_C = """SELECT '{p}' || user_id AS session, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS bash, count(*) FILTER (WHERE event_type = 'view') AS reads,
  count(*) FILTER (WHERE value > 60) AS errors FROM events GROUP BY user_id"""


def _summed(events: DataFrame) -> DataFrame:
    named = lambda n: F.coalesce(F.sum(F.size(F.filter("tool_uses", lambda u: u["name"] == n))), F.lit(0)).alias({"Bash": "bash", "Read": "reads"}[n])
    errors = F.coalesce(F.sum(F.size(F.filter("tool_results", lambda r: r["is_error"]))), F.lit(0)).alias("errors")
    return events.groupBy(F.col("session_id").alias("session")).agg(F.count(F.lit(1)).alias("events"), named("Bash"), named("Read"), errors)


def _tool(click: str, view: str) -> Column:
    return F.when(F.col("event_type") == "click", click).when(F.col("event_type") == "view", view).otherwise(F.col("event_type"))


@query(CALLS_C.format(p="t"))
def parse_dialect_c_sessions(spark, d):
    from .sources.transcripts import cline, cline_rows

    call_id = F.col("event_id").cast("string")
    use = F.struct(F.lit("tool_use").alias("type"), call_id.alias("id"), _tool("execute_command", "read_file").alias("name"), F.struct(F.col("props").alias("command"), F.lit("a.py").alias("path")).alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"))
    done = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command: string, path: string>").alias("input"), call_id.alias("tool_use_id"), (F.col("value") > 60).alias("is_error"))
    message = F.struct(F.lit("assistant").alias("role"), F.array(use, done).alias("content"))
    return _summed(cline(cline_rows(_files(table(spark, d, "events"), message))))


@query(CALLS_C.format(p="f"))
def parse_dialect_d_sessions(spark, d):
    from .sources.transcripts import gemini, gemini_rows

    tool = F.struct(F.col("event_id").cast("string").alias("id"), _tool("run_shell_command", "read_file").alias("name"), F.struct(F.col("props").alias("command")).alias("args"), F.when(F.col("value") > 60, "failed").otherwise("success").alias("status"))
    files = _files(table(spark, d, "events"), F.struct(F.lit("gemini").alias("type"), F.lit("text").alias("content"), F.array(tool).alias("toolCalls")))
    files = files.withColumn("path", F.regexp_replace("path", r"^/tasks/t(\d+)/f\.json$", "/chats/f$1.json"))
    return _summed(gemini(gemini_rows(files)))


@query(CALLS_C.format(p="s"))
def parse_dialect_e_sessions(spark, d):
    from .sources.transcripts import opencode

    rows = table(spark, d, "events")
    session, key = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
    messages = rows.select(key.alias("id"), session.alias("session_id"), F.col("event_id").alias("time_created"), F.lit('{"role":"assistant"}').alias("data"))
    state = F.struct(F.when(F.col("value") > 60, "error").otherwise("completed").alias("status"), F.struct(F.col("props").alias("command")).alias("input"))
    part = F.to_json(F.struct(F.lit("tool").alias("type"), _tool("bash", "read").alias("tool"), key.alias("callID"), state.alias("state")))
    parts = rows.select(key.alias("id"), key.alias("message_id"), F.col("event_id").alias("time_created"), part.alias("data"))
    return _summed(opencode(messages, parts))


# Further queries register themselves.
from . import catalogue_eval, catalogue_scan, catalogue_sources, catalogue_stores  # noqa: E402, F401
