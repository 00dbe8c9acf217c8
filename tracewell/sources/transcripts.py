"""Agent transcripts in five dialects, read into one event schema.

A reader gives rows (path, seq, v or err); a normaliser turns ``v``, one VARIANT for each message,
into the columns of ``EVENT``. Malformed input is a row with ``err``, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import FILE_CAP
from ..functions.text import base_name, dir_name, filled, without_harness

CALL = "struct<name: string, command: string, command_is_string: boolean, file_path: string, path: string, notebook_path: string, skill: string, input: string, id: string>"
RESULT = "struct<tool_use_id: string, is_error: boolean>"
USAGE = "struct<prompt_tokens: bigint, context_window: bigint>"
EVENT = {
    "type": "string", "role": "string", "ts": "timestamp", "uuid": "string", "parent_uuid": "string", "session_id": "string", "text": "string",
    "tool_uses": f"array<{CALL}>", "tool_results": f"array<{RESULT}>", "is_meta": "boolean", "synthetic": "boolean", "usage": USAGE, "cwd": "string",
    "is_compact_summary": "boolean", "subtype": "string", "attribution_skill": "string", "msg_prompt_tokens": "bigint", "msg_model": "string",
}


# --- JSON access: values count only if they have the type that is asked for


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.split(F.schema_of_variant(v), "[<(]")[0]


def text_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(node(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def true_at(v: Column, path: str) -> Column:
    return F.coalesce((kind(node(v, path)) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def long_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(node(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def list_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def none(t: str) -> Column:
    return F.lit(None).cast(t)


def no_blank(text: Column) -> Column:
    return F.when(filled(text), text)


def stamp(v: Column, path: str) -> Column:
    return F.try_to_timestamp(text_at(v, path))


def call(name: Column, arguments: Column, call_id: Column, **fields: Column) -> Column:
    """A tool call; fields that a dialect names otherwise are given, the rest come from the arguments."""
    get = lambda n: fields.get(n, text_at(arguments, f"$.{n}"))
    command = fields.get("command_node", node(arguments, "$.command"))
    plain = F.schema_of_variant(command) == "STRING"
    said = F.coalesce(F.when(plain, command.cast("string")), F.to_json(F.struct(command.alias("c"))))
    return F.struct(
        F.coalesce(name, F.lit("UnknownTool")).alias("name"), F.when(command.isNotNull(), said).alias("command"), F.coalesce(plain, F.lit(False)).alias("command_is_string"),
        get("file_path").alias("file_path"), get("path").alias("path"), get("notebook_path").alias("notebook_path"),
        F.coalesce(text_at(arguments, "$.command"), text_at(arguments, "$.name"), text_at(arguments, "$.skill")).alias("skill"),
        F.to_json(arguments).alias("input"), call_id.alias("id"),
    ).cast(CALL)


def bare_call(name: Column, call_id: Column, file_path: Column | None = None) -> Column:
    """A call without arguments, but for a file that it touches."""
    text = none("string")
    return F.struct(
        name.alias("name"), text.alias("command"), F.lit(False).alias("command_is_string"), (text if file_path is None else file_path).alias("file_path"), text.alias("path"), text.alias("notebook_path"), text.alias("skill"), F.lit("{}").alias("input"), call_id.alias("id"),
    ).cast(CALL)


def result(call_id: Column, is_error: Column) -> Column:
    return F.struct(call_id.alias("tool_use_id"), F.coalesce(is_error, F.lit(False)).alias("is_error")).cast(RESULT)


def block_texts(blocks: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(blocks, keep), lambda b: text_at(b, "$.text")), "\n")


def mapped(name: Column, names: dict[str, str]) -> Column:
    out = name
    for theirs, ours in names.items():
        out = F.when(name == theirs, ours).otherwise(out)
    return out


def typed(role: Column, names: dict[str, str]) -> Column:
    out = F.lit("other")
    for theirs, ours in names.items():
        out = F.when(role == theirs, ours).otherwise(out)
    return out


def events_of(rows: DataFrame, fmt: str, columns: dict[str, Column]) -> DataFrame:
    """Rows as events of a format; rows with ``err`` keep nulls."""
    fine = F.col("err").isNull()
    out = {k: F.when(fine, columns.get(k, none(t))).cast(t) for k, t in EVENT.items()}
    for k in ("tool_uses", "tool_results"):
        out[k] = F.coalesce(out[k], F.array().cast(EVENT[k]))
    for k in ("is_meta", "synthetic", "is_compact_summary"):
        out[k] = F.coalesce(out[k], F.lit(False))
    return rows.select("path", F.col("path").alias("session_key"), F.lit(fmt).alias("format"), "seq", *[v.alias(k) for k, v in out.items()], "err")


# --- readers


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (path, seq, v, err), in file order, blank lines left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.where(filled("value")).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("_block", "_row")))
    return decoded(rows)


def decoded(rows: DataFrame) -> DataFrame:
    """``value`` parsed to ``v``; what isn't an object is an error."""
    rows = rows.withColumn("v", F.try_parse_json("value"))
    err = F.when(F.col("v").isNull(), "undecodable").when(~is_object(F.col("v")), "not_an_object").when(~F.col("value").rlike(r"\}\s*$"), "undecodable")
    return rows.select("path", "seq", F.when(err.isNull(), F.col("v")).alias("v"), err.alias("err"))


def read_files(spark: SparkSession, path: str, glob: str, cap: int = FILE_CAP) -> DataFrame:
    """Whole files as (path, value, err). Larger ones than the cap are errors: a filter on the length keeps Spark from opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.withColumn("_path", F.col("_metadata.file_path"))
    small = files.where(F.col("length") <= cap).select(F.col("_path").alias("path"), F.col("content").cast("string").alias("value"), none("string").alias("err"))
    large = files.where(F.col("length") > cap).select(F.col("_path").alias("path"), none("string").alias("value"), F.lit("too_large").alias("err"))
    return small.unionByName(large)


def file_stamps(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, stamp) of every file: its time and size."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("stamp"))


def _messages(files: DataFrame, listed: Column, **more: Column) -> DataFrame:
    """One row for each message of whole-file sessions."""
    files = files.withColumns({"_list": listed} | more)
    files = files.withColumn("err", F.coalesce("err", F.when(F.col("_list").isNull(), "unexpected_shape")))
    empty = F.coalesce("_list", F.array().cast("array<variant>"))
    rows = files.select("path", "err", *more, F.posexplode_outer(F.when(F.col("err").isNull(), empty)).alias("seq", "v"))
    rows = rows.where(F.col("err").isNotNull() | F.col("seq").isNotNull())
    odd = F.when(F.col("err").isNull() & ~is_object(F.col("v")), "not_an_object")
    return rows.select("path", F.coalesce(F.col("seq") + 1, F.lit(1)).cast("long").alias("seq"), F.when(odd.isNull(), F.col("v")).alias("v"), F.coalesce("err", odd).alias("err"), *more)


# --- dialect A


def claude(rows: DataFrame) -> DataFrame:
    """Self-contained messages, one a line."""
    v = F.col("v")
    there = F.coalesce(node(v, "$.message.content"), node(v, "$.content"))
    rows = rows.withColumn("_content", there)
    content, blocks = F.col("_content"), F.try_variant_get("_content", "$", "array<variant>")
    is_text = lambda b: F.coalesce((text_at(b, "$.type") == "text") & text_at(b, "$.text").isNotNull(), F.lit(False))
    text = no_blank(F.when(kind(content) == "STRING", content.cast("string")).otherwise(block_texts(blocks, is_text)))
    rows = rows.withColumn("_text", text).withColumn("_clean", without_harness("_text"))
    synthetic = F.col("_text").isNotNull() & ~filled("_clean")
    of = lambda t: F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type") == t, F.lit(False)))
    usage = lambda n: F.coalesce(F.when(kind(node(v, f"$.message.usage.{n}")) == "BIGINT", F.try_variant_get(v, f"$.message.usage.{n}", "bigint")), F.lit(0))
    return events_of(rows, "claude", {
        "type": typed(text_at(v, "$.type"), {k: k for k in ("user", "assistant", "system", "summary")}), "role": text_at(v, "$.message.role"), "ts": stamp(v, "$.timestamp"),
        "uuid": text_at(v, "$.uuid"), "parent_uuid": text_at(v, "$.parentUuid"), "session_id": text_at(v, "$.sessionId"), "text": F.when(~synthetic, F.col("_clean")), "synthetic": synthetic,
        "tool_uses": F.transform(of("tool_use"), lambda b: call(text_at(b, "$.name"), node(b, "$.input"), text_at(b, "$.id"))),
        "tool_results": F.transform(of("tool_result"), lambda b: result(text_at(b, "$.tool_use_id"), true_at(b, "$.is_error"))),
        "is_meta": true_at(v, "$.isMeta"), "cwd": text_at(v, "$.cwd"), "is_compact_summary": true_at(v, "$.isCompactSummary"), "subtype": text_at(v, "$.subtype"), "attribution_skill": text_at(v, "$.attributionSkill"),
        "msg_prompt_tokens": F.when(is_object(node(v, "$.message.usage")), usage("input_tokens") + usage("cache_creation_input_tokens") + usage("cache_read_input_tokens")), "msg_model": text_at(v, "$.message.model"),
    })


# --- dialect B

#: A fixed value: the lines of a patch that name its files.
PATCHED = r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"


def failed_output(out: Column) -> Column:
    code = F.regexp_extract(out, r"Process exited with code (\d+)", 1)
    return F.coalesce(F.when(code != "", code != "0").otherwise(F.contains(out, F.lit("SandboxDenied")) | out.rlike(r"\A\w+ failed:")), F.lit(False))


def codex(rows: DataFrame) -> DataFrame:
    """Typed event lines; the session's id is on its first line only."""
    # Each step's columns are read several times by the next one, so Spark computes them once instead of writing them out at every place.
    v, p = F.col("v"), F.col("_p")
    rows = rows.withColumns({"_t": text_at(v, "$.type"), "_p": node(v, "$.payload")})
    rows = rows.withColumns({"_kind": F.when(is_object(p), text_at(p, "$.type")), "_name": text_at(p, "$.name"), "_call": text_at(p, "$.call_id"), "_out": text_at(p, "$.output")})
    t, of = F.col("_t"), F.col("_kind")
    shape = F.when((t == "session_meta") & is_object(p), "meta").when((t == "event_msg") & of.isin("user_message", "agent_message", "token_count"), of)
    shape = shape.when((t == "response_item") & of.isin("function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output"), of).otherwise("inert")
    rows = rows.withColumn("_s", shape)
    s, args, name, out = F.col("_s"), F.col("_args"), F.col("_name"), F.col("_out")
    call_id = F.coalesce("_call", text_at(p, "$.id"))
    rows = rows.withColumn("_args", F.when(s == "function_call", F.try_parse_json(text_at(p, "$.arguments"))))
    is_exec, is_view = (F.coalesce(name == n, F.lit(False)) for n in ("exec_command", "view_image"))
    own = lambda n: F.when(~is_exec & ~is_view, text_at(args, f"$.{n}"))
    named = F.when(is_exec, "Bash").when(is_view, "Read").when(name == "write_stdin", "WriteStdin").otherwise(name)
    rows = rows.withColumns({"_command": F.when(is_exec, node(args, "$.cmd")).otherwise(node(args, "$.command")), "_inner": F.when(s == "custom_tool_call_output", F.try_parse_json(out))})
    command, inner = F.col("_command"), F.col("_inner")
    function = call(named, args, call_id, command_node=command, file_path=F.when(is_view, text_at(args, "$.path")).otherwise(own("file_path")), path=own("path"), notebook_path=own("notebook_path"))
    rows = rows.withColumn("_files", F.when((s == "custom_tool_call") & (name == "apply_patch"), F.regexp_extract_all(text_at(p, "$.input"), F.lit(PATCHED), F.lit(1))))
    files = F.coalesce("_files", F.array().cast("array<string>"))
    edits = F.transform(files, lambda f, i: bare_call(F.lit("Edit"), F.concat(call_id, F.lit("#"), i.cast("string")), F.trim(f)))
    patch = F.when(F.size(files) > 0, edits).otherwise(F.array(bare_call(F.lit("Edit"), call_id)))
    custom = F.when(name == "apply_patch", patch).otherwise(F.array(bare_call(F.coalesce(name, F.lit("CustomTool")), call_id)))
    code, said = long_at(inner, "$.metadata.exit_code"), text_at(inner, "$.output")
    custom_failed = F.when(code.isNotNull(), code != 0).when(said.isNotNull(), failed_output(said)).otherwise(failed_output(out))
    result_id = F.col("_call")
    prompt, window = long_at(p, "$.info.last_token_usage.input_tokens"), long_at(p, "$.info.model_context_window")
    out_rows = events_of(rows, "codex", {
        "type": F.when(s.isin("user_message", "function_call_output", "custom_tool_call_output"), "user").when(s.isin("agent_message", "function_call", "custom_tool_call"), "assistant").otherwise("other"),
        "ts": stamp(v, "$.timestamp"), "session_id": F.when(s == "meta", F.coalesce(text_at(p, "$.session_id"), text_at(p, "$.id"))), "cwd": F.when(s == "meta", text_at(p, "$.cwd")),
        "text": F.when(s.isin("user_message", "agent_message"), no_blank(text_at(p, "$.message"))), "is_meta": s.isin("meta", "token_count"),
        "tool_uses": F.when(s == "function_call", F.array(function)).when(s == "custom_tool_call", custom),
        "tool_results": F.when(s == "function_call_output", F.array(result(result_id, failed_output(out)))).when(s == "custom_tool_call_output", F.array(result(result_id, custom_failed))),
        "usage": F.when((s == "token_count") & prompt.isNotNull(), F.struct(prompt.alias("prompt_tokens"), F.when(window > 0, window).alias("context_window"))),
    })
    return forward_fill(out_rows, "path", ["seq"], "session_id", "session_id")


# --- dialect C

#: A tool's name in the dialect, to the one that all dialects share.
CLINE_TOOLS = {"execute_command": "Bash", "read_file": "Read", "write_to_file": "Write", "replace_in_file": "Edit", "search_files": "Grep"}
CLINE_FILES = ["read_file", "write_to_file", "replace_in_file"]


def cline_files(spark: SparkSession, path: str, cap: int = FILE_CAP) -> DataFrame:
    return cline_rows(read_files(spark, path, "api_conversation_history.json", cap))


def cline_rows(files: DataFrame) -> DataFrame:
    """Messages of (path, value, err)."""
    return _messages(files, F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"))


def cline(rows: DataFrame) -> DataFrame:
    """A whole file with a list of messages; the session's id is its folder's name."""
    v = F.col("v")
    blocks, role = list_at(v, "$.content"), text_at(v, "$.role")
    of = lambda t: F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type") == t, F.lit(False)))

    def use(b: Column) -> Column:
        name, args = text_at(b, "$.name"), node(b, "$.input")
        at_path = F.when(name.isin(*CLINE_FILES), text_at(args, "$.path")).when(name == "execute_command", none("string")).otherwise(text_at(args, "$.file_path"))
        return call(mapped(name, CLINE_TOOLS), args, text_at(b, "$.id"), file_path=at_path, path=F.when(~name.isin(*CLINE_FILES, "execute_command"), text_at(args, "$.path")))

    is_text = lambda b: F.coalesce((text_at(b, "$.type") == "text") & text_at(b, "$.text").isNotNull(), F.lit(False))
    return events_of(rows, "cline", {
        "type": typed(role, {"user": "user", "assistant": "assistant"}), "role": role, "session_id": base_name(dir_name("path")), "text": no_blank(F.coalesce(text_at(v, "$.content"), block_texts(blocks, is_text))),
        "tool_uses": F.transform(of("tool_use"), use), "tool_results": F.transform(of("tool_result"), lambda b: result(text_at(b, "$.tool_use_id"), true_at(b, "$.is_error"))),
    })


# --- dialect D

#: As above.
GEMINI_TOOLS = {"run_shell_command": "Bash", "read_file": "Read", "write_file": "Write", "replace": "Edit", "glob": "Glob", "search_file_content": "Grep"}
GEMINI_FILES = ["read_file", "write_file", "replace"]


def gemini_files(spark: SparkSession, path: str, cap: int = FILE_CAP) -> DataFrame:
    return gemini_rows(read_files(spark, path, "*.json*", cap))


def gemini_rows(files: DataFrame) -> DataFrame:
    """Messages of (path, value, err): an object with messages, a bare list, or lines of which the last with messages wins (lines that don't parse are left out)."""
    each = F.filter(F.split("value", "\n"), lambda x: filled(x))
    # The parser stops after a first value, so what begins with a line that parses alone is lines.
    many = (F.size(each) > 1) & F.try_parse_json(F.try_element_at(each, F.lit(1))).isNotNull()
    whole = F.when(~F.coalesce(many, F.lit(False)), F.try_parse_json("value"))
    lines = F.filter(F.transform(each, lambda x: F.try_parse_json(x)), lambda x: is_object(x))
    files = files.withColumns({"_whole": whole, "_lines": F.when(whole.isNull(), lines)})
    files = files.withColumn("_last", F.try_element_at(F.filter("_lines", lambda x: list_at(x, "$.messages").isNotNull()), F.lit(-1)))
    listed = F.coalesce(list_at(F.col("_whole"), "$.messages"), list_at(F.col("_whole"), "$"), list_at(F.col("_last"), "$.messages"), F.when(F.size("_lines") > 0, F.col("_lines")))
    own = lambda c: F.coalesce(text_at(F.col(c), "$.sessionId"), text_at(F.col(c), "$.session_id"))
    sid = F.coalesce(own("_whole"), own("_last"), F.regexp_replace(base_name("path"), r"\.[^.]*$", ""))
    return _messages(files, listed, sid=sid)


def gemini(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    role = F.coalesce(text_at(v, "$.role"), text_at(v, "$.type"))
    rows = rows.withColumns({"_parts": F.coalesce(list_at(v, "$.content"), F.when(node(v, "$.content").isNull(), list_at(v, "$.parts"))), "_calls": list_at(v, "$.toolCalls"), "_role": role})
    parts, tools, role = F.col("_parts"), F.col("_calls"), F.col("_role")
    own = F.coalesce(F.size(tools) > 0, F.lit(False))

    def use(name: Column, args: Column, call_id: Column) -> Column:
        at_path = F.coalesce(text_at(args, "$.file_path"), text_at(args, "$.absolute_path"), text_at(args, "$.path"))
        plain = ~F.coalesce(name.isin(*GEMINI_FILES, "run_shell_command"), F.lit(False))
        return call(
            mapped(name, GEMINI_TOOLS), args, call_id, path=F.when(plain, text_at(args, "$.path")), notebook_path=F.when(plain, text_at(args, "$.notebook_path")),
            file_path=F.when(name.isin(*GEMINI_FILES), at_path).when(plain, text_at(args, "$.file_path")),
        )

    there = lambda n: n.isNotNull() & (kind(n) != "VOID")
    bad_call = lambda c: F.coalesce(text_at(c, "$.status").isin("error", "failed", "cancelled"), F.lit(False)) | F.coalesce(there(node(c, "$.result.error")), F.lit(False))
    bad_answer = lambda r: F.coalesce(there(node(r, "$.response.error")), F.lit(False)) | F.coalesce(there(node(r, "$.response.output.error")), F.lit(False))
    objects = F.filter(tools, is_object)
    within = lambda n: F.transform(F.filter(parts, lambda b: is_object(node(b, f"$.{n}"))), lambda b: node(b, f"$.{n}"))
    text = F.coalesce(text_at(v, "$.content"), F.when(node(v, "$.content").isNull(), text_at(v, "$.parts")), block_texts(parts, lambda b: text_at(b, "$.text").isNotNull()))
    return events_of(rows, "gemini", {
        "type": typed(role, {"user": "user", "model": "assistant", "assistant": "assistant", "gemini": "assistant", "system": "system"}), "role": role, "session_id": F.col("sid"), "text": no_blank(text),
        "tool_uses": F.when(own, F.transform(objects, lambda c: use(text_at(c, "$.name"), node(c, "$.args"), text_at(c, "$.id")))).otherwise(F.transform(within("functionCall"), lambda c: use(text_at(c, "$.name"), node(c, "$.args"), text_at(c, "$.id")))),
        "tool_results": F.when(own, F.transform(objects, lambda c: result(text_at(c, "$.id"), bad_call(c)))).otherwise(F.transform(within("functionResponse"), lambda c: result(text_at(c, "$.id"), bad_answer(c)))),
    })


# --- dialect E

#: As above.
OPENCODE_TOOLS = {"bash": "Bash", "read": "Read", "write": "Write", "edit": "Edit", "grep": "Grep", "glob": "Glob"}


def opencode(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Tables of messages and their parts (a message may have none); sessions in order of time and id."""
    each = parts.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "id", "data"))), lambda x: F.try_parse_json(x["data"])).alias("_parts"))
    rows = messages.join(each, messages["id"] == each["message_id"], "left")
    order = Window.partitionBy("session_id").orderBy("time_created", "id")
    err = F.col("err") if "err" in messages.columns else none("string")
    rows = rows.select(F.col("session_id").alias("path"), F.row_number().over(order).cast("long").alias("seq"), text_at(F.try_parse_json("data"), "$.role").alias("_role"), "_parts", err.alias("err"))
    blocks, role = F.filter("_parts", is_object), F.col("_role")
    of = lambda *t: F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type").isin(*t), F.lit(False)))

    def use(b: Column) -> Column:
        name, args = text_at(b, "$.tool"), node(b, "$.state.input")
        at_path = F.coalesce(text_at(args, "$.filePath"), text_at(args, "$.file_path"), text_at(args, "$.path"))
        plain = ~F.coalesce(name.isin("read", "write", "edit", "bash"), F.lit(False))
        return call(
            mapped(name, OPENCODE_TOOLS), args, text_at(b, "$.callID"), path=F.when(plain, text_at(args, "$.path")), notebook_path=F.when(plain, text_at(args, "$.notebook_path")),
            file_path=F.when(name.isin("read", "write", "edit"), at_path).when(plain, text_at(args, "$.file_path")),
        )

    edit = lambda f: bare_call(F.lit("Edit"), none("string"), f.cast("string"))
    uses = F.flatten(F.transform(of("tool", "patch"), lambda b: F.when(text_at(b, "$.type") == "tool", F.array(use(b))).otherwise(F.transform(F.coalesce(list_at(b, "$.files"), F.array().cast("array<variant>")), edit))))
    is_text = lambda b: F.coalesce((text_at(b, "$.type") == "text") & text_at(b, "$.text").isNotNull(), F.lit(False))
    return events_of(rows, "opencode", {
        "type": typed(role, {"user": "user", "assistant": "assistant"}), "role": role, "session_id": F.col("path"), "text": no_blank(block_texts(blocks, is_text)),
        "tool_uses": uses, "tool_results": F.transform(of("tool"), lambda b: result(text_at(b, "$.callID"), text_at(b, "$.state.status") == "error")),
    })


def session_index(sessions: DataFrame, messages: DataFrame, provider: str = "claude") -> DataFrame:
    """Rows for ``claude`` from an index of sessions and their messages: the messages' JSON in its envelope again."""
    kept = sessions.where(F.col("provider") == provider).select(F.col("id").alias("_sid"), F.col("session_id").alias("_session"))
    rows = messages.join(kept, messages["session_id"] == kept["_sid"])
    order = Window.partitionBy("_session").orderBy("sequence", "id")
    rows = rows.withColumns({"seq": F.row_number().over(order).cast("long"), "_m": F.try_parse_json("content")})
    envelope = F.to_variant_object(F.struct(
        F.col("type"), F.col("_m").alias("message"), F.col("timestamp"), F.col("uuid"), F.col("parent_uuid").alias("parentUuid"), F.col("_session").alias("sessionId"), (F.col("is_sidechain") == 1).alias("isSidechain")
    ))
    fine = is_object(F.col("_m"))
    return rows.select(F.col("_session").alias("path"), "seq", F.when(fine, envelope).alias("v"), F.when(~fine, "unparseable_content").alias("err"))


# --- sequences


def forward_fill(rows: DataFrame, key: str, order: list[str], column: str, alias: str) -> DataFrame:
    """Each row's last known value so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(alias, F.last(column, ignorenulls=True).over(w))


def first_known(column: str, order: list[str]) -> Column:
    """The first value that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))


def distinct_in_order(column: str, order: list[str]) -> Column:
    """Distinct values in order of their first appearance."""
    listed = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v")))))
    return F.array_distinct(F.transform(listed, lambda x: x["_v"]))


# --- registry

Reader = Callable[..., DataFrame]


def _literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def ranges(keys: DataFrame, key: str, parts: int, quoted: str | None = None) -> list[str]:
    """SQL conditions that deal rows to about equal ranges of a key, of any type that can be ordered: the bounds are those by which Spark would deal the keys."""
    dealt = keys.select(F.col(key).alias("k")).where("k IS NOT NULL").repartitionByRange(parts, "k")
    bounds = sorted(r.k for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect())[:-1]
    if not bounds:
        return ["1 = 1"]
    said, key = [_literal(b) for b in bounds], quoted or key
    middle = [f"{key} > {a} AND {key} <= {b}" for a, b in zip(said, said[1:])]
    return [f"{key} <= {said[0]} OR {key} IS NULL", *middle, f"{key} > {said[-1]}"]


def relation(spark: SparkSession, path: str, name: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table of a relational store: by JDBC, where filters and columns reach the database, or from an export (Parquet, else JSON lines).

    By JDBC and with ``parts``, ranges of ``key`` are read by a task each; only keys are read to find them.
    """
    if path.startswith("jdbc:"):
        whole = spark.read.format("jdbc").options(url=path, dbtable=name, **options).load()
        if parts <= 1 or key is None:
            return whole
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(path).quoteIdentifier(key)
        return spark.read.jdbc(path, name, predicates=ranges(whole.select(key), key, parts, quoted), properties=options)
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")
    if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return spark.read.parquet(f"{path}/{name}.parquet")
    return spark.read.json(f"{path}/{name}.json*")


def capped(messages: DataFrame, parts: DataFrame, cap: int = FILE_CAP) -> tuple[DataFrame, DataFrame]:
    """Messages and parts of sessions whose parts have at most ``cap`` bytes, and of larger ones the first message alone, without parts, with ``err``."""
    sizes = parts.join(messages.select(F.col("id").alias("message_id"), F.col("session_id").alias("_s")), "message_id").groupBy("_s").agg(F.sum(F.octet_length("data")).alias("_bytes"))
    large = sizes.where(F.col("_bytes") > cap).select(F.col("_s").alias("session_id"), F.lit(True).alias("_large"))
    marked = messages.join(large, "session_id", "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("time_created", "id")) == 1
    kept = marked.withColumn("_first", first).where(~F.col("_large") | F.col("_first"))
    out = kept.select(*messages.columns, F.when(F.col("_large"), "too_large").alias("err"))
    return out, parts.join(out.where("err IS NULL").select(F.col("id").alias("message_id")), "message_id", "left_semi")


def read_store(spark: SparkSession, path: str, fmt: str = "opencode", session: str | None = None, parts: int = 1, provider: str = "claude", cap: int = FILE_CAP, **options: str) -> DataFrame:
    """Events of a relational store, of all its sessions or one: conditions on session and provider reach the database, and tables are read by ranges of their keys."""
    of = lambda df, c: df if session is None else df.where(F.col(c) == session)
    if fmt == "opencode":
        messages = of(relation(spark, path, "message", "id", parts, **options), "session_id")
        every = relation(spark, path, "part", "message_id", parts, **options)
        every = of(every, "session_id") if "session_id" in every.columns else every
        return opencode(*capped(messages, every, cap))
    if fmt != "index":
        raise ValueError(f"no relational store of format {fmt!r}")
    sessions = of(relation(spark, path, "sessions", "id", parts, **options).where(F.col("provider") == provider), "session_id")
    return claude(session_index(sessions, relation(spark, path, "messages", "session_id", parts, **options), provider))


@dataclass(frozen=True)
class Source:
    """A kind of transcripts: how its events are read, how its handles are found, and what says that one has changed."""

    parse: Reader
    #: From session and path to (handle, label).
    discover: Reader
    #: From session and path to (handle, stamp).
    stamp: Reader


def _in_files(parse: Reader, glob: str) -> Source:
    files = lambda spark, path: file_stamps(spark, path, glob).withColumnRenamed("path", "handle")
    return Source(parse, lambda spark, path: files(spark, path).select("handle", base_name(dir_name("handle")).alias("label")), files)


def _in_store(parse: Reader, name: str, key: str, label: str) -> Source:
    def handles(spark: SparkSession, path: str) -> DataFrame:
        return relation(spark, path, name).select(F.concat(F.lit(f"{path}#"), F.col(key).cast("string")).alias("handle"), F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("_id"))

    def stamps(spark: SparkSession, path: str) -> DataFrame:
        files = None if path.startswith("jdbc:") else file_stamps(spark, path)
        return store_stamps(handles(spark, path), files)

    return Source(parse, lambda spark, path: handles(spark, path).select("handle", "label"), stamps)


def fingerprint(files: DataFrame) -> str:
    """One text for the stamps of any number of files, in whatever order: their number and what their hashes come to, added up in parts."""
    h = lambda k: F.xxhash64(F.lit(k), "path", "stamp")
    r = files.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h(1)), F.lit(0)), F.coalesce(F.bit_xor(h(2)), F.lit(0))).first()
    return "{}:{:016x}{:016x}".format(r[0], *(x & (1 << 64) - 1 for x in r[1:]))


def store_stamps(handles: DataFrame, files: DataFrame | None) -> DataFrame:
    """(handle, stamp) of a store's sessions: the fingerprint of all its files, also of what it has not yet merged into its main one (``-wal``), and the session's id."""
    whole = "" if files is None else fingerprint(files)
    return handles.select("handle", F.concat(F.lit(f"{whole}|"), "_id").alias("stamp"))


FORMATS: dict[str, Source] = {
    "claude": _in_files(lambda spark, path: claude(read_lines(spark, path)), "*.jsonl"),
    "codex": _in_files(lambda spark, path: codex(read_lines(spark, path)), "*.jsonl"),
    "cline": _in_files(lambda spark, path: cline(cline_files(spark, path)), "api_conversation_history.json"),
    "gemini": _in_files(lambda spark, path: gemini(gemini_files(spark, path)), "*.json*"),
    "opencode": _in_store(lambda spark, path: read_store(spark, path, "opencode"), "session", "id", "directory"),
    "index": _in_store(lambda spark, path: read_store(spark, path, "index"), "sessions", "session_id", "project_path"),
}


def register(name: str, source: Source | Reader) -> None:
    """Add a format: a source, or only a function from session and path to events of files."""
    FORMATS[name] = source if isinstance(source, Source) else _in_files(source, "*")


def source(fmt: str) -> Source:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[fmt]


def read_events(spark: SparkSession, path: str, fmt: str = "claude") -> DataFrame:
    """The events of all transcripts below a path."""
    return source(fmt).parse(spark, path)


def split_handle(handle: str, exists: Callable[[str], bool]) -> tuple[str, str | None]:
    """A store's path and the session after the last ``#``, unless the whole is a path."""
    head, mark, tail = handle.rpartition("#")
    return (handle, None) if not mark or exists(handle) else (head, tail)


def handle_parts(handle: Column | str, is_path: Column) -> Column:
    """``split_handle`` of a column: (path, session), where ``is_path`` says that the whole is a path."""
    h = F.col(handle) if isinstance(handle, str) else handle
    whole = is_path | ~F.contains(h, F.lit("#"))
    tail = F.substring_index(h, "#", -1)
    head = h.substr(F.lit(1), F.length(h) - F.length(tail) - 1)
    return F.struct(F.when(whole, h).otherwise(head).alias("path"), F.when(~whole, tail).alias("session"))
