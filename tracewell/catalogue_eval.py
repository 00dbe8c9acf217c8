"""Queries over artifact scoring: every matcher, the eval sets, evidence and routes, over markdown and scripts made of ``part``.

Artifacts are built so that each check's outcome follows from a part's size and key, which is what
the SQL says; nothing of the matchers' logic is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .functions import constants as C
from .operators import artifacts as A
from .operators import edits, loop, rank
from .plans.session import spread, table

#: A flag of a part, as SQL and as a column.
FLAGS = {
    "usage": "p_size % 2 = 0", "references": "p_size % 3 = 0", "laws": "p_size % 5 <> 0", "long": "p_size % 7 = 0", "vague": "p_size % 11 = 0", "when": "p_partkey % 3 <> 0", "short": "p_partkey % 13 = 0",
    "example": "p_partkey % 2 = 0", "danger": "p_partkey % 17 = 0", "safe": "p_partkey % 34 = 0", "file": "p_partkey % 5 = 0", "skill": "p_partkey % 7 = 0", "agent": "p_partkey % 9 = 0", "act": "p_partkey % 4 <> 0", "concrete": "p_size % 4 <> 0",
}


def _flag(name: str) -> Column:
    return F.expr(FLAGS[name].replace("<>", "!="))


def skills(spark: SparkSession, d: str) -> DataFrame:
    """A skill for each part: frontmatter, sections, laws, examples, references."""
    on = lambda name, yes, no="": F.when(_flag(name), yes).otherwise(no)
    lines = "\n".join(f"plain line {k} of prose" for k in range(45))
    rows = "\n".join(f"Run `step {k}`" for k in range(20))
    md = F.concat(
        F.lit("---\nname: part-"), F.col("p_partkey").cast("string"), F.lit("\ndescription: "),
        F.when(_flag("short"), F.lit("Short text")).otherwise(F.concat(F.lit("Sorts parts of every kind by "), on("vague", "various", "many"), F.lit(" rules. "), on("when", "Use when parts are mixed.", "Parts are mixed."))),
        F.lit("\n---\n\n# Title\n\n## "), on("usage", "Usage", "Manner"), F.lit("\n"), on("act", rows, lines[:400]), F.lit("\n\n## "), on("references", "References", "Sources"), F.lit("\n"), on("concrete", "See `a.b.c` and /x/y.z\n" * 12, "see there\n"),
        F.lit("\n## Iron Laws\n"), on("laws", "1. one\n2. two\n- three\n", "1. one\n"), F.lit("\n## "), on("safe", "Red Flags", "Steps"), F.lit("\n"), on("danger", "sudo rm x\n"), on("long", lines + "\n"),
        on("example", "```bash\nmake a\nmake b\n```\n"), on("file", "references/known.md and references/lost.md\n", "references/known.md\n"), on("skill", "[[lost-skill]] and [[known-skill]]\n"), on("agent", "`lost-reviewer`\n", "`known-reviewer`\n"),
    )
    return spread(table(spark, d, "part")).select("p_partkey", md.alias("md"), F.col("p_partkey").cast("string").alias("key"))


REFS = {"known_files": ["references/known.md"], "known_skills": ["known-skill"], "known_agents": ["known-reviewer"]}
CHECKS = {
    "usage": ("section_exists", {"section": "Usage"}), "references": ("section_exists", {"section": "references"}), "laws": ("has_iron_laws", {"min_count": 3}), "one_law": ("has_iron_laws", {}), "sections": ("max_section_lines", {"max": 40}),
    "name": ("frontmatter_field", {"field": "name"}), "effort": ("frontmatter_field", {"field": "effort"}), "described": ("description_length", {"min": 20, "max": 250}), "keywords": ("description_keywords", {"keywords": ["PARTS", "rules", "kind"], "min": 3}),
    "clear": ("description_no_vague", {}), "structured": ("description_structure", {}), "present": ("content_present", {"pattern": "lost-skill"}), "absent": ("content_absent", {"pattern": "sudo"}), "invalid": ("content_present", {"pattern": "("}),
    "harmless": ("no_dangerous_patterns", {}), "harmless_all": ("no_dangerous_patterns", {"exempt_safe_sections": False}), "examples": ("has_examples", {"min_blocks": 1}), "files": ("valid_file_refs", {}), "skills": ("valid_skill_refs", {}), "agents": ("valid_agent_refs", {}),
    "active": ("action_density", {"min_ratio": 0.25}), "unheard": ("no_such_check", {}),
}
EXPECTED = {
    "usage": FLAGS["usage"], "references": FLAGS["references"], "laws": FLAGS["laws"], "one_law": "true", "sections": f"NOT ({FLAGS['long']})", "name": "true", "effort": "false", "described": f"NOT ({FLAGS['short']})", "keywords": f"NOT ({FLAGS['short']})",
    "clear": f"NOT ({FLAGS['vague']}) OR {FLAGS['short']}", "structured": f"{FLAGS['when']} AND NOT ({FLAGS['short']})", "present": FLAGS["skill"], "absent": f"NOT ({FLAGS['danger']})", "invalid": "false", "harmless": f"NOT ({FLAGS['danger']}) OR {FLAGS['safe']}",
    "harmless_all": f"NOT ({FLAGS['danger']})", "examples": FLAGS["example"], "files": f"NOT ({FLAGS['file']})", "skills": f"NOT ({FLAGS['skill']})", "agents": f"NOT ({FLAGS['agent']})", "unheard": "false",
}


@query("SELECT p_partkey, " + ", ".join(f"({v}) AS c_{k}" for k, v in EXPECTED.items()) + " FROM part")
def eval_matchers(spark, d):
    """The outcome of every matcher for skills."""
    a = A.Artifact.of("md")
    return skills(spark, d).select("p_partkey", *[A.check(*CHECKS[k][:1], a, REFS | CHECKS[k][1]).alias(f"c_{k}") for k in EXPECTED])


SETS = [
    ("sections", 0.5, [("section_exists", {"section": "Usage", "weight": 3.0}), ("section_exists", {"section": "References"}), ("has_iron_laws", {"min_count": 3, "weight": 0.5})]),
    ("safety", 0.3, [("no_dangerous_patterns", {})]), ("nothing", 0.1, []), ("refs", 0.1, [("valid_file_refs", {}), ("valid_skill_refs", {"weight": 2.0})]),
]
_i = lambda sql: f"CAST(({sql}) AS INTEGER)"
SETS_SQL = f"""WITH d AS (SELECT p_partkey, floor(({_i(EXPECTED["usage"])} * 3 + {_i(EXPECTED["references"])} + {_i(EXPECTED["laws"])} * 0.5) / 4.5 * 10000 + 0.5) AS d1, {_i(EXPECTED["harmless"])} * 10000 AS d2,
  floor(({_i(EXPECTED["files"])} + {_i(EXPECTED["skills"])} * 2) / 3 * 10000 + 0.5) AS d4, NOT ({EXPECTED["harmless"]}) AS vetoed FROM part),
c AS (SELECT *, floor((d1 * 5 + d2 * 3 + 10000 + d4) / 10 + 0.5) / 10000 AS composite FROM d)"""


@query(f"{SETS_SQL} SELECT p_partkey, d1 / 10000 AS dim_sections, d2 / 10000 AS dim_safety, 1.0::DOUBLE AS dim_nothing, d4 / 10000 AS dim_refs, vetoed, composite, composite >= 0.75 AND NOT vetoed AS passed FROM c")
def eval_weighted_checks(spark, d):
    """Checks weigh what they say, a dimension without checks is whole, and a veto overrides the composite."""
    return A.score(skills(spark, d), "md", SETS, REFS).drop("md", "key")


@query(f"""{SETS_SQL} SELECT p_partkey, CASE WHEN least(d1, d2, d4, 10000) = 10000 THEN 'nothing' WHEN d4 = least(d1, d2, d4) THEN 'refs' WHEN d2 = least(d1, d2) THEN 'safety' ELSE 'sections' END AS weakest,
  array_to_string(list_transform(list_sort([{{'s': d1, 'n': 'sections'}}, {{'s': d2, 'n': 'safety'}}, {{'s': 10000, 'n': 'nothing'}}, {{'s': d4, 'n': 'refs'}}]), lambda x: x.n), ',') AS in_order,
  CASE WHEN least(d1, d2, d4, 10000) < 10000 AND d4 = least(d1, d2, d4) THEN CAST(NOT ({EXPECTED["files"]}) AS INTEGER) + CAST(NOT ({EXPECTED["skills"]}) AS INTEGER) WHEN least(d1, d2, d4, 10000) < 10000 AND d2 = least(d1, d2) THEN 1
    WHEN least(d1, d2, d4, 10000) < 10000 THEN CAST(NOT ({EXPECTED["usage"]}) AS INTEGER) + CAST(NOT ({EXPECTED["references"]}) AS INTEGER) + CAST(NOT ({EXPECTED["laws"]}) AS INTEGER) ELSE 0 END AS failed FROM c JOIN part USING (p_partkey)""")
def eval_weakest_first(spark, d):
    """The weakest dimension with what failed in it, and all dimensions from the weakest up."""
    scored = A.score(skills(spark, d), "md", SETS, REFS, evidence=True)
    each = A.long_scores(scored.select("p_partkey", "assertions", *[f"dim_{n}" for n, _, _ in SETS]), ["p_partkey", "assertions"], [n for n, _, _ in SETS])
    each = each.withColumn("failed", A.failed_evidence(F.col("assertions"), F.col("dimension")))
    order = loop.weakest_first(each, "p_partkey", "dimension", "score").select("p_partkey", F.array_join(F.transform("weakest_first", lambda x: x["dimension"]), ",").alias("in_order"))
    low = loop.weakest(each, "p_partkey", "dimension", "score", "failed").select("p_partkey", "weakest", F.size("failed").alias("failed"))
    return low.join(order, "p_partkey")


DEFAULT_SQL = f"""SELECT p_partkey, (2 + {_i(EXPECTED["laws"])} + {_i(EXPECTED["usage"])} + {_i(EXPECTED["references"])}) / 5 AS dim_completeness, floor(({_i(EXPECTED["files"])} + {_i(EXPECTED["skills"])} + {_i(EXPECTED["agents"])}) / 3 * 10000 + 0.5) / 10000 AS dim_accuracy,
  floor((2 + {_i(EXPECTED["sections"])}) / 3 * 10000 + 0.5) / 10000 AS dim_conciseness, (1 + {_i(EXPECTED["harmless"])}) / 2 AS dim_safety, NOT ({EXPECTED["harmless"]}) AS vetoed FROM part"""


@query(DEFAULT_SQL)
def eval_full_set(spark, d):
    """Dimensions of the full set."""
    return A.score(skills(spark, d), "md", "full", REFS).select("p_partkey", "dim_completeness", "dim_accuracy", "dim_conciseness", "dim_safety", "vetoed")


@query(f"SELECT p_partkey, check_type, passed, CASE check_type WHEN 'section_exists' THEN CASE WHEN passed THEN 'section ''Usage'' found' ELSE 'no section ''Usage'' among [Manner, ' || CASE WHEN {FLAGS['references']} THEN 'References' ELSE 'Sources' END || ', Iron Laws, ' || CASE WHEN {FLAGS['safe']} THEN 'Red Flags' ELSE 'Steps' END || ']' END "
       f"WHEN 'valid_skill_refs' THEN CASE WHEN passed THEN 'no skill references' ELSE 'unknown skills: [lost-skill]' END WHEN 'description_no_vague' THEN CASE WHEN passed THEN 'no vague words' ELSE 'vague words: [various]' END END AS evidence "
       f"FROM (SELECT *, unnest(['section_exists', 'valid_skill_refs', 'description_no_vague']) AS check_type, unnest([{EXPECTED['usage']}, {EXPECTED['skills']}, {EXPECTED['clear']}]) AS passed FROM part)")
def eval_evidence(spark, d):
    """What checks saw."""
    dims = [("all", 1.0, [("section_exists", {"section": "Usage"}), ("valid_skill_refs", {}), ("description_no_vague", {})])]
    told = A.score(skills(spark, d), "md", dims, REFS, evidence=True).select("p_partkey", F.explode("assertions").alias("a"))
    return told.select("p_partkey", "a.check_type", "a.passed", "a.evidence")


# --- hooks

_KINDS = "p_partkey % 6"


def hooks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    script = (
        F.when(k == 0, "#!/bin/sh\nx=$(cat)\necho ok").when(k == 1, "#!/bin/sh\necho 'a # b' # jq reads\necho ok").when(k == 2, "echo no shebang\njq .a").when(k == 3, "#!/bin/sh\n# jq here\necho x # $(cat)").when(k == 4, "#!/bin/sh\nread -r \\\n  line\nsudo rm y")
        .otherwise(F.concat(F.lit("#!/bin/sh\njq .a "), F.lit(chr(0x202E))))
    )
    event = F.when(F.col("p_size") % 3 == 0, "PreToolUse").when(F.col("p_size") % 3 == 1, "Stop").otherwise("Unheard")
    return table(spark, d, "part").select("p_partkey", script.alias("script"), event.alias("event"), F.when(F.col("p_size") % 5 == 0, "  ").otherwise("Bash").alias("matcher"))


HOOKS_SQL = f"""SELECT p_partkey, {_KINDS} <> 2 AS shebang, {_KINDS} <> 5 AS plain, p_size % 3 <> 0 OR {_KINDS} IN (0, 2, 4, 5) AS reads, p_size % 3 <> 2 AND p_size % 5 <> 0 AS pointer, {_KINDS} <> 4 AS harmless FROM part"""


@query(f"""SELECT p_partkey, shebang, plain, reads, pointer, (CAST(shebang AS INTEGER) + CAST(reads AS INTEGER)) / 2 AS dim_executable, CAST(harmless AS INTEGER)::DOUBLE AS dim_safety, NOT (harmless AND plain) AS vetoed,
  round((CAST(shebang AS INTEGER) + CAST(reads AS INTEGER)) / 2 * 0.3 + CAST(pointer AS INTEGER) * 0.3 + CAST(harmless AS INTEGER) * 0.4, 4) AS composite,
  round((CAST(shebang AS INTEGER) + CAST(reads AS INTEGER)) / 2 * 0.3 + CAST(pointer AS INTEGER) * 0.3 + CAST(harmless AS INTEGER) * 0.4, 4) >= 0.9 AND harmless AND plain AS passed FROM ({HOOKS_SQL})""")
def eval_hooks(spark, d):
    """Hook scripts by the hook set, with the pointer of each in its checks."""
    rows = hooks(spark, d)
    params = {"event": F.col("event"), "matcher": F.col("matcher"), "known_events": ["PreToolUse", "PostToolUse", "Stop"], "kind": "hook"}
    a = A.Artifact.of("script")
    out = A.score(rows, "script", "hook", params, kind="hook").withColumns({"shebang": A.hook_shebang(a, {}), "plain": A.hook_no_format_chars(a, params), "reads": A.hook_reads_stdin(a, params), "pointer": A.hook_pointer(a, params)})
    return out.select("p_partkey", "shebang", "plain", "reads", "pointer", "dim_executable", "dim_safety", "vetoed", "composite", "passed")


@query(f"SELECT p_partkey, kind, CASE WHEN kind = 'hook' THEN p_size % 4 <> 0 AND p_size % 3 <> 0 ELSE {FLAGS['usage']} AND p_size % 3 <> 0 END AS sound FROM (SELECT *, unnest(['skill', 'hook']) AS kind FROM part)")
def structural_floor(spark, d):
    """What must hold before an artifact is scored, for skills and hooks."""
    rows = table(spark, d, "part").withColumn("kind", F.explode(F.array(F.lit("skill"), F.lit("hook"))))
    body = F.concat(F.lit("name: x\n"), F.when(_flag("usage"), "description: y\n").otherwise(""))
    body = F.when(F.col("kind") == "hook", F.when(F.col("p_size") % 4 == 0, " \n ").otherwise("echo\n")).otherwise(body)
    content = F.concat(body, F.when(F.col("p_size") % 3 == 0, "\n=======\n").otherwise(""))
    return rows.select("p_partkey", "kind", loop.sound(content, F.col("kind")).alias("sound"))


@query("""SELECT p_partkey, r AS route, CASE r WHEN 'outside' THEN 'native:fallback' ELSE 'native' END AS engine, CASE r WHEN 'explicit' THEN 1 WHEN 'vendored' THEN 2 ELSE 6 END AS dims,
  CASE r WHEN 'explicit' THEN CAST(p_size + 1 <= 30 AS DOUBLE) WHEN 'vendored' THEN (CAST(p_size + 1 <= 20 AS INTEGER) + 1) / 2 END AS composite
FROM (SELECT *, unnest(['explicit', 'vendored', 'outside', 'default']) AS r FROM part)""")
def eval_routes(spark, d):
    """Whose dimensions judge an artifact, what the engine is called, and what the dimensions that are given say."""
    own = [{"name": "a", "weight": 0.5, "checks": [{"type": "line_count", "target": 20, "tolerance": 0}]}, {"name": "b", "weight": 0.5, "checks": []}]
    options = {"explicit": ([("x", 1.0, [("line_count", {"target": 30, "tolerance": 0})])], {"mode": "vendored", "dimensions": own}), "vendored": (None, {"mode": "vendored", "dimensions": own}), "outside": (None, {"mode": "exec-in-place"}), "default": (None, None)}
    rows = table(spark, d, "part").select("p_partkey", F.repeat(F.lit("x\n"), F.col("p_size")).alias("md"))
    out = None
    for name, given in options.items():
        dims, engine = A.route(*given)
        score = A.score(rows, "md", dims).select("p_partkey", F.col("composite").alias("composite")) if given != (None, None) and name != "outside" else rows.select("p_partkey", F.lit(None).cast("double").alias("composite"))
        one = score.select("p_partkey", F.lit(name).alias("route"), F.lit(engine).alias("engine"), F.lit(len(C.EVAL_SETS[dims] if isinstance(dims, str) else dims)).alias("dims"), "composite")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS old, sha256(coalesce(lead(text) OVER (ORDER BY doc_id), '')) AS new FROM documents""")
def diff_round_trip(spark, d):
    """Line diffs of each document with the next, whole texts: both texts are read back from the script."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    ranked = rank.numbered(rows.select("doc_id"), ["doc_id"])[0].select("doc_id", F.col("row").alias("_n"))
    nexts = ranked.select((F.col("_n") - 1).alias("_n"), F.col("doc_id").alias("_next"))
    pairs = ranked.join(nexts, "_n", "left").join(rows, "doc_id").join(rows.select(F.col("doc_id").alias("_next"), F.col("text").alias("_text")), "_next", "left")
    diff = edits.line_diff(pairs, "doc_id", "text", "_text")
    side = lambda gone: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != gone, F.struct("pos", "line")))), lambda x: x["line"]), "\n").cast("binary"), 256)
    return diff.groupBy("doc_id").agg(side("ins").alias("old"), side("del").alias("new"))


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % p_size + 1 AS c FROM part),
l AS (SELECT p_partkey, n, c, i, CASE WHEN i < c THEN c - 1 ELSE n - c END AS run, CASE WHEN i < c THEN i ELSE i - c END AS place FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p)),
k AS (SELECT p_partkey, i, 0 AS j, CASE WHEN i = c THEN '- line ' || i WHEN run > 7 AND place = 4 THEN '  ⋯ ' || (run - 6) || CASE WHEN run = 7 THEN ' unchanged line' ELSE ' unchanged lines' END ELSE '  line ' || i END AS t
  FROM l WHERE i = c OR run <= 7 OR place <= 4 OR place > run - 3 UNION ALL SELECT p_partkey, c, 1, '+ changed' FROM p)
SELECT p_partkey, string_agg(t, chr(10) ORDER BY i, j) AS told FROM k GROUP BY p_partkey""")
def diff_collapsed(spark, d):
    """An artifact of which a line has changed: the diff, with what is far from the change collapsed."""
    rows = table(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("line "), i.cast("string"))).alias("lines"), (F.col("p_partkey") % F.col("p_size")).cast("int").alias("c"))
    rows = rows.select("p_partkey", F.array_join("lines", "\n").alias("old"), F.array_join(F.transform("lines", lambda x, i: F.when(i == F.col("c"), "changed").otherwise(x)), "\n").alias("new"))
    return edits.told(edits.collapsed(edits.line_diff(rows, "p_partkey", "old", "new"), "p_partkey"), "p_partkey").withColumnRenamed("text", "told")


@query("""WITH b AS (SELECT p_partkey, p_brand AS body, CASE p_partkey % 3 WHEN 0 THEN '' ELSE '# ' || p_name END AS text, '<!-- TRACEWELL:BEGIN sha256:' || substr(sha256(p_brand), 1, 12) || ' -->' || chr(10) || p_brand || chr(10) || '<!-- TRACEWELL:END -->' AS block FROM part)
SELECT p_partkey, CASE WHEN text = '' THEN block ELSE rtrim(text) || chr(10) || chr(10) || block END || chr(10) AS file, p_partkey % 4 = 1 AS tampered, p_partkey % 4 <> 1 AS in_sync, true AS mended FROM b""")
def managed_blocks(spark, d):
    """Blocks put into files of someone else, some changed there by hand, and put in order again."""
    rows = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("# "), "p_name"))
    rows = rows.select("p_partkey", "p_brand", edits.upserted(text, F.concat(F.lit(" "), "p_brand", F.lit("\n"))).alias("file"))
    rows = rows.withColumn("found", F.when(F.col("p_partkey") % 4 == 1, F.regexp_replace("file", r"(sha256:[0-9a-f]+ -->\n)", "$1by hand: ")).otherwise(F.col("file")))
    return rows.select("p_partkey", "file", edits.tampered("found").alias("tampered"), edits.in_sync("found", "p_brand").alias("in_sync"), (edits.upserted("found", "p_brand") == F.col("file")).alias("mended"))


@query("""SELECT p_partkey, 'Sort The ' || upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS titled, 'a ` b' AS fenced, p_name || ' ''x''' AS quoted, '**' || p_brand || '**: do ' || p_size AS bold, CASE WHEN length(p_type) <= 6 THEN p_type ELSE substr(p_type, 1, 5) || '…' END AS clipped,
  p_size || repeat(' ', 4 - length(CAST(p_size AS VARCHAR))) AS padded, format('{:,}', p_partkey * 1000) AS digits, CAST(round(p_size / 50 * 100) AS BIGINT) || '%' AS percent, 'a b' AS comment FROM part""")
def text_helpers(spark, d):
    from .functions import text as T

    rows = table(spark, d, "part")
    return rows.select(
        "p_partkey", T.titled(F.concat(F.lit("sort-the_"), "p_brand")).alias("titled"), T.fence_safe(F.lit("\n\na ```` b\n")).alias("fenced"), T.quote_safe(F.concat("p_name", F.lit('  \n"x" '))).alias("quoted"),
        T.bold_pattern(F.concat("p_brand", F.lit(" : do  "), F.col("p_size").cast("string"))).alias("bold"), T.clipped("p_type", 6).alias("clipped"), T.padded(F.col("p_size").cast("string"), 4).alias("padded"),
        T.grouped_digits(F.col("p_partkey") * 1000).alias("digits"), T.percent(F.col("p_size") / 50).alias("percent"), T.one_line(F.lit(f"a{chr(0x202E)}\nb")).alias("comment"),
    )


def _told(name: str, score: str, failed: str) -> str:
    return f"{{'s': {score}, 't': '- {name}: ' || format('{{:.3f}}', {score} / 10000) || CASE WHEN {failed} <> '' THEN ' (failed: ' || {failed} || ')' ELSE '' END, 'n': '{name}'}}"


_FAILED = {
    "sections": f"concat_ws(', ', CASE WHEN NOT ({EXPECTED['usage']}) THEN 'section_exists' END, CASE WHEN NOT ({EXPECTED['references']}) THEN 'section_exists' END, CASE WHEN NOT ({EXPECTED['laws']}) THEN 'has_iron_laws' END)",
    "safety": f"CASE WHEN {EXPECTED['harmless']} THEN '' ELSE 'no_dangerous_patterns' END", "nothing": "''", "refs": f"concat_ws(', ', CASE WHEN NOT ({EXPECTED['files']}) THEN 'valid_file_refs' END, CASE WHEN NOT ({EXPECTED['skills']}) THEN 'valid_skill_refs' END)",
}
_LINES = ", ".join(_told(n, s, _FAILED[n]) for n, s in (("sections", "d1"), ("safety", "d2"), ("nothing", "10000"), ("refs", "d4")))


@query(f"{SETS_SQL} SELECT p_partkey, composite, 'composite ' || format('{{:.3f}}', composite) || '; weakest first:' || chr(10) || array_to_string(list_transform(list_sort(list_transform([{_LINES}], lambda x: {{'s': x.s, 'n': x.n, 't': x.t}})), lambda x: x.t), chr(10)) AS told FROM c JOIN part USING (p_partkey)")
def eval_metric_text(spark, d):
    """The text by which an optimiser learns what to mend."""
    scored = A.score(skills(spark, d), "md", SETS, REFS, evidence=True)
    names = [n for n, _, _ in SETS]
    each = A.long_scores(scored.select("p_partkey", "assertions", "composite", *[f"dim_{n}" for n in names]), ["p_partkey", "assertions", "composite"], names)
    failed = F.transform(F.filter("assertions", lambda a: (a["dimension"] == F.col("dimension")) & ~a["passed"]), lambda a: a["check_type"])
    return loop.metric_text(each.withColumn("failed", failed), "p_partkey", "dimension", "score", "failed", "composite")
