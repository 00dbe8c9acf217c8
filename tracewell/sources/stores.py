"""Readers and writers of what the engine keeps: journal lines, proposals, installed skills and their markers.

What is kept belongs to one host or team and is small: a row for each run, proposal or skill.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, dir_name, filled, short_hash
from ..operators.artifacts import Artifact
from ..operators.rank import newest, prune
from ..plans.session import cut

JOURNAL = "format int, iteration int, skill string, old_composite double, new_composite double, kept boolean, timestamp string, description string, reason string"
PROPOSAL = (
    "id string, name string, eval struct<composite: double, dimensions: map<string, double>, passed: boolean>, format int, adapter string, md string, created_at string, session_key string,"
    " session_path string, session_stamp string, outcome string, source_sessions array<string>, kind string, event string, matcher string,"
    " description string, should_trigger array<string>, stored_at string"
)
#: Proposals of a file, at most.
RECORDS = 1000
MARKER = "installed_by string, name string, installed_at string, skill_sha256 string, adapter string, source_session string, fingerprint string, format int"


def read_journal(spark: SparkSession, path: str, known: tuple[int, ...] = (1,)) -> DataFrame:
    """Journal lines of known formats; a line without format is of the first, one that doesn't parse is left out."""
    rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("format", F.coalesce("format", F.lit(1))).where(F.col("format").isin(*known))


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def proposal_id(session: str = "session_key", md: str = "md"):
    """An id from what was proposed for which session: the same content is stored once."""
    return F.concat(short_hash(session), F.lit("-"), short_hash(md))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the store's files: (file, at, value, r), where ``r`` is null if it can't be read.

    A file is one object, a list of objects, or a line for each.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,txt}").text(path, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    lines = F.filter(F.split("value", "\n"), lambda x: filled(x))
    # The parser stops after a first value, so what begins with a line that parses alone is lines.
    each = F.coalesce(F.try_parse_json(F.try_element_at(lines, F.lit(1))).isNotNull() & (F.size(lines) > 1), F.lit(False))
    whole = F.when(~each, F.try_parse_json("value"))
    listed = F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda x: F.to_json(x))
    rows = files.select("file", "at", F.explode(F.coalesce(listed, F.when(whole.isNotNull(), F.array(F.col("value"))), lines)).alias("value"))
    return rows.withColumn("r", F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)), F.from_json("value", PROPOSAL)))


def read_proposals(spark: SparkSession, path: str, known: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Stored proposals of all formats with later fields' defaults, newest first, of each id what was stored last; what doesn't parse is left out."""
    rows = _records(spark, path).where("r.id IS NOT NULL").withColumn("_at", F.coalesce(F.try_to_timestamp("r.stored_at"), "at"))
    rows = rows.groupBy("r.id").agg(F.max_by("r", F.struct("_at", "file")).alias("r")).select("r.*").drop("stored_at")
    rows = rows.withColumn("format", F.coalesce("format", F.lit(1))).where(F.col("format").isin(*known))
    sniffed = F.when(F.col("kind").isin("skill", "hook"), F.col("kind")).when(F.col("md").startswith("#!"), "hook").otherwise("skill")
    rows = rows.withColumns({"kind": sniffed, "source_sessions": F.coalesce("source_sessions", F.array(F.col("session_key"))), "outcome": F.coalesce("outcome", F.lit("proposed"))})
    return rows.orderBy(F.desc("created_at"), "id")


def _add(lines: DataFrame, path: str) -> None:
    """Lines (value) as files of a new folder. A write that dies leaves files that Spark's readers pass over."""
    lines.select("value").write.option("maxRecordsPerFile", RECORDS).text(f"{path.rstrip('/')}/put-{uuid.uuid4().hex}")


def put_proposals(spark: SparkSession, more: DataFrame, path: str) -> DataFrame:
    """Store proposals under the ids of their contents. They are added in files of their own, so nothing that is there is written again or lost; of one that is stored twice the later counts."""
    told = more.dropDuplicates(["session_key", "md"]).withColumns({"id": proposal_id(), "stored_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")})
    _add(told.select(F.to_json(F.struct(*told.columns)).alias("value")), path)
    return read_proposals(spark, path)


def prune_proposals(spark: SparkSession, path: str, keep: int) -> DataFrame:
    """Delete all but the newest proposals, and return the rest. Nothing else ever deletes one.

    Files that hold one that goes are replaced: first what else they hold is written, also what
    can't be read here, and then they are deleted. A run that dies in between has both, of which one
    is read. Other files aren't touched.
    """
    listed = read_proposals(spark, path).select("id", "created_at")
    gone = cut(prune(listed, "created_at", "id", keep).select("id"))
    every = _records(spark, path).withColumn("id", F.col("r.id"))
    touched = cut(every.join(gone, "id", "left_semi").select("file").distinct())
    names = [r.file for r in touched.collect()]
    if names:
        rest = cut(every.join(touched, "file", "left_semi").join(gone, "id", "left_anti").select("value"))
        if not rest.isEmpty():
            _add(rest.select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")), path)
        for name in names:
            file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, False)
    return read_proposals(spark, path)


def latest_for(sessions: DataFrame, proposals: DataFrame, key: str = "session_key") -> DataFrame:
    """Sessions with the newest proposal of each, if there is one."""
    last = newest(proposals.select(key, "id", "name", "created_at", "session_stamp"), key, "created_at", "id")
    return sessions.join(last, key, "left")


def find(proposals: DataFrame, prefix: str) -> list[str]:
    """The ids that begin with a prefix: none, the one meant, or several."""
    return [r.id for r in proposals.where(F.col("id").startswith(prefix)).select("id").distinct().orderBy("id").limit(3).collect()]


def read_markers(spark: SparkSession, path: str, name: str = ".mark.json") -> DataFrame:
    """Provenance markers (folder, marker) of the skills below a path; unreadable ones are left out.

    Spark's readers pass over files whose names begin with a dot, so the driver reads these: one
    small file for each skill that a host has installed.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/{name}")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(pattern) or []:
        stream = files.open(status.getPath())
        try:
            found.append((status.getPath().getParent().toString(), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    rows = spark.createDataFrame(found, "folder string, value string").select("folder", F.from_json("value", MARKER).alias("_m"))
    return rows.where("_m.installed_by IS NOT NULL AND coalesce(_m.format, 1) = 1")


def installed_skills(spark: SparkSession, path: str, marker: str = ".mark.json") -> DataFrame:
    """Installed skills by name, with their description and, where a marker says so, when and from what they came."""
    a = Artifact.of("value")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").text(path, wholetext=True).select("value", dir_name(F.col("_metadata.file_path")).alias("folder"))
    skills = files.select("folder", F.coalesce(a.field("name"), base_name("folder")).alias("skill"), a.description().alias("description"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    marks = read_markers(spark, path, marker).select(plain("folder").alias("_folder"), "_m")
    out = skills.join(marks, plain(F.col("folder")) == F.col("_folder"), "left")
    return out.select(
        "folder", "skill", "description", "sha256", F.try_to_timestamp("_m.installed_at").alias("installed_at"), F.col("_m.source_session").alias("source_session"),
        F.coalesce(F.col("_m.skill_sha256") != F.col("sha256"), F.lit(False)).alias("drifted"), F.col("_m").isNotNull().alias("ours"),
    ).orderBy("skill")
