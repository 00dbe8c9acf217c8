"""Reports over stores: how installed skills do, what was proposed, and what proposals have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CLUSTER_THRESHOLD
from ..functions.text import clipped, grouped_digits, padded, percent
from ..operators import relate, similar
from ..operators.artifacts import Artifact, score
from ..sources import stores
from ..sources.transcripts import read_events
from . import scan, shapes
from .session import cut

PLAIN = "^file:/+"


def modified(spark: SparkSession, path: str) -> DataFrame:
    """(path, at) of every file below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), PLAIN, "/").alias("path"), F.col("modificationTime").alias("at"))


def feedback(spark: SparkSession, skills: str, transcripts: str, fmt: str = "claude", options: scan.Options = scan.Options()) -> DataFrame:
    """For each skill that was installed from here the sessions since, by the time of their transcripts, and whether they used it and went better."""
    facts = scan.select_sessions(scan.session_facts(read_events(spark, transcripts, fmt), options.pack), options)
    timed = facts.withColumn("path", F.regexp_replace("path", PLAIN, "/")).join(modified(spark, transcripts), "path", "left")
    ours = stores.installed_skills(spark, skills).where("ours").select("skill", "installed_at").dropDuplicates(["skill"])
    told = relate.feedback(ours, timed.select("at", "skills_used", "friction"), "skill", "installed_at", "at", "skills_used", "friction")
    return told.join(ours, "skill", "left").orderBy("skill")


def proposals(spark: SparkSession, path: str, skills: str | None = None, whole: bool = False) -> DataFrame:
    """Stored proposals, newest first, and whether a skill of that name was installed from here; ``whole`` with all that is stored."""
    rows = stores.read_proposals(spark, path)
    if not whole:
        rows = rows.select("id", "name", "kind", "outcome", F.col("eval.composite").alias("composite"), F.size("source_sessions").alias("sources"), "created_at")
    ours = spark.createDataFrame([], "skill string") if skills is None else stores.installed_skills(spark, skills).where("ours").select("skill")
    return relate.with_installed(rows, ours, "name", "skill").orderBy(F.desc("created_at"), "id")


def show(spark: SparkSession, path: str, prefix: str, as_json: bool = False) -> str:
    """A stored proposal; an error if the prefix of its id means none or several."""
    found = stores.find(stores.read_proposals(spark, path), prefix)
    if len(found) != 1:
        raise ValueError(f"no proposal begins with {prefix!r}" if not found else f"several proposals begin with {prefix!r}: {', '.join(found)}")
    one = stores.read_proposals(spark, path).where(F.col("id") == found[0])
    if as_json:
        return shapes.proposals(one.withColumn("installed", F.lit(False)), whole=True).first().json
    r = one.first()
    score = "—" if r.eval is None or r.eval.composite is None else f"{r.eval.composite:.2f}"
    return f"{r.name or r.id}: {r.kind}, {r.outcome}, composite {score}\n\n{r.md or ''}"


Merge = Callable[[DataFrame], DataFrame]


def clustered(rows: DataFrame, least: float = CLUSTER_THRESHOLD) -> DataFrame:
    """Stored proposals with ``cluster``, the id of its first one: alike in the words of name, description and triggers, of one kind, the oldest first."""
    described = F.coalesce("description", Artifact.of("md").description())
    tokens = rows.select("id", "kind", "created_at", similar.routing_tokens(F.coalesce("name", F.lit("")), described, F.coalesce("should_trigger", F.array().cast("array<string>"))).alias("tokens"))
    clusters = similar.greedy_clusters(tokens, similar.similar_pairs(tokens, "id", "kind", "tokens", least), "id", "kind", order=("created_at",))
    return rows.join(clusters.select("id", "cluster"), "id")


def consolidation(spark: SparkSession, path: str, least: float = CLUSTER_THRESHOLD, merge: Merge | None = None, bar: float | None = None) -> DataFrame:
    """Clusters of stored proposals, oldest first, what became of each and what a merged artifact says it came from.

    ``merge`` gets the members of clusters of several (cluster, name, md, ...) and returns one
    artifact for each that it could merge (cluster, md). It is scored, and replaces its originals
    (``merged``) only if it passes the gate, whose bar can be set; otherwise they stay
    (``originals``), as they do where nothing came back (``error``). Without ``merge`` nothing is
    merged and all stay.
    """
    rows = cut(clustered(stores.read_proposals(spark, path).withColumn("name", F.coalesce("name", "id")), least))
    origin = similar.merged_provenance(rows, "cluster", ["created_at", "id"], "name", "session_key")
    begun = rows.groupBy("cluster").agg(F.min("created_at").alias("_begun"))
    if merge is None:
        scored, missing = rows.select("cluster").distinct().select("cluster", F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("double").alias("composite")), "originals"
    else:
        several = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cluster")
        made = merge(rows.join(several, "cluster")).select("cluster", "md").join(rows.select("cluster", "kind").distinct(), "cluster")
        judged = [score(made.where(F.col("kind") == kind), "md", eval_set, kind=kind, threshold=bar) for kind, eval_set in (("skill", "default"), ("hook", "hook"))]
        scored, missing = cut(judged[0].select("cluster", "passed", "composite").unionByName(judged[1].select("cluster", "passed", "composite"))), "error"
    outcomes = similar.merge_outcomes(rows, scored.select("cluster", "passed"), missing=missing)
    out = outcomes.join(origin, "cluster").join(begun, "cluster").join(scored.select("cluster", "composite"), "cluster", "left")
    return out.orderBy("_begun", "cluster").drop("_begun")


def listed(rows: DataFrame, columns: dict[str, int]) -> str:
    """A text table of few rows: columns and how wide they are."""
    kinds = dict(rows.dtypes)

    def cell(name: str, wide: int):
        number = kinds[name] in ("bigint", "int")
        said = grouped_digits(name) if number else percent(name) if name.endswith("_rate") else F.array_join(name, ", ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return padded(clipped(F.coalesce(said, F.lit("—")), wide), wide, right=number)

    head = "  ".join(name.ljust(wide) for name, wide in columns.items()).rstrip()
    return "\n".join([head, *(r.line.rstrip() for r in rows.select(F.concat_ws("  ", *[cell(n, w) for n, w in columns.items()]).alias("line")).collect())])


__all__ = ["consolidation", "feedback", "listed", "modified", "proposals", "show"]
