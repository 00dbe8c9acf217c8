"""What the verbs print as JSON: nested, with unknown values as null, one text for each record or one for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def _text(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), KEEP_NULLS)


def session_text() -> Column:
    """A session of ``scan.session_facts``."""
    c = F.col
    friction = F.struct("raw", c("friction").alias("score"), "rate", "dominant_signal", "signals").alias("friction")
    return _text(
        c("session_id"), c("path"), c("cwd"), friction, c("hazards"), F.struct(c("fingerprint").alias("type"), c("fingerprint_confidence").alias("confidence")).alias("fingerprint"),
        F.struct(c("opportunity").alias("score"), "missed", "skills_used").alias("opportunity"),
        F.struct(c("message_count").alias("events"), c("human_turns").alias("turns"), c("tool_count").alias("tools"), c("error_count").alias("errors"), "parse_errors").alias("counts"),
        c("file_paths"), c("max_ctx_pct"), c("tier2"),
    )


def sessions(rows: DataFrame) -> DataFrame:
    from ..functions.constants import WEIGHTS

    return rows.withColumn("signals", F.struct(*WEIGHTS)).select(session_text().alias("json"))


def proposals(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Stored proposals (``stores.read_proposals``, with ``installed``); ``whole`` with the artifact itself."""
    said = F.struct(F.col("eval.composite").alias("composite"), F.lit(None).cast("string").alias("engine"), F.coalesce("eval.dimensions", F.create_map().cast("map<string, double>")).alias("dimensions")).alias("eval")
    fields = [F.col(c) for c in ("id", "name", "outcome", "adapter", "created_at", "source_sessions", "installed")] + [said] + ([F.col("md")] if whole else [])
    return rows.select(_text(*fields).alias("json"))


def feedback(rows: DataFrame) -> DataFrame:
    """A report for each installed skill (``relate.feedback``)."""
    when = F.date_format("installed_at", "yyyy-MM-dd'T'HH:mm:ssXXX") if "installed_at" in rows.columns else F.lit(None).cast("string")
    return rows.select(_text(F.col("skill"), when.alias("installed_at"), F.col("sessions"), F.col("used").alias("sessions_used"), *[F.col(c) for c in ("usage_rate", "friction_with", "friction_without", "verdict")]).alias("json"))


def document(rows: DataFrame, name: str, **head: str | None) -> str:
    """All records of a report, which is small, as one text: what it covers, how many there are, and they."""
    import json

    found = [json.loads(r.json) for r in rows.collect()]
    return json.dumps(head | {"count": len(found), name: found}, ensure_ascii=False, indent=2)
