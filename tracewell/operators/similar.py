"""Similarity of proposals by shared tokens, and greedy clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CLUSTER_THRESHOLD
from ..functions.text import word_tokens
from ..plans.session import cut, release

#: Into how many parts the rows of a token are split.
SALT = 4


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(both.cast("double") / F.nullif(every, F.lit(0)))


def similar_pairs(rows: DataFrame, key: str, kind: str, tokens: str, least: float = CLUSTER_THRESHOLD) -> DataFrame:
    """Pairs (a < b) of one kind whose token sets overlap by at least ``least``.

    An inverted index over prefixes: with tokens in the order of how many rows of the kind hold
    them, rare first, sets of n and a pair that reaches the threshold share one of the first
    n - ceil(least * n) + 1. Only pairs that share such a token, and whose sizes allow it, are compared.
    """
    held = rows.select(F.col(key).alias("_id"), F.col(kind).alias("_kind"), F.array_sort(F.array_distinct(tokens)).alias("_set"))
    each = held.select("_id", "_kind", F.explode("_set").alias("_t"))
    rarity = each.groupBy("_kind", "_t").agg(F.count(F.lit(1)).alias("_df"))
    ordered = each.join(rarity, ["_kind", "_t"]).groupBy("_id", "_kind").agg(F.array_sort(F.collect_list(F.struct("_df", "_t"))).alias("_o"))
    n = F.size("_o")
    first = ordered.select("_id", "_kind", n.alias("_n"), F.explode(F.slice("_o", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("_p")).select("_id", "_kind", "_n", F.col("_p._t").alias("_t"))
    # A token's rows are dealt to several tasks, each of which meets all rows of the other side.
    other = first.select(F.col("_id").alias("_id2"), "_kind", "_t", F.col("_n").alias("_n2"), F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int").alias("_salt"))
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    alike = (F.col("_n") >= F.col("_n2") * least - 1e-9) & (F.col("_n2") >= F.col("_n") * least - 1e-9)
    pairs = salted.join(other, ["_kind", "_t", "_salt"]).where((F.col("_id") < F.col("_id2")) & alike).select("_id", "_id2").distinct()
    a, b = held.select("_id", F.col("_kind").alias(kind), F.col("_set").alias("_a")), held.select(F.col("_id").alias("_id2"), F.col("_set").alias("_b"))
    out = pairs.join(a, "_id").join(b, "_id2").withColumn("similarity", jaccard(F.col("_a"), F.col("_b")))
    return out.where(F.col("similarity") >= least).select(kind, F.col("_id").alias("a"), F.col("_id2").alias("b"), "similarity")


def reaching_pairs(rows: DataFrame, key: str, kind: str, tokens: str, least: float = CLUSTER_THRESHOLD, order: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``similar_pairs`` (a, b) from which every row reaches over earlier rows all that it reaches over all of them: what ``greedy_clusters`` needs.

    Rows that have the same tokens but for ones that no other row of the kind has are one class: how
    similar two rows are depends on their classes alone, so only classes are compared. Where rows of a
    class are similar to one another, a row that is similar to them needs just the last one before it,
    from which the others are reached, and gets the first as well, which mostly ends the search at
    once. Of classes whose rows are not similar to one another it needs every earlier row.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id"))
    held = rows.select(F.col(key).alias("_id"), F.col(kind).alias("_kind"), place.alias("_place"), F.array_distinct(tokens).alias("_set"))
    each = held.select("_id", "_kind", F.explode("_set").alias("_t"))
    shared = each.groupBy("_kind", "_t").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    cores = each.join(shared, ["_kind", "_t"]).groupBy("_id").agg(F.array_sort(F.collect_list("_t")).alias("_core"))
    core = F.coalesce("_core", F.array().cast("array<string>"))
    members = held.join(cores, "_id", "left").select("_id", "_kind", "_place", core.alias("_core"), F.size("_set").alias("_n"))
    members = cut(members.withColumn("_class", F.sha2(F.to_json(F.struct("_kind", "_core", "_n")).cast("binary"), 256)))
    classes = members.select("_class", "_kind", "_core", "_n").dropDuplicates(["_class"])
    k, n = F.size("_core"), F.col("_n")
    own = F.when(k < n, F.transform(F.sequence(F.lit(1), n - k), lambda i: F.concat("_class", F.lit("#"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    tight = (n > 0) & ((k == n) | (k.cast("double") / F.nullif(2 * n - k, F.lit(0)) >= least))
    classes = cut(classes.select("_class", "_kind", F.concat("_core", own).alias("_tokens"), F.coalesce(tight, F.lit(False)).alias("_tight")))
    alike = similar_pairs(classes, "_class", "_kind", "_tokens", least)
    ways = alike.select(F.col("a").alias("_x"), F.col("b").alias("_y")).unionByName(alike.select(F.col("b").alias("_x"), F.col("a").alias("_y")))
    ways = ways.unionByName(classes.where("_tight").select(F.col("_class").alias("_x"), F.col("_class").alias("_y")))
    ways = cut(ways.join(classes.select(F.col("_class").alias("_y"), "_tight"), "_y"))
    of = lambda end, id_: members.select(F.col("_class").alias(end), F.col("_place").alias(f"_at{end}"), F.col("_id").alias(id_))
    close, far = ways.where("_tight").select("_x", "_y"), ways.where("NOT _tight").select("_x", "_y")
    asked = close.join(of("_x", "a"), "_x").select("_x", "_y", F.col("_at_x").alias("_at"), F.lit(0).alias("_role"), "a", F.lit(None).cast(members.schema["_id"].dataType).alias("b"))
    there = close.join(of("_y", "b"), "_y").select("_x", "_y", F.col("_at_y").alias("_at"), F.lit(1).alias("_role"), F.lit(None).cast(members.schema["_id"].dataType).alias("a"), "b")
    before = Window.partitionBy("_x", "_y").orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, -1)
    ends = asked.unionByName(there).select("a", F.array(F.first("b", ignorenulls=True).over(before), F.last("b", ignorenulls=True).over(before)).alias("_ends"))
    near = ends.where("a IS NOT NULL").select("a", F.explode(F.array_distinct("_ends")).alias("b")).where("b IS NOT NULL")
    every = far.join(of("_x", "a"), "_x").join(of("_y", "b"), "_y").where(F.col("_at_y") < F.col("_at_x")).select("a", "b")
    return near.unionByName(every)


def routing_tokens(name: Column | str, description: Column | str, triggers: Column | str | None = None) -> Column:
    """The words by which proposals compete: of a name, a description and phrasings that should trigger it."""
    said = [F.col(c) if isinstance(c, str) else c for c in (name, description)]
    if triggers is not None:
        said.append(F.array_join(F.col(triggers) if isinstance(triggers, str) else triggers, " "))
    return word_tokens(F.concat_ws(" ", *said))


def greedy_clusters(rows: DataFrame, pairs: DataFrame, key: str, kind: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of rows in ascending order (``order``, then key): each joins the oldest cluster that holds a similar row, or opens one.

    A cluster's age is that of its first row. So the cluster of a row is the least row that can be
    reached from it over links from later to earlier rows: the oldest of its earlier neighbours'
    clusters, and so on. That needs no fold. Every row begins with itself, and each round takes the
    least of its earlier neighbours' rows, and then the row that its row has; rounds end when
    nothing changes. Rows that all link with one another take one round, chains as many as doublings
    reach their ends; chains whose rows also link with dead ends may take one for each link.
    Links and labels stay distributed, whatever a kind's size; ``pairs`` hold rows of one kind: all
    similar ones, or those of ``reaching_pairs``.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id"))
    nodes = cut(rows.select(F.col(key).alias("_id"), F.col(kind).alias("_kind"), place.alias("_place")))
    at = lambda end: nodes.select(F.col("_id").alias(end), F.col("_place").alias(f"_{end}"))
    linked = pairs.select("a", "b").where("a <> b").join(at("a"), "a").join(at("b"), "b")
    earlier = F.col("_a") < F.col("_b")
    links = cut(linked.select(F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("_id"), F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("_near")).distinct())
    labels = held = cut(nodes.select("_id", F.col("_place").alias("_least")))
    while True:
        of = lambda name: labels.select(F.col("_id").alias(name), F.col("_least").alias(f"_of{name}"))  # noqa: B023, E731
        near = links.join(of("_near"), "_near").groupBy("_id").agg(F.min("_of_near").alias("_new"))
        taken = labels.join(near, "_id", "left").select("_id", "_least", F.least("_least", "_new").alias("_new"))  # nulls are passed over
        moved = taken.withColumn("_at", F.col("_new.id")).join(of("_at"), "_at").select("_id", F.least("_new", "_of_at").alias("_new"), "_least")
        moved = cut(moved.select("_id", F.col("_new").alias("_least"), (F.col("_new") != F.col("_least")).alias("_moved")))
        release(held)
        labels, held = moved.drop("_moved"), moved
        if moved.where("_moved").isEmpty():
            break
    return nodes.join(labels, "_id").select(F.col("_id").alias(key), F.col("_kind").alias(kind), F.col("_least.id").alias("cluster"))


def merge_outcomes(clusters: DataFrame, passed: DataFrame, cluster: str = "cluster", missing: str = "originals") -> DataFrame:
    """``kept`` for single rows, ``merged`` where the merged artifact passed, ``originals`` where it failed, and ``missing`` where there is none."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    outcome = F.when(F.col("size") == 1, "kept").when(F.col("passed"), "merged").when(F.col("passed").isNull(), missing).otherwise("originals")
    return sizes.join(passed, cluster, "left").select(cluster, "size", outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """How many clusters had each outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"))


def merged_provenance(rows: DataFrame, cluster: str, order: list[str], name: str, session: str) -> DataFrame:
    """Of each cluster what a merged artifact says it came from: names, and sessions without repeats, both in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_name"), F.col(session).alias("_session"))))
    out = rows.groupBy(cluster).agg(listed.alias("_all"))
    sessions = F.array_distinct(F.filter(F.transform("_all", lambda x: x["_session"]), lambda s: s.isNotNull()))
    return out.select(cluster, F.transform("_all", lambda x: x["_name"]).alias("merged_from"), sessions.alias("session_ids"))
