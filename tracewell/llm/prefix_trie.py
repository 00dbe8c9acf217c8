"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

Conversations that begin with the same turns share nodes. A node's name is the exclusive or of
digests of (depth, role, text) over its turns, 128 bits; the parent's name is that without the
last turn's. So names come from running totals, and neither a long conversation nor a common
beginning has to be in one task: turns are numbered by ranges of (conversation, turn), totals are
taken by blocks of ``BLOCK`` turns, and nodes are counts over names.

Subtree sums: each node's child with most conversations is its heavy child, so a way up changes
heavy paths at most log2(conversations) times. Nodes find the top of their path by doubling. Each
path's own sum is handed to the path above, and the sums that have arrived there further up, round
by round, until none is left; then a node's value is its own plus that of the light paths attached
to it, and one suffix sum along each path, in blocks, gives every subtree's sum.

Digests of the conversations that end at a node are taken over sorted runs of ids, which tasks join
to strings before they meet, so equal conversations are hashed as a stream and never gathered.

Edge cases: rows of one turn number are ordered by role and text (null: empty), null turns first;
a null conversation id takes no part; a conversation that has no turns after rebuilding belongs to
the root; an empty table gives an empty result; very long texts are only digested and counted;
repeated rows are turns of their own; ids are whole numbers (64 bits); other columns are not carried.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, prepare, table
from .sharding import sql_crc32

#: Turns of a conversation, or nodes of a path, that are summed together.
BLOCK = 4096
#: Rows of a range.
RANGE_ROWS = 500_000
#: A key with more than this share of the rows is joined by broadcast: there can't be more of them than its inverse.
SHARES = 1000
#: Bytes of joined ids in one row, about.
JOINED = 1 << 16

NAME = ["p1", "p2"]


def _many(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))


# --- turns


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, d1, d2, chars) of every turn: its place in its conversation from 0, a digest of role and text, and the text's code points."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text"))
    order = ["conv", "_turn", "_role", "_text", "_row"]
    dealt = kept.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(_many(rows.sparkSession, rows.count()), *order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.char_length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256)
    place = F.monotonically_increasing_id()
    placed = cut(
        dealt.select("conv", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), digest.alias("digest"), F.char_length("_text").cast("long").alias("chars"))
    )
    parts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return placed.join(parts, ["conv", "part"]).select("conv", (F.col("base") + F.col("at")).alias("at"), "digest", "chars")


def borrowed(conv: Column, block: int = 100, heads: int = 6) -> tuple[Column, Column]:
    """Whose first turns a conversation begins with, and how many of them."""
    return conv - conv % block, (F.crc32(conv.cast("string").cast("binary")) % heads).cast("long")


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation's first turns have been replaced by those of the first of its block.

    The replacement of h turns is at most ``heads - 1`` long, and a lender serves its block alone.
    """
    convs = turns.select("conv").distinct()
    lender, h = borrowed(F.col("conv"), block, heads)
    first = turns.where(F.col("at") < heads - 1).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("lent"))
    plan = convs.select("conv", lender.alias("lender"), h.alias("h")).join(first.withColumnRenamed("conv", "lender"), "lender", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast(first.schema["lent"].dataType)), F.lit(1), F.col("h").cast("int"))
    plan = cut(plan.select("conv", "h", lent.alias("lent")))
    new = plan.select("conv", F.explode("lent").alias("t")).select("conv", "t.*")
    # a block of a conversation's turns at a time, so that a long one is no hot key
    blocks = turns.select("conv", F.floor(F.col("at") / BLOCK).alias("block")).distinct()
    shift = blocks.join(plan.select("conv", "h", F.size("lent").alias("got")), "conv")
    own = turns.withColumn("block", F.floor(F.col("at") / BLOCK)).join(shift, ["conv", "block"]).where("at >= h")
    return new.unionByName(own.select("conv", (F.col("at") - F.col("h") + F.col("got")).alias("at"), "digest", "chars")), convs


# --- nodes


def named(turns: DataFrame) -> DataFrame:
    """Every turn with its depth and the names of the node it makes (p1, p2) and of that node's parent (q1, q2)."""
    depth = (F.col("at") + 1).alias("depth")
    marks = turns.select("conv", depth, "chars", F.xxhash64(F.lit(1), F.col("at"), "digest").alias("e1"), F.xxhash64(F.lit(2), F.col("at"), "digest").alias("e2"), F.floor(F.col("at") / BLOCK).alias("block"))
    marks = cut(marks)
    over = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marks.withColumn("x1", F.bit_xor("e1").over(over)).withColumn("x2", F.bit_xor("e2").over(over))
    whole = marks.groupBy("conv", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("conv", "block", F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2")).where("block > 0")
    total = lambda k: F.col(f"x{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0)))
    out = local.join(carry, ["conv", "block"], "left").select("conv", "depth", "chars", total(1).alias("p1"), total(2).alias("p2"), "e1", "e2")
    return out.select("conv", "depth", "chars", *NAME, F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"))


def nodes_of(named_turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: its name and its parent's (null: the root), conv_id, depth, n_convs and the code points of its last text."""
    inner = named_turns.groupBy(*NAME).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"), none.alias("q1"), none.alias("q2"))
    return inner.unionByName(root)


def _with_parent(rows: DataFrame, parents: DataFrame, children: DataFrame, total: int) -> DataFrame:
    """``rows`` (q1, q2) with the columns of ``parents`` (q1, q2, ...). Parents of more than 1/SHARES of all nodes, fewer than SHARES, are broadcast."""
    heavy = F.broadcast(children.where(F.col("n_children") > total // SHARES).select("q1", "q2", F.lit(True).alias("_heavy")))
    marked = rows.join(heavy, ["q1", "q2"], "left")
    few = parents.join(heavy, ["q1", "q2"], "left_semi")
    light = marked.where("_heavy IS NULL").drop("_heavy").join(parents, ["q1", "q2"])
    return light.unionByName(marked.where("_heavy").drop("_heavy").join(F.broadcast(few), ["q1", "q2"]))


# --- heavy paths


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the name of their heavy path (its top node: h1, h2) and their place on it (from 0)."""
    child = F.struct("n_convs", "p1", "p2")
    heavy = nodes.where("q1 IS NOT NULL").groupBy("q1", "q2").agg(F.max(child).alias("c")).select("c.p1", "c.p2", F.lit(True).alias("heavy"))
    flagged = cut(nodes.join(heavy, NAME, "left"))
    tops = flagged.where("heavy IS NULL").select(*NAME)
    # a node one below a top is done; the others double their steps until they meet one that is
    below = flagged.where("heavy").select(*NAME, F.col("q1").alias("u1"), F.col("q2").alias("u2"), F.lit(1).cast("long").alias("steps"))
    met = tops.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.lit(True).alias("done"))
    state = cut(below.join(met, ["u1", "u2"], "left").withColumn("done", F.coalesce("done", F.lit(False))))
    finished, open_ = state.where("done"), state.where("NOT done")
    while not open_.isEmpty():
        target = finished.unionByName(open_).select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"), F.col("steps").alias("more"), F.col("done").alias("over"))
        moved = open_.drop("done").join(target, ["u1", "u2"])
        state = cut(moved.select(*NAME, F.col("v1").alias("u1"), F.col("v2").alias("u2"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done")))
        finished, open_ = finished.unionByName(state.where("done")), state.where("NOT done")
    place = finished.select(*NAME, F.col("u1").alias("h1"), F.col("u2").alias("h2"), F.col("steps").alias("place"))
    joined = flagged.join(place, NAME, "left")
    return joined.select(*[c for c in nodes.columns], F.coalesce("h1", "p1").alias("h1"), F.coalesce("h2", "p2").alias("h2"), F.coalesce("place", F.lit(0)).alias("place"))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` with each column of ``values`` summed over the node's subtree."""
    paths = cut(heavy_paths(nodes))
    sums = [F.sum(v).alias(v) for v in values]
    above = paths.where("place = 0 AND q1 IS NOT NULL").select("h1", "h2", "q1", "q2")  # of each path but the root's: the node it hangs on
    of_node = paths.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    up = cut(_hung(above, of_node, nodes.count()))
    own = cut(paths.groupBy("h1", "h2").agg(*sums))
    arrived, moving = own, own
    while True:
        moving = cut(moving.join(up.select("h1", "h2", "a1", "a2"), ["h1", "h2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(*sums))
        if moving.isEmpty():
            break
        arrived = arrived.unionByName(moving)
    totals = arrived.groupBy("h1", "h2").agg(*sums)
    hung = totals.join(up, ["h1", "h2"]).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    valued = paths.join(hung, NAME, "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values} | {"block": F.floor(F.col("place") / BLOCK)})
    valued = cut(valued.drop(*[f"_{v}" for v in values]))
    down = Window.partitionBy("h1", "h2", "block").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deeper = Window.partitionBy("h1", "h2").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = valued.groupBy("h1", "h2", "block").agg(*sums)
    carry = blocks.select("h1", "h2", "block", *[F.sum(v).over(deeper).alias(f"_{v}") for v in values]).where(F.col(f"_{values[0]}").isNotNull())
    summed = valued.withColumns({v: F.sum(v).over(down) for v in values}).join(carry, ["h1", "h2", "block"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).select(*nodes.columns)


def _hung(above: DataFrame, of_node: DataFrame, total: int) -> DataFrame:
    """The path above of each path. A node on which many paths hang is joined by broadcast."""
    children = above.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"))
    return _with_parent(above, of_node, children, total)


# --- digests of ids


def _joined(batches):
    """Sorted (p1, p2, conv) to rows of joined ids: name, first id, string."""
    now, ids, size, done = None, [], 0, []

    def flush():
        if ids:
            done.append((*now, ids[0], ",".join(map(str, ids))))

    def out():
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["p1", "p2", "first", "ids"])

    for batch in batches:
        for p1, p2, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (p1, p2) != now or size > JOINED:
                flush()
                now, ids, size = (p1, p2), [], 0
                if len(done) > 1000:
                    yield out()
                    done = []
            ids.append(conv)
            size += 8
    flush()
    if done:
        yield out()


def _hashed(batches):
    """Sorted rows of joined ids to one digest for each node, as a stream."""
    now, running, done = None, None, []

    def out():
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["p1", "p2", "ends_sha256"])

    for batch in batches:
        for p1, p2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (p1, p2) == now:
                running.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, running.hexdigest()))
                if len(done) > 10_000:
                    yield out()
                    done = []
            now, running = (p1, p2), hashlib.sha256(ids.encode())
    if now is not None:
        done.append((*now, running.hexdigest()))
    if done:
        yield out()


def ends(last: DataFrame, rows: int) -> DataFrame:
    """(p1, p2, ends_sha256) of nodes at which conversations end, from (p1, p2, conv)."""
    order = [*NAME, "conv"]
    dealt = last.select(*order).repartitionByRange(_many(last.sparkSession, rows), *order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(_joined, "p1 long, p2 long, first long, ids string")
    return joined.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(_hashed, "p1 long, p2 long, ends_sha256 string")


# --- the trie


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv, at, digest, chars); ``convs`` (conv) are all conversations, with turns or not."""
    prepare(turns.sparkSession)
    made = cut(named(turns))
    nodes = cut(nodes_of(made, convs))
    total = nodes.count()
    children = cut(nodes.where("q1 IS NOT NULL").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children")))
    counted = nodes.join(children.withColumnsRenamed({"q1": "p1", "q2": "p2"}), NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = cut(counted.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    summed = cut(subtree_sums(valued, ["n_leaves", "saved_tokens"]))
    last = made.groupBy("conv").agg(F.max(F.struct("depth", *NAME)).alias("l")).select("conv", "l.p1", "l.p2")
    zero = F.lit(0).cast("long")
    turnless = convs.join(made.select("conv").distinct(), "conv", "left_anti").select("conv", zero.alias("p1"), zero.alias("p2"))
    digests = ends(last.unionByName(turnless), convs.count())
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    inner = _with_parent(summed.where("q1 IS NOT NULL"), parents, children, total)
    out = inner.unionByName(summed.where("q1 IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))).join(digests, NAME, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(*rebuilt(cut(numbered(rows))))


ORACLE = {
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 100 AS lender, {sql_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
g AS (SELECT c.c, c.h, (SELECT count(*) FROM t WHERE t.c = c.lender AND t.i < c.h) AS got FROM c),
r AS (SELECT c.c, t.i + 1 AS d, t.role, t.text FROM c JOIN t ON t.c = c.lender AND t.i < c.h
  UNION ALL SELECT t.c, t.i - g.h + g.got + 1, t.role, t.text FROM t JOIN g ON g.c = t.c WHERE t.i >= g.h),
k AS (SELECT c, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY d)) AS p FROM r
  UNION ALL SELECT c, 0, 0, '' FROM c),
m AS (SELECT c, d, p, chars, lag(p) OVER (PARTITION BY c ORDER BY d) AS q, d = max(d) OVER (PARTITION BY c) AS ends FROM k),
n AS (SELECT p, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(q) AS q, (count(*) - 1) * min(chars) AS saved,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY p),
b AS (SELECT q, count(*) AS n_children FROM n WHERE q IS NOT NULL GROUP BY q),
s AS (SELECT k.p, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE b.n_children IS NULL) AS n_leaves
  FROM n JOIN k ON k.c = n.conv_id AND k.d <= n.depth LEFT JOIN b ON b.q = n.p GROUP BY k.p)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN n u ON u.p = n.q LEFT JOIN b ON b.q = n.p""",
}
