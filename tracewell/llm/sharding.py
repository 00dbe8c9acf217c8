"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone.

A tree has regions, racks and shards. A shard has a weight and room for it; a rack's room is the
summed room of its shards, a region's that of its racks, absent shards included. For a row every
region draws once: a time, ``-ln(u) / room``, and a place in its room. The place names a rack, in
proportion to the racks' room, and in that rack a shard, in proportion to the shards'. Where it
falls beyond the shard's weight the region has missed, and its live shards race on from that time
with ``-ln(u) / weight`` each. The region of the earliest time gets the row. The earliest of
exponential draws is one again, whose rate is the summed weight, so every shard gets rows in
proportion to its weight, while a full region costs one hash a row, however many shards it has.

A changed weight changes nothing but where places in that shard's room and its own race fall: rows
move into the shard that grew, or out of the one that shrank, and no row moves between two others.
One more shard is the weight of an absent one going from 0 to its own, or a new region that draws
apart from the others, so at every shard count it takes rows into itself alone.

Edge cases: a null key counts as the empty string; a null text is empty and has size 1; rows
that repeat get slots of their own; an empty table gives an empty result. Columns of the input
beside the key and the text are not carried, so none can clash. A weight above its room, or a tree
without weight, is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

SHARDS = 8
#: Rows of one range when slots are numbered.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    room: float = 1.0


def tree(shards: int) -> list[Leaf]:
    """The topology that a shard count stands for: two shards a rack, two racks a region; those beyond the count weigh nothing yet."""
    return [Leaf(s // 4, s // 2, s, float(s < shards)) for s in range(-(-shards // 4) * 4)]


def _uniform(hexadecimal: Column, first: int, digits: int) -> Column:
    """Between 0 and 1, both excluded, from some digits of a digest."""
    return (F.conv(F.substring(hexadecimal, first, digits), 16, 10).cast("double") + 0.5) / float(16**digits)


def _digest(key: Column, node: str) -> Column:
    return F.md5(F.concat(key, F.lit(f"/{node}")).cast("binary"))


def _time(u: Column, rate: float) -> Column:
    return -F.log(u) / float(rate)


def _split(place: Column, widths: list[float], choices: list) -> Column:
    """Of the choices, each a function of the place within it, the one whose width the place falls in."""
    starts = [math.fsum(widths[:k]) for k in range(len(widths))]
    out = choices[-1](place - F.lit(starts[-1]))
    for k in range(len(widths) - 2, -1, -1):
        out = F.when(place < F.lit(starts[k + 1]), choices[k](place - F.lit(starts[k]))).otherwise(out)
    return out


def _region(key: Column, name: int, leaves: list[Leaf]) -> Column:
    """A region's draw for a row: time, region and shard."""
    digest, room = _digest(key, str(name)), math.fsum(x.room for x in leaves)
    place, at = _uniform(digest, 14, 13) * float(room), _time(_uniform(digest, 1, 13), room)
    racks = sorted({x.rack for x in leaves})
    within = [[x for x in leaves if x.rack == k] for k in racks]

    def shard(x: Leaf):
        hit = F.lit(x.shard)
        return lambda rest: hit if x.weight == x.room else F.when(rest < float(x.weight), hit) if x.weight else F.lit(None).cast("int")

    def rack(held: list[Leaf]):
        return lambda rest: _split(rest, [x.room for x in held], [shard(x) for x in held])

    found = _split(place, [math.fsum(x.room for x in held) for held in within], [rack(held) for held in within])
    draw = lambda time, of: F.struct(time.alias("time"), F.lit(name).alias("region"), of.cast("int").alias("shard"))
    live = [x for x in leaves if x.weight]
    if all(x.weight == x.room for x in leaves):
        return draw(at, found)
    race = [draw(at + _time(_uniform(_digest(key, f"{name}/{x.shard}"), 1, 13), x.weight), F.lit(x.shard)) for x in live]
    return F.when(found.isNotNull(), draw(at, found)).otherwise(F.array_min(F.array(*race)))


def place_by_key(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that a row of this key goes to."""
    if any(not 0 <= x.weight <= x.room for x in leaves) or not any(x.weight for x in leaves):
        raise ValueError("a weight has to be between 0 and its room, and some weight above 0")
    regions = sorted({x.region for x in leaves})
    held = {r: [x for x in leaves if x.region == r] for r in regions}
    draws = [_region(key, r, held[r]) for r in regions if any(x.weight for x in held[r])]
    return F.array_min(F.array(*draws))["shard"]


def slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: their place in their shard, from 0 and without gaps, in ``order``.

    Rows are dealt by ranges of (shard, order, a number that separates repeats), as many as the
    rows need, so that no shard and no repeated row fills a task; a row's slot is the count of its
    shard's rows in earlier ranges plus its place in its own.
    """
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    many = max(rows.sparkSession.sparkContext.defaultParallelism, -(-numbered.count() // RANGE_ROWS))
    dealt = numbered.repartitionByRange(many, shard, *order, "_row").sortWithinPartitions(shard, *order, "_row").drop("_row")
    at = F.monotonically_increasing_id()
    placed = cut(dealt.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
    return placed.join(parts.drop("_rows", "_first"), [shard, "_part"]).withColumn("slot", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def shard_rows(rows: DataFrame, leaves: list[Leaf] | None = None, grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Law ``key``: the key and the tree decide. ``grown`` is the tree with one more shard, which takes rows only into itself."""
    leaves, grown = tree(SHARDS) if leaves is None else leaves, tree(SHARDS + 1) if grown is None else grown
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    put = rows.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        place_by_key(name, leaves).alias("shard"),
        place_by_key(name, grown).alias("grown_shard"),
    )
    return slots(put, "shard", [key, "text_crc32", "size"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _crc_step(x: int) -> int:
    """An entry of the checksum's table: a byte through eight steps of division by the reflected polynomial."""
    return reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), x)


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned checksum of a text's UTF-8 bytes."""
    step = f"xor(c >> 8, list_extract({[_crc_step(x) for x in range(256)]}::UINTEGER[], CAST(xor(c, x) & 255 AS BIGINT) + 1))"
    values = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS UINTEGER))"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, {values}), lambda c, x: {step}), 4294967295::UINTEGER) AS BIGINT)"


def _sql_uniform(digest: str, first: int, digits: int) -> str:
    return f"((CAST('0x' || substr({digest}, {first}, {digits}) AS UBIGINT) + 0.5::DOUBLE) / {16**digits}::DOUBLE)"


_REGION = "least(floor({u} * 4), 3)"
ORACLE = {
    "op7_sharding": f"""
WITH b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
  list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS UINTEGER)) AS bytes FROM documents),
c AS (SELECT doc_id, size, k, CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes),
  lambda c, x: xor(c >> 8, list_extract({[_crc_step(x) for x in range(256)]}::UINTEGER[], CAST(xor(c, x) & 255 AS BIGINT) + 1))), 4294967295::UINTEGER) AS BIGINT) AS text_crc32 FROM b),
h AS (SELECT *, md5(k || '/0') AS h0, md5(k || '/1') AS h1, md5(k || '/2') AS h2, md5(k || '/2/8') AS h8 FROM c),
t AS (SELECT *, -ln({_sql_uniform("h0", 1, 13)}) / 4 AS t0, -ln({_sql_uniform("h1", 1, 13)}) / 4 AS t1,
  -ln({_sql_uniform("h2", 1, 13)}) / 4 + CASE WHEN {_sql_uniform("h2", 14, 13)} * 4 < 1 THEN 0 ELSE -ln({_sql_uniform("h8", 1, 13)}) END AS t2,
  CAST({_REGION.format(u=_sql_uniform("h0", 14, 13))} AS INTEGER) AS s0, CAST({_REGION.format(u=_sql_uniform("h1", 14, 13))} AS INTEGER) + 4 AS s1 FROM h),
s AS (SELECT doc_id, size, text_crc32, CASE WHEN t0 <= t1 THEN s0 ELSE s1 END AS shard, CASE WHEN t2 < least(t0, t1) THEN 8 WHEN t0 <= t1 THEN s0 ELSE s1 END AS grown_shard FROM t)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard FROM s""",
}
