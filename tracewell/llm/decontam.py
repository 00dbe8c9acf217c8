"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows are its runs of ``WINDOW`` consecutive words (an item of fewer words is one
window). A document that holds a window holds all of the window's shingles, so of the shingles,
ordered by how rare they are over all documents, the first alone is a necessary prefix. The join
finds every document shingle among the windows' prefix shingles; the place of the shingle in
its window fixes where the window would lie in the document (positional bound), and it must fit
between the document's ends (length bound). What passes is verified byte for byte.

Items of at most ``PART_BYTES`` of text, which is checked, are broadcast, and documents look their
shingles up where they lie. More items than that are joined by shuffles: windows, the documents'
shingle counts, prefixes and the documents' shingles are all distributed tables, of which nothing
is collected or broadcast but a table of ``SIEVE`` bits that keeps most document shingles from
being shuffled at all. Join keys are salted, so a frequent shingle or a window of many items
doesn't meet in one task.

Edge cases: null and empty texts have no words; an item without words has no windows; items that
share an id count once; a repeated document is judged each time; empty tables give no hits or
an empty result; other columns are not carried by ``find_items``, and all of them by
``drop_contaminated``. A group of copies costs what its texts cost.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, table
from ._text import Words, grams, lookup, sieve, slices, spread, words

WINDOW = 10
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Bytes of items up to which they are broadcast. As windows and shingles they take about a hundred times that in the driver and in each worker.
PART_BYTES = 1 << 20
#: Bits of the table of prefix shingles, as a power of two: 2 MB.
SIEVE = 24
#: Into how many parts a join key is split.
SALT = 8

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def same_words(w: Words, start: np.ndarray, v: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words of ``w`` from ``start`` are those of ``v`` from ``first``, byte for byte with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, dtype=bool)
    of = np.repeat(np.arange(len(start)), n)
    x, y = spread(start, start + n), spread(first, first + n)
    good = np.bincount(of, weights=(w.hashes[x] != v.hashes[y]) | (w.ends[x] - w.starts[x] != v.ends[y] - v.starts[y]), minlength=len(start)) == 0
    x, y, of = x[good[of]], y[good[of]], of[good[of]]
    other = _LOWER[w.buffer[spread(w.starts[x], w.ends[x])]] != _LOWER[v.buffer[spread(v.starts[y], v.ends[y])]]
    good[np.repeat(of, w.ends[x] - w.starts[x])[other]] = False
    return good


class Windows:
    """The distinct windows of some items, and their shingles."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, shingle: int):
        self.words = w = words(pa.array([t for _, t in items], pa.string()), "alnum")
        seen: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        first, size = [], []
        self.hashes: list[np.ndarray] = []
        for k, (item, _) in enumerate(items):
            lo, hi = int(w.bounds[k]), int(w.bounds[k + 1])
            n = min(window, hi - lo)
            for start in range(lo, hi - n + 1) if n else ():
                spelled = b" ".join(_LOWER[w.buffer[w.starts[j] : w.ends[j]]].tobytes() for j in range(start, start + n))
                at = seen.setdefault(spelled, len(seen))
                if at == len(first):
                    first.append(start)
                    size.append(n)
                    self.hashes.append(w.hashes[start : start + n])
                    self.owners.append(set())
                self.owners[at].add("" if item is None else str(item))
        self.first, self.size = np.array(first, dtype=np.int64), np.array(size, dtype=np.int64)
        #: shingle length -> distinct shingle hashes, sorted
        found = defaultdict(list)
        for h in self.hashes:
            k = min(shingle, len(h))
            found[k].append(grams(h, k))
        self.shingles = {k: np.unique(np.concatenate(v)) for k, v in found.items()}
        self.shingle = shingle

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple]:
        """By shingle length: sorted prefix shingles, and for each its (window, place) pairs as flat arrays."""
        chosen = defaultdict(lambda: defaultdict(list))
        for at, h in enumerate(self.hashes):
            k = min(self.shingle, len(h))
            own = grams(h, k).tolist()
            place = min(range(len(own)), key=lambda p: (counts.get((k, own[p]), 0), own[p], p))
            chosen[k][own[place]].append((at, place))
        out = {}
        for k, table_ in chosen.items():
            keys = np.array(sorted(table_), dtype=np.uint64)
            lists = [table_[int(x)] for x in keys]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.array([p for x in lists for p in x], dtype=np.int64).reshape(-1, 2)
            out[k] = (keys, sieve(keys), bounds, flat)
        return out


def matches(w: Words, index: dict[int, tuple], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """First words and windows of all occurrences in a batch of texts."""
    starts, which = [], []
    for k, (keys, sieved, bounds, flat) in index.items():
        at, key = lookup(grams(w.hashes, k), keys, sieved)
        rows = spread(bounds[key], bounds[key + 1])
        at = np.repeat(at, bounds[key + 1] - bounds[key])
        window, place = flat[rows, 0], flat[rows, 1]
        start = at - place
        text = np.searchsorted(w.bounds, at, "right") - 1
        fits = (start >= w.bounds[text]) & (start + windows.size[window] <= w.bounds[text + 1])
        starts.append(start[fits])
        which.append(window[fits])
    none = np.zeros(0, dtype=np.int64)
    start, window = np.concatenate(starts or [none]), np.concatenate(which or [none])
    good = same_words(w, start, windows.words, windows.first[window], windows.size[window])
    return start[good], window[good]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in _merge(x)] for x in found], _SPANS)


class _Broadcast:
    """The join with items that are few enough to be broadcast."""

    def __init__(self, docs: DataFrame, text: str, items: list[tuple], window: int, shingle: int):
        self.windows = Windows(items, window, shingle)
        self.shared = prepare(docs.sparkSession).sparkContext.broadcast((self.windows.prefixes(_count(docs, text, self.windows.shingles)), self.windows))

    def find(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Each text's words, hit spans and items found."""
        index, windows = self.shared.value
        w = words(column, "alnum")
        start, which = matches(w, index, windows)
        text = np.searchsorted(w.bounds, start, "right") - 1
        spans, owners = [[] for _ in range(len(column))], [set() for _ in range(len(column))]
        start = start - w.bounds[text]
        for t, s, n in zip(text.tolist(), start.tolist(), windows.size[which].tolist(), strict=True):
            spans[t].append((s, s + n))
        for t, x in set(zip(text.tolist(), which.tolist(), strict=True)):
            owners[t] |= windows.owners[x]
        return np.diff(w.bounds), spans, owners


def _count(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each of the items' shingles occurs in all documents; they are as many as the broadcast items have."""
    if not wanted:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast({k: (v, sieve(v)) for k, v in wanted.items()})

    def work(batches):
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, (v, _) in shared.value.items()}
        for batch in batches:
            for part in slices(batch, 0):
                w = words(part.column(0), "alnum")
                for k, (v, sieved) in shared.value.items():
                    totals[k] += np.bincount(lookup(grams(w.hashes, k), v, sieved)[1], minlength=len(v))
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], names=["k", "at", "n"])

    rows = docs.select(text).mapInArrow(work, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    return {(r.k, int(wanted[r.k][r["at"]])): r.n for r in rows}


# --- items of any number


def _windows(items: DataFrame, key: str, window: int, shingle: int) -> DataFrame:
    """Every item's windows: item, the window's words (w), how many (n), shingle length k and shingles."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, 1):
                w = words(part.column(1), "alnum")
                names, said, sizes, lengths, hashes = [], [], [], [], []
                for item, lo, hi in zip(part.column(0).to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                    n = min(window, hi - lo)
                    if not n:
                        continue
                    k = min(shingle, n)
                    spelled = [_LOWER[w.buffer[w.starts[j] : w.ends[j]]].tobytes().decode("utf-8", "surrogatepass") for j in range(lo, hi)]
                    own = grams(w.hashes[lo:hi], k).view(np.int64)
                    for at in range(hi - lo - n + 1):
                        names.append(item)
                        said.append(" ".join(spelled[at : at + n]))
                        sizes.append(n)
                        lengths.append(k)
                        hashes.append(own[at : at + n - k + 1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(said, pa.string()), pa.array(sizes, pa.int32()), pa.array(lengths, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "w", "n", "k", "shingles"])

    read = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col("text"))
    return read.mapInArrow(work, "item string, w string, n int, k int, shingles array<long>")


def _sieved(prefixes: DataFrame) -> np.ndarray:
    """Which upper bits the prefixes' shingles have; what is collected are 2**SIEVE bits."""
    low = SIEVE - 12

    def bits(group):
        out = np.zeros(1 << low, dtype=np.uint8)
        out[group.column("slot").to_numpy() & ((1 << low) - 1)] = 1
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "bits": [np.packbits(out).tobytes()]})

    slot = F.shiftrightunsigned("shingle", 64 - SIEVE)
    parts = prefixes.select(slot.alias("slot")).distinct().withColumn("part", F.shiftright("slot", low).cast("int")).groupBy("part").applyInArrow(bits, "part int, bits binary")
    out = np.zeros((1 << 12, 1 << low), dtype=bool)
    for part, packed in parts.toLocalIterator():
        out[part] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
    return out.reshape(-1)


def _joined(docs: DataFrame, items: DataFrame, text: str, item_key: str, window: int, shingle: int) -> DataFrame:
    """Row number (_n), spans of words and items of every numbered document with a hit."""
    sc = docs.sparkSession.sparkContext
    every = cut(_windows(items, item_key, window, shingle))
    distinct = every.groupBy("w").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("shingles").alias("shingles"))
    lengths = sorted(r.k for r in every.select("k").distinct().collect())  # at most ``shingle`` of them

    def shingles(batches, tally: bool, table_=None):
        for batch in batches:
            for part in slices(batch, 1):
                w = words(part.column(1), "alnum")
                for k in lengths:
                    g = grams(w.hashes, k)
                    if tally:
                        g, n = np.unique(g, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k), pa.int32()), pa.array(g.view(np.int64)), pa.array(n)], names=["k", "shingle", "times"])
                        continue
                    at = np.flatnonzero(table_.value[(g >> np.uint64(64 - SIEVE)).astype(np.int64)])
                    of = np.searchsorted(w.bounds, at, "right") - 1
                    inside = at + k <= w.bounds[of + 1]
                    at, of = at[inside], of[inside]
                    cols = [part.column(0).take(pa.array(of)), pa.array((w.bounds[of + 1] - w.bounds[of]).astype(np.int64)), pa.array(at - w.bounds[of]), pa.array(np.full(len(at), k), pa.int32()), pa.array(g[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["_n", "size", "at", "k", "shingle"])

    read = docs.select("_n", text)
    counts = read.mapInArrow(lambda b: shingles(b, True), "k int, shingle long, times long").groupBy("k", "shingle").agg(F.sum("times").alias("times"))
    placed = distinct.select("w", "n", "k", F.posexplode("shingles").alias("place", "shingle")).join(counts, ["k", "shingle"], "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "place"))
    prefixes = cut(placed.groupBy("w", "n", "k").agg(rarest.alias("_")).select("w", "n", "k", "_.shingle", "_.place"))
    table_ = sc.broadcast(_sieved(prefixes))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("_n"), F.lit(SALT)).cast("int"))
    postings = salted(read.mapInArrow(lambda b: shingles(b, False, table_), "_n long, size long, at long, k int, shingle long"))
    start = F.col("at") - F.col("place")
    found = postings.join(prefixes.select("*", salts), ["k", "shingle", "salt"]).withColumn("start", start).where((start >= 0) & (start + F.col("n") <= F.col("size")))
    claimed = found.groupBy("_n").agg(F.collect_list(F.struct("start", "n", "w")).alias("claims"))

    def verify(batches):
        for batch in batches:
            for part in slices(batch, 1):
                w, claims = words(part.column(1), "alnum"), part.column(2)
                flat, of = claims.flatten(), np.repeat(np.arange(part.num_rows), np.diff(claims.offsets.to_numpy()))
                v = words(flat.field("w"), "alnum")
                starts, n = flat.field("start").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
                good = same_words(w, starts + w.bounds[of], v, v.bounds[:-1], n)
                keep = pa.array(good)
                cols = [part.column(0).take(pa.array(of[good])), pa.array(starts[good]), pa.array(n[good]), flat.field("w").filter(keep)]
                yield pa.RecordBatch.from_arrays(cols, names=["_n", "start", "n", "w"])

    hits = cut(read.join(claimed, "_n").mapInArrow(verify, "_n long, start long, n long, w string"))
    owned = salted(hits.select("_n", "w").distinct()).join(every.select("w", "item").distinct().select("*", salts), ["w", "salt"])
    items_of = owned.groupBy("_n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hits.groupBy("_n").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans")).join(items_of, "_n")


# --- what callers use


def _few(items: DataFrame, item_key: str) -> list[tuple] | None:
    """The items, if they are at most PART_BYTES with 64 bytes each for what else they need."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return [tuple(r) for r in items.select(item_key, "text").collect()] if size <= PART_BYTES else None


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """For each document: n_words, hit spans of words [start, end) in order, and the ids of the items found."""
    prepare(docs.sparkSession)
    kind, few = docs.schema[key].dataType.simpleString(), _few(items, item_key)
    if few is not None:
        join = _Broadcast(docs, text, few, window, shingle)

        def work(batches):
            for batch in batches:
                for part in slices(batch, 1):
                    n, spans, owners = join.find(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _spans(spans), pa.array([sorted(o) for o in owners], pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])

        return docs.select(key, text).mapInArrow(work, f"{key} {kind}, {_FOUND}")
    numbered = cut(docs.select(key, text).withColumn("_n", F.monotonically_increasing_id()))
    found = numbered.join(_joined(numbered, items, text, item_key, window, shingle), "_n", "left").select(key, text, "spans", "items")

    def report_(batches):
        for batch in batches:
            for part in slices(batch, 1):
                spans = [[(s["start"], s["end"]) for s in x or ()] for x in part.column(2).to_pylist()]
                n = np.diff(words(part.column(1), "alnum").bounds)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _spans(spans), pa.array([x or [] for x in part.column(3).to_pylist()], pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])

    return found.mapInArrow(report_, f"{key} {kind}, {_FOUND}")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_items``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    prepare(docs.sparkSession)
    few = _few(items, item_key)
    if few is None:
        numbered = cut(docs.withColumn("_n", F.monotonically_increasing_id()))
        return numbered.join(_joined(numbered, items, "text", item_key, WINDOW, SHINGLE), "_n", "left_anti").drop("_n")
    join, at = _Broadcast(docs, "text", few, WINDOW, SHINGLE), docs.columns.index("text")

    def work(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([not o for o in join.find(part.column(at))[2]], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = {
    "op9_decontam": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS said FROM s),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d),
g AS (SELECT doc_id, pos, n, array_to_string(ws[pos:pos + n - 1], ' ') AS said FROM p, (SELECT DISTINCT n FROM w) AS l WHERE pos + n - 1 <= len(ws)),
m AS (SELECT g.doc_id, g.pos, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.said = w.said),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id""",
}
