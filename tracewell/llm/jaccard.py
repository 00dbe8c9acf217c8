"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles; two link if 100 * |A and B| is at least
90 * |A or B|. Tokens (shingles) are put in one global order, rare ones first. By how many
documents hold them they are of one of four levels; the first three make up the rare class, whose
tokens are indexed singly, the last one the frequent class, whose tokens are split by hash into
sub-classes and indexed by pairs within a sub-class. A prefix grows along the global order until
it holds n - ceil(0.9 n) + 1 effective tokens: a rare token counts 1, and a sub-class with m
tokens counts m - 1, since sharing no pair leaves at most one shared token. Two sets that share no
signature of their prefixes therefore overlap too little to link. Tokens that a single document
holds are in the prefix but need no index entry.

How many sub-classes there are depends on the power of two that a set's size is in (small sets
index all tokens singly). A set whose partners may be in the next power also gives that one's
signatures.

Levels come from exact counts over all documents. Documents are dealt into chunks of some million
tokens, which go to the shared checkpoint folder. A chunk sends its distinct tokens to ranges of
token hashes, and each range answers every chunk with its tokens' levels, so no table of tokens is
broadcast or collected, at any size of the input. A text stays with its row only if it has
signatures.

Documents of one set are one class, so copies need no pairs. The documents of a signature are
not paired with each other but with one hub, that with the fewest tokens of its own, and described
by how they differ from it: for two documents x and y of one hub, the symmetric difference of x and y is
that of their differences, which are small where copies are near. Documents that link with the
hub are in one component. For any other pair (sizes differ by no more than the differences do) the
differences must overlap, by an amount that the sizes give, so a second prefix index, over the differences of each hub's documents (added
tokens first, rare ones before frequent ones, then removed ones) with bounds on size and
position, finds all pairs that may link. These are verified on the whole texts. Components are
those of all links.

Edge cases: null and empty texts and texts without words have the empty set, link with nothing
and are components of their own; a text of fewer words than a shingle has one shingle; repeated
rows are in one class; rows with a null id belong to their text's component; an empty table gives
an empty result; other columns are not carried. A threshold under 30 per cent is an error:
sub-classes couldn't complete prefixes. Sets are compared by the 64-bit hashes of their shingles,
and classes are told apart by two sums of those and their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, range_bits, release, stored, table
from ._text import U64, bytes_of, mix, shingles, slices, words
from .components import components

SHINGLE = 3
PERCENT = 90
#: Documents that hold a token of level 1, 2 and 3 (frequent), at least.
LEVELS = (2, 4, 16)
FREQUENT = 3
LEAST_PERCENT = 30
#: Ranges of token hashes that are counted together, as bits; so many bytes of input (as the optimiser knows it) fill one.
RANGE_BITS, RANGE_BYTES, MOST_BITS = 8, 4_000_000, 18
#: Sets below this size index single tokens only; above, one sub-class for each so many tokens.
SMALL = 16
#: Bytes of text in a chunk.
CHUNK = 6_000_000
#: Into how many parts a token of a hub's differences is split.
SALT = 8

_SHUT, _OPENED = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray | bytes) -> bytes:
    return _SHUT.compress(np.ascontiguousarray(x) if isinstance(x, np.ndarray) else x)


def _bytes(blob: bytes) -> bytes:
    return _OPENED.decompress(blob)


def _open(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_OPENED.decompress(blob), dtype=kind)


def sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and n + 1 bounds. Some megabytes of text are taken at a time."""
    parts = [_sets(p.column(0), shingle) for p in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0)]
    if len(parts) == 1:
        return parts[0]
    ends = np.cumsum([0, *[len(t) for t, _ in parts]])
    tokens = np.concatenate([np.zeros(0, dtype=U64), *[t for t, _ in parts]])
    return tokens, np.concatenate([np.zeros(1, dtype=np.int64), *[b[1:] + e for (_, b), e in zip(parts, ends[:-1], strict=True)]])


def _sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    h, bounds = shingles(words(column, "space"), shingle)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.searchsorted(text[first], np.arange(len(bounds)))


def _chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of rows: their keys and texts."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        seq, held, size = 0, [], 0

        def send():
            ids = pa.concat_arrays([i for i, _ in held])
            raw = [bytes_of(t) for _, t in held]
            ends = np.cumsum(np.concatenate([[0], *[np.diff(o) for _, o in raw]]))
            cols = [pa.array([(TaskContext.get().partitionId() << 32) | seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            cols += [pa.array([_pack(x)], pa.binary()) for x in (ends.astype(np.int64), np.concatenate([r for r, _ in raw]))]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "ends", "texts"])

        for batch in batches:
            for part in slices(batch, 1):
                held.append((part.column(0), part.column(1)))
                size += part.column(1).nbytes
                if size >= CHUNK:
                    yield send()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield send()

    return docs.select(key, text).mapInArrow(work, f"chunk long, ids array<{kind}>, ends binary, texts binary")


def _texts_of(ends: bytes, texts: bytes) -> pa.Array:
    ends, raw = _open(ends, np.int64), _bytes(texts)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))


def _levels(chunks: DataFrame, shingle: int, bits: int) -> DataFrame:
    """For each chunk and hash range the levels of the chunk's distinct tokens there, in order.

    A range knows 32 bits of its tokens' hashes: where two are the same, a level is too high, which never loses a link.
    """

    def send(batches):
        for batch in batches:
            for chunk, ends, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, n = np.unique(sets_of(_texts_of(ends, texts), shingle)[0], return_counts=True)
                edges = np.append(np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)), len(tokens)).tolist()
                low, n = (tokens >> U64(32 - bits)).astype(np.uint32), n.astype(np.uint32)
                parts = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
                for at in range(0, len(parts), 10_000):
                    some = parts[at : at + 10_000]
                    cols = [pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([low[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())]
                    # Most tokens are in one document of a chunk; a null says that all are.
                    many = [n[edges[k] : edges[k + 1]] for k in some]
                    cols.append(pa.array([None if x.max() == 1 else _pack(x) for x in many], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["chunk", "part", "tokens", "times"])

    def level(group):
        tokens = [np.frombuffer(x, dtype=np.uint32) for x in group.column("tokens").to_pylist()]
        times = [np.ones(len(t), dtype=np.uint32) if x is None else _open(x, np.uint32) for t, x in zip(tokens, group.column("times").to_pylist(), strict=True)]
        edges = np.cumsum([0, *map(len, tokens)])
        order = np.argsort(np.concatenate(tokens), kind="stable")
        begins = np.flatnonzero(np.diff(np.concatenate(tokens)[order].astype(np.int64), prepend=-1))
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), begins)
        held = np.repeat(np.searchsorted(np.array(LEVELS), total, "right").astype(np.uint8), np.diff(np.append(begins, len(order))))
        out = np.empty(len(order), dtype=np.uint8)
        out[order] = held
        packed = [_pack(out[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([group.column("chunk"), group.column("part"), pa.array(packed, pa.binary())], names=["chunk", "part", "levels"])

    sent = chunks.select("chunk", "ends", "texts").mapInArrow(send, "chunk long, part int, tokens binary, times binary")
    return sent.groupBy("part").applyInArrow(level, "chunk long, part int, levels binary")


def needed(n: int, percent: int = PERCENT) -> int:
    """Effective tokens in the prefix of a set of n."""
    return n - -(-percent * n // 100) + 1


def schemes(n: int, percent: int = PERCENT) -> list[int]:
    """The powers of two whose signatures a set of n gives: its own, and those above that a partner may be in."""
    return list(range(n.bit_length() - 1, (100 * n // percent).bit_length()))


def signatures(tokens: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set; ``levels`` belong to ``tokens``, which are distinct."""
    n = len(tokens)
    if not n:
        return tokens
    order = np.lexsort((tokens, levels))
    tokens, levels = tokens[order], levels[order]
    want, rare = needed(n, percent), int(np.searchsorted(levels, FREQUENT))
    if want <= rare:
        return tokens[:want][levels[:want] > 0]
    found = [tokens[:rare][levels[:rare] > 0]]
    for scheme in schemes(n, percent):
        if 1 << scheme < SMALL:
            found.append(tokens[rare:want])
            continue
        classes = (1 << scheme) // SMALL
        of = (tokens[rare:] % U64(classes)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(classes)]
        left, pairs = want - rare, []
        for token, c in zip(tokens[rare:].tolist(), of.tolist(), strict=True):
            if not left:
                break
            left -= bool(members[c])
            pairs += [(token, other) for other in members[c]]
            members[c].append(token)
        if left:
            raise ArithmeticError("a prefix can't be completed")  # not from LEAST_PERCENT on
        if pairs:
            p = np.sort(np.array(pairs, dtype=np.uint64), axis=1)
            found.append(mix(mix(p[:, 0]) + p[:, 1] + U64(scheme)))
    return np.unique(np.concatenate(found))


_SET = "n long, alone long, h1 long, h2 long, sigs array<long>, said binary, rarity binary"


def _prefixes(chunks: DataFrame, levels: DataFrame, key: str, kind: str, shingle: int, percent: int) -> DataFrame:
    """Of each row its set's size and hashes, and where it has signatures those, its tokens' levels and the compressed text."""

    def work(left, right):
        names = [key, "n", "alone", "h1", "h2", "sigs", "said", "rarity"]
        if not left.num_rows:
            none = [left.schema.field("ids").type.value_type, *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.table([pa.array([], t) for t in none], names=names)
        texts = _texts_of(left.column("ends")[0].as_py(), left.column("texts")[0].as_py())
        tokens, bounds = sets_of(texts, shingle)
        answered = sorted(zip(right.column("part").to_pylist(), right.column("levels").to_pylist(), strict=True))
        every = np.concatenate([np.zeros(0, dtype=np.uint8), *[_open(x, np.uint8) for _, x in answered]])
        level = every[np.unique(tokens, return_inverse=True)[1]]
        n = np.diff(bounds)
        zero = np.zeros(1, dtype=U64)
        high = np.concatenate([zero, np.cumsum(mix(tokens))])
        low = np.concatenate([zero, np.cumsum(mix(tokens ^ U64(0x5851F42D4C957F2D)))])
        lone = np.concatenate([[0], np.cumsum(level == 0)])
        alone = lone[bounds[1:]] - lone[bounds[:-1]]
        short = np.flatnonzero((n > 0) & (alone < n - -(-percent * n // 100) + 1))
        sigs, said, rarity = [None] * len(n), [None] * len(n), [None] * len(n)
        for k in short.tolist():
            own = level[bounds[k] : bounds[k + 1]]
            s = signatures(tokens[bounds[k] : bounds[k + 1]], own, percent)
            if len(s):
                sigs[k], rarity[k] = s.view(np.int64), _pack(own)
                said[k] = _pack(texts[k].as_buffer().to_pybytes())
        two = [pa.array((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64)) for x in (high, low)]
        cols = [left.column("ids").combine_chunks().flatten(), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), *two, pa.array(sigs, pa.list_(pa.int64())), pa.array(said, pa.binary()), pa.array(rarity, pa.binary())]
        return pa.table(cols, names=names)

    return chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(work, f"{key} {kind}, {_SET}")


def _texts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the compressed texts of both, and the levels of b's tokens."""
    named = lambda c: sets.select(F.col("node").alias(c), F.col("said").alias(f"_{c}"))
    rarer = sets.select(F.col("node").alias("b"), F.col("said").alias("_b"), "rarity")
    return pairs.join(rarer, "b").join(named("a"), "a").select("a", "b", "_a", "_b", "rarity")


def _each_pair(batch: pa.RecordBatch, shingle: int):
    """Parts of a batch of ``_texts``, where the sets of each row's two texts are, and all sets' tokens."""
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        said: dict[bytes, int] = {}
        places = [[said.setdefault(x, len(said)) for x in part.column(c).to_pylist()] for c in (2, 3)]
        raw = [_bytes(x) for x in said]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        tokens, bounds = sets_of(pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(b"".join(raw))), shingle)
        yield part, [(slice(bounds[x], bounds[x + 1]), slice(bounds[y], bounds[y + 1])) for x, y in zip(*places, strict=True)], tokens


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x (both sorted, not empty) are in y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _verified(pairs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets link."""

    def work(batches):
        for batch in batches:
            for part, places, tokens in _each_pair(batch, shingle):
                good = []
                for x, y in places:
                    both = int(_held(tokens[x], tokens[y]).sum())
                    good.append(100 * both >= percent * (x.stop - x.start + y.stop - y.start - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    return _texts(pairs, sets).mapInArrow(work, "a long, b long")


def allowed(total: int, percent: int = PERCENT) -> int:
    """How many tokens two linked sets of so many together may not share, at most."""
    return (100 - percent) * total // (100 + percent)


def difference(x: np.ndarray, levels: np.ndarray, hub: np.ndarray, percent: int = PERCENT) -> tuple[bool, int, np.ndarray, np.ndarray]:
    """Whether x links with its hub, how many tokens differ, and the prefix of the difference: tokens and places.

    A prefix holds all of the difference if x links with the hub, else as many tokens as linked
    sets may differ by, and one; of these those are given that other documents may have.
    """
    extra, lost = ~_held(x, hub), ~_held(hub, x)
    added, rarity = x[extra], levels[extra]
    n, near = len(added) + int(lost.sum()), allowed(len(x) + len(hub), percent)
    most = allowed(len(x) + 100 * len(x) // percent, percent)  # with any set that x may link with
    order = np.lexsort((added, rarity))
    tokens = np.concatenate([added[order], hub[lost]])
    shared = np.concatenate([rarity[order] > 0, np.ones(n - len(added), dtype=bool)])
    place = np.flatnonzero(shared[: n if n <= near else most + 1])
    return n <= near, n, tokens[place], place


def _differences(pairs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of each (hub a, document b) the ``difference``."""

    def work(batches):
        for batch in batches:
            for part, places, tokens in _each_pair(batch, shingle):
                rarity = [_open(r, np.uint8) for r in part.column(4).to_pylist()]
                done = [difference(tokens[y], r, tokens[x], percent) for (x, y), r in zip(places, rarity, strict=True)]
                cols = [pa.array([d[k] for d in done], t) for k, t in ((0, pa.bool_()), (1, pa.int64()))]
                cols.append(pa.array([d[2].view(np.int64) for d in done], pa.list_(pa.int64())))
                cols.append(pa.array([d[3] for d in done], pa.list_(pa.int64())))
                size = pa.array([y.stop - y.start for _, y in places], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], size, *cols], names=["hub", "node", "n", "near", "differ", "tokens", "places"])

    return _texts(pairs, sets).mapInArrow(work, "hub long, node long, n long, near boolean, differ long, tokens array<long>, places array<long>")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, ranges: int | None = None) -> DataFrame:
    """Key, n_shingles and component_id of every row.

    Components only, no list or number of links: documents that both link with one hub are in its
    component already, so the pair is never verified.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the threshold has to be from {LEAST_PERCENT} to 100 per cent")
    spark = prepare(docs.sparkSession)
    bits = range_bits(docs, RANGE_BITS, RANGE_BYTES, MOST_BITS) if ranges is None else ranges
    chunks = cut(_chunks(docs, key, text))
    rows = cut(_prefixes(chunks, _levels(chunks, shingle, bits), key, docs.schema[key].dataType.simpleString(), shingle, percent))
    release(spark, chunks)
    one = ["h1", "h2", "n"]  # what tells classes of equal sets apart
    kept = rows.where(F.col("sigs").isNotNull()).groupBy(*one).agg(F.max(F.struct("alone", "said", "rarity", "sigs")).alias("_"))
    sets = cut(kept.select(*one, "_.*", F.monotonically_increasing_id().alias("node")))
    entries = sets.select("node", "alone", F.explode("sigs").alias("sig"))
    hubs = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct("alone", "node"))["node"].alias("a")).where("_m > 1").select("sig", "a")
    pairs = entries.join(hubs, "sig").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    differ = cut(_differences(pairs, sets, shingle, percent))
    del kept, entries, hubs, pairs
    release(spark)
    parts = F.explode(F.arrays_zip("tokens", "places")).alias("_")
    each = differ.select("hub", "node", "n", "near", "differ", parts).select("hub", "node", "n", "near", "differ", F.col("_.tokens").alias("token"), F.col("_.places").alias("place"))
    named = lambda df, side: df.select("hub", "token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "near", "differ", "place")])
    # Two documents near their hub are in its component already; so one of a pair is far from it.
    x = named(each.where("NOT near"), "x").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    y = named(each, "y").withColumn("salt", F.pmod(F.xxhash64("node_y"), F.lit(SALT)).cast("int"))
    c = F.col
    most = F.floor((100 - percent) * (c("n_x") + c("n_y")) / (100 + percent))
    overlap = F.ceil((c("differ_x") + c("differ_y") - most) / 2)
    fits = (c("place_x") + overlap <= c("differ_x")) & (c("place_y") + overlap <= c("differ_y"))
    found = x.join(y, ["hub", "token", "salt"]).where((c("node_x") != c("node_y")) & (c("near_y") | (c("node_x") < c("node_y"))) & fits)
    found = found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    links = differ.where("near").select(c("hub").alias("a"), c("node").alias("b")).union(_verified(found, sets, shingle, percent))
    roots = components(links)
    first = rows.where("n > 0").groupBy(*one).agg(F.min(key).alias("_first"))
    classes = cut(first.join(sets.select(*one, "node").join(roots, "node"), one, "left").select(*one, "_first", "root"))
    # Written apart, so that the joins by root are of two shuffled sides, which Spark can split where one root has many classes.
    least = cut(classes.where("root IS NOT NULL").groupBy("root").agg(F.min("_first").alias("_least")))
    named = classes.join(least, "root", "left").select(*one, F.coalesce("_least", "_first").alias("component_id"))
    return rows.select(key, *one).join(named, one, "left").select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col(key)).alias("component_id"))


#: What the pipeline's stage takes for near copies.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT) -> DataFrame:
    """Of each component's documents that with the smallest id (of repeated rows one), with all columns.

    Rows are numbered once, in a table that every later step reads.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = join(numbered, "_row", shingle=shingle, percent=percent).select("_row", F.col("component_id").alias("_group"))
    named = groups.join(numbered.select("_row", "doc_id"), "_row")
    kept = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row"))["_row"].alias("_row")).select("_row")
    return numbered.join(kept, "_row", "left_semi").drop("_row")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
