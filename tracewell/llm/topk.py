"""Exact top-k by inner product: term-at-a-time accumulation into dense score arrays.

Vectors become integers, floor(1024 * x) of each component as a double. A dimension is a term;
its postings are the candidates with a non-zero component there. Query rows are sparse: for each
non-zero component the weighted postings are added to a dense array of scores, one slot a
candidate. The k best of each array are found by partition selection, and the lists of all
candidate chunks are merged.

Queries and candidates meet in blocks: candidates are dealt into chunks of about
``CHUNK`` rows and queries into blocks of about ``BLOCK`` rows, both by hash, and each (block,
chunk) pair is one group of bounded size. A stated query set against all rows needs that work;
what is shuffled is the candidates once for each block and the queries once for each chunk.

Edge cases: a vector that is null, or holds a null or non-finite component, takes no part; a
null id takes no part either; missing trailing components count as 0; an empty vector scores 0;
ties go to the smaller id. A query skips its own row alone: rows that repeat its id are candidates,
and each row of a repeated query id gets a list of its own under that id. Scores beyond 64 bits are
set to its limits (the sums themselves are exact), and then ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, prepare, table

K = 10
EVERY = 100
CHUNK = 8_192
BLOCK = 16_384
SCALE = 1024
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of floor(1024 * x); exact Python integers where 64 bits could overflow."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(out * SCALE)
    top = float(np.abs(scaled).max()) if scaled.size else 0.0
    if top * top * max(width, 1) < 2.0**62:
        return scaled.astype(np.int64)
    exact = np.empty(out.shape, dtype=object)
    for at, x in np.ndenumerate(out):
        n, d = float(x).as_integer_ratio()
        exact[at] = n * SCALE // d
    return exact


def search(asking: np.ndarray, queries: np.ndarray, having: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's row number, candidate's id, score) of each query's k best among these candidates (row numbers ``having``)."""
    order = np.lexsort((having, ids))
    ids, own = ids[order], {n: at for at, n in enumerate(having[order].tolist())}
    width = min(queries.shape[1], rows.shape[1])
    wide = object if object in (queries.dtype, rows.dtype) else np.int64
    if wide is np.int64 and rows.size and queries.size and float(np.abs(rows).max()) * float(np.abs(queries).max()) * max(width, 1) >= 2.0**62:
        wide = object
    columns = rows[order][:, :width].T.astype(wide, copy=False)
    postings = []
    for column in columns:
        held = np.flatnonzero(column)
        postings.append((slice(None), np.ascontiguousarray(column)) if len(held) == len(ids) else (held, column[held]))
    out, scores = [], np.zeros(len(ids), dtype=wide)
    for q, weights in zip(asking.tolist(), queries, strict=True):
        scores[:] = 0
        for term in np.flatnonzero(weights[:width]):
            where, values = postings[term]
            scores[where] += wide(weights[term]) * values if wide is np.int64 else int(weights[term]) * values
        if wide is object:
            scores = np.clip(scores, *_LONG)
        there = np.delete(np.arange(len(ids)), own[q]) if q in own else None
        s = scores if there is None else scores[there]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k] if wide is np.int64 else sorted(s)[len(s) - k]
            above = np.flatnonzero(s > least)
            best = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])  # ids ascend: ties to the smaller
        else:
            best = np.arange(len(s))
        for b in best:
            c = b if there is None else there[b]
            out.append((q, int(ids[c]), int(scores[c])))
    return out


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def top_k(rows: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Each query row's k best other rows: query_id, rank, the key and score."""
    prepare(rows.sparkSession)
    held = rows.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # Rows are numbered once: queries and candidates have to agree on the numbers.
    held = cut(held.withColumn("n", F.monotonically_increasing_id()))
    total, asked = held.agg(F.count(F.lit(1)), F.count_if("q")).first()
    chunks, blocks = max(1, math.ceil(total / chunk)), max(1, math.ceil(asked / block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    left = held.where("q").select("n", "v", deal(blocks).alias("b"), numbers(chunks).alias("c"))
    right = held.select("n", "id", "v", deal(chunks).alias("c")).select("n", "id", "v", "c", numbers(blocks).alias("b"))

    def pair(asking: pa.Table, having: pa.Table) -> pa.Table:
        found = []
        if asking.num_rows and having.num_rows:
            whole = [quantised([np.asarray(v.values, dtype=float) for v in t.column("v")]) for t in (asking, having)]
            found = search(asking.column("n").to_numpy(), whole[0], having.column("n").to_numpy(), having.column("id").to_numpy(), whole[1], k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["n", key, "score"])

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(pair, f"n long, {key} long, score long")
    place = Window.partitionBy("n").orderBy(F.desc("score"), key)
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.join(held.where("q").select("n", F.col("id").alias("query_id")), "n").select("query_id", "rank", key, "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = {
    "op3_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
