"""Exact inner-product search over vectors in order of descending length.

1. Every component ``x`` becomes the integer ``floor(scale * x)``. Vectors are range-partitioned
   and sorted by descending length.
2. The matrix of summed outer products, gathered by partial sums, gives the right singular
   vectors. Rotated by them, the leading coordinates hold most of an inner product. Only the first
   ``ROTATED`` components are rotated; further ones of very long vectors count as a rest.
3. Queries go in blocks of bounded bytes, one after the other: a block's queries are sent to the
   tasks, its result is written, and what was sent is released. A block starts from its scores
   against the longest vectors of all; each task then walks over tiles of its vectors, which
   descend within a file but not from file to file. A query passes over a tile whose largest product of lengths
   (Cauchy-Schwarz) is below its k-th score; a pair is dropped when the
   leading coordinates' sum plus the product of the residual lengths is. What is left is scored
   in integers, and the tasks' best are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize

SCALE = 256
#: Bytes of the queries in a block, about, and longest vectors that give the first thresholds, at most as many bytes.
BLOCK_BYTES = 32_000_000
HEAD = 2_048
#: Vectors and queries that are multiplied at a time, and components in a tile, or one vector.
TILE, TILE_CELLS = 1_024, 4_000_000
#: Components that are rotated.
ROTATED = 512


def rows_of(column, dim: int) -> np.ndarray:
    """A list column of integers as a matrix, shorter rows with zeros at the end."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def to_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, v, norm``; vectors that are null or hold null or non-finite components are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    rows = vectors.filter(ok).select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def tiles(batch, dim: int):
    """Parts of an Arrow batch ``id, v`` as ids and matrices, of bounded size; no wider than their longest vector."""
    import pyarrow.compute as pc

    longest = max(1, pc.max(batch.column(1).value_lengths()).as_py() or 1) if batch.num_rows else 1
    step = max(1, min(TILE, TILE_CELLS // longest))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        width = min(dim, max(1, pc.max(part.column(1).value_lengths()).as_py() or 1))
        yield part.column(0).to_numpy(), rows_of(part.column(1), width)


def rotate_leading(m: np.ndarray, rotate: np.ndarray) -> np.ndarray:
    """The leading components rotated; rows are as wide as the rotation at least."""
    r = len(rotate)
    m = np.pad(m, ((0, 0), (0, max(0, r - m.shape[1]))))
    return np.concatenate([m[:, :r] @ rotate, m[:, r:]], axis=1)


def rotation(ints: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the first ``dim`` components, by descending singular value, from summed outer products of all rows."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for b in batches:
            m = rows_of(b.column(0), dim)
            total += m.T @ m
        at = np.arange(dim * dim)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total.ravel(), pa.float64())], ["at", "x"])

    sums = ints.select(F.slice("v", 1, dim).alias("v")).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros(dim * dim)
    gram[sums["at"].to_numpy()] = sums["x"].to_numpy()
    _, vectors = np.linalg.eigh(gram.reshape(dim, dim))
    return vectors[:, ::-1].copy()


class Best:
    """The k best of each query so far: score descending, then id ascending."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.q = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        keep = order[nth < self.k]
        self.q, self.id, self.score = q[nth < self.k], ids[keep], score[keep]

    def thresholds(self, least: np.ndarray) -> np.ndarray:
        """Each query's k-th score, or ``least`` where that is larger."""
        out = least.copy()
        if len(self.q):
            ends = np.flatnonzero(np.diff(self.q, append=-1))
            full = ends[np.bincount(self.q, minlength=self.n)[self.q[ends]] == self.k]
            np.maximum.at(out, self.q[full], self.score[full])
        return out


def scan(chunks, q_ids: np.ndarray, q: np.ndarray, rotate: np.ndarray, least: np.ndarray, k: int, lead: int) -> Best:
    """``chunks``: (ids, integer vectors), best by descending length, right in any order. Scores below ``least`` are not wanted."""
    best, slack = Best(len(q_ids), k), 1e-6
    qr = rotate_leading(q, rotate)
    q_norm, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(qr[:, lead:], axis=1)
    limit = least.copy()
    for ids, v in chunks:
        norm = np.linalg.norm(v, axis=1)
        live = np.flatnonzero(q_norm * norm.max(initial=0.0) * (1 + slack) + slack >= limit)
        if not len(live):
            continue  # a task reads several files, by size: longer vectors may follow
        vr = rotate_leading(v, rotate)
        rest = np.linalg.norm(vr[:, lead:], axis=1)
        width = min(q.shape[1], v.shape[1])  # what is missing is zero
        for a in range(0, len(live), TILE):
            at = live[a : a + TILE]
            bound = qr[at, :lead] @ vr[:, :lead].T + np.outer(q_rest[at], rest)
            bound += slack * (1 + np.outer(q_norm[at], norm))
            i, j = np.nonzero((bound >= limit[at, None]) & (q_ids[at, None] != ids[None, :]))
            if 4 * len(i) > bound.size:
                score = (q[at, :width] @ v[:, :width].T)[i, j]
            else:
                step = max(1, min(50_000, TILE_CELLS // width))
                score = np.concatenate([np.einsum("ij,ij->i", q[at[i[s : s + step]], :width], v[j[s : s + step], :width]) for s in range(0, max(1, len(i)), step)])
            good = score >= limit[at[i]]
            best.add(at[i[good]], ids[j[good]], score[good])
        limit = best.thresholds(limit)
    return best


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` largest integer inner products of each row that ``is_query`` holds for: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``id``. Candidates are all rows but those with the query's own
    id; ties go to the smaller id; a query with fewer candidates gets all of them. Rows with a
    null id, a null vector, or null or non-finite components take no part. Shorter vectors count
    as filled up with zeros. Rows that repeat an id are candidates on their own, and a repeated
    query is answered once for each row. Scores are exact below 2^53. Other columns are not read,
    whatever their names. No rows give no rows.
    """
    spark = vectors.sparkSession
    ints = to_integers(vectors, id_col, vec_col, scale).filter("id is not null")
    sorted_ = ints.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm"), "id")
    # written once, so that a row's number stays the same
    sorted_ = materialize(sorted_.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    queries = sorted_.filter(is_query)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("longest"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("cells")).first()
    longest = sorted_.agg(F.coalesce(F.max(F.size("v")), F.lit(1)).alias("n")).first().n
    rotate = rotation(sorted_, max(1, min(longest, ROTATED)))
    lead = max(1, len(rotate) // 4)
    dim = max(1, size.longest)
    n_head = max(1, min(HEAD, block_bytes // (8 * longest)))
    head = sorted_.orderBy(F.desc("norm"), "id").limit(n_head).select("id", "v").toArrow().combine_chunks().to_batches()
    n_blocks = max(1, -(-8 * size.n * dim // block_bytes))
    out = None
    for block in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)) == block).select("id", "v").toArrow()
        q_ids, q = rows.column("id").to_numpy(), rows_of(rows.column("v").combine_chunks(), dim)
        least = np.full(len(q_ids), -np.inf)
        least = scan((t for b in head for t in tiles(b, longest)), q_ids, q, rotate, least, k, lead).thresholds(least)
        sent = spark.sparkContext.broadcast((q_ids, q, rotate, least))

        def run(batches, sent=sent):
            import pyarrow as pa

            q_ids, q, rotate, least = sent.value
            best = scan((t for b in batches for t in tiles(b, longest)), q_ids, q, rotate, least, k, lead)
            yield pa.record_batch([pa.array(best.q, pa.int64()), pa.array(q_ids[best.q], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score.astype(np.int64), pa.int64())], ["q", "query_id", "vec_id", "score"])

        found = sorted_.select("id", "v").mapInArrow(run, "q long, query_id long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found = materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
