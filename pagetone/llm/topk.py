"""Exact top-k by inner product: columnar branch and bound.

Vectors lie dimension by dimension (one contiguous column each). For a block of queries, partial scores grow by
one block of dimensions at a time. After each block a candidate's score can gain at most
|rest of query| * |rest of candidate|; candidates that cannot reach the query's k-th best lower bound any more
are dropped and the survivors are compacted. Scores are integers; where floating point could round one, bounds are
widened by what it may be off and the survivors are scored again in integers, so results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetone.session import shared_folder

#: Queries per round, and rows that set the first bounds; both bound what is broadcast.
QUERY_BLOCK, SEED_ROWS = 4096, 4096
DIM_BLOCK = 16
ROWS_AT_ONCE = 4096
#: Sums of products below this are whole in floating point; beyond it a sum of n terms is off by less than n * 2**-52 of |q| |c|.
WHOLE = float(1 << 53)


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds a null or non-finite one."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * scale).cast("bigint")))


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per query (column) the k-th best of these scores, -inf where there are fewer."""
    if scores.shape[0] < k:
        return np.full(scores.shape[1], -np.inf)
    return np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]


class _Queries:
    """Queries of one dimension with the norms of what remains after each block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seeds_ids: np.ndarray, seeds: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.whole = vectors
        self.columns = np.ascontiguousarray(vectors.T.astype(np.float64))  # dims x queries
        self.norm = np.sqrt((self.columns * self.columns).sum(axis=0))
        self.blocks = [(a, min(a + DIM_BLOCK, vectors.shape[1])) for a in range(0, vectors.shape[1], DIM_BLOCK)]
        self.rest = _rests(self.columns, self.blocks)
        self.bound = np.full(len(ids), -np.inf)
        if len(seeds):
            scores = seeds.astype(np.float64) @ self.columns
            scores[seeds_ids[:, None] == ids[None, :]] = -np.inf
            far = np.sqrt((seeds.astype(np.float64) ** 2).sum(axis=1).max()) if seeds.shape[1] else 0.0
            self.bound = _kth_best(scores, k) - _slack(self.norm * far, seeds.shape[1])


def _slack(product: np.ndarray, dims: int) -> np.ndarray:
    """How far a sum in floating point may be off, from |q| |c|."""
    return np.where(product < WHOLE, 0.0, product * (dims + 2) * 2.0 ** -51)


def _rests(columns: np.ndarray, blocks: list[tuple[int, int]]) -> list[np.ndarray]:
    """Upper bounds of the Euclidean norm of the dimensions after each block."""
    square = np.cumsum((columns * columns)[::-1], axis=0)[::-1]
    zero = np.zeros(columns.shape[1])
    return [np.sqrt(square[b]) * (1 + 1e-9) if b < columns.shape[0] else zero for _, b in blocks]


def _search(ids: np.ndarray, vectors: np.ndarray, queries: _Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector id, score) of the candidates that may belong to a query's top k."""
    columns = np.ascontiguousarray(vectors.T.astype(np.float64))
    rest = _rests(columns, queries.blocks)
    n = columns.shape[1]
    far = np.sqrt((columns * columns).sum(axis=0)).max() if n and len(columns) else 0.0
    slack = _slack(queries.norm * far, len(columns))
    partial, alive_q, alive_c = None, None, None
    for step, (a, b) in enumerate(queries.blocks):
        if partial is None:  # every pair is alive: one small matrix product
            full = queries.columns[a:b].T @ columns[a:b]
            may = full + np.outer(queries.rest[step], rest[step])
            alive_q, alive_c = np.nonzero(may + slack[:, None] >= queries.bound[:, None])
            partial = full[alive_q, alive_c]
        else:
            for d in range(a, b):
                partial += queries.columns[d, alive_q] * columns[d, alive_c]
            keep = partial + queries.rest[step][alive_q] * rest[step][alive_c] + slack[alive_q] >= queries.bound[alive_q]
            alive_q, alive_c, partial = alive_q[keep], alive_c[keep], partial[keep]
    if partial is None:
        alive_q, alive_c = (x.ravel() for x in np.meshgrid(np.arange(len(queries.ids)), np.arange(n), indexing="ij"))
        partial = np.zeros(len(alive_q))
    other = queries.ids[alive_q] != ids[alive_c]
    alive_q, alive_c, partial = alive_q[other], alive_c[other], partial[other]
    scores = np.zeros(len(partial), dtype=np.int64)
    large = queries.norm[alive_q] * far >= WHOLE
    scores[~large] = partial[~large].astype(np.int64)
    for part in np.array_split(np.flatnonzero(large), 1 + int(large.sum()) // ROWS_AT_ONCE):
        scores[part] = (queries.whole[alive_q[part]] * vectors[alive_c[part]]).sum(axis=1)
    return alive_q, ids[alive_c], scores


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < k
    return q[top], ids[top], scores[top]


def _matrix(lists: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows grouped by dimension: {dim: (row positions, matrix)}."""
    dims = lists.map(len).to_numpy()
    return {int(d): (np.flatnonzero(dims == d), np.array([lists.iloc[i] for i in np.flatnonzero(dims == d)],
                                                          dtype=np.int64).reshape(-1, int(d)))
            for d in np.unique(dims)}


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, its own id excluded.

    Ties go to the smaller id. Vectors or keys that are null, and vectors with null or non-finite components,
    take no part; vectors are only compared with those of the same number of dimensions. Repeated rows of an
    id are candidates each. Fewer candidates than k give all of them; empty tables give no rows.

    Queries go out in rounds of about QUERY_BLOCK, each with bounds from SEED_ROWS candidates, so a broadcast is
    bounded whatever the number of queries. A round ends, is written to the shared folder and lets go of its
    queries before the next begins. Every task keeps k rows per query of what it has seen; a round's
    ranking therefore reads at most k rows per query and task. Scores must fit a bigint.
    """
    spark = candidates.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("id"), quantized(F.col(vector), scale).alias("v")).filter(
            "id is not null and v is not null")

    asked, pool = usable(queries), usable(candidates)
    rounds = max(1, ceil(asked.count() / QUERY_BLOCK))
    sizes = pool.count()
    share = min(1.0, SEED_ROWS / max(sizes, 1))
    spread = F.pmod(F.xxhash64("id", F.lit("seed")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    seeds = pool.filter(spread).distinct().limit(2 * SEED_ROWS).toPandas()
    by_dim_seeds = _matrix(seeds["v"]) if len(seeds) else {}
    path = f"{shared_folder(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    for r in range(rounds):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).distinct().toPandas()
        searches = {}
        for dim, (rows, matrix) in (_matrix(block["v"]) if len(block) else {}).items():
            at, seed_matrix = by_dim_seeds.get(dim, (np.array([], dtype=int), np.empty((0, dim))))
            searches[dim] = _Queries(block["id"].to_numpy()[rows], matrix, seeds["id"].to_numpy()[at], seed_matrix, k)
        shared = spark.sparkContext.broadcast(searches)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            kept: dict[int, tuple] = {}
            for batch in batches:
                for dim, (rows, matrix) in _matrix(batch["v"]).items():
                    search = shared.value.get(dim)
                    if search is None:
                        continue
                    ids = batch["id"].to_numpy()[rows]
                    for a in range(0, len(ids), ROWS_AT_ONCE):
                        new = _search(ids[a:a + ROWS_AT_ONCE], matrix[a:a + ROWS_AT_ONCE], search)
                        old = kept.get(dim, (np.array([], np.int64),) * 3)
                        kept[dim] = _best(*[np.concatenate(x) for x in zip(old, new, strict=True)], k)
            for dim, (q, ids, scores) in kept.items():
                yield pd.DataFrame({"query_id": shared.value[dim].ids[q], "vec_id": ids, "score": scores})

        part = pool.mapInPandas(scan, "query_id bigint, vec_id bigint, score bigint")
        ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(path)
