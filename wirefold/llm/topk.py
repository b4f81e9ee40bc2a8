"""Exact top-k by inner product, aggregating sorted lists without random access.

Candidates are dealt into blocks of bounded size, queries into blocks as well, and every pair of
blocks is one small task: a stated query set against all rows. Inside a task every dimension is a
list of the block's rows sorted by value. A query reads each list from the end that favours it, to a
depth that doubles; a row seen in a list contributes its value, one not yet seen contributes at most
what was read last and at least what the list ends with. That gives every row a lower and an upper
bound. Rows whose upper bound is below the k-th lower bound cannot qualify; reading stops
when no more than k rows are left, or at the lists' ends, and only then are the
remaining rows' scores resolved. The blocks' winners are ranked per query.

Components become floor(scale * x), so scores are integers and ties exact: they go to the smaller
id. In dense vectors the bounds close late; the result is exact at any depth.

Defined results: null vectors, null ids and vectors with null or non-finite components take no part;
vectors of different lengths are compared as if padded with zeros; a query skips every row of its own id;
a query id that repeats counts once, with its smallest vector; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE = 10, 1024
ROWS, QUERIES = 2048, 512            # rows of a candidate block and of a query block
FIRST_DEPTH = 64
EXACT = 1 << 52                      # sums below are exact in doubles; beyond, integers are used


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, or null if the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine,
                  F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class Lists:
    """The sorted lists of one block, one per dimension, read from either end.

    Which rows a list has shown at some depth depends on the end it is read from, not on the query,
    so the bounds of all queries at one depth are two matrix products: positive weights with
    the rows as read from the top, negative ones as read from the bottom.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.n = vectors, len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)

    def _bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (query x row) after reading every list to ``depth``."""
        top, bottom = self.place >= self.n - depth, self.place < depth
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        values, line = self.vectors, self.sorted

        def total(unread_top: np.ndarray, unread_bottom: np.ndarray) -> np.ndarray:
            return (up @ np.where(top, values, unread_top).T
                    + down @ np.where(bottom, values, unread_bottom).T)
        return total(line[0], line[-1]), total(line[self.n - depth], line[depth - 1])

    def best(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k best; no other row can be.

        ``skip`` (query x row) marks rows that take no part for a query.
        """
        found = [np.flatnonzero(~s) for s in skip]
        active = np.flatnonzero([len(f) > k for f in found])
        depth = FIRST_DEPTH
        while depth < self.n and len(active):
            lower, upper = self._bounds(queries[active], depth)
            least = -np.inf if lower.dtype.kind == "f" else np.iinfo(np.int64).min
            lower[skip[active]] = upper[skip[active]] = least
            bar = np.partition(lower, -k, axis=1)[:, -k]
            alive = (upper >= bar[:, None]) & ~skip[active]
            for i, row in zip(active, alive):
                found[i] = np.flatnonzero(row)
            active = active[alive.sum(axis=1) > k]
            depth *= 2
        return found


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _task(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(queries):
            width = max(map(len, [*rows["v"], *queries["v"]]))
            ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
            vectors, asked = _matrix(rows["v"], width), _matrix(queries["v"], width)
            if width * np.abs(vectors).max(initial=0) * np.abs(asked).max(initial=0) < EXACT:
                vectors, asked = vectors.astype(np.float64), asked.astype(np.float64)
            lists = Lists(vectors)
            for query_id, query, near in zip(query_ids, asked, lists.best(
                    asked, k, query_ids[:, None] == ids)):
                score = (lists.vectors[near] @ query).astype(np.int64)
                top = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(top), query_id), ids[near][top], score[top]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))
    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE,
           vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query."""
    def taking_part(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"),
                         whole_numbers(F.col(f"`{vector}`"), scale).alias("v")).where(
                             "id is not null and v is not null")
    rows, asked = taking_part(candidates), taking_part(queries).groupBy("id").agg(F.min("v").alias("v"))
    row_blocks = max(1, -(-rows.count() // ROWS))
    query_blocks = max(1, -(-asked.count() // QUERIES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)))
                .withColumn(other, F.explode(F.sequence(
                    F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))))
    left = dealt(rows, "block", row_blocks, "part", query_blocks).groupBy("block", "part")
    right = dealt(asked, "part", query_blocks, "block", row_blocks).select(
        "id", "v", "block", "part").groupBy("block", "part")
    found = left.cogroup(right).applyInPandas(
        _task(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e),
  lambda z: z[1] * z[2]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
