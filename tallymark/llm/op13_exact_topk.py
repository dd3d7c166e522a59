"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index cuts vectors into blocks. In a block, each dimension's postings (vector, component) lie in segments of
equal quantised component. A query takes segments from the largest possible impact (query component times the
segment's largest component) downwards and adds them to its vectors' scores. A vector with m dimensions to go scores at most what
it has so far and the m largest impacts that dimensions have left. A query stops when all vectors that could still be among its k
best, by this bound, are few enough to be scored exactly, which costs less than going on; they then are. Nothing is left out without that proof.

Equal vectors are one entry with their k + 1 smallest ids: no other of their ids can be among anyone's k best. Equal queries are
answered once. Queries and blocks meet in tiles, each task holds one block and one group of queries.

Rows: vectors that are null or hold null or values that aren't finite take no part, nor do rows without vec_id, which can't be named.
Repeated rows are rows of their own: a query's own row is left out once. Shorter vectors have zeros after their end. An empty table
gives no rows. Scores beyond 64 bits are not defined.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import table, written

#: Components that fall into one segment: this many neighbouring values.
WIDTH = 4
#: Shares of all postings after which a query looks whether it can stop.
STOPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9)
#: A posting adds its part of the score and one of these, so that one sum gives both the score so far and the dimensions met.
ONE = 2.0**-13


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, vector)``: components times ``scale`` as whole numbers, of all rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where("vec_id is not null and embedding is not null").where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


class Block:
    """The index of one block: each dimension's postings by descending component, cut into segments, one dimension after the other."""

    def __init__(self, vectors: np.ndarray):
        n, self.dims = vectors.shape
        self.vectors, self.real = vectors, vectors.astype(np.float64)
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.ids = np.ascontiguousarray(order.T).ravel()
        self.values = np.ascontiguousarray(np.take_along_axis(self.real, order, axis=0).T).ravel()
        level = np.floor_divide(self.values, WIDTH).reshape(self.dims, n)
        new = np.ones((self.dims, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], n * self.dims)
        self.dim = self.begin // n
        self.first = np.flatnonzero(np.append(True, self.dim[1:] != self.dim[:-1]))  # segment of each dimension
        self.reach = np.maximum(np.abs(self.values[self.begin]), np.abs(self.values[self.end - 1]))  # a segment's largest component, whatever its sign
        self.largest = float(self.reach.max(initial=0))
        self.some_ids, self.parts = np.empty(n * self.dims, np.int64), np.empty(n * self.dims)
        self.stop = len(STOPS) // 2  # where queries have stopped lately; they begin to look just before

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that score as much as the k-th best of this block, or more."""
        n, size = len(self.vectors), float(np.abs(query).max(initial=0)) * self.largest * self.dims
        if size >= 2**52:  # beyond what floating point holds exactly
            at, scores = np.arange(n), self.vectors @ query
        else:
            real = query.astype(np.float64)
            at = self._possible(real, k) if n > 4 * k and size < 2**38 and self.dims < 1 / ONE else np.arange(n)
            scores = (self.real[at] @ real).astype(np.int64)
        if len(at) > k:
            least = np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        return at, scores

    def _take(self, segments: np.ndarray, query: np.ndarray) -> np.ndarray:
        """What these segments add to each vector: score, and ONE for each dimension."""
        first = np.concatenate([[True], (np.diff(segments) != 1) | (np.diff(self.dim[segments]) != 0)])
        begin, end = self.begin[segments[first]], self.end[segments[np.append(first[1:], True)]]
        m, slices = 0, []
        for a, b, q in zip(begin.tolist(), end.tolist(), query[self.dim[segments[first]]].tolist(), strict=True):
            np.multiply(self.values[a:b], q, out=self.parts[m : m + b - a])
            slices.append(self.ids[a:b])
            m += b - a
        self.parts[:m] += ONE
        np.concatenate(slices, out=self.some_ids[:m])
        return np.bincount(self.some_ids[:m], weights=self.parts[:m], minlength=len(self.vectors))

    def _possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places of a superset of the k best, proven by bounds on what is left."""
        n = len(self.vectors)
        impact = np.abs(query[self.dim]) * self.reach
        order = np.argsort(-impact)
        upto = np.cumsum((self.end - self.begin)[order])
        got, taken = np.zeros(n), np.zeros(len(impact), bool)
        for i in range(max(0, self.stop - 1), len(STOPS)):
            lowest = impact[order[min(int(np.searchsorted(upto, STOPS[i] * n * self.dims)), len(order) - 1)]]
            now = np.flatnonzero((impact >= lowest) & ~taken)
            if len(now):
                got += self._take(now, query)
                taken[now] = True
            left = np.maximum.reduceat(np.where(taken, 0.0, impact), self.first)  # of each dimension, no posting that is left adds more
            rest = np.concatenate([[0.0], np.cumsum(np.sort(left)[::-1])])  # what any so many dimensions can still add
            sums = np.floor(got)
            bound = sums + rest[self.dims - ((got - sums) / ONE).astype(np.int64)]
            known = self.real[np.argpartition(-sums, k)[:k]] @ query
            possible = np.flatnonzero(bound >= known.min())  # k vectors are known to score that much
            if len(possible) <= 0.2 * n:  # scoring them costs less than what is left
                self.stop = i
                return possible
        self.stop = len(STOPS) - 1
        return np.arange(n)


def _tile_search(k: int):
    """One block and one group of queries to the k best of each, ids and all."""

    def run(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(entries):
            return empty
        dims = max(max(map(len, queries["vector"])), max(map(len, entries["vector"])), 1)

        def matrix(column: pd.Series) -> np.ndarray:
            out = np.zeros((len(column), dims), np.int64)
            for i, v in enumerate(column):
                out[i, : len(v)] = v
            return out

        block, ids = Block(matrix(entries["vector"])), entries["ids"].tolist()
        q, v, s = [], [], []
        for name, vector in zip(queries["query"], matrix(queries["vector"]), strict=True):
            at, scores = block.best(vector, k)
            named = [(score, i) for place, score in zip(at.tolist(), scores.tolist(), strict=True) for i in ids[place].tolist()]
            named.sort(key=lambda x: (-x[0], x[1]))
            for score, i in named[:k]:
                q.append(name)
                v.append(i)
                s.append(score)
        return pd.DataFrame({"query": q, "vec_id": v, "score": s}) if q else empty

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_entries: int = 1 << 20, query_entries: int = 1 << 16) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(vec_id, vector)`` the k best of ``vectors(vec_id, vector)`` but itself.

    A block holds about ``block_entries`` components, a group of queries ``query_entries``; both follow from the data's
    size, so tasks stay as large as they are and grow in number. Ties go to smaller ids.
    """
    nearest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = vectors.select("vec_id", "vector", nearest.alias("r")).where(F.col("r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries.withColumn("at", F.xxhash64("vector")))
    asked = written(queries.select("vector").distinct().withColumns({"at": F.xxhash64("vector"), "query": F.monotonically_increasing_id()}))
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks, groups = max(1, -(-size(entries) // block_entries)), max(1, -(-size(asked) // query_entries))

    tiles = lambda df, own, n, other, m: df.withColumn(own, F.pmod("at", F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).drop("at")
    left = tiles(asked, "g", groups, "b", blocks).repartition(blocks * groups, "b", "g")
    right = tiles(entries, "b", blocks, "g", groups).repartition(blocks * groups, "b", "g")
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(_tile_search(k + 1), "query long, vec_id long, score long")
    found = written(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = found.select("*", rank.alias("r")).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))

    own = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = queries.join(asked.select("vector", "query"), "vector").select("query", F.col("vec_id").alias("query_id"), own.alias("own")).join(best, "query")
    mine = F.array_position(F.transform("best", lambda x: (x.vec_id == F.col("query_id")) & (x.score == F.col("own"))), True)
    others = F.filter("best", lambda x, i: (F.col("mine") == 0) | (i + 1 != F.col("mine")))
    return rows.withColumn("mine", mine).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", "x.score")


def op13_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20
"""
