"""Nearest neighbours by collision-counting hashing.

Inner products are turned into Euclidean distance: each vector gets one more component
that brings its norm to the largest of its shard, each query is scaled to that norm.
A shard projects its vectors on random directions and cuts each into buckets at quantiles.
A query looks at windows of buckets about its own projections; virtual rehashing widens all
windows together, step by step, and each vector inside a window gains a collision. A window
is the difference of two stored sets of bits, one for each vector, and the sets of all
directions are added up by full adders, 64 vectors to a word and many queries at once.
Vectors whose collisions reach the threshold are verified with their exact inner
product in double precision. Windows start narrow. Once k vectors are verified, windows widen
to `beyond` times the k-th best distance and no further, and the search ends there, or
when all vectors of the shard were met; no number of verified vectors ends it. A nearer
vector is missed with the small probability that too few of its projections fall into
windows that wide. Where few vectors are near, few are verified; where one vector is far
longer than the others, distances differ little and nearly all are.

Queries are met with shards in blocks, so a task holds one shard and one block of
queries, both of bounded size, and an index is built for thousands of searches; each sends its k best and a window keeps the k best of
all shards. Equal vectors get equal collisions, so copies are verified together and
ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, as query or candidate; vectors of different length never meet; rows that repeat
an id are candidates of their own, except for queries of that id; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SAMPLE = 64  # vectors of a shard that set its first windows
TOGETHER = 64  # queries whose collisions are counted together
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


class ShardIndex:
    """Bucketed projections of one shard's vectors.

    directions: number of projections; share: part of them that must collide; grow: factor by
    which windows widen; beyond: k-th distances that half a window must reach; start: first width, as
    part of what the nearest of one vector in `near` asks for, but at least of what a tenth of SAMPLE vectors of the shard
    need for their `near` nearest; buckets: base buckets
    of a direction, at its quantiles. A vector at the k-th distance collides in 87 of 100
    directions then, one a sixth farther away in no more than the share; `verified` counts what the last call verified.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: int = 160, share: float = 0.81, grow: float = 1.1, start: float = 0.9, beyond: float = 1.5, near: int = 20, buckets: int = 128, seed: int = 11) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # a matrix product may round equal rows apart by their place, so copies are projected once
        distinct, copy = np.unique(self.vectors, axis=0, return_inverse=True)
        norms = np.einsum("ij,ij->i", distinct, distinct)
        self.top = float(norms.max())
        extra = np.sqrt(np.maximum(self.top - norms, 0))
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(vectors.shape[1], directions))
        shadow = (distinct @ self.axes + np.outer(extra, rng.normal(size=directions))).T[:, copy.ravel()]
        n, buckets = len(ids), min(buckets, len(ids))
        # the lowest projection of every bucket
        self.sorted = np.sort(shadow, axis=1)[:, np.arange(buckets) * n // buckets]
        # all arrays as one, each in a range of its own, so that one search finds a place in every array
        self.apart = (np.arange(directions) * (4 * np.abs(shadow).max() + 1))[:, None]
        self.flat = (self.sorted + self.apart).ravel()
        # below[j, b]: the vectors in the first b buckets of direction j, one bit for each
        self.below = np.zeros((directions, buckets + 1, -(-n // 64)), np.uint64)
        for j in range(directions):
            inside = np.zeros((buckets, self.below.shape[2] * 64), bool)
            inside[np.searchsorted(self.sorted[j], shadow[j], "right") - 1, np.arange(n)] = True
            np.bitwise_or.accumulate(np.packbits(inside, axis=1, bitorder="little").view(np.uint64), axis=0, out=self.below[j, 1:])
        self.need, self.grow, self.beyond = max(1, int(np.ceil(share * directions))), grow, beyond
        # where the nearest ones begin, from the distances of a few of the vectors to their own
        few = self.vectors[rng.choice(len(ids), min(SAMPLE, len(ids)), replace=False)]
        few = few * np.sqrt(self.top / np.einsum("ij,ij->i", few, few))[:, None]
        products = few @ self.vectors.T
        kth = np.partition(products, -min(near + 1, len(ids)), axis=1)[:, -min(near + 1, len(ids))]
        near_by = np.sqrt(np.maximum(np.quantile(2 * self.top - 2 * kth, 0.1), 1e-6 * self.top))
        self.width = start * beyond * float(near_by)
        # of one vector in `near`, the nearest to a query lies about as far as the near-th of all
        self.few, self.first = rng.choice(len(ids), -(-len(ids) // near), replace=False), start * beyond

    def places(self, at: np.ndarray, side: str) -> np.ndarray:
        """The place of at[..., j] in sorted array j, for every j."""
        m, n = self.sorted.shape
        reach = self.apart[1, 0] / 4 if m > 1 else np.inf  # beyond all values of an array
        return np.searchsorted(self.flat, np.clip(at, -reach, reach) + self.apart[:, 0], side) - np.arange(m) * n

    def reached(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query, bits of the vectors with `need` collisions in the buckets low <= b < high of the directions.

        Plane i holds bit i of every vector's count; three entries of a plane become one there and a carry.
        Counts begin at 2 ** top - need, so that plane `top` is set where need is reached.
        """
        m, top = len(self.below), len(self.below).bit_length()
        none = np.zeros((len(low), self.below.shape[2]), np.uint64)
        planes = [[~none if ((1 << top) - self.need) >> i & 1 else none.copy()] for i in range(top)] + [[]]

        def add(i: int, bits: np.ndarray) -> None:
            planes[i].append(bits)
            if i < top and len(planes[i]) == 3:
                a, b, c = planes[i]
                odd = a ^ b
                planes[i] = [odd ^ c]
                a &= b  # two of three: both of a and b, or one of them and c
                odd &= c
                a |= odd
                add(i + 1, a)

        for j in range(m):
            bits = self.below[j, high[:, j]]
            bits ^= self.below[j, low[:, j]]
            add(0, bits)
        for i in range(top):
            if len(planes[i]) == 2:
                add(i + 1, planes[i][0] & planes[i][1])
        return np.bitwise_or.reduce(planes[top], axis=0) if planes[top] else none

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best found, best first, ties to the smaller id."""
        return self.search_all(query[None], np.array([own]), k)[0]

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What search finds, for each query; TOGETHER of them share a pass over the directions."""
        self.verified, found = 0, []
        for at in range(0, len(queries), TOGETHER):
            found += self._together(queries[at : at + TOGETHER], own[at : at + TOGETHER], k)
        return found

    def _together(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, buckets = len(self.ids), self.sorted.shape[1]
        scale = np.sqrt(self.top) / np.linalg.norm(queries, axis=1)
        centre = (queries * scale[:, None]) @ self.axes
        nearest = np.where(self.ids[self.few] == own[:, None], -np.inf, queries @ self.vectors[self.few].T).max(axis=1)
        width = np.maximum(self.width, self.first * np.sqrt(np.maximum(2 * self.top - 2 * scale * nearest, 0)))
        done = np.zeros((len(queries), self.below.shape[2]), np.uint64)
        picked, scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0)] * len(queries)
        open_ = np.arange(len(queries))
        while len(open_):
            low = self.places(centre[open_] - width[open_, None], "left")
            high = self.places(centre[open_] + width[open_, None], "right")
            met = self.reached(low, high)
            fresh = np.unpackbits((met & ~done[open_]).view(np.uint8), axis=1, bitorder="little").view(bool)
            done[open_] |= met
            whole = (low == 0).all(axis=1) & (high == buckets).all(axis=1)
            for i, q in enumerate(open_):
                new = np.flatnonzero(fresh[i])
                new = new[self.ids[new] != own[q]]
                picked[q] = np.concatenate([picked[q], new])
                scores[q] = np.concatenate([scores[q], exact_score(self.vectors.take(new, axis=0), queries[q])])
                wider = width[q] * self.grow
                if len(picked[q]) >= k:
                    kth = np.partition(scores[q], -k)[-k]
                    outgrown = self.beyond * np.sqrt(max(2 * self.top - 2 * scale[q] * kth, 0.0))
                    whole[i] |= outgrown <= width[q]
                    wider = min(wider, outgrown)  # no wider than the bound asks
                width[q] = wider
            open_ = open_[~whole]
        self.verified += sum(map(len, picked))
        return [self._best(*of, k) for of in zip(picked, scores, strict=True)]

    def _best(self, picked: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(picked) > k:
            best = scores >= np.partition(scores, -k)[-k]
            picked, scores = picked[best], scores[best]
        best = np.lexsort((self.ids[picked], -scores))[:k]
        return self.ids[picked[best]], scores[best]


def exact_score(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; a matrix product may round those of equal rows apart by their place, which this does not."""
    return np.einsum("ij,j->i", rows, query)


def usable(embedding: Column) -> Column:
    as_double = embedding.cast("array<double>")
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(as_double, lambda x: x != 0), F.lit(False))


def _search(k: int, options: dict):
    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(shard) and len(queries):
            index = ShardIndex(shard["vec_id"].to_numpy(np.int64), np.stack(shard["embedding"].to_list()).astype(np.float64), **options)
            own = queries["vec_id"].to_numpy(np.int64)
            found = index.search_all(np.stack(queries["embedding"].to_list()).astype(np.float64), own, k)
            out = [(np.full(len(ids), q), ids, scores) for q, (ids, scores) in zip(own, found, strict=True)]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 16_384, query_rows: int = 8_192, **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each query row, by inner product."""
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    fine = fine.withColumn("dim", F.size("embedding"))
    sizes = fine.agg(F.count("*"), F.count_if("q")).first()
    shards, groups = -(-sizes[0] // shard_rows) or 1, -(-sizes[1] // query_rows) or 1
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = fine.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int").alias("shard"), spread(groups, "part"))
    queries = fine.where("q").dropDuplicates(["vec_id", "embedding"])
    right = queries.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(groups)).cast("int").alias("part"), spread(shards, "shard"))
    key = ["dim", "shard", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k, options), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
