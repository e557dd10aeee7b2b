"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

The vectors are dealt to shards of bounded size.  In a shard every tree is the sorted array of one long hash string per
vector: the signs of its products with random planes.  A query descends in each tree to the longest prefix it shares with
any vector, then all trees ascend together, a bit at a time, until they hold enough candidates, which are compared exactly.
Best results of the shards are merged by a window.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Forest:
    """Index of one shard.  ``vectors`` must be distinct.

    ``share`` is the part of them a tree gives on average at least; ``least`` vectors come out in any case, or all.
    """

    def __init__(
        self, vectors: np.ndarray, trees: int = 40, bits: int = 24, share: float = 0.025, least: int = 1, seed: int = 11
    ):
        self.bits, self.wanted = bits, trees * max(share * len(vectors), min(least, len(vectors)))
        # One more coordinate makes all vectors equally long, so that nearness by angle is nearness by product.
        size = np.linalg.norm(vectors, axis=1)
        self.longest = size.max()
        lift = np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, trees * bits))
        codes = self.hashed(np.concatenate([vectors / self.longest, lift[:, None]], axis=1))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def hashed(self, lifted: np.ndarray) -> np.ndarray:
        """One hash string per tree and row, as a number whose highest bit comes first."""
        signs = (lifted @ self.planes > 0).reshape(len(lifted), -1, self.bits)
        return np.ascontiguousarray((signs @ (1 << np.arange(self.bits - 1, -1, -1))).T)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """For each query a row of flags: the vectors the forest gives for it."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        own = self.hashed(np.concatenate([unit, np.zeros((len(unit), 1))], axis=1))
        trees, count = own.shape
        low, high = np.empty((trees, count), np.int64), np.empty((trees, count), np.int64)
        level = self._longest_prefix(own)
        open_ = np.arange(count)
        for x in range(int(level.max()), -1, -1):
            here = open_[level[open_] >= x]
            shift = self.bits - x
            prefix = own[:, here] >> shift
            for t in range(trees):
                low[t, here] = np.searchsorted(self.codes[t], prefix[t] << shift)
                high[t, here] = np.searchsorted(self.codes[t], (prefix[t] + 1) << shift)
            enough = (high[:, here] - low[:, here]).sum(axis=0) >= self.wanted
            open_ = np.setdiff1d(open_, here[enough], assume_unique=True)
            if not len(open_):
                break
        flags = np.zeros((count, self.codes.shape[1]), bool)
        for t in range(trees):
            order, a, b = self.order[t], low[t].tolist(), high[t].tolist()
            for q in range(count):
                flags[q, order[a[q] : b[q]]] = True
        return flags

    def _longest_prefix(self, own: np.ndarray) -> np.ndarray:
        """Length of the longest prefix each query shares with a vector in any tree; next to its place in the order."""
        best = np.zeros(own.shape[1], np.int64)
        for t, codes in enumerate(self.codes):
            at = np.searchsorted(codes, own[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(codes) - 1)):
                apart = own[t] ^ codes[near]
                best = np.maximum(best, self.bits - np.ceil(np.log2(apart + 1)).astype(np.int64))
        return best


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, **options):
    """``(query_id, vec_id, score)`` lists: the best ``k`` of a shard that the forest finds for each query.

    Equal vectors are indexed once; of their ids only the ``k + 1`` smallest can be among the best.
    """
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ids))
    distinct = np.ascontiguousarray(vectors[starts])
    flags = Forest(distinct, least=k + 1, **options).candidates(queries)
    out_query, out_id, out_score = [], [], []
    for q in range(len(queries)):
        found = np.flatnonzero(flags[q])
        score = np.einsum("ij,j->i", distinct[found], queries[q])
        if len(found) > k + 1:
            keep = score >= np.partition(score, -(k + 1))[-(k + 1)]
            found, score = found[keep], score[keep]
        many = [ids[starts[f] : min(ends[f], starts[f] + k + 1)] for f in found]
        all_ids = np.concatenate(many) if many else np.empty(0, np.int64)
        all_scores = np.repeat(score, [len(m) for m in many])
        other = all_ids != query_ids[q]
        all_ids, all_scores = all_ids[other], all_scores[other]
        best = np.lexsort((all_ids, -all_scores))[:k]
        out_query.append(np.full(len(best), query_ids[q]))
        out_id.append(all_ids[best])
        out_score.append(all_scores[best])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (out_query, out_id, out_score))


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold only finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 8_192,
    query_rows: int = 512,
    **options,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row ``is_query`` holds for, the ``k`` largest inner products found.

    ``is_query`` is a condition on ``id``.  Rows with a null id or an unusable vector take no part; vectors are compared with those as
    long as themselves; of several rows of one id the one with the smallest vector counts.  Each task holds one
    shard and one block of queries, both of about the stated size, whatever the table's; shards and blocks are dealt by hashes
    of ids.  Ties go to the smaller id.
    """
    vectors = (
        table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        .where("id is not null")
        .where(usable(F.col("vector")))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
        .select("id", "vector", F.size("vector").alias("dim"), is_query.alias("asks"))
    )
    rows, asking = vectors.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, ceil(rows / shard_rows)), max(1, ceil(asking / query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    held = vectors.select("id", "vector", "dim", F.lit(False).alias("asks"), place("shard", shards).alias("shard"), each(blocks).alias("block"))
    asked = vectors.where("asks").select(
        "id", "vector", "dim", "asks", each(shards).alias("shard"), place("block", blocks).alias("block")
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        ids, asks = group["id"].to_numpy(), group["asks"].to_numpy()
        matrix = group["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if asks.all() or not asks.any():
            return schema.empty_table()
        found = search_shard(ids[~asks], matrix[~asks], ids[asks], matrix[asks], k, **options)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    best = (
        held.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
