"""Exact top-k search by inner product with ball trees (operator 1).

Vectors are dealt into shards; each shard is a ball tree, stored once.  A query first meets its own shard, which gives a
kth score; then blocks of queries meet all other shards, each search starting from that shared kth score and raising it.
Nodes are visited in order of their upper bound, query . centre + |query| * radius, until the bound falls below the kth
score.  Components are floor(scale * x) and all scores are exact integers.

A task holds one shard (at most ``SHARD`` vectors) and one block of queries (at most about ``BLOCK``); a query keeps at
most k results a shard.  Shards of dimension d are only met by queries of dimension d.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; rows
that repeat an id are candidates each, none for a query of that id, and queries that repeat an id share one list, the
best of all their scores; equal scores go to the smaller id; a query without any candidate has no row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.common import stored, tasks

SHARD = 16_384
BLOCK = 1024
LEAF = 64


class BallTree:
    """Vectors in leaf order; nodes as arrays: first and last row, centre, radius, children (-1: leaf)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii, stack = [], [], [(0, len(ids), -1, 0)]
        real = vectors.astype(np.float64)
        while stack:
            low, high, parent, side = stack.pop()
            rows = self.order[low:high]
            centre = real[rows].mean(0)
            away = np.sqrt(((real[rows] - centre) ** 2).sum(1))
            me = len(self.nodes)
            self.nodes.append([low, high, -1, -1])
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if high - low > LEAF:  # split at the median between two far points, by count, so equal vectors split too
                a = real[rows[away.argmax()]]
                b = real[rows[((real[rows] - a) ** 2).sum(1).argmax()]]
                half = (high - low) // 2
                self.order[low:high] = rows[np.argpartition(real[rows] @ (b - a), half)]
                stack += [(low, low + half, me, 0), (low + half, high, me, 1)]
        self._set(vectors[self.order], ids[self.order], np.array(self.nodes), np.array(centres), np.array(radii))

    def _set(self, vectors, ids, nodes, centres, radii):
        self.vectors, self.ids, self.nodes, self.centres, self.radii = vectors, ids, nodes, centres, radii
        largest = float(np.abs(vectors).max(initial=0))
        self.exact = largest * largest * vectors.shape[1] < 2**53
        self.values = vectors.astype(np.float64) if self.exact else vectors

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(x).astype(t).tobytes() for x, t in zip((self.vectors, self.ids, self.nodes, self.centres, self.radii), ("<i8", "<i8", "<i8", "<f8", "<f8"))]

    @classmethod
    def loaded(cls, dim: int, parts) -> BallTree:
        v, i, n, c, r = (np.frombuffer(x, t) for x, t in zip(parts, ("<i8", "<i8", "<i8", "<f8", "<f8")))
        tree = cls.__new__(cls)
        tree._set(v.reshape(-1, dim), i, n.reshape(-1, 4), c.reshape(-1, dim), r)
        return tree

    def products(self, rows: slice, query: np.ndarray) -> np.ndarray:
        if self.exact and float(np.abs(query).max(initial=0)) * np.abs(self.values[rows]).max(initial=0) * len(query) < 2**53:
            return (self.values[rows] @ query.astype(np.float64)).astype(np.int64)
        found = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.vectors[rows]]
        return np.array(found, dtype=np.int64)  # beyond 64 bits: OverflowError rather than a wrong score

    def search(self, query: np.ndarray, own: int, k: int, kth: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best above or at ``kth``, best first, ties to the smaller id."""
        point, best = query.astype(np.float64), []  # heap of (score, -id), worst first
        norm = float(np.sqrt((point**2).sum()))
        bounds = self.centres @ point + norm * self.radii
        bounds += 1e-9 * (np.abs(self.centres) @ np.abs(point) + norm * self.radii) + 1e-6
        floor = -math.inf if kth is None else kth
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            low, high, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = slice(low, high)
            scores = self.products(rows, query)
            for i in np.flatnonzero(scores >= floor):
                name = int(self.ids[low + i])
                if name == own:
                    continue
                item = (int(scores[i]), -name)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return [(s, -n) for s, n in sorted(best, reverse=True)]


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i8").reshape(-1, dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score from rows (vec_id, embedding)."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size("embedding").alias("dim"))
    n = vectors.count()
    shards = max(1, math.ceil(n / SHARD), min(4 * tasks(vectors), math.ceil(n / 1024)))
    clean = clean.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(x):
        import pandas as pd

        v, ids, dim = np.stack(x["v"].to_numpy()).astype(np.int64), x["vec_id"].to_numpy(), int(x["dim"].iloc[0])
        tree, asks = BallTree(v, ids), np.flatnonzero(x["asks"].to_numpy())
        kth = []
        for i in asks:
            got = tree.search(v[i], int(ids[i]), k, None)
            kth.append(got[-1][0] if len(got) == k else None)
        out = [(dim, int(x["shard"].iloc[0]), tree.stored(), [int(ids[i]) for i in asks], kth, [v[i].astype("<i8").tobytes() for i in asks])]
        return pd.DataFrame(out, columns=["dim", "shard", "tree", "query_id", "kth", "query"])

    index = stored(clean.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, tree array<binary>, query_id array<long>, kth array<long>, query array<binary>"))
    asked = index.select("dim", F.explode(F.arrays_zip("query_id", "kth", "query")).alias("q")).select("dim", "q.*")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    places = index.select(F.col("dim").alias("of"), F.col("shard").alias("shard"))
    asked = asked.join(places, F.col("dim") == F.col("of")).drop("of")  # every query meets every shard of its dimension, in blocks
    trees = index.select(F.col("dim").alias("t_dim"), F.col("shard").alias("t_shard"), "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("t_block"))

    def search(tree, queries):
        import pandas as pd

        out = []
        if len(tree) and len(queries):
            dim = int(queries["dim"].iloc[0])
            t = BallTree.loaded(dim, tree["tree"].iloc[0])
            for name, kth, q in zip(queries["query_id"], queries["kth"], _matrix(queries["query"], dim)):
                out += [(int(name), i, s) for s, i in t.search(q, int(name), k, None if kth != kth or kth is None else int(kth))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = asked.withColumn("kth", F.col("kth").cast("string")).groupBy("dim", "shard", "block").cogroup(trees.groupBy("t_dim", "t_shard", "t_block")).applyInPandas(
        lambda q, t: search(t, q), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
