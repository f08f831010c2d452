"""Exact top-k inner products by no-random-access aggregation, in blocks.

Queries and candidates are dealt into blocks of bounded size, each pair of blocks is one group. In a group every
dimension is a list of candidates sorted by their value, read from the end that a query's sign favours. Lists are read
in rounds, in step, ever deeper; for each query the known part of a candidate's score and the last values read bound it
from below and above. A candidate whose upper bound is under the k-th best lower bound is out and isn't looked at again.
Reading stops when no more than k candidates are left, whose final scores are then resolved, or at the lists' end, where
all that is left is known. The k best of each block merge into the k best of all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
#: Rows of a block at most, about; candidates' blocks at least; queries bounded at once.
BLOCK, LEAST_BLOCKS, QUERIES = 4096, 8, 64
#: Share of pairs that a round closes at least, to be looked at again.
LITTLE = 0.02
#: Shares of the lists that have been read after each round.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``: floor(scale * component) of each usable vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    return usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


class Lists:
    """The candidates of a block as one sorted list a dimension."""

    def __init__(self, cand: np.ndarray):
        self.cand, self.n = cand, len(cand)
        order = np.argsort(cand, axis=0, kind="stable")
        self.ordered = np.take_along_axis(cand, order, axis=0)  # each list's values, the smallest first
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        self.rank = np.empty_like(order)  # each candidate's place in each list
        np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(self.n)[:, None], order.shape), axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """What each candidate may hold at least and at most in each list, ``depth`` entries having been read from its upper end
        (the first two) or from its lower end. What isn't read lies between the last value read and the list's other end.
        Made once for all queries."""
        if depth not in self.tables:
            high, low = self.rank >= self.n - depth, self.rank < depth
            last = self.ordered
            self.tables[depth] = (np.where(high, self.cand, last[0]), np.where(high, self.cand, last[self.n - depth]), np.where(low, self.cand, last[depth - 1]), np.where(low, self.cand, last[-1]))
        return self.tables[depth]

    def bounds(self, rows: np.ndarray, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of candidates ``rows`` (columns) for queries (rows), ``depth`` entries of
        each list having been read."""
        if depth >= self.n:  # the lists' end: all is known
            known = queries @ self.cand[rows].T
            return known, known.copy()
        tables = self.read(depth)
        high_least, high_most, low_least, low_most = tables if len(rows) == self.n else (t[rows] for t in tables)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ high_least.T + down @ low_most.T, up @ high_most.T + down @ low_least.T

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, rounds: Sequence[float] = ROUNDS) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
        """(candidates, scores) that may be among each query's k best, all k best among them; own: pairs of a row with
        itself. Besides, the share of pairs still open after each round."""
        open_, shares, done = ~own, [], np.zeros(len(queries), bool)
        for share in rounds:
            live = np.flatnonzero(~done)
            if not len(live):
                break
            depth = max(1, int(self.n * share))
            rows = np.flatnonzero(open_[live].any(axis=0))
            lower, upper = self.bounds(rows, queries[live], depth)
            mine = open_[np.ix_(live, rows)]
            lower[~mine] = -np.inf
            if len(rows) > k:
                kth = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k]
                mine &= upper >= kth[:, None]
                open_[np.ix_(live, rows)] = mine
            done[live] = mine.sum(axis=1) <= k  # no outsider can qualify
            shares.append(float(open_.mean()))
        out = []
        for q, left in zip(queries, open_, strict=True):
            held = np.flatnonzero(left)
            out.append((held, self.cand[held] @ q))
        return out, shares


def best(cand: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, score) of each query's k best among the candidates, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    cand, ids = cand[order], ids[order]
    lists, out, rounds = Lists(cand), [], ROUNDS
    for at in range(0, len(queries), QUERIES):
        q, q_ids = queries[at : at + QUERIES], query_ids[at : at + QUERIES]
        found, shares = lists.best(q, q_ids[:, None] == ids[None, :], k, rounds)
        if not at:  # where the first queries close next to nothing, later ones read on without looking
            before = [1.0, *shares]
            rounds = [r for i, r in enumerate(ROUNDS) if r == ROUNDS[-1] or (i < len(shares) and before[i] - shares[i] > LITTLE)]
        for i, (held, scores) in enumerate(found):
            top = np.argsort(-scores, kind="stable")[:k]
            out += [(q_ids[i], ids[held[j]], int(scores[j])) for j in top]
    return out


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows; fewer if there are fewer.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are null, or hold nulls, NaN or infinite
    components, take no part. No row with the query's own vec_id is its partner; otherwise repeated rows of one vec_id are
    candidates each, and a repeated query is asked once (its smallest vector). Vectors of different lengths are compared as if padded by zeros. Empty tables give no rows.
    """
    rows = integers(vectors, scale)
    n = rows.count()
    blocks, per_query = max(LEAST_BLOCKS, -(-n // BLOCK)), max(1, -(-n // (every * BLOCK)))
    cells = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(per_query)).cast("int").alias("qb"), cells("cb", blocks))
    right = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit("c")), F.lit(blocks)).cast("int").alias("cb"), cells("qb", per_query))

    def joined(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dims = max(map(len, [*q["v"], *c["v"]]))
        pad = lambda rows: np.array([np.pad(v, (0, dims - len(v))) if len(v) < dims else v for v in rows], dtype=float).reshape(len(rows), dims)
        found = best(pad(c["v"]), c["vec_id"].to_numpy(), pad(q["v"]), q["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(joined, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
