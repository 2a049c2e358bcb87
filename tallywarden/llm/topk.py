"""Exact top-k search by branch and bound over columns.

Vectors lie in blocks, one column per dimension. A block of queries meets every
block of candidates once. Scores grow dimension block by dimension block; after
each, a candidate stays only if its score so far plus the most that the
remaining dimensions can add (product of the remaining norms) reaches the k-th
best score known for the query. Survivors are compacted before the next block.

Queries are a stated set. Candidates are copied once per block of queries, of
up to ``query_block`` rows; each task holds one block of queries and one block of
candidates. Each gives k rows per query, and those are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EXACT = 2.0**52  # sums of integers below this are exact in doubles


def best_of_block(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, dims: int):
    """Rows (query, candidate, score) of the ``k`` best candidates per query.

    ``q`` and ``c`` hold whole numbers, a row per vector, candidates in the order
    that decides ties; ``own`` says which candidate a query must skip.
    """
    d = q.shape[1]
    cuts = [*range(0, d, dims), d]
    # Dimensions with most of the candidates' mass first: bounds fall fastest.
    order = np.argsort(-(c * c).sum(0), kind="stable")
    columns, q = np.ascontiguousarray(c[:, order].T), q[:, order]
    rest_c = np.sqrt(np.cumsum((columns * columns)[::-1], 0)[::-1])
    rest_q = np.sqrt(np.cumsum((q * q)[:, ::-1], 1)[:, ::-1])
    n = columns.shape[1]
    # A first bound for all queries at once, from the candidates of largest norm.
    some = np.argsort(-rest_c[0], kind="stable")[: max(4 * k, n // 64)] if d else np.arange(n)
    start = q @ columns[:, some]
    start[own[:, some]] = -np.inf
    floor = np.partition(start, -k, 1)[:, -k] if start.shape[1] >= k else np.full(len(q), -np.inf)
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(~own[i])
        score = np.zeros(len(alive))
        for lo, hi in zip(cuts, cuts[1:]):
            score = score + q[i, lo:hi] @ columns[lo:hi, alive]
            if hi < d:
                # rounding of the bound stays below one unit in 2^40
                most = score + rest_q[i, hi] * rest_c[hi, alive] * (1 + 2.0**-40)
                stay = most >= floor[i]
                alive, score = alive[stay], score[stay]
        if len(score) > k:
            kth = np.partition(score, -k)[-k]
            stay = score >= kth
            alive, score = alive[stay], score[stay]
        first = np.lexsort((alive, -score))[:k]
        out.append((np.full(len(first), i), alive[first], score[first]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 10, dims: int = 8,
    query_block: int = 2048, candidate_block: int = 16384,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query its ``k``
    vectors of the largest inner product, ties to the smaller ``vec_id``; a query
    never meets the vector of its own id.

    Both tables hold ``vec_id`` and ``v``, an array of whole numbers. Rows with a
    null id or vector take no part, equal rows count once, shorter vectors count
    as filled up with zeros. Components must stay below 2^31 in size; scores are
    exact (Python integers where sums could pass 2^52) and must fit a long.
    """
    spark = vectors.sparkSession
    clean = [x.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL").distinct() for x in (queries, vectors)]
    counts = [x.count() for x in clean]
    blocks = [max(1, -(-n // size)) for n, size in zip(counts, (query_block, candidate_block))]
    # few candidates: more, smaller blocks, so that all cores work
    blocks[1] = max(blocks[1], -(-2 * spark.sparkContext.defaultParallelism // blocks[0])) if counts[1] > 4096 else blocks[1]

    def dealt(frame: DataFrame, mine: int, other: int, copies: str) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(other - 1))
        keyed = frame.withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.lit(mine)))
        names = ("qb", "cb") if copies == "cb" else ("cb", "qb")
        return keyed.select(
            F.col("mine").cast("int").alias(names[0]), F.explode(numbers).alias(names[1]), "vec_id", "v"
        )

    def matrix(lists: pd.Series, d: int) -> np.ndarray:
        out = np.zeros((len(lists), d))
        for row, x in zip(out, lists):
            row[: len(x)] = x
        return out

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(c):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        q, c = q.sort_values("vec_id", kind="stable"), c.sort_values("vec_id", kind="stable")
        d = max(q.v.map(len).max(), c.v.map(len).max())
        qm, cm = matrix(q.v, d), matrix(c.v, d)
        qi, ci = q.vec_id.to_numpy(), c.vec_id.to_numpy()
        largest = np.abs(qm).max(initial=0.0) * np.abs(cm).max(initial=0.0) * max(1, d)
        if largest >= _EXACT or np.square(cm).sum(1).max(initial=0) >= _EXACT:
            exact_q, exact_c = ([[int(y) for y in x] for x in f.v] for f in (q, c))
            rows = []
            for i, x in zip(qi, exact_q):
                scored = [(-sum(a * b for a, b in zip(x, y)), j) for j, y in zip(ci, exact_c) if j != i]
                rows += [(i, j, -s) for s, j in sorted(scored)[:k]]
            return pd.DataFrame(rows, columns=names)
        out = []
        for lo in range(0, len(qm), 256):
            own = qi[lo : lo + 256, None] == ci[None]
            i, j, s = best_of_block(qm[lo : lo + 256], cm, own, k, dims)
            out.append(pd.DataFrame({"query_id": qi[lo + i], "vec_id": ci[j], "score": s.astype(np.int64)}))
        return pd.concat(out)

    q = dealt(clean[0], blocks[0], blocks[1], "cb").groupBy("qb", "cb")
    c = dealt(clean[1], blocks[1], blocks[0], "qb").groupBy("qb", "cb")
    found = q.cogroup(c).applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
