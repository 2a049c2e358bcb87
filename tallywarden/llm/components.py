"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import discard, stored


def components(links: DataFrame, rounds: int | None = None, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of
    the links (``a``, ``b``), by alternating large-star and small-star rounds.

    Each round hangs neighbours under the smallest one they have in common, so
    rounds grow with the logarithm of a component's diameter. A node's smallest
    neighbour is an aggregate joined back to its links, never a group.

    With ``rounds`` no more than that many are made: nodes of one component may
    then have different names, but a name is never shared by two components.
    """
    edges = stored(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
        release=False,
    )
    before = None
    for turn in range(max_rounds):
        former = edges
        # Large star: every larger neighbour of u goes under u's smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v").distinct()
        )
        # Small star: u and its smaller neighbours go under the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        edges = stored(
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct(),
            "edges",
            release=False,
        )
        discard(former)
        if rounds is not None:
            if turn + 1 == rounds:
                break
            continue
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
    out.scratch = edges.scratch  # for ``discard``, when the result is stored itself
    return out
