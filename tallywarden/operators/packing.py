"""Greedy packing of ordered items into bins of a fixed capacity.

The bin of an item depends on all items before it. Inside one row (the
paragraphs of a page) a SQL ``aggregate`` does the fold. Across rows (the chunks
of a document) short documents take the same fold, long ones are cut into blocks:

1. each block, on its own, tabulates how it maps the fill level on entry to the
   fill level on exit (a step function with few steps),
2. the tables of a document are chained to find each block's entry level,
3. each block, on its own, packs its items starting from that level.

So no task ever holds more than one block of items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.operators.ordering import null_safe_join
from tallywarden.session import cut_lineage


def bin_starts(weights: str, capacity: int) -> Column:
    """0-based positions at which a new bin opens, for an array column.

    A bin closes before the item that would overflow it, unless it is empty, so
    one over-long item has a bin of its own. The array grows only once per bin.
    """
    return F.expr(
        f"""aggregate({weights},
              named_struct('pos', 0, 'fill', 0L, 'starts', cast(array() as array<int>)),
              (a, w) -> if(a.pos = 0 or a.fill + w > {int(capacity)},
                named_struct('pos', a.pos + 1, 'fill', cast(w as bigint),
                             'starts', array_append(a.starts, a.pos)),
                named_struct('pos', a.pos + 1, 'fill', a.fill + w, 'starts', a.starts)),
              a -> a.starts)"""
    )


def _next_open(cum: np.ndarray, capacity: int) -> np.ndarray:
    """For a bin opened at i, the position of the item that opens the next one."""
    base = np.concatenate(([0], cum[:-1]))
    after = np.searchsorted(cum, base + capacity, side="right")
    return np.maximum(after, np.arange(len(cum)) + 1)


def _step_table(weights: np.ndarray, capacity: int) -> tuple[list, list, list]:
    """(highest entry fill of the step, exit fill, bins opened) by rising fill."""
    n = len(weights)
    cum = np.cumsum(weights)
    nxt = _next_open(cum, capacity)
    exit_fill = np.zeros(n, dtype=np.int64)
    opened = np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        if j >= n:
            exit_fill[i] = cum[-1] - (cum[i - 1] if i else 0)
            opened[i] = 1
        else:
            exit_fill[i] = exit_fill[j]
            opened[i] = opened[j] + 1
    tops, exits, counts = [], [], []
    low = -1
    # Fill s meets its first overflow at the first p with s + cum[p] > capacity.
    if cum[-1] <= capacity:
        tops.append(int(capacity - cum[-1]))
        exits.append(None)
        counts.append(0)
        low = tops[-1]
    p = int(np.searchsorted(cum, capacity, side="right"))
    p = min(p, n - 1)
    while p >= 0:
        top = int(capacity - (cum[p - 1] if p else 0))
        if top > low and p < n and cum[p] > 0:
            tops.append(top)
            exits.append(int(exit_fill[p]))
            counts.append(int(opened[p]))
            low = top
        p -= 1
    # A bin that is over-full on entry (one over-long item) breaks at item 0.
    tops.append(np.iinfo(np.int64).max)
    exits.append(int(exit_fill[0]))
    counts.append(int(opened[0]))
    return tops, exits, counts


def greedy_bins(
    df: DataFrame,
    key: str,
    order: str,
    weight: str,
    capacity: int,
    out: str = "batch_no",
    block_size: int = 65536,
    bins: str | None = None,
) -> DataFrame:
    """Adds the 0-based bin number of each item within its ``key`` and, if ``bins``
    names a column for it, the number of bins of the key.

    ``order`` numbers the items of a key 0, 1, 2, ... without gaps.
    """
    made = [out, bins] if bins else [out]
    # Read several times below: kept as a narrow table instead of made again.
    slim = cut_lineage(
        df.select(
            F.col(key), F.col(order).cast("long").alias("__pos"), F.col(weight).cast("long").alias("__w")
        )
    )
    sizes = slim.groupBy(key).agg(F.max("__pos").alias("__last"))
    short_keys = sizes.filter(F.col("__last") < block_size).select(key)
    long_keys = sizes.filter(F.col("__last") >= block_size).select(key)

    packed = (
        null_safe_join(slim, short_keys, [key], "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("__pos", "__w"))).alias("__items"))
        .withColumn("__weights", F.col("__items.__w"))
        .withColumn("__starts", bin_starts("__weights", capacity))
        .select(key, "__items", "__starts", F.posexplode("__starts").alias("__bin", "__from"))
    )
    upto = F.coalesce(F.get("__starts", F.col("__bin") + 1), F.size("__items"))
    short = packed.select(
        key,
        F.explode(F.slice("__items", F.col("__from") + 1, upto - F.col("__from"))).alias("__item"),
        F.col("__bin").cast("long").alias(out),
        *([F.size("__starts").cast("long").alias(bins)] if bins else []),
    ).select(key, F.col("__item.__pos").alias("__pos"), *made)

    if long_keys.isEmpty():
        return null_safe_join(df, short.withColumnRenamed("__pos", order), [key, order], "inner")

    long_items = null_safe_join(slim, long_keys, [key], "left_semi").withColumn(
        "__block", F.floor(F.col("__pos") / F.lit(block_size))
    )
    key_type = df.schema[key].dataType.simpleString()

    def tabulate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__pos")
        tops, exits, counts = _step_table(part["__w"].to_numpy(), capacity)
        return pd.DataFrame(
            {
                key: [part[key].iloc[0]],
                "__block": [part["__block"].iloc[0]],
                "tops": [tops],
                "exits": [exits],
                "counts": [counts],
                "total": [int(part["__w"].sum())],
            }
        )

    tables = long_items.groupBy(key, "__block").applyInPandas(
        tabulate,
        f"{key} {key_type}, __block long, tops array<long>, exits array<long>, "
        "counts array<long>, total long",
    )

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__block")
        fill, opened, entries = 0, 0, []
        for i, row in enumerate(part.itertuples(index=False)):
            entries.append((row[0], row[1], fill, opened))
            tops = np.asarray(row[2], dtype=np.int64)
            if i == 0:
                step = len(tops) - 1
            else:
                step = int(np.searchsorted(tops, fill, side="left"))
            leaves = row[3][step]
            if leaves is None or np.isnan(leaves):
                fill = fill + int(row[5])
            else:
                fill = int(leaves)
                opened += int(row[4][step])
        return pd.DataFrame(entries, columns=[key, "__block", "__fill", "__opened"]).assign(__bins=opened)

    entries = tables.groupBy(key).applyInPandas(
        chain, f"{key} {key_type}, __block long, __fill long, __opened long, __bins long"
    )

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__pos")
        weights = part["__w"].to_numpy()
        fill = int(part["__fill"].iloc[0])
        number = int(part["__opened"].iloc[0]) - 1
        first = part["__pos"].iloc[0] == 0
        numbers = []
        for w in weights:
            if first or fill + w > capacity:
                number, fill, first = number + 1, int(w), False
            else:
                fill += int(w)
            numbers.append(number)
        packed = pd.DataFrame({key: part[key], "__pos": part["__pos"], out: numbers})
        return packed.assign(**{bins: part["__bins"]}) if bins else packed

    long = (
        null_safe_join(long_items, entries, [key, "__block"], "inner")
        .groupBy(key, "__block")
        .applyInPandas(pack, f"{key} {key_type}, __pos long, " + ", ".join(f"{c} long" for c in made))
    )
    numbered = short.unionByName(long).withColumnRenamed("__pos", order)
    return null_safe_join(df, numbered, [key, order], "inner")
