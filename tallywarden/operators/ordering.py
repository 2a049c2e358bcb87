"""Running values over an order, without one task per key.

A key may own a third of all rows, so no window here runs over a whole key.
Rows are cut into blocks along their order; each block is aggregated (with map
side combine), the small block table carries the running value from block to
block, and the only wide window is one over (key, block).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; the key columns of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    block: Column,
    value: Column,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, max or min of ``value`` per ``keys`` along ``order``.

    ``block`` must never decrease along ``order``; it bounds the rows one task
    sorts. The block table has rows / block size rows.
    """
    agg, combine = _COMBINE[how]
    blocked = df.withColumn("__block", block).withColumn("__value", value)
    upto = (Window.unboundedPreceding, 0 if inclusive else -1)
    part = blocked.groupBy(*keys, "__block").agg(agg("__value").alias("__part"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = part.select(*keys, "__block", agg("__part").over(before).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(*upto)
    return (
        null_safe_join(blocked, carried, [*keys, "__block"], "inner")
        .withColumn(out, combine(F.col("__carried"), agg("__value").over(inside)))
        .drop("__block", "__value", "__carried")
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list, block: Column, out: str = "rn"
) -> DataFrame:
    """1-based position per ``keys`` along ``order`` (which must be total)."""
    return running(df, keys, order, block, F.lit(1).cast("long"), out, "sum")


def rank_by_hash(df: DataFrame, hex_key: Column, tie: list, out: str = "rank") -> DataFrame:
    """Exact global position of each row in the order of a hexadecimal hash.

    The first four digits are the block, so there are 65,536 blocks at most and
    no task sees more than its share of the rows.
    """
    keyed = df.withColumn("__hash", hex_key)
    return row_numbers(
        keyed, [], ["__hash", *tie], F.substring("__hash", 1, 4), out
    ).drop("__hash")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps ``k`` rows per key and task before
    the shuffle (window group limit), so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def fixed_batches(
    df: DataFrame, keys: list[str], order: list, block: Column, size: int, out: str = "batch_no"
) -> DataFrame:
    """Batches of ``size`` consecutive rows per key."""
    numbered = row_numbers(df, keys, order, block, "__rn")
    return numbered.withColumn(
        out, F.floor((F.col("__rn") - 1) / F.lit(size)).cast("long")
    ).drop("__rn")
