"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.session import shared_dir


def stored(df: DataFrame, label: str, release: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and
    safe from the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    # Spark deletes shuffle files when their plan is garbage; the plan of a step
    # that is written is, and a collection now keeps disk use to one step.
    # Steps over a few ids or links can do without.
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: joins on it read
    it as it lies, whatever their number. Give it to ``drop_bucketed`` at the end."""
    spark, n = df.sparkSession, parts(df.sparkSession)
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.table(name)
    out.scratch, out.name = path, name
    return out


def drop_bucketed(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE {df.name}")
    discard(df)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``stored`` that no later step reads."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, getattr(df, "scratch")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. If the scan gives fewer tasks than there are cores, its
    rows are dealt out; large tables have more and are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def parts(spark: SparkSession) -> int:
    """Partitions for shuffles whose work is large for its bytes."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def summed_arrays(df: DataFrame, fan_in: int = 32) -> "list":
    """Element-wise sum of equally long float64 arrays held as bytes in the one
    column of ``df``, as a tree: tasks add up what they read, one array each.

    The sum is the same in any order if all values are multiples of one power
    of two and fit its 53 bits, which callers see to.
    """
    import numpy as np

    column = df.columns[0]

    def add(frames):
        total = None
        for frame in frames:
            for raw in frame[column]:
                x = np.frombuffer(raw, np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            import pandas as pd

            yield pd.DataFrame({column: [total.tobytes()]})

    schema = f"{column} binary"
    tree = df.repartition(fan_in).mapInPandas(add, schema).repartition(1).mapInPandas(add, schema)
    rows = tree.collect()
    return np.frombuffer(rows[0][0], np.float64) if rows else None


def blocks(sizes: list[int], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Neighbouring items, taken together up to ``most`` bytes: numpy calls are
    made per block and their arrays stay in the cache."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
