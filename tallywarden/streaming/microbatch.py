"""Cleaning of a growing folder of CSV files, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tallywarden.operators.cleaning import (
    drop_empty_rows,
    five_checks,
    trimmed_text,
    without_columns,
)
from tallywarden.session import width
from tallywarden.sources.tables import stream_csv, with_row_index


# A digest of each stored row as it came: copies in other batches have the same.
ROW_HASH = "row_hash"


FILE = "file"
COPIES = "__copies"
# Bytes of a file up to which one task numbers its rows.
SMALL_FILE = 4 << 20


def clean_chunks(df: DataFrame, row_idx: str, chunk: str | list[str]) -> DataFrame:
    """Cleaning with duplicates searched within each chunk of rows only."""
    return _stored(_counted(df, row_idx, chunk), row_idx, chunk)


def _names(chunk: str | list[str]) -> list[str]:
    return [chunk] if isinstance(chunk, str) else chunk


class _Cleaning:
    """The expressions that clean a batch. A stream makes them once: to make them
    anew takes longer than to run a small batch."""

    def __init__(self, schema: T.StructType, row_idx: str, chunk: str | list[str]) -> None:
        """``schema``: of the rows without banned columns."""
        self.chunk, self.chunk_keys = _names(chunk), [F.col(f"`{c}`") for c in _names(chunk)]
        self.data = [f.name for f in schema.fields if f.name not in (row_idx, *self.chunk)]
        cells = [F.col(f"`{c}`") for c in self.data]
        self.keys = [*self.chunk_keys, *cells]
        self.counts = [F.min(row_idx).alias(row_idx), F.count("*").alias(COPIES)]
        self.row_hash = F.sha2(F.to_json(F.struct(*self.data)), 256)
        stored = T.StructType([*(f for f in schema.fields if f.name != row_idx), T.StructField(ROW_HASH, T.StringType())])
        self.trimmed = trimmed_text(stored)
        self.trimmed_data = trimmed_text(stored, self.data)
        null_cells = reduce(lambda a, b: a + b, [c.isNull().cast("long") for c in cells])
        kept = null_cells < len(self.data)
        self.copies = [F.sum(COPIES).alias(COPIES), F.count("*").alias("__n")]
        self.totals = [
            F.sum(COPIES).alias("rows_input"),
            F.sum(F.when(kept, F.col("__n")).otherwise(0)).alias("rows"),
            F.sum(F.when(kept, F.col("__n") * null_cells).otherwise(0)).alias("null_cells"),
            F.sum(F.when(kept, F.col("__n") - 1).otherwise(0)).alias("repeats"),
        ]
        failed = F.transform(F.filter(five_checks(self.data), lambda c: c["status"] == "FAIL"), lambda c: c["name"])
        self.report = [
            *self.chunk_keys,
            F.col("rows_input"),
            F.col("rows").alias("rows_stored"),
            F.when(F.col("rows") > 0, F.array_sort(failed)).otherwise(F.array().cast("array<string>")).alias("failed"),
        ]

    def counted(self, bare: DataFrame) -> DataFrame:
        return bare.groupBy(*self.keys).agg(*self.counts)

    def stored(self, counted: DataFrame) -> DataFrame:
        kept = drop_empty_rows(counted, self.data).drop(COPIES)
        return kept.withColumn(ROW_HASH, self.row_hash).withColumns(self.trimmed)

    def metrics(self, counted: DataFrame) -> DataFrame:
        per_row = counted.withColumns(self.trimmed_data).groupBy(*self.keys).agg(*self.copies)
        return per_row.groupBy(*self.chunk_keys).agg(*self.totals).select(*self.report)


def _of_counted(counted: DataFrame, row_idx: str, chunk: str | list[str]) -> _Cleaning:
    return _Cleaning(T.StructType([f for f in counted.schema.fields if f.name != COPIES]), row_idx, chunk)


def _counted(df: DataFrame, row_idx: str, chunk: str | list[str]) -> DataFrame:
    """Each distinct row of a chunk, empty ones too, with its smallest index and the
    number of its copies."""
    bare = without_columns(df)
    return _Cleaning(bare.schema, row_idx, chunk).counted(bare)


def _stored(counted: DataFrame, row_idx: str, chunk: str | list[str]) -> DataFrame:
    return _of_counted(counted, row_idx, chunk).stored(counted)


def _metrics(counted: DataFrame, row_idx: str, chunk: str | list[str]) -> DataFrame:
    """``rows_input``, ``rows_stored`` and the names of failed checks per chunk."""
    return _of_counted(counted, row_idx, chunk).metrics(counted)


class _Numbering:
    """Rows of a micro-batch with their file, their position in it from 0, and the
    chunk of ``chunk_rows`` rows that this position lies in.

    The numbers follow from the file alone, so they are the same whatever files
    arrive together and in whatever order. Rows of small files are dealt by file to
    ``small`` tasks and numbered there. Of other files each split counts its rows, and a row
    adds its place in the split to the rows of the splits before; no row moves.
    """

    def __init__(self, schema: T.StructType, row_idx: str, chunk: str, chunk_rows: int, small: int) -> None:
        self.row_idx, self.small = row_idx, small
        columns = [F.col(f"`{f.name}`") for f in schema.fields if not f.name.startswith("__")]
        self.file, self.seq = F.col("__file"), F.monotonically_increasing_id()
        place = F.row_number().over(Window.partitionBy("__file").orderBy("__split", "__seq")) - 1
        self.by_file = [*columns, place.cast("long").alias(row_idx), self.file.alias(FILE)]
        self.by_split = [*columns, F.col(f"`{row_idx}`"), self.file.alias(FILE)]
        self.chunk = F.floor(F.col(row_idx) / F.lit(chunk_rows)).cast("long").alias(chunk)

    def numbered(self, batch: DataFrame) -> DataFrame:
        if self.small:
            rows = batch.withColumn("__seq", self.seq).repartition(self.small, self.file).select(*self.by_file)
        else:
            rows = with_row_index(batch, self.row_idx, per_file=True).select(*self.by_split)
        return rows.select("*", self.chunk)


def _one_batch(
    rows_path: str, metrics_path: str, row_idx: str, chunk: str, chunk_rows: int | None, small: int = 0
) -> Callable:
    keys = [FILE, chunk] if chunk_rows else [chunk]
    made: dict = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        # Both tables are partitioned by the batch: a batch that is run again
        # after a failure replaces its own rows and nothing else.
        # The files are read once; rows and metrics come from what they hold.
        if chunk_rows and not made:
            made["numbering"] = _Numbering(batch.schema, row_idx, chunk, chunk_rows, small)
        rows = made["numbering"].numbered(batch) if chunk_rows else batch.drop("__file", "__split")
        if "cleaning" not in made:
            bare = without_columns(rows)
            made["banned"] = bare is not rows
            made["cleaning"] = _Cleaning(bare.schema, row_idx, keys)
        cleaning = made["cleaning"]
        counted = cleaning.counted(without_columns(rows) if made["banned"] else rows).persist()
        try:
            _written(
                (cleaning.stored(counted), f"{rows_path}/batch_id={batch_id}"),
                (cleaning.metrics(counted), f"{metrics_path}/batch_id={batch_id}"),
            )
        finally:
            counted.unpersist()

    return run


def _written(*tables: tuple[DataFrame, str]) -> None:
    """Writes tables side by side: of a small batch most time goes to starting jobs."""

    def write(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    with ThreadPoolExecutor(len(tables)) as pool:
        # Jobs keep the properties of the stream's thread, so that they end with it.
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(write), df, path) for df, path in tables]
    for job in running:
        job.result()


def _small_files(spark: SparkSession, source: str) -> bool:
    """Whether no file that is there is too large to be numbered in one task. This
    decides speed only: a larger file that comes later is numbered all the same."""
    files = spark.read.format("binaryFile").load(source).select("length")
    return (files.agg(F.max("length")).first()[0] or 0) <= SMALL_FILE


def ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    rows_path: str,
    metrics_path: str,
    checkpoint: str,
    row_idx: str,
    chunk: str,
    files_per_batch: int = 16,
    chunk_rows: int | None = None,
) -> None:
    """Clean all files that are there now and stop; run again for later files.

    With ``chunk_rows`` rows and chunks are numbered per file on arrival and the
    tables gain a ``file`` column. Without, the files bring both numbers, and a chunk
    may be spread over files of several batches; ``current_rows`` then decides
    between the copies of a row, ``metrics`` count what each batch stored.
    """
    stream = stream_csv(spark, source, schema, files_per_batch, multiline=False, placed=True)
    small = min(files_per_batch, width(spark)) if chunk_rows and _small_files(spark, source) else 0
    query = (
        stream.writeStream.foreachBatch(_one_batch(rows_path, metrics_path, row_idx, chunk, chunk_rows, small))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_rows(rows: DataFrame, row_idx: str, chunk: str) -> DataFrame:
    """The rows of all batches with each row of a chunk once: the copy of smallest
    index, whichever batch brought it."""
    keys = [c for c in (FILE, chunk) if c in rows.columns]
    rest = [c for c in rows.columns if c not in (*keys, ROW_HASH, "batch_id")]
    first = F.min_by(F.struct(*rest), F.col(row_idx)).alias("first")
    return rows.groupBy(*keys, ROW_HASH).agg(first).select(*keys, "first.*")


def running_totals(metrics: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Totals over all chunks so far. Where chunks are spread over batches, give the
    ``current`` rows: a batch cannot know what others store."""
    stored = F.col("__stored") if current is None else current.agg(F.count("*").alias("n")).scalar()
    return (
        metrics.agg(
            F.sum("rows_input").alias("rows_input"),
            F.sum("rows_stored").alias("__stored"),
            F.bool_and(F.size("failed") == 0).alias("compliance_passed"),
        )
        .withColumn("rows_stored", stored)
        .withColumn("rows_dropped", F.col("rows_input") - F.col("rows_stored"))
        .select("rows_input", "rows_stored", "rows_dropped", "compliance_passed")
    )


def failures(metrics: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Chunks that failed, per check; a chunk that several batches hold counts once."""
    return (
        metrics.select(F.explode("failed").alias("name"), chunk)
        .groupBy("name")
        .agg(F.count_distinct(F.coalesce(F.col(chunk).cast("string"), F.lit(""))).alias("failed_chunks"))
    )
