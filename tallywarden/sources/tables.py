"""Table sources and sinks: CSV, JSON rule files, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV reader of the reference takes for null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Null tokens out, then each text column to its type; bad text gives null."""
    columns = []
    for field in schema.fields:
        raw = F.when(~F.col(f"`{field.name}`").isin(NULL_TOKENS), F.col(f"`{field.name}`"))
        if not isinstance(field.dataType, T.StringType):
            raw = raw.try_cast(field.dataType)
        columns.append(raw.alias(field.name))
    return df.select(*columns, *[c for c in df.columns if c.startswith("__")])


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _csv_options(multiline: bool) -> dict:
    return dict(
        header=True, encoding="UTF-8", quote='"', escape='"', multiLine=multiline,
        mode="PERMISSIVE", enforceSchema=False,
    )


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool = False,
    row_index: str | None = None,
) -> DataFrame:
    """CSV with header; malformed UTF-8 is replaced, null tokens become null.

    Columns are found by their names in the header, in whatever order; a column of
    the schema that the header lacks is an error, and so is a file whose header
    differs from that of the first one.

    Give a schema for large data: without one Spark reads the files twice.
    ``multiline`` allows line ends inside quotes but keeps Spark from splitting
    a file.
    ``row_index`` names a column for the position of each row over all files.
    """
    if schema is None:
        schema = spark.read.csv(
            path, inferSchema=True, nullValue="", **_csv_options(multiline)
        ).schema
    header = spark.read.csv(path, **_csv_options(multiline)).columns
    lacking = [f.name for f in schema.fields if f.name not in header]
    if lacking:
        raise ValueError(f"columns not in the header of {path}: {lacking}")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(texts).csv(path, **_csv_options(multiline))
    if row_index:
        raw = with_row_index(raw, "__row_index")
    out = _typed(raw, schema)
    return out.withColumnRenamed("__row_index", row_index) if row_index else out


def with_row_index(df: DataFrame, out: str = "row_idx", per_file: bool = False) -> DataFrame:
    """0-based position of each row, in order of file name and place in the file;
    ``per_file`` starts anew in each file and keeps its path in ``__file``.

    No sort and no shuffle of the rows: each file split counts its rows, the
    counts (one row per split) are summed up, and a row adds its place within
    its split to the rows before that split.
    """
    if "__file" not in df.columns:
        df = _placed(df)
    placed = df.withColumn("__seq", F.monotonically_increasing_id())
    splits = placed.groupBy("__file", "__split").agg(
        F.count("*").alias("__n"), F.min("__seq").alias("__first")
    )
    order = Window.partitionBy("__file").orderBy("__split") if per_file else Window.orderBy("__file", "__split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select(
        "__file", "__split", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    return (
        placed.join(base, ["__file", "__split"])
        .withColumn(out, F.col("__base") + F.col("__seq") - F.col("__first"))
        .drop("__split", "__seq", "__first", "__base", *([] if per_file else ["__file"]))
    )


def _placed(df: DataFrame) -> DataFrame:
    """Rows with the file and the split of it they come from."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split")
    )


def stream_csv(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1,
    multiline: bool = True, placed: bool = False,
) -> DataFrame:
    """The same scan as a stream of micro-batches of files; ``placed`` adds where in
    which file a row stands (``__file``, ``__split``)."""
    raw = (
        spark.readStream.schema(_text_schema(schema))
        .option("maxFilesPerTrigger", files_per_batch)
        .options(**{k: str(v).lower() if isinstance(v, bool) else v
                    for k, v in _csv_options(multiline).items()})
        .csv(path)
    )
    return _typed(_placed(raw) if placed else raw, schema)


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table. ``spread`` is for tables of long texts: if the scan has
    fewer partitions than the cluster has cores, its rows are dealt out to all
    of them. A large table has more partitions and is left as it is."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def store(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
    replace_partitions: bool = False,
) -> None:
    """Replace or append to a Parquet table. ``replace_partitions`` replaces only the
    partitions that have rows in ``df``: the files of all others stay as they are."""
    how = "dynamic" if replace_partitions else "static"
    if replace_partitions and mode != "overwrite":
        raise ValueError("partitions are replaced by overwriting")
    df.write.mode(mode).option("partitionOverwriteMode", how).partitionBy(*(partition_by or [])).parquet(path)


def upsert_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Puts rows into a table kept by partition, such as the chunks of a document or
    the verdicts of a day: a partition that comes again takes the place of its former
    rows, in one commit, and no other partition is read or written. Rows of one
    partition are written by as many tasks as hold them."""
    store(df, path, partition_by=partition_by, replace_partitions=True)


def read_rule_files(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON rule files: an array of objects each or, with ``lines``, an object a
    line. A broken file (or line) adds no rows."""
    full = T.StructType.fromDDL(schema).add("__broken", T.StringType())
    read = (
        spark.read.schema(full)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "__broken")
        .json(path)
    )
    return read.filter(F.col("__broken").isNull()).drop("__broken")


def write_rule_files(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
