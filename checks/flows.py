"""Streaming ingest, stage metrics and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import WS, query, table
from checks.transactions import LINES, lines
from tallywarden.operators import chunking as ck
from tallywarden.plans import jobs
from tallywarden.operators.stages import StageCounts, rows
from tallywarden.session import cut_lineage, scratch_path
from tallywarden.sources.tables import store
from tallywarden.streaming import microbatch as mb
from tallywarden.streaming.events import ingest_events

STREAM_SCHEMA = (
    T.StructType()
    .add("l_returnflag", "string")
    .add("l_linestatus", "string")
    .add("shipdate", "string")
)
# Line numbers that go to one file, and rows in a chunk of it.
FILE_NUMBERS, CHUNK_ROWS = 20_000, 2_500


def streamed(spark, sf, files_per_batch=4) -> tuple[str, str]:
    """Line items as CSV files, ingested by a stream; paths of rows and metrics. The
    files hold neither row numbers nor chunks."""
    base = scratch_path(spark, "stream")
    parted = lines(spark, sf).withColumn("part", F.floor(F.col("row_idx") / FILE_NUMBERS).cast("int"))
    files = (parted.agg(F.max("part")).first()[0] or 0) + 1
    by_file = parted.repartitionById(files, "part").sortWithinPartitions("row_idx", "l_returnflag", "l_linestatus", "shipdate")
    by_file.drop("row_idx", "part").write.option("header", True).csv(f"{base}/in")
    mb.ingest(
        spark, f"{base}/in", STREAM_SCHEMA, f"{base}/rows", f"{base}/metrics",
        f"{base}/checkpoint", "row_idx", "chunk", files_per_batch, chunk_rows=CHUNK_ROWS,
    )
    return f"{base}/rows", f"{base}/metrics"


PLACED = f"""{LINES}, placed AS (SELECT row_idx // {FILE_NUMBERS} AS part, l_returnflag, l_linestatus, shipdate,
    row_number() OVER (PARTITION BY row_idx // {FILE_NUMBERS} ORDER BY row_idx, l_returnflag, l_linestatus, shipdate) - 1 AS pos FROM lines)"""
STREAMED = f"""WITH {PLACED} SELECT CAST(part AS BIGINT) AS part, CAST(pos // {CHUNK_ROWS} AS BIGINT) AS chunk,
    l_returnflag, l_linestatus, shipdate, min(pos) AS row_idx FROM placed GROUP BY ALL"""


def _streamed_rows(spark, sf, files_per_batch):
    rows, _metrics = streamed(spark, sf, files_per_batch)
    part = F.regexp_extract(mb.FILE, "part-([0-9]+)-[^/]*$", 1).cast("long")
    return spark.read.parquet(rows).withColumn("part", part).drop("batch_id", mb.ROW_HASH, mb.FILE)


@query("x1_streamed_rows", STREAMED)
def _(spark, sf):
    return _streamed_rows(spark, sf, 4)


@query("x1_streamed_rows_in_one_batch", STREAMED)
def _(spark, sf):
    return _streamed_rows(spark, sf, 100_000)


@query(
    "x1_chunks_over_batches",
    f"""WITH {LINES} SELECT CAST(row_idx // 10000 AS BIGINT) AS chunk, l_returnflag, l_linestatus, shipdate,
          min(row_idx) AS row_idx FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    """Files that bring rows and chunks, each chunk dealt over all of them."""
    base = scratch_path(spark, "stream")
    chunked = lines(spark, sf).withColumn("chunk", F.floor(F.col("row_idx") / 10000))
    chunked.repartition(6, F.xxhash64("row_idx")).write.option("header", True).csv(f"{base}/in")
    schema = T.StructType.fromDDL("row_idx long, l_returnflag string, l_linestatus string, shipdate string, chunk long")
    mb.ingest(
        spark, f"{base}/in", schema, f"{base}/rows", f"{base}/metrics", f"{base}/checkpoint",
        "row_idx", "chunk", files_per_batch=2,
    )
    return mb.current_rows(spark.read.parquet(f"{base}/rows"), "row_idx", "chunk")


@query(
    "x2_running_totals",
    f"""WITH {PLACED}, k AS (SELECT DISTINCT part, pos // {CHUNK_ROWS}, l_returnflag, l_linestatus, shipdate FROM placed)
        SELECT count(*) AS rows_input, (SELECT count(*) FROM k) AS rows_stored, count(*) - (SELECT count(*) FROM k) AS rows_dropped,
          TRUE AS compliance_passed FROM lines""",
)
def _(spark, sf):
    _rows, metrics = streamed(spark, sf)
    return mb.running_totals(spark.read.parquet(metrics))


@query(
    "x3_stage_counts",
    f"""SELECT 0 AS place, 'pages' AS stage, count(*) AS n FROM documents
        UNION ALL SELECT 1, 'readable', count(*) FROM documents WHERE length(trim(text, {WS})) >= 80
        UNION ALL SELECT 2, 'classified', count(DISTINCT source) FROM documents""",
)
def _(spark, sf):
    """Counted while the stages are written; each input is read once."""
    base = scratch_path(spark, "stages")
    run = StageCounts("run-1")
    pages = table(spark, sf, "documents").select("doc_id", "source", ck.is_readable(F.col("text")).alias("readable"))
    store(run.counted(pages, pages=rows(), readable=F.count_if("readable")), f"{base}/pages")
    classes = spark.read.parquet(f"{base}/pages").groupBy("source").agg(F.count("*").alias("pages"))
    store(run.counted(classes, classified=rows()), f"{base}/classes")
    run.save(spark, f"{base}/runs")
    run.save(spark, f"{base}/runs")  # the same run again takes its own place
    return spark.read.parquet(f"{base}/runs").filter("run = 'run-1'").drop("run")


# Events in slices of time, a file each. A slice comes with all events of the slice
# before once more (copies), with every third of these under another id (late, in
# time), and with events of five slices before under other ids (too late).
SLICES = 8


@query(
    "x4_distinct_events",
    """WITH b AS (SELECT epoch(min(ts)) AS lo, (epoch(max(ts)) - epoch(min(ts))) / 8 + 1 AS w FROM events),
         s AS (SELECT events.*, CAST(floor((epoch(ts) - lo) / w) AS INTEGER) AS slice FROM events, b)
       SELECT event_id, user_id, event_type FROM s
       UNION ALL SELECT -event_id - 1, user_id, event_type FROM s WHERE event_id % 3 = 0 AND slice + 1 < 8""",
)
def _(spark, sf):
    base = scratch_path(spark, "events")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.col("ts").cast("double")
    lo, hi = e.agg(F.min(at), F.max(at)).first()
    wide = (hi - lo) / SLICES + 1
    sliced = cut_lineage(e.withColumn("slice", F.floor((at - lo) / wide).cast("int")))
    for k in range(SLICES):
        before = sliced.filter(F.col("slice") == k - 1)
        late = before.filter("event_id % 3 = 0").withColumn("event_id", -F.col("event_id") - 1)
        too_late = sliced.filter(F.col("slice") == k - 5).withColumn("event_id", -F.col("event_id") - 10**12)
        now = sliced.filter(F.col("slice") == k)
        now.unionAll(before).unionAll(late).unionAll(late).unionAll(too_late).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(sliced.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    delay = f"{int(2 * wide)} seconds"
    ingest_events(stream.drop("slice"), f"{base}/out", f"{base}/checkpoint", ["event_id"], "ts", delay)
    return spark.read.parquet(f"{base}/out").drop("ts")


@query(
    "clean_transactions",
    f"""WITH {LINES} SELECT l_returnflag, l_linestatus, shipdate, min(row_idx) AS row_idx FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    cleaned = jobs.clean_transactions(lines(spark, sf).withColumn("country", F.lit("XX")), "row_idx")
    path = scratch_path(spark, "clean")
    assert jobs.store_if_passed(cleaned, path)
    return spark.read.parquet(path)
