"""Scans, cleaning, checks, profiles, samples of transaction tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import WS, query, table
from tallywarden.functions.text import clean_label, transaction_label, violation_label
from tallywarden.operators import cleaning as cl
from tallywarden.operators import ordering, profile, summary
from tallywarden.session import scratch_path
from tallywarden.sources import tables as src

ORDER_CSV = (
    T.StructType()
    .add("o_orderkey", "long")
    .add("o_custkey", "long")
    .add("o_orderstatus", "string")
    .add("o_totalprice", "double")
    .add("o_orderdate", "date")
    .add("o_orderpriority", "string")
)


def orders(spark, sf):
    return table(spark, sf, "orders")


def orders_csv(spark, sf) -> str:
    """Orders as CSV text, with one priority left empty."""
    path = scratch_path(spark, "orders-csv")
    orders(spark, sf).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    ).write.option("header", True).csv(path)
    return path


@query(
    "s1_csv_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders""",
)
def _(spark, sf):
    df = src.scan_csv(spark, orders_csv(spark, sf), ORDER_CSV)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "s2_csv_row_chunks",
    """SELECT CAST(row_idx // 10000 AS BIGINT) AS chunk, count(*) AS row_count, min(row_idx) AS first_row,
         max(row_idx) AS last_row, count(DISTINCT row_idx) AS distinct_rows
       FROM (SELECT row_number() OVER () - 1 AS row_idx FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    df = src.scan_csv(
        spark, orders_csv(spark, sf), ORDER_CSV, multiline=False, row_index="row_idx"
    )
    return df.groupBy(F.floor(F.col("row_idx") / 10000).alias("chunk")).agg(
        F.count("*").alias("row_count"),
        F.min("row_idx").alias("first_row"),
        F.max("row_idx").alias("last_row"),
        F.count_distinct("row_idx").alias("distinct_rows"),
    )


@query(
    "s3_type_profile",
    """SELECT 'orders' AS tbl, c AS "column", t AS type FROM (
         SELECT unnest(['o_orderkey','o_totalprice','o_orderdate','o_orderpriority','date_text']) AS c,
           unnest(['integer','float','datetime',
             CASE WHEN count(*) FILTER (o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS TIMESTAMP) IS NULL) = 0
               THEN 'datetime (inferred)' ELSE 'string' END,
             CASE WHEN count(*) FILTER (try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NULL) = 0
               THEN 'datetime (inferred)' ELSE 'string' END]) AS t FROM orders)
       UNION ALL
       SELECT 'events', c, t FROM (
         SELECT unnest(['event_id','ts','event_type','value','large']) AS c,
           unnest(['integer','datetime',
             CASE WHEN count(*) FILTER (try_cast(event_type AS TIMESTAMP) IS NULL) = 0
               THEN 'datetime (inferred)' ELSE 'string' END,
             'float','boolean']) AS t FROM events)""",
)
def _(spark, sf):
    o = orders(spark, sf).select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
    )
    e = table(spark, sf, "events").select(
        "event_id", "ts", "event_type", "value", (F.col("value") > 100).alias("large")
    )
    tagged = [
        profile.profile_types(df).select(F.lit(name).alias("tbl"), "column", "type")
        for name, df in (("orders", o), ("events", e))
    ]
    return tagged[0].unionByName(tagged[1])


@query(
    "s4_replace_and_append",
    """SELECT o_orderstatus, count(*) AS row_count,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
       FROM orders GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "orders")
    o = orders(spark, sf)
    src.store(o, path)
    src.store(o.filter("o_orderstatus = 'F'"), path)
    src.store(o.filter("o_orderstatus <> 'F'"), path, mode="append")
    return (
        spark.read.parquet(path)
        .groupBy("o_orderstatus")
        .agg(
            F.count("*").alias("row_count"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
    )


@query("p1_banned_column", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "C_NationKey")
    return cl.without_columns(df, ["c_nationkey"])


@query(
    "p2_role_projection",
    "SELECT o_totalprice AS amount, o_custkey AS party, o_orderkey AS transaction_id FROM orders",
)
def _(spark, sf):
    return cl.project_roles(
        orders(spark, sf),
        {"amount": [*cl.AMOUNT_NAMES, "O_TotalPrice"], "party": ["custkey"], "country": ["country"]},
        [*cl.TRANSACTION_ID_NAMES, "O_OrderKey"],
    )


@query(
    "p3_amount_parse",
    f"""SELECT o_orderkey, try_cast(trim(replace(t, ',', ''), {WS}) AS DOUBLE) AS amount FROM (
         SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a'
           ELSE ' ' || format('{{:,.2f}}', o_totalprice) || chr(160) END AS t FROM orders)""",
)
def _(spark, sf):
    text = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(
        F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    )
    return orders(spark, sf).select("o_orderkey", cl.parsed_amount(text).alias("amount"))


def sparse_orders(spark, sf):
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("row_idx"),
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_totalprice") < 200000, F.col("o_totalprice")).alias("amount"),
    )


SPARSE = """sparse AS (SELECT o_orderkey AS row_idx, nullif(o_orderstatus, 'F') AS status,
  nullif(o_orderpriority, '5-LOW') AS priority,
  CASE WHEN o_totalprice < 200000 THEN o_totalprice END AS amount FROM orders)"""


@query(
    "p4_drop_empty_rows",
    f"WITH {SPARSE} SELECT * FROM sparse WHERE NOT (status IS NULL AND priority IS NULL AND amount IS NULL)",
)
def _(spark, sf):
    return cl.drop_empty_rows(sparse_orders(spark, sf), ["status", "priority", "amount"])


@query(
    "p4_empty_row_log",
    f"""WITH {SPARSE} SELECT row_idx, 'Row completely empty' AS reason FROM sparse
        WHERE status IS NULL AND priority IS NULL AND amount IS NULL ORDER BY row_idx LIMIT 25""",
)
def _(spark, sf):
    return cl.dropped_empty_log(sparse_orders(spark, sf), "row_idx", limit=25)


@query(
    "p5_drop_incomplete_rows",
    f"""WITH {SPARSE} SELECT * FROM sparse
        WHERE status IS NOT NULL AND priority IS NOT NULL AND amount IS NOT NULL""",
)
def _(spark, sf):
    return cl.drop_incomplete_rows(sparse_orders(spark, sf))


@query(
    "p5_incomplete_row_log",
    f"""WITH {SPARSE} SELECT row_idx, 'NULL values in column(s): ' || concat_ws(', ',
          CASE WHEN status IS NULL THEN 'status' END, CASE WHEN priority IS NULL THEN 'priority' END,
          CASE WHEN amount IS NULL THEN 'amount' END) AS reason
        FROM sparse WHERE status IS NULL OR priority IS NULL OR amount IS NULL""",
)
def _(spark, sf):
    return cl.dropped_incomplete_log(sparse_orders(spark, sf), "row_idx")


@query(
    "p6_trim_text",
    f"""SELECT c_custkey, trim(chr(9) || c_name || chr(160) || ' ', {WS}) AS c_name,
          trim(chr(10) || c_mktsegment, {WS}) AS c_mktsegment FROM customer""",
)
def _(spark, sf):
    padded = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("\t"), "c_name", F.lit("  ")).alias("c_name"),
        F.concat(F.lit("\n"), "c_mktsegment").alias("c_mktsegment"),
    )
    return cl.trim_text(padded)


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"),
        "l_returnflag",
        "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"),
    )


LINES = """lines AS (SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem)"""


@query(
    "w1_first_of_duplicates",
    f"""WITH {LINES} SELECT l_returnflag, l_linestatus, shipdate, row_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, shipdate ORDER BY row_idx) AS n FROM lines)
        WHERE n = 1""",
)
def _(spark, sf):
    return cl.first_of_duplicates(lines(spark, sf), "row_idx")


@query(
    "w1_duplicate_log",
    """SELECT doc_id AS row_idx, 'Duplicate row' AS reason FROM (
         SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS n FROM documents)
       WHERE n > 1 ORDER BY doc_id LIMIT 25""",
)
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "text", "lang")
    return cl.duplicate_log(df, "row_idx", limit=25)


@query(
    "w2_duplicates_within_chunks",
    f"""WITH {LINES} SELECT CAST(row_idx // 10000 AS BIGINT) AS chunk, l_returnflag, l_linestatus, shipdate,
          min(row_idx) AS row_idx FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    chunked = lines(spark, sf).withColumn("chunk", F.floor(F.col("row_idx") / 10000))
    return cl.first_of_duplicates(chunked, "row_idx", ["chunk"])


@query(
    "a16_distinct_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").distinct()


@query(
    "a1_amount_profile",
    """SELECT min(a) AS min_amount, max(a) AS max_amount, round(CAST(avg(a) AS DOUBLE), 2) AS mean_amount,
         count(*) FILTER (a >= 400000) AS large_rows, count(a) AS parsed_rows
       FROM (SELECT CAST(o_totalprice AS DECIMAL(18, 2)) AS a FROM orders)""",
)
def _(spark, sf):
    amount = cl.parsed_amount(F.format_number("o_totalprice", 2)).cast("decimal(18,2)")
    got = profile.amount_profile(orders(spark, sf), amount, 400000)
    return got.withColumn("mean_amount", F.round(F.col("mean_amount").cast("double"), 2))


@query(
    "a2_row_counts",
    f"""WITH {LINES} SELECT (SELECT count(*) FROM lines) AS rows_input, s AS rows_stored,
          (SELECT count(*) FROM lines) - s AS rows_dropped
        FROM (SELECT count(*) AS s FROM (SELECT DISTINCT l_returnflag, l_linestatus, shipdate FROM lines))""",
)
def _(spark, sf):
    df = lines(spark, sf)
    return cl.row_counts(df, cl.first_of_duplicates(df, "row_idx"))


@query(
    "a3_null_cells",
    f"""WITH {SPARSE} SELECT count(*) AS row_count, sum((status IS NULL)::INT + (priority IS NULL)::INT + (amount IS NULL)::INT)::BIGINT
          AS null_cells FROM sparse""",
)
def _(spark, sf):
    got = cl.row_totals(sparse_orders(spark, sf), ["status", "priority", "amount"])
    return got.select(F.col("rows").alias("row_count"), "null_cells")


@query(
    "a4_repeated_rows",
    f"""WITH {LINES} SELECT (SELECT count(*) FROM lines) -
          (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, shipdate FROM lines)) AS repeats""",
)
def _(spark, sf):
    return cl.row_totals(lines(spark, sf).drop("row_idx")).select("repeats")


CHECKS = """SELECT 'Country column removed' AS name, 'PASS' AS status, '' AS detail FROM t
  UNION ALL SELECT 'No NULL values', CASE WHEN nulls = 0 THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN nulls = 0 THEN '' ELSE nulls || ' NULL(s) still present.' END FROM t
  UNION ALL SELECT 'No duplicate rows', CASE WHEN dups = 0 THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN dups = 0 THEN '' ELSE dups || ' duplicate(s) still present.' END FROM t
  UNION ALL SELECT 'Dataset not empty after cleaning', CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN n > 0 THEN '' ELSE 'All rows were dropped during preprocessing.' END FROM t
  UNION ALL SELECT 'At least one column present', 'PASS', '' FROM t"""
SPARSE_TOTALS = """t AS (SELECT count(*) AS n,
  sum((status IS NULL)::INT + (priority IS NULL)::INT + (amount IS NULL)::INT)::BIGINT AS nulls,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, priority, amount FROM sparse)) AS dups FROM sparse)"""


@query("a5_check_report", f"WITH {SPARSE}, {SPARSE_TOTALS} {CHECKS}")
def _(spark, sf):
    return cl.check_report(sparse_orders(spark, sf), ["status", "priority", "amount"])


@query(
    "a5_gate",
    f"WITH {SPARSE}, {SPARSE_TOTALS}, c AS ({CHECKS}) SELECT bool_and(status = 'PASS') AS passed FROM c",
)
def _(spark, sf):
    return cl.gate(cl.check_report(sparse_orders(spark, sf), ["status", "priority", "amount"]))


@query(
    "a6_failed_checks",
    f"""WITH {LINES}, t AS (SELECT row_idx // 10000 AS chunk, count(*) AS n,
          count(DISTINCT (l_returnflag, l_linestatus, shipdate)) AS d FROM lines GROUP BY 1)
        SELECT 'No duplicate rows' AS name, count(*) AS failed_chunks FROM t WHERE n > d HAVING count(*) > 0""",
)
def _(spark, sf):
    chunked = lines(spark, sf).withColumn("chunk", F.floor(F.col("row_idx") / 10000))
    report = cl.check_report(chunked, ["l_returnflag", "l_linestatus", "shipdate"], ["chunk"])
    return cl.failed_checks(report)


@query(
    "u1_union_of_parts",
    """SELECT o_orderstatus, count(*) AS row_count, min(o_orderkey) AS first_key FROM orders GROUP BY 1""",
)
def _(spark, sf):
    o = orders(spark, sf)
    parts = o.filter("o_orderstatus = 'F'").unionByName(
        o.filter("o_orderstatus <> 'F'").select(*reversed(o.columns))
    )
    return parts.groupBy("o_orderstatus").agg(
        F.count("*").alias("row_count"), F.min("o_orderkey").alias("first_key")
    )


@query(
    "u5_quality_findings",
    f"""WITH {SPARSE}, {SPARSE_TOTALS}, c AS ({CHECKS})
        SELECT name AS rule, detail, 'HIGH' AS severity, 'VIOLATION' AS verdict FROM c WHERE status = 'FAIL'
        UNION ALL SELECT 'Data Quality: Null/Duplicate Rows',
          format('{{:,}}', dups) || ' rows dropped during preprocessing', 'MEDIUM', 'WARNING' FROM t WHERE dups > 0""",
)
def _(spark, sf):
    df = sparse_orders(spark, sf)
    data = ["status", "priority", "amount"]
    counts = cl.row_counts(df, cl.first_of_duplicates(df, "row_idx"))
    return cl.quality_findings(cl.check_report(df, data), counts)


@query("t1_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000")
def _(spark, sf):
    return orders(spark, sf).select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5000)


@query(
    "t1_sample_rows",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 50) AS text, lang, source
       FROM documents ORDER BY documents.doc_id LIMIT 5""",
)
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return profile.sample_rows(df, ["doc_id"], 5)


@query(
    "f11_row_labels",
    """SELECT o_orderkey, 'TXN-' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 6, '0') AS txn,
         'VIO-' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 7, '0') || '-' || substr('RULE-' || o_orderstatus || '-X', 1, 6) AS vio,
         'CLN-' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 7, '0') AS cln FROM orders""",
)
def _(spark, sf):
    rule = F.concat(F.lit("RULE-"), "o_orderstatus", F.lit("-X"))
    i = F.col("o_orderkey")
    return orders(spark, sf).select(
        i, transaction_label(i).alias("txn"), violation_label(i, rule).alias("vio"),
        clean_label(i).alias("cln"),
    )


@query(
    "w9_fixed_batches",
    """SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3 AS batch_no
       FROM orders""",
)
def _(spark, sf):
    year = F.year("o_orderdate")
    batched = ordering.fixed_batches(
        orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"], year, 3
    )
    return batched.select("o_orderkey", "batch_no")


@query(
    "t3_page",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 45""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_totalprice")
    return summary.page(df, [F.desc("o_totalprice"), "o_orderkey"], 4)


@query(
    "t3_deep_page",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 885""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_totalprice")
    block = F.floor(-F.col("o_totalprice") / 500)
    return summary.deep_page(df, [F.desc("o_totalprice"), "o_orderkey"], block, 60)


@query("t3_page_count", "SELECT CAST(greatest(1, ceil(count(*) / 15.0)) AS BIGINT) AS pages FROM orders")
def _(spark, sf):
    return summary.page_count(orders(spark, sf))
