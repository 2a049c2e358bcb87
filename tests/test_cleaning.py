"""Edge rows for scans, cleaning and the gate."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.operators import cleaning as cl
from tallywarden.plans import jobs
from tallywarden.sources import tables as src
from tallywarden.streaming.microbatch import clean_chunks


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_csv_edge_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(
        b'id,name,amount\n1,"a, b","12,50,000"\n2,"two\nlines",NA\n3,bad\xff,null\n4,,7.5\n5,x,oops\n'
    )
    schema = T.StructType().add("id", "long").add("name", "string").add("amount", "double")
    got = src.scan_csv(spark, str(path), schema, multiline=True).collect()
    assert [r.name for r in got] == ["a, b", "two\nlines", "bad�", None, "x"]
    assert [r.amount for r in got] == [None, None, None, 7.5, None]
    text = T.StructType().add("id", "long").add("name", "string").add("amount", "string")
    grouped = src.scan_csv(spark, str(path), text, multiline=True).select(cl.parsed_amount(F.col("amount")).alias("a"))
    assert [r.a for r in grouped.collect()] == [1250000.0, None, None, 7.5, None]


def test_row_index_over_splits(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(50000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = src.scan_csv(
            spark, str(path), T.StructType().add("n", "long"), multiline=False, row_index="i"
        )
        assert got.rdd.getNumPartitions() > 3
        assert got.filter("n <> i").count() == 0 and got.count() == 50000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_banned_column(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        both = spark.sql("select 1 as country, 2 as Country, 3 as country_of_origin")
        assert cl.without_columns(both).columns == ["Country", "country_of_origin"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert cl.without_columns(spark.sql("select 1 as COUNTRY, 2 as x")).columns == ["x"]
    assert cl.without_columns(spark.sql("select 2 as x")).columns == ["x"]


def test_roles():
    assert cl.role_column(["Total_Amount_X", "AMT"], cl.AMOUNT_NAMES) == "AMT"
    assert cl.role_column(["my_amount_col", "z"], cl.AMOUNT_NAMES) == "my_amount_col"
    assert cl.role_column(["z"], cl.AMOUNT_NAMES) is None
    assert cl.transaction_id_column(["ref", "ID"]) == "ID"


def test_null_variants_and_duplicates(spark):
    df = spark.createDataFrame(
        [(0, "a", None), (1, None, None), (2, "a", None), (3, "b", "c"), (4, " b", "c")],
        "i long, x string, y string",
    )
    clean = jobs.clean_transactions(df, "i")
    # Duplicates are searched before trimming: rows 3 and 4 both stay and fail the check.
    assert rows(clean.rows, "i", "x", "y") == [(0, "a", None), (3, "b", "c"), (4, "b", "c")]
    report = {r["name"]: r["status"] for r in clean.report.collect()}
    assert report["No duplicate rows"] == "FAIL" and report["No NULL values"] == "FAIL"
    assert tuple(clean.counts.first()) == (5, 3, 2)
    strict = jobs.clean_transactions(df, "i", strict=True)
    assert rows(strict.rows, "i") == [(3,), (4,)]
    logged = cl.dropped_incomplete_log(df, "i").filter("i = 1").first()["reason"]
    assert logged == "NULL values in column(s): x, y"


def test_empty_table_fails_gate(spark):
    df = spark.createDataFrame([], "i long, x string")
    clean = jobs.clean_transactions(df, "i")
    status = {r["name"]: r["status"] for r in clean.report.collect()}
    assert status["Dataset not empty after cleaning"] == "FAIL"
    assert not cl.gate(clean.report).first()[0]


def test_store_only_if_passed(spark, tmp_path):
    good = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i long, x string")
    assert jobs.store_if_passed(jobs.clean_transactions(good, "i"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    bad = good.unionByName(spark.sql("select 3L as i, ' a' as x"))
    assert not jobs.store_if_passed(jobs.clean_transactions(bad, "i"), str(tmp_path / "u"))


def test_result_ignores_partitioning(spark):
    df = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 7).cast("string").alias("x"))
    one = jobs.clean_transactions(df.coalesce(1), "i").rows
    two = jobs.clean_transactions(df.orderBy(F.desc("i")).repartition(13), "i").rows
    assert rows(one, "i", "x") == rows(two, "i", "x")


def test_chunk_scoped_duplicates(spark):
    df = spark.createDataFrame(
        [(0, 0, "a"), (1, 0, "a"), (2, 1, "a"), (3, 1, None)], "i long, chunk long, x string"
    )
    assert rows(clean_chunks(df, "i", "chunk"), "i") == [(0,), (2,)]


def test_logs_are_whole_by_default(spark):
    from tallywarden.operators import cleaning as cl

    df = spark.range(40).selectExpr("id AS row_idx", "CAST(NULL AS string) AS a")
    assert cl.dropped_empty_log(df, "row_idx").count() == 40
    assert cl.duplicate_log(df, "row_idx").count() == 39
    assert cl.duplicate_log(df, "row_idx", limit=25).count() == 25


def test_metrics_of_a_batch_come_from_one_grouping(spark):
    from tallywarden.streaming import microbatch as mb

    df = spark.createDataFrame(
        [(0, 0, "a", "x"), (1, 0, "a", "x"), (2, 0, " a", "x"), (3, 0, None, None), (4, 1, None, None), (5, None, "b", None)],
        "i long, chunk long, x string, y string",
    )
    got = mb._metrics(mb._counted(df, "i", ["chunk"]), "i", ["chunk"]).collect()
    assert {tuple(r) if not r.failed else (*r[:3], tuple(r.failed)) for r in got if r.failed} == {
        (0, 4, 2, ("No duplicate rows",)), (None, 1, 1, ("No NULL values",))
    }
    assert [tuple(r) for r in got if not r.failed] == [(1, 1, 0, [])]
