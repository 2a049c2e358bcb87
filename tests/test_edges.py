"""Rows that once gave wrong answers."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.functions.html import page_links
from tallywarden.functions.text import fill_template
from tallywarden.operators import audit, evaluate, registry, rules, summary
from tallywarden.operators.stages import StageCounts
from tallywarden.sources.tables import scan_csv, store, upsert_partitions
from tallywarden.sources import tables
from tallywarden.streaming import microbatch


def test_conditions_do_not_depend_on_the_number_of_rules(spark):
    tx = spark.sql(
        "select * from values (1, cast(0.1 as float), double('NaN'), cast(0.10 as decimal(9,2)), true, date'2024-01-02', '0.1'),"
        " (2, cast('Infinity' as float), double('-Infinity'), cast(7 as decimal(9,2)), false, null, 'NaN'),"
        " (3, null, 5.0D, null, null, date'2024-01-03', ' x ') t(id, f, d, m, b, day, s)"
    )
    book = [
        (f"{field}-{op}-{value}", field, op, value)
        for field in ("f", "d", "m", "b", "day", "s")
        for op in ("gt", "gte", "lt", "lte", "eq", "neq", "in", "not_in", "missing", "contains")
        for value in ("0.1", "5", "true", "2024-01-02", "x", "NaN", "٥", " 5", "5, ٥, x", None)
    ] + [(None, "d", "gt", "1")]
    frame = spark.createDataFrame(book, "rule_id string, condition_field string, condition_operator string, condition_value string")
    compiled = {tuple(r) for r in evaluate.violations(tx, frame, ["id"], compiled_rules=10_000).collect()}
    joined = {tuple(r) for r in evaluate.violations(tx, frame, ["id"], compiled_rules=1).collect()}
    assert compiled == joined and not any(name is None for _, name in joined)
    for number in (10_000, 1):
        told = {r.id: r.violated for r in evaluate.flagged(tx, frame, compiled_rules=number).collect()}
        assert told == {i: any(j == i for j, _ in joined) for i in (1, 2, 3)}
    for name in ("f-lte-0.1", "f-eq-0.1", "m-eq-0.1", "s-eq-0.1", "b-eq-true", "day-eq-2024-01-02"):
        assert (1, name) in joined, name
    assert (1, "d-gt-5") not in joined and (1, "d-lt-5") not in joined
    assert (2, "f-gt-5") in joined and (2, "d-lt-0.1") in joined and (3, "s-in-x") in joined


def test_many_rules_on_one_field(spark, monkeypatch):
    import bisect

    bounds = [(f"g{i}", "amount", "gt", str(10 * i)) for i in range(60_000)]
    others = [(f"n{i}", "name", "not_in", f"a{i}, b") for i in range(50)] + [(f"e{i}", "name", "eq", f"a{i}") for i in range(40_000)]
    rules = spark.createDataFrame(bounds + others, "rule_id string, condition_field string, condition_operator string, condition_value string")
    rows = [(1, 5.0, "a7"), (2, 101.0, "b"), (3, None, None), (4, -3.0, "zz"), (4, 600.0, "a39999"), (None, 30.0, "")]
    tx = spark.createDataFrame(rows, "id long, amount double, name string")
    steps = [10 * i for i in range(60_000)]
    want = []
    for i, amount, name in rows:
        if amount is not None:
            want += [(i, f"g{k}") for k in range(bisect.bisect_left(steps, amount))]
        if name is not None:
            want += [(i, f"n{k}") for k in range(50) if name not in (f"a{k}", "b")]
            want += [(i, name.replace("a", "e"))] if name.startswith("a") else []
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    for size in (1_000_000, 40_000):  # one index, several
        monkeypatch.setattr(evaluate, "INDEXED_RULES", size)
        got = evaluate.violations(tx, rules, ["id"])
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
        assert summary.compliance_summary(evaluate.flagged(tx, rules)).first().violation_count == 5


def test_rate_counts_rows_not_keys(spark):
    tx = spark.createDataFrame([(1, 9.0), (1, 9.0), (None, 9.0), (None, 9.0)], "id long, amount double")
    rules = spark.createDataFrame([("r", "amount", "gt", "5")], "rule_id string, condition_field string, condition_operator string, condition_value string")
    got = summary.compliance_summary(evaluate.flagged(tx, rules)).first()
    assert (got.total_rows, got.violation_count, got.compliance_rate) == (4, 4, 0.0)


def test_upsert_of_rows_without_order(spark):
    old = spark.createDataFrame([("k1", "old"), ("k2", "keep")], "k string, v string")
    new = spark.createDataFrame([("k1", "new", None), ("k3", "n3", None), ("k4", "late", 2), ("k4", "none", None)], "k string, v string, at int")
    got = registry.upsert(old, new, "k", F.col("at")).drop("at").collect()
    assert sorted(map(tuple, got)) == [("k1", "new"), ("k2", "keep"), ("k3", "n3"), ("k4", "late")]


def test_bins_of_a_null_key(spark):
    from tallywarden.operators.packing import greedy_bins

    rows = [(k, i, w) for k in ("a", None) for i, w in enumerate([5, 5, 3, 9, 1, 1, 12, 2])]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    want = [(i, b) for i, b in enumerate([0, 0, 1, 2, 2, 3, 4, 5])]
    for block in (100, 3):
        got = greedy_bins(df, "k", "i", "w", 10, block_size=block).collect()
        for key in ("a", None):
            assert sorted((r.i, r.batch_no) for r in got if r.k == key) == want


def test_ids_of_rows_are_whole(spark):
    df = spark.range(99_998, 100_002).selectExpr(
        "id AS place", "CAST(NULL AS string) AS id", "CAST(NULL AS string) AS transactionId", "'1' AS amount",
        "'r' AS rule", "'LOW' AS severity", "'x' AS verdict", "'x' AS status",
    )
    got = [r.transactionId for r in summary.normal_violations(df, "place").orderBy("id").collect()]
    assert sorted(got) == ["TXN-100000", "TXN-100001", "TXN-100002", "TXN-99999"]


def test_memo_rows_stay_whole(spark):
    memo = spark.createDataFrame([("k", "b", "Y"), ("k", "a", "Z")], "key string, x string, y string")
    new = spark.createDataFrame([("k", 1)], "key string, n int")
    assert [tuple(r) for r in registry.memo_lookup(new, memo, "key", ["x", "y"]).collect()] == [("k", 1, "a", "Z")]


def test_gate_of_unknown_type_is_false(spark):
    docs = spark.sql("select cast(null as string) as source_document_type")
    assert registry.order_gate(docs, docs).first().admitted is False


def test_rule_ids_tell_nulls_apart(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), ("a", "b", None), ("a", "b", "")], "title string, description string, source_clause string"
    )
    assert len({r.rule_id for r in rules.insertable_rules(df).collect()}) == 3


def test_history_holds_each_former_row(spark):
    reg = spark.sql("select 'R' rule_id, 'NEW' status, 'x' last_modified_by, 'y' modification_summary, 1 reference_count")
    rows = [("N2", "R", "MODIFIED", "two", "d2", "2024-02-01"), ("N1", "R", "MODIFIED", "one", "d1", "2024-01-01")]
    judged = spark.createDataFrame(
        [(a, b, c, s, "referenced", d, "t", when) for a, b, c, s, d, when in rows],
        "new_id string, matched_rule_id string, status string, modification_summary string, provenance_action string,"
        " source_document_name string, source_document_type string, source_document_date string",
    )
    got = {r.replaced_by: json.loads(r.old_rule) for r in registry.history_additions(reg, judged, "new_id").collect()}
    assert got["N1"] == {"rule_id": "R", "status": "NEW", "last_modified_by": "x", "modification_summary": "y", "reference_count": 1}
    assert got["N2"] == {"rule_id": "R", "status": "MODIFIED", "last_modified_by": "d1", "modification_summary": "one", "reference_count": 2}


def test_broken_links_are_left_out(spark):
    page = """<a href="http://[x/y">a</a> <a href="/z">b</a>"""
    df = spark.createDataFrame([(page, "http://h/p")], "html string, url string")
    assert df.select(page_links(F.col("html"), F.col("url"), None)).first()[0] == ["http://h/z"]


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("{party} paid {amount} {other}", "{amount}", 5)], "t string, party string, amount int")
    got = df.select(fill_template(F.col("t"), {"party": F.col("party"), "amount": F.col("amount")})).first()[0]
    assert got == "{amount} paid 5 {other}"


def test_clause_search_reads_whole_phrases(spark):
    same = "a" * 70
    df = spark.createDataFrame([(1, same + " x"), (2, same + " y")], "id int, c string")
    assert [r.id for r in registry.clause_search(df, "c", same + " y", ["id"]).collect()] == [2]


def test_matrix_without_hits_keeps_the_order_of_the_list(spark):
    df = spark.createDataFrame([(0, "R9", "one", None), (1, "R1", "two", "LOW"), (2, "R0", "three", "LOW")],
                               "idx int, rule_id string, title string, severity string").withColumn("description", F.lit(""))
    got = [(r.place, r.rule_id, r.severity, r.percentage) for r in audit.keyword_matrix(df, "idx").orderBy("place").collect()]
    assert got == [(0, "R9", "MEDIUM", 2.0), (1, "R1", "LOW", 2.0)]


def test_matrix_takes_each_rule_once(spark):
    rows = [(0, "A", "kyc and ctr", ""), (1, "B", "ctr", None), (2, "C", "aml pep sanction", "LOW")]
    df = spark.createDataFrame(rows, "idx int, rule_id string, title string, severity string").withColumn("description", F.lit(None).cast("string"))
    got = [(r.place, r.rule_id, r.severity) for r in audit.keyword_matrix(df, "idx").orderBy("place").collect()]
    assert got == [(0, "A", "MEDIUM"), (1, "B", "HIGH"), (2, "C", "LOW")]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1,x\n")
    schema = "a string, b long"
    assert [tuple(r) for r in scan_csv(spark, str(tmp_path), T.StructType.fromDDL(schema)).collect()] == [("x", 1)]
    with pytest.raises(ValueError):
        scan_csv(spark, str(tmp_path), T.StructType.fromDDL("c string"))


@pytest.mark.parametrize("files_per_batch", [1, 16])
def test_stream_keeps_the_first_copy_whatever_the_batches(spark, tmp_path, files_per_batch):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(["5,x ,1\n6,y,1\n", "1,x ,1\n2,z,1\n3,x,1\n4,x ,2\n"]):
        (tmp_path / "in" / f"{k}.csv").write_text("row_idx,a,chunk\n" + rows)
    schema = T.StructType.fromDDL("row_idx long, a string, chunk long")
    paths = [f"{tmp_path}/{d}" for d in ("rows", "metrics", "checkpoint")]
    microbatch.ingest(spark, f"{tmp_path}/in", schema, *paths, "row_idx", "chunk", files_per_batch)
    rows = microbatch.current_rows(spark.read.parquet(paths[0]), "row_idx", "chunk")
    assert sorted((r.chunk, r.row_idx, r.a) for r in rows.collect()) == [(1, 1, "x"), (1, 2, "z"), (1, 3, "x"), (1, 6, "y"), (2, 4, "x")]
    total = microbatch.running_totals(spark.read.parquet(paths[1]), rows).first()
    assert (total.rows_input, total.rows_stored, total.rows_dropped) == (6, 5, 1)


def test_stream_numbers_rows_and_chunks_on_arrival(spark, tmp_path):
    files = {f"{name}.csv": [f"{name}{i % 7}" for i in range(n)] for name, n in (("b", 25), ("a", 31), ("c", 1), ("d", 0))}
    want = set()
    for name, rows in files.items():
        for i, a in enumerate(rows):
            if a not in rows[i - i % 10 : i]:
                want.add((name, i // 10, i, a))
    for turn, (per_batch, order) in enumerate([(1, "abcd"), (1, "dcba"), (2, "cabd"), (16, "bdac")]):
        base = tmp_path / str(turn)
        (base / "in").mkdir(parents=True)
        for k, name in enumerate(order):
            path = base / "in" / f"{name}.csv"
            path.write_text("a\n" + "".join(f"{a}\n" for a in files[path.name]))
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # the order of arrival
        paths = [f"{base}/{d}" for d in ("rows", "metrics", "checkpoint")]
        microbatch.ingest(spark, f"{base}/in", T.StructType.fromDDL("a string"), *paths, "row_idx", "chunk", per_batch, chunk_rows=10)
        rows = spark.read.parquet(paths[0]).collect()
        assert {(r.file.split("/")[-1], r.chunk, r.row_idx, r.a) for r in rows} == want and len(rows) == len(want)
        total = microbatch.running_totals(spark.read.parquet(paths[1])).first()
        assert (total.rows_input, total.rows_stored, total.compliance_passed) == (57, len(want), True)


@pytest.mark.parametrize("small", [2, 0])
def test_small_files_are_numbered_as_others_but_read_once(spark, tmp_path, small):
    for name, n in (("b", 25), ("a", 31), ("c", 1)):
        (tmp_path / f"{name}.csv").write_text("a\n" + "".join(f"{name}{i}\n" for i in range(n)))
    batch = tables._placed(scan_csv(spark, str(tmp_path), T.StructType.fromDDL("a string")))
    got = microbatch._Numbering(batch.schema, "row_idx", "chunk", 10, small).numbered(batch)
    want = {(name, i, i // 10) for name, n in (("b", 25), ("a", 31), ("c", 1)) for i in range(n)}
    assert {(r.a[0], int(r.a[1:]), r.chunk) for r in got.collect()} == want
    assert all(int(r.a[1:]) == r.row_idx and r.file.endswith(f"{r.a[0]}.csv") for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan, plan.count("Relation [")) == ((False, 1) if small else (True, 2))


def test_a_stream_makes_its_expressions_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.csv").write_text(f"a\nx{k}\nx{k}\n")
    made = []
    checks = microbatch.five_checks
    monkeypatch.setattr(microbatch, "five_checks", lambda data: made.append(data) or checks(data))
    paths = [f"{tmp_path}/{d}" for d in ("rows", "metrics", "checkpoint")]
    microbatch.ingest(spark, f"{tmp_path}/in", T.StructType.fromDDL("a string"), *paths, "row_idx", "chunk", 1, chunk_rows=10)
    total = microbatch.running_totals(spark.read.parquet(paths[1])).first()
    assert (total.rows_input, total.rows_stored) == (8, 4) and made == [["a"]]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_partitions(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), path, ["k"])
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("k=b/*.parquet")}
    upsert_partitions(spark.createDataFrame([("a", 7), ("c", 8)], "k string, v int"), path, ["k"])
    got = sorted((r.k or "", r.v) for r in spark.read.parquet(path).collect())
    assert got == [("", 3), ("a", 7), ("b", 2), ("c", 8)]
    assert files and all(p.stat().st_mtime_ns == t for p, t in files.items())
    with pytest.raises(ValueError):
        store(spark.range(1), path, "append", replace_partitions=True)


def test_stage_counts_come_with_the_write(spark, tmp_path):
    run = StageCounts("r")
    df = run.counted(spark.range(50), all=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    store(df, str(tmp_path / "x"))
    assert "CollectMetrics" in df._jdf.queryExecution().executedPlan().toString()
    run.save(spark, str(tmp_path / "runs"))
    run.save(spark, str(tmp_path / "runs"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "runs")).orderBy("place").collect()]
    assert got == [(0, "all", 50, "r"), (1, "even", 25, "r")]
