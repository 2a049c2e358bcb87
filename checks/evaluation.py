"""Rule conditions over transactions, verdict summaries, audit sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RULES, query, rules_of_documents, table
from tallywarden.operators import audit, evaluate, registry, summary
from tallywarden.operators.ordering import row_numbers
from tallywarden.plans import jobs

AS_OF = "2026-01-01"
MESSAGE = "{transaction_id}: {amount} by customer {customer_id} on {transaction_date} ({threshold_value})"
# rule_id, title, severity, field, operator, value, unit
BOOK = [
    ("R1", "Large single amount", "HIGH", "amount", "gte", "400000", "INR"),
    ("R2", "Monthly total", "HIGH", "monthly_cash_total", "gte", "600000", "INR"),
    ("R3", "Urgent class", "MEDIUM", "priority", "in", "1-URGENT,2-HIGH", "category"),
    ("R4", "Negative balance", "CRITICAL", "balance", "lt", "0", "INR"),
    ("R5", "Old record", "LOW", "record_age_years", "gt", "29", "years"),
    ("R6", "Segment not allowed", "MEDIUM", "segment", "not_in", "BUILDING,HOUSEHOLD", "category"),
    ("R7", "Missing segment", "LOW", "segment", "missing", None, "boolean"),
    ("R8", "Unknown field", "LOW", "no_such_column", "gt", "1", "count"),
]
BOOK_SQL = "book AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in BOOK
) + ") v(rule_id, title, severity, field, op, val, unit))"


def local_rows(spark, rows, names):
    """A small table of literals; as SQL values it needs no Python worker."""
    cell = lambda v: "NULL" if v is None else f"'{v}'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def book(spark):
    names = (
        "rule_id, title, severity, condition_field, condition_operator, condition_value, condition_unit"
    )
    return local_rows(spark, BOOK, names).withColumn("violation_message_template", F.lit(MESSAGE))


def transactions(spark, sf):
    """Orders with customer columns and the monthly total of the customer."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    monthly = evaluate.monthly_totals(o, "o_custkey", "o_orderdate", cents)
    dated = o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return (
        dated.join(monthly, ["o_custkey", "month"])
        .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("priority"),
            (F.col("monthly_cash_total") / 100.0).alias("monthly_cash_total"),
            F.col("c_acctbal").alias("balance"),
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
            evaluate.record_age_years(F.col("o_orderdate"), AS_OF).alias("record_age_years"),
        )
    )


TX = f"""monthly AS (SELECT o_custkey AS ck, strftime(o_orderdate, '%Y-%m') AS month,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS monthly_cash_total, count(*) AS n FROM orders GROUP BY ALL),
  tx AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS transaction_date,
    o_totalprice AS amount, o_orderpriority AS priority, monthly_cash_total, c_acctbal AS balance,
    nullif(c_mktsegment, 'MACHINERY') AS segment,
    date_diff('year', o_orderdate::DATE, DATE '{AS_OF}')
      - CASE WHEN strftime(o_orderdate, '%m-%d') > '{AS_OF[5:]}' THEN 1 ELSE 0 END AS record_age_years
    FROM orders JOIN monthly ON ck = o_custkey AND month = strftime(o_orderdate, '%Y-%m')
    LEFT JOIN customer ON c_custkey = o_custkey)"""
BROKEN = f"""{TX}, {BOOK_SQL}, broken AS (
    SELECT transaction_id, rule_id FROM tx, book WHERE CASE rule_id
      WHEN 'R1' THEN amount >= 400000 WHEN 'R2' THEN monthly_cash_total >= 600000
      WHEN 'R3' THEN priority IN ('1-URGENT', '2-HIGH') WHEN 'R4' THEN balance < 0
      WHEN 'R5' THEN record_age_years > 29 WHEN 'R6' THEN segment NOT IN ('BUILDING', 'HOUSEHOLD')
      WHEN 'R7' THEN segment IS NULL ELSE FALSE END)"""


def broken(spark, sf, **kw):
    return evaluate.violations(transactions(spark, sf), book(spark), ["transaction_id"], **kw)


@query("j13_verdicts", f"WITH {BROKEN} SELECT transaction_id, rule_id FROM broken")
def _(spark, sf):
    return broken(spark, sf)


@query("j13_verdicts_large_book", f"WITH {BROKEN} SELECT transaction_id, rule_id FROM broken")
def _(spark, sf):
    return broken(spark, sf, compiled_rules=0)


@query(
    "j13_verdicts_rule_index",
    f"""WITH {TX}, book AS (SELECT 'C' || c_custkey AS rule_id, c_custkey AS v, 'eq' AS op FROM customer WHERE c_acctbal < 2000
           UNION ALL SELECT 'B' || c_custkey, 400000 + c_acctbal * 10, 'gt' FROM customer WHERE c_custkey % 10 = 0)
        SELECT transaction_id, rule_id FROM tx JOIN book ON op = 'eq' AND customer_id = v
        UNION ALL SELECT transaction_id, rule_id FROM tx JOIN book ON op = 'gt' AND amount > v""",
)
def _(spark, sf):
    """A rule per customer with little money, and a bound per tenth customer."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    listed = c.filter("c_acctbal < 2000").select(
        F.concat(F.lit("C"), key).alias("rule_id"), F.lit("customer_id").alias("condition_field"),
        F.lit("eq").alias("condition_operator"), key.alias("condition_value"),
    )
    bounds = c.filter("c_custkey % 10 = 0").select(
        F.concat(F.lit("B"), key).alias("rule_id"), F.lit("amount").alias("condition_field"),
        F.lit("gt").alias("condition_operator"), (400000 + F.col("c_acctbal") * 10).cast("string").alias("condition_value"),
    )
    return evaluate.violations(transactions(spark, sf), listed.unionAll(bounds), ["transaction_id"], compiled_rules=64)


OPS = [
    ("O1", "gt", "200000"), ("O2", "gte", "200000.5"), ("O3", "lt", "2000"), ("O4", "lte", "2000"),
    ("O5", "eq", "5"), ("O6", "neq", "5"), ("O7", "in", "1, 2"), ("O8", "not_in", "1,2"),
    ("O9", "missing", None), ("OA", "contains", "99"), ("OB", "gt", "not a number"),
]


@query(
    "p22_condition_operators",
    """SELECT o_orderkey, r AS rule_id FROM (SELECT o_orderkey, unnest(list_filter([
         CASE WHEN o_totalprice > 200000 THEN 'O1' END, CASE WHEN o_totalprice >= 200000.5 THEN 'O2' END,
         CASE WHEN o_totalprice < 2000 THEN 'O3' END, CASE WHEN o_totalprice <= 2000 THEN 'O4' END,
         CASE WHEN k = 5 THEN 'O5' END, CASE WHEN k <> 5 THEN 'O6' END, CASE WHEN k IN (1, 2) THEN 'O7' END,
         CASE WHEN k NOT IN (1, 2) THEN 'O8' END, CASE WHEN k IS NULL THEN 'O9' END,
         CASE WHEN contains(CAST(o_orderkey AS VARCHAR), '99') THEN 'OA' END], lambda x: x IS NOT NULL)) AS r
       FROM (SELECT *, nullif(o_custkey % 10, 3) AS k FROM orders))""",
)
def _(spark, sf):
    fields = {"O1": "o_totalprice", "O2": "o_totalprice", "O3": "o_totalprice", "O4": "o_totalprice",
              "OA": "o_orderkey", "OB": "o_totalprice"}
    rules = local_rows(
        spark,
        [(i, fields.get(i, "k"), op, v) for i, op, v in OPS],
        "rule_id, condition_field, condition_operator, condition_value",
    )
    tx = table(spark, sf, "orders").withColumn("k", F.nullif(F.col("o_custkey") % 10, F.lit(3)))
    return evaluate.violations(tx, rules, ["o_orderkey"])


@query(
    "p22_rules_not_evaluated",
    f"""WITH {BOOK_SQL} SELECT rule_id, CASE WHEN e THEN n ELSE 0 END AS rows_evaluated, CASE WHEN e THEN 0 ELSE n END AS rows_not_evaluated
        FROM (SELECT rule_id, field IN (SELECT column_name FROM (DESCRIBE SELECT o_totalprice AS amount,
          o_totalprice AS monthly_cash_total, o_orderpriority AS priority, 0 AS balance, '' AS segment, 0 AS record_age_years
          FROM orders)) AS e FROM book), (SELECT count(*) AS n FROM orders)""",
)
def _(spark, sf):
    tx = transactions(spark, sf)
    told = evaluate.evaluated_rules(book(spark), tx.columns)
    n, none = tx.agg(F.count("*").alias("n")).scalar(), F.lit(0).cast("long")
    return told.select(
        "rule_id",
        F.when(F.col("evaluated"), n).otherwise(none).alias("rows_evaluated"),
        F.when(F.col("evaluated"), none).otherwise(n).alias("rows_not_evaluated"),
    )


@query(
    "p23_violation_message",
    f"""WITH {BROKEN} SELECT b.transaction_id, b.rule_id, title AS rule, severity,
          b.transaction_id || ': ' || CAST(CAST(amount AS DECIMAL(18, 2)) AS VARCHAR) || ' by customer ' || customer_id || ' on ' || transaction_date || ' (' || coalesce(val, '') || ')' AS detail
        FROM broken b JOIN tx USING (transaction_id) JOIN book USING (rule_id)""",
)
def _(spark, sf):
    tx = transactions(spark, sf)
    keep = ["transaction_id", "customer_id", "transaction_date", "amount"]
    rules = book(spark)
    got = evaluate.violations(tx, rules, keep)
    values = {c: F.col(c) for c in keep if c != "amount"}
    values["amount"] = F.col("amount").cast("decimal(18,2)")
    with_value = got.join(rules.select("rule_id", F.col("condition_value").alias("threshold_value")), "rule_id")
    found = evaluate.findings(with_value, rules, {**values, "threshold_value": F.col("threshold_value")})
    return found.select("transaction_id", "rule_id", "rule", "severity", "detail")


@query(
    "a12_violations_per_rule",
    f"""WITH {BROKEN} SELECT rule_id, title AS rule, count(*) AS violations
        FROM broken JOIN book USING (rule_id) GROUP BY ALL""",
)
def _(spark, sf):
    rules = book(spark).select("rule_id", F.col("title").alias("rule"))
    return summary.violations_per_rule(broken(spark, sf).join(rules, "rule_id"))


@query(
    "a13_compliance_rate",
    f"""WITH {BROKEN}, v AS (SELECT count(DISTINCT transaction_id) AS v FROM broken)
        SELECT n AS total_rows, v AS violation_count, n - v AS compliant_count,
          round(100.0 * (n - v) / n, 2) AS compliance_rate FROM v, (SELECT count(*) AS n FROM tx)""",
)
def _(spark, sf):
    return summary.compliance_summary(evaluate.flagged(transactions(spark, sf), book(spark)))


@query(
    "a13_compliance_rate_of_repeated_rows",
    f"""WITH {BROKEN}, v AS (SELECT 3 * count(DISTINCT transaction_id) AS v FROM broken)
        SELECT 3 * n AS total_rows, v AS violation_count, 3 * n - v AS compliant_count,
          round(100.0 * (3 * n - v) / (3 * n), 2) AS compliance_rate FROM v, (SELECT count(*) AS n FROM tx)""",
)
def _(spark, sf):
    """Each transaction twice and once without its id, by the index of rules."""
    tx = transactions(spark, sf)
    rows = tx.unionAll(tx).unionAll(tx.withColumn("transaction_id", F.lit(None).cast("long")))
    return summary.compliance_summary(evaluate.flagged(rows, book(spark), compiled_rules=0))


EVENT_STATUS = """ev AS (SELECT event_id, user_id, value, CASE event_type WHEN 'error' THEN 'violation' WHEN 'click' THEN 'Needs_Review'
  WHEN 'view' THEN 'WARNING' WHEN 'signup' THEN 'COMPLIANT' END AS verdict,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'odd' WHEN 'click' THEN 'Critical' ELSE NULL END AS severity,
  CASE WHEN event_id % 3 = 0 THEN 'E' || event_id END AS id,
  CASE WHEN event_id % 4 = 0 THEN 'T' || event_id END AS tid FROM events)"""


def event_findings(spark, sf):
    e = table(spark, sf, "events")

    def pick(**values):
        out = F.lit(None).cast("string")
        for name, v in values.items():
            out = F.when(F.col("event_type") == name, v).otherwise(out)
        return out

    i = F.col("event_id")
    return e.select(
        "event_id",
        "user_id",
        pick(error="violation", click="Needs_Review", view="WARNING", signup="COMPLIANT").alias("verdict"),
        F.lit(None).cast("string").alias("status"),
        pick(error="high", view="odd", click="Critical").alias("severity"),
        F.when(i % 3 == 0, F.concat(F.lit("E"), i.cast("string"))).alias("id"),
        F.when(i % 4 == 0, F.concat(F.lit("T"), i.cast("string"))).alias("transactionId"),
        F.lit(None).cast("string").alias("rule"),
        F.when(i % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
    )


NORMAL_EVENTS = f"""{EVENT_STATUS}, norm AS (SELECT coalesce(id, 'VIO-' || (event_id + 1)) AS id,
    coalesce(tid, id, printf('TXN-%04d', event_id + 1)) AS "transactionId",
    CASE WHEN event_id % 5 <> 0 THEN value END AS amount, 'Compliance Rule' AS rule,
    CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END AS severity,
    CASE WHEN upper(coalesce(verdict, 'VIOLATION')) IN ('COMPLIANT', 'NEEDS_REVIEW') THEN upper(verdict) ELSE 'VIOLATION' END AS status
  FROM ev)"""


@query("p19_normal_violations", f"WITH {NORMAL_EVENTS} SELECT * FROM norm")
def _(spark, sf):
    return summary.normal_violations(event_findings(spark, sf), "event_id")


@query(
    "a14_verdict_distribution",
    f"""WITH {NORMAL_EVENTS} SELECT count(*) FILTER (status = 'VIOLATION') AS violation,
          count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) AS total,
          count(*) FILTER (status = 'COMPLIANT') AS compliant,
          round(100.0 * count(*) FILTER (status = 'COMPLIANT') / count(*), 2) AS compliance_pct FROM norm""",
)
def _(spark, sf):
    return summary.verdict_distribution(summary.normal_violations(event_findings(spark, sf), "event_id"))


@query(
    "a9_severity_histogram",
    """SELECT o_orderpriority, count(*) AS rules, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS percentage
       FROM orders GROUP BY 1""",
)
def _(spark, sf):
    return summary.histogram(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "a17_distinct_rule_ids",
    f"WITH {BROKEN} SELECT DISTINCT rule_id FROM broken",
)
def _(spark, sf):
    return broken(spark, sf).select("rule_id").distinct()


@query(
    "a19_monthly_totals",
    f"WITH {TX} SELECT ck AS o_custkey, month, monthly_cash_total, n AS cash_transaction_count FROM monthly",
)
def _(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    got = evaluate.monthly_totals(table(spark, sf, "orders"), "o_custkey", "o_orderdate", cents)
    return got.withColumn("monthly_cash_total", F.col("monthly_cash_total") / 100.0)


@query(
    "w11_days_since_flag",
    """SELECT event_id, date_diff('day', last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DATE, ts::DATE) AS days FROM events""",
)
def _(spark, sf):
    got = evaluate.days_since_flag(
        table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", "days"
    )
    return got.select("event_id", "days")


@query(
    "w11_record_age",
    f"""SELECT o_orderkey, date_diff('year', o_orderdate::DATE, DATE '{AS_OF}')
          - CASE WHEN strftime(o_orderdate, '%m-%d') > '{AS_OF[5:]}' THEN 1 ELSE 0 END AS years,
          date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS account_age_days FROM orders""",
)
def _(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        evaluate.record_age_years(d, AS_OF).alias("years"),
        evaluate.account_age_days(d, F.lit("1995-01-01")).alias("account_age_days"),
    )


@query(
    "j14_listed_names",
    """SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN
         (SELECT replace(lower(s_name), 'supplier', 'customer') FROM supplier WHERE s_acctbal < 3000)""",
)
def _(spark, sf):
    listed = table(spark, sf, "supplier").filter("s_acctbal < 3000")
    name = F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("  customer")))
    return evaluate.on_list(table(spark, sf, "customer"), F.col("c_name"), listed, name).select(
        "c_custkey", "c_name"
    )


KEYWORDS = {
    "first": (["qui ", "und "], "MEDIUM", 2.8, "first detail"),
    "second": (["the "], "HIGH", 1.9, "second detail"),
    "third": (["the ", "der "], "HIGH", 1.3, "third detail"),
    "fourth": (["zzzz never"], "CRITICAL", 0.8, "fourth detail"),
    "fifth": (["la "], "HIGH", 1.1, "fifth detail"),
}
MATRIX = f"""{RULES}, t AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS t FROM rules),
  g1 AS (SELECT 1 AS g, * FROM t WHERE contains(t, 'qui ') OR contains(t, 'und ') ORDER BY idx LIMIT 1),
  g2 AS (SELECT 2 AS g, * FROM t WHERE contains(t, 'the ') AND idx NOT IN (SELECT idx FROM g1) ORDER BY idx LIMIT 1),
  g3 AS (SELECT 3 AS g, * FROM t WHERE (contains(t, 'the ') OR contains(t, 'der '))
     AND idx NOT IN (SELECT idx FROM g1 UNION ALL SELECT idx FROM g2) ORDER BY idx LIMIT 1),
  g5 AS (SELECT 5 AS g, * FROM t WHERE contains(t, 'la ')
     AND idx NOT IN (SELECT idx FROM g1 UNION ALL SELECT idx FROM g2 UNION ALL SELECT idx FROM g3) ORDER BY idx LIMIT 1),
  matrix AS (SELECT row_number() OVER (ORDER BY g) - 1 AS place, rule_id, title, severity,
     CASE g WHEN 1 THEN 2.8 WHEN 2 THEN 1.9 WHEN 3 THEN 1.3 ELSE 1.1 END::DOUBLE AS percentage,
     CASE g WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE 'fifth' END || ' detail' AS detail
   FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g5))"""


def matrix(spark, sf):
    return audit.keyword_matrix(rules_of_documents(spark, sf), "idx", KEYWORDS)


@query("w10_keyword_matrix", f"WITH {MATRIX} SELECT * FROM matrix")
def _(spark, sf):
    return matrix(spark, sf)


@query(
    "w7_audit_sample",
    f"""WITH {MATRIX}, n AS (SELECT count(*) AS n FROM orders),
        q AS (SELECT *, sum(quota) OVER (ORDER BY place) AS hi FROM (
          SELECT *, greatest(1, CAST(floor(n * (percentage / 100)) AS BIGINT)) AS quota FROM matrix, n)),
        r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, rule_id, title, severity, detail FROM r JOIN q ON rn > hi - quota AND rn <= hi""",
)
def _(spark, sf):
    tx = table(spark, sf, "orders").select("o_orderkey")
    return audit.audit_sample(tx, matrix(spark, sf), "o_orderkey")


@query(
    "j3_rules_of_findings",
    f"""WITH {RULES} SELECT rule_id, title, severity FROM rules WHERE rule_id IN
          (SELECT 'R-' || o_custkey FROM orders WHERE o_totalprice >= 400000)""",
)
def _(spark, sf):
    found = (
        table(spark, sf, "orders")
        .filter("o_totalprice >= 400000")
        .select(F.concat(F.lit("R-"), F.col("o_custkey").cast("string")).alias("rule_id"))
    )
    return registry.rules_of(rules_of_documents(spark, sf), found).select("rule_id", "title", "severity")


@query(
    "j16_title_to_rule",
    """WITH m AS (SELECT o_orderpriority AS title, arg_min(o_custkey, o_orderkey) AS id FROM orders
         WHERE o_totalprice >= 490000 AND o_orderpriority <> '5-LOW' GROUP BY 1)
       SELECT o_orderkey, o_orderpriority AS title, coalesce('C' || id, 'SYS') AS rule_id
       FROM orders LEFT JOIN m ON title = o_orderpriority""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "title")
    m = o.filter("o_totalprice >= 490000 and title <> '5-LOW'").select(
        "title", "o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("rule_id")
    )
    got = registry.first_rule_of_title(o, m, "title", "rule_id", "o_orderkey")
    return got.select("o_orderkey", "title", "rule_id")


VIEW = """v AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
  WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'OTHER' END AS severity, 'TXN-' || o_orderkey AS txn,
  'Rule of ' || o_orderstatus AS rule FROM orders)"""


def view(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(p == "1-URGENT", "CRITICAL").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM")
        .when(p == "5-LOW", "LOW").otherwise("OTHER").alias("severity"),
        F.concat(F.lit("TXN-"), F.col("o_orderkey").cast("string")).alias("txn"),
        F.concat(F.lit("Rule of "), "o_orderstatus").alias("rule"),
    )


@query(
    "p18_result_search",
    f"WITH {VIEW} SELECT * FROM v WHERE contains(lower(txn), 'of f') OR contains(lower(rule), 'of f') OR contains(lower(txn), '12')",
)
def _(spark, sf):
    df = view(spark, sf)
    return summary.search(df, "OF F", ["txn", "rule"]).union(
        summary.search(df, "12", ["txn"]).filter(~F.contains(F.lower("rule"), F.lit("of f")))
    )


RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query(
    "t2_severity_order",
    f"""WITH {VIEW} SELECT o_orderkey, severity, row_number() OVER (ORDER BY {RANK} DESC, o_orderkey) AS place FROM v""",
)
def _(spark, sf):
    # The place in the sorted view, since a comparison cannot see the order itself.
    df = view(spark, sf).withColumn("rank", summary.severity_rank(F.col("severity")))
    block = (4 - F.col("rank")) * F.lit(1 << 40) + F.floor(F.col("o_orderkey") / 65536)
    placed = row_numbers(df, [], [F.desc("rank"), "o_orderkey"], block, "place")
    return placed.select("o_orderkey", "severity", "place")


@query("t2_severity_view", f"WITH {VIEW} SELECT o_orderkey, severity FROM v ORDER BY {RANK} DESC, o_orderkey")
def _(spark, sf):
    return summary.sorted_view(view(spark, sf).select("o_orderkey", "severity"), "severity", ["o_orderkey"])


@query(
    "t2_severity_page",
    f"""WITH {VIEW} SELECT o_orderkey, severity FROM v ORDER BY {RANK} DESC, o_orderkey LIMIT 15 OFFSET 735""",
)
def _(spark, sf):
    df = view(spark, sf).select("o_orderkey", "severity")
    rank = summary.severity_rank(F.col("severity"))
    block = (4 - rank) * F.lit(1 << 40) + F.floor(F.col("o_orderkey") / 1024)
    return summary.deep_page(df, [rank.desc(), "o_orderkey"], block, 50)


@query(
    "t4_first_findings",
    f"""WITH {NORMAL_EVENTS} SELECT id, status FROM norm WHERE status <> 'COMPLIANT' ORDER BY id LIMIT 5""",
)
def _(spark, sf):
    df = summary.normal_violations(event_findings(spark, sf), "event_id")
    return df.filter("status <> 'COMPLIANT'").orderBy("id").limit(5).select("id", "status")


@query(
    "u4_route_recombined",
    f"""WITH {VIEW} SELECT CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'verify' WHEN severity IN ('MEDIUM', 'LOW')
          THEN 'pass' ELSE 'skip' END AS route, count(*) AS rules FROM v GROUP BY 1""",
)
def _(spark, sf):
    from tallywarden.operators.rules import verify_route

    routed = view(spark, sf).withColumn("route", verify_route(F.col("severity")))
    return routed.groupBy("route").agg(F.count("*").alias("rules"))


@query(
    "evaluate_rules",
    f"""WITH {BROKEN} SELECT (SELECT count(*) FROM tx) AS total_rows, count(*) AS violations, count(DISTINCT transaction_id) AS violated_rows,
          (SELECT string_agg(rule_id, ',') FROM book WHERE rule_id = 'R8') AS not_evaluated FROM broken""",
)
def _(spark, sf):
    done = jobs.evaluate_rules(transactions(spark, sf), book(spark), ["transaction_id"], {})
    skipped = done.not_evaluated.agg(F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("r"))
    counts = done.per_rule.agg(F.sum("violations").alias("violations"))
    return done.totals.select(
        "total_rows",
        counts.scalar().alias("violations"),
        F.col("violation_count").alias("violated_rows"),
        skipped.scalar().alias("not_evaluated"),
    )
