"""Registry reads, lookups, upserts, judgements and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RULES, query, rules_of_documents, table
from tallywarden.operators import registry as rg
from tallywarden.operators import summary
from tallywarden.plans import jobs
from tallywarden.session import scratch_path
from tallywarden.sources.tables import read_rule_files, store, upsert_partitions, write_rule_files


def rules(spark, sf):
    return rules_of_documents(spark, sf)


@query(
    "s5_registry_scan",
    f"""WITH {RULES} SELECT rule_id, title, severity, status, confidence_score, 2 AS tags FROM rules""",
)
def _(spark, sf):
    path = scratch_path(spark, "registry")
    stored = rg.VersionedTable(spark, path)
    base = rules(spark, sf).select(
        "rule_id", "title", "severity", "status", "confidence_score",
        F.to_json(F.array("lang", "severity")).alias("metadata_tags"),
    )
    stored.write(base.limit(0))
    stored.write(base)
    got = stored.read()
    return got.withColumn("tags", F.size(F.from_json("metadata_tags", "array<string>"))).drop("metadata_tags")


RULE_FILE = "rule_id string, title string, severity string, idx long"


@query("s6_rule_files", f"WITH {RULES} SELECT rule_id, title, severity, idx FROM rules")
def _(spark, sf):
    path = scratch_path(spark, "rule-files")
    r = rules(spark, sf)
    write_rule_files(r.select("rule_id", "title", "severity", "idx"), path)
    # Cut off lines, one per rule of a language, must not add rows.
    cut = r.filter("lang = 'de'").select(F.concat(F.lit('{"rule_id": "'), "rule_id").alias("value"))
    cut.write.mode("append").text(path)
    return read_rule_files(spark, path, RULE_FILE, lines=True)


@query(
    "s7_rule_file_sink",
    f"""WITH {RULES} SELECT severity, count(*) AS rules, min(rule_id) AS first_rule FROM rules GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "rule-files")
    write_rule_files(rules(spark, sf).select("rule_id", "severity"), path)
    got = spark.read.text(path).select(F.from_json("value", "rule_id string, severity string").alias("r"))
    return got.groupBy("r.severity").agg(F.count("*").alias("rules"), F.min("r.rule_id").alias("first_rule"))


@query(
    "s10_verdict_store",
    """SELECT 'X' || (o_orderkey % 3) AS rule_id, count(*) AS violations FROM orders WHERE o_totalprice >= 300000 GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "verdicts")
    o = table(spark, sf, "orders")
    rule = F.concat(F.lit("X"), (F.col("o_orderkey") % 3).cast("string"))
    for status, dates in (("F", "2024-01-01"), ("O", "2024-01-02"), ("P", "2024-01-02")):
        part = o.filter(F.col("o_orderstatus") == status).select(
            rule.alias("rule_id"), F.col("o_orderkey").alias("transaction_id"),
            F.when(F.col("o_totalprice") >= 300000, "VIOLATION").otherwise("COMPLIANT").alias("verdict"),
            F.lit(dates).alias("run_date"),
        )
        store(part, path, "append", ["run_date"])
    bad = rg.where_equal(spark.read.parquet(path), verdict="VIOLATION")
    return bad.groupBy("rule_id").agg(F.count("*").alias("violations"))


@query(
    "s9_chunks_by_document",
    """WITH c AS (SELECT source, doc_id, n_chars FROM documents WHERE NOT source LIKE '%1'
         UNION ALL SELECT source, doc_id, n_chars + 1 FROM documents WHERE source LIKE '%1' AND doc_id % 3 = 0)
       SELECT source, count(*) AS chunks, sum(n_chars)::BIGINT AS chars FROM c GROUP BY 1""",
)
def _(spark, sf):
    """A store of chunks; some sources come again with other chunks."""
    path = scratch_path(spark, "chunk-store")
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    upsert_partitions(d, path, ["source"])
    again = d.filter("source LIKE '%1' AND doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    upsert_partitions(again, path, ["source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))


@query(
    "s10_explanations",
    """SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS run_date, 'X' || (o_orderkey % 3) AS rule_id, o_orderkey AS transaction_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'VIOLATION' ELSE 'NEEDS_REVIEW' END AS verdict,
         'order ' || o_orderkey || ' of ' || o_totalprice::DECIMAL(15,2) AS explanation
       FROM orders WHERE o_totalprice >= 300000""",
)
def _(spark, sf):
    """Verdicts and their explanations by run date; every third run is replayed."""
    base = scratch_path(spark, "verdict-store")
    o = table(spark, sf, "orders").filter("o_totalprice >= 300000")
    found = o.select(
        F.concat(F.lit("X"), (F.col("o_orderkey") % 3).cast("string")).alias("rule_id"),
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "VIOLATION").otherwise("NEEDS_REVIEW").alias("verdict"),
        F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_totalprice").cast("decimal(15,2)")).alias("explanation"),
        F.to_date(F.trunc("o_orderdate", "year")).alias("run_date"),
    )
    third = found.filter(F.year("run_date") % 3 == 0)
    for run in (found.withColumn("verdict", F.when(F.year("run_date") % 3 == 0, "first run").otherwise(F.col("verdict"))), third):
        run = run.repartition("run_date")  # a file per run date
        upsert_partitions(run.drop("explanation"), f"{base}/verdicts", ["run_date"])
        upsert_partitions(run.drop("verdict"), f"{base}/explanations", ["run_date"])
    told = spark.read.parquet(f"{base}/explanations")
    return spark.read.parquet(f"{base}/verdicts").join(told, ["run_date", "rule_id", "transaction_id"])


@query(
    "job_registry_upsert",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN idx % 4 = 0 THEN 'changed' ELSE title END AS title, severity,
          CASE WHEN idx % 4 = 0 THEN TRY_CAST(page_number AS BIGINT) END AS page_number FROM rules
        UNION ALL SELECT 'N-' || idx, title, severity, TRY_CAST(page_number AS BIGINT) FROM rules WHERE idx % 9 = 0""",
)
def _(spark, sf):
    r = rules(spark, sf)
    changed = r.filter("idx % 4 = 0").withColumn("title", F.lit("changed"))
    fresh = r.filter("idx % 9 = 0").withColumn("rule_id", F.concat(F.lit("N-"), F.col("idx").cast("string")))
    new = changed.unionAll(fresh).select("rule_id", "title", "page_number", "severity", F.lit("x").alias("not_kept"))
    return jobs.registry_upsert(r.select("rule_id", "title", "severity"), new, F.lit(1)).select("rule_id", "title", "severity", F.col("page_number").cast("long").alias("page_number"))


@query(
    "p16_registry_filters",
    f"""WITH {RULES} SELECT 'status' AS f, rule_id FROM rules WHERE status = 'MODIFIED'
        UNION ALL SELECT 'category', rule_id FROM rules WHERE category = 'SRC1'
        UNION ALL SELECT 'document', rule_id FROM rules WHERE source_document_name = 'src2.pdf'
        UNION ALL SELECT 'type', rule_id FROM rules WHERE source_document_type = 'master_direction'
        UNION ALL SELECT 'review', rule_id FROM rules WHERE needs_review
        UNION ALL SELECT 'id', rule_id FROM rules WHERE rule_id = 'R-17'""",
)
def _(spark, sf):
    r = rules(spark, sf)
    wanted = {
        "status": {"status": "MODIFIED"}, "category": {"category": "SRC1"},
        "document": {"source_document_name": "src2.pdf"},
        "type": {"source_document_type": "master_direction"}, "review": {"needs_review": True},
        "id": {"rule_id": "R-17"},
    }
    out = None
    for name, test in wanted.items():
        one = rg.where_equal(r, **test).select(F.lit(name).alias("f"), "rule_id")
        out = one if out is None else out.unionAll(one)
    return out


def hashed(spark, sf):
    return table(spark, sf, "documents").withColumn("hash", F.substring(F.sha2("text", 256), 1, 16))


@query(
    "j4_memo_hits",
    """WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents),
         memo AS (SELECT hash, arg_min(quality, h.doc_id) AS stored_quality, min(h.doc_id) AS stored_doc FROM h JOIN labels USING (doc_id) GROUP BY 1)
       SELECT doc_id, stored_doc, stored_quality FROM h JOIN memo USING (hash)""",
)
def _(spark, sf):
    h = hashed(spark, sf)
    memo = h.join(table(spark, sf, "labels"), "doc_id").select(
        "hash", F.col("doc_id").alias("stored_doc"), F.col("quality").alias("stored_quality")
    )
    names = ["stored_doc", "stored_quality"]
    return rg.memo_lookup(h, memo, "hash", names).select("doc_id", *names)


@query(
    "j4_memo_misses",
    """WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents)
       SELECT doc_id FROM h WHERE hash NOT IN (SELECT hash FROM h JOIN labels USING (doc_id))""",
)
def _(spark, sf):
    h = hashed(spark, sf)
    memo = h.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return rg.split_known(h, memo, "hash")[1].select("doc_id")


HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "j5_known_documents",
    f"""WITH p AS (SELECT page_id, {HOST} AS host, url FROM pages), k AS (SELECT DISTINCT host FROM p WHERE url LIKE '%.html%')
        SELECT page_id, host IN (SELECT host FROM k) AS known FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    known, fresh = rg.split_known(p, p.filter(F.contains("url", F.lit(".html"))), "host")
    return known.select("page_id", F.lit(True).alias("known")).unionAll(
        fresh.select("page_id", F.lit(False).alias("known"))
    )


@query(
    "j10_upsert",
    """WITH n AS (SELECT o_orderkey AS k, 'X' AS s, o_custkey AS note FROM orders WHERE o_totalprice >= 400000
         UNION ALL SELECT -o_orderkey - 1, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' END, o_custkey FROM orders WHERE o_orderstatus = 'F')
       SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NOT NULL THEN s ELSE o_orderstatus END AS o_orderstatus,
         o_totalprice, note FROM orders FULL JOIN n ON o_orderkey = k""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    changed = o.filter("o_totalprice >= 400000").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), F.col("o_custkey").alias("note")
    )
    fresh = o.filter("o_orderstatus = 'F'").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 2 == 0, "Y").alias("o_orderstatus"),
        F.col("o_custkey").alias("note"),
    )
    # An earlier version of each changed row is in the same batch and loses.
    stale = changed.withColumn("o_orderstatus", F.lit("stale"))
    new = changed.unionAll(fresh).withColumn("at", F.lit(2)).unionAll(stale.withColumn("at", F.lit(1)))
    without = changed.withColumn("o_orderkey", F.lit(None).cast("long")).withColumn("at", F.lit(3))
    return rg.upsert(o.drop("o_custkey"), new.unionAll(without), "o_orderkey", F.col("at")).drop("at")


@query(
    "j10_upsert_unordered",
    """SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NOT NULL THEN s ELSE o_orderstatus END AS o_orderstatus
       FROM orders FULL JOIN (SELECT o_orderkey AS k, 'X' AS s FROM orders WHERE o_totalprice >= 400000
         UNION ALL SELECT -o_orderkey - 1, 'Y' FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = k""",
)
def _(spark, sf):
    """New rows without a date: alone they count, beside a dated one they lose."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    dated = o.filter("o_totalprice >= 400000").withColumn("o_orderstatus", F.lit("X"))
    undated = dated.withColumns({"o_orderstatus": F.lit("stale"), "o_orderdate": F.lit(None).cast(o.schema["o_orderdate"].dataType)})
    alone = o.filter("o_orderstatus = 'F'").withColumns(
        {"o_orderkey": -F.col("o_orderkey") - 1, "o_orderstatus": F.lit("Y"), "o_orderdate": F.lit(None).cast(o.schema["o_orderdate"].dataType)}
    )
    new = dated.unionAll(undated).unionAll(alone).select("o_orderkey", "o_orderstatus", "o_orderdate")
    return rg.upsert(o.select("o_orderkey", "o_orderstatus"), new, "o_orderkey", F.col("o_orderdate")).drop("o_orderdate")


@query(
    "j11_order_gate",
    f"""WITH {RULES} SELECT rule_id, EXISTS (SELECT 1 FROM rules WHERE source_document_type = 'master_direction') AS admitted,
          coalesce(CASE WHEN idx % 6 > 0 THEN source_document_type END = 'master_direction', false) AS admitted_first FROM rules""",
)
def _(spark, sf):
    kind = F.when(F.col("idx") % 6 > 0, F.col("source_document_type")).alias("source_document_type")
    r = rules(spark, sf).select("rule_id", kind)
    without_base = r.filter("source_document_type <> 'master_direction'")
    first = rg.order_gate(r, without_base).select("rule_id", F.col("admitted").alias("admitted_first"))
    return rg.order_gate(r, r).select("rule_id", "admitted").join(first, "rule_id")


JUDGED = f"""{RULES}, judged AS (SELECT 'N-' || idx AS new_id, CASE WHEN idx % 9 = 0 THEN NULL ELSE 'R-' || (idx % 50) END AS matched_rule_id,
    CASE WHEN idx % 11 = 0 THEN 'odd' ELSE status END AS status, 'summary ' || n_chars AS modification_summary,
    CASE WHEN idx % 4 > 0 THEN 'referenced' END AS provenance_action, source_document_name, source_document_type, source_document_date FROM rules)"""


def judgements(spark, sf):
    i = F.col("idx")
    return rules(spark, sf).select(
        F.concat(F.lit("N-"), i.cast("string")).alias("new_id"),
        F.when(i % 9 != 0, F.concat(F.lit("R-"), (i % 50).cast("string"))).alias("matched_rule_id"),
        F.when(i % 11 == 0, "odd").otherwise(F.col("status")).alias("status"),
        F.concat(F.lit("summary "), F.col("n_chars").cast("string")).alias("modification_summary"),
        F.when(i % 4 > 0, "referenced").alias("provenance_action"),
        "source_document_name", "source_document_type", "source_document_date",
    )


@query(
    "j12_registry_after",
    f"""WITH {JUDGED}, t AS (SELECT matched_rule_id AS rule_id, count(*) AS n,
          arg_max(status, (source_document_date, new_id)) FILTER (status IN ('MODIFIED', 'SUPERSEDED')) AS last_status,
          arg_max(source_document_name, (source_document_date, new_id)) FILTER (status = 'MODIFIED') AS by_doc,
          arg_max(modification_summary, (source_document_date, new_id)) FILTER (status = 'MODIFIED') AS summary
        FROM judged WHERE matched_rule_id IS NOT NULL AND status IN ('EXISTING', 'MODIFIED', 'SUPERSEDED', 'CLARIFICATION') GROUP BY 1)
        SELECT r.rule_id, coalesce(last_status, status) AS status, coalesce(by_doc, last_modified_by) AS last_modified_by,
          coalesce(summary, modification_summary) AS modification_summary, reference_count + coalesce(n, 0) AS reference_count
        FROM rules r LEFT JOIN t ON r.rule_id = t.rule_id""",
)
def _(spark, sf):
    got = rg.apply_judgements(rules(spark, sf), judgements(spark, sf), "new_id")
    return got.select("rule_id", "status", "last_modified_by", "modification_summary", "reference_count")


@query(
    "j12_judged_rules",
    f"""WITH {JUDGED} SELECT new_id, s AS status, CASE WHEN s = 'MODIFIED' THEN modification_summary END AS modification_summary,
          CASE WHEN s = 'SUPERSEDED' THEN matched_rule_id END AS supersedes_rule_id, CASE WHEN s = 'CLARIFICATION' THEN matched_rule_id END AS parent_rule_id,
          CASE WHEN s = 'NEW' THEN 'introduced' ELSE coalesce(provenance_action, 'referenced') END AS provenance_action
        FROM (SELECT *, CASE WHEN status = 'odd' THEN 'NEW' ELSE status END AS s FROM judged)""",
)
def _(spark, sf):
    j = judgements(spark, sf)
    new = j.select("new_id", "source_document_name")
    got = rg.judged_rules(new, j, "new_id")
    return got.select(
        "new_id", "status", "modification_summary", "supersedes_rule_id", "parent_rule_id", "provenance_action"
    )


@query(
    "j12_provenance_rows",
    f"""WITH {JUDGED} SELECT matched_rule_id AS rule_id, source_document_date AS date, new_id AS from_rule, source_document_name AS document,
          source_document_type AS type, CASE status WHEN 'SUPERSEDED' THEN 'superseded' WHEN 'CLARIFICATION' THEN 'clarified'
            ELSE coalesce(provenance_action, 'referenced') END AS action
        FROM judged WHERE matched_rule_id IS NOT NULL AND status IN ('EXISTING', 'MODIFIED', 'SUPERSEDED', 'CLARIFICATION')""",
)
def _(spark, sf):
    return rg.provenance_additions(judgements(spark, sf), "new_id")


@query(
    "j12_history_rows",
    f"""WITH {JUDGED}, t AS (SELECT *, row_number() OVER w AS n,
          last_value(CASE WHEN status IN ('MODIFIED', 'SUPERSEDED') THEN status END IGNORE NULLS) OVER b AS was_status,
          last_value(CASE WHEN status = 'MODIFIED' THEN source_document_name END IGNORE NULLS) OVER b AS was_by,
          last_value(CASE WHEN status = 'MODIFIED' THEN modification_summary END IGNORE NULLS) OVER b AS was_summary
        FROM judged WHERE matched_rule_id IS NOT NULL AND status IN ('EXISTING', 'MODIFIED', 'SUPERSEDED', 'CLARIFICATION')
        WINDOW w AS (PARTITION BY matched_rule_id ORDER BY source_document_date, new_id),
          b AS (PARTITION BY matched_rule_id ORDER BY source_document_date, new_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT r.rule_id, new_id AS replaced_by, r.title AS old_title, coalesce(was_status, r.status) AS old_status,
          coalesce(was_by, r.last_modified_by) AS old_by, coalesce(was_summary, r.modification_summary) AS old_summary,
          CAST(r.reference_count + t.n - 1 AS INTEGER) AS old_references
        FROM t JOIN rules r ON r.rule_id = matched_rule_id WHERE t.status = 'MODIFIED'""",
)
def _(spark, sf):
    got = rg.history_additions(rules(spark, sf), judgements(spark, sf), "new_id")
    names = {"title": "title", "status": "status", "by": "last_modified_by", "summary": "modification_summary"}
    old = [F.get_json_object("old_rule", f"$.{c}").alias(f"old_{n}") for n, c in names.items()]
    count = F.get_json_object("old_rule", "$.reference_count").cast("int").alias("old_references")
    return got.select("rule_id", "replaced_by", *old, count)


@query(
    "j15_positional_statuses",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN idx % 20 < 15 AND idx % 3 > 0 THEN status ELSE 'NEW' END AS status,
          CASE WHEN idx % 20 < 15 THEN 'note ' || lang ELSE 'Could not map enriched data; defaulting to NEW.' END AS provenance_note FROM rules""",
)
def _(spark, sf):
    r = rules(spark, sf).withColumns(
        {"batch": F.floor(F.col("idx") / 20), "place": (F.col("idx") % 20).cast("int")}
    )
    item = F.struct(
        "place",
        F.when(F.col("idx") % 3 > 0, F.col("status")).alias("status"),
        F.concat(F.lit("note "), "lang").alias("provenance_note"),
    )
    answers = r.filter("place < 15").groupBy("batch").agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("answer")
    )
    got = rg.positional_statuses(r.select("rule_id", "batch", "place"), answers, "batch", "place", "answer")
    return got.select("rule_id", "status", "provenance_note")


@query("a7_rules_by_status", f"WITH {RULES} SELECT status, count(*) AS rules FROM rules GROUP BY 1")
def _(spark, sf):
    return rg.status_counts(rules(spark, sf))


@query(
    "a8_document_counts",
    f"""WITH {RULES}, s AS (SELECT source_document_name AS filename, CASE WHEN idx % 13 = 0 THEN 'odd' ELSE status END AS status FROM rules)
        SELECT filename, count(*) FILTER (status IN ('NEW', 'odd')) AS new_rules, count(*) FILTER (status = 'EXISTING') AS existing_rules,
          count(*) FILTER (status = 'MODIFIED') AS modified_rules, count(*) FILTER (status = 'SUPERSEDED') AS superseded_rules,
          count(*) FILTER (status = 'CLARIFICATION') AS clarification_rules, count(*) AS total_rules FROM s GROUP BY 1""",
)
def _(spark, sf):
    r = rules(spark, sf).select(
        F.col("source_document_name").alias("filename"),
        F.when(F.col("idx") % 13 == 0, "odd").otherwise(F.col("status")).alias("status"),
    )
    return rg.document_status_counts(r, "filename")


@query(
    "a15_memo_statistics",
    """SELECT count(DISTINCT substr(sha256(text), 1, 16)) AS cached_documents, sum(n_chars % 7)::BIGINT AS total_rules,
         sum(strlen(text))::BIGINT AS cache_bytes FROM documents""",
)
def _(spark, sf):
    return summary.memo_stats(hashed(spark, sf), "hash", F.col("n_chars") % 7, F.col("text"))


@query(
    "a8_counts_upserted",
    f"""WITH {RULES} SELECT source_document_name AS filename, count(*) AS total_rules FROM rules GROUP BY 1""",
)
def _(spark, sf):
    # The record of a document replaces its earlier record: the key is the name.
    r = rules(spark, sf).withColumnRenamed("source_document_name", "filename")
    before = rg.document_status_counts(r.filter("lang = 'en'"), "filename")
    after = rg.document_status_counts(r, "filename")
    return rg.upsert(before, after, "filename", F.col("total_rules")).select("filename", "total_rules")
