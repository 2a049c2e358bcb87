"""Rule records: parsing of answers, validation, gate, verification, shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RULES, WS, query, rules_of_documents, table
from tallywarden.functions import answers, arrays
from tallywarden.operators import rules as rl
from tallywarden.operators import summary


def rules(spark, sf):
    return rules_of_documents(spark, sf)


@query(
    "p8_rule_errors",
    r"""WITH d AS (SELECT d.doc_id, text, CASE WHEN n_chars % 11 = 0 THEN '' ELSE split_part(text, '.', 1) END AS title,
          CASE n_chars % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'SEVERE' END AS severity,
          (n_chars % 130) / 100.0 AS conf FROM documents d)
        SELECT doc_id, concat_ws('; ', CASE WHEN title = '' THEN 'Missing required field: title' END,
          CASE WHEN text = '' THEN 'Missing required field: description' END,
          CASE WHEN severity IS NULL THEN 'Missing required field: severity' END,
          CASE WHEN severity IS NULL THEN 'Invalid severity: None' WHEN severity = 'SEVERE' THEN 'Invalid severity: SEVERE' END,
          CASE WHEN conf > 1 THEN 'Confidence score out of range: ' || CAST(conf AS DOUBLE) END,
          CASE WHEN length(text) < 20 THEN 'Description too short (' || length(text) || ' chars < 20)'
               WHEN length(text) > 5000 THEN 'Description too long (' || length(text) || ' chars > 5000)' END) AS errors FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    severity = F.get(F.array(*[F.lit(v) for v in [*rl.SEVERITIES, "SEVERE", None]]), (n % 6).cast("int"))
    title = F.when(n % 11 == 0, "").otherwise(F.substring_index("text", ".", 1))
    errors = rl.rule_errors(title, F.col("text"), severity, (n % 130) / 100.0)
    return d.select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query(
    "p9_approval_status",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN coalesce(confidence_score, 0.5) >= 0.85 AND NOT coalesce(needs_review, FALSE)
          THEN 'auto_approved' ELSE 'pending_review' END AS approval FROM rules""",
)
def _(spark, sf):
    return rules(spark, sf).select(
        "rule_id", rl.approval_status(F.col("confidence_score"), F.col("needs_review")).alias("approval")
    )


@query(
    "a11_approval_rate",
    f"""WITH {RULES}, a AS (SELECT count(*) FILTER (coalesce(confidence_score, 0.5) >= 0.85 AND NOT coalesce(needs_review, FALSE)) AS auto_approved,
          count(*) AS total FROM rules)
        SELECT total, auto_approved, total - auto_approved AS pending_review, round(100.0 * auto_approved / total, 1) AS auto_approve_rate FROM a""",
)
def _(spark, sf):
    status = rl.approval_status(F.col("confidence_score"), F.col("needs_review"))
    got = rules(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(status == "auto_approved").alias("auto_approved")
    )
    return got.withColumn("pending_review", F.col("total") - F.col("auto_approved")).withColumn(
        "auto_approve_rate", summary.share(F.col("auto_approved"), F.col("total"))
    )


@query(
    "p10_confidence_cut",
    f"WITH {RULES} SELECT rule_id FROM rules WHERE coalesce(confidence_score, 0) >= 0.70",
)
def _(spark, sf):
    return rules(spark, sf).filter(F.coalesce("confidence_score", F.lit(0.0)) >= 0.70).select("rule_id")


@query(
    "p11_verify_route",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'verify' WHEN severity IN ('MEDIUM', 'LOW') THEN 'pass' ELSE 'skip' END AS route,
          CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 0 WHEN severity IN ('MEDIUM', 'LOW') THEN 1 ELSE 2 END AS rank FROM rules""",
)
def _(spark, sf):
    route = rl.verify_route(F.col("severity"))
    return rules(spark, sf).select("rule_id", route.alias("route"), rl.route_rank(route).alias("rank"))


def answer_table(spark, sf):
    """Answers as a model writes them: fenced, bare, an array, or broken."""
    b = table(spark, sf, "documents")
    rule = F.struct(
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("description"),
        F.lit("HIGH").alias("severity"),
        F.col("source").alias("source_clause"),
        F.lit("validation").alias("rule_type"),
        F.col("doc_id").cast("int").alias("page_number"),
        ((F.col("n_chars") % 101) / 100.0).alias("confidence_score"),
    )
    second = F.struct(
        F.lit("Second").alias("title"), F.col("lang").alias("description"), F.lit("LOW").alias("severity"),
        F.lit("c").alias("source_clause"), F.lit("t").alias("rule_type"), F.lit(7).alias("page_number"),
        F.lit(0.9).cast("double").alias("confidence_score"),
    )
    listed = F.to_json(F.array(rule, second))
    wrapped = F.concat(F.lit('{"rules": '), listed, F.lit("}"))
    k = F.col("doc_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), wrapped, F.lit("\n```\nDone.")))
        .when(k == 1, F.concat(F.lit("  "), wrapped))
        .when(k == 2, F.concat(F.lit("```\n"), listed, F.lit("\n```")))
        .otherwise(F.concat(F.lit('{"rules": [{"title": "cut'), F.col("lang")))
    )
    return b.select("doc_id", answer.alias("answer"))


@query(
    "f10_rules_from_answers",
    """WITH d AS (SELECT *, (n_chars % 101) / 100.0 AS c FROM documents WHERE doc_id % 4 < 3)
       SELECT doc_id, 0 AS rule_pos, split_part(text, '.', 1) AS title, text AS description, 'HIGH' AS severity,
         source AS source_clause, 'validation' AS rule_type, doc_id AS page_number, CAST(c AS DOUBLE) AS confidence_score FROM d WHERE c >= 0.70
       UNION ALL SELECT doc_id, 1, 'Second', lang, 'LOW', 'c', 't', 7, 0.9 FROM d""",
)
def _(spark, sf):
    return answers.rules_from_answers(answer_table(spark, sf), "answer").drop("paragraph_number")


@query(
    "f10_usable_answers",
    "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 2 ELSE 0 END AS rules FROM documents",
)
def _(spark, sf):
    return answer_table(spark, sf).select(
        "doc_id", F.size(answers.parsed_rules(F.col("answer"))).alias("rules")
    )


CITED = f"""cited AS (SELECT r.rule_id, r.idx, r.severity, r.confidence_score, r.title, r.description, r.needs_review,
    CASE WHEN r.idx % 3 = 0 THEN r.idx + 100000000 ELSE r.idx END AS doc_id,
    CASE WHEN r.idx % 2 = 0 THEN replace(d.text, ' ', '  ') ELSE coalesce(b.text, 'no clause of any kind') END AS source_clause,
    CASE WHEN r.idx % 5 = 0 THEN 'limit 12,345.5' ELSE 'no figure' END AS figures
  FROM rules r JOIN documents d ON d.doc_id = r.idx LEFT JOIN benchmark b ON b.item_id = r.idx % 40),
  checked AS (SELECT c.*, d.text AS page_text,
    wanted <> '' AND contains(coalesce({{page}}, ''), wanted) AS found,
    len(list_filter(regexp_extract_all(figures, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: NOT list_contains(
      list_transform(regexp_extract_all(coalesce(d.text, ''), '\\d[\\d,]*(?:\\.\\d+)?'), lambda y: replace(y, ',', '')), replace(x, ',', '')))) = 0 AS agree
    FROM (SELECT *, {{clause}} AS wanted FROM cited) c LEFT JOIN documents d ON d.doc_id = c.doc_id)""".format(
    page=f"trim(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), {WS})",
    clause=f"trim(lower(regexp_replace(source_clause, '\\s+', ' ', 'g')), {WS})",
)


def cited(spark, sf):
    """Rules that cite a page: a true clause, a foreign clause or no such page."""
    r = rules(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("foreign"))
    i = F.col("idx")
    joined = r.drop("source_clause").join(d, "idx").join(b, F.col("item_id") == i % 40, "left")
    return joined.select(
        "rule_id", "idx", "severity", "confidence_score", "title", "description", "needs_review",
        F.when(i % 3 == 0, i + 100000000).otherwise(i).alias("doc_id"),
        F.when(i % 2 == 0, F.replace("text", F.lit(" "), F.lit("  ")))
        .otherwise(F.coalesce("foreign", F.lit("no clause of any kind"))).alias("source_clause"),
        F.when(i % 5 == 0, "limit 12,345.5").otherwise("no figure").alias("figures"),
    )


@query(
    "j1_page_of_rule",
    f"WITH {RULES}, {CITED} SELECT rule_id, doc_id, md5(page_text) AS page_md5 FROM checked",
)
def _(spark, sf):
    got = rl.with_page_text(cited(spark, sf), table(spark, sf, "documents"), ["doc_id"], "text")
    return got.select("rule_id", "doc_id", F.md5("page_text").alias("page_md5"))


@query(
    "j2_source_check",
    f"WITH {RULES}, {CITED} SELECT rule_id, found AS clause_found, agree AS numbers_agree FROM checked",
)
def _(spark, sf):
    got = rl.with_page_text(cited(spark, sf), table(spark, sf, "documents"), ["doc_id"], "text")
    check = rl.source_check(F.col("source_clause"), F.col("figures"), F.col("page_text"))
    return got.select("rule_id", check.alias("c")).select("rule_id", "c.clause_found", "c.numbers_agree")


VERIFIED = f"""{RULES}, {CITED}, told AS (SELECT *, CASE WHEN severity NOT IN ('CRITICAL', 'HIGH') THEN NULL
      WHEN coalesce(page_text, '') = '' THEN 'skipped_no_page' WHEN found AND agree THEN 'verified'
      WHEN found THEN 'correction_needed' ELSE 'source_not_found' END AS outcome FROM checked),
  done AS (SELECT rule_id, outcome, round(CASE outcome WHEN 'skipped_no_page' THEN least(coalesce(confidence_score, 0.9) - 0.15, 0.75)
      WHEN 'verified' THEN least(coalesce(confidence_score, 0.9) + 0.05, 1.0) WHEN 'correction_needed' THEN 0.5
      WHEN 'source_not_found' THEN 0.3 ELSE confidence_score END, 6) AS confidence_score,
    CASE WHEN outcome = 'verified' THEN FALSE WHEN outcome IN ('correction_needed', 'source_not_found') THEN TRUE ELSE needs_review END AS needs_review,
    NOT coalesce(outcome = 'source_not_found', FALSE) AS is_active FROM told)"""


def verified(spark, sf):
    got = rl.with_page_text(cited(spark, sf), table(spark, sf, "documents"), ["doc_id"], "text")
    check = rl.source_check(F.col("source_clause"), F.col("figures"), F.col("page_text"))
    outcome = F.when(
        rl.verify_route(F.col("severity")) == "verify",
        rl.verification_outcome(F.col("page_text"), F.col("c")),
    )
    told = got.withColumn("c", check).withColumn("outcome", outcome)
    done = rl.apply_outcome(told, "outcome")
    return done.select(
        "rule_id", "outcome", F.round("confidence_score", 6).alias("confidence_score"),
        "needs_review", "is_active",
    )


@query("p28_verification_outcome", f"WITH {VERIFIED} SELECT * FROM done")
def _(spark, sf):
    return verified(spark, sf)


@query(
    "a10_verification_stats",
    f"""WITH {VERIFIED} SELECT coalesce(outcome, 'unknown') AS status, count(*) AS rules, count(*) FILTER (needs_review) AS needs_review,
          round(avg(coalesce(confidence_score, 0.5)), 4) AS avg_confidence FROM done GROUP BY 1""",
)
def _(spark, sf):
    return summary.verification_stats(verified(spark, sf), "outcome")


@query(
    "p7_registry_row",
    f"""WITH {RULES} SELECT rule_id, title, severity, try_cast(page_number AS INTEGER) AS page_number, status,
          CASE WHEN idx % 3 = 0 THEN 'A|' || lang ELSE '' END AS tags, CASE WHEN idx % 4 = 0 THEN 1 ELSE 0 END AS chain_length FROM rules""",
)
def _(spark, sf):
    raw = rules(spark, sf).select(
        "rule_id", "title", "severity", "page_number", "status",
        F.when(F.col("idx") % 3 == 0, F.concat(F.lit('["A", "'), "lang", F.lit('"]'))).otherwise("not json").alias("metadata_tags"),
        F.when(F.col("idx") % 4 == 0, F.lit('[{"document": "d", "type": "circular", "action": "introduced"}]')).alias("provenance_chain"),
        F.lit("dropped").alias("no_such_column"),
    )
    row = rl.registry_row(raw)
    return row.withColumns(
        {"tags": F.array_join("metadata_tags", "|"), "chain_length": F.size("provenance_chain")}
    ).drop("metadata_tags", "provenance_chain")


@query(
    "p20_display_shape",
    f"""WITH {RULES} SELECT rule_id AS id, coalesce(rule_type, nullif(category, ''), 'compliance') AS field, 'must comply' AS operator,
          coalesce(CASE WHEN idx % 2 = 0 THEN nullif(source_clause, '') END, substr(description, 1, 80)) AS threshold, severity, page_number AS page FROM rules""",
)
def _(spark, sf):
    r = rules(spark, sf).withColumn("source_clause", F.when(F.col("idx") % 2 == 0, F.col("source_clause")))
    return rl.display_shape(r)


CHAIN = """CASE WHEN idx % 3 = 0 THEN 'master-' || lang WHEN idx % 3 = 1 THEN NULL ELSE NULL END"""


@query(
    "p24_provenance_text",
    f"""WITH {RULES}, b AS (SELECT *, coalesce({CHAIN}, source_document_name) AS base, coalesce(last_modified_by, source_document_name) AS who FROM rules)
        SELECT rule_id, CASE status WHEN 'EXISTING' THEN 'Originally introduced in: ' || base || chr(10) || 'Referenced (unchanged) by: ' || source_document_name
          WHEN 'MODIFIED' THEN 'Originally introduced in: ' || base || chr(10) || 'Modified by: ' || who || chr(10) || 'Change: ' || modification_summary
          WHEN 'NEW' THEN 'Introduced by: ' || source_document_name || chr(10) || 'Not present in Master Direction'
          WHEN 'SUPERSEDED' THEN 'Originally introduced in: ' || base || chr(10) || 'Superseded by: ' || who
          ELSE 'Clarification of rule from: ' || base || chr(10) || 'Clarified by: ' || source_document_name END AS told FROM b""",
)
def _(spark, sf):
    entry = lambda d, k: arrays.provenance_entry(d, F.lit(k), F.lit(None), F.lit("introduced"))
    first = entry(F.col("source_document_name"), "circular")
    master = entry(F.concat(F.lit("master-"), "lang"), "master_direction")
    chain = F.when(F.col("idx") % 3 == 0, F.array(first, master)).when(F.col("idx") % 3 == 1, F.array(first))
    told = rl.provenance_text(
        F.col("status"), F.col("source_document_name"), F.col("last_modified_by"),
        F.col("modification_summary"), chain,
    )
    return rules(spark, sf).select("rule_id", told.alias("told"))


@query(
    "p25_lean_rules",
    f"""WITH {RULES} SELECT rule_id, substr(title, 1, 20) AS title, length(substr(description, 1, 120)) AS description_chars,
          substr(source_clause, 1, 100) AS clause, page_number, severity FROM rules""",
)
def _(spark, sf):
    lean = rl.lean_json(rules(spark, sf))
    get = lambda name: F.get_json_object("lean", f"$.{name}")
    return lean.select(
        "rule_id", F.substring(get("title"), 1, 20).alias("title"),
        F.length(get("description")).alias("description_chars"), get("source_clause").alias("clause"),
        get("page_number").alias("page_number"), get("severity").alias("severity"),
    )


@query(
    "p27_embedding_text",
    f"""WITH {RULES} SELECT rule_id, md5('Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Source: ' || source_clause) AS stored_md5,
          md5(title || ' ' || description || ' ' || source_clause) AS query_md5 FROM rules""",
)
def _(spark, sf):
    return rules(spark, sf).select(
        "rule_id", F.md5(rl.embedding_text()).alias("stored_md5"), F.md5(rl.query_text()).alias("query_md5")
    )


@query(
    "p29_provenance_stamp",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN idx % 2 = 0 THEN status ELSE 'NEW' END AS status, 'file-' || lang AS source_document_name,
          'circular' AS source_document_type, '2024-01-01' AS source_document_date, 'file-' || lang || '/circular/2024-01-01/introduced' AS entry FROM rules""",
)
def _(spark, sf):
    r = rules(spark, sf).withColumn("status", F.when(F.col("idx") % 2 == 0, F.col("status")))
    got = rl.stamp_provenance(
        r, F.concat(F.lit("file-"), "lang"), F.lit("circular"), F.lit("2024-01-01")
    )
    e = F.col("provenance_chain")[0]
    return got.select(
        "rule_id", "status", "source_document_name", "source_document_type", "source_document_date",
        F.concat_ws("/", e["document"], e["type"], e["date"], e["action"]).alias("entry"),
    )


@query(
    "p29_provenance_defaults",
    f"""WITH {RULES} SELECT rule_id, CASE WHEN idx % 2 = 0 THEN source_document_name ELSE 'late.pdf' END AS source_document_name,
          source_document_type FROM rules""",
)
def _(spark, sf):
    r = rules(spark, sf).withColumn(
        "source_document_name", F.when(F.col("idx") % 2 == 0, F.col("source_document_name"))
    )
    got = rl.stamp_provenance(r, F.lit("late.pdf"), F.lit("gazette"), F.lit("2024-01-01"), only_missing=True)
    return got.select("rule_id", "source_document_name", "source_document_type")


@query(
    "p30_insertable_rules",
    f"""WITH {RULES} SELECT CASE WHEN idx % 2 = 0 THEN rule_id ELSE
          substr(sha256(title || chr(31) || description || chr(31) || source_clause), 1, 32) END AS rule_id, idx FROM rules WHERE status <> 'EXISTING'""",
)
def _(spark, sf):
    r = rules(spark, sf).withColumn("rule_id", F.when(F.col("idx") % 2 == 0, F.col("rule_id")))
    return rl.insertable_rules(r).select("rule_id", "idx")


@query(
    "f15_array_append",
    f"""WITH {RULES} SELECT rule_id, 2 + CASE WHEN idx % 2 = 0 THEN 1 ELSE 0 END AS entries, 'circular' AS first_type, 'last-' || lang AS last_document FROM rules""",
)
def _(spark, sf):
    e = lambda d, k: arrays.provenance_entry(d, F.lit(k), F.lit(None), F.lit("x"))
    chain = F.when(F.col("idx") % 2 == 0, F.array(e(F.lit("zero"), "gazette")))
    chain = arrays.append_entry(chain, e(F.lit("one"), "circular"))
    chain = arrays.append_entry(chain, e(F.concat(F.lit("last-"), "lang"), "circular"))
    return rules(spark, sf).select(
        "rule_id", F.size(chain).alias("entries"),
        arrays.first_match(chain, lambda x: x["type"] == "circular")["type"].alias("first_type"),
        F.element_at(chain, -1)["document"].alias("last_document"),
    )


@query(
    "f16_json_lists",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '["' || event_type || '","' || user_id || '"]' AS encoded,
         2 AS decoded_size, 0 AS broken_size FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    encoded = arrays.encode_list(F.array("event_type", F.col("user_id").cast("string")))
    return e.select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), encoded.alias("encoded"),
        F.size(arrays.decode_list(encoded, "array<string>")).alias("decoded_size"),
        F.size(arrays.decode_list(F.col("event_type"), "array<string>")).alias("broken_size"),
    )
