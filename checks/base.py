"""Registration of the queries with their SQL twins, and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.functions.text import WHITESPACE
from tallywarden.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The strip set as an SQL expression.
WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", spread=name in ("documents", "pages"))


def rules_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One rule record per document: the registry at the scale of the data."""
    d = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    i, n = F.col("doc_id"), F.col("n_chars")

    def pick(c, values):
        return F.get(F.array(*[F.lit(v) for v in values]), c.cast("int"))

    status = pick(i % 5, ["NEW", "EXISTING", "MODIFIED", "SUPERSEDED", "CLARIFICATION"])
    kind = (
        F.when(F.col("lang") == "en", "circular")
        .when(F.col("lang") == "fr", "master_direction")
        .when(F.col("lang") == "de", "amendment")
        .otherwise("notification")
    )
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("R-"), i.cast("string")).alias("rule_id"),
        i.alias("idx"),
        F.substring_index("text", ".", 1).alias("title"),
        F.substring_index("text", "\n", 1).alias("description"),
        pick(n % 5, ["CRITICAL", "HIGH", "MEDIUM", "LOW", "SEVERE"]).alias("severity"),
        F.when(F.col("lang") == "en", "validation").when(F.col("lang") == "fr", "advisory").alias("rule_type"),
        F.upper("source").alias("category"),
        F.col("lang"),
        F.when(F.col("quality").isNotNull(), (n % 101) / 100.0).alias("confidence_score"),
        (F.col("quality") == 0).alias("needs_review"),
        status.alias("status"),
        F.concat("source", F.lit(".pdf")).alias("source_document_name"),
        kind.alias("source_document_type"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 1000).cast("int")).cast("string").alias("source_document_date"),
        F.when(i % 10 == 2, F.concat("source", F.lit("-m.pdf"))).alias("last_modified_by"),
        F.when(i % 5 == 2, F.concat(F.lit("limit "), n.cast("string"))).alias("modification_summary"),
        F.col("text").alias("source_clause"),
        F.when(i % 7 == 0, F.lit("p. x")).otherwise((i % 97).cast("string")).alias("page_number"),
        F.lit(1).alias("reference_count"),
        n.alias("n_chars"),
    )


# The same rule records in SQL, as a common table expression.
RULES = """rules AS (
  SELECT 'R-' || d.doc_id AS rule_id, d.doc_id AS idx,
    split_part(text, '.', 1) AS title, split_part(text, chr(10), 1) AS description,
    CASE n_chars % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'SEVERE' END AS severity,
    CASE lang WHEN 'en' THEN 'validation' WHEN 'fr' THEN 'advisory' END AS rule_type,
    upper(source) AS category, lang,
    CASE WHEN quality IS NOT NULL THEN (n_chars % 101) / 100.0 END::DOUBLE AS confidence_score,
    quality = 0 AS needs_review,
    CASE d.doc_id % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'EXISTING' WHEN 2 THEN 'MODIFIED' WHEN 3 THEN 'SUPERSEDED' ELSE 'CLARIFICATION' END AS status,
    source || '.pdf' AS source_document_name,
    CASE lang WHEN 'en' THEN 'circular' WHEN 'fr' THEN 'master_direction' WHEN 'de' THEN 'amendment' ELSE 'notification' END AS source_document_type,
    strftime(DATE '2020-01-01' + CAST(d.doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS source_document_date,
    CASE WHEN d.doc_id % 10 = 2 THEN source || '-m.pdf' END AS last_modified_by,
    CASE WHEN d.doc_id % 5 = 2 THEN 'limit ' || n_chars END AS modification_summary,
    text AS source_clause,
    CASE WHEN d.doc_id % 7 = 0 THEN 'p. x' ELSE CAST(d.doc_id % 97 AS VARCHAR) END AS page_number,
    1 AS reference_count, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
