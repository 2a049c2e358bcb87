"""Summaries and list views of rules, violations and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.operators.rules import SEVERITIES

PAGE_SIZE = 15


def severity_rank(severity: Column) -> Column:
    """CRITICAL 0 to LOW 3, anything else 4."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(4).cast("int")


def normal_severity(severity: Column) -> Column:
    up = F.upper(severity)
    return F.when(up.isin(SEVERITIES), up).otherwise("MEDIUM")


def normal_verdict(verdict: Column) -> Column:
    up = F.upper(F.coalesce(verdict, F.lit("VIOLATION")))
    return F.when(up.isin("COMPLIANT", "NEEDS_REVIEW"), up).otherwise("VIOLATION")


def normal_violations(df: DataFrame, place: str) -> DataFrame:
    """Violation rows as a list view takes them; ``place`` is the 0-based row."""
    full = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    number = F.col(place) + 1
    return df.select(
        F.coalesce(full("id"), F.concat(F.lit("VIO-"), number.cast("string"))).alias("id"),
        F.coalesce(
            full("transactionId"), full("id"), F.format_string("TXN-%04d", number)
        ).alias("transactionId"),
        F.col("amount").try_cast("double").alias("amount"),
        F.coalesce(F.col("rule"), F.lit("Compliance Rule")).alias("rule"),
        normal_severity(F.col("severity")).alias("severity"),
        normal_verdict(F.coalesce("verdict", "status")).alias("status"),
    )


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query in any of the columns, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return df.filter(hit)


def sorted_view(df: DataFrame, by: str, tie: list, ascending: bool = False) -> DataFrame:
    """By severity rank (LOW first unless ascending) or by text of a column."""
    key = severity_rank(F.col("severity")) if by == "severity" else F.col(by).cast("string")
    return df.orderBy(key.asc() if ascending else key.desc(), *tie)


def page(df: DataFrame, order: list, number: int, size: int = PAGE_SIZE) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def rows_of_page(df: DataFrame, block: Column, number: int, size: int = PAGE_SIZE) -> tuple[DataFrame, int]:
    """The rows of the blocks that hold a page, and how many of them come before it.

    ``block`` must never decrease along the view's order and not be null. Rows are
    counted per block; running counts say which blocks the page lies in. Two numbers
    come to the driver, however far back the page is.
    """
    first = (number - 1) * size
    counted = df.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("block"))
    hit = counted.withColumn("upto", upto).filter((F.col("upto") > first) & (F.col("upto") - F.col("n") < first + size))
    lo, hi, before = hit.agg(F.min("block"), F.max("block"), F.min(F.col("upto") - F.col("n"))).first()
    if lo is None:
        return df.limit(0), 0
    return df.filter(block.between(lo, hi)), first - before


def deep_page(df: DataFrame, order: list, block: Column, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """``page`` for large views: only the blocks that hold the page are sorted."""
    rows, skip = rows_of_page(df, block, number, size)
    return rows.orderBy(*order).offset(skip).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("pages")
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value. The second step runs on the counts."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("rules"))
        .withColumn("percentage", F.round(100 * F.col("rules") / total, 2))
    )


def violations_per_rule(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("rule_id", "rule")
        .agg(F.count("*").alias("violations"))
        .orderBy(F.desc("violations"), "rule_id")
    )


def compliance_rate(total: Column, violated: Column, digits: int = 2) -> Column:
    """Percentage of rows without a violation; 100 for no rows."""
    rate = F.try_divide(100.0 * (total - violated), total)
    return F.round(F.coalesce(rate, F.lit(100.0)), digits)


def compliance_summary(flagged: DataFrame, flag: str = "violated") -> DataFrame:
    """total, violated and compliant rows and the rate, of transaction rows that
    say whether they break any rule (``evaluate.flagged``). Rows are counted, not
    keys: repeated and null keys count as often as they stand there."""
    return (
        flagged.agg(F.count("*").alias("total_rows"), F.count_if(F.col(flag)).alias("violation_count"))
        .withColumn("compliant_count", F.col("total_rows") - F.col("violation_count"))
        .withColumn("compliance_rate", compliance_rate(F.col("total_rows"), F.col("violation_count")))
    )


def verdict_distribution(df: DataFrame, total: Column | None = None) -> DataFrame:
    """Compliant, violation and review counts with the compliant percentage.

    Without a known total, the rows that are not compliant are the total.
    """
    counted = df.agg(
        F.count_if(F.col("status") == "VIOLATION").alias("violation"),
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
        F.count("*").alias("__all"),
    )
    bad = F.col("violation") + F.col("needs_review")
    whole = total if total is not None else F.col("__all")
    return (
        counted.withColumn("total", F.when(whole > 0, whole).otherwise(bad))
        .withColumn("compliant", F.greatest(F.lit(0), F.col("total") - bad))
        .withColumn(
            "compliance_pct",
            F.round(F.coalesce(F.try_divide(100.0 * F.col("compliant"), F.col("total")), F.lit(100.0)), 2),
        )
        .drop("__all")
    )


def verification_stats(df: DataFrame, status: str = "verification_status") -> DataFrame:
    return df.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(
        F.count("*").alias("rules"),
        F.count_if("needs_review").alias("needs_review"),
        F.round(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 4).alias("avg_confidence"),
    )


def share(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 for an empty whole."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 1)


def size_stats(df: DataFrame, size: Column) -> DataFrame:
    """total, whole average, least and greatest; zeros for no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return df.agg(
        F.count("*").alias("total"),
        zero(F.floor(F.try_divide(F.sum(size), F.count(size)))).alias("avg_size"),
        zero(F.min(size)).alias("min_size"),
        zero(F.max(size)).alias("max_size"),
    )


def memo_stats(df: DataFrame, key: str, rules: Column, text: Column) -> DataFrame:
    return df.agg(
        F.count_distinct(key).alias("cached_documents"),
        F.sum(rules).alias("total_rules"),
        F.sum(F.octet_length(text)).alias("cache_bytes"),
    )


# Seconds per call and calls in parallel, per provider.
PROVIDER_SPEED = {"together": (3, 8), "openrouter": (5, 5), "groq": (4, 2)}
OTHER_SPEED = (4, 3)


def batch_cost(batches: Column, provider: str) -> Column:
    """struct(rounds, seconds) for a number of batches."""
    seconds, parallel = PROVIDER_SPEED.get(provider, OTHER_SPEED)
    rounds = F.ceil(batches / F.lit(parallel)).cast("long")
    return F.struct(rounds.alias("rounds"), (rounds * seconds).alias("seconds"))
