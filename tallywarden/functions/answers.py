"""Clean-up of model answers: fences off, first JSON value, parsed to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.text import strip

ANSWER_SCHEMA = (
    "rules array<struct<title:string,description:string,severity:string,"
    "source_clause:string,rule_type:string,page_number:int,paragraph_number:string,"
    "confidence_score:double>>"
)


def without_fences(c: Column) -> Column:
    """Content of the first fenced block, or the text itself."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(F.contains(c, F.lit("```")) & (fenced != ""), strip(fenced)).otherwise(strip(c))


def first_json(c: Column) -> Column:
    """From the first bracket to the last matching kind of bracket."""
    bare = without_fences(c)
    return F.coalesce(
        F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}|\[.*\]", 0), F.lit("")), F.lit("{}")
    )


def parsed_rules(c: Column) -> Column:
    """array<struct> of rules; an unusable answer gives an empty array.

    A bare array counts as the list of rules.
    """
    text = first_json(c)
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"rules":'), text, F.lit("}")))
    parsed = F.from_json(F.coalesce(wrapped, text), ANSWER_SCHEMA, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit('{"rules":[]}'), ANSWER_SCHEMA)["rules"]
    return F.coalesce(parsed["rules"], empty)


def rules_from_answers(df: DataFrame, answer: str, min_confidence: float = 0.70) -> DataFrame:
    """One row per usable rule; ``answer`` is replaced by the rule fields."""
    exploded = df.select(
        *[F.col(c) for c in df.columns if c != answer],
        F.posexplode(parsed_rules(F.col(answer))).alias("rule_pos", "r"),
    )
    kept = exploded.filter(F.coalesce(F.col("r.confidence_score"), F.lit(0.0)) >= min_confidence)
    return kept.select("*", "r.*").drop("r")
