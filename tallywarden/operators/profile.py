"""Profiles of transaction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGE_AMOUNT = 1_000_000


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def profile_types(df: DataFrame) -> DataFrame:
    """(column, type) with text columns tried as dates.

    Every value is tried, not a sample: a text column is ``datetime (inferred)``
    if no non-null value fails to parse.
    """
    bad = {}
    for f in df.schema.fields:
        if _kind(f.dataType) == "string":
            c = F.col(f"`{f.name}`").cast("string")
            bad[f.name] = F.count_if(c.isNotNull() & c.try_cast("timestamp").isNull())
    rows: list[Column] = []
    for f in df.schema.fields:
        kind = F.lit(_kind(f.dataType))
        if f.name in bad:
            kind = F.when(bad[f.name] == 0, "datetime (inferred)").otherwise("string")
        rows.append(F.struct(F.lit(f.name).alias("column"), kind.alias("type")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def amount_profile(df: DataFrame, amount: Column, large: float = LARGE_AMOUNT) -> DataFrame:
    """Least, greatest and mean amount and the count of large ones."""
    return df.agg(
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.avg(amount).alias("mean_amount"),
        F.count_if(amount >= large).alias("large_rows"),
        F.count(amount).alias("parsed_rows"),
    )


def sample_rows(
    df: DataFrame, order: list, n: int = 5, columns: int = 8, width: int = 50
) -> DataFrame:
    """The first rows as short texts, for a data set summary."""
    cut = [F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns[:columns]]
    return df.orderBy(*order).limit(n).select(*cut)
