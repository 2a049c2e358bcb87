"""Arrays of records: append, count, first match, JSON text in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = "array<struct<document:string,type:string,date:string,action:string>>"


def provenance_entry(document: Column, kind: Column, date: Column, action: Column) -> Column:
    return F.struct(
        document.cast("string").alias("document"),
        kind.cast("string").alias("type"),
        date.cast("string").alias("date"),
        action.cast("string").alias("action"),
    )


def append_entry(chain: Column, entry: Column) -> Column:
    return F.concat(F.coalesce(chain, F.array().cast(PROVENANCE)), F.array(entry))


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))


def decode_list(c: Column, schema: str) -> Column:
    """JSON text to an array; text that is no such array gives an empty one."""
    return F.coalesce(F.from_json(c, schema), F.array().cast(schema))


def encode_list(c: Column) -> Column:
    return F.to_json(c)
