"""Dates out of file names and running text, as ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and short forms, long names first.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
_SHORT = "janfebmaraprmayjunjulaugsepoctnovdec"


def _iso(year: Column, month: Column, day: Column, checked: bool) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    if checked:
        text = F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)
    return F.when(year != "", text)


def _parts(c: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]


def date_from_name(c: Column, checked: bool = True) -> Column:
    """d-m-Y, then Y-m-d, then a year standing alone (1 January).

    ``checked`` turns a day that is not in the calendar into null.
    """
    d1, m1, y1 = _parts(c, r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})")
    y2, m2, d2 = _parts(c, r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})")
    y3 = F.regexp_extract(c, r"\b(20\d{2})\b", 1)
    return (
        F.when(y1 != "", _iso(y1, m1, d1, checked))
        .when(y2 != "", _iso(y2, m2, d2, checked))
        .when(y3 != "", F.concat(y3, F.lit("-01-01")))
    )


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_SHORT), F.lower(F.substring(name, 1, 3)))
    return ((at + 2) / 3).cast("int").cast("string")


def date_from_text(c: Column, checked: bool = True) -> Column:
    """``14 August 2025`` first, then ``August 14, 2025``."""
    names = "|".join(MONTHS)
    d1, m1, y1 = _parts(c, rf"(?i)(\d{{1,2}})\s+({names})\s*,?\s*(\d{{4}})")
    m2, d2, y2 = _parts(c, rf"(?i)({names})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})")
    return F.when(y1 != "", _iso(y1, _month_number(m1), d1, checked)).when(
        y2 != "", _iso(y2, _month_number(m2), d2, checked)
    )
