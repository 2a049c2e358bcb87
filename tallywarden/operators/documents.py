"""Document classes, document types and obligation signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.dates import date_from_name, date_from_text
from tallywarden.functions.text import strip

# The document types, and the patterns that tell them, in test order.
DOCUMENT_TYPES = ["master_direction", "circular", "amendment", "gazette", "notification"]
NAME_PATTERNS = [
    (r"master\s*direction", "master_direction"),
    (r"master\s*circular", "master_direction"),
    (r"gazette", "gazette"),
    (r"amendment", "amendment"),
    (r"notification", "notification"),
    (r"circular", "circular"),
]
PAGE_PATTERNS = [
    (r"master\s+direction", "master_direction"),
    (r"master\s+circular", "master_direction"),
    (r"gazette\s+of\s+india", "gazette"),
    (r"amendment\s+to", "amendment"),
    (r"it\s+is\s+hereby\s+notified", "notification"),
    (r"ref\s*:\s*rbi", "circular"),
    (r"a\.p\.\s*\(dir", "circular"),
    (r"dnbs.*circular", "circular"),
    (r"dbr.*circular", "circular"),
]
# Words that make a text an obligation.
SIGNAL_PATTERNS = {
    "modal": r"\b(must|shall|should|are required to|are advised to|are directed to)\b",
    "prohibition": r"\b(must not|shall not|should not allow|not permitted)\b",
    "condition": r"\b(in the event of|where|if|when)\b",
    "threshold": r"(rs\.?|inr|usd|₹)\s*\d|\b\d+\s*(days|months|years|lakh)\b",
}


def normal_type(c: Column) -> Column:
    return F.translate(strip(F.lower(c)), " -", "__")


def is_base_document(document_type: Column) -> Column:
    return document_type == "master_direction"


def _cascade(c: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(c.rlike(f"(?U){p}"), F.lit(kind)) for p, kind in patterns])


def document_type(
    name: Column, text: Column, explicit: Column | None = None,
    name_patterns: list[tuple[str, str]] | None = None,
    page_patterns: list[tuple[str, str]] | None = None,
    first: int | None = None,
) -> Column:
    """struct(document_type, document_date, detection_method).

    A given type wins (an unknown one counts as circular), then the file name,
    then the text (its ``first`` characters, if given), then circular. Where the text told the
    type, the date is looked for in the text first, otherwise in the name first.
    """
    given = normal_type(explicit if explicit is not None else F.lit(None).cast("string"))
    given = F.when(given != "", given)
    by_name = _cascade(F.lower(name), name_patterns or NAME_PATTERNS)
    shown = text if first is None else F.substring(text, 1, first)
    by_text = _cascade(F.lower(shown), page_patterns or PAGE_PATTERNS)
    method = (
        F.when(given.isNotNull(), "explicit")
        .when(by_name.isNotNull(), "filename_pattern")
        .when(by_text.isNotNull(), "first_page_text")
        .otherwise("default_fallback")
    )
    kind = (
        F.when(given.isin(DOCUMENT_TYPES), given)
        .when(given.isNotNull(), F.lit("circular"))
        .otherwise(F.coalesce(by_name, by_text, F.lit("circular")))
    )
    in_name, in_text = date_from_name(name), date_from_text(text)
    date = F.when(method == "first_page_text", F.coalesce(in_text, in_name)).otherwise(
        F.coalesce(in_name, in_text)
    )
    return F.struct(
        kind.alias("document_type"), date.alias("document_date"), method.alias("detection_method")
    )


def text_class(
    df: DataFrame, doc: str, text: str, has_image: str | None = None, min_chars: int = 100,
    digital: float = 0.85, scanned: float = 0.15,
) -> DataFrame:
    """digital, scanned or mixed by the share of pages that hold text."""
    is_text = F.length(strip(F.col(text))) >= min_chars
    image = ~is_text & (F.col(has_image) if has_image else F.lit(False))
    ratio = F.col("text_pages") / F.col("total_pages")
    return (
        df.groupBy(doc)
        .agg(
            F.count("*").alias("total_pages"),
            F.count_if(is_text).alias("text_pages"),
            F.count_if(image).alias("image_pages"),
        )
        .withColumn("text_ratio", F.round(ratio, 2))
        .withColumn(
            "text_class",
            F.when(ratio >= digital, "digital").when(ratio <= scanned, "scanned").otherwise("mixed"),
        )
    )


def obligation_signals(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Names of the signals found; a text with none holds nothing to extract."""
    return F.array_compact(
        F.array(
            *[
                F.when(text.rlike(f"(?iU){p}"), F.lit(name))
                for name, p in (patterns or SIGNAL_PATTERNS).items()
            ]
        )
    )


def fill_empty_pages(df: DataFrame, second: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Text of empty pages from a second extraction, '' where that has none."""
    other = second.select(*keys, F.col(text).alias("__second"))
    own = F.when(strip(F.col(text)) != "", F.col(text))
    return (
        df.join(other, keys, "left")
        .withColumn(text, F.coalesce(own, F.col("__second"), F.lit("")))
        .drop("__second")
    )


def best_text(
    df: DataFrame, key: str, text: str, place: str, min_chars: int = 500, candidates: int | None = None
) -> DataFrame:
    """Longest text per key, the earliest on ties, nothing below ``min_chars``.

    ``place`` numbers the texts of a key from 0 (the page itself); with
    ``candidates`` links beyond that many are not looked at.
    """
    rank = F.struct(F.length(text), -F.col(place))
    return (
        (df if candidates is None else df.filter(F.col(place) <= candidates))
        .groupBy(key)
        .agg(F.max_by(F.struct(F.col(place), F.col(text)), rank).alias("b"))
        .select(key, F.col(f"b.{place}").alias(place), F.col(f"b.{text}").alias(text))
        .filter(F.length(text) >= min_chars)
    )


def best_link(df: DataFrame, key: str, link: str, place: str, containing: str = ".pdf") -> DataFrame:
    """First link with the given part, else the first that is not empty."""
    bare = strip(F.col(link))
    rank = F.struct(~F.contains(F.lower(bare), F.lit(containing)), F.col(place))
    return df.filter(bare != "").groupBy(key).agg(F.min_by(bare, rank).alias("best_link"))
