"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the reference's strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Openings of a numbered section, tried in this order.
SECTION_PATTERNS = [
    r"\d+\.\s+[A-Z]",
    r"Para\s+\d+",
    r"\([a-z]\)\s+",
    r"\([ivxlcdm]+\)\s+",
    r"[A-Z][a-z]+\s+\d+\.",
    r"Annex-[IVX]+",
    r"[A-Z]{2,}\s*:",
    r"\d+\.\d+\s+",
    r"Chapter\s+\d+",
]

BLANK_LINE = r"\n\s*\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Lower case, runs of white space to one blank, ends stripped."""
    return strip(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")))


def letter_ratio(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.try_divide(letters, F.length(c))


def token_estimate(c: Column, chars_per_token: int = 4) -> Column:
    return F.floor(F.length(c) / F.lit(chars_per_token))


def content_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def paragraphs(c: Column, separator: str = BLANK_LINE) -> Column:
    """Array of stripped, non-empty paragraphs."""
    parts = F.transform(F.split(c, separator), strip)
    return F.filter(parts, lambda p: p != "")


def section_marker(c: Column, patterns: list[str] | None = None) -> Column:
    """Opening of a numbered section at the very start of a paragraph, else ''.

    Alternatives are ordered, so the first pattern that fits wins.
    """
    alternatives = "|".join(f"(?:{p})" for p in patterns or SECTION_PATTERNS)
    return strip(F.regexp_extract(c, rf"(?U)\A(?:{alternatives})", 0))


def keyword_tags(c: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which any keyword occurs in the lower-case text."""
    low = F.lower(c)

    def hit(words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(low, F.lit(word.lower()))
        return found

    return F.array_compact(
        F.array(*[F.when(hit(words), F.lit(name)) for name, words in groups.items()])
    )


def transaction_label(row_idx: Column) -> Column:
    return F.format_string("TXN-%06d", (row_idx + 1).cast("long"))


def violation_label(row_idx: Column, rule_id: Column) -> Column:
    return F.format_string(
        "VIO-%07d-%s", (row_idx + 1).cast("long"), F.substring(rule_id, 1, 6)
    )


def clean_label(row_idx: Column) -> Column:
    return F.format_string("CLN-%07d", (row_idx + 1).cast("long"))


def pipe_labels(c: Column) -> Column:
    return F.split(c, r"\|")


def first_line(c: Column) -> Column:
    """First non-empty line, stripped."""
    return strip(F.substring_index(strip(c), "\n", 1))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``{name}`` in the template with the value, null as ''.

    The template is cut at its placeholders once; what a value holds is not
    looked at again. Names without a value stay as they are.
    """
    if not values:
        return template
    names = "|".join(re.escape(n) for n in values)
    parts = F.regexp_extract_all(template, F.lit(rf"(?s)\{{(?:{names})\}}|(?:(?!\{{(?:{names})\}}).)+"), F.lit(0))

    def filled(part: Column) -> Column:
        out = part
        for name, value in values.items():
            out = F.when(part == "{" + name + "}", F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, filled), "")


def pieces(c: Column, step: int = 450) -> Column:
    """The text cut every ``step`` characters, in one pass over it."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))


def windows(cut: str, size: int = 500, overlap: int = 50, snap: bool = True) -> Column:
    """Overlapping windows as array<struct<char_start, char_end, text>>.

    ``cut`` names a column made by ``pieces(text, size - overlap)``. Edges lie on
    the fixed grid ``k * (size - overlap)``; with ``snap`` an edge moves back to
    just behind the last white space of the ``overlap`` characters before it. An
    edge never moves further than the overlap, so no character is lost, and a
    window looks at its own piece and the two next to it only: the work grows
    with the length of the text.
    """
    step = size - overlap
    count = F.size(cut)
    # The window over the piece before the last takes a short last piece with it.
    tail = F.length(F.element_at(cut, -1))
    last = F.when((count > 1) & (tail <= overlap), count - 2).otherwise(count - 1)

    def back(text: Column) -> Column:
        """How many of these characters come after the last white space."""
        if not snap:
            return F.lit(0)
        kept = F.length(F.regexp_extract(text, r"(?s)\A.*\s", 0))
        return F.when(kept > 0, F.length(text) - kept).otherwise(0)

    def window(k: Column) -> Column:
        own = F.get(cut, k)
        before = F.right(F.get(cut, k - 1), F.lit(overlap))
        after = F.left(F.coalesce(F.get(cut, k + 1), F.lit("")), F.lit(overlap))
        lead = F.when(k == 0, 0).otherwise(back(before))
        keep = F.when(k == last, F.length(after)).otherwise(F.length(after) - back(after))
        text = F.concat(
            F.when(lead > 0, F.right(before, lead)).otherwise(""), own, F.left(after, keep)
        )
        start = k * step - lead
        return F.struct(
            start.cast("int").alias("char_start"),
            (k * step + F.length(own) + keep).cast("int").alias("char_end"),
            strip(text).alias("text"),
        )

    return F.transform(F.sequence(F.lit(0), last), window)
