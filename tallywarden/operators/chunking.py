"""Pages to paragraphs, chunks, filtered chunks and token batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.text import (
    BLANK_LINE,
    first_line,
    letter_ratio,
    paragraphs,
    pieces,
    section_marker,
    strip,
    token_estimate,
    windows,
)
from tallywarden.operators.ordering import running
from tallywarden.operators.packing import bin_starts, greedy_bins

MAX_CHUNK_CHARS = 3200
MIN_CHUNK_CHARS = 80
MIN_POLICY_CHARS = 100
MIN_LETTER_RATIO = 0.4

# Text that marks forms, tables and back matter, in test order.
SKIP_PATTERNS = [
    ("appendix", r"^(Schedule|Annexure|Annex|Appendix|Form|Attachment)\s*[-:]"),
    ("contents", r"^(TABLE|Table)\s+OF\s+(CONTENTS|Contents)"),
    ("pipe_rows", r"^\s*\|.*\|.*\|"),
    ("form_field", r"^(Name|Address|Date|Signature)(\s*[:=]|\s*\(\s*\))"),
    ("control", r"^(Print|Sign|DateField|Checkbox|Radio\s+Button)"),
    ("back_matter", r"^(Page\s+\d+|Index|Bibliography|References|Glossary)"),
    ("check_mark", "[✓✗☐☑]"),
    ("signature_line", r"^_{2,}"),
]

# Tokens a provider takes, and what the prompt and answer need.
PROVIDER_TOKENS = {"together": 6000, "openrouter": 6000, "groq": 3000}
OTHER_PROVIDER_TOKENS = 4000
PROMPT_TOKENS = 900
ANSWER_TOKENS = 2000


def batch_capacity(provider: str) -> int:
    return PROVIDER_TOKENS.get(provider, OTHER_PROVIDER_TOKENS) - PROMPT_TOKENS - ANSWER_TOKENS


def is_readable(text: Column, min_chars: int = 80) -> Column:
    """Whether a page has enough text."""
    return F.coalesce(F.length(strip(text)) >= min_chars, F.lit(False))


def readable_pages(df: DataFrame, text: str, min_chars: int = 80) -> DataFrame:
    """Pages with enough text; their text is stripped."""
    return df.withColumn(text, strip(F.col(text))).filter(F.length(text) >= min_chars)


def explode_paragraphs(
    df: DataFrame, keep: list[str], text: str, separator: str = BLANK_LINE,
    patterns: list[str] | None = None,
) -> DataFrame:
    """One row per paragraph: pos, paragraph, section_marker."""
    return df.select(
        *keep, F.posexplode(paragraphs(F.col(text), separator)).alias("pos", "paragraph")
    ).withColumn("section_marker", section_marker(F.col("paragraph"), patterns))


def chunk_pages(
    df: DataFrame,
    doc: str,
    page: str,
    text: str,
    separator: str = BLANK_LINE,
    patterns: list[str] | None = None,
    limit: int = MAX_CHUNK_CHARS,
    min_chars: int = MIN_CHUNK_CHARS,
    pages_per_block: int = 1024,
) -> DataFrame:
    """Chunks that end at paragraph ends, numbered 0, 1, ... over each document.

    A page is one row and is packed inside that row. The number of a chunk is
    the count of chunks on earlier pages (a blocked running sum) plus its place
    on the page. ``paragraph_number`` is the last marker seen on the page so far.
    """
    packed = (
        df.select(doc, page, paragraphs(F.col(text), separator).alias("__paras"))
        .withColumn("__len", F.transform("__paras", F.length))
        .withColumn("__starts", bin_starts("__len", limit))
    )

    def measure(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("__starts", i + 1), F.size("__len"))
        chars = F.aggregate(
            F.slice("__len", start + 1, end - start), F.lit(0), lambda s, n: s + n
        )
        return F.struct(
            start.alias("start"), end.alias("end"), (chars + 2 * (end - start - 1)).alias("chars")
        )

    # Which chunks are long enough is known from lengths alone, so counting them
    # for the numbering builds no chunk text.
    measured = packed.withColumn("__all", F.transform("__starts", measure)).select(
        doc, page, "__paras", F.filter("__all", lambda b: b["chars"] >= min_chars).alias("__kept")
    )
    numbered = running(
        measured,
        [doc],
        [page],
        F.floor(F.col(page) / F.lit(pages_per_block)),
        F.size("__kept").cast("long"),
        "__before",
        inclusive=False,
    ).withColumn("__marks", F.transform("__paras", lambda p: section_marker(p, patterns)))

    def build(b: Column) -> Column:
        seen = F.filter(F.slice("__marks", F.lit(1), b["end"]), lambda m: m != "")
        return F.struct(
            F.array_join(F.slice("__paras", b["start"] + 1, b["end"] - b["start"]), "\n\n").alias("text"),
            F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")).alias("marker"),
        )

    rows = numbered.select(
        doc, page, "__before", F.posexplode(F.transform("__kept", build)).alias("__i", "c")
    ).withColumn("chunk_index", F.col("__before") + F.col("__i"))
    return rows.select(
        doc,
        page,
        "chunk_index",
        F.col("c.marker").alias("paragraph_number"),
        F.col("c.text").alias("text"),
        F.length("c.text").alias("char_count"),
        F.struct(
            F.col(page).alias("page"),
            F.col("chunk_index"),
            F.format_string("page_%d_chunk_%d", F.col(page), F.col("chunk_index")).alias("source"),
        ).alias("metadata"),
    )


def skip_reason(
    text: Column, min_chars: int = MIN_POLICY_CHARS, min_letters: float = MIN_LETTER_RATIO
) -> Column:
    """Why a chunk holds no policy text, or null if it is to be kept."""
    anyhow = "|".join(f"(?:{p})" for _, p in SKIP_PATTERNS)
    which = F.coalesce(
        *[F.when(text.rlike(f"(?dmiU){p}"), F.lit(name)) for name, p in SKIP_PATTERNS]
    )
    return (
        F.when(text.isNull() | (F.length(strip(text)) < min_chars), F.lit("too_short"))
        .when(text.rlike(f"(?dmiU){anyhow}"), which)
        .when(letter_ratio(text) < min_letters, F.lit("few_letters"))
    )


def policy_chunks(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    return df.filter(skip_reason(F.col(text), **kw).isNull())


def fitting_chunks(df: DataFrame, text: str = "text", provider: str = "together") -> DataFrame:
    """Chunks that each fit one call of the provider: a longer one becomes several
    rows, ``part`` 0, 1, ... in order. No character is lost."""
    most = batch_capacity(provider) * 4
    last = F.floor((F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)) - 1) / most).cast("int")
    parts = df.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring(F.col(text), F.col("part") * most + 1, F.lit(most))
    return parts.withColumn(text, F.when(F.length(text) > most, piece).otherwise(F.col(text)))


def batch_chunks(
    df: DataFrame, doc: str, order: str, text: str = "text", provider: str = "together",
    block_size: int = 65536, batches: str | None = None,
) -> DataFrame:
    """Token batches per document. ``order`` numbers the kept chunks 0, 1, ...;
    ``batches`` names a column for the number of batches of the document.

    A chunk that no call takes has a batch of its own; ``fitting_chunks`` makes
    such chunks fit beforehand.
    """
    capacity = batch_capacity(provider)
    sized = df.withColumn("tokens", token_estimate(F.col(text)).cast("long"))
    return greedy_bins(sized, doc, order, "tokens", capacity, "batch_no", block_size, batches)


def batch_prompts(
    df: DataFrame, doc: str, order: str, text: str = "text", page: str = "page",
    paragraph: str = "paragraph_number",
) -> DataFrame:
    """One prompt text per batch. A batch is bounded by its token capacity.

    With a column ``batches`` (``batch_chunks`` makes it) the texts are shuffled once;
    without, the batches of a document are counted first, which reads them twice.
    """
    known = "batches" in df.columns
    per_batch = df.filter(F.col(doc).isNotNull()).groupBy(doc, "batch_no").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(order).alias("o"), page, paragraph, text))
        ).alias("__chunks"),
        *([F.max("batches").alias("batches")] if known else []),
    )
    if not known:
        per_batch = per_batch.join(per_batch.groupBy(doc).agg(F.count("*").alias("batches")), doc)

    def section(c: Column, i: Column) -> Column:
        head = F.concat(
            F.lit("--- CHUNK "), (i + 1).cast("string"), F.lit(" | Page "), c[page].cast("string"),
            F.when(c[paragraph] != "", F.concat(F.lit(" | "), c[paragraph])).otherwise(""),
            F.lit(" ---"),
        )
        tail = F.concat(F.lit("--- END CHUNK "), (i + 1).cast("string"), F.lit(" ---"))
        return F.concat_ws("\n", head, strip(c[text]), tail)

    body = F.array_join(F.transform("__chunks", section), "\n\n")
    return per_batch.select(
        doc,
        "batch_no",
        "batches",
        F.size("__chunks").alias("chunks"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Batch "), (F.col("batch_no") + 1).cast("string"), F.lit(" of "),
                     F.col("batches").cast("string"), F.lit(".")),
            F.lit(""),
            body,
        ).alias("prompt"),
    )


def window_chunks(
    df: DataFrame, keep: list[str], text: str, size: int = 500, overlap: int = 50, snap: bool = True
) -> DataFrame:
    """Overlapping character windows with true offsets and the page's first line."""
    cut = df.filter(strip(F.col(text)) != "").select(
        *keep,
        first_line(F.col(text)).alias("section_title"),
        pieces(F.col(text), size - overlap).alias("__cut"),
    )
    return cut.select(
        *keep,
        "section_title",
        F.posexplode(windows("__cut", size, overlap, snap)).alias("chunk_index", "w"),
    ).select(*keep, "section_title", "chunk_index", "w.*")
