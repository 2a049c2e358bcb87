"""HTML to text and link extraction."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.functions.text import strip

# Closing tags that end a line.
BREAKING_TAGS = "p|div|li|h1|h2|h3|h4|h5|h6|tr|br"
# The entities the JVM-only variant knows.
BASIC_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
]
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_to_text(c: Column, entities: str = "full", min_line: int = 3) -> Column:
    """Readable lines of a page. ``entities='basic'`` needs no Python worker."""
    bare = F.regexp_replace(c, r"(?is)<script.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style.*?</style>", " ")
    bare = F.regexp_replace(bare, rf"(?i)</(?:{BREAKING_TAGS})>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    if entities == "full":
        bare = _unescape(bare)
    else:
        for name, char in BASIC_ENTITIES:
            bare = F.replace(bare, F.lit(name), F.lit(char))
    lines = F.transform(
        F.split(bare, LINE_ENDS), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))
    )
    return F.array_join(F.filter(lines, lambda x: F.length(x) >= min_line), "\n")


def raw_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))


def _joined(root: str | None, link: str | None) -> str | None:
    """The absolute form of a link, or null for one that is no address."""
    try:
        return None if link is None else urljoin(root or "", link)
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve(base: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if group is None else [_joined(root, x) for x in group]
            for root, group in zip(base, links)
        ]
    )


def page_links(c: Column, base: Column, containing: str | None = ".pdf") -> Column:
    """Absolute links of a page in first-seen order, each once."""
    found = F.array_distinct(F.array_compact(_resolve(base, F.transform(raw_links(c), strip))))
    if containing:
        found = F.filter(found, lambda x: F.contains(F.lower(x), F.lit(containing.lower())))
    return found
