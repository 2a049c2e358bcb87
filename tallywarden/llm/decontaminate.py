"""Benchmark decontamination with DataFrame functions alone.

Windows of benchmark items are hashed; the set of their hashes is small and, if its
checked size allows, broadcast. Documents are split into words once and the hash of
each of their windows is looked up; id, number of words and hits go on, no text does.
The hits are then brought to the documents that have them, again by broadcast if
their checked number allows, and compared word by word there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.common import discard, stored

# Words are runs of 0-9, a-z and everything beyond ASCII; A-Z are lowered first.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BROADCAST_ROWS = 200_000  # a hash and a length each: some MB


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BETWEEN), lambda w: w != "")


def _windows(ws: Column, n: Column | int) -> Column:
    """Hash of every window of ``n`` words with its position."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i + 1, n)))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``item_id``, ``n``, ``h`` and ``window``: the distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    n = F.least(F.size("ws"), F.lit(size))
    cut = F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.slice("ws", i + 1, n))
    return (
        items.select("item_id", n.alias("n"), F.explode(cut).alias("window"))
        .distinct()
        .withColumn("h", F.xxhash64("window"))
    )


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def _lookup(docs: DataFrame, items: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``n_words`` of every document; ``doc_id``, ``pos``, ``n``, ``of``
    of every place where a window of the items ``of`` stands)."""
    none = F.array().cast("array<string>")
    # Length 0 stands for the document itself: one window without words in each.
    zero = docs.sparkSession.range(1).select(F.lit(0).alias("n"), F.xxhash64(none).alias("h"))
    keys = stored(items.select("n", "h").distinct().unionByName(zero), "keys", False)
    worded = docs.select("doc_id", words(F.col("text")).alias("ws"))
    sized = worded.select(
        "doc_id", "ws", F.size("ws").alias("n_words"), F.explode(F.array(*[F.lit(n) for n in [0, *lengths]])).alias("n")
    )
    hashes = F.when(F.col("n") == 0, F.array(F.xxhash64(none))).otherwise(_windows(F.col("ws"), F.col("n")))
    at = sized.select("doc_id", "n_words", "n", F.posexplode(hashes).alias("pos", "h"))
    known = stored(at.join(_small(keys), ["n", "h"]), "known")
    sizes = known.filter("n = 0").groupBy("doc_id").agg(F.max("n_words").cast("long").alias("n_words"))
    hits = stored(known.filter("n > 0").select("doc_id", "pos", "n", "h").distinct(), "hits", False)
    if hits.count() <= _BROADCAST_ROWS:
        lists = F.broadcast(hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "h")).alias("hits")))
    else:
        lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "h")).alias("hits"))
    cut = F.transform(
        "hits",
        lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), x["h"].alias("h"), F.slice("ws", x["pos"] + 1, x["n"]).alias("window")),
    )
    seen = worded.join(lists, "doc_id").select("doc_id", F.inline(cut)).distinct()
    windows = items.groupBy("n", "h", "window").agg(F.collect_set("item_id").alias("of"))
    windows = _small(stored(windows, "windows", False))
    return sizes, stored(seen.join(windows, ["n", "h", "window"]).select("doc_id", "pos", "n", "of"), "verified", False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids as text,
    sorted) and ``spans`` (hit words, as disjoint pieces of word positions).

    A window is ``size`` consecutive words of an item, or all of a shorter item.
    Null and blank texts have no words; items without words have no window. Rows
    without ``doc_id`` or ``item_id`` take no part. Repeated rows of a document
    count once. Other columns are ignored. ``doc_id`` and ``item_id`` may have any
    type.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    items = stored(item_windows(benchmark.filter("item_id IS NOT NULL"), size), "items", False)
    lengths = [r[0] for r in items.select("n").distinct().orderBy("n").collect()]  # at most ``size``
    sizes, hits = _lookup(docs, items, lengths)
    discard(items)
    named = hits.select("doc_id", F.explode("of").alias("item")).distinct().groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items")
    )
    # In order of place, a hit that starts behind all before it opens a span.
    ends = hits.groupBy("doc_id", "pos").agg(F.max(F.col("pos") + F.col("n")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("pos")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", F.when(F.col("pos") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(before))
    spans = numbered.groupBy("doc_id", "span").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    marked = spans.groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    return (
        sizes.join(marked, "doc_id", "left")
        .join(named, "doc_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, columns as given."""
    bad = decontaminate(docs, benchmark, size).filter("n_hit > 0").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti")
