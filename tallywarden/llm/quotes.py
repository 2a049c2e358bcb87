"""Conversations without quotations, in reply order, with DataFrame functions.

Lines that open with ``>`` are quoted, once per mark. Consecutive lines of one
level are a passage. A passage is looked up, by a digest of its letters and
digits, among the own texts, paragraphs and lines of earlier messages of the same
conversation; the latest one is what the message answers. A passage that is none
of these, as a trimmed one, is looked up by its paragraphs and lines; the message
that holds most of them, the latest on ties, is what is answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.common import stored
from tallywarden.operators.ordering import row_numbers, running

_MARKS = r"^\s*((?:>\s?)*)"
# The line before a quotation that names its author.
ATTRIBUTION = r"^(On|Am|Le|El) .{0,200}(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def normal(text: Column) -> Column:
    """Lower-case letters and digits of any script, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    n = normal(text)
    return F.when(n != "", F.sha2(n, 256))


def _lines(messages: DataFrame) -> DataFrame:
    """Level and content of every line of messages that hold a quotation."""
    return (
        messages.select("id", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
        .withColumn("level", F.length(F.regexp_replace(F.regexp_extract("raw", _MARKS, 1), r"\s", "")))
        .withColumn("content", F.regexp_replace("raw", _MARKS, ""))
    )


def reply_order(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (without quotations), ``n_quotes``
    (passages), ``parent_turn`` (what it answers, or null), ``thread_turn`` (the
    first message of its thread), ``depth`` and ``position`` (from 1, threads one
    after another, each in the order of turns).

    A message answers what its shallowest passage with a match quotes, the latest
    earlier match if there are several. Rows without ``conv_id`` or ``turn`` take
    no part, equal rows count once, different rows of one turn stay apart. A null
    text counts as empty. A quotation that matches nothing is removed all the same.
    Messages of a conversation are never brought into one group.
    """
    rows = (
        messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .filter("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
        .withColumn("id", F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("role", F.lit("\x1e")), "text"), 256))
    )
    quoting = F.col("text").rlike(r"(?m)^\s*>")
    lines = stored(_lines(rows.filter(quoting)), "lines")
    # A line is part of the passage of the line before if the level is the same.
    w = Window.partitionBy("id").orderBy("line")
    islands = lines.withColumn("new", (F.lag("level").over(w).isNull() | (F.lag("level").over(w) != F.col("level"))).cast("int"))
    islands = islands.withColumn("passage", F.sum("new").over(w)).withColumn("after", F.lead("level").over(w))
    islands = islands.filter(~((F.col("level") == 0) & (F.col("after") > 0) & F.col("content").rlike(ATTRIBUTION)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    passages = islands.groupBy("id", "conv_id", "turn", "passage", "level").agg(joined.alias("content"))
    passages = stored(passages, "passages")
    own = passages.filter("level = 0").groupBy("id").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage", "content"))), lambda x: x["content"]), "\n")).alias("own")
    )
    quotes = passages.filter("level > 0").groupBy("id").agg(F.count("*").alias("n_quotes"))
    plain = rows.filter(~quoting).withColumn("n_quotes", F.lit(0).cast("long"))
    cut = rows.filter(quoting).join(own, "id", "left").join(quotes, "id", "left").select(
        "conv_id", "turn", "role", F.coalesce("own", F.lit("")).alias("text"), "id", F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes")
    )
    clean = stored(plain.unionByName(cut), "messages")

    # Only what some passage asks for is looked up: the whole of it, its paragraphs and its lines.
    def digests(x: Column) -> Column:
        units = F.concat(F.array(x), F.split(x, r"\n\s*\n"), F.split(x, "\n"))
        return F.array_distinct(F.filter(F.transform(units, digest), lambda k: k.isNotNull()))

    quoted = passages.filter("level > 0")
    asked = quoted.select("conv_id", "turn", "id", "passage", "level", digest(F.col("content")).alias("key")).filter("key IS NOT NULL")
    parts = quoted.select("conv_id", "turn", "id", "passage", "level", F.explode(digests(F.col("content"))).alias("key"))
    keys = parts.select("conv_id", "key").distinct()
    originals = (
        clean.join(keys.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(digests(F.col("text"))).alias("key"))
        .join(keys, ["conv_id", "key"], "left_semi").distinct()
    )
    originals = stored(originals, "originals")
    events = originals.select(
        "conv_id", "key", "turn", F.col("turn").alias("source"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("passage"), F.lit(None).cast("int").alias("level")
    ).union(asked.select("conv_id", "key", "turn", F.lit(None).cast("long"), "id", "passage", "level"))
    # Latest original before: a running maximum in blocks of turns. Within a turn
    # the asking rows come first, so a message never answers its own turn.
    found = running(
        events, ["conv_id", "key"], ["turn", F.col("source").isNotNull()], F.floor(F.col("turn") / 4096),
        F.col("source"), "match", "max",
    ).filter("id IS NOT NULL AND match < turn")
    found = stored(found.select("id", "passage", "level", "match"), "found")
    # A trimmed passage is nowhere whole: the message that holds most of its parts.
    held = (
        parts.join(found, ["id", "passage"], "left_anti").join(originals.withColumnRenamed("turn", "match"), ["conv_id", "key"])
        .filter("match < turn").groupBy("id", "passage", "level", "match").agg(F.count("*").alias("n"))
    )
    whole = found.withColumn("n", F.lit(2**62).cast("long")).select("id", "level", "n", "match")
    best = whole.union(held.select("id", "level", "n", "match")).groupBy("id").agg(
        F.max(F.struct((-F.col("level")).alias("shallow"), "n", "match")).alias("best")
    )
    parents = best.select("id", F.col("best.match").alias("parent_turn"))
    clean = stored(clean.join(parents, "id", "left"), "linked")

    # Threads by pointer doubling over the answers alone.
    links = clean.filter("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up"))
    links = stored(links.withColumn("depth", F.lit(1).cast("long")), "threads")
    while True:
        above = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        next_ = stored(
            links.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "turn", F.coalesce("up2", "up").alias("up"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"),
            ),
            "threads",
        )
        links = next_.drop("moved")
        if next_.filter("moved").isEmpty():
            break
    placed = clean.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "id",
        F.coalesce("up", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )
    return row_numbers(
        placed, ["conv_id"], ["thread_turn", "turn", "id"], F.floor(F.col("thread_turn") / 4096), "position"
    ).drop("id")
