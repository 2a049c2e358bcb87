"""The rule registry: filters, lookups, upsert and judgements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.operators.ordering import running

from tallywarden.operators.rules import STATUSES

JUDGEMENT_SCHEMA = (
    "matched_rule_id string, status string, confidence double, "
    "modification_summary string, key_delta string, provenance_action string"
)


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Filter by status, category, source document, review flag, id, verdict, ..."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    return df


def clause_search(
    df: DataFrame, clause: str, phrase: str, order: list, limit: int | None = None,
    literal: bool = True, first: int | None = None,
) -> DataFrame:
    """Rules whose clause contains the phrase, or only the ``first`` characters of
    it where a view asks for that. ``literal=False`` lets ``_`` in the
    phrase stand for any character, as a pattern search does."""
    phrase = re.sub("%", "", phrase.strip())
    if first is not None:
        phrase = phrase[:first]
    c = F.col(clause)
    pattern = phrase.replace("\\", "\\\\")
    hit = F.contains(F.lower(c), F.lit(phrase.lower())) if literal else c.ilike(f"%{pattern}%")
    found = df.filter(hit)
    return found.orderBy(*order).limit(limit) if limit else found


def rules_of(registry: DataFrame, findings: DataFrame, key: str = "rule_id") -> DataFrame:
    """Registry rows of the rules that occur in the findings."""
    return registry.join(findings.select(key).distinct(), key, "left_semi")


def split_known(
    new: DataFrame, known: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, rows to process)."""
    keys = known.select(key).distinct()
    return new.join(keys, key, "left_semi"), new.join(keys, key, "left_anti")


def memo_lookup(new: DataFrame, memo: DataFrame, key: str, stored: list[str]) -> DataFrame:
    """Stored columns for content seen before; the smallest
    memo row of a key is used, as a whole."""
    one = memo.groupBy(key).agg(F.min(F.struct(*stored)).alias("__one")).select(key, "__one.*")
    return new.join(one, key, "inner")


def order_gate(documents: DataFrame, registry: DataFrame, kind: str = "source_document_type") -> DataFrame:
    """Documents with ``admitted``: base documents always, the others only once
    the registry holds a base document."""
    has_base = registry.agg(
        F.coalesce(F.bool_or(F.col(kind) == "master_direction"), F.lit(False)).alias("b")
    )
    return documents.withColumn(
        "admitted", F.col(kind).eqNullSafe("master_direction") | has_base.scalar()
    )


def latest_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row per key; rows without a key are left out. A row whose order is
    null counts as earlier than any other."""
    rest = [c for c in df.columns if c != key]
    return (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(order.isNotNull(), order)).alias("r"))
        .select(key, "r.*")
    )


def keyless(new: DataFrame, key: str) -> DataFrame:
    """The rows that an upsert cannot take: null or empty key."""
    return new.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Existing rows with the new ones laid over them.

    Only columns the new rows bring are changed; columns only they have are
    added. The last of several new rows for one key, by ``order``, counts. New
    rows without a key are not taken; ``keyless`` gives them.
    """
    new = latest_per_key(new, key, order)
    marked = new.withColumnsRenamed({c: f"__n_{c}" for c in new.columns})
    joined = existing.join(marked, existing[key] == marked[f"__n_{key}"], "full_outer")
    is_new = F.col(f"__n_{key}").isNotNull()
    out = []
    for c in existing.columns:
        if c == key:
            out.append(F.coalesce(existing[c], F.col(f"__n_{c}")).alias(c))
        elif c in new.columns:
            out.append(F.when(is_new, F.col(f"__n_{c}")).otherwise(existing[c]).alias(c))
        else:
            out.append(existing[c])
    out += [F.col(f"__n_{c}").alias(c) for c in new.columns if c not in existing.columns]
    return joined.select(*out)


class VersionedTable:
    """A Parquet table replaced as a whole: each write is a new version folder.

    Readers take the newest version that finished; a failed write is never seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            folder = status.getPath()
            done = jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if re.fullmatch(r"v\d+", folder.getName()) and fs.exists(done):
                found.append(int(folder.getName()[1:]))
        return sorted(found)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]:08d}")

    def write(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version:08d}")
        return version


def judged_rules(new: DataFrame, judgements: DataFrame, new_id: str) -> DataFrame:
    """New rules with the status, links and notes their judgement gives them.

    A rule without a judgement, or with an unknown status, is NEW.
    """
    fields = ["matched_rule_id", "status", "modification_summary", "provenance_action"]
    j = judgements.select(new_id, *[F.col(c).alias(f"__{c}") for c in fields])
    status = F.when(F.col("__status").isin(STATUSES), F.col("__status")).otherwise("NEW")
    return (
        new.join(j, new_id, "left")
        .withColumn("status", status)
        .withColumns(
            {
                "modification_summary": F.when(F.col("status") == "MODIFIED", F.col("__modification_summary")),
                "last_modified_by": F.when(F.col("status") == "MODIFIED", F.col("source_document_name")),
                "supersedes_rule_id": F.when(F.col("status") == "SUPERSEDED", F.col("__matched_rule_id")),
                "parent_rule_id": F.when(F.col("status") == "CLARIFICATION", F.col("__matched_rule_id")),
                "provenance_action": F.when(F.col("status") == "NEW", "introduced").otherwise(
                    F.coalesce("__provenance_action", F.lit("referenced"))
                ),
            }
        )
        .drop(*[f"__{c}" for c in fields])
    )


def _touching(judgements: DataFrame) -> DataFrame:
    return judgements.filter(
        F.col("matched_rule_id").isNotNull()
        & F.col("status").isin("EXISTING", "MODIFIED", "SUPERSEDED", "CLARIFICATION")
    )


def provenance_additions(judgements: DataFrame, new_id: str) -> DataFrame:
    """Rows to append to the provenance table, one per judgement with a match.

    The chain of a rule is kept as rows, not as one growing array cell, so a
    rule that every document refers to stays spread over the cluster.
    """
    fixed = (
        F.when(F.col("status") == "SUPERSEDED", "superseded")
        .when(F.col("status") == "CLARIFICATION", "clarified")
        .otherwise(F.coalesce("provenance_action", F.lit("referenced")))
    )
    return _touching(judgements).select(
        F.col("matched_rule_id").alias("rule_id"),
        F.col("source_document_date").alias("date"),
        F.col(new_id).alias("from_rule"),
        F.col("source_document_name").alias("document"),
        F.col("source_document_type").alias("type"),
        fixed.alias("action"),
    )


def apply_judgements(registry: DataFrame, judgements: DataFrame, new_id: str) -> DataFrame:
    """Registry after all judgements of a run; several may hit one rule.

    Judgements are ordered by (source date, new rule id), so the result does not
    depend on task order; the last status change wins.
    """
    when = F.struct("source_document_date", new_id)
    modified = F.col("status") == "MODIFIED"
    changed = F.col("status").isin("MODIFIED", "SUPERSEDED")
    per_rule = (
        _touching(judgements)
        .groupBy(F.col("matched_rule_id").alias("__id"))
        .agg(
            F.count("*").alias("__references"),
            F.max_by("status", F.when(changed, when)).alias("__status"),
            F.max_by("source_document_name", F.when(modified, when)).alias("__by"),
            F.max_by("modification_summary", F.when(modified, when)).alias("__summary"),
            F.count_if(modified).alias("__modified"),
            F.count_if(changed).alias("__changed"),
        )
    )
    hit = F.col("__modified") > 0
    return (
        registry.join(per_rule, registry["rule_id"] == F.col("__id"), "left")
        .withColumns(
            {
                "status": F.when(F.col("__changed") > 0, F.col("__status")).otherwise(registry["status"]),
                "last_modified_by": F.when(hit, F.col("__by")).otherwise(registry["last_modified_by"]),
                "modification_summary": F.when(hit, F.col("__summary")).otherwise(
                    registry["modification_summary"]
                ),
                "reference_count": F.coalesce(registry["reference_count"], F.lit(1))
                + F.coalesce("__references", F.lit(0)),
            }
        )
        .drop("__id", "__references", "__status", "__by", "__summary", "__modified", "__changed")
    )


def history_additions(registry: DataFrame, judgements: DataFrame, new_id: str) -> DataFrame:
    """The old row, as JSON, for each judgement that modifies it, as the judgements
    before it, by (source date, new rule id), left it."""
    order, month = ["source_document_date", new_id], F.substring("source_document_date", 1, 7)
    when = [F.col("source_document_date").alias("d"), F.col(new_id).alias("i")]
    modified = F.col("status") == "MODIFIED"
    touching = _touching(judgements).select("matched_rule_id", *order, "status", "source_document_name", "modification_summary")
    before = {
        "__status": (F.when(F.col("status").isin("MODIFIED", "SUPERSEDED"), F.struct(*when, F.col("status").alias("v"))), "max"),
        "__by": (F.when(modified, F.struct(*when, F.col("source_document_name").alias("v"))), "max"),
        "__summary": (F.when(modified, F.struct(*when, F.col("modification_summary").alias("v"))), "max"),
        "__references": (F.lit(1).cast("long"), "sum"),
    }
    for name, (value, how) in before.items():
        touching = running(touching, ["matched_rule_id"], order, month, value, name, how, inclusive=False)
    names = {"status": "__status", "last_modified_by": "__by", "modification_summary": "__summary"}
    joined = touching.filter(modified).select(
        F.col("matched_rule_id").alias("rule_id"), F.col(new_id).alias("replaced_by"), *before
    ).join(registry, "rule_id")
    old = []
    for c in registry.columns:
        if c in names:
            old.append(F.when(F.col(names[c]).isNotNull(), F.col(f"{names[c]}.v")).otherwise(F.col(c)).alias(c))
        elif c == "reference_count":
            old.append((F.coalesce(c, F.lit(1)) + F.coalesce("__references", F.lit(0))).cast(registry.schema[c].dataType).alias(c))
        else:
            old.append(F.col(c))
    return joined.select("rule_id", "replaced_by", F.to_json(F.struct(*old)).alias("old_rule"))


def positional_statuses(rules: DataFrame, answers: DataFrame, batch: str, place: str, answer: str) -> DataFrame:
    """Status and note of answer element i for rule i of the batch; none gives NEW."""
    schema = "array<struct<status:string,provenance_note:string>>"
    items = answers.select(
        batch, F.posexplode(F.from_json(F.col(answer), schema)).alias(place, "__a")
    )
    return rules.join(items, [batch, place], "left").select(
        *rules.columns,
        F.coalesce("__a.status", F.lit("NEW")).alias("status"),
        F.coalesce("__a.provenance_note", F.lit("Could not map enriched data; defaulting to NEW.")).alias(
            "provenance_note"
        ),
    )


def first_rule_of_title(df: DataFrame, matrix: DataFrame, title: str, rule_id: str, order: str) -> DataFrame:
    """Rule id of the first matrix entry with the title, 'SYS' if there is none."""
    first = matrix.groupBy(title).agg(F.min_by(rule_id, order).alias("__id"))
    return df.join(first, title, "left").withColumn(rule_id, F.coalesce("__id", F.lit("SYS"))).drop("__id")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("rules"))


def document_status_counts(df: DataFrame, document: str) -> DataFrame:
    """Rules per document and status as columns; unknown statuses count as new."""
    known = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("NEW")
    counted = (
        df.select(document, known.alias("status")).groupBy(document).pivot("status", STATUSES).count()
    )
    named = counted.na.fill(0).select(
        document, *[F.col(s).alias(f"{s.lower()}_rules") for s in STATUSES]
    )
    return named.withColumn(
        "total_rules", sum((F.col(f"{s.lower()}_rules") for s in STATUSES), F.lit(0))
    )


def distinct_links(parts: list[DataFrame], key: str, link: str, place: str) -> DataFrame:
    """Union of link lists per key: each link once, in order of first sight."""
    every = None
    for n, part in enumerate(parts):
        one = part.select(key, link, F.struct(F.lit(n).alias("list"), F.col(place).alias("place")).alias("__at"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key, link).agg(F.min("__at").alias("__at")).select(
        key, link, F.col("__at.list").alias("list"), F.col("__at.place").alias(place)
    )
