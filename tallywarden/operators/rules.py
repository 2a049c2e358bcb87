"""Rule records: validation, confidence gate, verification, registry shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.functions.arrays import PROVENANCE, decode_list, first_match, provenance_entry
from tallywarden.functions.text import squeeze, strip

# Enumerations of the data model.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
STATUSES = ["NEW", "EXISTING", "MODIFIED", "SUPERSEDED", "CLARIFICATION"]
INSERTABLE = ["NEW", "MODIFIED", "SUPERSEDED", "CLARIFICATION"]
AUTO_APPROVE = 0.85
# The columns of the registry.
REGISTRY_COLUMNS = [
    "rule_id", "title", "category", "severity", "logic_type", "page_number",
    "paragraph_number", "act_section", "circular_reference", "source_clause",
    "description", "plain_english", "violation_message_template", "applicable_entity",
    "metadata_tags", "condition_field", "condition_operator", "condition_value",
    "condition_unit", "status", "source_document_name", "source_document_type",
    "source_document_date", "last_modified_by", "modification_summary",
    "provenance_chain", "rule_history", "parent_rule_id", "supersedes_rule_id",
    "reference_count",
]


def column_or(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def rule_errors(title: Column, description: Column, severity: Column, confidence: Column) -> Column:
    """Array of complaints; an empty array means a valid rule."""
    text = F.coalesce(description, F.lit(""))
    size = F.length(text)

    def missing(c: Column, name: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"Missing required field: {name}"))

    return F.array_compact(
        F.array(
            missing(title, "title"),
            missing(description, "description"),
            missing(severity, "severity"),
            F.when(
                ~F.coalesce(severity.isin(SEVERITIES), F.lit(False)),
                F.concat(F.lit("Invalid severity: "), F.coalesce(severity, F.lit("None"))),
            ),
            F.when(
                ~confidence.between(0, 1),
                F.concat(F.lit("Confidence score out of range: "), confidence.cast("string")),
            ),
            F.when(size < 20, F.format_string("Description too short (%d chars < 20)", size)).when(
                size > 5000, F.format_string("Description too long (%d chars > 5000)", size)
            ),
        )
    )


def approval_status(
    confidence: Column, needs_review: Column, threshold: float = AUTO_APPROVE
) -> Column:
    sure = F.coalesce(confidence, F.lit(0.5)) >= threshold
    held = F.coalesce(needs_review, F.lit(False))
    return F.when(sure & ~held, "auto_approved").otherwise("pending_review")


def verify_route(severity: Column) -> Column:
    """verify, pass or skip; the names do not sort, use ``route_rank``."""
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), "verify")
        .when(severity.isin("MEDIUM", "LOW"), "pass")
        .otherwise("skip")
    )


def route_rank(route: Column) -> Column:
    return F.when(route == "verify", 0).when(route == "pass", 1).otherwise(2)


def with_page_text(
    rules: DataFrame, pages: DataFrame, keys: list[str], text: str, out: str = "page_text"
) -> DataFrame:
    """The text of each rule's page, null where there is no such page."""
    return rules.join(pages.select(*keys, F.col(text).alias(out)), keys, "left")


def numbers_in(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def source_check(clause: Column, rule_text: Column, page_text: Column) -> Column:
    """struct(clause_found, numbers_agree, missing_numbers), without a model.

    The clause must occur in the page, ignoring case and spacing, and every
    number of the rule must occur in the page.
    """
    wanted = F.coalesce(squeeze(clause), F.lit(""))
    found = (wanted != "") & F.contains(F.coalesce(squeeze(page_text), F.lit("")), wanted)
    missing = F.array_except(
        numbers_in(F.coalesce(rule_text, F.lit(""))), numbers_in(F.coalesce(page_text, F.lit("")))
    )
    return F.struct(
        found.alias("clause_found"),
        (F.size(missing) == 0).alias("numbers_agree"),
        missing.alias("missing_numbers"),
    )


def verification_outcome(page_text: Column, check: Column) -> Column:
    return (
        F.when(F.coalesce(page_text, F.lit("")) == "", "skipped_no_page")
        .when(check["clause_found"] & check["numbers_agree"], "verified")
        .when(check["clause_found"], "correction_needed")
        .otherwise("source_not_found")
    )


def apply_outcome(df: DataFrame, outcome: str = "verification_status") -> DataFrame:
    """Confidence, review flag and activity after verification.

    An unusable answer is an error and leaves the rule active.
    """
    o = F.col(outcome)
    given = F.col("confidence_score")
    confidence = (
        F.when(o == "skipped_no_page", F.least(F.coalesce(given, F.lit(0.9)) - 0.15, F.lit(0.75)))
        .when(o == "verified", F.least(F.coalesce(given, F.lit(0.9)) + 0.05, F.lit(1.0)))
        .when(o == "correction_needed", 0.5)
        .when(o == "source_not_found", 0.3)
        .when(o.startswith("error"), F.greatest(F.coalesce(given, F.lit(0.5)) - 0.2, F.lit(0.3)))
        .otherwise(given)
    )
    review = (
        F.when(o == "verified", False)
        .when(o.isin("correction_needed", "source_not_found"), True)
        .otherwise(column_or(df, "needs_review", "boolean"))
    )
    active = F.when(o == "source_not_found", False).otherwise(
        F.coalesce(column_or(df, "is_active", "boolean"), F.lit(True))
    )
    return df.withColumns(
        {"confidence_score": confidence, "needs_review": review, "is_active": active}
    )


def verify_rules(rules: DataFrame, pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Route by severity and check the urgent ones against their page."""
    routed = rules.withColumn("route", verify_route(F.col("severity")))
    urgent = routed.filter(F.col("route") == "verify")
    checked = with_page_text(urgent, pages, keys, text)
    told = F.concat_ws(" ", "title", "description", "source_clause")
    checked = checked.withColumn(
        "__check", source_check(F.col("source_clause"), told, F.col("page_text"))
    ).withColumn("verification_status", verification_outcome(F.col("page_text"), F.col("__check")))
    done = apply_outcome(checked).drop("__check", "page_text")
    rest = routed.filter(F.col("route") != "verify")
    return done.unionByName(rest, allowMissingColumns=True)


def registry_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Known columns only; list columns as arrays, page number as a number."""
    lists = {
        "metadata_tags": "array<string>",
        "provenance_chain": PROVENANCE,
        "rule_history": "array<string>",
    }
    kinds = dict(df.dtypes)
    out = []
    for name in columns or REGISTRY_COLUMNS:
        if name not in kinds:
            continue
        c = F.col(name)
        if name in lists:
            c = (
                decode_list(c, lists[name])
                if kinds[name] == "string"
                else F.coalesce(c, F.array().cast(lists[name]))
            )
        elif name == "page_number":
            c = c.try_cast("int")
        out.append(c.alias(name))
    return df.select(*out)


def stamp_provenance(
    df: DataFrame, document: Column, kind: Column, date: Column, only_missing: bool = False
) -> DataFrame:
    """Source columns and a one-entry chain; status NEW where there is none."""
    given = {
        "source_document_name": document, "source_document_type": kind,
        "source_document_date": date,
    }
    chain = F.array(provenance_entry(document, kind, date, F.lit("introduced")))
    stamped = {
        name: F.coalesce(column_or(df, name, "string"), value) if only_missing else value
        for name, value in given.items()
    }
    stamped["status"] = F.coalesce(column_or(df, "status", "string"), F.lit("NEW"))
    if not only_missing:
        stamped["provenance_chain"] = chain
    return df.withColumns(stamped)


def insertable_rules(df: DataFrame) -> DataFrame:
    """Rules the registry takes, each with an id that its content decides."""
    made = F.substring(
        F.sha2(
            F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in ("title", "description", "source_clause")]),
            256,
        ),
        1,
        32,
    )
    ids = [
        F.when(column_or(df, c, "string") != "", column_or(df, c, "string"))
        for c in ("rule_id", "id")
    ]
    return df.filter(
        F.coalesce(column_or(df, "status", "string"), F.lit("NEW")).isin(INSERTABLE)
    ).withColumn("rule_id", F.coalesce(*ids, made))


def display_shape(df: DataFrame) -> DataFrame:
    """id, field, operator, threshold, severity as a list view shows them."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.select(
        F.col("rule_id").alias("id"),
        F.coalesce(full("rule_type"), full("category"), F.lit("compliance")).alias("field"),
        F.lit("must comply").alias("operator"),
        F.coalesce(full("source_clause"), F.substring("description", 1, 80), F.lit("")).alias(
            "threshold"
        ),
        "severity",
        F.col("page_number").alias("page"),
    )


def provenance_text(
    status: Column, source: Column, modified_by: Column, summary: Column, chain: Column
) -> Column:
    """A sentence or two on where a rule comes from, by its status."""
    src = F.coalesce(source, F.lit("unknown"))
    master = first_match(chain, lambda e: e["type"] == "master_direction")["document"]
    base = F.coalesce(master, src)
    by = F.coalesce(F.when(modified_by != "", modified_by), src)
    first = F.concat(F.lit("Originally introduced in: "), base)
    note = F.when(summary != "", F.concat(F.lit("Change: "), summary))
    return (
        F.when(status == "EXISTING", F.concat_ws("\n", first, F.concat(F.lit("Referenced (unchanged) by: "), src)))
        .when(status == "MODIFIED", F.concat_ws("\n", first, F.concat(F.lit("Modified by: "), by), note))
        .when(
            (F.coalesce(status, F.lit("NEW")) == "NEW") & (src != ""),
            F.concat_ws("\n", F.concat(F.lit("Introduced by: "), src), F.lit("Not present in Master Direction")),
        )
        .when(status == "SUPERSEDED", F.concat_ws("\n", first, F.concat(F.lit("Superseded by: "), by)))
        .when(
            status == "CLARIFICATION",
            F.concat_ws("\n", F.concat(F.lit("Clarification of rule from: "), base),
                        F.concat(F.lit("Clarified by: "), src)),
        )
        .otherwise(F.concat(F.lit("Introduced by: "), src))
    )


def lean_json(df: DataFrame, out: str = "lean") -> DataFrame:
    """Short JSON form of a rule for a comparison."""
    return df.select(
        "rule_id",
        F.to_json(
            F.struct(
                "title",
                F.substring("description", 1, 120).alias("description"),
                F.substring("source_clause", 1, 100).alias("source_clause"),
                "page_number",
                "severity",
                F.col("rule_id").alias("id"),
            ),
            {"ignoreNullFields": "false"},
        ).alias(out),
    )


def embedding_text() -> Column:
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")))
    return F.concat_ws(
        "\n", part("Title", "title"), part("Description", "description"), part("Source", "source_clause")
    )


def query_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "source_clause")])


def clause_phrase(clause: Column, length: int | None = None) -> Column:
    """Search phrase of a clause: stripped, without %; or only its first
    ``length`` characters, where a view asks for that."""
    whole = F.replace(strip(clause), F.lit("%"), F.lit(""))
    return whole if length is None else F.substring(whole, 1, length)
