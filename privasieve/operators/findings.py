"""Findings: one per document with signals, with risk, owner, and plain-language summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import short_hash
from .anchors import safe_path


def workspace_risk(types: Column) -> Column:
    """Risk inside a scan: high or medium."""
    high = F.array(*map(F.lit, fixed.HIGH_RISK_TYPES))
    return F.when(F.arrays_overlap(types, high), "high").otherwise("medium")


def public_risk(types: Column) -> Column:
    """Risk of one analysed file: high, medium, low or none. `types` holds distinct types."""
    high = F.array(*map(F.lit, fixed.HIGH_RISK_TYPES))
    medium = F.array(*map(F.lit, fixed.MEDIUM_RISK_TYPES))
    return (
        F.when(F.arrays_overlap(types, high), "high")
        .when((F.size(types) >= 3) | F.arrays_overlap(types, medium), "medium")
        .when(F.size(types) > 0, "low")
        .otherwise("none")
    )


def risk_score(risk: Column) -> Column:
    return F.when(risk == "high", 86).otherwise(64)


def recommended_action(risk: Column) -> Column:
    return F.when(risk == "high", "escalate").otherwise("keep_with_reason")


def file_key(path: Column) -> Column:
    return short_hash(path, 24)


def finding_id(scan_id: str, path: Column) -> Column:
    return F.concat(F.lit("finding_"), short_hash(F.concat_ws(":", F.lit(scan_id), path), 12))


def assemble_findings(documents: DataFrame, sources: DataFrame, scan_id: str) -> DataFrame:
    """Findings of documents that carry their `signals`.

    Everything about a finding is in its row; only the small source table is joined, by hash if it
    outgrows a broadcast.
    """
    types = F.array_sort(F.array_distinct(F.transform("signals", lambda s: s["type"])))
    flagged = documents.filter(F.size("signals") > 0).select(
        "doc_id", "source_id", "path", "name", "family", "size_bytes",
        types.alias("personal_data_types"), F.size("signals").alias("evidence_signal_count"),
    )
    risk = workspace_risk(F.col("personal_data_types"))
    return (
        flagged.join(sources.select("source_id", "owner_user_id", "assignment_type"), "source_id", "left")
        .withColumn("risk_level", risk)
        .select(
            finding_id(scan_id, F.col("path")).alias("finding_id"),
            F.lit(scan_id).alias("scan_id"),
            "doc_id",
            "source_id",
            F.col("name").alias("file_name"),
            safe_path(F.col("path")).alias("source_path"),
            "risk_level",
            risk_score(F.col("risk_level")).alias("risk_score"),
            F.lower("family").alias("context_category"),
            "personal_data_types",
            F.lit("needs_review").alias("retention_status"),
            recommended_action(F.col("risk_level")).alias("recommended_action"),
            "evidence_signal_count",
            F.lit(fixed.POLICY_VERSION).alias("policy_pack_version"),
            F.when(F.col("owner_user_id").isNull(), "unassigned").otherwise("assigned").alias("status"),
            "owner_user_id",
            "assignment_type",
            file_key(F.col("path")).alias("file_key"),
            "size_bytes",
        )
    )


def document_types(signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct sorted types and signal count per document, from stored signals."""
    return signals.groupBy(key).agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("signals")
    )


def detected_types(signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and type: count, highest confidence, and place in the list."""
    counted = signals.groupBy(key, "type").agg(
        F.count("*").alias("signals"), F.max(F.round("confidence", 2)).alias("highest_confidence")
    )
    order = Window.partitionBy(key).orderBy(F.desc("signals"), "type")
    return counted.withColumn("place", F.row_number().over(order))


def evidence_locations(evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct safe location labels of a document in first-seen order."""
    first = (
        evidence.filter(F.col("location_label") != "Detected text")
        .groupBy(key, "location_label").agg(F.min("seq").alias("seq"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "location_label")))
    return first.groupBy(key).agg(F.transform(ordered, lambda e: e["location_label"]).alias("locations"))


def human_list(items: Column) -> Column:
    """a / a and b / a, b, and c"""
    head = F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", ")
    return (
        F.when(F.size(items) == 0, "")
        .when(F.size(items) == 1, F.element_at(items, 1))
        .when(F.size(items) == 2, F.concat_ws(" and ", items))
        .otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))
    )


def _copy_maps() -> tuple[Column, Column]:
    def as_map(i: int) -> Column:
        return F.create_map(*[F.lit(x) for k, v in fixed.SIGNAL_COPY.items() for x in (k, v[i])])

    return as_map(0), as_map(1)


def plain_summary(detected: DataFrame, product: str, file_format: str, key: str = "doc_id") -> DataFrame:
    """Headline, explanation, relevance and recommendation of documents with signals.

    `detected` is the result of `detected_types`; a document has at most one row per type.
    """
    labels, relevance = _copy_maps()
    label = F.coalesce(F.try_element_at(labels, F.col("type")), F.replace("type", F.lit("_"), F.lit(" ")))
    note = F.coalesce(F.try_element_at(relevance, F.col("type")), F.lit(fixed.OTHER_RELEVANCE))
    noun = F.when(F.col("signals") == 1, "signal").otherwise("signals")
    rows = detected.select(
        key, "place", "type", "signals",
        F.concat_ws(" ", F.col("signals").cast("string"), label, noun).alias("counted"),
        F.concat_ws(" ", label, note).alias("note"),
    )
    item = F.struct("place", "type", "counted", "note")
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.sum("signals").alias("signals")
    )
    items = F.col("items")
    risk = public_risk(F.transform(items, lambda i: i["type"]))
    extra = F.size(items) - 3
    notes = F.concat(
        F.transform(F.slice(items, 1, 3), lambda i: i["note"]),
        F.when(
            extra > 0,
            F.array(
                F.concat(
                    extra.cast("string"),
                    F.when(extra == 1, F.lit(" other category")).otherwise(F.lit(" other categories")),
                    F.lit(" also needs accountable review"),
                )
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    plural = F.when(F.col("signals") == 1, "").otherwise("s")
    found = F.concat(F.lit(f"{product} found "), F.col("signals").cast("string"), F.lit(" redacted signal candidate"), plural)
    return grouped.withColumn("risk_level", risk).select(
        key,
        F.col("signals").alias("signal_count"),
        "risk_level",
        F.concat(F.lit(f"This {file_format} file contains "), human_list(F.transform(items, lambda i: i["counted"])), F.lit(".")).alias("headline"),
        F.when(F.col("risk_level") == "high", F.concat(found, F.lit(HIGH_EXPLANATION)))
        .when(F.col("risk_level") == "medium", F.concat(found, F.lit(MEDIUM_EXPLANATION)))
        .otherwise(F.concat(found, F.lit(LOW_EXPLANATION))).alias("explanation"),
        F.concat(F.lit("GDPR relevance: "), human_list(notes), F.lit(".")).alias("relevance"),
        F.when(F.col("risk_level") == "high", HIGH_RECOMMENDATION)
        .when(F.col("risk_level") == "medium", MEDIUM_RECOMMENDATION)
        .otherwise(LOW_RECOMMENDATION).alias("recommendation"),
    )


# Sentences of the summary.
HIGH_EXPLANATION = (
    ", including at least one category that should be treated as priority personal-data evidence "
    "before retention, sharing, or cleanup decisions."
)
MEDIUM_EXPLANATION = (
    " that can identify, contact, or profile a person and should be checked by an accountable owner."
)
LOW_EXPLANATION = (
    ". The match still needs context before deciding whether the file belongs in a governed source inventory."
)
HIGH_RECOMMENDATION = (
    "Treat this as a priority review candidate and verify the redacted evidence in a governed "
    "Workspace before deciding next actions."
)
MEDIUM_RECOMMENDATION = (
    "Review the file with an accountable owner because multiple or moderate-confidence data signals were detected."
)
LOW_RECOMMENDATION = "Review the matched evidence before deciding whether the file needs governed follow-up."


def context_category(families: DataFrame, mapping: DataFrame) -> DataFrame:
    """Family to context category; families without one are `unknown`."""
    return families.join(mapping, "family", "left").withColumn(
        "context_category", F.coalesce("context_category", F.lit("unknown"))
    )


def attach_guidance(categories: DataFrame, guidance: DataFrame) -> DataFrame:
    return categories.join(guidance, "context_category", "left")


def type_requirements(types: DataFrame, guidance_types: DataFrame) -> DataFrame:
    """Which detected types the policy mentions."""
    named = guidance_types.select("type").distinct().withColumn("evidence_requirement", F.lit("detector_signal"))
    return types.join(named, "type", "left")


def retention_due(items: DataFrame, rules: DataFrame, modified: str, as_of: str) -> DataFrame:
    """Review due date by category; items without a rule have none and are never overdue."""
    due = F.date_add(F.col(modified).cast("date"), F.col("review_after_days"))
    return (
        items.join(rules, "context_category", "left")
        .withColumn("has_rule", F.col("review_after_days").isNotNull())
        .withColumn("review_due", due)
        .withColumn("overdue", F.coalesce(due < F.lit(as_of).cast("date"), F.lit(False)))
    )


def normal_retention(status: Column, retention: Column) -> Column:
    """A retained finding whose review is open is retained until review."""
    open_review = retention.isNull() | retention.isin("needs_review", "review_required", "overdue")
    return F.when((status == "retained") & open_review, "retained_until_review").otherwise(retention)


def evidence_share(families: DataFrame, total: DataFrame) -> DataFrame:
    """Split a total over families by flagged files; the last family takes what is left.

    `families` (family, flagged) is one row per family, so the ordered window is small.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("family")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    share = F.when(
        (F.col("total") > 0) & (F.col("flagged") > 0),
        F.greatest(F.lit(1), F.floor(F.col("total") * F.col("flagged") / F.col("all_flagged") + 0.5)),
    ).otherwise(0).cast("long")
    shared = (
        families.crossJoin(total)
        .withColumn("all_flagged", F.sum("flagged").over(everything))
        .withColumn("last", F.lead("family").over(ordered).isNull())
        .withColumn("share", share)
    )
    left = F.greatest(F.lit(0), F.col("total") - F.coalesce(F.sum("share").over(before), F.lit(0)))
    return shared.withColumn("share", F.when(F.col("last"), left).otherwise(F.col("share"))).select(
        "family", "flagged", "share"
    )
