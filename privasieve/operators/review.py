"""Review decisions and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision -> resulting status, and the metric each decision counts in.
DECISION_STATUS = {
    "delete_candidate": "delete_candidate",
    "keep_with_reason": "retained",
    "correct_false_positive": "false_positive",
    "reassign_owner": "assigned",
    "escalate": "escalated",
}
CHECKLIST = ("review_redacted_evidence", "confirm_business_purpose", "confirm_permission_boundary")
HIGH_RISK_CHECK = "consider_escalation_path"
DELETE_CHECK = "confirm_delete_candidate"


def required_checklist(risk: Column, action: Column, decision: Column) -> Column:
    none = F.array().cast("array<string>")
    high = (risk == "high") | (action == "escalate")
    return F.concat(
        F.array(*map(F.lit, CHECKLIST)),
        F.when(high, F.array(F.lit(HIGH_RISK_CHECK))).otherwise(none),
        F.when(decision == "delete_candidate", F.array(F.lit(DELETE_CHECK))).otherwise(none),
    )


def validate(requests: DataFrame) -> DataFrame:
    """The first rule a request breaks, as pointer and message; null for a valid request.

    Needs the request joined with what its finding allows: allowed_decisions (may be empty), actor
    of the boundary, required_items, target_allowed, queue_allowed.
    """
    decision, given = F.col("decision"), F.coalesce("checklist_item_ids", F.array().cast("array<string>"))
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    rules = (
        (F.coalesce("request_finding_id", "finding_id") != F.col("finding_id"), "#/findingId",
         "Review request findingId does not match the route."),
        (F.coalesce(~decision.isin(*DECISION_STATUS), F.lit(True)), "#/decision", "Review decision is not available."),
        ((F.size("allowed_decisions") > 0) & ~F.array_contains(F.col("allowed_decisions"), decision), "#/decision",
         "Review decision is outside the current permission boundary."),
        ((F.coalesce("actor_id", F.lit("")) != "") & (F.col("actor_id") != F.col("boundary_actor_id")), "#/actorId",
         "Review actor does not match the current permission boundary."),
        (blank, "#/reason", "Review reason is required."),
        (F.size(F.array_except("required_items", given)) > 0, "#/checklistItemIds",
         "Required review checklist items must be acknowledged."),
        ((decision == "keep_with_reason") & F.col("retention_until").isNull(), "#/retentionUntil",
         "Retention review date is required."),
        ((decision == "reassign_owner") & (F.coalesce("reassign_to", F.lit("")) == ""), "#/reassignToUserId",
         "Transfer target is required."),
        ((decision == "reassign_owner") & ~F.coalesce("target_allowed", F.lit(False)), "#/reassignToUserId",
         "Transfer target is outside the current review support options."),
        ((decision == "escalate") & (F.coalesce("next_action", F.lit("")) == ""), "#/nextAction",
         "Escalation queue is required."),
        ((decision == "escalate") & ~F.coalesce("queue_allowed", F.lit(False)), "#/nextAction",
         "Escalation queue is outside the current review support options."),
    )
    problem = None
    for test, pointer, message in rules:
        value = F.struct(F.lit(pointer).alias("pointer"), F.lit(message).alias("message"))
        problem = F.when(test, value) if problem is None else problem.when(test, value)
    return requests.withColumn("problem", problem)


def support(findings: DataFrame) -> DataFrame:
    """Decisions an actor may take on a finding, denied ones, and the checklist.

    Needs owner_user_id, actor_id, allowed (permissions), risk_level, recommended_action.
    """
    owns = F.coalesce(F.col("owner_user_id") == F.col("actor_id"), F.lit(False))
    decisions = F.array(*map(F.lit, DECISION_STATUS))
    none = F.array().cast("array<string>")
    checklist = required_checklist(F.col("risk_level"), F.col("recommended_action"), F.lit("delete_candidate"))
    return findings.select(
        "*",
        F.when(owns, decisions).otherwise(none).alias("available_decisions"),
        F.concat(F.when(owns, none).otherwise(decisions), F.array(F.lit("execute_real_deletion"))).alias("denied_actions"),
        checklist.alias("checklist"),
    )


def first_per_idempotency_key(events: DataFrame) -> DataFrame:
    """Of review events with one finding and idempotency key only the first counts."""
    keyed = F.col("idempotency_key").isNotNull()
    order = F.struct("occurred_at", "event_id")
    columns = events.columns
    row = F.struct(*columns)
    first = (
        events.filter(keyed).groupBy("finding_id", "idempotency_key").agg(F.min_by(row, order).alias("row"))
        .select("row.*").select(*columns)
    )
    return first.unionByName(events.filter(~keyed))


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings after all accepted decisions: last status, any keep, last transfer."""
    order = F.struct("decided_at", "review_id")
    to = F.when(F.col("decision") == "reassign_owner", F.col("target_id"))
    last_transfer = F.max_by(to, F.when(to.isNotNull(), order))
    status = F.create_map(*[F.lit(x) for pair in DECISION_STATUS.items() for x in pair])
    folded = reviews.groupBy("finding_id").agg(
        F.max_by("decision", order).alias("last_decision"),
        F.bool_or(F.col("decision") == "keep_with_reason").alias("kept"),
        last_transfer.alias("new_owner"),
    )
    joined = findings.join(folded, "finding_id", "left")
    return joined.select(
        "finding_id",
        F.coalesce(F.try_element_at(status, F.col("last_decision")), F.col("status")).alias("status"),
        F.when(F.col("kept"), "retained_until_review").otherwise(F.col("retention_status")).alias("retention_status"),
        F.coalesce("new_owner", "owner_user_id").alias("owner_user_id"),
    )


def outcome_counters(reviews: DataFrame, open_findings: DataFrame, reassign_closes: bool = True) -> DataFrame:
    """Decisions per kind and the backlog left. `reassign_closes` chooses whether a transfer closes work."""
    kind = F.col("decision")
    counts = reviews.agg(
        F.count("*").alias("decisions"),
        *[F.count_if(kind == d).alias(d) for d in DECISION_STATUS],
    )
    closing = F.col("decisions") if reassign_closes else F.col("decisions") - F.col("reassign_owner")
    return counts.crossJoin(open_findings.agg(F.count("*").alias("open"))).select(
        "decisions", *DECISION_STATUS, F.greatest(F.lit(0), F.col("open") - closing).alias("open_review_backlog")
    )


def review_time(reviews: DataFrame) -> DataFrame:
    decided, opened = F.col("decided_at").cast("timestamp"), F.col("opened_at").cast("timestamp")
    hours = (F.unix_micros(decided) - F.unix_micros(opened)) / 3.6e9
    return reviews.agg(
        F.round(F.percentile(hours, F.lit(0.5)), 4).alias("median_hours"),
        F.round(F.count("*") / F.countDistinct(F.to_date("decided_at")), 4).alias("decisions_per_day"),
    )


# --- audit -------------------------------------------------------------------------------------


def events_from_scan(scans: DataFrame, findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Audit events of a scan: started and finished per scan, one per finding, one per review."""
    started = scans.select(F.concat(F.lit("audit_start_"), "scan_id").alias("audit_event_id"), "scan_id",
                           F.lit("full_scan_started").alias("event_type"), F.lit("human").alias("actor_type"))
    ended = scans.select(F.concat(F.lit("audit_end_"), "scan_id").alias("audit_event_id"), "scan_id",
                         F.concat(F.lit("full_scan_"), "outcome").alias("event_type"),
                         F.when(F.col("outcome") == "completed", "system").otherwise("human").alias("actor_type"))
    found = findings.select(F.concat(F.lit("audit_"), "finding_id").alias("audit_event_id"), "scan_id", "finding_id",
                            F.lit("finding_assigned").alias("event_type"), F.lit("system").alias("actor_type"))
    decided = reviews.select(F.concat(F.lit("audit_"), "review_id").alias("audit_event_id"), "scan_id", "finding_id",
                             F.lit("review_recorded").alias("event_type"), F.lit("human").alias("actor_type"))
    joined = started.unionByName(ended)
    for part in (found, decided):
        joined = joined.unionByName(part, allowMissingColumns=True)
    return joined


def deduplicate(events: DataFrame, order: str = "event_id") -> DataFrame:
    """The first event of every audit id. A partial minimum per task comes before the shuffle, so
    one id that repeats many times costs one row per task."""
    columns = events.columns
    return (
        events.groupBy("audit_event_id").agg(F.min_by(F.struct(*columns), F.col(order)).alias("row")).select("row.*")
    )


def newest_first(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def page_after(events: DataFrame, size: int, last: tuple | None = None) -> DataFrame:
    """The page of `size` events, newest first, that follows the event `last` (occurred_at, event_id); the first without it. What
    comes before is left out by a filter, so no page costs more than another."""
    if last is not None:
        at, event = F.lit(last[0]), F.lit(last[1])
        events = events.filter((F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("event_id") < event)))
    return newest_first(events, size)


def actor_type(actor_id: Column) -> Column:
    return F.when((actor_id == "system") | actor_id.startswith("svc_"), "system").otherwise("human")


def recording_summary(events: DataFrame) -> DataFrame:
    kind = F.coalesce("actor_type", actor_type(F.col("actor_id")))
    return events.groupBy("scan_id").agg(
        F.count("*").alias("recorded"),
        F.count_if(F.col("object_type") == "scan").alias("linked_scan"),
        F.count("finding_id").alias("linked_finding"),
        F.count_if(F.col("event_type") == "review_recorded").alias("reviews"),
        F.count_if(kind == "system").alias("system_events"),
        F.count_if(kind == "human").alias("human_events"),
        F.bool_or("raw_content_exposed").alias("raw_content_exposed"),
        F.bool_or("deletion_executed").alias("deletion_executed"),
    )


def search(events: DataFrame, fields: list[str], words: str) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return events.filter(F.contains(F.lower(text), F.lit(words.lower())))


def finding_timeline(events: DataFrame) -> DataFrame:
    """Events of every finding, newest first.

    A global order splits by finding and time, so a finding with very many events is spread over
    several tasks.
    """
    return events.filter("finding_id is not null").orderBy("finding_id", F.desc("occurred_at"), F.desc("event_id"))
