"""Management queries and the planning of assisted review."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_label(path: Column, source_name: Column) -> Column:
    """Show a relative path; hide addresses, absolute paths and opaque references behind the source."""
    hidden = F.coalesce(F.nullif(F.trim(source_name), F.lit("")), F.lit("Source reference hidden"))
    plain = F.trim(path)
    unsafe = plain.rlike(r"(?i)\Ahttps?:") | plain.startswith("/") | plain.startswith("~/") | plain.rlike(r"\A[A-Za-z]:[\\/]") | plain.startswith("source_reference:")
    return F.when(F.coalesce(plain, F.lit("")) == "", hidden).when(unsafe, hidden).otherwise(plain)


def filter_findings(findings: DataFrame, words: str = "", risk: str = "all", status: str = "all") -> DataFrame:
    text = F.lower(F.concat_ws(" ", "file_name", "source_label", F.coalesce("context_category", F.lit(""))))
    out = findings.filter(F.contains(text, F.lit(words.lower()))) if words else findings
    if risk != "all":
        out = out.filter(F.col("risk_level") == risk)
    return out if status == "all" else out.filter(F.col("status") == status)


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page with the total and the next offset (null on the last page)."""
    total = rows.agg(F.count("*").alias("total"))
    following = F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("next_offset", following)


def top_high_risk(findings: DataFrame, order: list, count: int = 3) -> DataFrame:
    return findings.filter(F.col("risk_level") == "high").orderBy(*order).limit(count)


def admin_aggregation(scan: DataFrame, outcomes: DataFrame, delta: DataFrame) -> DataFrame:
    """Coverage, risk, backlog, outcomes and delta in one row, from one-row inputs."""
    joined = scan.crossJoin(outcomes).crossJoin(delta)
    work = F.greatest(F.col("flagged_files"), F.col("decisions") + F.col("open_review_backlog"))
    return joined.withColumn("reviewable_findings", work).withColumn(
        "completion_rate", F.when(work > 0, F.round(F.col("decisions") / work, 3)).otherwise(1.0))


# --- assisted review: plan and cost only, no model is called ------------------------------------

TIERS = (
    "source_policy_context", "metadata_inventory", "text_layer", "ocr", "grep_rules", "policy_context_risk",
    "ai_context", "owner_assignment_boundary", "review_permission_boundary", "audit_recording", "delta_evaluation_metrics",
)


def tier_plan(candidates: DataFrame, assist_enabled: bool, ocr_local: bool) -> DataFrame:
    """Eleven tiers per candidate with their status."""
    def ready(test: Column, other: str) -> Column:
        return F.when(test, "ready").otherwise(other)

    assist = (
        F.when(~F.col("redacted") | ~F.col("policy_available"), "blocked")
        .when(~F.col("ambiguous") | (F.col("hits") <= 0), "skipped")
        .otherwise("ready" if assist_enabled else "disabled")
    )
    status = {
        "source_policy_context": ready(F.col("policy_available"), "blocked"),
        "metadata_inventory": F.lit("enabled"),
        "text_layer": ready(F.col("text_available"), "skipped"),
        "ocr": F.when(~F.col("ocr_required"), "skipped").otherwise("ready" if ocr_local else "deferred"),
        "grep_rules": ready(F.col("text_available") | ~F.col("ocr_required"), "waiting_for_ocr"),
        "policy_context_risk": ready(F.col("policy_available"), "blocked"),
        "ai_context": assist,
        "owner_assignment_boundary": ready(F.col("owner_available"), "blocked"),
        "review_permission_boundary": ready(F.col("permission_available"), "blocked"),
        "audit_recording": ready(F.col("audit_available"), "blocked"),
        "delta_evaluation_metrics": F.lit("enabled"),
    }
    steps = F.array(*[F.struct(F.lit(t).alias("tier"), status[t].alias("status")) for t in TIERS])
    return candidates.select("doc_id", F.posexplode(steps).alias("place", "s")).select("doc_id", "place", "s.*")


def tier_eligible(candidates: DataFrame) -> DataFrame:
    reason = (
        F.when(~F.col("redacted"), "not_redacted").when(F.col("hits") <= 0, "no_anchor")
        .when(~F.col("policy_available"), "no_policy")
    )
    return candidates.withColumn("reject_reason", reason)


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def tier_cost(candidates: DataFrame, prompt_price: Decimal, completion_price: Decimal, max_prompt: int, max_completion: int) -> DataFrame:
    """Prompt tokens, bounded, and the price of a call."""
    prompt = F.least(tokens(F.col("text")), F.lit(max_prompt))
    price = F.lit(prompt_price).cast("decimal(18,10)")
    fixed = (F.lit(completion_price).cast("decimal(18,10)") * F.lit(max_completion)).cast("decimal(18,10)")
    return candidates.withColumn("prompt_tokens", prompt).withColumn(
        "cost", ((F.col("prompt_tokens").cast("decimal(10,0)") * price) + fixed).cast("decimal(18,10)"))


def tier_full_cost(candidates: DataFrame, prompt_price: Decimal, completion_price: Decimal, max_prompt: int, max_completion: int) -> DataFrame:
    """Prompt tokens of the whole text and the price of sending it whole; `over_prompt` marks texts that one call cannot hold, and
    `calls` tells how many it takes, each with its own completion."""
    prompt = tokens(F.col("text"))
    calls = F.ceil(prompt / F.lit(max_prompt)).cast("long")
    price = F.lit(prompt_price).cast("decimal(18,10)")
    fixed = (F.lit(completion_price).cast("decimal(18,10)") * F.lit(max_completion)).cast("decimal(18,10)")
    cost = (prompt.cast("decimal(10,0)") * price + calls.cast("decimal(10,0)") * fixed).cast("decimal(18,10)")
    return candidates.withColumns({"prompt_tokens": prompt, "calls": calls, "over_prompt": prompt > max_prompt, "cost": cost})


def tier_budget(costs: DataFrame, budget: Decimal, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Admit candidates in key order while the running cost fits the budget.

    A running sum over everything would put all rows into one task. Keys are cut at their quantiles
    into ranges of about equal size; each range sums itself, and only the range totals, at most
    `parts` rows, are summed in order. There are as many ranges as shuffle partitions, 64 at least.
    """
    parts = parts or max(64, int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = costs.agg(F.percentile_approx(key, shares, 10_000).alias("cuts"))
    ranged = costs.crossJoin(F.broadcast(cuts)).withColumn(
        "part", F.size(F.filter("cuts", lambda c: c <= F.col(key)))
    ).drop("cuts")
    totals = ranged.groupBy("part").agg(F.sum("cost").alias("part_cost"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("part_cost").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(key)
    summed = ranged.join(F.broadcast(starts), "part").withColumn("running", F.col("before") + F.sum("cost").over(inside))
    return summed.select(key, "cost", F.col("running").cast("decimal(28,10)").alias("running"), (F.col("running") <= F.lit(budget)).alias("admitted"))
