"""Owners, permissions, and workspace membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash

# Permissions of the five workspace groups, and groups that may take over a review.
GROUP_PERMISSIONS = {
    "workspace_owner": (
        "manage_workspace_ownership", "view_workspace_admin", "invite_workspace_members", "manage_workspace_members",
        "manage_workspace_settings", "manage_workspace_groups", "view_workspace_metrics", "view_workspace_audit",
        "view_governance", "view_assigned_findings", "view_review_support", "review_findings", "view_owned_sources"),
    "workspace_admin": (
        "view_workspace_admin", "manage_workspace_settings", "invite_workspace_members", "manage_workspace_members",
        "manage_workspace_groups", "view_workspace_metrics", "view_workspace_audit", "view_governance", "view_owned_sources"),
    "privacy_reviewer": ("view_assigned_findings", "view_review_support", "review_findings"),
    "data_steward": ("view_owned_sources", "view_assigned_findings", "review_findings"),
    "auditor": ("view_workspace_audit", "view_workspace_metrics", "view_governance"),
}
RECEIVING_GROUPS = ("workspace_owner", "privacy_reviewer", "data_steward", "dpo_legal")
# Actions denied without the permission of the same name, then those denied to everybody.
GUARDED_ACTIONS = (
    "manage_workspace_groups", "manage_workspace_members", "invite_workspace_members",
    "view_workspace_admin", "manage_workspace_ownership",
)
DENIED_TO_ALL = ("execute_real_deletion", "sync_enterprise_directory")
NO_MEMBER_DENIALS = ("view_workspace_admin", "execute_real_deletion")


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _filled(owner: Column) -> Column:
    return F.when(owner["user_id"].isNotNull() & (owner["user_id"] != ""), owner)


def resolve_owner(sources: DataFrame) -> DataFrame:
    """Owner of a source's findings: assigned owner, fallback owner, configured user id."""
    user = F.when(
        F.col("assigned_owner_user_id").isNotNull() & (F.col("assigned_owner_user_id") != ""),
        F.col("assigned_owner_user_id"),
    ).otherwise(F.col("master_of_data_user_id"))
    user = text_or_null(user)
    configured = F.when(
        user.isNotNull(),
        F.struct(user.alias("user_id"), user.alias("display_name"), F.lit("source_master_of_data").alias("assignment_type")),
    )
    owner = F.coalesce(_filled(F.col("assigned_owner")), _filled(F.col("fallback_owner")), configured)
    return sources.withColumn("owner", owner)


def visibility_owner(sources: DataFrame) -> DataFrame:
    """Who may see a source. The order differs from `resolve_owner`: the id comes before the fallback."""
    return sources.withColumn(
        "visible_to",
        F.coalesce(
            F.col("assigned_owner.user_id"),
            text_or_null(F.col("assigned_owner_user_id")),
            F.col("fallback_owner.user_id"),
            text_or_null(F.col("master_of_data_user_id")),
        ),
    )


def steward_fallback(sources: DataFrame, members: DataFrame) -> DataFrame:
    """Sources without a direct owner go to the first data steward of their workspace."""
    stewards = (
        members.filter((F.col("status") == "active") & F.array_contains("group_ids", "data_steward"))
        .groupBy("workspace_id").agg(F.min_by("account_id", "member_order").alias("steward_id"))
    )
    joined = sources.join(stewards, "workspace_id", "left")
    return joined.withColumn("fallback_user_id", F.when(F.col("direct_owner_id").isNull(), F.col("steward_id"))).drop("steward_id")


def reassign(findings: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """Findings of changed sources get the new owner; without one they are unassigned."""
    changed = changed_sources.select("source_id", F.col("owner_user_id").alias("new_owner"), F.lit(True).alias("changed"))
    joined = findings.join(changed, "source_id", "left")
    owner = F.when(F.col("changed"), F.col("new_owner")).otherwise(F.col("owner_user_id"))
    status = (
        F.when(F.col("changed") & F.col("new_owner").isNull(), "unassigned")
        .when(F.col("changed") & (F.col("status") == "unassigned"), "assigned")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("owner_user_id", owner).withColumn("status", status).drop("new_owner", "changed")


def owner_profile(findings: DataFrame) -> DataFrame:
    kind = F.col("assignment_type")
    return findings.groupBy("source_id").agg(
        F.count_if(kind == "direct_owner").alias("direct_owner"),
        F.count_if(kind == "data_steward_fallback").alias("steward_fallback"),
        F.count_if(kind == "escalation").alias("escalation"),
        F.count_if(F.col("owner_user_id").isNull()).alias("unowned"),
    )


def receiving_members(members: DataFrame) -> DataFrame:
    """Active members that may take over a review."""
    groups = F.array(*map(F.lit, RECEIVING_GROUPS))
    return members.filter((F.col("status") == "active") & F.arrays_overlap("group_ids", groups))


def transfer_options(findings: DataFrame, members: DataFrame) -> DataFrame:
    """How many members can take over each finding, and the first of them.

    The options of a finding are its workspace's receiving members without its owner. The list
    is kept once per workspace; a finding needs only its size and its first two entries, so no
    finding-member pairs are made.
    """
    able = receiving_members(members)
    per_workspace = able.groupBy("workspace_id").agg(
        F.countDistinct("account_id").alias("able"), F.min("account_id").alias("first_id")
    )
    second = (
        able.join(per_workspace, "workspace_id").filter(F.col("account_id") > F.col("first_id"))
        .groupBy("workspace_id").agg(F.min("account_id").alias("second_id"))
    )
    owners = able.select("workspace_id", F.col("account_id").alias("owner_user_id")).distinct().withColumn("owner_able", F.lit(1))
    joined = (
        findings.join(per_workspace.join(second, "workspace_id", "left"), "workspace_id", "left")
        .join(owners, ["workspace_id", "owner_user_id"], "left")
    )
    count = F.coalesce("able", F.lit(0)) - F.coalesce("owner_able", F.lit(0))
    first = F.when(F.col("first_id") != F.coalesce("owner_user_id", F.lit("")), F.col("first_id")).otherwise(F.col("second_id"))
    return joined.withColumn("option_count", count).withColumn("first_option", first).drop("able", "first_id", "second_id", "owner_able")


def effective_permissions(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct sorted permissions of each membership, with a fingerprint."""
    granted = (
        members.select("membership_id", "workspace_id", F.explode("group_ids").alias("group_id"))
        .join(groups.select("group_id", "permissions"), "group_id")
        .groupBy("membership_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("permissions")))).alias("allowed"))
    )
    none = F.array().cast("array<string>")
    joined = members.join(granted, "membership_id", "left").withColumn("allowed", F.coalesce("allowed", none))
    key = F.concat_ws(":", "account_id", "workspace_id", F.array_join("group_ids", ","), F.array_join("allowed", ","))
    return joined.withColumn("fingerprint", F.concat(F.lit("sha256:"), short_hash(key, 24)))


def denied_actions(permissions: DataFrame) -> DataFrame:
    """Denied actions of each membership in their fixed order."""
    guarded = F.array(*map(F.lit, GUARDED_ACTIONS))
    missing = F.filter(guarded, lambda a: ~F.array_contains(F.col("allowed"), a))
    denied = F.concat(missing, F.array(*map(F.lit, DENIED_TO_ALL)))
    return permissions.select("membership_id", F.posexplode(denied).alias("place", "action"))


def visible_findings(findings: DataFrame, actors: DataFrame) -> DataFrame:
    """Inside a workspace an actor sees the findings they own."""
    mine = actors.select("workspace_id", F.col("account_id").alias("owner_user_id")).distinct()
    return findings.join(mine, ["workspace_id", "owner_user_id"], "left_semi")


def visible_source_counts(permissions: DataFrame, sources: DataFrame) -> DataFrame:
    """How many sources each member sees: admins all of the workspace, owner-viewers their own.

    `sources` has workspace_id and visible_to. Counts are joined, not sources, so an admin of a
    large workspace costs one row.
    """
    every = sources.groupBy("workspace_id").agg(F.count("*").alias("all_sources"))
    own = sources.groupBy("workspace_id", F.col("visible_to").alias("account_id")).agg(F.count("*").alias("own_sources"))
    viewer = F.arrays_overlap("allowed", F.array(F.lit("view_owned_sources"), F.lit("view_assigned_findings")))
    joined = permissions.join(every, "workspace_id", "left").join(own, ["workspace_id", "account_id"], "left")
    seen = (
        F.when(F.array_contains("allowed", "view_workspace_admin"), F.col("all_sources"))
        .when(viewer, F.col("own_sources"))
    )
    return joined.select("membership_id", F.coalesce(seen, F.lit(0)).alias("visible_sources"))


def visible_to(rows: DataFrame, actor: DataFrame, owner: str = "visible_to") -> DataFrame:
    """The rows (with workspace_id and an owner) that one actor sees, as a lazy filter.

    `actor` is one row: workspace_id, account_id, allowed. Without a workspace an actor sees all; in one, admins see all of it,
    viewers what they own, others nothing. The one row goes to every task, so no row is shuffled.
    """
    viewer = F.arrays_overlap("allowed", F.array(F.lit("view_owned_sources"), F.lit("view_assigned_findings")))
    who = F.broadcast(actor.limit(1).select(
        F.col("workspace_id").alias("_workspace"), F.col("account_id").alias("_account"),
        F.array_contains("allowed", "view_workspace_admin").alias("_admin"), viewer.alias("_viewer"),
    ))
    inside = F.col("workspace_id") == F.col("_workspace")
    sees = F.col("_workspace").isNull() | (inside & (F.col("_admin") | (F.col("_viewer") & (F.col(owner) == F.col("_account")))))
    return rows.join(who, sees).drop("_workspace", "_account", "_admin", "_viewer")


def workspace_counts(workspaces: DataFrame, members: DataFrame, invitations: DataFrame) -> DataFrame:
    active = members.filter(F.col("status") == "active").groupBy("workspace_id").agg(F.count("*").alias("members"))
    pending = invitations.filter(F.col("status") == "pending").groupBy("workspace_id").agg(F.count("*").alias("pending_invitations"))
    joined = workspaces.join(active, "workspace_id", "left").join(pending, "workspace_id", "left")
    return joined.fillna(0, ["members", "pending_invitations"])


def group_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    counted = (
        members.filter(F.col("status") == "active").select("workspace_id", F.explode("group_ids").alias("group_id"))
        .groupBy("workspace_id", "group_id").agg(F.count("*").alias("members"))
    )
    return groups.join(counted, ["workspace_id", "group_id"], "left").fillna(0, ["members"])


def current_membership(members: DataFrame, workspaces: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requested membership; without a request the selected one, else the last active one.

    `wanted` has account_id, requested, selected. A request that cannot be met gives no row.
    """
    active = members.filter(F.col("status") == "active").join(
        workspaces.filter(F.col("status") == "active").select("workspace_id"), "workspace_id", "left_semi"
    )
    joined = active.join(wanted, "account_id")
    rank = (
        F.when(F.col("workspace_id") == F.col("requested"), 0)
        .when(F.col("requested").isNull() & (F.col("workspace_id") == F.col("selected")), 1)
        .when(F.col("requested").isNull(), 2)
    )
    order = Window.partitionBy("account_id").orderBy(
        "rank", F.when(F.col("rank") == 2, -F.col("member_order")).otherwise(F.col("member_order"))
    )
    ranked = joined.withColumn("rank", rank).filter("rank is not null")
    return ranked.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "rank")


def invitation_state(invitations: DataFrame, now: Column) -> DataFrame:
    """A pending invitation whose expiry has passed or cannot be read is expired."""
    late = F.coalesce(F.try_to_timestamp("expires_at") <= now, F.lit(True))
    state = F.when((F.col("status") == "pending") & late, "expired").otherwise(F.col("status"))
    return invitations.withColumn("state", state)


def matching_invitations(invitations: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pending invitations of an account, matched by mail address without regard to case."""
    mail = accounts.filter(F.col("email").isNotNull() & (F.col("email") != "")).select("account_id", F.lower("email").alias("mail"))
    return invitations.filter(F.col("status") == "pending").withColumn("mail", F.lower("email")).join(mail, "mail")


def role_invariant(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether a change of one member's groups (null: removal) leaves its workspace an admin and an owner.

    Compares counts per workspace with what the change takes and gives; no member pairs.
    """
    def holds(role: str) -> Column:
        return ((F.col("status") == "active") & F.array_contains("group_ids", role)).cast("int")

    flagged = members.withColumn("admin", holds("workspace_admin")).withColumn("owner", holds("workspace_owner"))
    totals = flagged.groupBy("workspace_id").agg(F.sum("admin").alias("admins"), F.sum("owner").alias("owners"))
    joined = changes.join(flagged.select("membership_id", "workspace_id", "status", "admin", "owner"), "membership_id").join(totals, "workspace_id")

    def left(total: str, had: str, role: str) -> Column:
        gets = (F.col("status") == "active") & F.coalesce(F.array_contains("new_group_ids", role), F.lit(False))
        return F.col(total) - F.col(had) + gets.cast("int") > 0

    return joined.withColumn("keeps_admin", left("admins", "admin", "workspace_admin")).withColumn(
        "keeps_owner", left("owners", "owner", "workspace_owner"))
