"""Queries for owners, permissions, review, audit, evaluation, management, and planning.

People and review work are derived from the customer, supplier and order tables by the input
texts below, which read the same in both engines; the jobs themselves are written separately.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import short_hash
from ..operators import detect, evaluate, findings, manage, owners, review
from ..sources.forms import FIRST_FORM_ID
from ..sources.tables import corpus, table
from .detection_queries import signals
from .finding_queries import FINDINGS, SCAN, _batch, _compared, _current_findings, _findings, _previous_findings, _scan_summary, _SCAN_SQL, BATCH, DELTA
from .oracle_base import CORPUS, SIGNALS, quote, values
from .registry import query

WORKSPACES_IN = "SELECT n_name AS workspace_id, CASE WHEN n_nationkey % 9 = 8 THEN 'suspended' ELSE 'active' END AS status FROM nation"
MEMBERS_IN = (
    "SELECT concat('mem_', c_custkey) AS membership_id, n_name AS workspace_id, concat('user_', c_custkey - c_custkey % 2) AS account_id, c_custkey AS member_order, "
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'workspace_owner,workspace_admin' WHEN 'BUILDING' THEN 'workspace_admin' WHEN 'FURNITURE' THEN 'privacy_reviewer,data_steward' "
    "WHEN 'HOUSEHOLD' THEN 'data_steward' ELSE 'auditor' END AS group_list, CASE WHEN c_acctbal < 1000 THEN 'removed' ELSE 'active' END AS status "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
SOURCES_IN = (
    "SELECT concat('s', s_suppkey) AS source_id, n_name AS workspace_id, CASE s_suppkey % 5 WHEN 0 THEN concat('user_', s_suppkey) WHEN 4 THEN '' END AS assigned_id, "
    "CASE WHEN s_suppkey % 5 < 2 THEN concat('user_fb_', s_suppkey) END AS fallback_id, CASE s_suppkey % 4 WHEN 1 THEN concat(' user_cfg_', s_suppkey, ' ') WHEN 2 THEN '  ' END AS config_id, "
    "CASE s_suppkey % 3 WHEN 0 THEN concat('user_mod_', s_suppkey) END AS master_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
WORK_IN = (
    "SELECT concat('f_', o_orderkey) AS finding_id, o_orderkey, n_name AS workspace_id, concat('c', o_custkey) AS source_id, "
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('user_', o_custkey - o_custkey % 2) END AS owner_user_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unassigned' ELSE 'assigned' END AS status, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE 'medium' END AS risk_level, o_orderdate AS opened_at FROM orders "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
)
_DECISION = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'delete_candidate' WHEN 1 THEN 'keep_with_reason' WHEN 2 THEN 'correct_false_positive' WHEN 3 THEN 'reassign_owner' WHEN 4 THEN 'escalate' ELSE 'archive' END"
)
REVIEWS_IN = (
    "SELECT concat('r_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS review_id, concat('f_', l_orderkey) AS finding_id, l_shipdate AS decided_at, o_orderdate AS opened_at, "
    "CASE l_linenumber % 5 WHEN 0 THEN 'delete_candidate' WHEN 1 THEN 'keep_with_reason' WHEN 2 THEN 'correct_false_positive' WHEN 3 THEN 'reassign_owner' ELSE 'escalate' END AS decision, "
    "concat('user_t', l_suppkey) AS target_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
EVENTS_IN = (
    "SELECT event_id, concat('aud_', event_id - event_id % 3) AS audit_event_id, concat('scan_', user_id % 40) AS scan_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('f_', user_id) END AS finding_id, "
    "CASE event_type WHEN 'purchase' THEN 'review_recorded' ELSE event_type END AS event_type, CASE user_id % 5 WHEN 0 THEN 'system' WHEN 1 THEN concat('svc_', user_id) ELSE concat('user_', user_id) END AS actor_id, "
    "CASE WHEN event_id % 6 = 0 THEN 'human' END AS actor_type, CASE WHEN event_id % 3 = 0 THEN 'scan' ELSE 'finding' END AS object_type, ts AS occurred_at, props AS summary, "
    "value > 400 AS raw_content_exposed, value > 90000 AS deletion_executed, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('key_', user_id, '_', event_type) END AS idempotency_key FROM events"
)


def _run(spark, directory, sql, *names):
    return spark.sql(_braced(sql, names), **{n: table(spark, directory, n) for n in names})


def _braced(sql, names):
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return sql


def _workspaces(spark, directory):
    return _run(spark, directory, WORKSPACES_IN, "nation")


def _members(spark, directory):
    rows = _run(spark, directory, MEMBERS_IN, "customer", "nation")
    return rows.withColumn("group_ids", F.split("group_list", ","))


def _work(spark, directory):
    return _run(spark, directory, WORK_IN, "orders", "customer", "nation")


def _reviews(spark, directory):
    return _run(spark, directory, REVIEWS_IN, "lineitem", "orders")


def _events(spark, directory):
    return _run(spark, directory, EVENTS_IN, "events")


def _owner(column, kind):
    user = F.col(column)
    return F.when(user.isNotNull(), F.struct(user.alias("user_id"), user.alias("display_name"), F.lit(kind).alias("assignment_type")))


def _owned_sources(spark, directory):
    rows = _run(spark, directory, SOURCES_IN, "supplier", "nation")
    return rows.select(
        "source_id", "workspace_id", _owner("assigned_id", "direct_owner").alias("assigned_owner"), _owner("fallback_id", "data_steward_fallback").alias("fallback_owner"),
        F.col("config_id").alias("assigned_owner_user_id"), F.col("master_id").alias("master_of_data_user_id"))


@query(
    "own_resolve", "source_id varchar, owner_user_id varchar, assignment_type varchar",
    "SELECT source_id, CASE WHEN coalesce(assigned_id, '') <> '' THEN assigned_id WHEN fallback_id IS NOT NULL THEN fallback_id ELSE nullif(trim(cfg), '') END AS owner_user_id, "
    "CASE WHEN coalesce(assigned_id, '') <> '' THEN 'direct_owner' WHEN fallback_id IS NOT NULL THEN 'data_steward_fallback' WHEN trim(cfg) <> '' THEN 'source_master_of_data' END AS assignment_type "
    f"FROM (SELECT *, CASE WHEN coalesce(config_id, '') <> '' THEN config_id ELSE master_id END AS cfg FROM ({SOURCES_IN}) s) x",
)
def resolve(spark, directory):
    found = owners.resolve_owner(_owned_sources(spark, directory))
    return found.select("source_id", F.col("owner.user_id").alias("owner_user_id"), F.col("owner.assignment_type").alias("assignment_type"))


@query(
    "own_visibility_owner", "source_id varchar, visible_to varchar",
    f"SELECT source_id, coalesce(assigned_id, nullif(trim(config_id), ''), fallback_id, nullif(trim(master_id), '')) AS visible_to FROM ({SOURCES_IN}) s",
)
def visibility(spark, directory):
    return owners.visibility_owner(_owned_sources(spark, directory))


@query(
    "own_steward_fallback", "source_id varchar, direct_owner_id varchar, fallback_user_id varchar",
    f"SELECT source_id, nullif(assigned_id, '') AS direct_owner_id, CASE WHEN nullif(assigned_id, '') IS NULL THEN (SELECT arg_min(account_id, member_order) FROM ({MEMBERS_IN}) m "
    f"WHERE m.workspace_id = s.workspace_id AND status = 'active' AND contains(group_list, 'data_steward')) END AS fallback_user_id FROM ({SOURCES_IN}) s",
)
def steward(spark, directory):
    rows = _owned_sources(spark, directory).withColumn("direct_owner_id", F.nullif(F.col("assigned_owner.user_id"), F.lit("")))
    return owners.steward_fallback(rows, _members(spark, directory))


_CHANGED_IN = "SELECT concat('c', c_custkey) AS source_id, CASE WHEN c_custkey % 4 < 2 THEN concat('user_new_', c_custkey) END AS owner_user_id FROM customer WHERE c_acctbal > 5000"


@query(
    "own_reassign", "finding_id varchar, owner_user_id varchar, status varchar",
    "SELECT finding_id, CASE WHEN c.source_id IS NULL THEN w.owner_user_id ELSE c.owner_user_id END AS owner_user_id, CASE WHEN c.source_id IS NULL THEN status "
    f"WHEN c.owner_user_id IS NULL THEN 'unassigned' WHEN status = 'unassigned' THEN 'assigned' ELSE status END AS status FROM ({WORK_IN}) w LEFT JOIN ({_CHANGED_IN}) c ON c.source_id = w.source_id",
)
def reassign(spark, directory):
    return owners.reassign(_work(spark, directory), _run(spark, directory, _CHANGED_IN, "customer"))


@query(
    "own_profile", "source_id varchar, direct_owner bigint, steward_fallback bigint, unowned bigint",
    "SELECT source_id, count(*) FILTER (assignment_type = 'direct_owner') AS direct_owner, count(*) FILTER (assignment_type = 'data_steward_fallback') AS steward_fallback, "
    "count(*) FILTER (owner_user_id IS NULL) AS unowned FROM fnd GROUP BY source_id", FINDINGS,
)
def profile(spark, directory):
    return owners.owner_profile(_findings(spark, directory))


@query(
    "own_transfer_options", "finding_id varchar, option_count bigint, first_option varchar",
    f"SELECT finding_id, count(DISTINCT m.account_id) AS option_count, min(m.account_id) AS first_option FROM ({WORK_IN}) w LEFT JOIN (SELECT * FROM ({MEMBERS_IN}) x WHERE status = 'active' "
    "AND regexp_matches(group_list, 'workspace_owner|privacy_reviewer|data_steward|dpo_legal')) m ON m.workspace_id = w.workspace_id AND m.account_id <> coalesce(w.owner_user_id, '') GROUP BY finding_id",
)
def transfer(spark, directory):
    return owners.transfer_options(_work(spark, directory), _members(spark, directory))


def _groups(spark):
    rows = [(g, list(p)) for g, p in owners.GROUP_PERMISSIONS.items()]
    return F.broadcast(spark.createDataFrame(rows, "group_id string, permissions array<string>"))


_GROUPS_SQL = "grp(group_id, permission) AS (VALUES " + ", ".join(f"({quote(g)}, {quote(p)})" for g, ps in owners.GROUP_PERMISSIONS.items() for p in ps) + ")"
PERMS = f"""mem AS ({MEMBERS_IN}), {_GROUPS_SQL},
perm AS (SELECT mem.*, (SELECT list_sort(list(DISTINCT permission)) FROM grp WHERE list_contains(string_split(mem.group_list, ','), group_id)) AS allowed FROM mem)"""


def _permissions(spark, directory):
    return owners.effective_permissions(_members(spark, directory), _groups(spark))


@query(
    "prm_effective", "membership_id varchar, allowed varchar, fingerprint varchar",
    "SELECT membership_id, array_to_string(allowed, ',') AS allowed, 'sha256:' || substring(sha256(concat(account_id, ':', workspace_id, ':', group_list, ':', array_to_string(allowed, ','))), 1, 24) AS fingerprint FROM perm", PERMS,
)
def effective(spark, directory):
    return _permissions(spark, directory).withColumn("allowed", F.array_join("allowed", ","))


@query(
    "prm_denied", "membership_id varchar, place int, action varchar",
    "SELECT membership_id, row_number() OVER (PARTITION BY membership_id ORDER BY n) - 1 AS place, action FROM perm, (VALUES " +
    ", ".join(f"({i}, {quote(a)})" for i, a in enumerate(owners.GUARDED_ACTIONS + owners.DENIED_TO_ALL)) +
    f") d(n, action) WHERE action IN {values(owners.DENIED_TO_ALL)} OR NOT list_contains(allowed, action)", PERMS,
)
def denied(spark, directory):
    return owners.denied_actions(_permissions(spark, directory))


@query(
    "prm_findings_visible", "finding_id varchar, owner_user_id varchar",
    f"SELECT finding_id, owner_user_id FROM ({WORK_IN}) w WHERE EXISTS (SELECT 1 FROM ({MEMBERS_IN}) m WHERE m.status = 'active' AND m.workspace_id = w.workspace_id AND m.account_id = w.owner_user_id)",
)
def findings_visible(spark, directory):
    return owners.visible_findings(_work(spark, directory), _members(spark, directory).filter("status = 'active'"))


_SEEN_IN = "SELECT concat('c', c_custkey) AS source_id, n_name AS workspace_id, concat('user_', c_custkey - c_custkey % 2) AS visible_to FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(
    "prm_sources_visible", "membership_id varchar, visible_sources bigint",
    f"SELECT membership_id, CASE WHEN list_contains(allowed, 'view_workspace_admin') THEN (SELECT count(*) FROM ({_SEEN_IN}) s WHERE s.workspace_id = perm.workspace_id) "
    f"WHEN list_contains(allowed, 'view_owned_sources') OR list_contains(allowed, 'view_assigned_findings') THEN (SELECT count(*) FROM ({_SEEN_IN}) s WHERE s.workspace_id = perm.workspace_id AND visible_to = account_id) ELSE 0 END AS visible_sources FROM perm", PERMS,
)
def sources_visible(spark, directory):
    return owners.visible_source_counts(_permissions(spark, directory), _run(spark, directory, _SEEN_IN, "customer", "nation"))


_ACTORS = (("admin", "list_contains(allowed, 'view_workspace_admin')"), ("viewer", "NOT list_contains(allowed, 'view_workspace_admin') AND list_contains(allowed, 'view_owned_sources')"))


@query(
    "prm_source_rows", "actor varchar, source_id varchar",
    f"SELECT 'outside' AS actor, source_id FROM ({_SEEN_IN}) s UNION ALL "
    f"SELECT 'admin', source_id FROM ({_SEEN_IN}) s JOIN who ON kind = 'admin' AND s.workspace_id = who.workspace_id UNION ALL "
    f"SELECT 'viewer', source_id FROM ({_SEEN_IN}) s JOIN who ON kind = 'viewer' AND s.workspace_id = who.workspace_id AND visible_to = account_id",
    PERMS + ", who AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM (SELECT workspace_id, account_id FROM perm WHERE {test} ORDER BY membership_id LIMIT 1) {kind}" for kind, test in _ACTORS) + ")",
)
def source_rows(spark, directory):
    """What three actors see: one without a workspace, an admin, and a viewer."""
    permissions, sources = _permissions(spark, directory), _run(spark, directory, _SEEN_IN, "customer", "nation")
    admin = F.array_contains("allowed", "view_workspace_admin")
    columns = ("workspace_id", "account_id", "allowed")
    actors = {
        "outside": spark.range(1).select(F.lit(None).cast("string").alias("workspace_id"), F.lit("guest").alias("account_id"), F.array().cast("array<string>").alias("allowed")),
        "admin": permissions.filter(admin).orderBy("membership_id").select(*columns),
        "viewer": permissions.filter(~admin & F.array_contains("allowed", "view_owned_sources")).orderBy("membership_id").select(*columns),
    }
    seen = [owners.visible_to(sources, actor).select(F.lit(name).alias("actor"), "source_id") for name, actor in actors.items()]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


_INVITES_IN = (
    "SELECT concat('inv_', event_id) AS invitation_id, concat('NATION_', user_id % 25) AS workspace_id, CASE event_id % 3 WHEN 0 THEN 'accepted' ELSE 'pending' END AS status, "
    "CASE event_id % 10 WHEN 9 THEN 'soon' ELSE CAST(ts AS {text}) END AS expires_at, concat('User_', user_id, '@Example.org') AS email FROM events"
)


def _invitations(spark, directory):
    return _run(spark, directory, _INVITES_IN.replace("{text}", "STRING"), "events")


_INVITES_SQL = _INVITES_IN.replace("{text}", "VARCHAR")


@query(
    "wsp_counts", "workspace_id varchar, members bigint, pending_invitations bigint",
    f"SELECT workspace_id, (SELECT count(*) FROM ({MEMBERS_IN}) m WHERE m.workspace_id = w.workspace_id AND status = 'active') AS members, "
    f"(SELECT count(*) FROM ({_INVITES_SQL}) i WHERE i.workspace_id = w.workspace_id AND status = 'pending') AS pending_invitations FROM ({WORKSPACES_IN}) w",
)
def workspace_counts(spark, directory):
    return owners.workspace_counts(_workspaces(spark, directory), _members(spark, directory), _invitations(spark, directory))


_WANTED_IN = (
    "SELECT account_id, CASE WHEN max(member_order) % 4 = 0 THEN max(workspace_id) END AS requested, CASE WHEN max(member_order) % 4 = 1 THEN min(workspace_id) WHEN max(member_order) % 4 = 2 THEN 'nowhere' END AS selected "
    "FROM ({m}) m GROUP BY account_id"
)


@query(
    "wsp_current_membership", "account_id varchar, membership_id varchar",
    f"SELECT account_id, membership_id FROM (SELECT m.account_id, membership_id, row_number() OVER (PARTITION BY m.account_id ORDER BY CASE WHEN coalesce(w.requested, w.selected, '') = m.workspace_id THEN 0 ELSE 1 END, CASE WHEN coalesce(w.requested, w.selected, '') = m.workspace_id THEN member_order ELSE -member_order END) AS n, "
    f"w.requested FROM ({MEMBERS_IN}) m JOIN ({_WANTED_IN.replace('{m}', MEMBERS_IN)}) w USING (account_id) "
    f"WHERE m.status = 'active' AND m.workspace_id IN (SELECT workspace_id FROM ({WORKSPACES_IN}) x WHERE status = 'active') AND (w.requested IS NULL OR w.requested = m.workspace_id)) r WHERE n = 1",
)
def current(spark, directory):
    members = _members(spark, directory)
    wanted = spark.sql(_WANTED_IN.replace("({m})", "{m}"), m=members)
    # Two memberships of one account in the same workspace are told apart by their order.
    return owners.current_membership(members, _workspaces(spark, directory), wanted)


@query(
    "wsp_invitation_state", "state varchar, invitations bigint",
    f"SELECT CASE WHEN status = 'pending' AND coalesce(try_cast(expires_at AS TIMESTAMP) <= TIMESTAMP '2024-01-05', true) THEN 'expired' ELSE status END AS state, count(*) AS invitations FROM ({_INVITES_SQL}) i GROUP BY 1",
)
def invitation_state(spark, directory):
    found = owners.invitation_state(_invitations(spark, directory), F.lit("2024-01-05").cast("timestamp"))
    return found.groupBy("state").agg(F.count("*").alias("invitations"))


_CHANGES_IN = "SELECT concat('mem_', c_custkey) AS membership_id, CASE c_custkey % 3 WHEN 0 THEN 'auditor' WHEN 1 THEN 'workspace_admin,workspace_owner' END AS new_list FROM customer"


@query(
    "wsp_role_invariant", "membership_id varchar, keeps_admin boolean, keeps_owner boolean",
    f"SELECT c.membership_id, EXISTS (SELECT 1 FROM mem o WHERE o.workspace_id = m.workspace_id AND o.status = 'active' AND contains(CASE WHEN o.membership_id = c.membership_id THEN coalesce(new_list, '') ELSE o.group_list END, 'workspace_admin')) AS keeps_admin, "
    f"EXISTS (SELECT 1 FROM mem o WHERE o.workspace_id = m.workspace_id AND o.status = 'active' AND contains(CASE WHEN o.membership_id = c.membership_id THEN coalesce(new_list, '') ELSE o.group_list END, 'workspace_owner')) AS keeps_owner "
    f"FROM ({_CHANGES_IN}) c JOIN mem m ON m.membership_id = c.membership_id", f"mem AS ({MEMBERS_IN})",
)
def role_invariant(spark, directory):
    changes = _run(spark, directory, _CHANGES_IN, "customer").withColumn("new_group_ids", F.split("new_list", ","))
    return owners.role_invariant(_members(spark, directory), changes)


# --- review ------------------------------------------------------------------------------------

_REQUEST_IN = (
    f"SELECT w.*, {_DECISION} AS decision, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'checked' END AS reason, CASE WHEN o_orderkey % 13 = 0 THEN 'f_other' ELSE finding_id END AS request_finding_id, "
    "CASE o_orderkey % 17 WHEN 0 THEN 'user_else' WHEN 1 THEN NULL ELSE owner_user_id END AS actor_id, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'review_redacted_evidence' ELSE 'review_redacted_evidence,confirm_business_purpose,confirm_permission_boundary,consider_escalation_path,confirm_delete_candidate' END AS item_list, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE opened_at END AS retention_until, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 3 THEN 'user_x' ELSE 'user_ok' END AS reassign_to, "
    "CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 4 THEN 'nowhere' ELSE 'legal_escalation' END AS next_action, o_orderkey % 19 = 0 AS narrow FROM ({w}) w"
)


@query(
    "rev_validate", "finding_id varchar, pointer varchar, message varchar",
    "SELECT finding_id, " + ", ".join(
        "CASE WHEN request_finding_id <> finding_id THEN {0} WHEN decision = 'archive' THEN {1} WHEN narrow AND decision <> 'escalate' THEN {2} WHEN coalesce(actor_id, '') <> '' AND actor_id IS DISTINCT FROM owner_user_id AND owner_user_id IS NOT NULL THEN {3} "
        "WHEN trim(reason) = '' THEN {4} WHEN NOT contains(item_list, 'confirm_business_purpose') THEN {5} WHEN decision = 'keep_with_reason' AND retention_until IS NULL THEN {6} WHEN decision = 'reassign_owner' AND reassign_to = '' THEN {7} "
        "WHEN decision = 'reassign_owner' AND reassign_to <> 'user_ok' THEN {8} WHEN decision = 'escalate' AND next_action = '' THEN {9} WHEN decision = 'escalate' AND next_action <> 'legal_escalation' THEN {10} END AS {n}".format(*[quote(x) for x in xs], n=n)
        for n, xs in (("pointer", ("#/findingId", "#/decision", "#/decision", "#/actorId", "#/reason", "#/checklistItemIds", "#/retentionUntil", "#/reassignToUserId", "#/reassignToUserId", "#/nextAction", "#/nextAction")),
                      ("message", ("Review request findingId does not match the route.", "Review decision is not available.", "Review decision is outside the current permission boundary.", "Review actor does not match the current permission boundary.",
                                   "Review reason is required.", "Required review checklist items must be acknowledged.", "Retention review date is required.", "Transfer target is required.",
                                   "Transfer target is outside the current review support options.", "Escalation queue is required.", "Escalation queue is outside the current review support options.")))
    ) + f" FROM ({_REQUEST_IN.replace('{w}', WORK_IN)}) r",
)
def validate(spark, directory):
    requests = spark.sql(_REQUEST_IN.replace("({w})", "{w}"), w=_work(spark, directory))
    ready = requests.select(
        "*", F.col("owner_user_id").alias("boundary_actor_id"), F.split("item_list", ",").alias("checklist_item_ids"),
        F.when(F.col("narrow"), F.array(F.lit("escalate"))).otherwise(F.array().cast("array<string>")).alias("allowed_decisions"),
        review.required_checklist(F.col("risk_level"), F.lit(""), F.col("decision")).alias("required_items"),
        (F.col("reassign_to") == "user_ok").alias("target_allowed"), (F.col("next_action") == "legal_escalation").alias("queue_allowed"))
    return review.validate(ready).select("finding_id", "problem.pointer", "problem.message")


@query(
    "rev_support", "finding_id varchar, available_decisions varchar, denied_actions varchar, checklist varchar",
    "SELECT finding_id, CASE WHEN own THEN 'delete_candidate|keep_with_reason|correct_false_positive|reassign_owner|escalate' ELSE '' END AS available_decisions, "
    "CASE WHEN own THEN '' ELSE 'delete_candidate|keep_with_reason|correct_false_positive|reassign_owner|escalate|' END || 'execute_real_deletion' AS denied_actions, "
    "'review_redacted_evidence|confirm_business_purpose|confirm_permission_boundary|' || CASE risk_level WHEN 'high' THEN 'consider_escalation_path|' ELSE '' END || 'confirm_delete_candidate' AS checklist "
    f"FROM (SELECT *, coalesce(owner_user_id = 'user_' || (o_orderkey - o_orderkey % 2), false) AS own FROM ({WORK_IN}) w) x",
)
def support(spark, directory):
    rows = _work(spark, directory).withColumn("actor_id", F.concat(F.lit("user_"), F.col("o_orderkey") - F.col("o_orderkey") % 2)).withColumn("recommended_action", F.lit(""))
    found = review.support(rows)
    return found.select("finding_id", *[F.array_join(c, "|").alias(c) for c in ("available_decisions", "denied_actions", "checklist")])


@query(
    "rev_apply", "finding_id varchar, status varchar, retention_status varchar, owner_user_id varchar",
    "SELECT finding_id, CASE d WHEN 'delete_candidate' THEN 'delete_candidate' WHEN 'keep_with_reason' THEN 'retained' WHEN 'correct_false_positive' THEN 'false_positive' WHEN 'reassign_owner' THEN 'assigned' WHEN 'escalate' THEN 'escalated' ELSE status END AS status, "
    "CASE WHEN kept THEN 'retained_until_review' ELSE 'needs_review' END AS retention_status, coalesce(t, owner_user_id) AS owner_user_id "
    f"FROM ({WORK_IN}) w LEFT JOIN (SELECT finding_id, arg_max(decision, (decided_at, review_id)) AS d, bool_or(decision = 'keep_with_reason') AS kept, arg_max(target_id, (decided_at, review_id)) FILTER (decision = 'reassign_owner') AS t FROM ({REVIEWS_IN}) v GROUP BY 1) r USING (finding_id)",
)
def apply_reviews(spark, directory):
    return review.apply_reviews(_work(spark, directory).withColumn("retention_status", F.lit("needs_review")), _reviews(spark, directory))


@query(
    "rev_idempotent", "event_id bigint, finding_id varchar, idempotency_key varchar",
    f"SELECT event_id, finding_id, idempotency_key FROM ({EVENTS_IN}) e WHERE event_type = 'review_recorded' AND (idempotency_key IS NULL OR event_id = (SELECT arg_min(f.event_id, (f.occurred_at, f.event_id)) FROM ({EVENTS_IN}) f "
    "WHERE f.event_type = 'review_recorded' AND f.finding_id IS NOT DISTINCT FROM e.finding_id AND f.idempotency_key = e.idempotency_key))",
)
def idempotent(spark, directory):
    return review.first_per_idempotency_key(_events(spark, directory).filter("event_type = 'review_recorded'"))


_COUNT_SQL = (
    "SELECT (SELECT count(*) FROM rv) AS decisions, " + ", ".join(f"(SELECT count(*) FROM rv WHERE decision = {quote(d)}) AS {d}" for d in review.DECISION_STATUS) +
    f", greatest(0, (SELECT count(*) FROM ({WORK_IN}) w WHERE risk_level = 'high') - (SELECT count(*) FROM rv WHERE decision <> 'reassign_owner')) AS open_review_backlog"
)
_COUNT_COLUMNS = "decisions bigint, " + ", ".join(f"{d} bigint" for d in review.DECISION_STATUS) + ", open_review_backlog bigint"
_RV = f"rv AS (SELECT * FROM ({REVIEWS_IN}) r)"


def _counters(spark, directory):
    return review.outcome_counters(_reviews(spark, directory), _work(spark, directory).filter("risk_level = 'high'"), reassign_closes=False)


@query("rev_outcome_counters", _COUNT_COLUMNS, _COUNT_SQL, _RV)
def outcome_counters(spark, directory):
    return _counters(spark, directory)


@query(
    "rev_review_time", "median_hours double, decisions_per_day double",
    f"SELECT round(quantile_cont((epoch_us(decided_at) - epoch_us(opened_at)) / 3.6e9, 0.5), 4) AS median_hours, round(count(*) / count(DISTINCT CAST(decided_at AS DATE)), 4) AS decisions_per_day FROM ({REVIEWS_IN}) r",
)
def review_time(spark, directory):
    return review.review_time(_reviews(spark, directory))


# --- audit -------------------------------------------------------------------------------------


@query(
    "aud_events_from_scan", "audit_event_id varchar, scan_id varchar, finding_id varchar, event_type varchar, actor_type varchar",
    "SELECT 'audit_start_' || scan_id AS audit_event_id, scan_id, NULL AS finding_id, 'full_scan_started' AS event_type, 'human' AS actor_type FROM sc UNION ALL "
    "SELECT 'audit_end_' || scan_id, scan_id, NULL, 'full_scan_' || outcome, CASE outcome WHEN 'completed' THEN 'system' ELSE 'human' END FROM sc UNION ALL "
    f"SELECT 'audit_' || finding_id, concat('scan_', workspace_id), finding_id, 'finding_assigned', 'system' FROM ({WORK_IN}) w UNION ALL "
    f"SELECT 'audit_' || review_id, 'scan_all', finding_id, 'review_recorded', 'human' FROM ({REVIEWS_IN}) r",
    "sc AS (SELECT concat('scan_', n_name) AS scan_id, CASE WHEN n_nationkey % 6 = 5 THEN 'failed' ELSE 'completed' END AS outcome FROM nation)",
)
def events_from_scan(spark, directory):
    scans = _run(spark, directory, "SELECT concat('scan_', n_name) AS scan_id, CASE WHEN n_nationkey % 6 = 5 THEN 'failed' ELSE 'completed' END AS outcome FROM nation", "nation")
    work = _work(spark, directory).withColumn("scan_id", F.concat(F.lit("scan_"), "workspace_id"))
    return review.events_from_scan(scans, work, _reviews(spark, directory).withColumn("scan_id", F.lit("scan_all")))


@query("aud_dedupe", "audit_event_id varchar, event_id bigint, event_type varchar",
       f"SELECT audit_event_id, event_id, event_type FROM ({EVENTS_IN}) e QUALIFY row_number() OVER (PARTITION BY audit_event_id ORDER BY event_id) = 1")
def dedupe(spark, directory):
    return review.deduplicate(_events(spark, directory))


@query("aud_newest_first", "event_id bigint, occurred_at timestamp", "SELECT event_id, ts AS occurred_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest(spark, directory):
    return review.newest_first(_events(spark, directory), 50)


@query("aud_third_page", "event_id bigint, occurred_at timestamp", "SELECT event_id, ts AS occurred_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def third_page(spark, directory):
    events, last = _events(spark, directory), None
    for _ in range(2):
        row = review.page_after(events, 50, last).orderBy("occurred_at", "event_id").first()
        last = (row["occurred_at"], row["event_id"])
    return review.page_after(events, 50, last)


@query(
    "aud_recording_summary", "scan_id varchar, recorded bigint, linked_scan bigint, linked_finding bigint, reviews bigint, system_events bigint, human_events bigint, raw_content_exposed boolean, deletion_executed boolean",
    "SELECT scan_id, count(*) AS recorded, count(*) FILTER (object_type = 'scan') AS linked_scan, count(finding_id) AS linked_finding, count(*) FILTER (event_type = 'review_recorded') AS reviews, "
    "count(*) FILTER (k = 'system') AS system_events, count(*) FILTER (k = 'human') AS human_events, bool_or(raw_content_exposed) AS raw_content_exposed, bool_or(deletion_executed) AS deletion_executed "
    f"FROM (SELECT *, coalesce(actor_type, CASE WHEN actor_id = 'system' OR actor_id LIKE 'svc\\_%' ESCAPE '\\' THEN 'system' ELSE 'human' END) AS k FROM ({EVENTS_IN}) e) x GROUP BY scan_id",
)
def recording(spark, directory):
    return review.recording_summary(_events(spark, directory))


_SEARCHED = ["event_type", "actor_id", "actor_type", "object_type", "summary", "finding_id", "scan_id"]


@query(
    "aud_search", "event_id bigint",
    f"SELECT event_id FROM ({EVENTS_IN}) e WHERE contains(lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _SEARCHED) + ")), 'svc_1')",
)
def search(spark, directory):
    return review.search(_events(spark, directory), _SEARCHED, "SVC_1")


@query("aud_finding_timeline", "finding_id varchar, event_id bigint, occurred_at timestamp", f"SELECT finding_id, event_id, occurred_at FROM ({EVENTS_IN}) e WHERE finding_id IS NOT NULL")
def timeline(spark, directory):
    return review.finding_timeline(_events(spark, directory))


# --- evaluation --------------------------------------------------------------------------------
# The golden set: what each form shape must give, read off the rules by hand.
EXPECTED = (
    (), ("email", "person_name", "phone_number"), ("employee_id", "salary_compensation"), ("email", "online_identifier"), ("iban_like", "tax_id"),
    ("national_identifier",), ("device_identifier", "online_identifier"), ("expense_amount",), ("url",), ("account_handle", "email"),
    ("location_data", "online_identifier"), ("passport_number",), ("driver_license", "person_name", "phone_number"), ("payment_card",),
    ("person_name",), ("credential_secret", "organization_identifier"),
)
_EXPECTED_CASE = "CASE k % 16 " + " ".join(f"WHEN {i} THEN {quote('|'.join(t))}" for i, t in enumerate(EXPECTED)) + " END"
CASES = f"""{SIGNALS},
cases AS (SELECT g.doc_id, g.source AS suite, string_split(expected, '|') AS ex, coalesce(s.ac, []) AS ac FROM
  (SELECT {FIRST_FORM_ID} + k AS doc_id, n_name AS source, {_EXPECTED_CASE} AS expected FROM (SELECT c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) f) g
  LEFT JOIN (SELECT doc_id, list(DISTINCT type) AS ac FROM sig GROUP BY 1) s USING (doc_id)),
m AS (SELECT doc_id, suite, list_filter(ex, lambda x: x <> '') AS ex, ac FROM cases),
mm AS (SELECT *, len(list_filter(ex, lambda x: list_contains(ac, x))) AS tp, len(list_filter(ac, lambda x: NOT list_contains(ex, x))) AS fp, len(list_filter(ex, lambda x: NOT list_contains(ac, x))) AS fn FROM m)"""


def _cases(spark, directory):
    forms = _run(spark, directory, f"SELECT k, n_name AS suite, {_EXPECTED_CASE} AS expected FROM (SELECT c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) f", "customer", "nation")
    actual = findings.document_types(signals(spark, directory)).select("doc_id", F.col("types").alias("actual"))
    none = F.array().cast("array<string>")
    expected = F.filter(F.split("expected", r"\|"), lambda t: t != "")
    golden = forms.select((F.col("k") + FIRST_FORM_ID).alias("doc_id"), "suite", expected.alias("expected"))
    return golden.join(actual, "doc_id", "left").withColumn("actual", F.coalesce("actual", none))


_MATCH_SQL = "array_to_string(list_sort(list_filter({}, lambda x: {}list_contains({}, x))), '|')"


@query(
    "evl_case_match", "doc_id bigint, matched varchar, missed varchar, extra varchar, perfect boolean",
    f"SELECT doc_id, {_MATCH_SQL.format('ex', '', 'ac')} AS matched, {_MATCH_SQL.format('ex', 'NOT ', 'ac')} AS missed, {_MATCH_SQL.format('ac', 'NOT ', 'ex')} AS extra, fp = 0 AND fn = 0 AS perfect FROM mm", CASES,
)
def case_match(spark, directory):
    found = evaluate.case_match(_cases(spark, directory))
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("matched", "missed", "extra")], "perfect")


_SCORES = (
    "count(*) AS cases, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (fp = 0 AND fn = 0) AS perfect_cases, "
    "CASE WHEN sum(tp) + sum(fp) = 0 THEN 1 ELSE round(sum(tp) / (sum(tp) + sum(fp)), 6) END AS precision, CASE WHEN sum(tp) + sum(fn) = 0 THEN 1 ELSE round(sum(tp) / (sum(tp) + sum(fn)), 6) END AS recall, "
    "CASE WHEN sum(tp) + sum(fp) = 0 AND sum(tp) + sum(fn) = 0 THEN 1 WHEN sum(tp) = 0 THEN 0 ELSE round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) END AS f1"
)
_SCORE_COLUMNS = "cases bigint, tp bigint, fp bigint, fn bigint, perfect_cases bigint, precision double, recall double, f1 double"


@query("evl_micro_prf", _SCORE_COLUMNS, f"SELECT {_SCORES} FROM mm", CASES)
def micro(spark, directory):
    return evaluate.micro_scores(evaluate.case_match(_cases(spark, directory)))


@query("evl_suite_rollup", "suite varchar, " + _SCORE_COLUMNS, f"SELECT suite, {_SCORES} FROM mm GROUP BY ROLLUP (suite)", CASES)
def suite_rollup(spark, directory):
    return evaluate.micro_scores(evaluate.case_match(_cases(spark, directory)), "suite")


@query("evl_type_rollup", "type varchar, expected_cases bigint, actual_cases bigint",
       "SELECT type, count(*) FILTER (side = 'e') AS expected_cases, count(*) FILTER (side = 'a') AS actual_cases FROM (SELECT unnest(ex) AS type, 'e' AS side FROM mm UNION ALL SELECT unnest(ac), 'a' FROM mm) t GROUP BY type", CASES)
def type_rollup(spark, directory):
    return evaluate.type_rollup(_cases(spark, directory))


@query(
    "evl_confusion", "tp bigint, fp bigint, fn bigint, predicted bigint, actual bigint, evaluated bigint, tn bigint",
    "SELECT tp, fp, fn, tp + fp AS predicted, tp + fn AS actual, n AS evaluated, greatest(0, n - tp - fp - fn) AS tn FROM (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) AS n FROM "
    "(SELECT doc_id, coalesce(quality = 1, false) AS g, EXISTS (SELECT 1 FROM sig s WHERE s.doc_id = d.doc_id) AS p FROM documents d LEFT JOIN labels USING (doc_id)) x) y", SIGNALS,
)
def confusion(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id")
    golden = table(spark, directory, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return evaluate.confusion(golden, signals(spark, directory).join(docs, "doc_id", "left_semi"), docs)


@query(
    "evl_scenario", "family varchar, tp bigint, fp bigint, actual bigint, precision double, recall double, f1 double",
    "SELECT family, tp, fp, actual, p AS precision, r AS recall, round(2 * p * r / nullif(p + r, 0), 3) AS f1 FROM (SELECT family, tp, fp, actual, round(tp / nullif(tp + fp, 0), 3) AS p, round(tp / nullif(actual, 0), 3) AS r FROM ("
    "SELECT source AS family, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g) AS actual FROM "
    "(SELECT source, coalesce(quality = 1, false) AS g, EXISTS (SELECT 1 FROM sig s WHERE s.doc_id = d.doc_id) AS p FROM documents d LEFT JOIN labels USING (doc_id)) x GROUP BY 1) y) z", SIGNALS,
)
def scenario(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", F.col("source").alias("family"))
    golden = table(spark, directory, "labels").select("doc_id", (F.col("quality") == 1).alias("g"))
    predicted = signals(spark, directory).select("doc_id").distinct().withColumn("p", F.lit(True))
    joined = docs.join(golden, "doc_id", "left").join(predicted, "doc_id", "left").fillna(False, ["g", "p"])
    counts = joined.groupBy("family").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if("g").alias("actual"))
    return evaluate.scenario_scores(counts)


@query("evl_review_context", "decisions bigint, open_review_backlog bigint, completion_rate double",
       f"SELECT decisions, open_review_backlog, round(decisions / greatest(decisions + open_review_backlog, 1), 3) AS completion_rate FROM ({_COUNT_SQL}) c", _RV)
def review_context(spark, directory):
    return _counters(spark, directory).withColumn("completion_rate", evaluate.completion_rate(F.col("decisions"), F.col("open_review_backlog")))


@query("evl_risk_progress", "workspace_id varchar, reviewed_high_risk bigint, remaining_high_risk bigint, risk_reduction_rate double",
       "SELECT workspace_id, least(h, d) AS reviewed_high_risk, greatest(0, h - least(h, d)) AS remaining_high_risk, CASE WHEN h > 0 THEN round(least(h, d) / h, 3) ELSE 1 END AS risk_reduction_rate FROM "
       f"(SELECT workspace_id, count(*) FILTER (risk_level = 'high') AS h, count(*) FILTER (o_orderkey % 3 = 0) AS d FROM ({WORK_IN}) w GROUP BY 1) x")
def risk_progress(spark, directory):
    counted = _work(spark, directory).groupBy("workspace_id").agg(F.count_if(F.col("risk_level") == "high").alias("h"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("d"))
    return counted.select("workspace_id", *evaluate.risk_progress(F.col("h"), F.col("d")))


@query("evl_safety", "raw_content_exposed boolean, legal_conclusion_provided boolean, deletion_executed boolean",
       f"SELECT coalesce(bool_or(raw_content_exposed), false) AS raw_content_exposed, false AS legal_conclusion_provided, coalesce(bool_or(deletion_executed), false) AS deletion_executed FROM ({EVENTS_IN}) e")
def safety(spark, directory):
    return evaluate.safety(_events(spark, directory).withColumn("legal_conclusion_provided", F.lit(False)))


@query("evl_reproducibility", "documents bigint, same bigint, share double",
       f"SELECT count(*) AS documents, count(*) FILTER (r IS NULL OR doc_id % 10 <> 3) AS same, round(avg(CASE WHEN r IS NULL OR doc_id % 10 <> 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT doc_id, 1 AS r FROM sig GROUP BY 1) x", SIGNALS)
def reproducibility(spark, directory):
    ordered = F.array_sort(F.collect_list(F.concat_ws(":", "type", "snippet", "start", "end")))
    runs = signals(spark, directory).groupBy("doc_id").agg(short_hash(F.array_join(ordered, ";"), 24).alias("fingerprint"))
    other = F.when(F.col("doc_id") % 10 == 3, F.reverse("fingerprint")).otherwise(F.col("fingerprint"))
    return evaluate.reproducible_share(runs, runs.withColumn("fingerprint", other))


@query(
    "evl_corpus_manifest", "path varchar, state varchar",
    "SELECT concat('doc_', doc_id) AS path, CASE WHEN doc_id % 9 = 4 THEN 'untracked' WHEN doc_id % 9 = 5 THEN 'different' ELSE 'equal' END AS state FROM documents "
    "UNION ALL SELECT concat('gone_', doc_id), 'missing' FROM documents WHERE doc_id % 9 = 4",
)
def corpus_manifest(spark, directory):
    content = F.encode(F.col("text"), "UTF-8")
    docs = table(spark, directory, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("path"), content.alias("content"))
    files = docs.withColumn("length", F.length("content").cast("long"))
    # In the manifest one file in nine went by another name and one had another checksum.
    tracked = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("gone_"), "doc_id")).otherwise(F.col("path"))
    checksum = F.when(F.col("doc_id") % 9 == 5, F.lit("0")).otherwise(F.sha2("content", 256))
    manifest = files.select(tracked.alias("path"), F.col("length").alias("byte_size"), checksum.alias("sha256"))
    return evaluate.manifest_check(files, manifest)


# --- management and planning -------------------------------------------------------------------


def _listed(spark, directory):
    rows = _findings(spark, directory)
    label = manage.source_label(F.col("path"), F.col("source_id"))
    return rows.select("doc_id", "finding_id", F.col("name").alias("file_name"), label.alias("source_label"), F.lower("family").alias("context_category"), "risk_level",
                       F.when(F.col("owner_user_id").isNull(), "unassigned").otherwise("assigned").alias("status"))


@query("qry_findings_filter", "doc_id bigint, risk_level varchar, status varchar",
       "SELECT doc_id, risk_level, status FROM (SELECT doc_id, risk_level, CASE WHEN owner_user_id IS NULL THEN 'unassigned' ELSE 'assigned' END AS status, lower(concat_ws(' ', name, path, family)) AS t FROM fnd) x WHERE contains(t, 'nation_1') AND risk_level = 'high' AND status = 'assigned'", FINDINGS)
def findings_filter(spark, directory):
    return manage.filter_findings(_listed(spark, directory), "Nation_1", "high", "assigned")


_LABEL_PATH = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat(' docs/', page_id) WHEN 2 THEN concat('/srv/', page_id) WHEN 3 THEN concat('source_reference:', page_id) ELSE '' END"


@query("qry_source_label", "page_id bigint, label varchar",
       f"SELECT page_id, CASE WHEN trim(p) = '' OR regexp_matches(trim(p), '^(?i:https?:|/|~/|source_reference:)') THEN CASE WHEN page_id % 2 = 0 THEN 'Web' ELSE 'Source reference hidden' END ELSE trim(p) END AS label FROM (SELECT page_id, {_LABEL_PATH} AS p FROM pages) x")
def source_label(spark, directory):
    name = F.when(F.col("page_id") % 2 == 0, " Web ").otherwise(" ")
    return table(spark, directory, "pages").select("page_id", manage.source_label(F.expr(_LABEL_PATH), name).alias("label"))


@query("qry_page", "finding_id varchar, total bigint, next_offset int",
       "SELECT finding_id, (SELECT count(*) FROM fnd) AS total, CASE WHEN (SELECT count(*) FROM fnd) > 75 THEN 75 END AS next_offset FROM fnd ORDER BY finding_id LIMIT 25 OFFSET 50", FINDINGS)
def paged(spark, directory):
    return manage.page(_listed(spark, directory), ["finding_id"], 25, 50)


@query("qry_top_high_risk", "finding_id varchar, risk_level varchar", "SELECT finding_id, risk_level FROM fnd WHERE risk_level = 'high' ORDER BY finding_id LIMIT 3", FINDINGS)
def top(spark, directory):
    return manage.top_high_risk(_listed(spark, directory), ["finding_id"])


_ADMIN_COLUMNS = "total_files bigint, flagged_files bigint, high_risk bigint, decisions bigint, open_review_backlog bigint, reviewable_findings bigint, completion_rate double, changed_files bigint, missing_files bigint"


@query(
    "qry_admin_aggregation", _ADMIN_COLUMNS,
    "SELECT total_files, flagged_files, high_risk, decisions, open_review_backlog, greatest(flagged_files, decisions + open_review_backlog) AS reviewable_findings, "
    "round(decisions / greatest(flagged_files, decisions + open_review_backlog), 3) AS completion_rate, changed_files, missing_files FROM "
    f"(SELECT sum(total_files)::BIGINT AS total_files, sum(flagged_files)::BIGINT AS flagged_files, sum(high_risk)::BIGINT AS high_risk FROM ({_SCAN_SQL}) s) a, ({_COUNT_SQL}) c, "
    "(SELECT count(*) FILTER (change IN ('new', 'modified')) AS changed_files, count(*) FILTER (change = 'missing') AS missing_files FROM cmp) d",
    f"{FINDINGS}, {_RV}, {DELTA}",
)
def admin_aggregation(spark, directory):
    scan = _scan_summary(spark, directory).agg(*[F.sum(c).alias(c) for c in ("total_files", "flagged_files", "high_risk")])
    changes = _compared(spark, directory).agg(F.count_if(F.col("change").isin("new", "modified")).alias("changed_files"), F.count_if(F.col("change") == "missing").alias("missing_files"))
    return manage.admin_aggregation(scan, _counters(spark, directory), changes)


@query(
    "qry_shared_metrics", "source_id varchar, inventory_files bigint, detected_signals bigint, findings_with_signals bigint, assigned_findings bigint, evidence_cards bigint",
    f"SELECT source_id, total_files AS inventory_files, detected_signals, flagged_files AS findings_with_signals, assigned_findings, flagged_files AS evidence_cards FROM ({_SCAN_SQL}) s", FINDINGS,
)
def shared_metrics(spark, directory):
    found = _scan_summary(spark, directory)
    return found.select("source_id", F.col("total_files").alias("inventory_files"), "detected_signals", F.col("flagged_files").alias("findings_with_signals"), "assigned_findings", F.col("flagged_files").alias("evidence_cards"))


_CANDIDATE = {
    "text_available": "n_chars > 200", "ocr_required": "n_chars % 3 = 0", "hits": "n_chars % 4", "ambiguous": "n_chars % 5 < 3", "redacted": "n_chars % 7 > 0",
    "policy_available": "n_chars % 11 > 0", "owner_available": "n_chars % 13 > 3", "permission_available": "n_chars % 2 = 0", "audit_available": "n_chars % 17 > 0",
}
_CAND_SQL = "SELECT doc_id, text, " + ", ".join(f"{v} AS {k}" for k, v in _CANDIDATE.items()) + " FROM documents"


def _candidates(spark, directory):
    return table(spark, directory, "documents").select("doc_id", "text", *[F.expr(v).alias(k) for k, v in _CANDIDATE.items()])


@query(
    "tier_plan", "doc_id bigint, place int, tier varchar, status varchar",
    "SELECT doc_id, place, tier, CASE tier WHEN 'metadata_inventory' THEN 'enabled' WHEN 'delta_evaluation_metrics' THEN 'enabled' WHEN 'text_layer' THEN CASE WHEN text_available THEN 'ready' ELSE 'skipped' END "
    "WHEN 'ocr' THEN CASE WHEN ocr_required THEN 'deferred' ELSE 'skipped' END WHEN 'grep_rules' THEN CASE WHEN ocr_required AND NOT text_available THEN 'waiting_for_ocr' ELSE 'ready' END "
    "WHEN 'ai_context' THEN CASE WHEN NOT (redacted AND policy_available) THEN 'blocked' WHEN ambiguous AND hits > 0 THEN 'ready' ELSE 'skipped' END "
    "ELSE CASE WHEN CASE tier WHEN 'owner_assignment_boundary' THEN owner_available WHEN 'review_permission_boundary' THEN permission_available WHEN 'audit_recording' THEN audit_available ELSE policy_available END THEN 'ready' ELSE 'blocked' END END AS status "
    f"FROM ({_CAND_SQL}) c, (VALUES " + ", ".join(f"({i}, {quote(t)})" for i, t in enumerate(manage.TIERS)) + ") t(place, tier)",
)
def tier_plan(spark, directory):
    return manage.tier_plan(_candidates(spark, directory), assist_enabled=True, ocr_local=False)


@query("tier_eligible", "doc_id bigint, reject_reason varchar",
       f"SELECT doc_id, CASE WHEN NOT redacted THEN 'not_redacted' WHEN hits <= 0 THEN 'no_anchor' WHEN NOT policy_available THEN 'no_policy' END AS reject_reason FROM ({_CAND_SQL}) c")
def tier_eligible(spark, directory):
    return manage.tier_eligible(_candidates(spark, directory))


def _costs(spark, directory):
    return manage.tier_cost(_candidates(spark, directory), Decimal("0.00000025"), Decimal("0.0000015"), 2000, 300)


_COST_SQL = "SELECT doc_id, least(greatest(1, (length(text) + 3) // 4), 2000) AS prompt_tokens, CAST(least(greatest(1, (length(text) + 3) // 4), 2000) * 0.00000025 + 300 * 0.0000015 AS DECIMAL(18,10)) AS cost FROM documents"


@query("tier_cost", "doc_id bigint, prompt_tokens bigint, micros bigint", f"SELECT doc_id, prompt_tokens, CAST(cost * 100000000 AS BIGINT) AS micros FROM ({_COST_SQL}) c")
def tier_cost(spark, directory):
    return _costs(spark, directory).withColumn("micros", (F.col("cost") * 100000000).cast("long"))


@query(
    "tier_full_cost", "doc_id bigint, prompt_tokens bigint, calls bigint, over_prompt boolean, micros bigint",
    "SELECT doc_id, t AS prompt_tokens, (t + 1999) // 2000 AS calls, t > 2000 AS over_prompt, CAST(CAST(t * 0.00000025 + ((t + 1999) // 2000) * 300 * 0.0000015 AS DECIMAL(18,10)) * 100000000 AS BIGINT) AS micros "
    "FROM (SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS t FROM documents) c",
)
def tier_full_cost(spark, directory):
    costs = manage.tier_full_cost(_candidates(spark, directory), Decimal("0.00000025"), Decimal("0.0000015"), 2000, 300)
    return costs.withColumn("micros", (F.col("cost") * 100000000).cast("long"))


@query("tier_budget", "doc_id bigint, admitted boolean", f"SELECT doc_id, sum(cost) OVER (ORDER BY doc_id) <= 0.4 AS admitted FROM ({_COST_SQL}) c")
def tier_budget(spark, directory):
    return manage.tier_budget(_costs(spark, directory).select("doc_id", "cost"), Decimal("0.4"))
