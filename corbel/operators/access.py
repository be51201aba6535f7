"""Who may do what: grants, role tables, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles and their actions: fixed values.
ACTIONS = (
    "workspace.read", "workspace.update", "workspace.delete", "membership.read", "membership.invite", "membership.manage", "service_account.manage", "scan.create", "scan.read", "scan.process", "finding.read",
    "finding.write", "evidence.read", "evidence.write", "review.resolve", "policy.read", "policy.write", "policy.promote", "capsule.read", "audit.read", "audit.export", "integration.manage", "key.manage",
)
READ = ("workspace.read", "scan.read", "finding.read", "evidence.read", "policy.read", "capsule.read")
PERMISSIONS = {
    "owner": ACTIONS,
    "admin": tuple(a for a in ACTIONS if a != "workspace.delete"),
    "policy_manager": (*READ, "scan.create", "review.resolve", "policy.write", "policy.promote"),
    "reviewer": (*READ, "review.resolve"),
    "analyst": (*READ, "scan.create"),
    "auditor": (*READ, "audit.read", "audit.export"),
    "ingestion_service": ("workspace.read", "scan.create", "scan.read"),
    "scan_worker": ("workspace.read", "scan.read", "scan.process", "finding.write", "evidence.read", "policy.read"),
    "evidence_worker": ("workspace.read", "scan.read", "evidence.read", "evidence.write", "finding.read"),
    "integration_client": ("workspace.read", "scan.create", "scan.read", "finding.read", "evidence.read", "capsule.read"),
    "audit_exporter": ("workspace.read", "audit.read", "audit.export"),
}
ROLE_ORDER = ("owner", "admin", "policy_manager", "reviewer", "analyst", "auditor")


def matrix(spark: SparkSession) -> DataFrame:
    """``(role, action)`` of all permissions."""
    return spark.createDataFrame([(r, a) for r, acts in PERMISSIONS.items() for a in acts], "role string, action string")


def permitted(role: Column, action: Column) -> Column:
    out = F.lit(False)
    for r, acts in PERMISSIONS.items():
        out = out | ((role == r) & action.isin(*acts))
    return out


def decision(workspace: Column, requested: Column, status: Column, current: Column, presented: Column, role: Column, action: Column) -> Column:
    """The first reason to deny, or ALLOW."""
    return (
        F.when(role.isNull(), "MISSING_GRANT").when(~workspace.eqNullSafe(requested), "WORKSPACE_MISMATCH").when(status != "active", "INACTIVE_GRANT").when(current != presented, "STALE_GRANT").when(~permitted(role, action), "ROLE_DENIED").otherwise("ALLOW")
    )


def role_rank(role: Column) -> Column:
    out = F.when(role == ROLE_ORDER[0], 0)
    for k, r in enumerate(ROLE_ORDER[1:], 1):
        out = out.when(role == r, k)
    return out.otherwise(len(ROLE_ORDER))


def last_owner_guard(members: DataFrame, workspace: str, role: str, status: str) -> DataFrame:
    """``removable``: an active owner may go only if the workspace has another one."""
    owners = members.where((F.col(role) == "owner") & (F.col(status) == "active")).groupBy(workspace).agg(F.count("*").alias("owners"))
    own = (F.col(role) == "owner") & (F.col(status) == "active")
    return members.join(owners, workspace, "left").withColumn("removable", ~own | (F.coalesce("owners", F.lit(0)) > 1)).drop("owners")


def scopes_valid(scopes: Column) -> Column:
    """1 to 32 scopes, all of them known actions."""
    return F.coalesce(F.size(scopes).between(1, 32) & (F.size(F.array_except(scopes, F.array(*map(F.lit, ACTIONS)))) == 0), F.lit(False))
