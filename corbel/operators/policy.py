"""The fail-closed policy lattice: controls, findings, evidence and rules fold to the most restrictive disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import RANK, unrank

# Finding categories that a policy knows: fixed values.
CATEGORIES = ("direct_prompt_injection", "indirect_prompt_injection", "obfuscation", "hidden_content", "source_mismatch", "stale_evidence", "contradiction", "parser_risk", "policy_failure", "other")
CONTRIBUTION = "subject, disposition rank, reason"


def _rows(df: DataFrame, rank: Column, reason: Column) -> DataFrame:
    return df.select("subject", rank.cast("int").alias("rank"), reason.cast("string").alias("reason"))


def from_controls(controls: DataFrame) -> DataFrame:
    """``(subject, required, class, status)``: a required control that did not pass blocks, one about evidence asks for review."""
    optional = ~F.col("required") | (F.col("class") == "optional")
    code = F.concat(F.lit("REQUIRED_"), F.upper("class"), F.lit("_CONTROL_"), F.upper("status"))
    return _rows(controls.where("status <> 'pass'"), F.when(optional, 0).when(F.col("class") == "evidence", 1).otherwise(2), F.when(optional, "OPTIONAL_CONTROL_UNAVAILABLE").otherwise(code))


def from_findings(findings: DataFrame) -> DataFrame:
    """``(subject, category, severity)``: medium asks for review, high and critical block, and so does what is not known."""
    known, s = F.col("category").isin(*CATEGORIES), F.col("severity")
    rank = F.when(~known, 2).when(s.isin("info", "low"), 0).when(s == "medium", 1).otherwise(2)
    reason = F.when(~known, "UNKNOWN_FINDING_CATEGORY").when(s.isin("medium", "high", "critical"), F.concat(F.lit("FINDING_"), F.upper(s))).when(~s.isin("info", "low"), "UNKNOWN_FINDING_SEVERITY")
    return _rows(findings, rank, reason)


def from_evidence(evidence: DataFrame) -> DataFrame:
    """``(subject, required, minimum_bps, claim_bps array, material_conflict)``."""
    low = F.exists("claim_bps", lambda x: x < F.col("minimum_bps"))
    codes = F.array_compact(F.array(F.when(low, "EVIDENCE_BELOW_THRESHOLD"), F.when(F.col("material_conflict"), "MATERIAL_CONFLICT_UNRESOLVED")))
    return _rows(evidence.where("required").withColumn("reason", F.explode(codes)), F.lit(1), F.col("reason"))


def from_rules(rules: DataFrame) -> DataFrame:
    """``(subject, action, reason_code, layer)``: an action outside the lattice blocks; an allow of a lower layer matches but adds nothing."""
    known = F.col("action").isin(*RANK)
    weak = (F.col("layer") != "platform") & (F.col("action") == "allow")
    rank = F.when(~known, 2).when(F.col("action") == "block", 2).when(F.col("action") == "review", 1).otherwise(0)
    return _rows(rules, rank, F.when(~known, "UNKNOWN_POLICY_ACTION").when(~weak, F.col("reason_code")))


def from_availability(subjects: DataFrame) -> DataFrame:
    """``(subject, available)``: without a policy everything is blocked."""
    return _rows(subjects.where("not available"), F.lit(2), F.lit("POLICY_NO_MATCH"))


def evaluate(subjects: DataFrame, *contributions: DataFrame) -> DataFrame:
    """Each subject's disposition and sorted distinct reasons; subjects without a contribution are allowed."""
    every = contributions[0]
    for c in contributions[1:]:
        every = every.unionByName(c)
    folded = every.groupBy("subject").agg(F.max("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return subjects.select("subject").join(folded, "subject", "left").select("subject", unrank(F.coalesce("rank", F.lit(0))).alias("disposition"), F.coalesce("reasons", F.lit("")).alias("reason_codes"))


def merge_model(deterministic: Column, model: Column, model_valid: Column) -> Column:
    """A model's view never weakens a block; without a valid answer at least review."""
    fallback = F.when(model_valid, model).otherwise(F.lit("review"))
    rank = lambda c: F.when(c == "block", 2).when(c == "review", 1).otherwise(0)
    return F.when(deterministic == "block", "block").otherwise(unrank(F.greatest(rank(deterministic), rank(fallback))))


def next_policy_state(state: Column, target: Column) -> Column:
    """``accepted`` if a policy version may move so, else ``rejected``: draft, approved, active, then superseded, or rolled back and active again."""
    legal = ((state == "draft") & (target == "approved")) | ((state == "approved") & (target == "active")) | ((state == "active") & target.isin("superseded", "rolled_back")) | ((state == "rolled_back") & (target == "active"))
    return F.when(legal, "accepted").otherwise("rejected")


def review_outcome(priority: Column, approvals: Column) -> Column:
    """High priority needs two different approvers, others one."""
    n = F.size(F.array_distinct(approvals))
    return F.when(n >= F.when(priority == "high", 2).otherwise(1), "approved").otherwise("pending")
