"""The default policies over attempts that the driver's tables make up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import policies as P
from strata.operators.rules import all_effects
from strata.plans.registry import query, table


def _chain(rules: tuple[P.Rule, ...], column: int) -> str:
    """The first rule's value, as SQL states it: conditions in the order of their priority."""
    return "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[column]}'" for r in sorted(rules, key=lambda r: (r[1], r[0]))) + " END"


CLAIM_INPUTS = {
    "protected": "k % 17 = 0", "attempt_mode": "CASE WHEN k % 3 = 0 THEN 'watching' ELSE 'editing' END", "claim_exists": "k % 4 <> 0", "same_agent": "c % 5 = 0",
    "claim_mode": "CASE WHEN c % 7 = 0 THEN 'watching' ELSE 'editing' END", "owner_alive": "c % 3 <> 0",
    "conflict_mode": "CASE k % 11 % 4 WHEN 0 THEN 'hard_block' WHEN 1 THEN 'soft_block' WHEN 2 THEN 'advisory' ELSE 'off' END",
}
ACTION_INPUTS = {
    "destructive": "k % 19 = 0", "allowlisted": "k % 5 = 0", "default_allowed": "c % 6 = 0", "writes_repo": "k % 3 = 0", "writes_filesystem": "k % 7 = 0",
    "writes_coord": "k % 13 = 0", "network": "c % 4 = 0", "requires_repo": "k % 3 = 0 OR c % 9 = 0", "repo_present": "k % 23 <> 0",
    "require_active_agent": "c % 2 = 0", "active_agent": "c % 10 <> 0", "origin": "CASE WHEN c % 5 = 0 THEN 'spawn' ELSE '' END",
    "guard_mode": "CASE k % 4 WHEN 0 THEN 'enforce' WHEN 1 THEN 'advisory' ELSE 'off' END", "coord_active": "c % 3 = 0",
    "conflicting_claims": "c % 21 // 20", "heartbeat_age": "k % 130", "unread_conflicts": "c % 6 // 5 + c % 15 // 14", "presence_overlap": "k % 14 // 13",
    "watching_claims": "k % 2", "program": "CASE WHEN c % 2 = 0 THEN 'git' ELSE 'ls' END",
    "subcommand": "CASE k % 5 WHEN 0 THEN 'commit' WHEN 1 THEN 'merge' WHEN 2 THEN 'rebase' ELSE 'log' END", "exit_code": "k % 6 // 4", "files_touched": "c % 4",
}
SPAWN_INPUTS = {
    "command_present": "k % 29 <> 0", "active_agent": "k % 23 <> 0", "name_present": "k % 19 <> 0", "action_hard_block": "c % 17 = 0",
    "requested_profile": "CASE WHEN c % 3 = 0 THEN 'x' ELSE '' END", "requested_valid": "c % 6 <> 0", "runtime_valid": "k % 13 <> 0", "selected_valid": "c % 11 <> 0",
    "parent_known": "k % 2 = 0", "escalates_parent": "k % 7 = 0", "action_advisory": "c % 4 = 1",
    "selected_profile": "CASE k % 5 WHEN 0 THEN 'read_only' WHEN 1 THEN 'repo_write' WHEN 2 THEN 'network_read' WHEN 3 THEN 'repo_write_network' ELSE 'other' END",
}


def _input_sql(inputs: dict[str, str]) -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in inputs.items())
    return f"WITH i AS (SELECT k, {columns} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"


def _inputs(spark: SparkSession, sf_dir: str, inputs: dict[str, str]) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.select("k", *(F.expr(sql.replace("//", "DIV")).alias(name) for name, sql in inputs.items()))


def _decided_sql(inputs: dict[str, str], rules: tuple[P.Rule, ...]) -> str:
    names = (("action", 3), ("rule", 0), ("code", 4), ("profile", 5))
    return f"{_input_sql(inputs)} SELECT k, {', '.join(f'{_chain(rules, i)} AS {n}' for n, i in names)} FROM i"


@query(_decided_sql(CLAIM_INPUTS, P.CLAIM_RULES))
def default_claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of entities decided by the seven default rules."""
    return P.decide(_inputs(spark, sf_dir, CLAIM_INPUTS), P.CLAIM_RULES).select("k", "action", "rule", "code", "profile")


@query(_decided_sql(ACTION_INPUTS, P.ACTION_RULES))
def default_action_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local commands decided by the nineteen default rules."""
    return P.decide(_inputs(spark, sf_dir, ACTION_INPUTS), P.ACTION_RULES).select("k", "action", "rule", "code", "profile")


@query(_decided_sql(SPAWN_INPUTS, (*P.SPAWN_RULES, ("x", 1000, "TRUE", "none", "x", "x"))).replace("THEN 'x'  END", "END").replace("'x' END", "NULL END"))
def default_spawn_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child agents decided by the sixteen default rules; none may hold."""
    return P.decide(_inputs(spark, sf_dir, SPAWN_INPUTS), P.SPAWN_RULES).select(
        "k", "action", *(F.col(c) for c in ("rule", "code", "profile"))
    )


@query(_input_sql(ACTION_INPUTS) + " UNION ALL ".join(f" SELECT k, '{r[0]}' AS rule, '{r[3]}' AS effect FROM i WHERE {r[2]}" for r in P.EFFECT_RULES))
def default_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every effect that follows a command which has run."""
    return all_effects(_inputs(spark, sf_dir, ACTION_INPUTS), P.policy_rules(P.EFFECT_RULES)).select("k", "rule", "effect")


@query(_decided_sql(CLAIM_INPUTS, tuple(r for r in P.CLAIM_RULES if r[0] != "ProtectedEntity")))
def overridden_claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules with one switched off."""
    attempts = _inputs(spark, sf_dir, CLAIM_INPUTS)
    return P.decide(attempts, P.CLAIM_RULES, {"ProtectedEntity": False}).select("k", "action", "rule", "code", "profile")
