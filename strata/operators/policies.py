"""The default policies: ordered rules over the flat columns of an attempt.

A policy is a list of rows, so a caller puts rules of their own before or in
place of these and evaluates them the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.rules import PolicyRule, evaluate

Rule = tuple[str, int, str, str, str, str]  # name, priority, condition, action, code, profile

_WRITES = "(writes_repo OR writes_filesystem OR writes_coord)"
_UNLISTED = "NOT default_allowed AND NOT allowlisted"
_OTHER_EDITS = "claim_exists AND NOT same_agent AND claim_mode = 'editing'"

# The rules on claims of an entity.
CLAIM_RULES: tuple[Rule, ...] = (
    ("ProtectedEntity", 0, "protected AND attempt_mode = 'editing'", "HardBlock", "protected_entity", ""),
    ("SameAgentClaim", 5, "claim_exists AND same_agent", "Allow", "same_agent", ""),
    ("ActiveConflictHardBlock", 10, f"{_OTHER_EDITS} AND owner_alive AND conflict_mode = 'hard_block'", "HardBlock", "editing_conflict", ""),
    ("ActiveConflictSoftBlock", 20, f"{_OTHER_EDITS} AND owner_alive AND conflict_mode = 'soft_block'", "SoftBlock", "editing_conflict", ""),
    ("ActiveConflictAdvisory", 30, f"{_OTHER_EDITS} AND owner_alive AND conflict_mode = 'advisory'", "Advisory", "editing_conflict", ""),
    ("StaleConflict", 40, f"{_OTHER_EDITS} AND NOT owner_alive", "ReclaimSuggested", "stale_claim_owner", ""),
    ("DefaultAllow", 999, "TRUE", "Allow", "allow", ""),
)

# The rules on local commands.
ACTION_RULES: tuple[Rule, ...] = (
    ("DestructiveAction", 0, "destructive AND NOT allowlisted", "HardBlock", "destructive_action", "blocked"),
    ("ConflictingEntityWrite", 5, "writes_repo AND coord_active AND conflicting_claims > 0", "HardBlock", "conflicting_claim", "blocked"),
    ("StaleAgentWrite", 6, "writes_repo AND coord_active AND heartbeat_age > 120", "HardBlock", "stale_agent", "blocked"),
    ("RepoRequired", 10, "requires_repo AND NOT repo_present", "HardBlock", "repo_required", "blocked"),
    ("ActiveAgentRequired", 20, "writes_repo AND require_active_agent AND NOT active_agent", "HardBlock", "active_agent_required", "blocked"),
    ("GovernedSubprocessAllowlist", 25, f"guard_mode = 'enforce' AND origin <> '' AND {_UNLISTED}", "HardBlock", "governed_subprocess_not_allowlisted", "blocked"),
    ("AllowlistEnforced", 30, f"guard_mode = 'enforce' AND {_UNLISTED}", "HardBlock", "not_allowlisted", "blocked"),
    ("UnreadConflictsWrite", 35, "writes_repo AND coord_active AND unread_conflicts > 0", "Advisory", "unread_conflicts", "repo_write"),
    ("PresenceOverlapWrite", 36, "writes_filesystem AND coord_active AND presence_overlap > 0", "Advisory", "presence_overlap", "repo_write"),
    ("WatchedEntityWrite", 37, "writes_repo AND coord_active AND watching_claims > 0", "Advisory", "watched_entity", "repo_write"),
    ("AdvisoryReadOnly", 40, f"guard_mode = 'advisory' AND {_UNLISTED} AND NOT {_WRITES} AND NOT network", "Advisory", "not_allowlisted", "read_only"),
    ("AdvisoryRepoWrite", 41, f"guard_mode = 'advisory' AND {_UNLISTED} AND {_WRITES} AND NOT network", "Advisory", "not_allowlisted", "repo_write"),
    ("AdvisoryNetworkRead", 42, f"guard_mode = 'advisory' AND {_UNLISTED} AND NOT {_WRITES} AND network", "Advisory", "not_allowlisted", "network_read"),
    ("AdvisoryRepoWriteNetwork", 43, f"guard_mode = 'advisory' AND {_UNLISTED} AND {_WRITES} AND network", "Advisory", "not_allowlisted", "repo_write_network"),
    ("AllowReadOnly", 900, f"NOT {_WRITES} AND NOT network", "Allow", "allow", "read_only"),
    ("AllowRepoWrite", 910, f"{_WRITES} AND NOT network", "Allow", "allow", "repo_write"),
    ("AllowNetworkRead", 920, f"NOT {_WRITES} AND network", "Allow", "allow", "network_read"),
    ("AllowRepoWriteNetwork", 930, f"{_WRITES} AND network", "Allow", "allow", "repo_write_network"),
    ("DefaultAllow", 999, "TRUE", "Allow", "allow", "read_only"),
)

# The rules on child agents.
SPAWN_RULES: tuple[Rule, ...] = (
    ("MissingCommand", 0, "NOT command_present", "HardBlock", "missing_command", "blocked"),
    ("ActiveAgentRequired", 10, "NOT active_agent", "HardBlock", "active_agent_required", "blocked"),
    ("MissingName", 20, "NOT name_present", "HardBlock", "missing_name", "blocked"),
    ("ActionBlocked", 30, "action_hard_block", "HardBlock", "action_blocked", "blocked"),
    ("InvalidRequestedProfile", 40, "requested_profile <> '' AND NOT requested_valid", "HardBlock", "invalid_profile", "blocked"),
    ("InvalidRuntime", 45, "NOT runtime_valid", "HardBlock", "invalid_runtime", "blocked"),
    ("RequestedProfileTooNarrow", 50, "NOT selected_valid", "HardBlock", "profile_too_narrow", "blocked"),
    ("ParentProfileEscalation", 60, "parent_known AND escalates_parent", "HardBlock", "profile_escalation", "blocked"),
    ("AdvisoryReadOnly", 900, "action_advisory AND selected_profile = 'read_only'", "Advisory", "spawn_allowed", "read_only"),
    ("AdvisoryRepoWrite", 901, "action_advisory AND selected_profile = 'repo_write'", "Advisory", "spawn_allowed", "repo_write"),
    ("AdvisoryNetworkRead", 902, "action_advisory AND selected_profile = 'network_read'", "Advisory", "spawn_allowed", "network_read"),
    ("AdvisoryRepoWriteNetwork", 903, "action_advisory AND selected_profile = 'repo_write_network'", "Advisory", "spawn_allowed", "repo_write_network"),
    ("AllowReadOnly", 950, "selected_profile = 'read_only'", "Allow", "spawn_allowed", "read_only"),
    ("AllowRepoWrite", 951, "selected_profile = 'repo_write'", "Allow", "spawn_allowed", "repo_write"),
    ("AllowNetworkRead", 952, "selected_profile = 'network_read'", "Allow", "spawn_allowed", "network_read"),
    ("AllowRepoWriteNetwork", 953, "selected_profile = 'repo_write_network'", "Allow", "spawn_allowed", "repo_write_network"),
)

# What follows a command that has run; all that hold take effect.
EFFECT_RULES: tuple[Rule, ...] = (
    ("PublishGitCommitToFeed", 10, "program = 'git' AND subcommand = 'commit' AND exit_code = 0", "publish_commit_to_feed", "effect_publish_commit", "effect"),
    ("PublishGitMergeToFeed", 11, "program = 'git' AND subcommand = 'merge' AND exit_code = 0", "publish_commit_to_feed", "effect_publish_commit", "effect"),
    ("PublishGitRebaseToFeed", 12, "program = 'git' AND subcommand = 'rebase' AND exit_code = 0", "publish_commit_to_feed", "effect_publish_commit", "effect"),
    ("RegisterReadPresence", 20, "NOT writes_filesystem AND coord_active AND files_touched > 0 AND exit_code = 0", "register_presence", "effect_register_presence", "effect"),
    ("RefreshHeartbeat", 100, "coord_active AND exit_code = 0", "refresh_heartbeat", "effect_refresh_heartbeat", "effect"),
)


def policy_rules(rules: tuple[Rule, ...]) -> list[PolicyRule]:
    return [PolicyRule(name, priority, when, action) for name, priority, when, action, _, _ in rules]


def decide(attempts: DataFrame, rules: tuple[Rule, ...], overridden: dict[str, bool] | None = None) -> DataFrame:
    """attempts with action, rule, code, profile and trace; ``overridden`` switches rules off by name."""
    rules = tuple(r for r in rules if (overridden or {}).get(r[0], True))
    decided = evaluate(attempts, policy_rules(rules), "none")
    for i, name in ((4, "code"), (5, "profile")):
        pairs = [F.lit(x) for r in rules for x in (r[0], r[i])]
        decided = decided.withColumn(name, F.element_at(F.create_map(*pairs), F.col("rule")))
    return decided
