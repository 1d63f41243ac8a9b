"""Command lines classified by what they touch, and the runtime profiles that they need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import stripped

#: The command line of the engine itself, which a caller can name otherwise.
OWN_PROGRAM = "strata"

# Programs by effect.
READ_ONLY = (
    "cat", "date", "env", "false", "find", "git-status", "grep", "head", "less", "ls", "printenv", "printf", "pwd", "rg", "tail", "true",
    "uname", "wc", "whoami",
)
NETWORK = ("curl", "wget", "scp", "ssh")
GIT_READS = ("status", "diff", "log", "show", "grep", "blame", "rev-parse")
GIT_WRITES = (
    "add", "reset", "checkout", "switch", "restore", "clean", "rm", "mv", "commit", "merge", "rebase", "cherry-pick", "revert", "stash",
    "apply", "am", "branch", "tag",
)
OWN_READS = ("version", "status", "log", "show", "blame", "diff", "reflog", "grep", "shortlog", "verify", "coord", "coordd", "workon")
OWN_COORDINATES = ("coord", "coordd", "workon")
OWN_WRITES = (
    "add", "reset", "rm", "commit", "branch", "tag", "checkout", "switch", "merge", "conflicts", "cherrypick", "revert", "remote", "config",
    "publish", "gc", "stash", "rebase", "sparse-checkout", "lfs", "bisect", "worktree", "clean", "module", "workspace",
)
CLEAN_FORCED = ("-f", "-fd", "-fdx", "-xdf")
EVERYTHING = (".", "./", "/", "/*")
# The scopes of a profile, from least to most.
FILESYSTEM = ("repo_ro", "repo_rw", "host_process")
NETWORKS = ("deny", "allow", "ambient")
DELETES = ("none", "repo_only", "ambient")
PROFILES = {
    "blocked": ("", "deny", "none", False),
    "read_only": ("repo_ro", "deny", "none", False),
    "repo_write": ("repo_rw", "deny", "repo_only", True),
    "network_read": ("repo_ro", "allow", "none", False),
    "repo_write_network": ("repo_rw", "allow", "repo_only", True),
}


def selector(kind: str, argv: Column) -> Column:
    words = F.filter(F.transform(argv, lambda x: stripped(x)), lambda x: x != "")
    return F.concat(F.lit(kind + ":"), F.array_join(words, " "))


def _has(args: Column, *wanted: str) -> Column:
    return F.arrays_overlap(args, F.array(*map(F.lit, wanted)))


def inspect(argv: Column, own: str = OWN_PROGRAM) -> Column:
    """struct of program, subcommand, selector, and what the command line does."""
    no = F.lit(False)
    program = F.coalesce(F.regexp_extract(F.get(argv, F.lit(0)), "([^/]+)/*$", 1), F.lit(""))
    args = F.when(F.size(argv) > 1, F.slice(argv, 2, 1 << 20)).otherwise(F.array().cast("array<string>"))
    first = F.get(args, F.lit(0))
    plain = F.filter(args, lambda x: ~x.startswith("-") & (x != ""))
    is_own, is_git = program == own, program == "git"
    sub = F.coalesce(F.when(is_own, first).otherwise(F.get(plain, F.lit(0))), F.lit(""))
    bare = F.size(args) == 0
    in_place = F.exists(args, lambda x: x.startswith("-i"))
    rest = F.when(F.size(args) > 1, F.slice(args, 2, 1 << 20)).otherwise(F.array().cast("array<string>"))

    reads = (
        F.when(is_git, bare | sub.isin(*GIT_READS))
        .when(is_own, bare | sub.isin(*OWN_READS, "init", "clone"))
        .when(program == "sed", ~in_place)
        .otherwise(program.isin(*READ_ONLY))
    )
    network = F.when(is_git | is_own, ~bare & sub.isin("fetch", "push", "pull")).otherwise(program.isin(*NETWORK))
    known_own = (*OWN_READS, *OWN_WRITES, "init", "clone", "fetch", "push", "pull")
    repo = F.when(is_git, ~bare & ~sub.isin(*GIT_READS)).when(is_own, ~bare & ~sub.isin(*OWN_READS, "init", "clone")).otherwise(no)
    writes_repo = (
        F.when(is_git, repo & (sub != "fetch")).when(is_own, ~bare & sub.isin(*OWN_WRITES, "push", "pull")).otherwise(no)
    )
    writes_files = (
        F.when(is_git, no).when(is_own, ~bare & (sub.isin("init", "clone") | ~sub.isin(*known_own)))
        .when(program == "sed", in_place).otherwise(~program.isin(*READ_ONLY, *NETWORK))
    )
    removes = F.exists(args, lambda x: (x.startswith("-") & x.contains("r") & x.contains("f")) | x.isin(*EVERYTHING))
    git_destroys = (
        F.when(sub == "reset", _has(rest, "--hard")).when(sub == "clean", _has(rest, *CLEAN_FORCED))
        .when(sub == "checkout", _has(rest, "--")).when(sub == "restore", _has(rest, "--worktree", "--staged")).otherwise(no)
    )
    destroys = F.when(program == "rm", removes).when(is_git, git_destroys).otherwise(no)
    some = F.size(argv) > 0
    flags = {
        "default_allowed": reads, "writes_filesystem": writes_files, "writes_repo": writes_repo, "writes_coord": is_own & sub.isin(*OWN_COORDINATES),
        "network": network, "requires_repo": repo, "destructive": destroys,
    }
    return F.struct(
        program.alias("program"), F.when(some, sub).otherwise("").alias("subcommand"), selector("shell", argv).alias("selector"),
        *((some & F.coalesce(c, no)).alias(n) for n, c in flags.items()),
    )


def files_of(argv: Column, own: str = OWN_PROGRAM) -> Column:
    """The paths that a command line names, for the few programs whose arguments are paths."""
    program = F.regexp_extract(F.get(argv, F.lit(0)), "([^/]+)/*$", 1)

    def paths(skip: int) -> Column:
        rest = F.when(F.size(argv) >= skip, F.slice(argv, skip, 1 << 20)).otherwise(F.array().cast("array<string>"))
        return F.filter(rest, lambda x: ~x.startswith("-"))

    sub = F.get(argv, F.lit(1))
    return (
        F.when((program == "git") & sub.isin("add", "checkout", "restore"), paths(3))
        .when((program == own) & (sub == "add"), paths(3))
        .when(program.isin("touch", "rm", "cp", "mv"), paths(2))
        .otherwise(F.array().cast("array<string>"))
    )


def profile_for(action: Column) -> Column:
    """The name of the least profile under which an inspected action can run."""
    writes = action["writes_repo"] | action["writes_filesystem"] | action["writes_coord"]
    return F.when(action["network"], F.when(writes, "repo_write_network").otherwise("network_read")).otherwise(F.when(writes, "repo_write").otherwise("read_only"))


def rank(scope: Column, scopes: tuple[str, ...]) -> Column:
    """1 for the least scope; 0 for one that is not listed."""
    return F.array_position(F.array(*map(F.lit, scopes)), F.coalesce(scope, F.lit(""))).cast("int")


def profile(name: Column) -> Column:
    """struct<filesystem, network, deletes, snapshot> of a named profile."""
    found = F.lit(None).cast("struct<filesystem:string,network:string,deletes:string,snapshot:boolean>")
    for key, values in PROFILES.items():
        named = F.struct(*(F.lit(v).alias(n) for v, n in zip(values, ("filesystem", "network", "deletes", "snapshot"), strict=True)))
        found = F.when(name == key, named).otherwise(found)
    return found


def profile_allows(granted: Column, required: Column) -> Column:
    """Whether each scope of ``granted`` is at least that of ``required``."""
    held = F.lit(True)
    for field, scopes in (("filesystem", FILESYSTEM), ("network", NETWORKS), ("deletes", DELETES)):
        held = held & (rank(granted[field], scopes) >= rank(required[field], scopes))
    return held
