"""Ordered rules as rows: patterns over paths, and prioritised policies.

Rule lists are configuration: they are compiled on the driver into one
expression per rule, so a pass over any number of paths needs neither a join nor
a shuffle, and all rules of a row are evaluated in one stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import glob_regex


@dataclass(frozen=True)
class PathRule:
    """A line of an ignore file: ! negates, a trailing / matches directories, a leading or inner / anchors."""

    line: str

    @property
    def negated(self) -> bool:
        return self.line.startswith("!")

    def matches(self, path: Column) -> Column:
        body = self.line.removeprefix("!")
        directory = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        inner = glob_regex(body.lstrip("/"))[1:-1]
        start = "^" if anchored else "(?:^|/)"
        end = "/" if directory else "(?:/|$)"
        return path.rlike(f"{start}{inner}{end}")


@dataclass(frozen=True)
class IgnoreRule:
    """A line of an ignore file.

    ! negates.  With a trailing / the rule names a folder, literally: the path
    itself, or any folder above it, or (without a leading /) any part of the path.
    All others are globs, of the whole path where they have a slash, else of its
    last part.
    """

    line: str

    @property
    def negated(self) -> bool:
        return self.line.startswith("!")

    def matches(self, path: Column) -> Column:
        body = self.line.removeprefix("!")
        rooted, folder = body.startswith("/"), body.endswith("/")
        body = body.strip("/")
        if folder:
            above = (path == body) | path.startswith(body + "/")
            return above if rooted or "/" in body else above | F.array_contains(F.split(path, "/"), body)
        whole = rooted or "/" in body
        return (path if whole else F.substring_index(path, "/", -1)).rlike(glob_regex(body))


#: What no file has to name: the folders of version control.
BUILT_IN = (".git",)


def ignore_rules(lines: Sequence[str], built_in: Sequence[str] = BUILT_IN, modules: Sequence[str] = ()) -> list[IgnoreRule]:
    """The rules of an ignore file's lines, after what is built in and before the folders of modules."""
    own = [line.strip() for line in lines]
    return [IgnoreRule(x) for x in (*built_in, *(x for x in own if x and not x.startswith("#")), *(f"{m}/" for m in modules))]


def last_match(path: Column, rules: Sequence[PathRule | IgnoreRule]) -> Column:
    """Number from 1 of the last rule that matches, null if none does."""
    return F.greatest(F.lit(None).cast("int"), *(F.when(r.matches(path), F.lit(i)) for i, r in enumerate(rules, 1)))


def all_matches(path: Column, rules: Sequence[PathRule | IgnoreRule]) -> Column:
    """Numbers from 1 of every rule that matches, in order."""
    return F.array_compact(F.array(*(F.when(r.matches(path), F.lit(i)) for i, r in enumerate(rules, 1))))


def ignored(path: Column, rules: Sequence[PathRule | IgnoreRule]) -> Column:
    """Whether the last matching rule is not a negated one."""
    last = last_match(path, rules)
    kept = [i for i, r in enumerate(rules, 1) if r.negated]
    return F.coalesce(~last.isin(kept) if kept else last.isNotNull(), F.lit(False))


def in_cone(path: Column, patterns: Sequence[str]) -> Column:
    """Sparse selection: top-level files always; else the last pattern that matches decides."""
    rules = [PathRule(p) for p in patterns]
    return ~path.contains("/") | ignored(path, rules)


def attribute(path: Column, rules: Sequence[tuple[str, dict[str, str]]], key: str) -> Column:
    """The value that the last rule which matches the path and sets the key gives it."""
    value = F.lit(None).cast("string")
    for pattern, values in rules:
        if key in values:
            value = F.when(PathRule(pattern).matches(path), F.lit(values[key])).otherwise(value)
    return value


def owners(path: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The owners of all rules that match, each once, in the order of the rules."""
    none = F.array().cast("array<string>")
    lists = [F.when(PathRule(p).matches(path), F.array(*map(F.lit, names))).otherwise(none) for p, names in rules]
    return F.array_distinct(F.concat(*lists)) if lists else none


@dataclass(frozen=True)
class PolicyRule:
    name: str
    priority: int
    when: str  # a SQL condition over the input's columns
    action: str


def evaluate(inputs: DataFrame, rules: Sequence[PolicyRule], default: str) -> DataFrame:
    """inputs with action and rule: of the rules that hold the one of least priority, ties by name.

    ``trace`` lists every rule that holds, in that order; ``default`` stands
    where none does.
    """
    outcome = [
        F.when(F.coalesce(F.expr(r.when), F.lit(False)), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")))
        for r in rules
    ]
    held = F.array_sort(F.array_compact(F.array(*outcome)))
    first = F.get(F.col("_held"), F.lit(0))
    return (
        inputs.withColumn("_held", held)
        .withColumn("action", F.coalesce(first["action"], F.lit(default)))
        .withColumn("rule", first["name"])
        .withColumn("trace", F.array_join(F.transform("_held", lambda r: r["name"]), ","))
        .drop("_held")
    )


def all_effects(inputs: DataFrame, rules: Sequence[PolicyRule]) -> DataFrame:
    """One row for each input and each rule that holds for it."""
    outcome = [F.when(F.expr(r.when), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("effect"))) for r in rules]
    return inputs.withColumn("_e", F.explode(F.array_compact(F.array(*outcome)))).select(*inputs.columns, "_e.rule", "_e.effect")
