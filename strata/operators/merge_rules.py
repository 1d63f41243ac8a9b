"""Rules over the matched entities of a merge, by language, that give diagnostics.

A rule takes the rows of ``entity_merge.matched`` of its language and returns path, key,
severity, message and rule, as a plan; all rules together are one union over rows that
are written once.  A caller's rules are added to ``DEFAULT`` or stand alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.tables import settled

Rule = Callable[[DataFrame], DataFrame]


def diagnostic(rows: DataFrame, severity: str, rule: str, message: Column) -> DataFrame:
    return rows.select("path", "key", F.lit(severity).alias("severity"), message.alias("message"), F.lit(rule).alias("rule"))


def interface_methods(body: Column) -> Column:
    """Lines with something in them behind the line that opens an interface; comments and closing lines do not count."""
    behind = F.regexp_extract(body, r"(?s)interface ?\{[^\n]*\n(.*)", 1)
    lines = F.transform(F.split(behind, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.size(F.filter(lines, lambda line: (line != "") & ~line.rlike(r"^(\}|//)") & ~line.rlike(r"interface ?\{")))


# Names, severities and messages of the rules for Go.
def go_interface_impl(rows: DataFrame) -> DataFrame:
    """One side alone gave an interface more methods."""
    one = rows.filter("disposition IN ('OursOnly', 'TheirsOnly')").filter(F.col("base.body").rlike(r"\binterface ?\{"))
    ours = F.col("disposition") == "OursOnly"
    new = interface_methods(F.when(ours, F.col("ours.body")).otherwise(F.col("theirs.body"))) - interface_methods(F.col("base.body"))
    text = F.format_string("%s: %s added %d method(s) to interface — implementors may need updating", "base.name", F.when(ours, "ours").otherwise("theirs"), "_new")
    return diagnostic(one.withColumn("_new", new).filter("_new > 0"), "warning", "go-interface-impl", text)


def go_const_var_block(rows: DataFrame) -> DataFrame:
    """Both sides changed a const or var block."""
    both = rows.filter("disposition = 'Conflict' AND base IS NOT NULL AND ours IS NOT NULL AND theirs IS NOT NULL").filter(F.col("base.body").rlike(r"^\s*(const|var)[ (\t]"))
    return diagnostic(both, "info", "go-const-var-block", F.concat("base.name", F.lit(": both sides modified const/var block — consider set-union merge")))


def go_init_func(rows: DataFrame) -> DataFrame:
    """Both sides changed an init function."""
    both = rows.filter("disposition = 'Conflict' AND base.name = 'init'").filter(F.col("base.body").rlike(r"^\s*func\s"))
    return diagnostic(both, "warning", "go-init-func", F.lit("init() modified on both sides — review carefully, execution order may matter"))


DEFAULT: dict[str, tuple[Rule, ...]] = {"go": (go_interface_impl, go_const_var_block, go_init_func)}


def diagnostics(matched: DataFrame, rules: Mapping[str, Sequence[Rule]] = DEFAULT) -> DataFrame:
    """path, key, severity, message, rule: what the rules of each file's language have to say; no rules, no rows."""
    rows = settled(matched)
    found = [rule(rows.filter(F.col("lang") == lang)).select("path", "key", "severity", "message", "rule") for lang, own in rules.items() for rule in own]
    nothing = diagnostic(rows.filter(F.lit(False)), "", "", F.lit(""))
    return reduce(DataFrame.unionByName, found, nothing)
