"""Queries over whole tables that stand beside those whose SQL reads a part."""

from __future__ import annotations

from collections import Counter
import re

from strata.plans import composite, matching_rules


def test_names_of_the_whole_benchmark(spark, tmp_path):
    items = [(1, "Alpha beta"), (20, "gamma_1 beta"), (500, "Delta; alpha"), (501, None)]
    bodies = [(1, "alpha ALPHA delta"), (2, "gamma_1 x beta"), (3, None), (4, "gamma"), (5, "delta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(bodies, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def words(text):
        return set(re.findall("[a-z0-9_]{4,}", (text or "").lower()))

    names = set().union(*(words(t) for _, t in items))
    wanted = Counter(w for _, t in bodies for w in words(t) & names)
    assert wanted["delta"] == 2
    assert {r.name: r.n for r in matching_rules.impact_refs_all(spark, str(tmp_path)).collect()} == wanted


def test_every_spawn_is_traced(spark, tmp_path):
    events = [(i, i * 7 % 300) for i in range(0, 260, 3)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    spawns = {k for i, _ in events for k in (i % 97, i % 89)}
    wanted = {s: sum(s in (i % 97, i % 89) or u == 3 * s for i, u in events) for s in spawns}
    assert max(wanted) > 20
    assert {r.spawn: r.events for r in composite.spawn_trace_all(spark, str(tmp_path)).collect()} == wanted
