from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from strata.sources import records as R


def envelope(kind: str, data: bytes) -> bytes:
    return f"{kind} {len(data)}\0".encode() + data


def test_loose_objects_round_trip(spark, tmp_path):
    for i, data in enumerate((b"one", "zwei é".encode(), b"")):
        raw = envelope("blob", data)
        name = hashlib.sha256(raw).hexdigest()
        (tmp_path / name[:2]).mkdir(exist_ok=True)
        (tmp_path / name[:2] / name[2:]).write_bytes(zlib.compress(raw) if i else raw)
    (tmp_path / "00").mkdir(exist_ok=True)
    (tmp_path / "00" / ("f" * 62)).write_bytes(b"blob 9\0short")
    objects = R.read_loose(spark, str(tmp_path)).cache()
    assert objects.count() == 4 and R.damaged(objects).count() == 1
    new = spark.createDataFrame([("blob", b"one"), ("blob", b"new"), ("blob", b"new")], "type string, data binary")
    assert [bytes(r.data) for r in R.put(objects, new).collect()] == [b"new"]


def test_commits_round_trip(spark):
    df = spark.createDataFrame([("t1", ["p1", "p2"], "Ann <a@b>", 5, "title\n\nbody"), ("t2", [], "Bob", 6, "")], "tree string, parents array<string>, author string, timestamp long, message string")
    text = R.commit_text(*(F.col(c) for c in df.columns)).cast("binary")
    objects = R.put(spark.createDataFrame([], R.OBJECTS), df.select(F.lit("commit").alias("type"), text.alias("data")))
    found = {r.tree: (r.parents, r.author, r.timestamp, r.message) for r in R.parse_commits(objects).collect()}
    assert found == {"t1": (["p1", "p2"], "Ann <a@b>", 5, "title\n\nbody"), "t2": ([], "Bob", 6, "")}


def test_reflog(spark):
    lines = spark.createDataFrame([("a b 7 commit: x y\tsrc%3A1.go:decl:f:-:T:modify,q:k:create",), ("b c 8 reset",), ("",)], "value string")
    found = [(r.old, r.new, r.timestamp, r.reason, [tuple(e) for e in r.entities]) for r in R.parse_reflog(lines).orderBy("timestamp").collect()]
    assert found == [("a", "b", 7, "commit: x y", [("src%3A1.go", "decl:f:-:T", "modify"), ("q", "k", "create")]), ("b", "c", 8, "reset", [])]


def test_rule_lines(spark):
    lines = spark.createDataFrame([("# note",), ("*.go  ann bob # x",), ("",), ("img/* binary text=auto -eol x",)], "value string")
    assert [(r.pattern, r.names) for r in R.parse_rules(lines).collect()] == [("*.go", ["ann", "bob"]), ("img/*", ["binary", "text=auto", "-eol", "x"])]
    assert [r["values"] for r in R.parse_attributes(lines).collect()][1] == {"diff": "false", "merge": "false", "text": "auto", "eol": "false", "x": "true"}


def test_files_of_a_repository(spark, tmp_path):
    import json

    from strata.sources import files as S

    h = [f"{i:064x}" for i in range(6)]
    for name, text in (("heads/main", h[0] + "\n"), ("heads/a/b", h[1]), ("tags/v1", h[2]), ("heads/bad", "no hash")):
        (tmp_path / "refs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "refs" / name).write_text(text)
    refs = S.read_refs(spark, str(tmp_path))
    assert {(r.branch, r.hash) for r in S.branches(refs).collect()} == {("main", h[0]), ("a/b", h[1]), ("bad", None)}
    assert {(r.tag, r.hash) for r in S.tags(refs).collect()} == {("v1", h[2])}
    index = {"entries": {"p": {"path": "p", "blob_hash": h[0], "mode": "100644", "mod_time": 5, "size": 3}, "q": {"path": "q", "blob_hash": h[1], "conflict": True, "ours_blob_hash": h[2]}}}
    (tmp_path / "index").write_text(json.dumps(index))
    assert {(r.path, r.blob_hash, r.size, r.conflict) for r in S.read_index(spark, str(tmp_path / "index")).collect()} == {("p", h[0], 3, None), ("q", h[1], None, True)}
    graph = {"version": 1, "entries": {h[0]: {"tree": h[1], "parents": [h[2], h[3]], "generation": 2, "timestamp": 9}}}
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    assert [tuple(r) for r in S.read_commit_graph(spark, str(tmp_path / "graph.json")).collect()] == [(h[0], h[1], [h[2], h[3]], 2, 9)]
    (tmp_path / "lock").write_text(json.dumps({"modules": {"m": {"commit": h[4], "url": "u", "track": "main"}}}))
    assert [tuple(r) for r in S.read_module_lock(spark, str(tmp_path / "lock")).collect()] == [("m", h[4], "u", "main")]
    (tmp_path / "modules").write_text('# all\n[module "a"]\n\turl = https://x/a ; note\n\tpath = lib/a\n; no\n[module "b"]\nurl=u\npath = lib/b\ntrack = dev\n')
    assert {(r.name, r.url, r.path, r.track, r.pin) for r in S.read_modules(spark, str(tmp_path / "modules")).collect()} == {("a", "https://x/a", "lib/a", None, None), ("b", "u", "lib/b", "dev", None)}


def test_signers_shallow_and_records(spark, tmp_path):
    import datetime

    from strata.sources import files as S

    def lines(*rows):
        return spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)

    assert {tuple(r) for r in S.parse_signers(lines("# x", "", "a@b ssh-ed25519 AAA c", "a@b ssh-rsa BBB", "c@d k v")).collect()} == {("a@b", "ssh-rsa BBB"), ("c@d", "k v")}
    h = "0" * 64
    assert [r.hash for r in S.parse_shallow(lines(h, "", " " + h, "x")).collect()] == [h]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"id": "1", "agent": "a", "heartbeat_at": "2024-01-01T00:00:00Z"}')
    (tmp_path / "s" / "log.jsonl").write_text('{"id": "2", "agent": "b", "heartbeat_at": "2024-01-01T00:10:00Z", "more": 1}\n{"id": "3", "age')
    sessions = S.read_records(spark, str(tmp_path / "s"), S.SESSION)
    assert {r.id for r in sessions.collect()} == {"1", "2"}
    now = F.lit(datetime.datetime(2024, 1, 1, 0, 11, tzinfo=datetime.timezone.utc))
    assert [r.id for r in S.stale(sessions, now, 120).collect()] == ["1"]


def test_legacy_trees(spark):
    from strata.sources import objects as O

    h = "a" * 64
    data = f"version 1\nx y\t100755 {h} {h} -\nold file {h} - -\nsub dir - - {h}\n".encode()
    rows = O.parse_trees(spark.createDataFrame([("t", "tree", len(data), data)], R.OBJECTS)).collect()
    assert {(r.name, r.mode, r.is_dir, r.blob, r.entities, r.subtree) for r in rows} == {
        ("x y", "100755", False, h, h, None), ("old", "100644", False, h, None, None), ("sub", "40000", True, None, None, h)
    }
    refs = {(r.child, r.parent) for r in O.references(spark.createDataFrame([("t", "tree", len(data), data)], R.OBJECTS)).collect()}
    assert refs == {("t", h)}
