from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators.incremental import VersionedTarget, changed_records, replay_runs, run_increment

LOG = "project string, rel_path string, sha256 string, is_deleted boolean, scan_id bigint, observed_at timestamp, run_id string"
RUNS = "run_id bigint, project string, scan_id bigint, status string"
T = [datetime(2024, 1, d) for d in range(1, 12)]


def test_changed_records(frame):
    s = frame([("a", "1"), ("b", "2"), (None, "3"), ("d", None)], "k string, v string")
    t = frame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "k string, v string")
    assert {(r["k"], r["change"]) for r in changed_records(s, t, ["k"], "v").collect()} == {("b", "changed"), ("c", "gone"), (None, "new")}
    assert changed_records(s.limit(0), t.limit(0), ["k"], "v").count() == 0


def test_replay(frame):
    log = frame(
        [
            ("p", "a", "AA", None, 1, T[0], "x"), ("p", "a", "AA", None, 1, T[0], "x"), ("p", "b", "BB", False, 1, T[0], "x"), ("p", "a", "aa", False, 2, T[1], "x"), ("p", "b", "", True, 3, T[2], "x"),
            ("p", "c", "CC", False, 4, T[1], "x"), ("p", "c", "C0", False, 3, T[3], "x"), ("p", "d", "DD", False, None, T[0], "x"), ("q", "a", "AA", False, 1, T[0], "x"),
        ], LOG,
    )
    runs = frame([(1, "p", 1, "success"), (1, "p", 1, "success"), (2, "p", 2, "failed"), (3, "p", 2, "success"), (4, "p", 4, "success"), (5, "q", 1, "aborted")], RUNS)
    got = {tuple(r) for r in replay_runs(log, runs).select("run_id", "project", "rel_path").collect()}
    assert got == {(1, "p", "a"), (1, "p", "b"), (4, "p", "b"), (4, "p", "c")}
    assert replay_runs(log.limit(0), runs).count() == 0 and replay_runs(log, runs.limit(0)).count() == 0


def test_increments_process_each_change_once(spark, frame, tmp_path):
    target, seen = VersionedTarget(spark, str(tmp_path / "t")), []

    def process(df):
        seen.append(sorted(r["k"] for r in df.collect()))
        return df.withColumn("out", F.upper("v"))

    first = frame([("a", "1"), ("b", "1")], "k string, v string")
    assert run_increment(first, target, ["k"], "v", process) == 1
    assert run_increment(first, target, ["k"], "v", process) == 1
    second = frame([("a", "1"), ("b", "2"), ("c", "1")], "k string, v string")

    def dies(df):
        raise OSError("lost")

    with pytest.raises(OSError):
        run_increment(second, target, ["k"], "v", dies)
    assert target.version() == 1
    assert run_increment(second, target, ["k"], "v", process) == 2
    assert run_increment(second.where("k <> 'a'"), target, ["k"], "v", process) == 3
    assert seen == [["a", "b"], ["b", "c"], []]
    assert {(r["k"], r["v"]) for r in target.read().collect()} == {("b", "2"), ("c", "1")}
    assert target.read(number=1).count() == 2


def test_two_writers(spark, frame, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    rows = frame([("a",)], "k string")
    target.publish(rows, 0)
    with pytest.raises(RuntimeError):
        target.publish(rows, 0)
    assert target.version() == 1


def test_parts_follow_the_change(spark, frame, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    schema = "p string, k string, v string"
    same = lambda df: df.withColumn("out", F.upper("v"))
    run_increment(frame([("a", "x", "1"), ("b", "y", "1"), (None, "z", None)], schema), target, ["p", "k"], "v", same)
    scope = frame([("a",)], "p string")
    assert run_increment(frame([("a", "w", "2")], schema), target, ["p", "k"], "v", same, scope=scope) == 2
    assert {(r["p"], r["k"], r["v"]) for r in target.read().collect()} == {("a", "w", "2"), ("b", "y", "1"), (None, "z", None)}
    assert target._each(target.parts()[-1:], "rows").count() == 1 and {(r["k"], r["gone"]) for r in target._each(target.parts()[-1:], "keys").collect()} == {("w", False), ("x", True)}
    none = lambda df: df.where("false")
    rows = [("a", "w", "3"), ("b", "y", "1"), (None, "z", None)]
    assert run_increment(frame(rows, schema), target, ["p", "k"], "v", none) == 3
    assert run_increment(frame(rows, schema), target, ["p", "k"], "v", none) == 3  # a record without output isn't processed again
    assert run_increment(frame(rows[1:], schema), target, ["p", "k"], "v", same, compact_after=2) == 5 and len(target.parts()) == 1
    assert {(r["p"], r["k"]) for r in target.read().collect()} == {("b", "y"), (None, "z")}
    assert target.vacuum(keep=1) == 0 and target.vacuum(keep=1, older_than_s=0) == 8
    assert target.read().count() == 2 and target.version() == 5


def test_concurrent_writers(spark, frame, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    target = VersionedTarget(spark, str(tmp_path / "t"))
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: target._create(f"{target.root}/log/{1:012d}", f"[{i}]"), range(8)))
    assert got.count(True) == 1 and target.parts() == [got.index(True)]


def test_clashing_columns_and_odd_values(spark, frame, tmp_path):
    schema = "k string, v string, version string, gone boolean, change string, offered int"
    rows = [("x" * 50_000, "1", "a", True, "c", 1), (None, "1", None, None, None, None), ("", None, "b", False, "d", 2)]
    target = VersionedTarget(spark, str(tmp_path / "t"))
    assert run_increment(frame(rows, schema), target, ["k"], "v", lambda df: df) == 1
    assert run_increment(frame(rows, schema), target, ["k"], "v", lambda df: df) == 1
    assert run_increment(frame([rows[0], ("", "2", "b", False, "d", 2)], schema), target, ["k"], "v", lambda df: df) == 2
    assert sorted((r["k"][:1], r["v"], r["version"], r["offered"]) for r in target.read().collect()) == [("", "2", "b", 2), ("x", "1", "a", 1)]
    assert run_increment(frame([], schema), target, ["k"], "v", lambda df: df) == 3 and target.read().count() == 0
    empty = VersionedTarget(spark, str(tmp_path / "e"))
    assert run_increment(frame([], schema), empty, ["k"], "v", lambda df: df) == 0 and empty.read() is None
