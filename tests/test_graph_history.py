from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from braidframe.operators import graph, history

T0 = datetime(2025, 1, 1)


def edges(spark, rows):
    return spark.createDataFrame(rows, "run string, node int, dep int")


def nodes(spark, ids, run="r"):
    return spark.createDataFrame([(run, i) for i in ids], "run string, n int")


@pytest.mark.parametrize("most", [0, 100])
def test_waves(spark, most):
    e = edges(spark, [("r", 1, 0), ("r", 2, 1), ("r", 3, 0), ("r", 3, 2), ("r", 4, 99)])
    got = {r["node"]: r["wave"] for r in graph.waves(nodes(spark, [0, 1, 2, 3, 4, None]), e, ["run"], "n", most).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert graph.waves(nodes(spark, [0]).limit(0), e.limit(0), ["run"], "n", most).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_cycle(spark, most):
    with pytest.raises(Exception, match="cycle"):
        graph.waves(nodes(spark, [0, 1, 2]), edges(spark, [("r", 0, 1), ("r", 1, 0), ("r", 2, 0)]), ["run"], "n", most).collect()


def test_reach_and_status(spark):
    e = edges(spark, [("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("r", 3, 0)])
    roots = spark.createDataFrame([("r", 3)], "run string, root int")
    assert {r["node"]: r["distance"] for r in graph.reachable(e, roots, ["run"]).collect()} == {3: 0, 2: 1, 0: 1, 1: 2}
    n = nodes(spark, [0, 1, 2, 3, 7])
    assert [r["n"] for r in graph.unreached(n, e, roots, ["run"], "n").collect()] == [7]
    hits = spark.createDataFrame([("r", 0), ("r", 2), ("r", 3)], "run string, node int")
    got = {r["node"]: r["status"] for r in graph.cached_status(n.withColumnRenamed("n", "node"), e, hits, ["run"]).collect()}
    assert got == {0: "cached", 1: "will_run", 2: "unknown", 3: "unknown", 7: "will_run"}


def test_edges_ignore_nulls(spark):
    df = spark.createDataFrame([("r", 1, [0, 0, None]), ("r", None, [1]), ("r", 2, None), ("r", 3, [])], "run string, n int, deps array<int>")
    assert [tuple(r) for r in graph.edges_of(df, ["run"], "n", "deps").collect()] == [("r", 1, 0)]


def test_wave_totals_take_the_first_peak(spark):
    levels = spark.createDataFrame([("r", 0, 0), ("r", 1, 1), ("r", 2, 2)], "run string, node int, wave int")
    w = spark.createDataFrame([("r", 0, 2), ("r", 1, 5), ("r", 2, 5)], "run string, node int, gb int")
    assert tuple(graph.wave_totals(levels, w, ["run"], ["gb"]).first()) == ("r", 3, 5, 1, 12)


def test_prior_entry(spark):
    rows = [("a", T0, 1), ("a", T0, 2), ("a", T0 + timedelta(days=3), 3), ("b", T0, 9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, e int")
    assert {r["e"]: r["prior"] for r in history.prior_entry(df, ["k"], "ts", "e").collect()} == {1: 3, 2: 3, 3: 2, 9: None}
    ties = spark.createDataFrame([("a", T0, 1), ("a", T0, 2), ("a", T0, 3)], "k string, ts timestamp_ntz, e int")
    assert {r["e"]: r["prior"] for r in history.prior_entry(ties, ["k"], "ts", "e").collect()} == {1: 3, 2: 3, 3: 2}


def test_compaction(spark):
    rows = [("t", "status", "a", 1), ("t", "status", "b", 3), ("t", "gone", "x", 1), ("t", "gone", None, 2), ("t", "seconds", "1.5", 1), ("t", "seconds", "2", 2)]
    df = spark.createDataFrame(rows, "k string, f string, v string, seq int")
    got = {r["f"]: r["v"] for r in history.compact(df, ["k"], "f", "v", ["seq"], added=["seconds"]).collect()}
    assert got == {"status": "b", "seconds": "3.5"}


def test_eviction(spark):
    rows = [(f"e{i}", 10, T0 + timedelta(days=i)) for i in range(6)] + [("old", None, None)]
    df = spark.createDataFrame(rows, "id string, size bigint, at timestamp_ntz")
    gone = lambda **kw: {r["id"] for r in history.evict(df, "id", "size", "at", **kw).where("evicted").collect()}
    assert gone(keep_count=3) == {"e0", "e1", "e2", "old"}
    assert gone(keep_bytes=40) == {"e0", "e1", "old"}
    assert gone(older_than="2025-01-04", keep_count=2) == {"e0", "e1", "e2", "e3", "old"}
    assert gone() == set()


def test_sweep(spark):
    day = timedelta(days=1)
    rows = [(T0, T0 + day, 2), (T0 + day, T0 + 2 * day, 3), (T0 + day / 2, T0 + day * 1.5, 1), (None, T0, 9)]
    df = spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz, w int")
    row = history.sweep_peak(df, "s", "e", {"n": F.lit(1), "w": F.col("w")}).first()
    assert (row["peak_n"], row["peak_w"]) == (2, 4)


def test_latest_usage_and_versions(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 5.0)], "k string, t int, v double")
    u = history.usage(df, ["k"], "t", ["v"], "t").first()
    assert (u["n_samples"], u["mean_v"], u["peak_v"], u["peak_v_at"], u["last_v"]) == (3, 5.0, 5.0, 3, 5.0)  # of equal peaks the last
    assert history.latest(df, ["k"], ["t"]).first()["t"] == 3
    v = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2)], "key string, version_id string, created_at int")
    al = spark.createDataFrame([("a", "prod", "v1")], "key string, alias string, version_id string")
    asked = spark.createDataFrame([("a", None), ("a", "prod"), ("a", "v2"), ("zz", None)], "key string, selector string")
    got = {(r["key"], r["selector"]): r["version_id"] for r in history.resolve_version(asked, v, al, "key").collect()}
    assert got == {("a", None): "v2", ("a", "prod"): "v1", ("a", "v2"): "v2", ("zz", None): None}


def test_depth_has_no_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 3, raising=False)
    nodes = spark.createDataFrame([(1, i) for i in range(7)], "g int, node int")
    edges = spark.createDataFrame([(1, i, i - 1) for i in range(1, 7)], "g int, node int, dep int")
    roots = spark.createDataFrame([(1, 6)], "g int, root int")
    assert {r["node"]: r["distance"] for r in graph.reachable(edges, roots, ["g"]).collect()} == {i: 6 - i for i in range(7)}
    levels = graph.waves(nodes, edges, ["g"], "node", most_edges=0)
    assert {r["node"]: r["wave"] for r in levels.collect()} == {i: i for i in range(7)}
    hits = nodes.where("node > 0")
    status = {r["node"]: r["status"] for r in graph.cached_status(levels, edges, hits, ["g"]).collect()}
    assert status == {0: "will_run", **dict.fromkeys(range(1, 7), "unknown")}
    seen = {r["node"]: r["status"] for r in graph.cached_status(levels, edges, nodes, ["g"], nodes.where("node = 4")).collect()}
    assert seen == {**dict.fromkeys(range(4), "cached"), 4: "unknown", 5: "unknown", 6: "unknown"}


LOG = "run string, seq int, kind string, task string, fields map<string,string>, phase string, seconds double"
ENTRIES = [
    ("r", 1, "task_created", "t", {"status": "pending", "name": "a"}, None, None),
    ("r", 2, "task_updated", "t", {"status": "running", "attempt": "1"}, None, None),
    ("r", 3, "task_timing", "t", None, "stage", 1.25),
    ("r", 4, "run_timing", None, None, "plan", 0.1),
    ("r", 5, "task_created", "t", {"status": "again"}, None, None),
    ("r", 6, "task_timing", "t", None, "stage", 0.5),
    ("r", 7, "task_timing", "t", None, "stage", 0.25),
    ("r", 8, "task_updated", "t", {"status": None, "exit": "0"}, None, None),
    ("r", 9, "run_update", None, {"status": "done", "gone": "x"}, None, None),
    ("r", 10, "run_update", None, {"gone": None}, None, None),
    ("r", 11, "profile_set", None, {"a": "1", "b": "2"}, None, None),
    ("r", 12, "profile_set", None, {"a": "3"}, None, None),
    ("r", 13, "run_timing", None, None, "plan", 0.2),
    ("r", 14, "task_updated", None, {"lost": "1"}, None, None),
    ("r", 15, "other", "t", {"status": "x"}, "stage", 9.0),
    (None, 16, "task_updated", "u", {"k": "v"}, None, None),
]
STATE = {
    ("r", "task", "t", "exit", "0"), ("r", "task_timing", "t", "stage", "0.75"), ("r", "total_timing", "", "stage", "2.0"), ("r", "run_timing", "", "plan", "0.3"),
    ("r", "run", "", "status", "done"), ("r", "profile", "", "a", "3"), (None, "task", "u", "k", "v"),
}


def test_replay_of_a_whole_log(spark):
    log = spark.createDataFrame(ENTRIES, LOG)
    assert {tuple(r) for r in history.replay(log, "run", ["seq"]).collect()} == STATE
    for at in (4, 6, 11):  # going on from an earlier state
        first = history.replay(log.where(F.col("seq") <= at), "run", ["seq"])
        assert {tuple(r) for r in history.replay(log.where(F.col("seq") > at), "run", ["seq"], start=first).collect()} == STATE
    assert history.replay(log.limit(0), "run", ["seq"]).count() == 0


def test_component_diff(spark):
    schema = "e int, component string, digest string"
    now = [(1, "source_hash", "a"), (1, "version", "1"), (1, "env", None), (1, "inputs.x", "p"), (1, "inputs.new", "q"), (2, "inputs", None), (2, "env", "e"), (3, "env", "e"), (4, "other", "z")]
    then = [(1, "source_hash", "b"), (1, "version", "1"), (1, "env", "e"), (1, "inputs.x", "p"), (1, "inputs.old", "q"), (2, "inputs.x", "p"), (2, "env", "e"), (3, "env", "e"), (4, "other", "y")]
    diff = history.component_diff(spark.createDataFrame(now, schema), spark.createDataFrame(then, schema), ["e"])
    assert {tuple(r) for r in diff.collect()} == {
        (1, "source_hash", "changed"), (1, "env", "not_recorded"), (1, "inputs.new", "added"), (1, "inputs.old", "removed"), (2, "inputs", "not_recorded"), (4, "other", "changed"),
    }
    assert {r["e"]: r["reasons"] for r in history.coarse_reasons(diff, ["e"]).collect()} == {1: ["input_changed", "source_hash_changed"], 2: ["cache_key_changed"], 4: ["cache_key_changed"]}


def test_retained_and_profile(spark):
    puts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4), (None, 9)], "id string, t int")
    assert {r["id"] for r in history.retained(puts, "id", ["t"], 2).collect()} == {"a", "c"}
    seen = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", -1.0), ("y", 0.0), ("y", float("nan")), ("z", None)], "p string, s double")
    assert [tuple(r) for r in history.phase_profile(seen, [], "p", "s").collect()] == [("x", 3.0, 2)]
