import math
import random

import numpy as np
import pytest

from braidframe.llm import sketch

SCHEMA = "g string, v double, k0 string, sketch string, weight string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(g, v, "x", "x", "x", "x") for g, v in rows], SCHEMA)


def estimates(spark, rows):
    found = sketch.percentiles(sketch.build(frame(spark, rows), ["g"], "v"), ["g"])
    return {(r["g"], r["q"]): (r["n"], r["estimate"]) for r in found.collect()}


SHAPES = {
    "uniform": lambda r: r.random() * 1000,
    "heavy": lambda r: r.paretovariate(0.7),
    "equal": lambda r: 42.0 if r.random() < 0.6 else r.random() * 100,
    "wide": lambda r: 10 ** r.uniform(-9, 15),
    "whole": lambda r: float(r.randint(0, 3)),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_rank_error_against_sorting(spark, shape):
    rng = random.Random(shape)
    values = sorted(SHAPES[shape](rng) for _ in range(20_000))
    got = estimates(spark, [("a", v) for v in values])
    for (_, q), (n, estimate) in got.items():
        assert n == len(values)
        rel = 2.1 * sketch.RELATIVE_ERROR
        low = sum(v < estimate * (1 - rel) for v in values)
        high = sum(v <= estimate * (1 + rel) for v in values)
        rank = math.ceil(q * n)
        assert low - sketch.shape().rank_error * n < rank <= high + sketch.shape().rank_error * n


def test_what_is_no_measurement(spark):
    got = estimates(spark, [("a", None), ("a", float("nan")), ("a", -1.0), ("a", 5.0), (None, 7.0), ("b", -0.5), ("c", 0.0), ("d", float("inf"))])
    assert {g for g, _ in got} == {"a", None, "c", "d"}
    assert got["a", 0.5][0] == 1 and got["a", 0.5][1] == pytest.approx(5.0, rel=0.002)
    assert got[None, 0.5][1] == pytest.approx(7.0, rel=0.002)
    assert got["c", 0.99] == (1, 0.0) and got["d", 0.5] == (1, math.inf)


def test_empty(spark):
    assert estimates(spark, []) == {}


def counters(df):
    return {r["g"]: tuple(map(tuple, sketch._unpack(bytes(r["sketch"])))) for r in df.collect() if len(r["sketch"]) > 2}


def test_merge_and_deletion(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random() * 10) for _ in range(3000)]
    whole = sketch.build(frame(spark, rows), ["g"], "v")
    parts = sketch.build(frame(spark, rows[:1000]), ["g"], "v").unionByName(sketch.build(frame(spark, rows[1000:]), ["g"], "v"))
    assert counters(whole) == counters(sketch.merge(parts, ["g"])) and len(counters(whole)) == 3
    undone = whole.unionByName(sketch.build(frame(spark, rows[:1000]), ["g"], "v", weight=F.lit(-1)))
    assert counters(sketch.merge(undone, ["g"])) == counters(sketch.build(frame(spark, rows[1000:]), ["g"], "v"))
    gone = whole.unionByName(sketch.build(frame(spark, rows), ["g"], "v", weight=F.lit(-1)))
    assert sketch.percentiles(sketch.merge(gone, ["g"]), ["g"]).count() == 0


def test_many_keys_are_handed_over_early(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HELD", 500)
    rng = random.Random(9)
    rows = [(str(i % 300), rng.random()) for i in range(3000)]
    found = {r["g"]: r["n"] for r in sketch.percentiles(sketch.build(frame(spark, rows), ["g"], "v"), ["g"], [0.5]).collect()}
    assert found == {str(i): 10 for i in range(300)}


def test_without_keys(spark):
    (row,) = sketch.percentiles(sketch.build(frame(spark, [("a", float(i)) for i in range(1, 102)]), [], "v"), [], [0.5]).collect()
    assert row["n"] == 101 and abs(row["estimate"] - 51) <= 51 * 0.002 + 1


def test_size_is_bounded(spark):
    rng = random.Random(4)
    built = sketch.build(frame(spark, [("a", 10 ** rng.uniform(-5, 12)) for _ in range(30_000)]), ["g"], "v").collect()
    of = sketch.shape()
    assert len(built) == 1 and len(built[0]["sketch"]) <= 12 * of.size and of.size <= of.rows * of.width * of.hashed + 2 * of.width


def test_shapes():
    of = sketch.shape()
    assert of == sketch.Shape(1024, 5) and of.rank_error < sketch.EPSILON
    assert sketch.shape(0.005, 0.01).width > of.width and sketch.shape(0.02, 0.01).rows > of.rows
    for cells, weights in (([], []), ([0], [1]), ([5, 70_000, 70_001], [-1, 300, 2**40])):
        a, b = sketch._unpack(sketch._pack(np.array(cells, np.int64), np.array(weights, np.int64)))
        assert a.tolist() == cells and b.tolist() == weights


def test_exact_values_by_counting(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", None]), rng.choice([0.0, 1.0, 1.0001, 1.0002, rng.random() * 50])) for _ in range(4000)]
    df = frame(spark, rows)
    found = sketch.rank_check(df, ["g"], "v", sketch.percentiles(sketch.build(df, ["g"], "v"), ["g"])).collect()
    assert len(found) == 2 * len(sketch.PERCENTILES) and all(r["within"] for r in found)
    for r in found:
        values = sorted(v for g, v in rows if g == r["g"])
        assert r["n"] == len(values) and r["exact_value"] == values[math.ceil(r["q"] * len(values)) - 1]


def test_codes_keep_order(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1e-320, 1e-12, 0.5, 1.0, 1.01, 1e9, 1e300, float("inf")]
    codes = [r["c"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", sketch.encode(F.col("v")).alias("c")).orderBy("v").collect()]
    assert codes == sorted(codes) and codes[0] == codes[1] == 0
    for v, c in zip(values[2:-1], codes[2:-1], strict=True):
        assert sketch.decode(c) == pytest.approx(v, rel=1.1 * sketch.RELATIVE_ERROR)


def test_merge_check_merges_stored_days(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from braidframe.llm import queries

    days = [(float(i), "a", datetime(2025, 1, 1 + i % 5, i % 24)) for i in range(200)]
    spark.createDataFrame(days, "duration_s double, base_name string, started_at timestamp_ntz").write.parquet(f"{tmp_path}/task_runs.parquet")
    spark.createDataFrame(days, "rss_bytes double, base_name string, sampled_at timestamp_ntz").selectExpr("cast(rss_bytes as bigint) as rss_bytes", "base_name", "sampled_at").write.parquet(f"{tmp_path}/resource_samples.parquet")
    merged, merge = [], sketch.merge
    monkeypatch.setattr(sketch, "merge", lambda s, keys, of=None: merged.append(s) or merge(s, keys, of))
    rows = queries.p3_merge_check(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(sketch.PERCENTILES) and all(r["same"] for r in rows)
    parts = next(m for m in merged if m.inputFiles() and all("braid-sketches" in f for f in m.inputFiles()))
    assert parts.count() == 10 and parts.select("day").distinct().count() == 5
