from datetime import datetime

from pyspark.sql import functions as F

from braidframe.operators import integrity

REFS = "ref_id bigint, version_id string, recorded_at timestamp_ntz, parent string, at string"
PARENTS = "version_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, born string"


def t(day, hour=0):
    return datetime(2025, 3, day, hour)


def run(spark, refs, parents):
    r = integrity.references(spark.createDataFrame([(*x, "extra", "extra") for x in refs], REFS), "refs", "ref_id", "version_id", "recorded_at", "v")
    p = integrity.parents(spark.createDataFrame([(*x, "extra") for x in parents], PARENTS), "v", "version_id", "created_at", "deleted_at")
    return r, p


def found(spark, refs, parents):
    return {(r["ref_id"], r["reason"]) for r in integrity.orphan_rows(*run(spark, refs, parents), reasons=True).collect()}


def test_missing_deleted_and_later(spark):
    parents = [("a", t(1), None), ("b", t(1), t(5)), ("c", t(9), None), ("c", t(9), None), (None, t(1), None), ("  ", t(1), None), ("d", None, None)]
    refs = [(1, " A ", t(2)), (2, "b", t(5)), (3, "b", t(4)), (4, "c", t(8)), (5, "c", t(9)), (6, "zz", t(3)), (7, None, t(3)), (8, "   ", t(3)), (9, "a", None), (10, "d", t(3))]
    assert found(spark, refs, parents) == {(2, "not_live"), (4, "not_live"), (6, "missing"), (9, "not_live"), (10, "not_live")}


def test_registered_again_after_deletion(spark):
    parents = [("a", t(1), t(3)), ("a", t(6), t(8)), ("a", t(2), t(4))]
    refs = [(d, "a", t(d)) for d in range(1, 10)]
    assert {i for i, _ in found(spark, refs, parents)} == {4, 5, 8, 9}


def test_empty_tables(spark):
    assert found(spark, [], [("a", t(1), None)]) == set()
    assert found(spark, [(1, "a", t(1))], []) == {(1, "missing")}
    assert integrity.orphan_report(*run(spark, [], [])).count() == 0


def test_hot_id_against_brute_force(spark):
    import random

    rng = random.Random(5)
    parents = [(rng.choice(["hot", "x", "y"]), t(rng.randint(1, 27), rng.randint(0, 23)), rng.choice([None, t(28), t(rng.randint(1, 27), 5)])) for _ in range(60)]
    refs = [(i, "HOT" if i % 3 else rng.choice(["x", "y", "q"]), t(rng.randint(1, 27), rng.randint(0, 23))) for i in range(900)]
    want = {i for i, v, at in refs if not any(p == v.lower() and b <= at and (e is None or e > at) for p, b, e in parents)}
    assert {i for i, _ in found(spark, refs, parents)} == want


def test_lives_of_any_length_against_brute_force(spark):
    import random
    from datetime import timedelta

    rng, origin = random.Random(8), datetime(1969, 12, 1)
    moment = lambda: origin + timedelta(microseconds=rng.choice([rng.randrange(2**45), rng.randrange(2**20), 2**38 * rng.randint(-2, 90)]))
    parents = [(f"i{rng.randint(0, 12)}", b, rng.choice([b + timedelta(microseconds=rng.randint(-5, 2 ** rng.choice([3, 20, 38, 40, 44]))), moment()])) for b in (moment() for _ in range(80))]
    refs = [(i, f"I{rng.randint(0, 13)}", moment()) for i in range(3000)] + [(5000 + i, v, at) for i, (v, b, e) in enumerate(parents) for at in (b, e)]
    want = {i for i, v, at in refs if not any(p == v.lower() and b <= at < e for p, b, e in parents)}
    assert 100 < len(want) < 3100 and {i for i, _ in found(spark, refs, parents)} == want


def test_repeated_rows_and_report(spark):
    refs = [(1, "a", t(1)), (1, "a", t(1)), (2, "b", t(1))]
    report = integrity.orphan_report(*run(spark, refs, [("b", t(1), None)])).collect()
    assert [(r["period"], r["n_refs"], r["n_orphans"], r["n_missing"], r["n_not_live"]) for r in report] == [("2025-03", 2, 1, 1, 0)]


def test_plan_has_no_cross_join(spark):
    refs, parents = run(spark, [(1, "a", t(1))], [("b", t(1), None)])
    plan = integrity.orphan_rows(refs, parents)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert refs.where(F.col("target_id") == "a").count() == 1
