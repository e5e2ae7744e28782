import random

from pyspark.sql import functions as F

from braidframe.operators.ordered import neighbour, running_max, running_sum


def rows(n=600):
    rng = random.Random(7)
    return [(rng.choice([None, "hot", "hot", "b"]), rng.randint(0, 300), i, rng.choice([None, rng.randint(-5, 50)])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t int, i int, v int")


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_neighbour(spark):
    data = rows()
    for following in (False, True):
        got = {r["i"]: r["n"] for r in neighbour(frame(spark, data), ["k"], F.floor(F.col("t") / 20), ["t", "i"], F.col("i"), "n", following=following).collect()}
        want = {}
        for rs in by_key(data).values():
            ids = [r[2] for r in rs]
            want |= dict(zip(ids, [*ids[1:], None] if following else [None, *ids], strict=False))
        assert got == want


def test_neighbour_value_null_is_kept(spark):
    data = [("a", 1, 1, None), ("a", 50, 2, 3)]
    got = {r["i"]: r["n"] for r in neighbour(frame(spark, data), ["k"], F.floor(F.col("t") / 20), ["t", "i"], F.col("v"), "n").collect()}
    assert got == {1: None, 2: None}


def test_running(spark):
    data = rows()
    order = [F.col("t"), F.col("i")]
    top = {r["i"]: r["o"] for r in running_max(frame(spark, data), ["k"], F.floor(F.col("t") / 20), order, F.col("v"), "o").collect()}
    total = {r["i"]: r["o"] for r in running_sum(frame(spark, data), ["k"], F.floor(F.col("t") / 20), order, F.col("v"), "o").collect()}
    for rs in by_key(data).values():
        s, m = 0, None
        for _, _, i, v in rs:
            s += v or 0
            m = v if m is None else m if v is None else max(m, v)
            assert total[i] == s and top[i] == m


def test_empty(spark):
    assert running_sum(frame(spark, []), ["k"], F.col("t"), ["t"], F.col("v"), "o").count() == 0
