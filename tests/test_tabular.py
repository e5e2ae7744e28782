import pytest
from pyspark.sql import functions as F

from braidframe.operators import models, tabular


def test_left_join_null_keys_and_clashes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "n")], "k int, v string")
    plain = tabular.left_join(a, b, ["k"])
    assert plain.columns == ["k", "v", "v_r"]
    assert {tuple(r) for r in plain.collect()} == {(1, "x", "p"), (1, "x", "q"), (None, "y", None), (3, "z", None)}
    assert {tuple(r) for r in tabular.left_join(a, b, ["k"], null_keys_match=True).collect()} == {(1, "x", "p"), (1, "x", "q"), (None, "y", "n"), (3, "z", None)}


def test_membership(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (None,)], "m int")
    assert [r[0] for r in tabular.in_set(a, "k", b, "m").collect()] == [1]
    assert {r[0] for r in tabular.not_in_any(a, "k", [(b, "m")]).collect()} == {2, None}


def test_group_agg_drops_null_keys_and_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), (None, 5)], "k string, v int")
    assert [tuple(r) for r in tabular.group_agg(df, ["k"], tabular.sum0(F.col("v")).alias("s")).collect()] == [("a", 0)]


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r[0] for r in tabular.sort_nulls_last(df, [("v", True)]).collect()] == [1, 2, None]
    assert [r[0] for r in tabular.sort_nulls_last(df, [("v", False)]).collect()] == [2, 1, None]


def test_best_and_top(spark):
    df = spark.createDataFrame([("a", i % 4, i) for i in range(50)] + [("b", None, 1)], "g string, v int, i int")
    best = {r["g"]: (r["v"], r["i"]) for r in tabular.best_per_group(df, ["g"], [F.col("v"), F.col("i")], largest=True).collect()}
    assert best == {"a": (3, 47), "b": (None, 1)}
    top = sorted((r["rank"], r["i"]) for r in tabular.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("i")], 3).where("g = 'a'").collect())
    assert top == [(1, 3), (2, 7), (3, 11)]


def test_union_and_diff(spark):
    u = tabular.union_tagged({"l": spark.createDataFrame([(1,)], "a int"), "r": spark.createDataFrame([("x",)], "b string")}, "tag")
    assert {tuple(r) for r in u.collect()} == {("l", 1, None), ("r", None, "x")}
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(2, None), (3, "y"), (4, "n")], "k int, v string")
    assert {r["k"]: r["change"] for r in tabular.key_diff(a, b, "k", "v").collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}


def test_zip_ordinal_of_different_length(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "ordinal int, a string"), spark.createDataFrame([(1, "p")], "ordinal int, b string")
    with pytest.raises(Exception, match="different length"):
        tabular.zip_ordinal(a, b).collect()


def test_preview(spark):
    df = spark.range(5)
    assert [r["truncated"] for r in tabular.preview(df, 3, [F.col("id")]).collect()] == [True] * 3
    assert [r["truncated"] for r in tabular.preview(df, 5, [F.col("id")]).collect()] == [False] * 5


def test_confusion_of_nothing(spark):
    df = spark.createDataFrame([], "a boolean, p boolean")
    row = tabular.confusion(df, F.col("a"), F.col("p")).first()
    assert (row["tp"], row["accuracy"], row["f1"]) == (0, 0.0, 0.0)


def test_models_learn_a_line(spark):
    data = [(float(i % 20), float((i * 7) % 5), int(i % 20 > 9)) for i in range(400)] + [(None, 1.0, 1), (1.0, 1.0, None)]
    df = spark.createDataFrame(data, "x double, z double, y int")
    metrics = models.grid(df, ["x", "z"], "y", {"a": {}, "b": {"threshold": 0.999999}})
    assert models.champion(metrics).first()["candidate"] == "a"
    assert metrics.where("candidate = 'a'").first()["accuracy"] > 0.95


def test_logistic_grid_reads_the_whole_vector(spark, tmp_path):
    from braidframe.plans.aggregates import logistic_grid

    rows = [([float((i * k) % 7) for k in range(1, 40)] + [float(i % 2)], i % 2) for i in range(200)]  # only the last entry tells the labels apart
    spark.createDataFrame(rows, "embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["candidate"]: r["accuracy"] for r in logistic_grid(spark, str(tmp_path)).collect()}
    assert found["plain"] == 1.0
