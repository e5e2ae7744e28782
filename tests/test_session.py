import os

from braidframe import session


def test_cut_and_drop(spark):
    kept = session.cut(spark.range(5), "test")
    path = session._CUTS[-1].removeprefix("file://")
    assert kept.count() == 5 and os.path.isdir(path)
    assert session.drop_cuts(spark) >= 1 and not os.path.isdir(path)


def test_empty_cut(spark):
    assert session.cut(spark.range(0), "test").count() == 0


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    few = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(few, "id").rdd.getNumPartitions() > few.rdd.getNumPartitions()
    grouped = few.groupBy("id").count()
    assert session.spread(grouped, "id") is grouped


def test_control_tables_are_bounded(spark):
    assert len(session.bounded_rows(spark.range(3), 3, "t")) == 3
    try:
        session.bounded_rows(spark.range(4), 3, "t")
        raise AssertionError
    except ValueError as e:
        assert "more than 3" in str(e)
