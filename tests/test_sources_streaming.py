import gzip
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from braidframe.sources import readers
from braidframe.streaming import events as streams


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,flag,note\n1,yes,"two\nlines"\n2,no,\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), "id bigint, flag string, note string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "yes", "two\nlines"), (2, "no", None)]
    (tmp_path / "b.tsv").write_text("id\tx\n1\t2\n")
    assert readers.read_tsv(spark, str(tmp_path / "b.tsv")).first()["x"] == "2"


def test_tagged_files(spark, tmp_path):
    for n in ("s 1", "s2"):
        (tmp_path / f"{n}.csv").write_text(f"v\n{n}\n")
    got = readers.read_tagged(spark, {"one": str(tmp_path / "s 1.csv"), "two": str(tmp_path / "s2.csv")}, "sample", "v string")
    assert {tuple(r) for r in got.collect()} == {("one", "s 1"), ("two", "s2")}


def test_json_and_blobs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d.json").write_text(json.dumps({"a": 5}, indent=2))
    assert readers.read_json(spark, str(tmp_path / "l.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
    assert readers.read_json(spark, str(tmp_path / "d.json"), "a int", lines=False).first()["a"] == 5
    assert {r["size"] for r in readers.read_blobs(spark, str(tmp_path), "*.jsonl").select("size").collect()} == {18}


def test_fastq(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1\nACGT\n+\nIIII\n@r2\nAC\n+\n@@\n")
    lines = readers.read_lines(spark, str(tmp_path / "r.fastq.gz"))
    numbered = lines.select("file", "value", F.monotonically_increasing_id().alias("n"))  # one file, not splittable
    stats = readers.read_stats(readers.fastq_records(numbered), 3).first()
    assert (stats["num_seqs"], stats["sum_len"], stats["min_len"]) == (1, 4, 4)


def test_text_parts(spark):
    df = spark.createDataFrame([("a\nb\nc\n",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.tail_lines("t", 2)).collect()] == ["b\nc", "x", "", None]
    assert spark.createDataFrame([("abcdef",)], "t string").select(readers.byte_prefix("t", 3)).first()[0] == "abc"


def test_pinned_lookup(spark):
    manifest = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal int, id string")
    table = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 3, 2)], "id string, v int, seq int")
    assert [r["v"] for r in readers.pinned_lookup(manifest, table, "id", F.col("seq")).collect()] == [2, 3]
    with pytest.raises(Exception, match="no row for"):
        readers.pinned_lookup(spark.createDataFrame([(0, "zz")], "ordinal int, id string"), table, "id", F.col("seq")).collect()


def test_configuration(tmp_path):
    (tmp_path / "a.toml").write_text('x = 1\n[t]\na = 1\n')
    (tmp_path / "b.json").write_text('{"t": {"b": 2}}')
    config = readers.load_config(str(tmp_path / "a.toml"), str(tmp_path / "b.json"))
    assert config == {"x": 1, "t": {"b": 2}}
    assert readers.param("x", int, given={"x": "3"}, config=config) == 3
    assert readers.param("x", int, config=config) == 1
    assert readers.param("f", bool, given={"f": "Off"}) is False
    assert readers.param("m", int, given={"m": "1, 2"}, multiple=True) == [1, 2]
    for bad in (lambda: readers.param("q"), lambda: readers.param("x", int, given={"x": "a"}), lambda: readers.param("x", given={"x": "a"}, choices=["b"]), lambda: readers.param("f", bool, given={"f": "maybe"})):
        with pytest.raises(ValueError):
            bad()


def test_random_table_is_seeded(spark):
    a, b = (readers.random_table(spark, 10, 3, 1).collect() for _ in range(2))
    assert a == b and len(a[0]) == 4


@pytest.fixture
def log(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(i, t0 + timedelta(minutes=20 * i), f"u{i % 2}", 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, user string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def test_stream_equals_batch(spark, log):
    df, folder, tmp = log
    stream = streams.stream_parquet(spark, folder, df)
    streams.drain_to_parquet(streams.windowed_counts(stream, "ts", "1 hour", "user", value="value", late="10 days"), str(tmp / "out"), str(tmp / "cp"))
    again = streams.stream_parquet(spark, folder, df)
    streams.drain_to_parquet(streams.windowed_counts(again, "ts", "1 hour", "user", value="value", late="10 days"), str(tmp / "out"), str(tmp / "cp"))
    emitted = []
    update = streams.windowed_counts(streams.stream_parquet(spark, folder, df), "ts", "1 hour", "user", late="10 days")
    streams.drain(update, lambda d, n: emitted.extend(tuple(r) for r in d.collect()), str(tmp / "cp2"), mode="update")
    batch = {tuple(r) for r in streams.windowed_counts(df, "ts", "1 hour", "user").collect()}
    assert set(emitted) == batch


def test_stream_drops_repeats(spark, log):
    df, folder, tmp = log
    df.write.mode("append").parquet(folder)
    stream = streams.first_seen(streams.stream_parquet(spark, folder, df), "ts", "30 days", "event_id")
    streams.drain_to_parquet(stream, str(tmp / "seen"), str(tmp / "cp3"))
    assert spark.read.parquet(str(tmp / "seen")).count() == 100


def test_sessions(spark, log):
    df, _, _ = log
    assert streams.session_counts(df, "ts", "30 minutes", "user").count() == 100
    assert streams.session_counts(df, "ts", "41 minutes", "user").count() == 2
