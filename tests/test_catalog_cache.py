import numpy as np
import pytest
from pyspark.sql import functions as F

from braidframe.catalog import Asset, Catalog, CheckFailed, array_asset, model_asset, nested_references, reserve_names, text_asset
from braidframe.resultcache import ResultCache
from braidframe.sources import sinks


def test_register_resolve_read(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    one = cat.register(Asset(spark.range(3), "numbers", checks={"not_empty": lambda d: F.count(F.lit(1)) > 0}), run_id="r1")
    again = cat.register(Asset(spark.range(3).orderBy(F.desc("id")), "numbers"), run_id="r1")
    assert one == again
    two = cat.register(Asset(spark.range(4), "numbers"), run_id="r2", parents=[one, one])
    assert [tuple(r) for r in cat.assets().select("kind", "name", "latest", "n_versions").collect()] == [("table", "numbers", two, 2)]
    assert cat.read("table:numbers").count() == 4 and cat.read("numbers", one).count() == 3
    cat.set_alias("numbers", "prod", one)
    assert cat.read("numbers", "prod").count() == 3
    cat.set_alias("numbers", "prod")
    assert cat.resolve("numbers", "prod")[2] == two
    assert [tuple(r) for r in cat.lineage().collect()] == [(two, one)]
    for bad in (lambda: cat.resolve("nope"), lambda: cat.resolve("numbers", "nope")):
        with pytest.raises(KeyError):
            bad()


def test_registering_a_read_table_again(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    one = cat.register(Asset(spark.range(10), "first"), run_id="r", )
    two = cat.register(Asset(cat.read("first"), "second"), run_id="r")
    assert cat.read("first", one).count() == 10 and cat.read("second", two).count() == 10
    assert cat.versions().select("path").distinct().count() == 1
    seqs = sorted(r["seq"] for r in cat.versions().collect())
    assert seqs == [0, 1] and cat._next("versions", "seq bigint") == 2 and cat._next("versions", "seq bigint") == 3


def test_texts_and_arrays(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register(text_asset(spark, "note", "# hi", "markdown", caption="A note", group="notes"), run_id="r")
    assert cat.read_text("note") == "# hi" and cat.versions().first()["metadata"] == {"form": "markdown", "caption": "A note", "group": "notes"}
    with pytest.raises(ValueError):
        text_asset(spark, "bad", "{", "json")
    values = np.arange(24, dtype="float32").reshape(4, 3, 2)
    cat.register(array_asset(spark, "cube", values), run_id="r")
    back = cat.read_array("cube")
    assert back.dtype == values.dtype and (back == values).all()
    cat.register(model_asset(spark, "m", {"f1": 0.5}), run_id="r")
    assert cat.read("model:m").first()["value"] == 0.5
    with pytest.raises(TypeError):
        array_asset(spark, "objects", np.array(["a"], dtype=object))


def test_names_of_outputs(spark):
    rows = [("t", "table", None, 2), ("t", "table", None, 1), ("t", "table", "x", 3), ("t", "table", "x", 4), ("u", "text", "x", 5), ("u", "text", None, 6)]
    got = {r["i"]: (r["asset_name"], r["duplicate"]) for r in reserve_names(spark.createDataFrame(rows, "task string, kind string, name string, i int"), "task", "kind", "name", ["i"]).collect()}
    assert got == {1: ("t.table[0]", False), 2: ("t.table[1]", False), 3: ("x", True), 4: ("x", True), 5: ("x", False), 6: ("u.text[0]", False)}


def test_failed_check_publishes_nothing(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    with pytest.raises(CheckFailed, match="positive"):
        cat.register(Asset(spark.range(3), "n", checks={"positive": lambda d: F.bool_and(F.col("id") > 0)}), run_id="r")
    assert cat.versions().count() == 0


def test_ambiguous_and_bytes_only(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register(Asset(spark.range(1), "x"), run_id="r")
    cat.register(Asset(spark.range(1), "x", kind="file"), run_id="r")
    with pytest.raises(KeyError, match="ambiguous"):
        cat.resolve("x")
    with pytest.raises(TypeError):
        cat.read("file:x")
    with pytest.raises(ValueError):
        Asset(spark.range(1), "x", kind="other")


def test_second_run_hits(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    made = []

    def step(n):
        made.append(n)
        return spark.range(n)

    for _ in range(2):
        assert cache.run(step, n=3).count() == 3
    assert made == [3] and (cache.hits, cache.misses) == (1, 1)
    cache.run(step, n=4)
    cache.run(step, n=3, version=2)
    assert made == [3, 4, 3]
    diff = {r["component"]: r["change"] for r in cache.explain(step, n=4, version=2).collect()}
    assert diff["input:n"] == "changed" and diff["version"] == "same"
    assert cache.prune(keep_count=1) == 2 and cache.entries().count() == 1


def test_changed_files_miss(spark, tmp_path):
    cache, path = ResultCache(spark, str(tmp_path / "cache")), str(tmp_path / "in")
    step = lambda d: d.selectExpr("count(*) AS n")
    spark.range(40).write.parquet(path)
    assert cache.run(step, d=spark.read.parquet(path)).first()["n"] == 40
    assert cache.run(step, d=spark.read.parquet(path)).first()["n"] == 40 and (cache.hits, cache.misses) == (1, 1)
    spark.range(3).write.mode("overwrite").parquet(path)
    assert cache.run(step, d=spark.read.parquet(path)).first()["n"] == 3 and cache.misses == 2
    for rows in ([(1,)], [(2,)], [(1,)]):
        cache.run(step, d=spark.createDataFrame(rows, "v int"))
    assert (cache.hits, cache.misses) == (2, 4)
    assert cache.clear() == 4 and cache.entries().count() == 0


def helper(n):
    return n


def test_source_closure_and_damaged_entries(spark, tmp_path, monkeypatch):
    from braidframe import resultcache

    def step(n):
        return spark.range(helper(n))

    before = resultcache.source_closure(step)
    monkeypatch.setitem(globals(), "helper", lambda n: n + 1)
    assert resultcache.source_closure(step) != before
    cache = ResultCache(spark, str(tmp_path))
    cache.run(step, n=3)
    victim = next(p for p in (tmp_path / "data").rglob("*.parquet") if p.stat().st_size)
    victim.unlink()
    assert cache.run(step, n=3).count() == 4 and cache.misses == 2
    assert cache.run(step, n=3).count() == 4 and cache.hits == 1


def test_nested_references():
    assert nested_references({"a": ["asset:table:x", ("asset:text:y", 3)], "b": {"c": "asset:table:x"}, "asset:model:k": None}) == ["table:x", "text:y", "model:k"]


def test_tables_as_inputs(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    step = lambda d: d.where("id > 0")
    cache.run(step, d=spark.range(3))
    cache.run(step, d=spark.range(3))
    assert cache.misses <= 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "i int, s string")
    stats = sinks.write_parquet(df, str(tmp_path / "t"))
    assert stats["byte_size"] > 0
    assert stats["row_count"] == 2 and stats["schema"][0] == {"name": "i", "dtype": "int"}
    assert sinks.records(df, [F.col("i")]).first()[0] == '[{"i":1},{"i":2,"s":"b"}]'
    assert sinks.markdown_table(df, [F.col("i")]).first()[0].splitlines()[2:] == ["| 1 |  |", "| 2 | b |"]
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy("i")) != sinks.content_digest(df.limit(1))
    digest = sinks.content_digest(df)
    path = sinks.write_once(df, str(tmp_path / "cas"), digest)
    assert path == sinks.write_once(df.limit(0), str(tmp_path / "cas"), digest) and spark.read.parquet(path).count() == 2
    sinks.append_events(df, str(tmp_path / "log"))
    sinks.append_events(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert spark.read.text(str(tmp_path / "log")).first()[0].startswith('{"i":')


def test_digest_tells_rows_apart(spark):
    schema = "a string, b double, m map<string,int>"
    frames = [[(None, 1.0, None)], [("", 1.0, None)], [("x", None, {"k": 1})], [("x", None, {"k": 2})], [("x", None, None)], [("x", None, None)] * 2, []]
    assert len({sinks.content_digest(spark.createDataFrame(f, schema)) for f in frames}) == len(frames)


def test_remote_files(spark, tmp_path):
    from braidframe.sources import remote

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    ref = remote.RemoteRef(f"file://{tmp_path}/a")
    assert remote.stat(spark, ref)["is_folder"] and remote.stat(spark, ref)["size"] >= 5
    assert remote.stat(spark, remote.RemoteRef(f"file://{tmp_path}/none")) is None
    assert [r["size"] for r in remote.listing(spark, ref, "*.txt").collect()] == [5]
    copy = remote.resolve(spark, ref, root=f"file://{tmp_path}/shared")
    assert spark.read.text(copy).first()[0] == "hello" and copy == remote.stage(spark, ref, root=f"file://{tmp_path}/shared")
    assert remote.resolve(spark, remote.RemoteRef(ref.uri, access="stream")) == ref.uri and remote.resolve(spark, ref, large=1) == ref.uri
    remote.upload(spark, f"file://{tmp_path}/a", remote.RemoteRef(f"file://{tmp_path}/b"))
    assert (tmp_path / "b" / "x.txt").read_text() == "hello"
    assert remote.s3("b", "/k").spark_path == "s3a://b/k" and remote.oci("b", "n", "k").uri == "oci://b@n/k"
    for bad in (lambda: remote.RemoteRef("no address"), lambda: remote.RemoteRef("s3://b/k", access="x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        remote.stage(spark, remote.RemoteRef(f"file://{tmp_path}/none"))


def test_folders_by_content(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name / "deep er").mkdir(parents=True)
        (tmp_path / name / "x.bin").write_bytes(b"\x00\xff")
        (tmp_path / name / "deep er" / "y.txt").write_text("hi")
    assert {(r["file"], r["size"]) for r in sinks.folder_manifest(spark, str(tmp_path / "a")).collect()} == {("x.bin", 2), ("deep er/y.txt", 2)}
    one, two = (sinks.folder_once(spark, str(tmp_path / n), str(tmp_path / "cas")) for n in ("a", "b"))
    assert one == two
    (tmp_path / "b" / "x.bin").write_bytes(b"\x01")
    assert sinks.folder_once(spark, str(tmp_path / "b"), str(tmp_path / "cas"))[0] != one[0]
    from pathlib import Path

    assert (Path(one[1]) / "deep er" / "y.txt").read_text() == "hi"
