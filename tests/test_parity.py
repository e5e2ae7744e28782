import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidframe.functions import parity
from braidframe.functions.time import epoch_micros


def values(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("__i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("__i").select(column).collect()]


def test_rounding_equals_numpy(spark):
    nums = [2.5, 0.125, 8.345, -2.5, 1e10 + 0.5, None]
    for digits in (0, 2):
        got = values(spark, parity.round_half_even("v", digits), [(v,) for v in nums], "v double")
        assert got == [None if v is None else float(np.round(v, digits)) for v in nums]


def test_divide_and_flags(spark):
    assert values(spark, parity.divide("a", "b"), [(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double") == [None, 0.25, None]
    assert values(spark, parity.equals("a", "yes"), [("yes",), ("no",), (None,)], "a string") == [True, False, False]
    assert values(spark, parity.clip_lower("a", 1), [(0,), (None,), (5,)], "a int") == [1, None, 5]
    assert values(spark, parity.band("a", [(10, "watch"), (14, "lead")], "standard"), [(14,), (10,), (9,), (None,)], "a int") == ["lead", "watch", "standard", "standard"]
    assert values(spark, parity.map_values("a", {"x": 1.0}), [("x",), ("y",), (None,)], "a string") == [1.0, None, None]


def test_names(spark):
    texts = ["  Größe -- Été 3!", "x-ray mid_market", "___", "", None]
    assert values(spark, parity.slug("t"), [(t,) for t in texts], "t string") == ["größe_été_3", "x_ray_mid_market", "", "", None]
    assert values(spark, parity.title_case("t"), [(t,) for t in texts], "t string") == [None if t is None else t.title() for t in texts]
    assert values(spark, parity.suffix("t"), [("a/b.tar.gz",), (".hidden",), ("x/none",)], "t string") == [".gz", "", ""]


def test_quantities(spark):
    assert values(spark, parity.parse_size("t"), [("2GB",), ("1.5 K",), ("7",), ("3b",), ("x",), ("1.5 KiB",), (None,)], "t string") == [2 * 2**30, 1536, 7, 3, None, None, None]
    assert values(spark, parity.parse_duration("t"), [("5m",), (" 2h ",), ("7d",), ("1",), ("30s",), ("5 m",)], "t string") == [300, 7200, 604800, None, None, None]
    assert values(spark, parity.parse_memory_gb("t"), [("512Mi",), ("4Gi",), ("1Ti",), ("0Gi",), ("100G",), ("1M",), ("3",), ("x",), (None,)], "t string") == [1, 4, 1024, 0, 94, 1, None, None, 0]
    times = [(4.24,), (12.34,), (59.6,), (245.0,), (119.7,), (7380.4,), (28992.0,), (-3.0,), (None,)]
    assert values(spark, parity.human_duration("t"), times, "t double") == ["4.2s", "12s", "60s", "4m 05s", "1m 60s", "2h 03m 00s", "8h 03m 12s", "0.0s", "—"]
    assert values(spark, parity.human_bytes("t"), [(512,), (1536,), (5 * 2**30,), (2**51,), (-1,), (None,)], "t bigint") == ["512 B", "1.5 KB", "5.0 GB", "2048.0 TB", "0 B", "—"]
    assert values(spark, parity.human_age("t"), [(59.9,), (60.0,), (7200.0,), (86399.0,), (200000.0,), (-5.0,), (None,)], "t double") == ["59s", "1m", "2h", "23h", "2d", "0s", "-"]
    assert values(spark, parity.thousands("t"), [(1234567,), (None,)], "t bigint") == ["1,234,567", "—"]


def test_times_and_segments(spark):
    texts = ["2025-03-09T02:30:00.123456", "2025-03-09T02:30:00+01:00", "2025-03-09", "1969-12-31 23:59:59Z", "nope", "", None]
    assert values(spark, parity.iso_micros("t"), [(x,) for x in texts], "t string") == [1741487400123456, 1741483800000000, 1741478400000000, -1000000, None, None, None]
    assert values(spark, parity.elapsed_seconds(F.col("a"), F.col("b")), [(0, 1500000), (5, 1), (None, 1)], "a bigint, b bigint") == [1.5, 0.0, None]
    assert values(spark, parity.last_segment("t"), [("a.b.c",), ("x",), ("",), (None,)], "t string") == ["c", "x", "unknown", "unknown"]
    assert values(spark, parity.looks_like_flag("t"), [("--x",), ("-5",), ("-",), ("-1e3",), ("x",)], "t string") == [True, False, False, False, False]
    assert values(spark, parity.divide("a", "b", by_zero="float"), [(1.0, 0.0), (-2.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double") == [math.inf, -math.inf, 0.25, None]
    assert math.isnan(values(spark, parity.divide("a", "b", by_zero="float"), [(0.0, 0.0)], "a double, b double")[0])


def test_failure_kinds(spark):
    rows = [("CycleError", ""), ("ImportError", "x"), ("FileNotFoundError", "no file"), ("FileNotFoundError", "step did not create out"), ("PermissionError", None), ("EnvMissing", ""), ("ContainerGone", ""), ("CacheBroken", ""), ("ValueError", ""), (None, None), ("FileNotFoundError", None)]
    assert values(spark, parity.failure_kind("e", "m"), rows, "e string, m string") == ["cycle_detected", "import_error", "missing_input", "output_validation_error", "invalid_path", "env_mismatch", "env_mismatch", "cache_error", "user_code_error", "user_code_error", "missing_input"]


def test_globs_and_addresses(spark):
    table = {"a.*": "glob", "a.b": "exact", "[xy]?": "set", "*": "any"}
    assert values(spark, parity.first_glob("t", table), [("a.b",), ("a.c",), ("x1",), ("z",), (None,)], "t string") == ["exact", "glob", "set", "any", None]
    got = values(spark, parity.parse_uri("t"), [("s3://b/k/x",), ("oci://b@ns/k",), ("/local",)], "t string")
    assert [None if r is None else tuple(r) for r in got] == [("s3", "b", None, "k/x"), ("oci", "b", "ns", "k"), None]
    assert values(spark, parity.redact("t", ["key", "keyring", ""]), [("a keyring and a key",)], "t string") == ["a [redacted] and a [redacted]"]


def test_misc(spark):
    assert values(spark, parity.line_count("t"), [("a\nb\n",), ("a\nb",), ("",), (None,)], "t string") == [2, 2, 0, None]
    assert values(spark, parity.null_if_nan("t"), [(math.nan,), (1.0,)], "t double") == [None, 1.0]
    assert values(spark, parity.canonical_map("m"), [({"b": "1", "a": "2"},)], "m map<string,string>") == ['{"a":"2","b":"1"}']
    prints = values(spark, parity.fingerprint(F.col("a"), F.col("b")), [("x", "y"), ("xy", ""), (None, "xy"), ("", "xy")], "a string, b string")
    assert len(set(prints)) == 4
    assert values(spark, parity.backoff(F.lit(1.0), F.lit(2.0), F.col("a"), F.lit(5.0)), [(1,), (3,), (9,)], "a int") == [1.0, 4.0, 5.0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2025-03-09 02:30:00.123456' AS t UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.5' UNION ALL SELECT NULL")
        assert {r[0] for r in df.select(epoch_micros("t")).collect()} == {1741487400123456, -500000, None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_maps(spark):
    rows = [({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "key"}), ({"x": "key"}, None)]
    assert values(spark, parity.merge_maps("m", "n"), rows, "m map<string,string>, n map<string,string>") == [{"a": "1", "b": "3"}, {"x": "key"}, {"x": "key"}]
    assert values(spark, parity.redact_map("m", ["b"], ["1"]), rows[:2], "m map<string,string>, n map<string,string>") == [{"a": "[redacted]", "b": "[redacted]"}, None]


def test_close_matches(spark):
    import difflib

    known = ["align_panel", "trim_reads", "rank_compounds"]
    texts = ["aligned_panel", "trimreads", "zzz", "", None]
    assert values(spark, parity.close_matches("t", known), [(x,) for x in texts], "t string") == [None if x is None else difflib.get_close_matches(x, known, 3, 0.4) for x in texts]
