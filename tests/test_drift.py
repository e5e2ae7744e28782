import json

from braidframe.operators import drift

RAW = "raw_id bigint, file_id bigint, producer string, file_seq int, file_name string, line_no int, record string, field string, kind string"
ALIASES = {"ver": "v", "V": "v", "Meta": "meta", "envHash": "env_hash", "lock": "pixi_lock"}


def raw(spark, files):
    """files: {file_id: (producer, seq, [record, ...])}"""
    rows = [(i * 100 + n, i, p, s, f"f{i}", n, r if r is None or isinstance(r, str) else json.dumps(r), "x", "x") for i, (p, s, rs) in files.items() for n, r in enumerate(rs)]
    return spark.createDataFrame(rows, RAW)


META = (("meta",), ("meta", "env_hash"))


def changes(spark, files, nested=META):
    return {(r["file_id"], r["change"], r["old_path"], r["new_path"]) for r in drift.changes(raw(spark, files), ALIASES, nested).collect()}


def test_any_depth(spark):
    files = {1: ("p", 1, [{"a": [1]}, {"x": {"y": {"z": 1}}}]), 2: ("p", 2, [{"a": {"b": 1}}, {"x": {"y": {"z": "1"}}}])}
    assert changes(spark, files, None) == {(2, "retyped", "a", "a"), (2, "added", "", "a.b"), (2, "retyped", "x.y.z", "x.y.z")}
    assert changes(spark, files) == {(2, "retyped", "a", "a")}


def test_every_spelling_comes_and_goes(spark):
    files = {1: ("p", 1, [{"q": 1}]), 2: ("p", 2, [{"v": 1}, {"ver": 2}]), 3: ("p", 3, [{"q": 1}])}
    assert changes(spark, files) == {(2, "removed", "q", ""), (2, "added", "", "v"), (2, "added", "", "ver"), (3, "removed", "v", ""), (3, "removed", "ver", ""), (3, "added", "", "q")}


def test_long_form(spark):
    files = {1: ("p", 1, [{"v": 1, "ver": "2", "o": {"p": [True], "n": None}}, {"f": 1.5, "b": False, "w": 10**40}, None, "[]"])}
    df = raw(spark, files)
    rows = {(r["line_no"], r["spelled"]): r for r in drift.values(df.union(df), ALIASES).collect()}
    assert {k: (r["path"], r["kind"], r["value"]) for k, r in rows.items()} == {
        (0, "v"): ("v", "whole", "1"), (0, "ver"): ("v", "string", "2"), (0, "o"): ("o", "object", '{"n":null,"p":[true]}'), (0, "o.p"): ("o.p", "array", "[true]"),
        (1, "f"): ("f", "fraction", "1.5"), (1, "b"): ("b", "boolean", "false"), (1, "w"): ("w", "whole", str(10**40)),
    }
    assert int(rows[0, "v"]["as_whole"]) == 1 and rows[0, "ver"]["as_string"] == "2" and rows[1, "f"]["as_fraction"] == 1.5
    assert rows[1, "b"]["as_boolean"] is False and rows[0, "o.p"]["as_json"] == "[true]" and rows[1, "w"]["as_whole"] is None
    assert drift.values(df.limit(0), ALIASES).count() == 0


def test_added_removed_renamed_retyped(spark):
    files = {
        1: ("p", 1, [{"v": 1, "meta": {"env_hash": {"lock": "a"}, "x": None}}]),
        2: ("p", 3, [{"ver": 1.0, "Meta": {"env_hash": {"pixi_lock": "a"}}, "new": True}]),
        3: ("q", 2, [{"other": 1}]),
    }
    assert changes(spark, files) == {
        (2, "renamed", "v", "ver"), (2, "retyped", "v", "ver"), (2, "renamed", "meta", "Meta"),
        (2, "renamed", "meta.env_hash", "Meta.env_hash"), (2, "renamed", "meta.env_hash.lock", "Meta.env_hash.pixi_lock"), (2, "added", "", "new"),
    }


def test_lines_that_are_no_objects(spark):
    files = {1: ("p", 1, [{"a": 1}]), 2: ("p", 2, [None, "", "[1]", "3", '{"a": 1', "NaN"]), 3: ("p", 4, [{"a": 1}])}
    assert changes(spark, files) == {(2, "removed", "a", ""), (3, "added", "", "a")}


def test_several_types_and_repeated_rows(spark):
    one = [{"a": 1}, {"a": "1"}]
    files = {1: ("p", 1, one * 2), 2: ("p", 2, list(reversed(one))), 3: ("p", 3, [{"a": [1]}, {"a": {"b": 1}}])}
    assert changes(spark, files) == {(3, "retyped", "a", "a")}


def test_numbers_as_written(spark):
    files = {1: ("p", 1, ['{"a": 1}']), 2: ("p", 2, ['{"a": 1.0}']), 3: ("p", 3, ['{"a": 1e2}']), 4: ("p", 4, ['{"a": 123456789012345678901234567890}'])}
    assert changes(spark, files) == {(2, "retyped", "a", "a"), (4, "retyped", "a", "a")}


def test_env_hash_that_is_no_object(spark):
    files = {1: ("p", 1, [{"meta": {"envHash": {"k": 1}}}]), 2: ("p", 2, [{"meta": {"envHash": "text"}}])}
    assert changes(spark, files) == {(2, "removed", "meta.envHash.k", ""), (2, "retyped", "meta.envHash", "meta.envHash")}


def test_order_of_files(spark):
    files = {i: ("p", s, [{"a": 1, f"k{s}": 1}]) for i, s in ((9, 10), (4, 9000), (7, 5000))}
    assert {c for c in changes(spark, files) if c[1] == "removed"} == {(7, "removed", "k10", ""), (4, "removed", "k5000", "")}


def test_missing_producer_and_number(spark):
    files = {1: (None, None, [{"a": 1}]), 2: (None, 1, [{"b": 1}])}
    assert changes(spark, files) == {(2, "removed", "a", ""), (2, "added", "", "b")}


def test_empty(spark):
    assert changes(spark, {}) == set()


def test_aliases(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "b"), (None, "c"), ("d", None)], "alias string, field string")
    assert drift.alias_map(df) == {"a": "b"}


def test_entries_split_into_branches(spark):
    files = {1: ("p", 1, [{"v": 1, "meta": {"lock": "x"}}, {"ver": "2", "odd": [2, 1]}, {"V": 2.5}, None, "[]"])}
    df = raw(spark, files)
    fields = {r["field"]: list(r["kinds"]) for r in drift.fused_schema(df, ALIASES).collect()}
    assert fields["v"] == ["fraction", "string", "whole"]
    fields.pop("odd")
    rows = {r["line_no"]: r for r in drift.entries(df.union(df), ALIASES, fields).collect()}
    assert sorted(rows) == [0, 1, 2]
    assert (rows[0]["v"], int(rows[0]["v__whole"]), rows[0]["v__string"]) == ("1", 1, None)
    assert (rows[1]["v"], rows[1]["v__string"], rows[1]["v__whole"]) == ("2", "2", None)
    assert rows[2]["v__fraction"] == 2.5 and rows[1]["rest"] == {"odd": "[2,1]"} and rows[0]["meta"] == '{"lock":"x"}'
