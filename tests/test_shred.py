import json

import pytest

from braidframe.operators import jsontext, shred
from braidframe.plans.training import ASSET_FIELDS, ITEM_FIELDS, MANIFEST, TASK_FIELDS


def nodes(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "manifest_id bigint, manifest string, node string, path string")
    return shred.shred(df, "manifest_id", "manifest", MANIFEST, **kw)


def paths(df):
    return {(r["node_path"], r["parent_path"]) for r in shred.parent_links(df, "manifest_id").collect()}


MANIFEST_TEXT = json.dumps(
    {
        "tasks": {
            "t/1": {"node_id": 3, "cached": True, "assets": [{"name": "a", "version_id": "v"}, None, "text", {"name": None}], "inputs": {"g": {"type": "list", "items": [1, {"value": {"items": [[2], None]}}]}, "items": [{"items": {"items": [7]}}]}},
            "bad": "text",
            "t2": {"assets": {"items": [1]}, "inputs": [{"items": [1]}]},
        },
        "assets": [{"name": "not in a task"}],
    }
)


def test_entities_and_owners(spark):
    want = {
        ("tasks/t/1", ""), ("tasks/t2", ""),
        ("tasks/t/1/assets/0", "tasks/t/1"), ("tasks/t/1/assets/3", "tasks/t/1"),
        ("tasks/t/1/inputs/g/items/0", "tasks/t/1"), ("tasks/t/1/inputs/g/items/1", "tasks/t/1"),
        ("tasks/t/1/inputs/g/items/1/value/items/0", "tasks/t/1/inputs/g/items/1"), ("tasks/t/1/inputs/g/items/1/value/items/1", "tasks/t/1/inputs/g/items/1"),
        ("tasks/t/1/inputs/items/0", "tasks/t/1"), ("tasks/t/1/inputs/items/0/items/items/0", "tasks/t/1/inputs/items/0"),
    }
    for columns in (None, ["node", "entity", "path", "home"]):
        assert paths(nodes(spark, [MANIFEST_TEXT], columns=columns)) == want


def test_bad_texts_give_no_rows(spark):
    bad = [None, "", "{", "[1,]", "NaN", '{"tasks": {"a": {}}} x', '{"tasks": [1]}', "3", '{"a": 01}', '"\t"']
    assert paths(nodes(spark, bad)) == set()
    assert nodes(spark, []).count() == 0


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, MANIFEST_TEXT)] * 3 + [(2, MANIFEST_TEXT)], "manifest_id bigint, manifest string")
    found = shred.parent_links(shred.shred(df, "manifest_id", "manifest", MANIFEST), "manifest_id")
    assert found.count() == 20


def test_null_keys_have_parents(spark):
    df = spark.createDataFrame([(None, MANIFEST_TEXT)], "manifest_id bigint, manifest string")
    found = shred.parent_links(shred.shred(df, "manifest_id", "manifest", MANIFEST), "manifest_id").collect()
    assert len(found) == 10 and sum(r["parent_path"] == "" for r in found) == 2


def test_adjacency_is_complete(spark):
    rows = nodes(spark, ['{"a": [1.50, null, true], "b": {"c": "x"}}']).collect()
    by = {r["node"]: r for r in rows}
    assert [(r["kind"], r["label"], r["ordinal"], r["scalar"]) for _, r in sorted(by.items())] == [
        ("object", None, 0, None), ("array", "a", 0, None), ("fraction", None, 0, "1.50"), ("null", None, 1, None), ("boolean", None, 2, "true"), ("object", "b", 1, None), ("string", "c", 0, "x"),
    ]
    assert all(r["parent"] is None or r["parent"] in by for r in rows)


def test_deep_nesting(spark):
    depth = 30_000
    text = '{"tasks": {"t": {"inputs": {"x": ' + '{"items": [' * depth + "1" + "]}" * depth + "}}}}"
    value = jsontext.read(text)
    assert jsontext.kind(value) == "object"
    small = '{"tasks": {"t": {"inputs": {"x": ' + '{"items": [' * 1500 + "1" + "]}" * 1500 + "}}}}"
    assert nodes(spark, [small], columns=["entity"]).where("entity IS NOT NULL").count() == 1501


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9\\n", {}, [], true, false, null], "b": {"c": {"d": []}}}', " [ ] ", "0", '"a"', "[[[1]]]"])
def test_iterative_reader_equals_the_other(text):
    assert jsontext._read_deep(text) == jsontext._DECODER.decode(text)


@pytest.mark.parametrize("text", ["", "[", "[1", "[1 2]", '{"a"}', '{"a":}', "{1:2}", "[1]]", "tru", '"\\x"', "-", "1.", "[,]"])
def test_iterative_reader_refuses(text):
    with pytest.raises(ValueError):
        jsontext._read_deep(text)


def test_entity_tables(spark):
    n = nodes(spark, [MANIFEST_TEXT])
    tasks = {r["node_path"]: r for r in shred.entity_table(n, "manifest_id", "task", TASK_FIELDS).collect()}
    assert tasks["tasks/t/1"]["node_id"] == 3 and tasks["tasks/t/1"]["cached"] is True and tasks["tasks/t2"]["node_id"] is None
    assets = {r["node_path"]: (r["parent_path"], r["name"], r["version_id"], r["position"]) for r in shred.entity_table(n, "manifest_id", "asset", ASSET_FIELDS).collect()}
    assert assets == {"tasks/t/1/assets/0": ("tasks/t/1", "a", "v", 0), "tasks/t/1/assets/3": ("tasks/t/1", None, None, 3)}
    wrong_type = nodes(spark, ['{"tasks": {"t": {"node_id": "text"}}}'])
    assert shred.entity_table(wrong_type, "manifest_id", "task", TASK_FIELDS).first()["node_id"] is None


def test_lone_surrogate(spark):
    (path, owner), = paths(nodes(spark, ['{"tasks": {"\\ud800": {}}}']))
    assert path.startswith("tasks/") and len(path) > 6 and owner == ""


def test_entity_tables_keep_nested_content(spark):
    frame = {"type": "pandas.DataFrame", "columns": ["b", "a"], "rows": 7}
    task = {
        "node_id": "text",
        "dependency_ids": [4, 2],
        "failure": {"kind": "timeout", "detail": {"tail": ["line 0", "line 1"]}},
        "resource_usage": {"peak": {"rss_bytes": 5, "process_count": 3}},
        "inputs": {"p": 1.5, "g": {"type": "list", "length": 3, "items": [{"key": "k", "value": frame}, {"type": "list", "length": 1, "items": [[9, {"deep": 1}]]}, "x"]}},
        "assets": [{"name": "a", "metadata": {"checks": [{"ok": True}]}}, "lost"],
    }
    n = nodes(spark, [json.dumps({"tasks": {"t": task, "none": {"dependency_ids": []}}})])
    tasks = {r["node_key"]: r for r in shred.entity_table(n, "manifest_id", "task", TASK_FIELDS).collect()}
    t = tasks["t"]
    assert (t["dependency_ids"], t["failure_kind"], t["failure_detail_tail"]) == ([4, 2], "timeout", ["line 0", "line 1"])
    assert (t["resource_usage_peak_rss_bytes"], t["resource_usage_peak_process_count"]) == (5, 3)
    assert tasks["none"]["dependency_ids"] == [] and tasks["none"]["failure_detail_tail"] is None
    want = {**task, "inputs": {"p": 1.5, "g": {"type": "list", "length": 3, "items": [None] * 3}}, "assets": [None, "lost"]}
    assert json.loads(t["content"]) == want
    (asset,) = shred.entity_table(n, "manifest_id", "asset", ASSET_FIELDS).collect()
    assert json.loads(asset["content"]) == task["assets"][0]
    items = {r["node_path"].removeprefix("tasks/t/inputs/g/items/"): r for r in shred.entity_table(n, "manifest_id", "item", ITEM_FIELDS).collect()}
    assert (items["0"]["key"], items["0"]["value"], items["0"]["value_type"], items["0"]["value_columns"], items["0"]["value_rows"]) == ("k", None, "pandas.DataFrame", ["b", "a"], 7)
    assert (items["1"]["length"], json.loads(items["1"]["content"])) == (1, {"type": "list", "length": 1, "items": [None]})
    assert json.loads(items["1/items/0"]["content"]) == [9, {"deep": 1}]
    assert items["2"]["content"] is None and items["2"]["scalar"] == "x"


def test_relative_paths_tell_keys_apart(spark):
    n = nodes(spark, ['{"tasks": {"t": {"failure/kind": "x", "dependency_ids": {"#": 1}}}}'])
    row = shred.entity_table(n, "manifest_id", "task", TASK_FIELDS).first()
    assert row["failure_kind"] is None and row["dependency_ids"] is None
    assert row["content"] == '{"dependency_ids":{"#":1},"failure/kind":"x"}'
