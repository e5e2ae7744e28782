import json

from braidframe.operators import eventlog


def lines(spark, rows):
    return spark.createDataFrame([(r if r is None or isinstance(r, str) else json.dumps(r), "x") for r in rows], "value string, event string")


def task(event, ts, attempt=0, **more):
    return {"event": event, "run_id": "r", "ts": ts, "v": 1, "task_id": "t", "task_name": "n", "attempt": attempt, **more}


def test_schema_has_one_type_per_field(spark):
    assert len(eventlog.EVENTS) == 21 and len(set(eventlog.schema().names)) == len(eventlog.schema().names)
    assert set(eventlog.STATES) <= set(eventlog.EVENTS)


def test_problems(spark):
    rows = [
        {"event": "run_started", "run_id": "r", "ts": "1", "v": 1, "workflow": "w"},
        {"event": "run_started", "run_id": "r", "chunk": "of a log"},
        {"event": "run_started", "run_id": "r", "new_field": 1},
        {"event": "other", "run_id": "r"},
        {"event": "run_started"},
        {"run_id": "r"},
        "{",
        "",
        None,
        {"event": "task_failed", "run_id": "r", "task_id": "t", "exit_code": "text", "failure": {"kind": "k"}},
    ]
    found = eventlog.parse(lines(spark, rows)).collect()
    assert [r["problem"] for r in found] == [None, "stray_field", None, "unknown_event", "no_run_id", "unknown_event", "not_json", "not_json", None]
    assert found[-1]["exit_code"] is None and found[0]["workflow"] == "w"
    assert eventlog.parse(lines(spark, []).limit(0)).count() == 0


def test_round_trip(spark):
    rows = [task("task_log", "1", stream="stdout", chunk="a\nb", sequence=3), {"event": "run_completed", "run_id": "r", "ts": "2", "v": 1, "status": "failed", "task_counts": {"failed": 2}}]
    parsed = eventlog.parse(lines(spark, rows))
    back = [r["value"] for r in eventlog.to_lines(parsed).collect()]
    assert [json.loads(x) for x in back] == rows and all(list(json.loads(x)) == sorted(json.loads(x)) for x in back)


def test_states(spark):
    rows = [
        task("task_ready", "1"), task("task_started", "2"), task("task_log", "9", chunk="late"), task("task_retrying", "3"), task("task_started", "4", 1), task("task_completed", "5", 1, cache_key="k"),
        {**task("task_completed", "1", status="cached"), "task_id": "c"}, {**task("task_started", "1"), "task_id": "s"}, {**task("task_failed", "1"), "task_id": "s"},
        {**task("task_notice", "1"), "task_id": "only"}, {"event": "other", "run_id": "r", "task_id": "bad"},
    ]
    got = {r["task_id"]: (r["state"], r["attempts"], r["started"], r["ended"], r["cache_key"]) for r in eventlog.task_states(eventlog.parse(lines(spark, rows))).collect()}
    assert got == {"t": ("succeeded", 2, "2", "5", "k"), "c": ("cached", 1, None, "1", None), "s": ("failed", 1, "1", "1", None), "only": (None, 1, None, None, None)}
