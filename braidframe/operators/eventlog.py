"""Typed events of runs and tasks: JSON lines in and out, checks, and the state that a log leads to.

Everything here works on tables and on streams alike but for :func:`task_states`, which aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of every event, of every task event, and of each kind of event beside those.
EVERY_EVENT = "event string, run_id string, ts string, v int"
EVERY_TASK = "task_id string, task_name string, attempt int, display_label string"
EVENTS = {
    "graph_node_registered": "task_id string, task_name string, kind string, env string, dependency_ids array<string>",
    "graph_expanded": "parent_task_id string, new_node_ids array<string>",
    "task_cache_hit": f"{EVERY_TASK}, cache_key string",
    "task_cache_miss": f"{EVERY_TASK}, cache_key string",
    "task_ready": f"{EVERY_TASK}, resources map<string,string>",
    "task_started": f"{EVERY_TASK}, kind string, env string, resources map<string,string>, remote_job_id string, execution_backend string",
    "task_running": f"{EVERY_TASK}, remote_job_id string",
    "task_staging": f"{EVERY_TASK}, status string, remote_input_count bigint, access_method string",
    "task_streaming_mounted": f"{EVERY_TASK}, scheme string, bucket string, mount_seconds double",
    "task_streaming_unmounted": f"{EVERY_TASK}, scheme string, bucket string, unmount_seconds double, bytes_read bigint, range_requests bigint",
    "task_log": f"{EVERY_TASK}, stream string, chunk string, sequence bigint",
    "task_notice": f"{EVERY_TASK}, message string",
    "task_retrying": f"{EVERY_TASK}, retries_remaining int, failure map<string,string>, delay_seconds double",
    "task_completed": f"{EVERY_TASK}, status string, cache_key string, outputs array<map<string,string>>, remote_job_id string",
    "task_failed": f"{EVERY_TASK}, exit_code int, failure map<string,string>, remote_job_id string",
    "env_prepare_started": f"{EVERY_TASK}, env string",
    "env_prepare_completed": f"{EVERY_TASK}, env string",
    "env_prepare_failed": f"{EVERY_TASK}, env string, error string",
    "run_started": "workflow string",
    "run_validated": "task_count bigint, edge_count bigint, env_count bigint",
    "run_completed": "status string, task_counts map<string,bigint>, error string",
}
# Which state of a task an event leads to; other events leave it as it is.
STATES = {
    "task_ready": "ready",
    "task_staging": "staging",
    "task_started": "running",
    "task_running": "running",
    "task_retrying": "waiting",
    "task_cache_hit": "cached",
    "task_completed": "succeeded",
    "task_failed": "failed",
}


def _fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def schema() -> T.StructType:
    """All fields of all events, each once; fields of one name have one type."""
    found: dict[str, T.StructField] = {}
    for ddl in (EVERY_EVENT, EVERY_TASK, *EVENTS.values()):
        for f in _fields(ddl):
            if found.setdefault(f.name, f).dataType != f.dataType:
                raise TypeError(f"two types of {f.name}")
    return T.StructType(list(found.values()))


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """Every line as a row of all fields, with ``problem``: not_json, unknown_event, no_run_id, stray_field or null.

    A stray field is one that another kind of event has. Values of another type than the field's are
    null. Null lines are left out; other columns of ``lines`` are ignored.
    """
    all_fields = schema()
    d = lines.where(F.col(text).isNotNull()).select(F.from_json(text, all_fields).alias("e"), F.json_object_keys(F.col(text)).alias("__keys"))
    known = F.array(*[F.lit(n) for n in all_fields.names])
    own: Column = F.lit(None).cast("array<string>")
    for event, ddl in EVENTS.items():
        names = [f.name for f in (*_fields(EVERY_EVENT), *_fields(ddl))]
        own = F.when(F.col("e.event") == event, F.array(*[F.lit(n) for n in names])).otherwise(own)
    stray = F.size(F.array_intersect(F.array_except("__keys", own), known)) > 0
    problem = (
        F.when(F.col("__keys").isNull(), "not_json")
        .when(~F.coalesce(F.col("e.event").isin(*EVENTS), F.lit(False)), "unknown_event")
        .when(F.col("e.run_id").isNull(), "no_run_id")
        .when(stray, "stray_field")
    )
    return d.select("e.*", problem.alias("problem"))


def to_lines(events: DataFrame) -> DataFrame:
    """(value): each event as JSON with the fields of its kind only, keys sorted, null fields left out; unknown kinds are left out."""
    there = set(events.columns)
    line: Column = F.lit(None).cast("string")
    for event, ddl in EVENTS.items():
        names = sorted({f.name for f in (*_fields(EVERY_EVENT), *_fields(ddl))} & there)
        line = F.when(F.col("event") == event, F.to_json(F.struct(*names))).otherwise(line)
    return events.select(line.alias("value")).where("value IS NOT NULL")


def task_states(events: DataFrame, order: Sequence[str] = ("ts", "attempt")) -> DataFrame:
    """(run_id, task_id, state, attempts, started, ended, cache_key): the last state of each task.

    Of events at equal places the later state in the order of STATES counts. A completion that says
    ``cached`` is cached. Rows with a problem or without a task are left out.
    """
    state: Column = F.lit(None).cast("string")
    rank: Column = F.lit(None).cast("int")
    for i, (event, name) in enumerate(STATES.items()):
        state = F.when(F.col("event") == event, F.when((F.lit(event) == "task_completed") & (F.col("status") == "cached"), "cached").otherwise(name)).otherwise(state)
        rank = F.when(F.col("event") == event, i).otherwise(rank)
    good = events.where(F.col("task_id").isNotNull() & (F.col("problem").isNull() if "problem" in events.columns else F.lit(True)))
    last = F.max_by(state, F.when(state.isNotNull(), F.struct(*order, rank.alias("rank"))))
    ended = F.col("event").isin("task_completed", "task_failed", "task_cache_hit")
    return good.groupBy("run_id", "task_id").agg(
        last.alias("state"),
        (F.max("attempt") + 1).alias("attempts"),
        F.min(F.when(F.col("event") == "task_started", F.col("ts"))).alias("started"),
        F.max(F.when(ended, F.col("ts"))).alias("ended"),
        F.max("cache_key").alias("cache_key"),
    )
