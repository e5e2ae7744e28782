"""Queries p1, p2, p4 and p5: the general problems on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.functions.time import epoch_micros
from braidframe.operators import drift, integrity, intervals, shred
from braidframe.plans.tables import table

#: Entities of a run manifest.
MANIFEST = (
    shred.Entity("task", ("tasks", "*"), "object"),
    shred.Entity("asset", ("tasks", "*", "assets", "#"), "object"),
    shred.Entity("item", ("tasks", "*", "inputs{}", "**", "items", "#")),
)
#: Columns of the flat tables; all else that a node holds is in its ``content``.
TASK_FIELDS = {
    "task_id": "string", "node_id": "bigint", "task": "string", "status": "string", "cached": "boolean", "env": "string", "started_at": "string", "finished_at": "string", "exit_code": "int", "attempt": "int",
    "dependency_ids/#": "bigint", "failure/kind": "string", "failure/detail/tail/#": "string", "resource_usage/peak/rss_bytes": "bigint", "resource_usage/peak/process_count": "bigint",
}
ASSET_FIELDS = {"asset_key": "string", "name": "string", "version_id": "string"}
_SUMMARY = {"type": "string", "value": "string", "length": "bigint", "dtype": "string", "shape/#": "bigint", "columns/#": "string", "rows": "bigint"}
#: An item is a value, a summary, or a key with either.
ITEM_FIELDS = {"key": "string", **_SUMMARY, **{f"value/{f}": t for f, t in _SUMMARY.items()}}


# --- p1 -------------------------------------------------------------------------------------------


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, d, "task_runs").select("task_run_id", F.explode("assets").alias("asset"), "recorded_at")
    refs = (
        integrity.references(runs.select("task_run_id", F.col("asset.version_id").alias("version_id"), "recorded_at"), "task_runs", "task_run_id", "version_id", "recorded_at", "asset_versions")
        .unionByName(integrity.references(table(spark, d, "asset_refs"), "asset_refs", "ref_id", "version_id", "recorded_at", "asset_versions"))
        .unionByName(integrity.references(table(spark, d, "materializations"), "materializations", "mat_id", "artifact_id", "recorded_at", "artifacts"))
    )
    targets = integrity.parents(table(spark, d, "asset_versions"), "asset_versions", "version_id", "created_at", "deleted_at").unionByName(
        integrity.parents(table(spark, d, "artifacts"), "artifacts", "artifact_id", "created_at", "deleted_at")
    )
    return refs, targets


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references of task_runs, asset_refs and materializations."""
    rows = integrity.orphan_rows(*_references(spark, d))
    return rows.select("ref_table", "ref_id", "target_id", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """References and dangling ones per table and month."""
    return integrity.orphan_report(*_references(spark, d))


_P1_REFS = """
refs AS (
  SELECT DISTINCT 'task_runs' AS ref_table, task_run_id AS ref_id, 'v' AS parent, lower(trim(a.version_id)) AS target_id, recorded_at
  FROM (SELECT task_run_id, unnest(assets) AS a, recorded_at FROM task_runs)
  UNION SELECT 'asset_refs', ref_id, 'v', lower(trim(version_id)), recorded_at FROM asset_refs
  UNION SELECT 'materializations', mat_id, 'a', lower(trim(artifact_id)), recorded_at FROM materializations),
good AS (SELECT * FROM refs WHERE target_id IS NOT NULL AND target_id <> ''),
parents AS (
  SELECT 'v' AS parent, lower(trim(version_id)) AS id, created_at, deleted_at FROM asset_versions
  UNION ALL SELECT 'a', lower(trim(artifact_id)), created_at, deleted_at FROM artifacts),
bad AS (
  SELECT g.*, EXISTS (SELECT 1 FROM parents p WHERE p.parent = g.parent AND p.id = g.target_id) AS known FROM good g
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = g.parent AND p.id = g.target_id
    AND p.created_at <= g.recorded_at AND (p.deleted_at IS NULL OR p.deleted_at > g.recorded_at)))
"""
P1_FOUND_SQL = f"WITH {_P1_REFS} SELECT DISTINCT ref_table, ref_id, target_id, strftime(recorded_at, '%Y-%m') AS period FROM bad"
P1_REPORT_SQL = f"""WITH {_P1_REFS},
n AS (SELECT ref_table, period, count(*) AS n_refs FROM (SELECT DISTINCT ref_table, ref_id, target_id, strftime(recorded_at, '%Y-%m') AS period FROM good) GROUP BY ALL),
b AS (SELECT ref_table, period, count(*) AS n_orphans, count(*) FILTER (NOT known) AS n_missing, count(*) FILTER (known) AS n_not_live
  FROM (SELECT ref_table, ref_id, target_id, strftime(recorded_at, '%Y-%m') AS period, bool_or(known) AS known FROM bad GROUP BY ALL) GROUP BY ALL)
SELECT n.ref_table, n.period, n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_missing, 0) AS n_missing, coalesce(n_not_live, 0) AS n_not_live
FROM n LEFT JOIN b ON n.ref_table = b.ref_table AND n.period = b.period"""


# --- p2 -------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return shred.shred(table(spark, d, "run_manifests"), "manifest_id", "manifest", MANIFEST, columns=columns or None)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Tasks, assets and items of all manifests with their own and their parent's path."""
    return shred.parent_links(_nodes(spark, d, "node", "parent", "entity", "path", "home"), "manifest_id").select("manifest_id", "node_path", "parent_path").distinct()


P2_FOUND_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT manifest_id, CAST(manifest AS JSON) AS j FROM run_manifests WHERE json_valid(manifest)),
t0 AS (SELECT manifest_id, json_extract(j, '$.tasks') AS tasks FROM m WHERE json_type(j, '$.tasks') = 'OBJECT'),
t AS (SELECT manifest_id, 'tasks/' || e.key AS np, e.value AS v FROM t0, json_each(tasks) AS e WHERE json_type(e.value) = 'OBJECT'),
a0 AS (SELECT manifest_id, np, json_extract(v, '$.assets') AS assets FROM t WHERE json_type(v, '$.assets') = 'ARRAY'),
a AS (SELECT manifest_id, np || '/assets/' || e.key AS np, np AS op FROM a0, json_each(assets) AS e WHERE json_type(e.value) = 'OBJECT'),
w AS (
  SELECT manifest_id, np || '/inputs' AS np, json_extract(v, '$.inputs') AS v, FALSE AS holds_items, FALSE AS is_item, np AS op FROM t WHERE json_type(v, '$.inputs') = 'OBJECT'
  UNION ALL
  SELECT w.manifest_id, w.np || '/' || e.key, e.value, json_type(w.v) = 'OBJECT' AND e.key = 'items' AND json_type(e.value) = 'ARRAY', w.holds_items, CASE WHEN w.is_item THEN w.np ELSE w.op END
  FROM w, json_each(w.v) AS e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY'))
SELECT manifest_id, np AS node_path, '' AS parent_path FROM t UNION SELECT * FROM a UNION SELECT manifest_id, np, op FROM w WHERE is_item"""


def p2_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One row per task of a manifest."""
    return shred.entity_table(_nodes(spark, d), "manifest_id", "task", TASK_FIELDS)


def p2_assets(spark: SparkSession, d: str) -> DataFrame:
    """One row per asset of a task."""
    return shred.entity_table(_nodes(spark, d), "manifest_id", "asset", ASSET_FIELDS)


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per item of a list, tuple or dict value in a task's inputs."""
    return shred.entity_table(_nodes(spark, d), "manifest_id", "item", ITEM_FIELDS)


# --- p4 -------------------------------------------------------------------------------------------


def _cache_meta(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    return table(spark, d, "cache_meta_raw"), drift.alias_map(table(spark, d, "field_aliases"))


#: Only the keys of these objects are fields beside the top-level ones.
META = (("meta",), ("meta", "env_hash"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed or retyped between a producer's consecutive files."""
    return p4_changes(spark, d).select("file_id", "change", "old_path", "new_path").distinct()


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same with the types on either side, each sorted."""
    found = drift.changes(*_cache_meta(spark, d), META)
    return found.select("file_id", "change", "old_path", "new_path", F.array_join("old_kinds", ",").alias("old_kinds"), F.array_join("new_kinds", ",").alias("new_kinds"))


def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    """The fused schema of all objects at any depth: each field's alternatives and spellings over all files."""
    return drift.fused_schema(*_cache_meta(spark, d)).select("field", "n_files", F.array_join("kinds", ",").alias("kinds"), F.array_join("spellings", ",").alias("spellings"))


#: More fields than this stay in the map column of p4_entries; p4_values has every field of any file with its type.
MOST_COLUMNS = 500


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """All entries in one table, conflicting types split into branches."""
    raw, names = _cache_meta(spark, d)
    common = drift.fused_schema(raw, names, META).orderBy(F.desc("n_files"), "field").limit(MOST_COLUMNS)
    return drift.entries(raw, names, {r["field"]: list(r["kinds"]) for r in common.collect()}, META)


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """All entries with all their fields at any depth, one row per field, in typed branches."""
    return drift.values(*_cache_meta(spark, d))


_P4_TYPE = "CASE json_type(e.value) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'fraction' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'whole' END"
_P4 = f"""
names AS (SELECT alias, min(field) AS field FROM field_aliases WHERE alias IS NOT NULL AND field IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT raw_id, file_id, CAST(record AS JSON) AS j FROM cache_meta_raw WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
f1 AS (SELECT raw_id, file_id, e.key AS spelled, coalesce(n.field, e.key) AS field, {_P4_TYPE} AS kind, e.value FROM r, json_each(j) AS e LEFT JOIN names n ON n.alias = e.key WHERE json_type(e.value) <> 'NULL'),
f2 AS (SELECT raw_id, file_id, f.spelled || '.' || e.key AS spelled, f.field || '.' || coalesce(n.field, e.key) AS field, {_P4_TYPE} AS kind, e.value FROM f1 f, json_each(f.value) AS e LEFT JOIN names n ON n.alias = e.key WHERE f.field = 'meta' AND f.kind = 'object' AND json_type(e.value) <> 'NULL'),
f3 AS (SELECT raw_id, file_id, f.spelled || '.' || e.key AS spelled, f.field || '.' || coalesce(n.field, e.key) AS field, {_P4_TYPE} AS kind, e.value FROM f2 f, json_each(f.value) AS e LEFT JOIN names n ON n.alias = e.key WHERE f.field = 'meta.env_hash' AND f.kind = 'object' AND json_type(e.value) <> 'NULL'),
facts AS (SELECT file_id, spelled, field, kind FROM f1 UNION SELECT file_id, spelled, field, kind FROM f2 UNION SELECT file_id, spelled, field, kind FROM f3),
s AS (SELECT file_id, field, min(spelled) AS path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM facts GROUP BY ALL),
files AS (SELECT file_id, min(producer) AS producer, min(file_seq) AS seq FROM cache_meta_raw WHERE file_id IS NOT NULL GROUP BY 1),
p AS (SELECT file_id, lag(file_id) OVER (PARTITION BY producer ORDER BY seq, file_id) AS before FROM files),
o AS (SELECT p.file_id, s.field, path, kinds FROM p JOIN s ON s.file_id = p.before), n AS (SELECT p.file_id, s.field, path, kinds FROM p JOIN s ON s.file_id = p.file_id WHERE before IS NOT NULL),
d AS (SELECT file_id, field, o.path AS old_path, n.path AS new_path, o.kinds AS old_kinds, n.kinds AS new_kinds FROM o FULL JOIN n USING (file_id, field)),
c AS (SELECT file_id, CASE WHEN old_path IS NULL THEN 'added' WHEN new_path IS NULL THEN 'removed' ELSE 'renamed' END AS change, coalesce(old_path, '') AS old_path, coalesce(new_path, '') AS new_path, old_kinds, new_kinds FROM d WHERE old_path IS DISTINCT FROM new_path
  UNION ALL SELECT file_id, 'retyped', old_path, new_path, old_kinds, new_kinds FROM d WHERE old_kinds <> new_kinds)"""
#: For files that spell a field in one way each, as all of the test tables do; tests cover the others.
P4_FOUND_SQL = f"WITH {_P4} SELECT DISTINCT file_id, change, old_path, new_path FROM c"
P4_CHANGES_SQL = f"WITH {_P4} SELECT DISTINCT file_id, change, old_path, new_path, old_kinds, new_kinds FROM c"


_P4_DEEP = f"""
WITH RECURSIVE names AS (SELECT alias, min(field) AS field FROM field_aliases WHERE alias IS NOT NULL AND field IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT raw_id, file_id, CAST(record AS JSON) AS j FROM cache_meta_raw WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
w AS (SELECT file_id, e.key AS spelled, coalesce((SELECT field FROM names WHERE alias = e.key), e.key) AS field, {_P4_TYPE} AS kind, e.value AS v FROM r, json_each(j) AS e WHERE json_type(e.value) <> 'NULL'
  UNION ALL SELECT w.file_id, w.spelled || '.' || e.key, w.field || '.' || coalesce((SELECT field FROM names WHERE alias = e.key), e.key), {_P4_TYPE}, e.value FROM w, json_each(w.v) AS e WHERE w.kind = 'object' AND json_type(e.value) <> 'NULL')"""
P4_SCHEMA_SQL = f"{_P4_DEEP} SELECT field, count(DISTINCT file_id) AS n_files, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT spelled, ',' ORDER BY spelled) AS spellings FROM w GROUP BY 1"


# --- p5 -------------------------------------------------------------------------------------------


def _executions(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "task_runs").where(F.col("node_id").isNotNull() & (F.col("finished_at") > F.col("started_at")))
    return runs.select("run_id", "node_id", epoch_micros("started_at").alias("start_us"), epoch_micros("finished_at").alias("end_us"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the executions of each node."""
    found = intervals.gaps(_executions(spark, d), ["run_id", "node_id"], "start_us", "end_us")
    return found.select("run_id", "node_id", F.col("gap_start").alias("gap_start_us"), F.col("gap_end").alias("gap_end_us"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous busy periods of each node."""
    found = intervals.periods(_executions(spark, d), ["run_id", "node_id"], "start_us", "end_us")
    return found.select("run_id", "node_id", F.col("period_start").alias("start_us"), F.col("period_end").alias("end_us"))


_P5 = """
WITH e AS (SELECT DISTINCT run_id, node_id, epoch_us(started_at) AS s, epoch_us(finished_at) AS f FROM task_runs WHERE node_id IS NOT NULL AND finished_at > started_at),
b AS (SELECT *, max(f) OVER (PARTITION BY run_id, node_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)"""
P5_FOUND_SQL = f"{_P5} SELECT run_id, node_id, before AS gap_start_us, s AS gap_end_us FROM b WHERE s > before"
P5_PERIODS_SQL = f"""{_P5}, i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, node_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT run_id, node_id, min(s) AS start_us, max(f) AS end_us FROM i GROUP BY run_id, node_id, k"""

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_tasks": p2_tasks,
    "p2_assets": p2_assets,
    "p2_items": p2_items,
    "p4_found": p4_found,
    "p4_changes": p4_changes,
    "p4_schema": p4_schema,
    "p4_entries": p4_entries,
    "p4_values": p4_values,
    "p5_found": p5_found,
    "p5_periods": p5_periods,
}

ORACLE = {
    "p1_found": P1_FOUND_SQL,
    "p1_report": P1_REPORT_SQL,
    "p2_found": P2_FOUND_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_changes": P4_CHANGES_SQL,
    "p4_schema": P4_SCHEMA_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_periods": P5_PERIODS_SQL,
}
