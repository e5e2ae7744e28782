"""Queries over the engine's own metadata: runs, events, versions, cache entries and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.functions import parity
from braidframe.functions.time import epoch_micros
from braidframe.operators import graph, history, tabular
from braidframe.plans.tables import table
from braidframe.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def mark(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return mark


# --- summaries ------------------------------------------------------------------------------------

_RUNS = "(SELECT DISTINCT task_run_id, run_id, workflow, status, cached, env, attempt, duration_s, exit_code FROM task_runs)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_runs").select("task_run_id", "run_id", "workflow", "status", "cached", "env", "attempt", "duration_s", "exit_code").distinct()


@query(f"SELECT run_id, count(*) AS n, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (cached OR status = 'cached') AS cached FROM {_RUNS} GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by state per run."""
    return _runs(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("cached") | (F.col("status") == "cached")).alias("cached"))


@query(f"SELECT workflow, round_even(coalesce(100.0 * count(*) FILTER (cached)::DOUBLE / nullif(count(cached), 0)::DOUBLE, 0), 2) AS hit_percent FROM {_RUNS} GROUP BY 1")
def hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of cached rows, 0 where there is nothing."""
    hits, all_ = F.count_if("cached").cast("double"), F.count("cached").cast("double")
    return _runs(spark, d).groupBy("workflow").agg(parity.round_half_even(parity.divide(100.0 * hits, all_, F.lit(0.0)), 2).alias("hit_percent"))


@query("SELECT string_agg(n || ' ' || namespace, ' · ' ORDER BY n DESC, namespace) AS line FROM (SELECT namespace, count(DISTINCT version_id) AS n FROM asset_versions WHERE namespace IS NOT NULL GROUP BY 1)")
def namespace_counts_desc(spark: SparkSession, d: str) -> DataFrame:
    """Counts by namespace, largest first, as one line."""
    counts = tabular.group_agg(table(spark, d, "asset_versions"), ["namespace"], F.count_distinct("version_id").alias("n"))
    line = F.concat_ws(" ", F.col("n").cast("string"), "namespace")
    return sinks.lines_document(counts, line, [-F.col("n"), F.col("namespace")], "line").select(F.replace("line", F.lit("\n"), F.lit(" · ")).alias("line"))


_PEAK = "CASE WHEN {m} IS NOT NULL THEN {{'a': {m}, 'b': sampled_at, 'c': sample_id}} END"


@query(f"""WITH s AS (SELECT DISTINCT * FROM resource_samples WHERE run_id IS NOT NULL)
SELECT run_id, count(*) AS n_samples, round_even(avg(cpu_percent), 9) AS mean_cpu, max(cpu_percent) AS peak_cpu, arg_max(sampled_at, {_PEAK.format(m="cpu_percent")}) AS peak_cpu_at, max(rss_bytes) AS peak_rss,
arg_max(rss_bytes, CASE WHEN rss_bytes IS NOT NULL THEN {{'a': sampled_at, 'b': sample_id}} END) AS last_rss, max(process_count) AS peak_processes, arg_max(sampled_at, {_PEAK.format(m="process_count")}) AS peak_processes_at FROM s GROUP BY 1""")
def sampler_peak_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean, peak, last time of the peak and last value of sampled measures."""
    s = table(spark, d, "resource_samples").where("run_id IS NOT NULL").distinct()
    u = history.usage(s, ["run_id"], "sampled_at", ["cpu_percent", "rss_bytes", "process_count"], "sample_id")
    shown = {"peak_cpu": "peak_cpu_percent", "peak_cpu_at": "peak_cpu_percent_at", "peak_rss": "peak_rss_bytes", "last_rss": "last_rss_bytes", "peak_processes": "peak_process_count", "peak_processes_at": "peak_process_count_at"}
    return u.select("run_id", "n_samples", parity.round_half_even("mean_cpu_percent", 9).alias("mean_cpu"), *[F.col(c).alias(n) for n, c in shown.items()])


@query(f"SELECT run_id, workflow, max(attempt) AS attempts, round_even(coalesce(sum(CASE WHEN isnan(duration_s) OR duration_s < 0 THEN 0 ELSE duration_s END), 0), 2) AS seconds FROM {_RUNS} GROUP BY ALL")
def attempts_usage(spark: SparkSession, d: str) -> DataFrame:
    """Attempts take the maximum, seconds add up; what is no measurement counts as 0."""
    good = F.when(F.isnan("duration_s") | (F.col("duration_s") < 0), 0.0).otherwise(F.col("duration_s"))
    return _runs(spark, d).groupBy("run_id", "workflow").agg(F.max("attempt").alias("attempts"), parity.round_half_even(tabular.sum0(good), 2).alias("seconds"))


@query("SELECT storage_backend, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT artifact_id, storage_backend, size FROM artifacts) GROUP BY 1")
def store_size(spark: SparkSession, d: str) -> DataFrame:
    """Bytes per storage backend."""
    a = table(spark, d, "artifacts").select("artifact_id", "storage_backend", "size").distinct()
    return a.groupBy("storage_backend").agg(F.count(F.lit(1)).alias("n"), tabular.sum0(F.col("size")).alias("bytes"))


@query("SELECT k AS key, count(*) AS n, CAST(sum(CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN CAST(v AS BIGINT) END) AS BIGINT) AS total FROM (SELECT unnest(map_entries(metadata)).key AS k, unnest(map_entries(metadata)).value AS v FROM (SELECT DISTINCT version_id, metadata FROM asset_versions)) GROUP BY 1")
def dynamic_dimension_sum(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the keys of a map column."""
    rows = table(spark, d, "asset_versions").select("version_id", F.array_sort(F.map_entries("metadata")).alias("m")).distinct()
    kv = rows.select(F.inline("m"))
    whole = F.when(F.col("value").rlike("^-?[0-9]+$"), F.col("value").try_cast("bigint"))
    return kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("total"))


# --- versions, cache, retention -------------------------------------------------------------------


@query("""WITH v AS (SELECT DISTINCT namespace, name, version_id, created_at FROM asset_versions)
SELECT namespace, name, arg_max(version_id, {'a': created_at, 'b': version_id}) AS latest, count(DISTINCT version_id) AS n_versions FROM v GROUP BY ALL""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Latest version and number of versions per asset."""
    v = table(spark, d, "asset_versions").select("namespace", "name", "version_id", "created_at")
    return v.groupBy("namespace", "name").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("latest"), F.count_distinct("version_id").alias("n_versions"))


@query("""WITH a AS (SELECT artifact_id, min(created_at) AS created_at, max(size) AS size FROM artifacts GROUP BY 1),
m AS (SELECT *, created_at < TIMESTAMP '2025-09-01' AS aged FROM a),
r AS (SELECT *, sum(CASE WHEN aged THEN 0 ELSE coalesce(size, 0) END) OVER w AS kept_bytes, sum(CASE WHEN aged THEN 0 ELSE 1 END) OVER w AS kept FROM m WINDOW w AS (ORDER BY created_at DESC NULLS LAST, artifact_id DESC ROWS UNBOUNDED PRECEDING))
SELECT artifact_id, size, coalesce(aged, FALSE) OR kept_bytes > 1500000000 OR kept > 800 AS evicted FROM r""")
def cumulative_budget_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Which entries age and budgets would evict, oldest first."""
    a = table(spark, d, "artifacts").groupBy("artifact_id").agg(F.min("created_at").alias("created_at"), F.max("size").alias("size"))
    return history.evict(a, "artifact_id", "size", "created_at", keep_bytes=1_500_000_000, keep_count=800, older_than="2025-09-01").select("artifact_id", "size", "evicted")


@query("""WITH i AS (SELECT DISTINCT task_run_id, workflow, started_at, finished_at FROM task_runs WHERE started_at IS NOT NULL AND finished_at IS NOT NULL),
p AS (SELECT workflow, started_at AS t, 1 AS o, 1 AS w FROM i UNION ALL SELECT workflow, finished_at, 0, -1 FROM i),
u AS (SELECT workflow, t, o, sum(w) AS w FROM p GROUP BY ALL), r AS (SELECT workflow, sum(w) OVER (PARTITION BY workflow ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS s FROM u)
SELECT workflow, CAST(greatest(max(s), 0) AS BIGINT) AS peak_running FROM r GROUP BY 1""")
def interval_sweep_peak(spark: SparkSession, d: str) -> DataFrame:
    """The most executions of a workflow that ran at once; an end comes before a start at the same moment."""
    i = table(spark, d, "task_runs").select("task_run_id", "workflow", "started_at", "finished_at").distinct()
    return history.sweep_peak(i, "started_at", "finished_at", {"running": F.lit(1).cast("bigint")}, ["workflow"])


@query("""WITH l AS (SELECT user_id, event_type AS field, CASE WHEN event_type = 'error' AND value < 5 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS value, ts, event_id FROM events)
SELECT user_id, field, value FROM l QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) = 1 AND value IS NOT NULL""")
def log_compaction_lww(spark: SparkSession, d: str) -> DataFrame:
    """A patch log replayed: the last patch of a field wins, a null deletes it."""
    e = table(spark, d, "events")
    value = F.when((F.col("event_type") == "error") & (F.col("value") < 5), F.lit(None)).otherwise(F.col("event_id").cast("string"))
    patches = e.select("user_id", F.col("event_type").alias("field"), value.alias("value"), "ts", "event_id")
    return history.compact(patches, ["user_id"], "field", "value", ["ts", "event_id"])


@query("""WITH v AS (SELECT DISTINCT namespace || ':' || name AS key, version_id, created_at FROM asset_versions WHERE namespace IS NOT NULL AND name IS NOT NULL), latest AS (SELECT key, arg_max(version_id, {'a': created_at, 'b': version_id}) AS latest, arg_min(version_id, {'a': created_at, 'b': version_id}) AS first FROM v GROUP BY 1),
q AS (SELECT ref_id, namespace || ':' || name AS key, CASE ref_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'first' ELSE version_id END AS selector FROM (SELECT DISTINCT ref_id, namespace, name, version_id FROM asset_refs))
SELECT ref_id, q.key, selector, CASE WHEN selector IS NULL THEN latest WHEN selector = 'first' AND first IS NOT NULL THEN first ELSE selector END AS version_id FROM q LEFT JOIN latest l ON q.key = l.key""")
def version_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Selectors resolved: none to the latest, an alias to its version, else a version id."""
    key = F.concat_ws(":", "namespace", "name")
    named = F.col("namespace").isNotNull() & F.col("name").isNotNull()
    versions = table(spark, d, "asset_versions").where(named).select(key.alias("key"), "version_id", "created_at").distinct()
    aliases = versions.groupBy("key").agg(F.min_by("version_id", F.struct("created_at", "version_id")).alias("version_id")).withColumn("alias", F.lit("first"))
    asked = table(spark, d, "asset_refs").select("ref_id", "namespace", "name", "version_id").distinct()
    selector = F.when(F.col("ref_id") % 3 == 1, F.lit("first")).when(F.col("ref_id") % 3 == 2, F.col("version_id"))
    asked = asked.select("ref_id", F.when(named, key).alias("key"), selector.alias("selector"))
    return history.resolve_version(asked, versions, aliases, "key").select("ref_id", "key", "selector", "version_id")


@query("""WITH e AS (SELECT DISTINCT cache_key, base_name AS function, env, workflow, recorded_at, task_run_id FROM task_runs WHERE cache_key IS NOT NULL AND base_name IS NOT NULL),
p AS (SELECT *, lag(env) OVER w AS env0, lag(workflow) OVER w AS workflow0, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY function ORDER BY recorded_at, task_run_id))
SELECT task_run_id, CASE WHEN k = 1 THEN 'first' WHEN env IS DISTINCT FROM env0 AND workflow IS DISTINCT FROM workflow0 THEN 'env,workflow' WHEN env IS DISTINCT FROM env0 THEN 'env' WHEN workflow IS DISTINCT FROM workflow0 THEN 'workflow' ELSE '' END AS moved FROM p""")
def cache_explain(spark: SparkSession, d: str) -> DataFrame:
    """Which components of a cache key moved since the function's previous entry."""
    from braidframe.operators.ordered import neighbour

    e = table(spark, d, "task_runs").where("cache_key IS NOT NULL AND base_name IS NOT NULL").select("cache_key", F.col("base_name").alias("function"), "env", "workflow", "recorded_at", "task_run_id").distinct()
    before = neighbour(e, ["function"], F.floor(epoch_micros("recorded_at") / history.DAY_US), ["recorded_at", "task_run_id"], F.struct("env", "workflow"), "before")
    moved = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"before.{c}")), F.lit(c)) for c in ("env", "workflow")]))
    return before.select("task_run_id", F.when(F.col("before").isNull(), "first").otherwise(F.array_join(moved, ",")).alias("moved"))


# --- graphs ---------------------------------------------------------------------------------------

_EDGES = """n AS (SELECT DISTINCT run_id, node_id AS node FROM task_runs WHERE node_id IS NOT NULL AND run_id IS NOT NULL),
e0 AS (SELECT DISTINCT run_id, node_id AS node, unnest(dependency_ids) AS dep FROM task_runs WHERE node_id IS NOT NULL), e AS (SELECT e0.* FROM e0 JOIN n ON n.run_id = e0.run_id AND n.node = e0.dep)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, d, "task_runs").where("run_id IS NOT NULL")
    return runs, graph.known_edges(graph.edges_of(runs, ["run_id"], "node_id", "dependency_ids"), runs, ["run_id"], "node_id")


_WAVES = f"WITH RECURSIVE {_EDGES}, w AS (SELECT run_id, node, 0 AS wave FROM n UNION SELECT e.run_id, e.node, w.wave + 1 FROM w JOIN e ON e.run_id = w.run_id AND e.dep = w.node)"


@query(f"{_WAVES} SELECT run_id, node, max(wave)::INT AS wave FROM w GROUP BY ALL")
def dag_waves(spark: SparkSession, d: str) -> DataFrame:
    """Longest-path wave of every node of every run."""
    runs, edges = _graph(spark, d)
    return graph.waves(runs, edges, ["run_id"], "node_id")


@query(f"""{_WAVES}, l AS (SELECT run_id, node, max(wave) AS wave FROM w GROUP BY ALL),
c AS (SELECT run_id, node_id AS node, max(attempt) + 1 AS attempts, 1 AS nodes FROM task_runs WHERE node_id IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
s AS (SELECT run_id, wave, sum(attempts) AS attempts, sum(nodes) AS nodes FROM l JOIN c USING (run_id, node) GROUP BY ALL),
m AS (SELECT *, max(nodes) OVER (PARTITION BY run_id) AS top_nodes, max(attempts) OVER (PARTITION BY run_id) AS top_attempts FROM s)
SELECT run_id, count(*) AS waves, CAST(max(nodes) AS BIGINT) AS peak_nodes, (min(wave) FILTER (nodes = top_nodes))::INT AS peak_nodes_wave, CAST(sum(nodes) AS BIGINT) AS total_nodes,
CAST(max(attempts) AS BIGINT) AS peak_attempts, (min(wave) FILTER (attempts = top_attempts))::INT AS peak_attempts_wave, CAST(sum(attempts) AS BIGINT) AS total_attempts FROM m GROUP BY 1""")
def wave_peak_resources(spark: SparkSession, d: str) -> DataFrame:
    """Demand summed per wave: its peak, the first wave at the peak, the total."""
    runs, edges = _graph(spark, d)
    weights = runs.where("node_id IS NOT NULL").groupBy("run_id", F.col("node_id").alias("node")).agg((F.max("attempt") + 1).alias("attempts"), F.lit(1).alias("nodes"))
    return graph.wave_totals(graph.waves(runs, edges, ["run_id"], "node_id"), weights, ["run_id"], ["nodes", "attempts"])


@query(f"""WITH RECURSIVE {_EDGES}, root AS (SELECT run_id, max(node) AS root FROM n GROUP BY 1),
a AS (SELECT run_id, root, root AS node, 0 AS distance FROM root UNION SELECT a.run_id, a.root, e.dep, a.distance + 1 FROM a JOIN e ON e.run_id = a.run_id AND e.node = a.node)
SELECT run_id, root, node, min(distance)::INT AS distance FROM a GROUP BY ALL""")
def lineage_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Everything that each run's last node depends on, with the least distance."""
    runs, edges = _graph(spark, d)
    roots = runs.where("node_id IS NOT NULL").groupBy("run_id").agg(F.max("node_id").alias("root"))
    return graph.reachable(edges, roots, ["run_id"])


@query(f"""WITH RECURSIVE {_EDGES}, root AS (SELECT run_id, max(node) AS node FROM n GROUP BY 1),
a AS (SELECT run_id, node FROM root UNION SELECT a.run_id, e.dep FROM a JOIN e ON e.run_id = a.run_id AND e.node = a.node)
SELECT run_id, node AS node_id FROM n EXCEPT SELECT run_id, node FROM a""")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that each run's last node does not depend on."""
    runs, edges = _graph(spark, d)
    nodes = runs.where("node_id IS NOT NULL")
    roots = nodes.groupBy("run_id").agg(F.max("node_id").alias("root"))
    return graph.unreached(nodes, edges, roots, ["run_id"], "node_id")


@query(f"""WITH RECURSIVE {_EDGES}, opaque AS (SELECT DISTINCT run_id, node_id AS node FROM task_runs WHERE node_id IS NOT NULL AND task_type IN ('notebook', 'script')),
hit AS (SELECT DISTINCT run_id, node_id AS node FROM task_runs WHERE cached AND node_id IS NOT NULL EXCEPT SELECT * FROM opaque), miss AS (SELECT * FROM n EXCEPT SELECT * FROM hit),
b AS (SELECT e.run_id, e.node FROM miss JOIN e ON e.run_id = miss.run_id AND e.dep = miss.node UNION SELECT e.run_id, e.node FROM b JOIN e ON e.run_id = b.run_id AND e.dep = b.node)
SELECT n.run_id, n.node, CASE WHEN b.node IS NOT NULL OR o.node IS NOT NULL THEN 'unknown' WHEN hit.node IS NOT NULL THEN 'cached' ELSE 'will_run' END AS status
FROM n LEFT JOIN b ON n.run_id = b.run_id AND n.node = b.node LEFT JOIN hit ON n.run_id = hit.run_id AND n.node = hit.node LEFT JOIN opaque o ON o.run_id = n.run_id AND o.node = n.node""")
def cached_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What a repeated run would find cached, given that a miss, a notebook or a script makes all that follows unknown."""
    runs, edges = _graph(spark, d)
    hits = runs.where("cached AND node_id IS NOT NULL").select("run_id", F.col("node_id").alias("node"))
    opaque = runs.where("node_id IS NOT NULL AND task_type IN ('notebook', 'script')").select("run_id", F.col("node_id").alias("node"))
    nodes = runs.where("node_id IS NOT NULL").select("run_id", F.col("node_id").alias("node")).distinct()
    return graph.cached_status(nodes, edges, hits, ["run_id"], opaque)


@query(f"SELECT run_id, node, wave, CAST(row_number() OVER (PARTITION BY run_id, wave ORDER BY node) - 1 AS INT) AS \"row\" FROM ({_WAVES} SELECT run_id, node, max(wave)::INT AS wave FROM w GROUP BY ALL)")
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    """Columns and rows of every run's graph for drawing."""
    runs, edges = _graph(spark, d)
    return graph.layout(graph.waves(runs, edges, ["run_id"], "node_id"), ["run_id"])


@query("SELECT run_id, CAST(count(DISTINCT dep) AS BIGINT) AS n_deps, string_agg(DISTINCT CAST(dep AS VARCHAR), ',' ORDER BY CAST(dep AS VARCHAR)) AS deps FROM (SELECT run_id, unnest(dependency_ids) AS dep FROM task_runs) WHERE dep IS NOT NULL GROUP BY 1")
def dependency_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of all dependencies of a run's nodes."""
    deps = table(spark, d, "task_runs").select("run_id", F.explode("dependency_ids").alias("dep")).where("dep IS NOT NULL").select("run_id", F.col("dep").cast("string").alias("dep")).distinct()
    return deps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_deps"), F.array_join(F.array_sort(F.collect_list("dep")), ",").alias("deps"))


# --- logs, keys and retention ---------------------------------------------------------------------

_LOG_KIND = "CASE event_type WHEN 'view' THEN 'task_created' WHEN 'click' THEN 'task_updated' WHEN 'purchase' THEN 'task_timing' WHEN 'error' THEN 'run_update' WHEN 'signup' THEN 'run_timing' ELSE 'profile_set' END"


@query(f"""WITH l AS (SELECT user_id % 50 AS run, event_id, {_LOG_KIND} AS kind, CAST(user_id % 7 AS VARCHAR) AS task, CAST(event_id % 3 AS VARCHAR) AS field, CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS VARCHAR) END AS v, CAST(event_id % 4 AS VARCHAR) AS phase, CAST(event_id % 16 AS DOUBLE) / 16 AS seconds, event_id AS seq FROM events),
f AS (SELECT run, CASE WHEN kind = 'run_update' THEN 'run' WHEN kind = 'profile_set' THEN 'profile' ELSE 'task' END AS scope, CASE WHEN kind IN ('task_created', 'task_updated') THEN task ELSE '' END AS owner, field, v, seq FROM l WHERE kind IN ('task_created', 'task_updated', 'run_update', 'profile_set')),
r AS (SELECT run, CASE WHEN kind = 'task_created' THEN task ELSE '' END AS owner, kind = 'profile_set' AS p, max(seq) AS since FROM l WHERE kind IN ('task_created', 'profile_set') GROUP BY ALL),
k AS (SELECT f.* FROM f LEFT JOIN r ON r.run = f.run AND r.owner = f.owner AND r.p = (f.scope = 'profile') AND f.scope <> 'run' WHERE since IS NULL OR seq >= since),
s AS (SELECT run, 'task_timing' AS scope, task AS owner, phase, seconds, seq FROM l WHERE kind = 'task_timing' UNION ALL SELECT run, 'total_timing', '', phase, seconds, seq FROM l WHERE kind = 'task_timing' UNION ALL SELECT run, 'run_timing', '', phase, seconds, seq FROM l WHERE kind = 'run_timing'),
t AS (SELECT s.* FROM s LEFT JOIN r ON r.run = s.run AND r.owner = s.owner AND NOT r.p AND s.scope = 'task_timing' WHERE since IS NULL OR seq >= since)
SELECT run, scope, owner, field, arg_max({{'v': v}}, seq).v AS value FROM k GROUP BY ALL HAVING arg_max({{'v': v}}, seq).v IS NOT NULL UNION ALL SELECT run, scope, owner, phase, CAST(round(sum(seconds), 6) AS VARCHAR) FROM t GROUP BY ALL""")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """A whole log of all six patch kinds replayed."""
    kinds = {"view": "task_created", "click": "task_updated", "purchase": "task_timing", "error": "run_update", "signup": "run_timing"}
    kind = F.lit("profile_set")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    i = F.col("event_id")
    log = table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("run"), i.alias("seq"), kind.alias("kind"), (F.col("user_id") % 7).cast("string").alias("task"),
        F.create_map((i % 3).cast("string"), F.when(i % 5 > 0, i.cast("string"))).alias("fields"), (i % 4).cast("string").alias("phase"), ((i % 16).cast("double") / 16).alias("seconds"),
    )
    return history.replay(log, "run", ["seq"])


_ENTRY = "(SELECT DISTINCT base_name AS function, task_run_id, recorded_at, workflow, env, attempt, task_type, name FROM task_runs WHERE cache_key IS NOT NULL AND base_name IS NOT NULL)"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY recorded_at, task_run_id) AS k FROM {_ENTRY}),
p AS (SELECT a.task_run_id, a.env IS NULL OR b.env IS NULL AS env_open, a.env <> b.env AS env_moved, a.attempt IS NULL OR b.attempt IS NULL AS v_open, a.attempt <> b.attempt AS v_moved, a.task_type IS NULL OR b.task_type IS NULL AS s_open, a.task_type <> b.task_type AS s_moved,
  a.workflow IS NULL OR b.workflow IS NULL AS i_open, a.workflow <> b.workflow AS i_moved FROM e a JOIN e b ON a.function = b.function AND b.k = a.k - 1),
m AS (SELECT task_run_id, concat_ws(',', CASE WHEN env_open THEN 'env=not_recorded' WHEN env_moved THEN 'env=changed' END, CASE WHEN i_open THEN 'inputs.workflow=not_recorded' WHEN i_moved THEN 'inputs.workflow=changed' END, CASE WHEN s_open THEN 'source_hash=not_recorded' WHEN s_moved THEN 'source_hash=changed' END, CASE WHEN v_open THEN 'version=not_recorded' WHEN v_moved THEN 'version=changed' END) AS components,
  concat_ws(',', CASE WHEN NOT env_open AND env_moved THEN 'env_changed' END, CASE WHEN NOT i_open AND i_moved THEN 'input_changed' END, CASE WHEN NOT s_open AND s_moved THEN 'source_hash_changed' END, CASE WHEN NOT v_open AND v_moved THEN 'version_bump' END) AS reasons FROM p)
SELECT task_run_id, components, CASE WHEN reasons = '' THEN 'cache_key_changed' ELSE reasons END AS reasons FROM m WHERE components <> ''""")
def cache_key_components(spark: SparkSession, d: str) -> DataFrame:
    """For each cache entry and the same function's previous one: the components that differ or are not recorded, and the coarse reasons."""
    from braidframe.operators.ordered import neighbour

    e = table(spark, d, "task_runs").where("cache_key IS NOT NULL AND base_name IS NOT NULL").select(F.col("base_name").alias("function"), "task_run_id", "recorded_at", "workflow", "env", "attempt", "task_type", "name").distinct()
    parts = {"env": F.col("env"), "inputs.workflow": F.col("workflow"), "source_hash": F.col("task_type"), "version": F.col("attempt").cast("string")}
    listed = F.array(*[F.struct(F.lit(k).alias("component"), v.alias("digest")) for k, v in parts.items()])
    pairs = neighbour(e.withColumn("now", listed), ["function"], F.floor(epoch_micros("recorded_at") / history.DAY_US), ["recorded_at", "task_run_id"], F.col("now"), "then").where("then IS NOT NULL")
    side = lambda c: pairs.select("task_run_id", F.inline(c))
    diff = history.component_diff(side("now"), side("then"), ["task_run_id"])
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "component", "status"))), ",").alias("components")
    reasons = history.coarse_reasons(diff, ["task_run_id"]).select("task_run_id", F.array_join("reasons", ",").alias("reasons"))
    return diff.groupBy("task_run_id").agg(shown).join(reasons, "task_run_id")


@query("SELECT version_id AS entry FROM (SELECT version_id, max({'a': recorded_at, 'b': ref_id}) AS last FROM asset_refs WHERE version_id IS NOT NULL GROUP BY 1) ORDER BY last DESC NULLS LAST, version_id LIMIT 64")
def lru_retention(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of 64 payloads holds after all references (the capacity is the feature)."""
    puts = table(spark, d, "asset_refs").where("version_id IS NOT NULL").select(F.col("version_id").alias("entry"), F.col("recorded_at").alias("a"), F.col("ref_id").alias("b"))
    return history.retained(puts, "entry", ["a", "b"], 64)


@query("SELECT workflow, base_name AS phase, round_even(sum(duration_s), 6) AS seconds, count(*) AS count FROM (SELECT DISTINCT task_run_id, workflow, base_name, duration_s FROM task_runs) WHERE duration_s > 0 AND NOT isnan(duration_s) GROUP BY ALL")
def phase_profile(spark: SparkSession, d: str) -> DataFrame:
    """Seconds and observations per phase."""
    r = table(spark, d, "task_runs").select("task_run_id", "workflow", "base_name", "duration_s").distinct()
    return history.phase_profile(r, ["workflow"], "base_name", "duration_s").withColumn("seconds", parity.round_half_even("seconds", 6))


@query("""SELECT run_id, node_id, task_run_id FROM (SELECT DISTINCT run_id, coalesce(node_id, -1) AS node_id, task_run_id FROM task_runs WHERE status = 'failed' AND run_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY node_id, task_run_id) <= 3""")
def failures_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first three failures of each run by node (how many is the feature); a missing node counts as -1."""
    r = table(spark, d, "task_runs").where("status = 'failed' AND run_id IS NOT NULL").select("run_id", F.coalesce("node_id", F.lit(-1).cast("bigint")).alias("node_id"), "task_run_id").distinct()
    return tabular.top_n_per_group(r, ["run_id"], [F.col("node_id"), F.col("task_run_id")], 3).select("run_id", "node_id", "task_run_id")


@query("SELECT workflow, arg_max(run_id, {'a': started_at, 'b': run_id}) AS newest, max(started_at) AS started_at FROM task_runs WHERE started_at IS NOT NULL AND run_id IS NOT NULL GROUP BY 1")
def newest_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each workflow."""
    r = table(spark, d, "task_runs").where("started_at IS NOT NULL AND run_id IS NOT NULL")
    return r.groupBy("workflow").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("newest"), F.max("started_at").alias("started_at"))


@query("SELECT namespace, kind, count(*) AS n_versions, max(created_at) AS newest FROM (SELECT DISTINCT namespace, kind, version_id, created_at FROM asset_versions WHERE kind = 'model') GROUP BY ALL")
def model_listing(spark: SparkSession, d: str) -> DataFrame:
    """Registered models by namespace."""
    v = table(spark, d, "asset_versions").where("kind = 'model'").select("namespace", "kind", "version_id", "created_at").distinct()
    return v.groupBy("namespace", "kind").agg(F.count(F.lit(1)).alias("n_versions"), F.max("created_at").alias("newest"))


# --- texts, JSON and quantities -------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON text."""
    k = F.from_json("props", "k INT")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("""SELECT r_name, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def to_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Each group's rows as a JSON array of records."""
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    record = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return n.groupBy("r_name").agg(F.to_json(tabular.sorted_list(record, F.col("n_nationkey"))).alias("nations"))


@query("""SELECT doc_id, CASE WHEN text = '' THEN 0 WHEN right(text, 1) = chr(10) THEN length(text) - length(replace(text, chr(10), '')) ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::INT AS n_lines FROM documents""")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines per document; a last one without newline counts."""
    return table(spark, d, "documents").select("doc_id", parity.line_count("text").cast("int").alias("n_lines"))


@query("""WITH b AS (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(l[greatest(len(l) - 2, 1):len(l)], chr(10)) AS tail FROM b""")
def text_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last three lines of each document."""
    return table(spark, d, "documents").select("doc_id", readers.tail_lines("text", 3).alias("tail"))


_WRITTEN = "(SELECT DISTINCT size, CASE size % 7 WHEN 0 THEN size || '' WHEN 1 THEN size || ' KB' WHEN 2 THEN (size % 1000) || '.5G' WHEN 3 THEN (size % 50) || 'tb' WHEN 4 THEN size || 'x' WHEN 5 THEN (size % 90) || 'm' ELSE (size % 90) || 'Gi' END AS raw FROM artifacts WHERE size >= 0)"


@query(f"""WITH r AS (SELECT DISTINCT raw FROM {_WRITTEN})
SELECT raw, CASE WHEN regexp_full_match(raw, '[0-9]+([.][0-9]+)?\\s*[KMGTkmgt]?[bB]?') THEN CAST(floor(CAST(regexp_extract(raw, '^[0-9.]+') AS DOUBLE) * CASE upper(regexp_extract(raw, '[KMGTkmgt]')) WHEN 'K' THEN 1024.0 WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0 WHEN 'T' THEN 1099511627776.0 ELSE 1.0 END) AS BIGINT) END AS bytes,
CASE WHEN regexp_full_match(raw, '[0-9]+[mhd]') THEN CAST(regexp_extract(raw, '^[0-9]+') AS BIGINT) * CASE right(raw, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS seconds,
CASE WHEN regexp_full_match(raw, '[0-9]+([.][0-9]+)?\\s*(Gi|Mi|G|M|Ti|Ki)') THEN CAST(ceil(CAST(regexp_extract(raw, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(raw, '(Gi|Mi|G|M|Ti|Ki)$') WHEN 'Gi' THEN 1.0 WHEN 'Mi' THEN 1.0 / 1024 WHEN 'G' THEN 1e9 / 1073741824 WHEN 'M' THEN 1e6 / 1073741824 WHEN 'Ti' THEN 1024.0 ELSE 1.0 / 1048576 END::DOUBLE) AS BIGINT) END AS memory_gb FROM r""")
def parse_sizes_durations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, durations and memory amounts written for people."""
    z = F.col("size")
    text = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    raw = F.lit(None).cast("string")
    for rest, written in {6: text(z % 90, "Gi"), 5: text(z % 90, "m"), 4: text(z, "x"), 3: text(z % 50, "tb"), 2: text(z % 1000, ".5G"), 1: text(z, " KB"), 0: text(z, "")}.items():
        raw = F.when(z % 7 == rest, written).otherwise(raw)
    rows = table(spark, d, "artifacts").where("size >= 0").select(raw.alias("raw")).distinct()
    return rows.select("raw", parity.parse_size("raw").alias("bytes"), parity.parse_duration("raw").alias("seconds"), parity.parse_memory_gb("raw").alias("memory_gb"))


_BYTES = "CASE WHEN size IS NULL THEN '—' WHEN b < 1024 THEN b || ' B' " + " ".join(f"{'ELSE' if u == 'TB' else f'WHEN b < {m * 1024} THEN'} printf('%.1f', round_even(b / {m}.0::DOUBLE, 1)) || ' {u}'" for u, m in (("KB", 2**10), ("MB", 2**20), ("GB", 2**30), ("TB", 2**40))) + " END"


@query(f"SELECT DISTINCT artifact_id, size, {_BYTES} AS shown FROM (SELECT *, greatest(size, 0) AS b FROM artifacts)")
def human_format(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as people read them."""
    return table(spark, d, "artifacts").select("artifact_id", "size", parity.human_bytes("size").alias("shown")).distinct()


@query("""WITH r AS (SELECT DISTINCT task_run_id, CASE WHEN isnan(duration_s) THEN NULL ELSE duration_s END AS s, epoch_us(started_at) AS a, epoch_us(finished_at) AS f, name FROM task_runs),
v AS (SELECT *, greatest(s, 0) AS v, CAST(floor(greatest(s, 0) / 3600) AS BIGINT) AS h FROM r), w AS (SELECT *, CAST(floor((v - h * 3600) / 60) AS BIGINT) AS m FROM v)
SELECT task_run_id, CASE WHEN s IS NULL THEN '—' WHEN v < 10 THEN printf('%.1f', round_even(v, 1)) || 's' WHEN v < 60 THEN CAST(round_even(v, 0) AS BIGINT) || 's' WHEN v < 3600 THEN m || 'm ' || lpad(CAST(CAST(round_even(v - m * 60, 0) AS BIGINT) AS VARCHAR), 2, '0') || 's'
ELSE h || 'h ' || lpad(CAST(m AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(CAST(round_even(v - h * 3600 - m * 60, 0) AS BIGINT) AS VARCHAR), 2, '0') || 's' END AS lasted,
CASE WHEN a IS NULL THEN '-' WHEN y < 60 THEN y || 's' WHEN y < 3600 THEN y // 60 || 'm' WHEN y < 86400 THEN y // 3600 || 'h' ELSE y // 86400 || 'd' END AS age, CASE WHEN a IS NULL OR f IS NULL THEN NULL ELSE greatest((f - a) / 1e6::DOUBLE, 0.0) END AS elapsed, CASE WHEN name IS NULL OR name = '' THEN 'unknown' ELSE regexp_extract(name, '[^.]*$') END AS base
FROM (SELECT *, greatest((epoch_us(TIMESTAMP '2026-01-01') - a) // 1000000, 0) AS y FROM w) WHERE v IS NULL OR v < 1e12""")
def human_times(spark: SparkSession, d: str) -> DataFrame:
    """Durations, ages at a fixed moment, elapsed seconds and the last part of dotted names."""
    r = table(spark, d, "task_runs").select("task_run_id", parity.null_if_nan("duration_s").alias("s"), epoch_micros("started_at").alias("a"), epoch_micros("finished_at").alias("f"), "name").distinct()
    r = r.where("s IS NULL OR s < 1e12")
    age = F.floor((F.lit(1_767_225_600_000_000) - F.col("a")) / 1_000_000)
    return r.select("task_run_id", parity.human_duration("s").alias("lasted"), parity.human_age(age).alias("age"), parity.elapsed_seconds(F.col("a"), F.col("f")).alias("elapsed"), parity.last_segment("name").alias("base"))


@query("SELECT DISTINCT artifact_id, size, CASE WHEN size IS NULL THEN '—' ELSE format('{:,}', size) END AS shown FROM artifacts")
def human_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts with commas."""
    return table(spark, d, "artifacts").select("artifact_id", "size", parity.thousands("size").alias("shown")).distinct()


@query("""SELECT DISTINCT task_run_id, name, CASE WHEN name = 'core.score_stories' THEN 'exact' WHEN name LIKE 'modules.report.%' THEN 'reports' WHEN name LIKE '%.score\\_%' ESCAPE '\\' THEN 'scores' WHEN name LIKE 'qc.%' THEN 'quality' END AS override FROM task_runs""")
def glob_override(spark: SparkSession, d: str) -> DataFrame:
    """The first glob that matches; an equal name comes before any glob."""
    patterns = {"modules.report.*": "reports", "*.score_*": "scores", "qc.*": "quality", "core.score_stories": "exact"}
    return table(spark, d, "task_runs").select("task_run_id", "name", parity.first_glob("name", patterns).alias("override")).distinct()


@query("""SELECT DISTINCT mat_id, CASE WHEN path LIKE '%.npy' THEN 'stage' WHEN size >= 2000000 THEN 'stream' ELSE 'auto' END AS mode FROM materializations""")
def access_mode_resolve(spark: SparkSession, d: str) -> DataFrame:
    """How an input is read: by pattern, else by size, else the default."""
    pattern = F.when(F.col("path").endswith(".npy"), "stage")
    null = F.lit(None).cast("string")
    mode = parity.access_mode(null, null, pattern, F.col("size"), F.lit("auto"), large=2_000_000)
    return table(spark, d, "materializations").select("mat_id", mode.alias("mode")).distinct()


@query("""SELECT DISTINCT mat_id, regexp_extract(path, '[^/]*$') AS base, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS suffix FROM materializations""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Base name and suffix of paths."""
    return table(spark, d, "materializations").select("mat_id", parity.basename("path").alias("base"), parity.suffix("path").alias("suffix")).distinct()


@query("""SELECT DISTINCT task_run_id, least(1.5 * pow(2.0, attempt), 20.0) AS wait_s, least(CAST(ceil(3 * pow(1.5, attempt)) AS BIGINT), 12) AS memory_gb FROM task_runs WHERE attempt IS NOT NULL""")
def backoff_escalation(spark: SparkSession, d: str) -> DataFrame:
    """Wait before the next attempt and memory for it, both bounded."""
    a = F.col("attempt")
    return table(spark, d, "task_runs").where("attempt IS NOT NULL").select("task_run_id", parity.backoff(F.lit(1.5), F.lit(2.0), a + 1, F.lit(20.0)).alias("wait_s"), parity.escalate(F.lit(3), F.lit(1.5), a, F.lit(12).cast("bigint")).alias("memory_gb")).distinct()


@query("""SELECT 'asset_versions' AS name, count(*) AS n_rows, count(*) > 0 AS not_empty, bool_and(version_id IS NOT NULL) AS ids_complete FROM asset_versions""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks over a whole table in one aggregation."""
    return table(spark, d, "asset_versions").agg(F.lit("asset_versions").alias("name"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) > 0).alias("not_empty"), F.bool_and(F.col("version_id").isNotNull()).alias("ids_complete"))
