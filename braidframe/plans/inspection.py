"""Queries that describe, label, look up and check: the reporting side of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.functions import parity
from braidframe.functions.time import epoch_micros
from braidframe.operators import graph, history, tabular
from braidframe.plans.tables import table
from braidframe.session import scratch_dir

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


@query("""SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || '[' || row_number() OVER (PARTITION BY label ORDER BY event_id) || ']' ELSE label END AS shown
FROM (SELECT event_id, event_type || '-' || user_id AS label FROM events)""")
def occurrence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Repeated labels numbered in order."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("label"))
    return history.occurrence(e, "label", "event_id", "shown", F.floor(F.col("event_id") / 100_000)).select("event_id", "shown")


@query("""SELECT kind, name, CASE WHEN n = 1 THEN anchor ELSE anchor || '--' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY kind, name) AS n FROM
(SELECT DISTINCT kind, name, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '_', 'g') AS anchor FROM asset_versions WHERE name IS NOT NULL AND kind IS NOT NULL))""")
def duplicate_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of equal spelling get a suffix from the second on (a label has at most as many as there are kinds)."""
    from pyspark.sql import Window

    a = table(spark, d, "asset_versions").where("name IS NOT NULL AND kind IS NOT NULL").select("kind", "name", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "_").alias("anchor")).distinct()
    n = F.row_number().over(Window.partitionBy("anchor").orderBy("kind", "name"))
    return a.withColumn("n", n).select("kind", "name", F.when(F.col("n") == 1, F.col("anchor")).otherwise(F.concat_ws("--", "anchor", F.col("n").cast("string"))).alias("anchor"))


@query("""WITH RECURSIVE n AS (SELECT run_id, node_id AS node, max(attempt) + 1 AS attempts, count(*) AS n FROM task_runs WHERE node_id IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
e AS (SELECT DISTINCT t.run_id, t.node_id AS node, t.dep FROM (SELECT run_id, node_id, unnest(dependency_ids) AS dep FROM task_runs WHERE node_id IS NOT NULL) t JOIN n ON n.run_id = t.run_id AND n.node = t.dep),
a AS (SELECT run_id, max(node) AS root, max(node) AS node FROM n GROUP BY 1 UNION SELECT a.run_id, a.root, e.dep FROM a JOIN e ON e.run_id = a.run_id AND e.node = a.node)
SELECT run_id, root, count(*) AS n_nodes, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(n) AS BIGINT) AS n FROM a JOIN n USING (run_id, node) GROUP BY ALL""")
def tree_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Sums over everything below a root."""
    runs = table(spark, d, "task_runs").where("run_id IS NOT NULL AND node_id IS NOT NULL")
    weights = runs.groupBy("run_id", F.col("node_id").alias("node")).agg((F.max("attempt") + 1).alias("attempts"), F.count(F.lit(1)).alias("n"))
    edges = graph.known_edges(graph.edges_of(runs, ["run_id"], "node_id", "dependency_ids"), runs, ["run_id"], "node_id")
    reach = graph.reachable(edges, runs.groupBy("run_id").agg(F.max("node_id").alias("root")), ["run_id"])
    return history.roll_up(reach, weights, ["run_id"], ["attempts", "n"])


@query("""SELECT task_type, env, count(*) AS n, count(*) FILTER (status IN ('succeeded', 'failed', 'cached')) AS n_ended, count(*) FILTER (status = 'running') AS n_open FROM (SELECT DISTINCT task_run_id, task_type, env, status FROM task_runs) GROUP BY ALL""")
def dispatch_counters(spark: SparkSession, d: str) -> DataFrame:
    """Submissions and their states per executor kind."""
    r = table(spark, d, "task_runs").select("task_run_id", "task_type", "env", "status").distinct()
    return r.groupBy("task_type", "env").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("succeeded", "failed", "cached")).alias("n_ended"), F.count_if(F.col("status") == "running").alias("n_open"))


@query("""SELECT c AS "column", dtype, CAST(n AS BIGINT) AS n, CAST(n_null AS BIGINT) AS n_null, CAST(n_distinct AS BIGINT) AS n_distinct FROM (
SELECT 'env' AS c, 'string' AS dtype, count(*) AS n, count(*) - count(env) AS n_null, count(DISTINCT env) AS n_distinct FROM task_runs
UNION ALL SELECT 'node_id', 'bigint', count(*), count(*) - count(node_id), count(DISTINCT node_id) FROM task_runs
UNION ALL SELECT 'started_at', 'timestamp_ntz', count(*), count(*) - count(started_at), count(DISTINCT started_at) FROM task_runs)""")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    """Type, nulls and distinct values of columns."""
    return history.profile(table(spark, d, "task_runs"), ["env", "node_id", "started_at"])


@query("""SELECT mat_id, sha256(path || '|' || size || '|' || mtime_ns) AS stat_digest FROM (SELECT DISTINCT mat_id, path, size, mtime_ns FROM materializations WHERE path IS NOT NULL AND size IS NOT NULL AND mtime_ns IS NOT NULL)""")
def stat_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Identity of a file by path, size and time instead of content."""
    m = table(spark, d, "materializations").select("mat_id", "path", "size", "mtime_ns").na.drop().distinct()
    return m.select("mat_id", F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string")), 256).alias("stat_digest"))


@query("""SELECT name AS finding, n FROM (SELECT 'versions without artifact' AS name, count(*) AS n FROM asset_versions WHERE artifact_id IS NULL
UNION ALL SELECT 'versions deleted before created', count(*) FROM asset_versions WHERE deleted_at < created_at UNION ALL SELECT 'runs without node', count(*) FROM task_runs WHERE node_id IS NULL
UNION ALL SELECT 'runs that end before they start', count(*) FROM task_runs WHERE finished_at < started_at) WHERE n > 0""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their number, one aggregation per table."""
    v = table(spark, d, "asset_versions").agg(F.count_if(F.col("artifact_id").isNull()).alias("versions without artifact"), F.count_if(F.col("deleted_at") < F.col("created_at")).alias("versions deleted before created"))
    r = table(spark, d, "task_runs").agg(F.count_if(F.col("node_id").isNull()).alias("runs without node"), F.count_if(F.col("finished_at") < F.col("started_at")).alias("runs that end before they start"))
    rows = lambda t: t.unpivot([], t.columns, "finding", "n")
    return rows(v).unionByName(rows(r)).where("n > 0")


@query("""SELECT title, status FROM (SELECT 1 AS i, 'enough segments' AS title, CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) >= 3 THEN 'ready' ELSE 'review' END AS status
UNION ALL SELECT 2, 'orders present', CASE WHEN (SELECT count(*) FROM orders) > 0 THEN 'ready' ELSE 'review' END UNION ALL SELECT 3, 'many regions', CASE WHEN (SELECT count(*) FROM region) >= 10 THEN 'ready' ELSE 'review' END)""")
def literal_checklist(spark: SparkSession, d: str) -> DataFrame:
    """Literal rows whose status depends on the tables, by scalar subqueries."""
    ready = lambda ok: F.when(ok, "ready").otherwise("review")
    segments = table(spark, d, "customer").agg(F.count_distinct("c_mktsegment")).scalar()
    orders = table(spark, d, "orders").agg(F.count(F.lit(1))).scalar()
    regions = table(spark, d, "region").agg(F.count(F.lit(1))).scalar()
    rows = spark.createDataFrame([("enough segments",), ("orders present",), ("many regions",)], "title string")
    status = F.when(F.col("title") == "enough segments", ready(segments >= 3)).when(F.col("title") == "orders present", ready(orders > 0)).otherwise(ready(regions >= 10))
    return rows.select("title", status.alias("status"))


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 2""")
def positional_access(spark: SparkSession, d: str) -> DataFrame:
    """The second row of each group."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    return tabular.top_n_per_group(e, ["user_id"], [F.col("ts"), F.col("event_id")], 2).where("rank = 2").select("user_id", "event_id", "value")


_URI = "CASE ref_id % 4 WHEN 0 THEN 's3://' || namespace || '/' || artifact_path WHEN 1 THEN 'gs://' || namespace WHEN 2 THEN 'oci://' || namespace || '@' || kind || '/' || name ELSE artifact_path END"


@query(f"""WITH u AS (SELECT DISTINCT ref_id, {_URI} AS uri FROM asset_refs), p AS (SELECT *, regexp_matches(uri, '^(s3|gs|oci)://[^/@]+') AS ok FROM u)
SELECT ref_id, uri, CASE WHEN ok THEN split_part(uri, '://', 1) END AS scheme, CASE WHEN ok THEN regexp_extract(uri, '^[a-z0-9]+://([^/@]+)', 1) END AS bucket, CASE WHEN ok THEN nullif(regexp_extract(uri, '^[a-z0-9]+://[^/@]+@([^/]+)', 1), '') END AS space, CASE WHEN ok THEN regexp_extract(uri, '^[a-z0-9]+://[^/]+/(.*)$', 1) END AS path FROM p""")
def uri_parts(spark: SparkSession, d: str) -> DataFrame:
    """Object-store addresses of three kinds, and paths that are none, taken apart."""
    rest = F.col("ref_id") % 4
    cat = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])
    uri = F.when(rest == 0, cat("s3://", "namespace", "/", "artifact_path")).when(rest == 1, cat("gs://", "namespace")).when(rest == 2, cat("oci://", "namespace", "@", "kind", "/", "name")).otherwise(F.col("artifact_path"))
    u = table(spark, d, "asset_refs").select("ref_id", uri.alias("uri")).distinct().withColumn("u", parity.parse_uri("uri"))
    return u.select("ref_id", "uri", "u.scheme", "u.bucket", F.col("u.namespace").alias("space"), F.col("u.key").alias("path"))


_ERRORS = ("CycleError", "ImportError", "CodecError", "ShellTaskError", "PermissionError", "FileNotFoundError", "EnvPrepareError", "CacheReadError", "ValueError")
_ERROR_OF = "CASE abs(coalesce(exit_code, 0)) % 9 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERRORS)) + " END"


@query(f"""SELECT DISTINCT task_run_id, CASE WHEN e = 'CycleError' THEN 'cycle_detected' WHEN e = 'ImportError' THEN 'import_error' WHEN e = 'CodecError' THEN 'serialization_error' WHEN e = 'ShellTaskError' THEN 'shell_command_error' WHEN e = 'PermissionError' THEN 'invalid_path'
WHEN e = 'FileNotFoundError' THEN CASE WHEN m LIKE '%did not create%' THEN 'output_validation_error' ELSE 'missing_input' END WHEN e LIKE '%Env%' THEN 'env_mismatch' WHEN e LIKE '%Cache%' THEN 'cache_error' ELSE 'user_code_error' END AS kind
FROM (SELECT task_run_id, {_ERROR_OF} AS e, CASE WHEN attempt > 0 THEN name || ' did not create its output' ELSE name END AS m FROM task_runs)""")
def failure_classify(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of failures from class and message by ordered rules."""
    number = F.abs(F.coalesce("exit_code", F.lit(0))) % 9
    error = F.get(F.array(*[F.lit(e) for e in _ERRORS]), number)
    message = F.when(F.col("attempt") > 0, F.concat("name", F.lit(" did not create its output"))).otherwise(F.col("name"))
    return table(spark, d, "task_runs").select("task_run_id", parity.failure_kind(error, message).alias("kind")).distinct()


@query("""SELECT DISTINCT task_run_id, CASE WHEN exit_code IS NULL THEN 'none' WHEN exit_code = 0 THEN 'ok' WHEN exit_code IN (137, 143) THEN 'killed' WHEN exit_code BETWEEN 126 AND 127 THEN 'not runnable' ELSE 'error' END AS kind FROM task_runs""")
def classify_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules; the first that holds names the class."""
    c = F.col("exit_code")
    rules = [(c.isNull(), "none"), (c == 0, "ok"), (c.isin(137, 143), "killed"), (c.between(126, 127), "not runnable")]
    return table(spark, d, "task_runs").select("task_run_id", parity.first_match(rules, "error").alias("kind")).distinct()


@query("""SELECT DISTINCT task_run_id, replace(replace(name, 'modules', '[redacted]'), 'core', '[redacted]') AS name FROM task_runs""")
def redact_values(spark: SparkSession, d: str) -> DataFrame:
    """Known values replaced in texts."""
    return table(spark, d, "task_runs").select("task_run_id", parity.redact("name", ["core", "modules"]).alias("name")).distinct()


_KNOWN = ["align_panel", "trim_reads", "rank_compounds", "fold_counts", "plan_lanes"]


def closest_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that resemble a mistyped one, as Python's difflib finds them (no oracle: SQL lacks the measure)."""
    names = table(spark, d, "task_runs").select("base_name").distinct()
    return names.select("base_name", F.array_join(parity.close_matches("base_name", _KNOWN), ",").alias("closest"))


QUERIES["closest_names"] = closest_names


@query(f"""WITH n AS (SELECT DISTINCT base_name FROM task_runs), k AS (SELECT unnest({_KNOWN}) AS known),
s AS (SELECT base_name, known, 1 - levenshtein(base_name, known) / greatest(length(base_name), length(known))::DOUBLE AS s FROM n, k WHERE base_name IS NOT NULL),
t AS (SELECT * FROM s WHERE s >= 0.4 QUALIFY row_number() OVER (PARTITION BY base_name ORDER BY s DESC, known) <= 3)
SELECT n.base_name, string_agg(known, ',' ORDER BY s DESC, known) AS nearest FROM n JOIN t ON t.base_name = n.base_name GROUP BY 1""")
def nearest_names(spark: SparkSession, d: str) -> DataFrame:
    """The same by edit distance, without Python."""
    names = table(spark, d, "task_runs").select("base_name").distinct()
    return names.select("base_name", F.array_join(parity.closest("base_name", _KNOWN), ",").alias("nearest")).where("nearest <> ''")


# --- runs, outputs and reports --------------------------------------------------------------------

_TASKS = "(SELECT DISTINCT run_id, node_id, task_run_id, status, cached, started_at, finished_at, base_name, exit_code FROM task_runs WHERE run_id IS NOT NULL)"


@query(f"""SELECT run_id, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (coalesce(cached, FALSE)) AS cached, min(started_at) AS started_at, max(finished_at) AS finished_at,
CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'running') > 0 THEN 'running' ELSE 'succeeded' END AS state FROM {_TASKS} GROUP BY 1""")
def inspect_run(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of every run."""
    r = table(spark, d, "task_runs").where("run_id IS NOT NULL").select("run_id", "node_id", "task_run_id", "status", "cached", "started_at", "finished_at", "base_name", "exit_code").distinct()
    failed, running = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "running")
    state = F.when(F.col("failed") > 0, "failed").when(F.col("running") > 0, "running").otherwise("succeeded")
    out = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), failed.alias("failed"), running.alias("running"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    return out.withColumn("state", state)


@query(f"""WITH l AS (SELECT run_id, arg_max(text, {{'a': created_at, 'b': doc_id}}) AS log FROM documents WHERE run_id IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL GROUP BY 1),
b AS (SELECT t.task_run_id, t.run_id, t.base_name, t.exit_code, string_split(CASE WHEN right(log, 1) = chr(10) THEN left(log, length(log) - 1) ELSE log END, chr(10)) AS l FROM {_TASKS} t LEFT JOIN l USING (run_id) WHERE t.status = 'failed')
SELECT DISTINCT task_run_id, run_id, base_name, exit_code, CASE WHEN l IS NOT NULL THEN array_to_string(l[greatest(len(l) - 1, 1):len(l)], chr(10)) END AS log_tail FROM b""")
def debug_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed tasks with the end of their run's newest log."""
    from braidframe.sources.readers import tail_lines

    logs = table(spark, d, "documents").where("run_id IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL")
    newest = logs.groupBy("run_id").agg(F.max_by(tail_lines("text", 2), F.struct("created_at", "doc_id")).alias("log_tail"))
    r = table(spark, d, "task_runs").where("status = 'failed' AND run_id IS NOT NULL").select("task_run_id", "run_id", "base_name", "exit_code").distinct()
    return r.join(newest, "run_id", "left").select("task_run_id", "run_id", "base_name", "exit_code", "log_tail")


@query("""SELECT DISTINCT ref_id, kind, lower(regexp_extract(regexp_extract(artifact_path, '[^/]*$'), '^.+([.][^.]+)$', 1)) AS suffix,
CASE WHEN kind = 'table' THEN CASE lower(regexp_extract(regexp_extract(artifact_path, '[^/]*$'), '^.+([.][^.]+)$', 1)) WHEN '.csv' THEN 'csv' WHEN '.tsv' THEN 'tsv' END
WHEN kind = 'fig' THEN CASE lower(regexp_extract(regexp_extract(artifact_path, '[^/]*$'), '^.+([.][^.]+)$', 1)) WHEN '.png' THEN 'png' WHEN '.svg' THEN 'svg' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' END END AS sub_kind FROM asset_refs""")
def sub_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What a path output is, by kind and suffix."""
    return table(spark, d, "asset_refs").select("ref_id", "kind", F.lower(parity.suffix("artifact_path")).alias("suffix"), parity.sub_kind("kind", "artifact_path").alias("sub_kind")).distinct()


@query("""SELECT task_run_id, i::INT AS position, a.name AS name, a.asset_key AS asset_key, a.version_id IS NOT NULL AND trim(a.version_id) <> '' AS present
FROM (SELECT DISTINCT task_run_id, assets, unnest(assets) AS a, generate_subscripts(assets, 1) - 1 AS i FROM task_runs)""")
def output_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every output of every task in order, absent ones too."""
    r = table(spark, d, "task_runs").select("task_run_id", "assets").distinct()
    o = r.select("task_run_id", F.posexplode("assets").alias("position", "a"))
    present = F.coalesce(F.trim("a.version_id") != "", F.lit(False))
    return o.select("task_run_id", "position", "a.name", "a.asset_key", present.alias("present"))


@query("""SELECT 'table' AS kind, count(*) AS total, least(count(*), 50) AS shown, count(*) > 50 AS truncated FROM orders
UNION ALL SELECT 'text', count(*), count(*) FILTER (strlen(text) <= 4096), bool_or(strlen(text) > 4096) FROM documents WHERE text IS NOT NULL""")
def report_preview(spark: SparkSession, d: str) -> DataFrame:
    """How much of each kind a report shows: fifty rows of a table, four KiB of a text (the limits are the feature)."""
    rows = tabular.preview(table(spark, d, "orders").select("o_orderkey"), 50, [F.col("o_orderkey")]).agg(F.count(F.lit(1)).alias("shown"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    orders = table(spark, d, "orders").agg(F.count(F.lit(1))).scalar()
    long = F.octet_length("text") > 4096
    texts = table(spark, d, "documents").where("text IS NOT NULL").agg(F.count(F.lit(1)).alias("total"), F.count_if(~long).alias("shown"), F.bool_or(long).alias("truncated"))
    return rows.select(F.lit("table").alias("kind"), orders.alias("total"), "shown", "truncated").unionByName(texts.select(F.lit("text").alias("kind"), "total", "shown", "truncated"))


@query("""SELECT '<table><tr><th>segment</th><th>n</th></tr>' || string_agg('<tr><td>' || segment || '</td><td>' || n || '</td></tr>', '' ORDER BY n DESC, segment) || '</table>' AS document
FROM (SELECT c_mktsegment || ' <&>' AS raw, replace(replace(replace(c_mktsegment || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS segment, count(*) AS n FROM customer GROUP BY ALL)""")
def html_report_table(spark: SparkSession, d: str) -> DataFrame:
    """A report's table as HTML, escaped."""
    from braidframe.sources import sinks

    c = table(spark, d, "customer").groupBy(F.concat("c_mktsegment", F.lit(" <&>")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.html_table(c, [-F.col("n"), F.col("segment")])


@query("SELECT doc_id, hex(encode(text)[doc_id % 64 + 1:doc_id % 64 + 16]) AS bytes FROM documents WHERE text IS NOT NULL AND strlen(text) >= 80")
def byte_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen bytes of each text from a position of its own."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND octet_length(text) >= 80")
    return docs.select("doc_id", F.hex(parity.byte_window("text", F.col("doc_id") % 64, 16)).alias("bytes"))


@query("""SELECT 'orders ' || (SELECT count(*) FROM orders) || chr(10) || string_agg('- ' || o_orderpriority || ': ' || n, chr(10) ORDER BY o_orderpriority) AS document FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def brief_document(spark: SparkSession, d: str) -> DataFrame:
    """A brief: the number of rows, then a line for each group."""
    from braidframe.sources import sinks

    o = table(spark, d, "orders")
    counts = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = o.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("i"), F.lit("").alias("key"), F.concat(F.lit("orders "), F.col("n").cast("string")).alias("line"))
    lines = total.unionByName(counts.select(F.lit(1).alias("i"), F.col("o_orderpriority").alias("key"), F.concat(F.lit("- "), F.col("o_orderpriority"), F.lit(": "), F.col("n").cast("string")).alias("line")))
    return sinks.lines_document(lines, F.col("line"), [F.col("i"), F.col("key")])


@query("""SELECT DISTINCT mat_id, CASE WHEN m = 'stream' AND mat_id % 11 = 0 THEN 'stage' ELSE m END AS mode FROM (SELECT mat_id, CASE WHEN mat_id % 5 = 0 THEN 'stream' WHEN mat_id % 7 = 0 THEN 'stage' WHEN path LIKE '%.npy' THEN 'stage' WHEN size >= 2000000 THEN 'stream' ELSE 'auto' END AS m FROM materializations)""")
def access_mode_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How an input is read: by reference, task, pattern, size, default; staged where streaming is not available."""
    i = F.col("mat_id")
    explicit, task = F.when(i % 5 == 0, "stream"), F.when(i % 7 == 0, "stage")
    pattern = F.when(F.col("path").endswith(".npy"), "stage")
    mode = parity.access_mode(explicit, task, pattern, F.col("size"), F.lit("auto"), large=2_000_000, available=i % 11 != 0)
    return table(spark, d, "materializations").select("mat_id", mode.alias("mode")).distinct()


@query("""SELECT kind, storage_backend, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted FROM (SELECT DISTINCT artifact_id, kind, storage_backend, size, deleted_at FROM artifacts) GROUP BY ALL""")
def transfer_counters(spark: SparkSession, d: str) -> DataFrame:
    """Objects and bytes by kind and backend."""
    a = table(spark, d, "artifacts").select("artifact_id", "kind", "storage_backend", "size", "deleted_at").distinct()
    return a.groupBy("kind", "storage_backend").agg(F.count(F.lit(1)).alias("n_files"), tabular.sum0(F.col("size")).alias("bytes"), F.count("deleted_at").alias("n_deleted"))


# --- streams (extensions) -------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    import os

    from braidframe.streaming.events import stream_parquet

    like = table(spark, d, "events")
    path = f"{d}/events.parquet"
    return stream_parquet(spark, path, like) if os.path.isdir(path) else stream_parquet(spark, d, like, glob="events.parquet")


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    import uuid

    from braidframe.streaming.events import drain

    root = f"{scratch_dir(spark)}/braid-stream-{uuid.uuid4().hex}"
    drain(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={n}"), f"{root}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the tumbling windows of a stream that has been read to its end."""
    from braidframe.streaming.events import windowed_counts

    out = _drained(spark, windowed_counts(_event_stream(spark, d), "ts", "1 day"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Extension: repeats dropped from a stream while its watermark is open."""
    from braidframe.streaming.events import first_seen

    return _drained(spark, first_seen(_event_stream(spark, d), "ts", "60 days", "user_id", "event_type").select("user_id", "event_type"), "append").select("user_id", "event_type")


@query("SELECT user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY 1")
def last_activity(spark: SparkSession, d: str) -> DataFrame:
    """Newest moment per key."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max(epoch_micros("ts")).alias("last_us"))
