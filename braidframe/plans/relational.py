"""Scans, projections, joins, set operations and sorts on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.functions import parity
from braidframe.functions.time import epoch_micros, month_of
from braidframe.operators import graph, history, tabular
from braidframe.plans.tables import table

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


# --- joins ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, n_name, r_name, strftime(o_orderdate, '%Y-%m') AS order_month, round_even(o_totalprice - c_acctbal, 2) AS above_balance
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def star_left_join_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Fact with three chained dimensions and derived columns."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    star = tabular.star_join(orders, [(table(spark, d, "customer"), ["c_custkey"]), (nation, ["c_nationkey"]), (region, ["n_regionkey"])])
    return star.select("o_orderkey", "c_name", "n_name", "r_name", month_of("o_orderdate").alias("order_month"), parity.round_half_even(F.col("o_totalprice") - F.col("c_acctbal"), 2).alias("above_balance"))


@query("""WITH ps AS (SELECT l_partkey, l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL)
SELECT p_partkey, l_suppkey AS suppkey, s_name, quantity FROM part LEFT JOIN ps ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def multi_match_left_join(spark: SparkSession, d: str) -> DataFrame:
    """One part, several suppliers: every match gives a row, parts without any stay."""
    supplied = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("suppkey")).agg(F.sum("l_quantity").alias("quantity"))
    names = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "suppkey")
    joined = tabular.star_join(table(spark, d, "part"), [(supplied, ["p_partkey"]), (names, ["suppkey"])])
    return joined.select("p_partkey", "suppkey", "s_name", "quantity")


@query("""WITH lanes AS (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN lanes ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey WHERE s_nationkey IS NOT NULL""")
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join on two columns, then rows without a match dropped (Catalyst makes it an inner join)."""
    placed = tabular.star_join(
        table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"),
        [(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["o_orderkey"]), (table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), ["c_custkey"])],
    )
    lanes = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"), "s_nationkey").distinct()
    return tabular.left_join(placed, lanes, ["l_suppkey", "nation"]).na.drop(subset=["s_nationkey"]).select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_suppkey", "s_nationkey")


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)")
def semi_join_impacted(spark: SparkSession, d: str) -> DataFrame:
    """Orders that occur among the returned lines."""
    hit = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05))
    return tabular.in_set(table(spark, d, "orders"), "o_orderkey", hit, "l_orderkey")


@query("""SELECT artifact_id, kind, size FROM (SELECT DISTINCT artifact_id, kind, size FROM artifacts) a
WHERE NOT EXISTS (SELECT 1 FROM asset_versions v WHERE v.artifact_id = a.artifact_id) AND NOT EXISTS (SELECT 1 FROM materializations m WHERE m.artifact_id = a.artifact_id)""")
def anti_join_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """Stored artifacts that neither the catalogue nor any materialisation names."""
    stored = table(spark, d, "artifacts").select("artifact_id", "kind", "size").distinct()
    return tabular.not_in_any(stored, "artifact_id", [(table(spark, d, "asset_versions"), "artifact_id"), (table(spark, d, "materializations"), "artifact_id")])


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, a.n AS before, b.n AS after,
CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_outer_component_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two states compared: added, removed, changed, same."""
    counts = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    return tabular.key_diff(counts(1996), counts(1997), "custkey", "n")


@query("""WITH base AS (SELECT base_name, max(cpu_percent) AS peak_cpu FROM resource_samples WHERE cpu_percent >= 0 AND base_name IS NOT NULL GROUP BY 1)
SELECT t.task_run_id, t.base_name, peak_cpu, CASE WHEN b.base_name IS NULL THEN 'missing' WHEN peak_cpu > 400 THEN 'high' ELSE 'ok' END AS verdict
FROM (SELECT DISTINCT task_run_id, base_name FROM task_runs) t LEFT JOIN base b ON t.base_name = b.base_name""")
def lookup_join_missing_marker(spark: SparkSession, d: str) -> DataFrame:
    """Records against a baseline; those without one are marked."""
    base = table(spark, d, "resource_samples").where("cpu_percent >= 0")
    base = tabular.group_agg(base, ["base_name"], F.max("cpu_percent").alias("peak_cpu"), F.lit(True).alias("known"))
    runs = table(spark, d, "task_runs").select("task_run_id", "base_name").distinct()
    verdict = parity.first_match([(F.col("known").isNull(), "missing"), (F.col("peak_cpu") > 400, "high")], "ok")
    return tabular.left_join(runs, base, ["base_name"]).select("task_run_id", "base_name", "peak_cpu", verdict.alias("verdict"))


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events),
p AS (SELECT *, lag(event_id) OVER w AS before, lag(ts) OVER w AS before_ts, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top, count(*) OVER (PARTITION BY user_id) AS n
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, coalesce(before, CASE WHEN n > 1 THEN top END) AS prior FROM p""")
def prior_entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each event the same user's newest earlier one, else the newest other one."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return history.prior_entry(events, ["user_id"], "ts", "event_id").select("event_id", "user_id", "prior")


@query("""SELECT user_id, min(ts) FILTER (event_type = 'signup') AS started, max(ts) FILTER (event_type = 'purchase') AS finished,
CAST(epoch_us(max(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'signup')) AS DOUBLE) / 1e6 AS seconds FROM events GROUP BY 1""")
def event_pair_duration(spark: SparkSession, d: str) -> DataFrame:
    """First begin to last end per key, by conditional aggregation instead of a self-join."""
    return history.paired_events(table(spark, d, "events"), ["user_id"], "event_type", "ts", "signup", "purchase")


@query("""WITH n AS (SELECT DISTINCT run_id, node_id FROM task_runs WHERE node_id IS NOT NULL),
e AS (SELECT DISTINCT run_id, node_id AS node, unnest(dependency_ids) AS dep FROM task_runs WHERE node_id IS NOT NULL)
SELECT e.run_id, e.node, e.dep FROM e JOIN n ON n.run_id = e.run_id AND n.node_id = e.dep""")
def edge_join(spark: SparkSession, d: str) -> DataFrame:
    """Dependency lists as edges; those to unknown nodes are dropped."""
    runs = table(spark, d, "task_runs")
    return graph.known_edges(graph.edges_of(runs, ["run_id"], "node_id", "dependency_ids"), runs, ["run_id"], "node_id")


@query("""WITH refs AS (SELECT ref_id, version_id, recorded_at FROM asset_refs), v AS (SELECT DISTINCT version_id, kind, artifact_id, created_at, namespace, name FROM asset_versions),
v1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY created_at, namespace, name, artifact_id, kind) = 1),
r1 AS (SELECT * FROM refs WHERE version_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY recorded_at, ref_id) = 1)
SELECT r1.version_id, ref_id, kind, artifact_id FROM r1 JOIN v1 ON r1.version_id = v1.version_id""")
def dedup_version_lookup(spark: SparkSession, d: str) -> DataFrame:
    """References looked up in the catalogue: repeats and misses skipped."""
    v = table(spark, d, "asset_versions").select("version_id", "kind", "artifact_id", "created_at", "namespace", "name")
    v = tabular.keep_first(v, ["version_id"], [F.col(c) for c in ("created_at", "namespace", "name", "artifact_id", "kind")])
    r = table(spark, d, "asset_refs").select("ref_id", "version_id", "recorded_at").where("version_id IS NOT NULL")
    r = tabular.keep_first(r, ["version_id"], [F.col("recorded_at"), F.col("ref_id")])
    return r.join(v, "version_id").select("version_id", "ref_id", "kind", "artifact_id")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal, o_orderkey FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS ordinal, o_orderkey AS mirrored FROM orders)
SELECT a.ordinal, o_orderkey, mirrored FROM a JOIN b ON a.ordinal = b.ordinal""")
def positional_zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of equal length joined by position."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    up = tabular.number_rows(orders, month, [F.col("o_orderdate"), F.col("o_orderkey")]).select("ordinal", "o_orderkey")
    down = tabular.number_rows(orders, -month, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("ordinal", F.col("o_orderkey").alias("mirrored"))
    return tabular.zip_ordinal(up, down).select(F.col("ordinal").cast("bigint").alias("ordinal"), "o_orderkey", "mirrored")


@query("""SELECT a.task_run_id, a.env, b.n_env FROM (SELECT DISTINCT task_run_id, env FROM task_runs) a
LEFT JOIN (SELECT env, count(DISTINCT task_run_id) AS n_env FROM task_runs GROUP BY env) b ON a.env IS NOT DISTINCT FROM b.env""")
def null_safe_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join in which null keys match each other, as they do in data frames in memory."""
    runs = table(spark, d, "task_runs").select("task_run_id", "env").distinct()
    counts = runs.groupBy("env").agg(F.count("task_run_id").alias("n_env"))
    return tabular.left_join(runs, counts, ["env"], null_keys_match=True)


# --- projections and filters ----------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 7500 THEN 'lead' WHEN c_acctbal >= 2500 THEN 'watch' ELSE 'standard' END AS band FROM customer")
def bands(spark: SparkSession, d: str) -> DataFrame:
    """Threshold bands, highest first."""
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", parity.band("c_acctbal", [(2500, "watch"), (7500, "lead")], "standard").alias("band"))


@query("""SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN 0.75 WHEN 'HOUSEHOLD' THEN 1.0 END::DOUBLE AS weight FROM customer""")
def dict_map(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lookup; what is not in it becomes null."""
    weights = {"BUILDING": 1.5, "MACHINERY": 0.75, "HOUSEHOLD": 1.0}
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", parity.map_values("c_mktsegment", weights).alias("weight"))


@query("""SELECT sample_id, coalesce(cpu_percent >= 100, FALSE) AS busy, coalesce(rss_bytes >= 1000000000, FALSE) AS large, coalesce(base_name = 'align_panel', FALSE) AS is_align,
CASE WHEN coalesce(cpu_percent >= 100, FALSE) AND coalesce(rss_bytes >= 1000000000, FALSE) AND NOT coalesce(base_name = 'align_panel', FALSE) THEN 'advance' ELSE 'watch' END AS mark FROM (SELECT DISTINCT * FROM resource_samples)""")
def flags_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons that are False on null, and a conjunction of them."""
    s = table(spark, d, "resource_samples").distinct()
    flags = s.select("sample_id", parity.flag(F.col("cpu_percent") >= 100).alias("busy"), parity.flag(F.col("rss_bytes") >= 1_000_000_000).alias("large"), parity.equals("base_name", "align_panel").alias("is_align"))
    return flags.withColumn("mark", F.when(F.col("busy") & F.col("large") & ~F.col("is_align"), "advance").otherwise("watch"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS returned_quantity FROM lineitem")
def where_default(spark: SparkSession, d: str) -> DataFrame:
    """A value where a condition holds, else a default."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parity.where("l_quantity", F.col("l_returnflag") == "R", 0.0).alias("returned_quantity"))


@query("SELECT DISTINCT sample_id, CASE WHEN cpu_percent IS NULL THEN NULL ELSE greatest(cpu_percent, 1.0) END AS cpu FROM resource_samples")
def clip_min(spark: SparkSession, d: str) -> DataFrame:
    """Values raised to a least one; null stays null."""
    return table(spark, d, "resource_samples").select("sample_id", parity.clip_lower("cpu_percent", 1.0).alias("cpu")).distinct()


@query("SELECT DISTINCT task_run_id, least(duration_s, CAST(node_id AS DOUBLE)) AS smaller FROM task_runs WHERE duration_s IS NULL OR NOT isnan(duration_s)")
def row_min(spark: SparkSession, d: str) -> DataFrame:
    """Row-wise minimum that skips nulls."""
    runs = table(spark, d, "task_runs").where(F.col("duration_s").isNull() | ~F.isnan("duration_s"))
    return runs.select("task_run_id", F.least("duration_s", F.col("node_id").cast("double")).alias("smaller")).distinct()


@query("SELECT p_partkey, round_even(9 - log10(p_retailprice), 3) AS log_score, round_even(p_retailprice / p_size, 2) AS per_unit FROM part")
def log_score(spark: SparkSession, d: str) -> DataFrame:
    """Logarithm and quotient, rounded half to even."""
    return table(spark, d, "part").select("p_partkey", parity.round_half_even(9 - F.log10("p_retailprice"), 3).alias("log_score"), parity.round_half_even(parity.divide("p_retailprice", "p_size"), 2).alias("per_unit"))


@query("SELECT p_partkey, p_name FROM part WHERE (p_size >= 45 OR p_retailprice > 2000) AND p_type <> 'ECONOMY' AND p_brand IN ('Brand#2', 'Brand#17', 'Brand#9')")
def predicate_mix(spark: SparkSession, d: str) -> DataFrame:
    """Range, disjunction, inequality and IN list in one pushed filter."""
    p = table(spark, d, "part").where(((F.col("p_size") >= 45) | (F.col("p_retailprice") > 2000)) & (F.col("p_type") != "ECONOMY") & F.col("p_brand").isin("Brand#2", "Brand#17", "Brand#9"))
    return p.select("p_partkey", "p_name")


@query("""SELECT l_orderkey, l_linenumber, round_even(CAST(l_returnflag = 'R' AS INT) * 4.0 + CAST(l_linestatus = 'O' AS INT) * 2.5 + l_quantity / 10.0 - l_discount * 3.0, 2) AS score FROM lineitem""")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Flags by weight plus a ratio minus a penalty."""
    flag = lambda c, v: parity.equals(c, v).cast("int")
    s = flag("l_returnflag", "R") * 4.0 + flag("l_linestatus", "O") * 2.5 + F.col("l_quantity") / 10.0 - F.col("l_discount") * 3.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parity.round_half_even(s, 2).alias("score"))


@query("SELECT DISTINCT task_run_id, run_id, node_id, started_at, finished_at FROM task_runs WHERE node_id IS NOT NULL AND started_at IS NOT NULL AND finished_at IS NOT NULL")
def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows complete in the named columns."""
    return table(spark, d, "task_runs").select("task_run_id", "run_id", "node_id", "started_at", "finished_at").na.drop(subset=["node_id", "started_at", "finished_at"]).distinct()


@query("""WITH n AS (SELECT count(*) AS total FROM part) SELECT p_brand, count(*) AS n, (SELECT total FROM n) AS total, round_even(100.0 * count(*) / (SELECT total FROM n), 1) AS percent FROM part GROUP BY 1""")
def constant_from_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A scalar of the whole table beside every group's row."""
    groups = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n")).scalar()
    return groups.withColumn("total", total).withColumn("percent", parity.round_half_even(100.0 * F.col("n") / F.col("total"), 1))


# --- set operations -------------------------------------------------------------------------------


@query("""SELECT 'refs' AS origin, lower(trim(version_id)) AS version_id, recorded_at FROM asset_refs UNION ALL SELECT 'versions', lower(trim(version_id)), created_at FROM asset_versions""")
def union_all_tagged(spark: SparkSession, d: str) -> DataFrame:
    """UNION ALL with a column that tells where a row is from."""
    norm = F.lower(F.trim("version_id")).alias("version_id")
    return tabular.union_tagged({"refs": table(spark, d, "asset_refs").select(norm, "recorded_at"), "versions": table(spark, d, "asset_versions").select(norm, F.col("created_at").alias("recorded_at"))}, "origin")


@query("SELECT artifact_id FROM asset_versions UNION SELECT artifact_id FROM materializations")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """All ids that either table names."""
    return table(spark, d, "asset_versions").select("artifact_id").union(table(spark, d, "materializations").select("artifact_id")).distinct()


@query("SELECT artifact_id FROM artifacts EXCEPT SELECT artifact_id FROM materializations")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    """Ids of one table that the other lacks."""
    return table(spark, d, "artifacts").select("artifact_id").subtract(table(spark, d, "materializations").select("artifact_id"))


@query("SELECT artifact_id FROM artifacts INTERSECT SELECT artifact_id FROM materializations")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Ids in both tables."""
    return table(spark, d, "artifacts").select("artifact_id").intersect(table(spark, d, "materializations").select("artifact_id"))


@query("SELECT version_id, ref_id, recorded_at FROM asset_refs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY recorded_at, ref_id) = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key."""
    refs = table(spark, d, "asset_refs").select("version_id", "ref_id", "recorded_at")
    return tabular.keep_first(refs, ["version_id"], [F.col("recorded_at"), F.col("ref_id")])


# --- sorts and limits -----------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part ORDER BY p_brand, p_size DESC, p_retailprice DESC, p_partkey")
def mixed_sort(spark: SparkSession, d: str) -> DataFrame:
    """Several keys, mixed directions."""
    return tabular.sort_nulls_last(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), [("p_brand", True), ("p_size", False), ("p_retailprice", False), ("p_partkey", True)])


@query("SELECT sample_id, base_name, rss_bytes FROM (SELECT DISTINCT * FROM resource_samples) ORDER BY rss_bytes DESC NULLS LAST, sample_id")
def null_last_sort(spark: SparkSession, d: str) -> DataFrame:
    """Nulls last in either direction."""
    return tabular.sort_nulls_last(table(spark, d, "resource_samples").distinct().select("sample_id", "base_name", "rss_bytes"), [("rss_bytes", False), ("sample_id", True)])


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS ordinal, o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 50 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def preview_limit(spark: SparkSession, d: str) -> DataFrame:
    """A preview of 50 rows and whether there are more."""
    head = tabular.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return head.select("ordinal", "o_orderkey", "o_totalprice", "truncated")


@query("""WITH s AS (SELECT c_mktsegment, round_even(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1) SELECT * FROM s ORDER BY balance DESC, c_mktsegment DESC LIMIT 1""")
def rank_top(spark: SparkSession, d: str) -> DataFrame:
    """The first of a ranked list, without ranking it."""
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(parity.round_half_even(F.sum("c_acctbal"), 2).alias("balance"))
    return s.agg(F.max_by(F.struct("c_mktsegment", "balance"), F.struct("balance", "c_mktsegment")).alias("r")).select("r.*")


@query("SELECT CAST(epoch_us(ts) AS BIGINT) AS us, event_id FROM events")
def iso_to_micros(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps as microseconds, whatever the session's zone."""
    return table(spark, d, "events").select(epoch_micros("ts").alias("us"), "event_id")
