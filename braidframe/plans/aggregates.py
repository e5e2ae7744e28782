"""Aggregations, rankings and fan-out sweeps on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.functions import parity
from braidframe.functions.time import month_of
from braidframe.operators import fanout, models, tabular
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


def _cents(c: str) -> F.Column:
    """Exact money: sums do not depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS order_month, c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS urgent_total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY ALL""")
def month_segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Joined fact by month and segment: count, sum and conditional sum."""
    joined = tabular.left_join(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer"), ["c_custkey"])
    joined = joined.withColumn("order_month", month_of("o_orderdate")).withColumn("urgent", parity.where("o_totalprice", parity.equals("o_orderpriority", "1-URGENT"), 0.0)).withColumnRenamed("c_mktsegment", "segment")
    out = tabular.group_agg(joined, ["order_month", "segment"], F.count(F.lit(1)).alias("orders"), _cents("o_totalprice").alias("total"), _cents("urgent").alias("urgent_total"))
    return out.orderBy("order_month", "segment")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round_even(sum(l_extendedprice * (1 - l_discount)), 0) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL""")
def filtered_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Filter, then two keys with several sums in one pass."""
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return tabular.group_agg(lines, ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), parity.round_half_even(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("net"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS priority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY ALL)
SELECT priority, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, round_even(CAST(sum(total) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0), 1) AS per_order FROM m GROUP BY 1""")
def re_aggregate_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A finer summary rolled up, then a ratio of sums."""
    fine = table(spark, d, "orders").groupBy(month_of("o_orderdate").alias("month"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    coarse = fine.groupBy("priority").agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"))
    return coarse.withColumn("per_order", parity.round_half_even(parity.divide("total", F.col("n").cast("double")), 1))


@query("""SELECT workflow, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (cached) AS n_cached, count(*) FILTER (exit_code <> 0) AS n_nonzero FROM (SELECT DISTINCT task_run_id, workflow, status, cached, exit_code FROM task_runs) WHERE workflow IS NOT NULL GROUP BY 1""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts under conditions, per group."""
    runs = table(spark, d, "task_runs").select("task_run_id", "workflow", "status", "cached", "exit_code").distinct()
    return tabular.group_agg(runs, ["workflow"], F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if("cached").alias("n_cached"), F.count_if(F.col("exit_code") != 0).alias("n_nonzero"))


@query("""SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, max(c_acctbal) AS most, round_even(avg(c_acctbal), 2) AS mean, round_even(avg(CAST(c_acctbal > 0 AS DOUBLE)), 3) AS share_positive FROM customer GROUP BY 1""")
def mixed_aggs(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum, maximum and means of numbers and booleans."""
    positive = (F.col("c_acctbal") > 0).cast("double")
    return tabular.group_agg(table(spark, d, "customer"), ["c_mktsegment"], F.count(F.lit(1)).alias("n"), _cents("c_acctbal").alias("balance"), F.max("c_acctbal").alias("most"), parity.round_half_even(F.avg("c_acctbal"), 2).alias("mean"), parity.round_half_even(F.avg(positive), 3).alias("share_positive"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, round_even(avg(value), 3) AS mean, min(value) AS least, max(value) AS most FROM events")
def global_profile(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over a whole table."""
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), parity.round_half_even(F.avg("value"), 3).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1")
def collect_sorted_lists(spark: SparkSession, d: str) -> DataFrame:
    """A group's values as a list in a given order."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(tabular.sorted_list(F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.col("o_orderkey")).alias("l"))
    return lists.select("o_custkey", F.array_join("l", ",").alias("orders"), F.size("l").cast("bigint").alias("n"))


@query("""SELECT workflow, string_agg(DISTINCT v, ',' ORDER BY v) AS versions, count(DISTINCT v) AS n FROM (SELECT workflow, unnest(assets).name AS v FROM task_runs) WHERE v IS NOT NULL AND workflow IS NOT NULL GROUP BY 1""")
def union_of_lists(spark: SparkSession, d: str) -> DataFrame:
    """Union of the rows' lists per group: exploded, distinct, then collected."""
    names = table(spark, d, "task_runs").select("workflow", F.explode("assets").alias("a")).select("workflow", F.col("a.name").alias("v")).where("v IS NOT NULL AND workflow IS NOT NULL").distinct()
    return names.groupBy("workflow").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("versions"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT task_run_id, CAST(len(assets) AS INT) AS n_assets, CAST(len(dependency_ids) AS INT) AS n_deps FROM task_runs")
def list_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of array columns; a null array has none."""
    return table(spark, d, "task_runs").select("task_run_id", F.array_size("assets").alias("n_assets"), F.array_size("dependency_ids").alias("n_deps")).distinct()


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL ORDER BY lang")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct values."""
    return table(spark, d, "documents").select("lang").where("lang IS NOT NULL").distinct().orderBy("lang")


_MARKS = "SELECT l_returnflag = 'R' AS actual, l_discount >= t AS predicted, name FROM lineitem, (VALUES ('loose', 0.03), ('middle', 0.06), ('strict', 0.09)) c(name, t)"
_COUNTS = f"SELECT name AS candidate, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND NOT predicted) AS tn, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn FROM ({_MARKS}) GROUP BY 1"
_METRICS = f"""SELECT *, round_even((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 3) AS accuracy, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 3) AS precision,
round_even(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 3) AS recall, round_even(coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 3) AS f1 FROM ({_COUNTS})"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    candidates = fanout.branches(spark, [{"candidate": n, "threshold": t} for n, t in (("loose", 0.03), ("middle", 0.06), ("strict", 0.09))])
    lines = fanout.across(table(spark, d, "lineitem").select("l_returnflag", "l_discount"), candidates)
    return tabular.confusion(lines, F.col("l_returnflag") == "R", F.col("l_discount") >= F.col("threshold"), ["candidate"])


@query(_METRICS)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts and rates of several candidates over all rows in one job."""
    return _metrics(spark, d)


@query(f"SELECT candidate, f1 FROM ({_METRICS}) ORDER BY f1 DESC, candidate DESC LIMIT 1")
def champion_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate; equal ones by name."""
    return models.champion(_metrics(spark, d)).select("candidate", "f1")


# --- rankings -------------------------------------------------------------------------------------


@query("SELECT l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey, l_orderkey, l_linenumber) = 1")
def top1_min_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The least row per group, as an aggregate."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return tabular.best_per_group(lines, ["l_partkey"], [F.col(c) for c in ("l_extendedprice", "l_suppkey", "l_orderkey", "l_linenumber")])


@query("""WITH s AS (SELECT c_nationkey, c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey DESC) = 1""")
def top1_max_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The greatest summed value per group."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(table(spark, d, "customer"), "c_custkey")
    sums = orders.groupBy("c_nationkey", "c_custkey").agg(_cents("o_totalprice").alias("total"))
    return tabular.best_per_group(sums, ["c_nationkey"], [F.col("total"), F.col("c_custkey")], largest=True)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER w::INT AS rank FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 5")
def top5_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first five per group; each group is thinned in salted parts first."""
    return tabular.top_n_per_group(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)


# --- fan-out --------------------------------------------------------------------------------------

_SCENARIOS = [("baseline", 0, 1.0), ("delay", 30, 1.0), ("surge", 0, 0.8), ("both", 45, 0.7)]


@query("""WITH s AS (SELECT * FROM (VALUES ('baseline', 0, 1.0), ('delay', 30, 1.0), ('surge', 0, 0.8), ('both', 45, 0.7)) v(scenario, days, scale)),
x AS (SELECT scenario, o_orderpriority, round_even(l_quantity * scale::DOUBLE / 50.0, 2) AS fill, date_diff('day', o_orderdate, l_shipdate) - days AS slack FROM lineitem JOIN orders ON l_orderkey = o_orderkey, s)
SELECT scenario, o_orderpriority AS priority, count(*) AS n, round_even(avg(fill), 3) AS mean_fill, min(fill) AS worst_fill, count(*) FILTER (fill < 0.2) AS n_low, count(*) FILTER (slack < 0) AS n_late FROM x GROUP BY ALL""")
def scenario_cross_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every scenario over the whole joined table in one job."""
    scenarios = fanout.branches(spark, fanout.zip_rows(scenario=[s[0] for s in _SCENARIOS], days=[s[1] for s in _SCENARIOS], scale=[s[2] for s in _SCENARIOS])).drop(fanout.ORDINAL)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.col("o_orderpriority").alias("priority"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate").join(orders, "l_orderkey")
    x = fanout.across(lines, scenarios).select("scenario", "priority", parity.round_half_even(F.col("l_quantity") * F.col("scale") / 50.0, 2).alias("fill"), (F.date_diff("l_shipdate", "o_orderdate") - F.col("days")).alias("slack"))
    return x.groupBy("scenario", "priority").agg(F.count(F.lit(1)).alias("n"), parity.round_half_even(F.avg("fill"), 3).alias("mean_fill"), F.min("fill").alias("worst_fill"), F.count_if(F.col("fill") < 0.2).alias("n_low"), F.count_if(F.col("slack") < 0).alias("n_late"))


@query("""SELECT branch::INT AS branch, low, high, count(*) FILTER (p_size >= low AND p_size < high) AS n FROM part, (VALUES (0, 0, 10), (1, 10, 25), (2, 25, 60)) v(branch, low, high) GROUP BY ALL""")
def zip_params_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Parameters zipped row by row, all branches in one aggregation."""
    rows = fanout.branches(spark, fanout.zip_rows(low=[0, 10, 25], high=[10, 25, 60]), "low int, high int")
    return fanout.run_over(rows, table(spark, d, "part").select("p_size"), [], F.count_if((F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high"))).alias("n"))


@query("""SELECT (a.i * 3 + b.i)::INT AS branch, a.brand, b.size, 'parts/' || a.brand || '/' || b.size AS label, count(p_partkey) FILTER (p_brand = a.brand AND p_size <= b.size) AS n
FROM part, (VALUES (0, 'Brand#2'), (1, 'Brand#9')) a(i, brand), (VALUES (0, 10), (1, 20), (2, 40)) b(i, size) GROUP BY ALL""")
def product_params_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All combinations, the first axis slowest, with a label derived per branch."""
    rows = fanout.branches(spark, fanout.product_rows(brand=["Brand#2", "Brand#9"], size=[10, 20, 40], label=fanout.per_branch("parts/{brand}/{size}")), "brand string, size int, label string")
    return fanout.run_over(rows, table(spark, d, "part").select("p_brand", "p_size"), [], F.count_if((F.col("p_brand") == F.col("brand")) & (F.col("p_size") <= F.col("size"))).alias("n"))


@query("""SELECT (a.i * 2 + b.i)::INT AS branch, a.flag, b.least, count(l_orderkey) FILTER (l_returnflag = a.flag AND l_quantity >= b.least) AS n FROM lineitem, (VALUES (0, 'A'), (1, 'N'), (2, 'R')) a(i, flag), (VALUES (0, 10), (1, 40)) b(i, least) GROUP BY ALL""")
def chained_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Branches chained: every old branch with every new row."""
    first = fanout.branches(spark, fanout.zip_rows(flag=["A", "N", "R"]), "flag string")
    rows = fanout.chain(first, fanout.branches(spark, fanout.zip_rows(least=[10, 40]), "least int"))
    return fanout.run_over(rows, table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), [], F.count_if((F.col("l_returnflag") == F.col("flag")) & (F.col("l_quantity") >= F.col("least"))).alias("n"))


@query("""SELECT p_brand, string_agg(CAST(n AS VARCHAR), ',' ORDER BY branch) AS counts FROM (SELECT branch, p_brand, count(*) FILTER (p_size >= low) AS n FROM part, (VALUES (0, 40), (1, 20), (2, 0)) v(branch, low) GROUP BY ALL) GROUP BY 1""")
def gather_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Results of branches gathered in branch order."""
    rows = fanout.branches(spark, fanout.zip_rows(low=[40, 20, 0]), "low int")
    counts = fanout.run_over(rows, table(spark, d, "part").select("p_brand", "p_size"), ["p_brand"], F.count_if(F.col("p_size") >= F.col("low")).alias("n"))
    return fanout.gather(counts.withColumn("n", F.col("n").cast("string")), ["p_brand"], "n", "counts").select("p_brand", F.array_join("counts", ",").alias("counts"))


@query("SELECT DISTINCT task_run_id, 'results/' || workflow || '/' || base_name || '.' || CAST(attempt AS VARCHAR) || '.csv' AS path FROM task_runs")
def template_expand(spark: SparkSession, d: str) -> DataFrame:
    """A template filled from each row; a null part gives null."""
    return fanout.expand_column(table(spark, d, "task_runs"), "results/{workflow}/{base_name}.{attempt}.csv", "path").select("task_run_id", "path").distinct()


@query("""SELECT DISTINCT task_run_id, regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(lower(env), '[^\\p{L}\\p{N}]', '_', 'g') AS env_slug FROM task_runs""")
def slugify_text(spark: SparkSession, d: str) -> DataFrame:
    """Names as identifiers."""
    return table(spark, d, "task_runs").select("task_run_id", parity.slug("name").alias("slug"), parity.slug_each("env").alias("env_slug")).distinct()


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Every entry of the embeddings as a column, and whether the label is 0."""
    rows = table(spark, d, "embeddings")
    features = [f"x{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return rows.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(features)], (F.col("label") == 0).cast("int").alias("y")), features


def logistic_grid(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of three candidates of a logistic regression over all entries of all embeddings (no oracle: another solver)."""
    e, features = _labelled(spark, d)
    candidates = {"plain": {}, "weighted": {"weight_scale": 3.0}, "strict": {"threshold": 0.7}}
    return models.grid(e, features, "y", candidates)


QUERIES["logistic_grid"] = logistic_grid


def segment_probability(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability of a fitted model by segment (the label), greatest first (no oracle: another solver)."""
    e, features = _labelled(spark, d)
    scored = models.score(models.fit_logistic(e, features, "y", weight_scale=3.0), e, features)
    return models.segment_means(scored, "label")


QUERIES["segment_probability"] = segment_probability


@query("SELECT label AS segment, round_even(avg(probability), 3) AS predicted_probability FROM (SELECT c_mktsegment AS label, 1 / (1 + exp(-c_acctbal / 5000.0::DOUBLE)) AS probability FROM customer) GROUP BY 1")
def score_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a given score by segment."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), (1 / (1 + F.exp(-F.col("c_acctbal") / 5000.0))).alias("probability"))
    return models.segment_means(c, "segment")


# --- extensions: beyond the reference -------------------------------------------------------------


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows of a day."""
    from braidframe.streaming.events import windowed_counts

    out = windowed_counts(table(spark, d, "events"), "ts", "1 day", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT strftime(s, '%Y-%m-%d %H') AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 12 HOURS AS s FROM events, (VALUES (0), (1)) v(o)) GROUP BY ALL""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: windows of a day every twelve hours."""
    from braidframe.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "1 day", slide="12 hours").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM k GROUP BY user_id, k.k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of a user, ended by an hour without events."""
    from braidframe.streaming.events import session_counts

    out = session_counts(table(spark, d, "events"), "ts", "1 hour", "user_id")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query("SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_ext(spark: SparkSession, d: str) -> DataFrame:
    """Extension: grouping sets."""
    lines = table(spark, d, "lineitem")
    sets = lines.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], F.col("l_returnflag"), F.col("l_linestatus"))
    out = sets.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.coalesce("l_linestatus", F.lit("-")).alias("status"), "g1", "g2", "n", "quantity")


@query("SELECT coalesce(p_brand, '-') AS brand, coalesce(p_type, '-') AS type, count(*) AS n, max(p_retailprice) AS most FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_rollup_ext(spark: SparkSession, d: str) -> DataFrame:
    """Extension: cube."""
    out = table(spark, d, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("most"))
    return out.select(F.coalesce("p_brand", F.lit("-")).alias("brand"), F.coalesce("p_type", F.lit("-")).alias("type"), "n", "most")


@query("""SELECT o_orderkey, rank() OVER w::INT AS r, dense_rank() OVER w::INT AS dr, lag(o_orderkey) OVER w2 AS before, lead(o_orderkey) OVER w2 AS after, ntile(4) OVER w2::INT AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w2 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_rank_ext(spark: SparkSession, d: str) -> DataFrame:
    """Extension: ranks and neighbours per customer."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    w2 = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.lag("o_orderkey").over(w2).alias("before"), F.lead("o_orderkey").over(w2).alias("after"), F.ntile(4).over(w2).alias("quarter"))


@query("""WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_ext(spark: SparkSession, d: str) -> DataFrame:
    """Extension: as-of join by an ordered scan over both sides, cut by day (no pairs of a key's rows)."""
    from braidframe.functions.time import epoch_micros
    from braidframe.operators.ordered import running_max

    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view"))
    view = F.col("event_type") == "view"
    line = e.select("user_id", "event_id", epoch_micros("ts").alias("t"), view.cast("int").alias("is_view"), F.when(view, F.struct(epoch_micros("ts").alias("t"), F.col("event_id").alias("id"))).alias("seen"))
    out = running_max(line, ["user_id"], F.floor(F.col("t") / 86_400_000_000), [F.col("t"), F.col("is_view").desc()], F.col("seen"), "last")
    return out.where("is_view = 0").select("event_id", "user_id", F.col("last.id").alias("view_id"))
