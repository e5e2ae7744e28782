"""Queries p3 on the measurements and p6 to p8 on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.llm import bpe, mixing, sketch, splitting
from braidframe.plans.tables import table
from braidframe.session import cut

_P3_KEYS = ["metric", "base_name"]


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(metric, base_name, at, value) of both tables; each delivered row counts."""
    runs = table(spark, d, "task_runs").select(F.lit("duration_s").alias("metric"), "base_name", F.col("started_at").alias("at"), F.col("duration_s").alias("value"))
    samples = table(spark, d, "resource_samples").select(F.lit("rss_bytes").alias("metric"), "base_name", F.col("sampled_at").alias("at"), F.col("rss_bytes").cast("double").alias("value"))
    return runs.unionByName(samples)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of duration_s and rss_bytes per base_name."""
    return sketch.percentiles(sketch.build(_measures(spark, d), _P3_KEYS, "value"), _P3_KEYS)


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """One sketch per metric, base_name and day, written to the shared folder and read back, as a daily job would keep them."""
    by_day = _measures(spark, d).withColumn("day", F.to_date("at"))
    return cut(sketch.build(by_day, [*_P3_KEYS, "day"], "value"), "sketches")


def p3_merge_check(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from the merged sketches of days against those from one sketch of all rows: they are the same.

    Days are merged to months and those to the whole, so no task reads a name's sketches of all days.
    """
    months = sketch.merge(_day_sketches(spark, d).withColumn("month", F.trunc("day", "month")), [*_P3_KEYS, "month"])
    merged = sketch.percentiles(sketch.merge(months, _P3_KEYS), _P3_KEYS)
    direct = p3_percentiles(spark, d)
    tag = lambda t, name: t.select(*_P3_KEYS, "q", F.struct("n", "code").alias(name))
    both = tag(merged, "m").unionByName(tag(direct, "d"), allowMissingColumns=True).groupBy(*_P3_KEYS, "q").agg(F.max("m").alias("m"), F.max("d").alias("d"))
    return both.select(*_P3_KEYS, "q", F.col("m.n").alias("n"), F.col("m").eqNullSafe(F.col("d")).alias("same"))


def p3_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """For each percentile: the number of measurements, the exact value, and whether the estimate's rank is within the bound."""
    return sketch.rank_check(_measures(spark, d), _P3_KEYS, "value", p3_percentiles(spark, d))


_P3 = f"""
WITH m AS (
  SELECT 'duration_s' AS metric, base_name, duration_s AS value FROM task_runs
  UNION ALL SELECT 'rss_bytes', base_name, CAST(rss_bytes AS DOUBLE) FROM resource_samples),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, base_name ORDER BY value) AS place, count(*) OVER (PARTITION BY metric, base_name) AS n FROM m WHERE value >= 0 AND NOT isnan(value)),
p AS (SELECT r.*, q FROM r, (SELECT unnest([{", ".join(map(str, sketch.PERCENTILES))}])::DOUBLE AS q) WHERE place = ceil(q * n))"""
P3_RANK_CHECK_SQL = f"{_P3} SELECT metric, base_name, q, n, value AS exact_value, TRUE AS within FROM p"
P3_MERGE_CHECK_SQL = f"{_P3} SELECT metric, base_name, q, n, TRUE AS same FROM p"


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The uses of documents that make up the target shares, in serving order."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents above their source's limit: those that the splitter cut."""
    pieces = splitting.split_oversized(table(spark, d, "documents"), table(spark, d, "split_limits"), with_text=False)
    return pieces.where(F.col("piece") == 0).select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of those documents."""
    return splitting.split_oversized(table(spark, d, "documents"), table(spark, d, "split_limits"))


QUERIES = {
    "p3_percentiles": p3_percentiles,
    "p3_merge_check": p3_merge_check,
    "p3_rank_check": p3_rank_check,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}

#: Token counts are beyond SQL, and so are sketches; SQL gives the exact ranks that the sketches are held against.
ORACLE: dict[str, str] = {"p3_rank_check": P3_RANK_CHECK_SQL, "p3_merge_check": P3_MERGE_CHECK_SQL}
