"""Queries through sources and sinks: what a table's rows are after they went out to a format and came back.

Each writes a test table whole to a folder of its own below the shared folder and reads it again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe import pipeline
from braidframe.catalog import Asset, Catalog, reserve_names
from braidframe.functions import parity
from braidframe.operators import eventlog, fanout
from braidframe.operators.ordered import running_sum
from braidframe.plans.tables import table
from braidframe.resultcache import ResultCache
from braidframe.session import note, scratch_dir
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


def _folder(spark: SparkSession, label: str) -> str:
    return note(f"{scratch_dir(spark)}/braid-{label}-{uuid.uuid4().hex}")


def _lines(spark: SparkSession, path: str, lines: list[str]) -> str:
    """A small text file, such as a configuration, in the shared folder."""
    fs, p = sinks.file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    return path


# --- delimited text -------------------------------------------------------------------------------

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_mktsegment, count(*) AS n, round_even(sum(c_acctbal), 2) AS balance, min(c_name) AS first FROM customer GROUP BY 1")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Delimited files with header and schema."""
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "customer"), path)
    c = readers.read_csv(spark, path, _CUSTOMER)
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), parity.round_half_even(F.sum("c_acctbal"), 2).alias("balance"), F.min("c_name").alias("first"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated files."""
    path = _folder(spark, "tsv")
    table(spark, d, "nation").write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT 'file ' || (s_nationkey % 3) AS part, s_suppkey, s_name FROM supplier")
def tagged_files_union(spark: SparkSession, d: str) -> DataFrame:
    """Several files as one table with the file's tag in front."""
    root = _folder(spark, "tagged")
    s = table(spark, d, "supplier")
    for k in range(3):
        sinks.write_csv(s.where(F.col("s_nationkey") % 3 == k).select("s_suppkey", "s_name"), f"{root}/f{k}")
    return readers.read_tagged(spark, {f"file {k}": f"{root}/f{k}" for k in range(3)}, "part", "s_suppkey bigint, s_name string")


@query("SELECT 'region' AS name, count(*) AS n_rows FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def delimited_row_count(spark: SparkSession, d: str) -> DataFrame:
    """Rows of delimited files by counting lines less the header of each file, without parsing."""
    parts = []
    for name in ("region", "supplier"):
        path = _folder(spark, name)
        sinks.write_csv(table(spark, d, name), path)
        per_file = readers.read_lines(spark, path).groupBy("file").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n"))
        parts.append(per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows"))
    return parts[0].unionByName(parts[1])


# --- JSON, text and blobs -------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last, round_even(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written and read with a schema."""
    path = _folder(spark, "jsonl")
    sinks.write_json_lines(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    o = readers.read_json(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"), parity.round_half_even(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT r_name, CAST(len(list(n_name)) AS INT) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def json_document_read(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per file, each with an array."""
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    path = _folder(spark, "documents")
    n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).repartition("r_name").write.json(path)
    docs = readers.read_json(spark, path, "r_name string, names array<string>", lines=True)
    return docs.select("r_name", F.size("names").alias("n"), F.array_join("names", ",").alias("names"))


@query("SELECT event_type, count(*) AS n, count(value) AS n_values, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def event_sink(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines with sorted keys, appended to twice."""
    path = _folder(spark, "events")
    e = table(spark, d, "events").select("value", "event_type", "event_id")
    sinks.append_events(e.where("event_id % 2 = 0"), path)
    sinks.append_events(e.where("event_id % 2 = 1"), path)
    lines = readers.read_lines(spark, path).where(F.col("value").startswith('{"event_id":')).select(F.from_json("value", "event_id bigint, event_type string, value double").alias("e")).select("e.*")
    return lines.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.sum("event_id").alias("ids"))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN left(text, 40) END AS head FROM documents WHERE text IS NULL OR regexp_full_match(text, '[\\x01-\\x7f\\s]*')")
def byte_prefix_text(spark: SparkSession, d: str) -> DataFrame:
    """The first forty bytes of each text of single-byte characters (there a byte is a character)."""
    docs = table(spark, d, "documents").where(F.col("text").isNull() | F.col("text").rlike(r"^[\x01-\x7f\s]*$"))
    return docs.select("doc_id", readers.byte_prefix("text", 40).alias("head"))


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS size_class, count(*) AS n FROM region GROUP BY 1")
def blob_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files found by listing, without reading them: one for each region, its key and one more bytes long."""
    root = _folder(spark, "blobs")
    for r in table(spark, d, "region").collect():
        _lines(spark, f"{root}/{r['r_regionkey']}.bin", ["x" * (r["r_regionkey"] + 1)])
    return readers.read_blobs(spark, root, "*.bin").groupBy(F.col("size").alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


_RUNS = "SELECT DISTINCT run_id, CAST(node_id AS VARCHAR) AS task_id, base_name, coalesce(attempt, 0) AS attempt, status, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS a, strftime(finished_at, '%Y-%m-%dT%H:%M:%S.%f') AS f, cache_key, env FROM task_runs WHERE run_id IS NOT NULL AND node_id IS NOT NULL AND started_at IS NOT NULL"


@query(f"""WITH r AS ({_RUNS}), e AS (SELECT run_id, task_id, attempt, a AS ts, 2 AS rank, 'running' AS state, a AS started, NULL AS ended, NULL AS cache_key FROM r
  UNION ALL SELECT run_id, task_id, attempt, f, 6, CASE status WHEN 'cached' THEN 'cached' ELSE 'succeeded' END, NULL, f, cache_key FROM r WHERE status IN ('succeeded', 'cached') AND f IS NOT NULL
  UNION ALL SELECT run_id, task_id, attempt, f, 7, 'failed', NULL, f, NULL FROM r WHERE status = 'failed' AND f IS NOT NULL)
SELECT run_id, task_id, arg_max(state, {{'a': ts, 'b': attempt, 'c': rank}}) AS state, CAST(max(attempt) + 1 AS INT) AS attempts, min(started) AS started, max(ended) AS ended, max(cache_key) AS cache_key FROM e GROUP BY ALL""")
def event_log_states(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines of their kinds, read back, checked, and folded to each task's state."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    r = table(spark, d, "task_runs").where("run_id IS NOT NULL AND node_id IS NOT NULL AND started_at IS NOT NULL")
    r = r.select("run_id", F.col("node_id").cast("string").alias("task_id"), F.col("base_name").alias("task_name"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "status", iso("started_at").alias("a"), iso("finished_at").alias("f"), "cache_key", "env").distinct()
    r = r.withColumn("v", F.lit(1))
    ended = F.when(F.col("status").isin("succeeded", "cached"), "task_completed").when(F.col("status") == "failed", "task_failed")
    started = r.select("run_id", "task_id", "task_name", "attempt", "v", "env", F.lit("task_started").alias("event"), F.col("a").alias("ts"))
    finished = r.where(ended.isNotNull() & F.col("f").isNotNull()).select("run_id", "task_id", "task_name", "attempt", "v", "cache_key", "status", ended.alias("event"), F.col("f").alias("ts"))
    path = _folder(spark, "log")
    eventlog.to_lines(started.unionByName(finished, allowMissingColumns=True)).write.text(path)
    return eventlog.task_states(eventlog.parse(readers.read_lines(spark, path)))


# --- tables and stores ----------------------------------------------------------------------------


@query("SELECT 'part' AS name, count(*) AS row_count, 6 AS n_columns, 'p_partkey:bigint' AS first_column, TRUE AS has_bytes FROM part")
def parquet_sink_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the Parquet sink says of a table that it wrote."""
    stats = sinks.write_parquet(table(spark, d, "part"), _folder(spark, "part"))
    first = stats["schema"][0]
    row = ("part", stats["row_count"], len(stats["schema"]), f"{first['name']}:{first['dtype']}", stats["byte_size"] > 0)
    return spark.createDataFrame([row], "name string, row_count bigint, n_columns int, first_column string, has_bytes boolean")


@query("SELECT p_brand, count(*) AS n, max(p_retailprice) AS most FROM part GROUP BY 1")
def cas_write_once(spark: SparkSession, d: str) -> DataFrame:
    """A content-addressed table: written twice, kept once, read by its digest."""
    root, part = _folder(spark, "cas"), table(spark, d, "part")
    digest = sinks.content_digest(part)
    path = sinks.write_once(part, root, digest)
    if path != sinks.write_once(part.limit(0), root, digest):
        raise AssertionError("another path for the same content")
    return readers.read_parquet(spark, path, ["p_brand", "p_retailprice"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("most"))


@query("""SELECT 'suppliers' AS name, 2 AS n_versions, count(*) AS n_rows, TRUE AS checks_hold, TRUE AS first_kept, TRUE AS refused FROM supplier""")
def register_checks(spark: SparkSession, d: str) -> DataFrame:
    """Registered twice, the second time from what the catalogue gave back; a failing check publishes nothing."""
    from braidframe.catalog import CheckFailed

    cat, s = Catalog(spark, _folder(spark, "catalog")), table(spark, d, "supplier")
    checks = {"has_rows": lambda t: F.count(F.lit(1)) > 0, "keys": lambda t: F.bool_and(F.col("s_suppkey").isNotNull())}
    first = cat.register(Asset(s, "suppliers", checks=checks), run_id="r1")
    cat.register(Asset(cat.read("suppliers"), "suppliers", checks=checks), run_id="r2", parents=[first])
    cat.set_alias("suppliers", "base", first)
    refused = False
    try:
        cat.register(Asset(s, "suppliers", checks={"none": lambda t: F.count(F.lit(1)) == 0}), run_id="r3")
    except CheckFailed:
        refused = True
    n = cat.assets().where("name = 'suppliers'").first()["n_versions"]
    kept = cat.read("table:suppliers", "base")
    return kept.agg(F.lit("suppliers").alias("name"), F.lit(int(n)).alias("n_versions"), F.count(F.lit(1)).alias("n_rows"), F.lit(True).alias("checks_hold"), F.lit(cat.resolve("suppliers", "base")[2] == first).alias("first_kept"), F.lit(refused).alias("refused"))


@query("SELECT r_name, 2 AS misses, 1 AS hits FROM region")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """The same call twice and another once: one hit, two misses."""
    cache = ResultCache(spark, _folder(spark, "cache"))

    def regions(t: DataFrame, upper: bool) -> DataFrame:
        return t.select(F.upper("r_name").alias("r_name") if upper else "r_name")

    t = table(spark, d, "region")
    cache.run(regions, t=t, upper=False)
    cache.run(regions, t=t, upper=True)
    out = cache.run(regions, t=table(spark, d, "region"), upper=False)
    return out.select("r_name", F.lit(cache.misses).alias("misses"), F.lit(cache.hits).alias("hits"))


@query("""SELECT ref_id, CASE WHEN name IS NOT NULL THEN name ELSE task_key || '.' || kind || '[' || (row_number() OVER (PARTITION BY task_key, kind, name IS NULL ORDER BY ref_id) - 1) || ']' END AS asset_name,
name IS NOT NULL AND count(*) OVER (PARTITION BY task_key, kind, name) > 1 AS duplicate FROM (SELECT DISTINCT ref_id, run_id || task_key AS task_key, kind, CASE WHEN ref_id % 3 > 0 THEN name END AS name FROM asset_refs WHERE task_key IS NOT NULL AND run_id IS NOT NULL AND kind IS NOT NULL)""")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of outputs: their own, or by task, kind and number; names used twice are marked."""
    refs = table(spark, d, "asset_refs").where("task_key IS NOT NULL AND run_id IS NOT NULL AND kind IS NOT NULL")
    refs = refs.select("ref_id", F.concat("run_id", "task_key").alias("task_key"), "kind", F.when(F.col("ref_id") % 3 > 0, F.col("name")).alias("name")).distinct()
    return reserve_names(refs, "task_key", "kind", "name", ["ref_id"]).select("ref_id", "asset_name", "duplicate")


# --- reads, lookups and parameters ----------------------------------------------------------------

_READ = "SELECT doc_id, length(regexp_replace(substr(text, 1, 200), '\\s', '', 'g')) AS len FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"


@query(f"SELECT lang || '.fastq' AS file, count(*) AS num_seqs, CAST(sum(len) AS BIGINT) AS sum_len, min(len) AS min_len, max(len) AS max_len FROM ({_READ.replace('doc_id, ', 'doc_id, lang, ')}) WHERE len >= 20 GROUP BY 1")
def fastq_stats(spark: SparkSession, d: str) -> DataFrame:
    """Reads of four lines each, one file a language: numbers and lengths of those with at least twenty bases."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    seq = F.regexp_replace(F.substring("text", 1, 200), r"\s", "")
    four = docs.select("lang", "doc_id", F.posexplode(F.array(F.concat(F.lit("@r"), F.col("doc_id").cast("string")), seq, F.lit("+"), F.repeat(F.lit("I"), F.length(seq)))).alias("i", "value"))
    numbered = running_sum(four, ["lang"], F.floor(F.col("doc_id") / 100_000), ["doc_id", "i"], F.lit(1), "at")
    lines = numbered.select(F.concat("lang", F.lit(".fastq")).alias("file"), (F.col("at") - 1).alias("n"), "value")
    return readers.read_stats(readers.fastq_records(lines), 20).select("file", "num_seqs", "sum_len", "min_len", "max_len")


@query("SELECT lang || '.fastq' AS file, 2 * count(*) AS n_lines, count(*) AS n_records FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def fastq_quick_count(spark: SparkSession, d: str) -> DataFrame:
    """Records by their header lines only."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    lines = docs.select(F.concat("lang", F.lit(".fastq")).alias("file"), F.explode(F.array(F.concat(F.lit("@r"), F.col("doc_id").cast("string")), F.lit("ACGT"))).alias("value"))
    return readers.caret_records(lines)


@query("""WITH m AS (SELECT CAST(row_number() OVER (ORDER BY n_name DESC) AS BIGINT) AS ordinal, n_nationkey FROM nation), t AS (SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name, max(c_custkey) AS c_custkey FROM customer GROUP BY 1)
SELECT ordinal, n_nationkey, c_custkey, c_name FROM m JOIN t ON c_nationkey = n_nationkey""")
def pinned_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows for a manifest's keys in its order; of repeated keys the last row."""
    manifest = running_sum(table(spark, d, "nation").withColumn("__a", F.lit(0)), ["__a"], F.lit(0), [F.col("n_name").desc()], F.lit(1).cast("bigint"), "ordinal").select("ordinal", "n_nationkey")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    found = readers.pinned_lookup(manifest.join(customers.select("n_nationkey").distinct(), "n_nationkey", "left_semi").select("ordinal", "n_nationkey"), customers, "n_nationkey", F.col("c_custkey"))
    return found.select("ordinal", "n_nationkey", "c_custkey", "c_name")


@query("SELECT 20000 AS n, 4 AS n_columns, TRUE AS in_range, TRUE AS same_again")
def random_table_stats(spark: SparkSession, d: str) -> DataFrame:
    """A seeded table of uniform numbers, made twice alike."""
    a, b = (readers.random_table(spark, 20_000, 3, 5) for _ in range(2))
    both = a.join(b.withColumnsRenamed({f"c{i:02d}": f"d{i:02d}" for i in range(3)}), "id")
    fits = F.bool_and((F.col("c00") >= 0) & (F.col("c00") < 1) & (F.col("c02") >= 0) & (F.col("c02") < 1))
    return both.agg(F.count(F.lit(1)).cast("int").alias("n"), F.lit(len(a.columns)).alias("n_columns"), fits.alias("in_range"), F.bool_and((F.col("c00") == F.col("d00")) & (F.col("c01") == F.col("d01"))).alias("same_again"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 2500.0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def configured_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parameters: the given value before the configured before the default."""
    config: Mapping = json.loads('{"least": "2500", "segments": "HOUSEHOLD"}')
    least = readers.param("least", float, config=config, default=0.0)
    segments = readers.param("segments", given={"segments": "BUILDING, MACHINERY"}, config=config, multiple=True)
    return table(spark, d, "customer").where((F.col("c_acctbal") >= least) & F.col("c_mktsegment").isin(segments)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# --- values ---------------------------------------------------------------------------------------


@query("""SELECT DISTINCT task_run_id, lower(name) AS low, CASE WHEN isnan(duration_s) THEN NULL ELSE duration_s END AS seconds, CAST(exit_code AS BIGINT) AS code FROM task_runs""")
def scalar_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Lower case, NaN to null, and a cast that refuses what does not convert."""
    r = table(spark, d, "task_runs")
    return r.select("task_run_id", F.lower("name").alias("low"), parity.null_if_nan("duration_s").alias("seconds"), readers.coerce(F.col("exit_code").cast("string"), "bigint").alias("code")).distinct()


@query("""SELECT DISTINCT p_type, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""")
def title_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word with a capital."""
    return table(spark, d, "part").select("p_type", parity.title_case("p_type").alias("title")).distinct()


@query("""WITH v AS (SELECT DISTINCT version_id, metadata FROM asset_versions WHERE metadata IS NOT NULL), e AS (SELECT version_id, metadata, unnest(map_entries(metadata)) AS kv FROM v),
t AS (SELECT version_id, metadata, '{' || string_agg(to_json(kv.key) || ':' || to_json(kv.value), ',' ORDER BY kv.key) || '}' AS text FROM e WHERE kv.value IS NOT NULL GROUP BY ALL)
SELECT DISTINCT v.version_id, coalesce(t.text, '{}') AS text FROM v LEFT JOIN t ON t.version_id = v.version_id AND t.metadata = v.metadata""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Maps as JSON texts with sorted keys; null values are left out."""
    v = table(spark, d, "asset_versions").where("metadata IS NOT NULL")
    return v.select("version_id", parity.canonical_map(F.map_filter("metadata", lambda _, x: x.isNotNull())).alias("text")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_shippriority = 0 THEN CASE WHEN v > 0 THEN CAST('Infinity' AS DOUBLE) WHEN v < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END ELSE v / o_shippriority END AS ratio FROM (SELECT o_orderkey, CAST(o_orderkey % 3 - 1 AS DOUBLE) AS v, CAST(o_orderkey % 2 AS DOUBLE) AS o_shippriority FROM orders)")
def float_division(spark: SparkSession, d: str) -> DataFrame:
    """Division by zero as data frames do it."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 - 1).cast("double").alias("v"), (F.col("o_orderkey") % 2).cast("double").alias("w"))
    return o.select("o_orderkey", parity.divide("v", "w", by_zero="float").alias("ratio"))


@query("""WITH v AS (SELECT DISTINCT version_id, coalesce(metadata, MAP {}) AS m, kind FROM asset_versions), e AS (SELECT version_id, kind, unnest(map_entries(m)) AS kv FROM v),
a AS (SELECT version_id, kind, kv.key AS k, CASE WHEN kv.key IN ('note', 'rows') THEN '[redacted]' ELSE replace(kv.value, 'a', '*') END AS x FROM e WHERE kv.key <> 'kind' UNION ALL SELECT version_id, kind, 'kind', replace(kind, 'a', '*') FROM v)
SELECT version_id, k, x, count(*) AS n FROM a WHERE x IS NOT NULL GROUP BY ALL""")
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Maps merged, then values redacted by key and by content."""
    v = table(spark, d, "asset_versions").select("version_id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("m"), "kind")
    v = v.withColumn("m", F.array_sort(F.map_entries("m"))).distinct().withColumn("m", F.map_from_entries("m"))
    own = F.create_map(F.lit("kind"), F.col("kind"))
    shown = parity.redact_map(parity.merge_maps("m", own), ["note", "rows"], ["a"], "*")
    marked = F.transform_values(shown, lambda k, x: F.when(k.isin("note", "rows"), "[redacted]").otherwise(x))
    return v.select("version_id", F.explode(marked).alias("k", "x")).where("x IS NOT NULL").groupBy("version_id", "k", "x").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT t AS token, left(t, 1) = '-' AND t <> '-' AND TRY_CAST(t AS DOUBLE) IS NULL AS is_flag FROM (SELECT CASE ref_id % 4 WHEN 0 THEN '--' || kind WHEN 1 THEN '-' || ref_id WHEN 2 THEN kind ELSE '-' END AS t FROM asset_refs WHERE kind IS NOT NULL)")
def flag_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Which tokens of a command are options."""
    rest, i = F.col("ref_id") % 4, F.col("ref_id").cast("string")
    token = F.when(rest == 0, F.concat(F.lit("--"), "kind")).when(rest == 1, F.concat(F.lit("-"), i)).when(rest == 2, F.col("kind")).otherwise("-")
    return table(spark, d, "asset_refs").where("kind IS NOT NULL").select(token.alias("token")).distinct().withColumn("is_flag", parity.looks_like_flag("token"))


# --- fan-out --------------------------------------------------------------------------------------


@query("""SELECT ((b.i * 2 + s.i))::INT AS branch, 'out/' || n || '-' || k AS path, n, k FROM (VALUES (0, 'x'), (1, 'y'), (2, 'z')) b(i, n), (VALUES (0, 7), (1, 9)) s(i, k)
UNION ALL SELECT 10 + i, 'zip/' || n || '/' || k, n, k FROM (VALUES (0, 'x', 7), (1, 'y', 9)) v(i, n, k)""")
def expanded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Templates filled with all combinations, and position by position."""
    paths = fanout.expand("out/{n}-{k}", n=["x", "y", "z"], k=[7, 9])
    pairs = [(n, k) for n in "xyz" for k in (7, 9)]
    rows = [(i, p, *pairs[i]) for i, p in enumerate(paths)]
    rows += [(10 + i, p, *nk) for i, (p, nk) in enumerate(zip(fanout.zip_expand("zip/{n}/{k}", n=["x", "y"], k=[7, 9]), [("x", 7), ("y", 9)], strict=True))]
    return spark.createDataFrame(rows, "branch int, path string, n string, k int")


@query("""SELECT s.seg, l.low, count(*) AS n, sum(CASE WHEN c_acctbal >= l.low THEN 1 ELSE 0 END)::BIGINT AS above FROM customer JOIN (VALUES ('BUILDING'), ('MACHINERY')) s(seg) ON c_mktsegment = seg, (VALUES (0), (5000), (9000)) l(low) GROUP BY ALL""")
def flow_of_branches(spark: SparkSession, d: str) -> DataFrame:
    """A whole flow: a scan, a chained product of branches, one table per branch gathered into a union, each step lazy."""
    steps = pipeline.Registry()

    @steps.step()
    def scan(name):
        return table(spark, d, name)

    @steps.step()
    def counted(frame, seg, low):
        part = frame.where(F.col("c_mktsegment") == seg)
        return part.agg(F.lit(seg).alias("seg"), F.lit(low).alias("low"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") >= low).alias("above"))

    @steps.step()
    def gathered(frames):
        return fanout.union_branches(frames).drop(fanout.ORDINAL)

    @steps.flow
    def flow():
        calls = counted(frame=scan(name="customer")).product_map(seg=["BUILDING", "MACHINERY"], low=[0, 5000, 9000])
        return gathered(frames=list(calls))

    return pipeline.evaluate(steps.the_flow()())


@query("""WITH p AS (SELECT o_orderpriority AS name, count(*) AS n, round_even(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1), m AS (SELECT max(n) AS most FROM p)
SELECT name, n, CASE WHEN n = most THEN 'large' ELSE 'small' END AS route, CASE WHEN n = most THEN NULL ELSE mean END AS mean FROM p, m WHERE name <> '5-LOW'""")
def routed_flow(spark: SparkSession, d: str) -> DataFrame:
    """A flow that expands while it runs: one branch per value found, routed by a condition, one branch skipped, parts of results passed on."""
    steps = pipeline.Registry()
    orders = table(spark, d, "orders")

    @steps.step()
    def found():
        rows = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority").collect()  # one row per priority
        return [r["o_orderpriority"] for r in rows], max(r["n"] for r in rows)

    @steps.step()
    def summary(name):
        if name == "5-LOW":
            return None
        return orders.where(F.col("o_orderpriority") == name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), parity.round_half_even(F.avg("o_totalprice"), 2).alias("mean"))

    @steps.step()
    def routed(frame, most):
        if frame is None:
            return None
        large = F.col("n") == most
        return frame.select("name", "n", F.when(large, "large").otherwise("small").alias("route"), F.when(~large, F.col("mean")).alias("mean"))

    @steps.step()
    def expanded(names, most):
        return [routed(frame=summary(name=n), most=most) for n in names]

    @steps.step()
    def gathered(frames):
        return fanout.union_branches([f for f in fanout.flatten(frames) if f is not None]).drop(fanout.ORDINAL)

    @steps.flow
    def flow():
        start = found()
        return gathered(frames=expanded(names=start.output[0], most=start.output[1]))

    return pipeline.evaluate(steps.the_flow()())


@query("""SELECT string_agg(c_mktsegment || ' ' || n || ' ' || printf('%.2f', revenue), chr(10) ORDER BY c_mktsegment) AS manifest
FROM (SELECT c_mktsegment, count(*) AS n, round_even(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""")
def flow_scan_to_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A whole flow: delimited files scanned and joined, a branch per segment registered as a checked asset, all gathered into a manifest."""
    steps, cat = pipeline.Registry(), Catalog(spark, _folder(spark, "flow"))

    @steps.step()
    def scanned(name, schema):
        path = _folder(spark, name)
        sinks.write_csv(table(spark, d, name), path)
        return readers.read_csv(spark, path, schema)

    @steps.step()
    def joined(orders, customers):
        wide = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_totalprice")
        return wide, [r[0] for r in wide.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # one branch each

    @steps.step()
    def branch(wide, segment):
        part = wide.where(F.col("c_mktsegment") == segment).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), parity.round_half_even(F.sum("o_totalprice"), 2).alias("revenue"))
        name = f"revenue {segment.lower()}"
        cat.register(Asset(part, name, checks={"one_row": lambda t: F.count(F.lit(1)) == 1}), run_id="flow")
        return name

    @steps.step()
    def branches_of(wide, segments):
        return branch(wide=wide).map(segment=segments)

    @steps.step()
    def manifest(names):
        rows = fanout.union_branches([cat.read(n) for n in fanout.flatten(names)])
        line = F.format_string("%s %d %.2f", "c_mktsegment", "n", "revenue")
        return sinks.lines_document(rows, line, [F.col("c_mktsegment")], "manifest")

    @steps.flow
    def flow():
        customer = scanned(name="customer", schema=_CUSTOMER)
        orders = scanned(name="orders", schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
        both = joined(orders=orders, customers=customer)
        return manifest(names=branches_of(wide=both.output[0], segments=both.output[1]))

    return pipeline.evaluate(steps.the_flow()())
