"""Operators over logs, versions and cache entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidframe.functions.time import epoch_micros
from braidframe.operators.ordered import neighbour, running_sum

DAY_US = 86_400_000_000


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``; (an aggregate, so keys of any size combine early)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and df.schema[c].dataType.typeName() != "map"])).alias("r")).select(*keys, "r.*")


def prior_entry(df: DataFrame, keys: Sequence[str], ts: str, entry: str) -> DataFrame:
    """Add ``prior``: the newest entry of the same key written strictly earlier; where there is none, the
    newest other entry; null for an only one.

    Equal times: the greater entry counts as newer, and none of them as earlier. The look-back is an
    ordered scan over distinct times, cut by day, not a join of a key's rows with each other.
    """
    moments = df.groupBy(*keys, ts).agg(F.max(entry).alias("__e"))
    looked = neighbour(moments, list(keys), F.floor(epoch_micros(ts) / DAY_US), [ts], F.col("__e"), "__prior").select(*keys, ts, "__prior")
    newest = F.max_by(entry, F.struct(ts, entry))
    top = df.groupBy(*keys).agg(newest.alias("__top"))
    d = df.join(top, list(keys))
    second = d.where(F.col(entry) != F.col("__top")).groupBy(*keys).agg(newest.alias("__second"))
    d = d.join(looked, [*keys, ts]).join(second, list(keys), "left")
    other = F.when(F.col("__top") != F.col(entry), F.col("__top")).otherwise(F.col("__second"))
    return d.withColumn("prior", F.coalesce("__prior", other)).drop("__prior", "__top", "__second")


def compact(patches: DataFrame, keys: Sequence[str], field: str, value: str, seq: Sequence[str], *, added: Sequence[str] = ()) -> DataFrame:
    """Replay a log of field patches: (keys, field, value).

    The last patch of a field wins; a null value deletes the field. Fields in ``added`` are sums of all
    their (numeric) patches instead.
    """
    is_sum = F.col(field).isin(*added) if added else F.lit(False)
    last = F.max_by(value, F.struct(*seq))
    total = F.sum(F.when(is_sum, F.col(value).try_cast("double"))).cast("string")
    out = patches.groupBy(*keys, field).agg(F.when(F.first(is_sum), total).otherwise(last).alias(value))
    return out.where(F.col(value).isNotNull())


# The kinds of patches in a log, by what they do.
PATCHES = ("task_created", "task_updated", "run_update", "run_timing", "profile_set", "task_timing")


def replay(log: DataFrame, run: str, seq: Sequence[str], *, start: DataFrame | None = None) -> DataFrame:
    """Replay a whole log: (run, scope, owner, field, value), one row per field of the final state.

    ``log`` has ``run``, ``kind`` (see PATCHES; others are ignored), ``task``, ``fields`` (map of text),
    ``phase``, ``seconds`` and the columns ``seq`` that order it within a run. A created task replaces
    what was known of it, timings too; an update sets fields or, with null, deletes them; timings add up
    per task and phase, and per run in the totals; a profile replaces the profile before. Scopes: task,
    task_timing (owner is the task), run, run_timing, total_timing and profile (owner is empty).
    Sums are rounded to six digits. ``start`` is an earlier result to go on from: its fields come before
    the log, its sums are added to. Patches without task where one is needed are ignored.

    All patches are turned into rows of one table and folded by two aggregations; the only join brings
    each task's last creation to its patches.
    """
    order = F.struct(*seq)
    d = log.withColumn("__at", order)
    kind, has_task = F.col("kind"), F.col("task").isNotNull()
    none, text = F.lit(None).cast("string"), F.lit("")
    row = lambda scope, owner, field, value, add: F.struct(F.lit(scope).alias("scope"), owner.alias("owner"), field.alias("field"), value.alias("value"), add.alias("added"))
    plain = F.lit(None).cast("double")
    entries = F.coalesce(F.map_entries("fields"), F.array().cast("array<struct<key:string,value:string>>"))
    fields = lambda scope, owner: F.transform(entries, lambda x: row(scope, owner, x["key"], x["value"], plain))
    timed = F.col("phase").isNotNull() & F.col("seconds").isNotNull()
    seconds = F.col("seconds").cast("double")
    rows = (
        F.when(kind.isin("task_created", "task_updated") & has_task, fields("task", F.col("task")))
        .when(kind == "run_update", fields("run", text))
        .when(kind == "profile_set", fields("profile", text))
        .when((kind == "run_timing") & timed, F.array(row("run_timing", text, F.col("phase"), none, seconds)))
        .when((kind == "task_timing") & timed & has_task, F.array(row("task_timing", F.col("task"), F.col("phase"), none, seconds), row("total_timing", text, F.col("phase"), none, seconds)))
    )
    patches = d.select(run, "__at", F.inline(rows))
    # what a task, or the profile, held before it was last replaced is gone
    replaced = F.when((kind == "task_created") & has_task, F.col("task")).when(kind == "profile_set", text)
    resets = d.select(F.col(run).alias("__run"), replaced.alias("__owner"), (kind == "profile_set").alias("__profile"), "__at").where(F.col("__owner").isNotNull())
    resets = resets.groupBy("__run", "__owner", "__profile").agg(F.max("__at").alias("__since"))
    kept = patches.withColumn("__is_profile", F.col("scope") == "profile").withColumn("__resettable", F.col("scope").isin("task", "task_timing", "profile"))
    same = F.col(run).eqNullSafe(F.col("__run")) & (F.col("owner") == F.col("__owner")) & (F.col("__is_profile") == F.col("__profile")) & F.col("__resettable")
    kept = kept.join(resets, same, "left").where(F.col("__since").isNull() | (F.col("__at") >= F.col("__since")))
    kept = kept.select(run, "scope", "owner", "field", "value", "added", F.col("__at").alias("at"))
    if start is not None:
        sums = F.col("scope").isin("task_timing", "run_timing", "total_timing")
        before = start.join(resets, F.col(run).eqNullSafe(F.col("__run")) & (F.col("owner") == F.col("__owner")) & ((F.col("scope") == "profile") == F.col("__profile")) & F.col("scope").isin("task", "task_timing", "profile"), "left_anti")
        kept = kept.unionByName(before.select(run, "scope", "owner", "field", F.when(~sums, F.col("value")).alias("value"), F.when(sums, F.col("value").try_cast("double")).alias("added"), F.lit(None).cast(kept.schema["at"].dataType).alias("at")))
    folded = kept.groupBy(run, "scope", "owner", "field").agg(F.sum("added").alias("added"), F.max_by(F.struct("value"), F.struct(F.col("at").isNotNull().alias("known"), F.col("at").alias("at"))).alias("last"))
    value = F.when(F.col("added").isNotNull(), F.round("added", 6).cast("string")).otherwise(F.col("last.value"))
    return folded.select(run, "scope", "owner", "field", value.alias("value")).where(F.col("value").isNotNull())


# The coarse reason that a moved component stands for.
REASONS = {"source_hash": "source_hash_changed", "extra_source_hash": "source_hash_changed", "version": "version_bump", "env": "env_changed", "env_hash.pixi_lock": "env_changed"}


def component_diff(current: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, component, status): the components of a cache key that differ between two entries.

    Both sides are (keys, component, digest). A null digest means that the entry does not record the
    component, which is ``not_recorded`` and not equality; else ``added``, ``removed`` or ``changed``.
    Where one side records no ``inputs`` at all (a component of that name with a null digest), the single
    inputs of the other are left out.
    """
    tag = lambda t, name: t.select(*keys, "component", F.struct("digest").alias(name))
    both = tag(current, "now").unionByName(tag(prior, "then"), allowMissingColumns=True).groupBy(*keys, "component").agg(F.max("now").alias("now"), F.max("then").alias("then"))
    bare = both.where(F.col("component") == "inputs").select(*[F.col(k).alias(f"__{k}") for k in keys])
    of = F.lit(True)
    for k in keys:
        of = of & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = both.join(bare, of & F.col("component").startswith("inputs."), "left_anti")
    now, then = F.col("now"), F.col("then")
    unknown = (now.isNotNull() & now["digest"].isNull()) | (then.isNotNull() & then["digest"].isNull())
    status = F.when(unknown, "not_recorded").when(now.isNull(), "removed").when(then.isNull(), "added").when(now["digest"] != then["digest"], "changed")
    return both.select(*keys, "component", status.alias("status")).where(F.col("status").isNotNull())


def coarse_reasons(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reasons): sorted codes of what moved; ``cache_key_changed`` where no code covers it."""
    from braidframe.functions.parity import map_values

    code = F.when(F.col("component").startswith("inputs"), "input_changed").otherwise(map_values("component", REASONS))
    moved = F.when(F.col("status") != "not_recorded", code)
    found = diff.groupBy(*keys).agg(F.array_sort(F.collect_set(moved)).alias("reasons"))
    return found.withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("cache_key_changed"))).otherwise(F.col("reasons")))


def retained(puts: DataFrame, entry: str, order: Sequence[str], capacity: int) -> DataFrame:
    """What a cache of ``capacity`` entries holds after all puts: the entries put last, each put counting anew."""
    return puts.where(F.col(entry).isNotNull()).groupBy(entry).agg(F.max(F.struct(*order)).alias("__last")).orderBy(F.desc("__last"), entry).limit(capacity).select(entry)


def phase_profile(observations: DataFrame, keys: Sequence[str], phase: str, seconds: str) -> DataFrame:
    """(keys, phase, seconds, count) of the observations above zero; partial results add up."""
    good = observations.where((F.col(seconds) > 0) & ~F.isnan(F.col(seconds).cast("double")))
    return good.groupBy(*keys, F.col(phase).alias("phase")).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("count"))


def evict(entries: DataFrame, entry: str, size: str, created: str, *, keep_bytes: int | None = None, keep_count: int | None = None, older_than: str | None = None) -> DataFrame:
    """Add ``evicted``: oldest first, first by age, then until the rest fits the byte and count budgets.

    A null time is oldest, a null size 0; equal times go by ``entry``. Running totals are carried from
    day to day, so no task orders the whole table.
    """
    us = epoch_micros(created)
    aged = F.coalesce(F.col(created) < F.to_timestamp_ntz(F.lit(older_than)), F.lit(False)) if older_than else F.lit(False)
    d = entries.withColumn("__aged", aged).withColumn("__all", F.lit(0)).withColumn("__us", us).withColumn("__size", F.coalesce(size, F.lit(0)).cast("bigint"))
    live = F.struct(F.when(F.col("__aged"), 0).otherwise(F.col("__size")).alias("b"), F.when(F.col("__aged"), 0).otherwise(1).alias("n"))
    # newest first: what is kept is the longest newest part within the budgets
    order = [F.col("__us").desc_nulls_last(), F.col(entry).desc()]
    bucket = -F.coalesce(F.floor(F.col("__us") / DAY_US), F.lit(-(2**40)))
    d = d.withColumn("__live", live)
    d = running_sum(d, ["__all"], bucket, order, F.col("__live.b"), "__kept_bytes")
    d = running_sum(d, ["__all"], bucket, order, F.col("__live.n"), "__kept_count")
    over = F.lit(False)
    if keep_bytes is not None:
        over = over | (F.col("__kept_bytes") > keep_bytes)
    if keep_count is not None:
        over = over | (F.col("__kept_count") > keep_count)
    return d.withColumn("evicted", F.col("__aged") | over).drop("__aged", "__all", "__us", "__size", "__live", "__kept_bytes", "__kept_count")


def sweep_peak(intervals: DataFrame, start: str, end: str, weights: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, peak_<name> ...): the most that overlaps at any moment; ends count before starts at equal times.

    Intervals with a null bound are ignored. Points are united per moment first; running sums are cut by day.
    """
    whole = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    d = whole if keys else whole.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]
    names = list(weights)
    point = lambda at, sign, o: F.struct(epoch_micros(at).alias("__t"), F.lit(o).alias("__o"), *[(w * sign).alias(f"__w_{n}") for n, w in weights.items()])
    points = d.select(*by, F.inline(F.array(point(end, -1, 0), point(start, 1, 1)))).groupBy(*by, "__t", "__o").agg(*[F.sum(f"__w_{n}").alias(f"__w_{n}") for n in names])
    for n in names:
        points = running_sum(points, by, F.floor(F.col("__t") / DAY_US), ["__t", "__o"], F.col(f"__w_{n}"), f"__s_{n}")
    peaks = points.groupBy(*by).agg(*[F.greatest(F.max(f"__s_{n}"), F.lit(0)).alias(f"peak_{n}") for n in names])
    return peaks if keys else peaks.drop("__all")


def paired_events(events: DataFrame, keys: Sequence[str], kind: str, ts: str, begin: str, finish: str) -> DataFrame:
    """(keys, started, finished, seconds) from the first ``begin`` and the last ``finish`` event by conditional aggregation."""
    out = events.groupBy(*keys).agg(F.min(F.when(F.col(kind) == begin, F.col(ts))).alias("started"), F.max(F.when(F.col(kind) == finish, F.col(ts))).alias("finished"))
    return out.withColumn("seconds", (epoch_micros("finished") - epoch_micros("started")) / 1e6)


def usage(samples: DataFrame, keys: Sequence[str], ts: str, measures: Sequence[str], tie: str) -> DataFrame:
    """Per key: number of samples, and of each measure the mean, the peak, when it peaked last, and the last value."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_samples")]
    for m in measures:
        v = F.col(m)
        known = v.isNotNull()
        aggs += [
            F.avg(v).alias(f"mean_{m}"),
            F.max(v).alias(f"peak_{m}"),
            F.max_by(F.when(known, F.col(ts)), F.when(known, F.struct(v, F.col(ts), F.col(tie)))).alias(f"peak_{m}_at"),
            F.max_by(v, F.when(known, F.struct(F.col(ts), F.col(tie)))).alias(f"last_{m}"),
        ]
    return samples.groupBy(*keys).agg(*aggs)


def resolve_version(asked: DataFrame, versions: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Add ``version_id``: of no selector the latest version, of an alias its version, else the selector itself."""
    newest = versions.groupBy(key).agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("__latest"))
    named = aliases.select(key, F.col("alias").alias("selector"), F.col("version_id").alias("__alias"))
    d = asked.join(newest, key, "left").join(named, [key, "selector"], "left")
    return d.withColumn("version_id", F.when(F.col("selector").isNull(), F.col("__latest")).otherwise(F.coalesce("__alias", "selector"))).drop("__latest", "__alias")


def occurrence(df: DataFrame, label: str, order: str, out: str, bucket: Column, pattern: str = "%s[%d]") -> DataFrame:
    """Add ``out``: the label, numbered by ``order`` where it occurs more than once.

    ``bucket`` must not decrease along ``order``; numbers are counted in buckets and shifted, so a label
    may hold any share of the rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__many")).withColumnRenamed(label, "__label")
    numbered = running_sum(df, [label], bucket, [order], F.lit(1), "__nth")
    joined = numbered.join(counts, F.col(label).eqNullSafe(F.col("__label")), "left")
    return joined.withColumn(out, F.when(F.col("__many") > 1, F.format_string(pattern, label, "__nth")).otherwise(F.col(label))).drop("__many", "__nth", "__label")


def roll_up(reach: DataFrame, weights: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of each measure over everything a root reaches, itself included (``reach`` from graph.reachable)."""
    return reach.join(weights, [*keys, "node"]).groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n_nodes"), *[F.sum(m).alias(m) for m in measures])


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, dtype, n, n_null, n_distinct) of some columns in one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count(c).alias(f"k_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    row = df.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col("n"), (F.col("n") - F.col(f"k_{c}")).alias("n_null"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])
    return row.select(F.inline(parts))
