"""Tabular operators whose null, order and tie rules follow data frames in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidframe.operators.ordered import running_sum


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, null_keys_match: bool = False, suffix: str = "_r") -> DataFrame:
    """Left equi-join by name; other columns of the right side that clash get ``suffix``.

    Every match gives a row. Null keys match nothing, or each other with ``null_keys_match``.
    """
    clash = [c for c in right.columns if c in left.columns and c not in on]
    right = right.withColumnsRenamed({c: c + suffix for c in clash})
    if not null_keys_match:
        return left.join(right, list(on), "left")
    keyed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    return left.join(keyed, cond, "left").drop(*[f"__r_{k}" for k in on])


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Chain of left joins. Whether a dimension is broadcast is left to its measured size."""
    return reduce(lambda d, dim: left_join(d, dim[0], dim[1]), dims, fact)


def in_set(df: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose value occurs in a column of another table (IN as a left semi join)."""
    return df.join(members.where(F.col(member).isNotNull()).select(F.col(member).alias(column)).distinct(), column, "left_semi")


def not_in_any(df: DataFrame, column: str, members: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose value occurs in none of several columns; rows with a null value are kept."""
    refs = reduce(DataFrame.union, [m.select(F.col(c).alias(column)) for m, c in members])
    return df.join(refs.where(F.col(column).isNotNull()).distinct(), column, "left_anti")


def group_agg(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Group by named keys; rows with a null key are dropped."""
    return reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df).groupBy(*keys).agg(*aggs)


def sum0(c: Column) -> Column:
    """Sum that is 0 where nothing is summed."""
    return F.coalesce(F.sum(c), F.lit(0))


def sort_nulls_last(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending), nulls last in either direction."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order])


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, largest: bool = False) -> DataFrame:
    """One whole row per group: the least (or greatest) by ``order``, which should end in a tie-break.

    An aggregate with map-side combine, not a window: a group of any size costs one row per task. Where
    ``order`` ties completely, the least (greatest) row by all columns is taken.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by if largest else F.min_by
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best(row, F.struct(*order)).alias("r")).select("r.*")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows per group; each group is first thinned to ``n`` rows in ``salts`` parts."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    thin = df.withColumn("__salt", salt).withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= n)
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n).drop("__salt", "__n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Distinct by ``keys``, the first by ``order`` stays."""
    return best_per_group(df, keys, order)


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL by name with a leading column that tells the frame; missing columns are null."""
    parts = [d.select(F.lit(name).alias(tag), "*") for name, d in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sorted_list(value: Column, *order: Column) -> Column:
    """A group's values as an array in the order of ``order`` (then of the value)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))), lambda x: x["v"])


def key_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: (key, before, after, change) with change in added, removed, changed, same."""
    joined = left.select(key, F.col(value).alias("before"), F.lit(True).alias("__l")).join(right.select(key, F.col(value).alias("after"), F.lit(True).alias("__r")), key, "full_outer")
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return joined.select(key, "before", "after", change.alias("change"))


def preview(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows by ``order``, and whether there are more."""
    head = df.orderBy(*order).limit(n + 1)
    numbered = head.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy(*order)))  # n + 1 rows
    return numbered.withColumn("truncated", F.max("ordinal").over(Window.partitionBy()) > n).where(F.col("ordinal") <= n)


def number_rows(df: DataFrame, bucket: Column, order: Sequence[Column], out: str = "ordinal", keys: Sequence[str] = ()) -> DataFrame:
    """Positions 1, 2, ... by ``order`` over a whole table (or per key), without a window over all of it.

    ``bucket`` must not decrease along ``order``; positions are counted in buckets and shifted.
    """
    d = df.withColumn("__all", F.lit(0)) if not keys else df
    numbered = running_sum(d, list(keys) or ["__all"], bucket, list(order), F.lit(1), out)
    return numbered.drop("__all") if not keys else numbered


def zip_ordinal(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Positional join of two numbered tables; a row without partner raises when it is reached."""
    joined = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), ordinal, "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    checked = F.when(both, True).otherwise(F.raise_error(F.lit("tables of different length")).cast("boolean"))
    return joined.where(checked).drop("__l", "__r")


def confusion(df: DataFrame, actual: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts tp, tn, fp, fn and from them accuracy, precision, recall and f1 (3 digits; 0 where undefined)."""
    from braidframe.functions.parity import divide, round_half_even

    counts = df.groupBy(*keys).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
    )
    zero = F.lit(0.0)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    accuracy = divide(tp + tn, tp + tn + fp + fn, zero)
    precision, recall = divide(tp, tp + fp, zero), divide(tp, tp + fn, zero)
    f1 = divide(2.0 * tp, 2.0 * tp + fp + fn, zero)
    rounded = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1}
    return counts.select("*", *[round_half_even(v, 3).alias(k) for k, v in rounded.items()])
