"""Fan-out as branch tables: one row per branch, so that N branches are one plan and not N jobs."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.session import bounded_rows

ORDINAL = "branch"
#: A branch table holds arguments, not data.
MOST_BRANCHES = 10_000
_PLACEHOLDER = re.compile(r"\{([^{}]*)\}")


@dataclass(frozen=True)
class PerBranch:
    """An argument rendered from the other arguments of its own branch."""

    template: str


class ExpandedPaths(list):
    """Result of :func:`expand`; refused as a product axis, since it is a product already."""


def per_branch(template: str) -> PerBranch:
    """``per_branch("out/{sample}.csv")``: derived for each branch, never an axis of its own."""
    if not isinstance(template, str):
        raise TypeError("per_branch needs a template string")
    if not placeholders(template):
        raise ValueError(f"{template!r} has no placeholders, so all branches would get the same value")
    return PerBranch(template)


def placeholders(template: str) -> list[str]:
    """Names in order of first use; an empty or malformed name is an error."""
    names = list(dict.fromkeys(_PLACEHOLDER.findall(template)))
    for n in names:
        if not n.isidentifier():
            raise ValueError(f"bad placeholder {n!r} in {template!r}")
    return names


def _columns(columns: Mapping[str, Any]) -> tuple[dict[str, list], dict[str, PerBranch]]:
    derived = {k: v for k, v in columns.items() if isinstance(v, PerBranch)}
    axes: dict[str, list] = {}
    for k, v in columns.items():
        if k in derived:
            continue
        if isinstance(v, (str, bytes)):
            raise TypeError(f"{k} varies over the characters of a string; wrap it in a list")
        axes[k] = v if isinstance(v, list) else list(v)
    if not axes:
        raise ValueError("a fan-out needs at least one varying argument that is not derived")
    return axes, derived


def _derive(rows: list[dict], derived: Mapping[str, PerBranch]) -> list[dict]:
    for k, p in derived.items():
        for n in placeholders(p.template):
            if rows and n not in rows[0]:
                raise ValueError(f"{k}: unknown argument {n!r}")
        for row in rows:
            row[k] = p.template.format(**{n: row[n] for n in placeholders(p.template)})
    return rows


def zip_rows(**columns: Any) -> list[dict]:
    """Branch arguments row by row; columns of different length are an error."""
    axes, derived = _columns(columns)
    if len({len(v) for v in axes.values()}) > 1:
        raise ValueError("columns of different length: " + ", ".join(f"{k}={len(v)}" for k, v in axes.items()))
    return _derive([dict(zip(axes, values, strict=True)) for values in zip(*axes.values(), strict=True)], derived)


def product_rows(**axes_: Any) -> list[dict]:
    """All combinations, the first axis varying slowest."""
    for k, v in axes_.items():
        if isinstance(v, ExpandedPaths):
            raise ValueError(f"{k} is the result of expand(); zip it instead")
    axes, derived = _columns(axes_)
    return _derive([dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())], derived)


def branches(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: str | None = None) -> DataFrame:
    """Branch table of some rows with their ordinal; control data of the caller, so its size is the caller's."""
    numbered = [{ORDINAL: i, **r} for i, r in enumerate(rows)]
    if not numbered and schema is None:
        raise ValueError("no branches: a schema is needed")
    return spark.createDataFrame([tuple(r.values()) for r in numbered], f"{ORDINAL} int, {schema}" if schema else list(numbered[0]))


def chain(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every existing branch with every new row, the old ordinal slowest (both are control tables)."""
    a, b = (bounded_rows(t.orderBy(ORDINAL), MOST_BRANCHES, "a branch table") for t in (left, right))
    rest = lambda t: [f for f in t.schema.fields if f.name != ORDINAL]
    schema = T.StructType([T.StructField(ORDINAL, T.IntegerType()), *rest(left), *rest(right)])
    pick = lambda t, r: [r[f.name] for f in rest(t)]
    rows = [(i, *pick(left, x), *pick(right, y)) for i, (x, y) in enumerate(itertools.product(a, b))]
    return left.sparkSession.createDataFrame(rows, schema)


def across(data: DataFrame, branch_table: DataFrame) -> DataFrame:
    """Every row once per branch, with the branch's columns.

    The branches become a literal array that each row explodes, so there is neither a join nor an
    exchange, and the rows stay in generated code. At most ``MOST_BRANCHES`` branches.
    """
    fields = branch_table.schema.fields
    rows = bounded_rows(branch_table, MOST_BRANCHES, "a branch table")
    made = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in rows]
    return data.select("*", F.inline(F.array(*made))) if made else data.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def run_over(branch_table: DataFrame, data: DataFrame, keys: Sequence[str], *metrics: Column) -> DataFrame:
    """Apply all branches to all rows in one job and aggregate per branch (and ``keys``).

    Partial aggregation keeps what leaves a task at branches x groups rows.
    """
    names = [c for c in branch_table.columns if c not in keys]
    return across(data, branch_table).groupBy(*names, *keys).agg(*metrics)


def expand(template: str, **wildcards: Any) -> ExpandedPaths:
    """All fillings of a template, in the order of the placeholders' first use."""
    names = placeholders(template)
    _match_names(template, names, wildcards)
    axes = [_axis(n, wildcards[n]) for n in names]
    return ExpandedPaths(template.format(**dict(zip(names, values, strict=True))) for values in itertools.product(*axes))


def zip_expand(template: str, **wildcards: Any) -> ExpandedPaths:
    """Fillings of a template position by position; different lengths are an error."""
    names = placeholders(template)
    _match_names(template, names, wildcards)
    axes = [_axis(n, wildcards[n]) for n in names]
    if len({len(a) for a in axes}) > 1:
        raise ValueError("wildcards of different length")
    return ExpandedPaths(template.format(**dict(zip(names, values, strict=True))) for values in zip(*axes, strict=True))


def _match_names(template: str, names: list[str], given: Mapping[str, Any]) -> None:
    missing, extra = [n for n in names if n not in given], [n for n in given if n not in names]
    if missing or extra:
        raise ValueError(f"{template!r}: missing {missing}, unknown {extra}")


def _axis(name: str, value: Any) -> list:
    if isinstance(value, (str, bytes)):
        raise ValueError(f"{name} varies over the characters of a string; wrap it in a list")
    return list(value)


def expand_column(df: DataFrame, template: str, out: str) -> DataFrame:
    """The template filled from each row's columns; a null column gives a null."""
    parts = re.split(r"\{([^{}]*)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)]
    return df.withColumn(out, F.concat(*pieces))


def gather(df: DataFrame, keys: Sequence[str], value: str, out: str, ordinal: str = ORDINAL) -> DataFrame:
    """A branch's results as one array in branch order; for scalar tails of bounded number."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy(*keys).agg(ordered.alias(out))


def flatten(value: Any) -> list:
    """Nested lists and tuples in order; strings are values."""
    if isinstance(value, (list, tuple)):
        return list(itertools.chain.from_iterable(flatten(v) for v in value))
    return [value]


def union_branches(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables of several branches as one, with the branch's ordinal in front."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(F.lit(i).alias(ORDINAL), "*") for i, f in enumerate(frames)])
