"""Percentiles of very large numeric columns, by dyadic Count-sketches.

Values are encoded, order kept, as whole numbers of ``BITS`` bits. For every binary resolution of the
codes a signed sketch counts the prefixes; fine resolutions are hashed into ``rows`` x ``width`` counters,
coarse ones with no more than ``width`` prefixes are counted exactly. Tasks add their rows to counters
and hand over one sketch for each key, so what is exchanged depends on the number of keys and tasks, not
of rows. Sketches are binary values that can be stored; adding them, by day or by file, gives the sketch
of all their rows, and adding one of negative weight takes its rows back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.operators.ordered import running_sum
from braidframe.session import ship

#: Bits of a code: resolutions 0 (single codes) to BITS (everything).
BITS = 20
#: Half the relative width of the values that share a code.
RELATIVE_ERROR = 0.001
#: Rank error, as a share of the group's size, and the chance that one resolution exceeds its part of it.
EPSILON, DELTA = 0.02, 0.11
#: Values below count as zero.
LEAST = 1e-300
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Counters that a task holds before it hands sketches over, about 100 MB.
HELD = 8_000_000

_LN_GAMMA = math.log((1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR))
_LN_LEAST = math.log(LEAST)
_TOP = (1 << BITS) - 1


@dataclass(frozen=True)
class Shape:
    """Counters of a sketch: ``rows`` x ``width`` for each hashed resolution, then those of the exact ones."""

    width: int
    rows: int

    @property
    def hashed(self) -> int:
        """Resolutions 0 to hashed - 1 have more than ``width`` prefixes."""
        return max(0, BITS - (self.width.bit_length() - 1))

    @property
    def exact_at(self) -> int:
        return self.hashed * self.rows * self.width

    @property
    def size(self) -> int:
        """Counters in all; an exact resolution with 2**k prefixes has its at exact_at + 2**k - 1."""
        return self.exact_at + (2 << (BITS - self.hashed)) - 1

    @property
    def rank_error(self) -> float:
        return 4 * math.sqrt(self.hashed) / self.width

    @cached_property
    def seeds(self) -> np.ndarray:
        return _mix(np.arange(1, BITS * self.rows + 1, dtype=np.uint64)).reshape(BITS, self.rows)


def shape(epsilon: float = EPSILON, delta: float = DELTA) -> Shape:
    """The least shape for a rank error of ``epsilon`` n.

    A prefix's estimate in one row is spoilt by the w/8 heaviest other prefixes with probability 1/8 at
    most; the squared weights of the rest sum to n**2 / (4 w/8) at most, so they put it off with a
    variance of 2 (n/w)**2 and, by Chebyshev, by more than 4 n/w with probability 1/8 at most. The median
    of d rows is then off by more than 4 n/w with at most the chance that half of d trials of 1/4 succeed:
    d is the least with that chance within ``delta``. A rank is a sum over the hashed resolutions, whose
    errors are independent with mean zero: 4 sqrt(resolutions) n/w, which ``epsilon`` bounds.
    """
    rows = 1
    while sum(math.comb(rows, k) * 0.25**k * 0.75 ** (rows - k) for k in range(rows // 2 + 1, rows + 1)) > delta:
        rows += 2
    width = 2
    while Shape(width, rows).rank_error > epsilon:
        width *= 2
    return Shape(width, rows)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_measurement(v: Column) -> Column:
    """Null, NaN and values below zero are no measurements."""
    v = v.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v >= 0)


def encode(v: Column) -> Column:
    """Order-preserving code of a value >= 0: 0 for zero, else its place on a logarithmic scale; +Infinity is the last code."""
    v = v.cast("double")
    place = F.floor((F.ln(v) - F.lit(_LN_LEAST)) / F.lit(_LN_GAMMA)) + 1
    return F.when(v < LEAST, F.lit(0)).when(v == F.lit(float("inf")), F.lit(_TOP)).otherwise(place).cast("bigint")


def decode(code: int) -> float:
    """Middle of the values that share a code."""
    if code <= 0:
        return 0.0
    if code >= _TOP:
        return math.inf
    return math.exp((code - 0.5) * _LN_GAMMA + _LN_LEAST)


# --- counters -------------------------------------------------------------------------------------


def _tally(index: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights by index, those that are not zero, in order."""
    if size <= 4 * len(index) + 65_536:
        sums = np.bincount(index, weight, size)
        at = np.flatnonzero(sums)
        return at, sums[at].astype(np.int64)
    at, inverse = np.unique(index, return_inverse=True)
    sums = np.bincount(inverse, weight, len(at)).astype(np.int64)
    return at[sums != 0], sums[sums != 0]


def _count(of: Shape, key: np.ndarray, keys: int, code: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, counters, weights) of the rows of each key, for keys numbered from 0."""
    found_key, found_cell, found_weight = [], [], []

    def add(slot: np.ndarray, signed: np.ndarray, width: int, offset: int) -> None:
        at, sums = _tally(key * width + slot, signed, keys * width)
        found_key.append(at // width)
        found_cell.append(offset + at % width)
        found_weight.append(sums)

    for level in (*range(of.hashed), *range(BITS, of.hashed - 1, -1)):  # in the order of the counters
        prefix = code >> level
        if level >= of.hashed:
            width = 1 << (BITS - level)
            add(prefix, weight, width, of.exact_at + width - 1)
            continue
        for r in range(of.rows):
            h = _mix(prefix.astype(np.uint64) + of.seeds[level, r])
            slot = (h & np.uint64(of.width - 1)).astype(np.int64)
            add(slot, np.where(h >> np.uint64(63), -weight, weight), of.width, (level * of.rows + r) * of.width)
    owner, cell, total = (np.concatenate(x) for x in (found_key, found_cell, found_weight))
    order = np.argsort(owner, kind="stable")  # counters stay in order within a key
    owner, cell, total = owner[order], cell[order], total[order]
    bounds = np.searchsorted(owner, np.arange(keys + 1))
    for k in range(keys):
        if bounds[k] < bounds[k + 1]:
            yield k, cell[bounds[k] : bounds[k + 1]], total[bounds[k] : bounds[k + 1]]


def _pack(cell: np.ndarray, weight: np.ndarray) -> bytes:
    """A sketch as bytes: widths of the two columns, distances between counters in use, their weights."""
    steps = np.diff(cell, prepend=0)
    kind = next(t for t in ("<u1", "<u2", "<u4") if not len(steps) or steps.max() <= np.iinfo(t).max)
    most = int(np.abs(weight).max()) if len(weight) else 0
    of = next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    return bytes((int(kind[2]), int(of[2]))) + steps.astype(kind).tobytes() + weight.astype(of).tobytes()


def _unpack(sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = sketch[0], sketch[1]
    n = (len(sketch) - 2) // (a + b)
    return np.cumsum(np.frombuffer(sketch, f"<u{a}", n, 2).astype(np.int64)), np.frombuffer(sketch, f"<i{b}", n, 2 + n * a).astype(np.int64)


# --- relations of sketches ------------------------------------------------------------------------


def _keyed(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]


def _schema(df: DataFrame, keys: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), *(T.StructField(n, t) for n, t in more)])


def _back(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *more)


def _numbers(columns: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key, and a row of each key. Nulls are equal to each other, NaNs too."""
    number = np.zeros(rows, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        _, number = np.unique(number * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, first


def _same(key: tuple) -> tuple:
    return tuple("nan" if isinstance(v, float) and v != v else v for v in key)


#: Tasks whose sketches are added first, before those of all tasks meet.
TASKS_A_GROUP = 64
_GROUP = "__group"


def parts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, of: Shape | None = None) -> DataFrame:
    """(keys, sketch): the sketches that tasks make of their rows, one or more for a key. No exchange."""
    of = of or shape()
    rows = df.where(is_measurement(F.col(value))).select(*_keyed(df, keys), encode(F.col(value)).alias("code"), (F.lit(1) if weight is None else weight).cast("bigint").alias("weight"))
    names = [f"k{i}" for i in range(len(keys))]
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[tuple, list]] = {}
        amount = 0

        def united(some: list) -> tuple[np.ndarray, np.ndarray]:
            return some[0] if len(some) == 1 else _tally(np.concatenate([c for c, _ in some]), np.concatenate([w for _, w in some]), of.size)

        kinds: list[pa.DataType] = []

        def give() -> Iterator[pa.RecordBatch]:
            every = list(held.values())
            held.clear()
            for i in range(0, len(every), 200):
                some = every[i : i + 200]
                cols = [pa.array([k[j] for k, _ in some], kinds[j]) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([_pack(*united(x)) for _, x in some], pa.binary())], names=[*names, "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n) for n in names]
            kinds = [c.type for c in columns]
            number, first = _numbers(columns, batch.num_rows)
            owners = list(zip(*[c.take(pa.array(first)).to_pylist() for c in columns], strict=True)) if names else [()]
            for k, cell, total in _count(of, number, len(first), batch.column("code").to_numpy(), batch.column("weight").fill_null(0).to_numpy()):
                held.setdefault(_same(owners[k]), (owners[k], []))[1].append((cell, total))
                amount += len(cell)
            if amount > HELD:
                for k, (owner, some) in held.items():
                    held[k] = owner, [united(some)]
                amount = sum(len(c) for _, some in held.values() for c, _ in some)
                if amount > HELD // 2:
                    yield from give()
                    amount = 0
        yield from give()

    return _back(rows.mapInArrow(run, _schema(df, keys, ("sketch", T.BinaryType()))), keys, "sketch")


def merge(sketches: DataFrame, keys: Sequence[str], of: Shape | None = None) -> DataFrame:
    """(keys, sketch): sketches of equal keys added. They are read one after another, whatever their number."""
    of = of or shape()
    names = [f"k{i}" for i in range(len(keys))]
    rows = sketches.select(*_keyed(sketches, keys), "sketch")
    rows = rows.repartition(*names).sortWithinPartitions(*names) if names else rows.repartition(1)
    ship(sketches.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, open_, key = np.zeros(of.size, np.int64), None, None
        kinds: list[pa.DataType] = []

        def row() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, kinds, strict=True)), pa.array([_pack(at, sums[at])], pa.binary())], names=[*names, "sketch"])

        for batch in batches:
            columns = [batch.column(n) for n in names]
            kinds = [c.type for c in columns]
            owners = list(zip(*[c.to_pylist() for c in columns], strict=True)) if names else [()] * batch.num_rows
            for owner, sketch in zip(owners, batch.column("sketch"), strict=True):
                if _same(owner) != open_:
                    if open_ is not None:
                        yield row()
                        sums[:] = 0
                    open_, key = _same(owner), owner
                cell, weight = _unpack(sketch.as_py())
                sums[cell] += weight
        if open_ is not None:
            yield row()

    return _back(rows.mapInArrow(run, _schema(sketches, keys, ("sketch", T.BinaryType()))), keys, "sketch")


def build(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, of: Shape | None = None) -> DataFrame:
    """(keys, sketch): one sketch of at most ``of.size`` counters for each key.

    Every row counts as often as it occurs, or with ``weight``; a negative weight takes rows back, a null
    one counts nothing. Null keys are a group of their own; a key without measurements has no sketch;
    other columns are ignored. Sketches can only be added if they were made with the same shape.
    """
    # Two steps, so that no task reads a key's sketches from all tasks of a large job.
    grouped = parts(df, keys, value, weight, of).withColumn(_GROUP, F.floor(F.spark_partition_id() / TASKS_A_GROUP))
    return merge(merge(grouped, [*keys, _GROUP], of), keys, of)


def _descend(of: Shape, sums: np.ndarray, wanted: Sequence[float]) -> tuple[int, list[int]]:
    n = int(sums[of.exact_at])
    rows = np.arange(of.rows)
    seen: dict[tuple[int, int], float] = {}

    def estimate(level: int, prefix: int) -> float:
        if (level, prefix) not in seen:
            if level >= of.hashed:
                seen[level, prefix] = float(sums[of.exact_at + (1 << (BITS - level)) - 1 + prefix])
            else:
                h = _mix(np.uint64(prefix) + of.seeds[level])
                at = (level * of.rows + rows) * of.width + (h & np.uint64(of.width - 1)).astype(np.int64)
                seen[level, prefix] = float(np.median(np.where(h >> np.uint64(63), -sums[at], sums[at])))
        return seen[level, prefix]

    codes = []
    for q in wanted:
        rank, prefix, whole = max(1.0, math.ceil(q * n)), 0, float(n)
        for level in range(BITS - 1, -1, -1):
            left = estimate(level, prefix * 2)
            if level < of.hashed:  # what the right sibling leaves of the parent is a second vote
                left = (left + whole - estimate(level, prefix * 2 + 1)) / 2
            left = min(max(left, 0.0), whole)
            if rank <= left and left > 0:
                prefix, whole = prefix * 2, left
            else:
                prefix, whole, rank = prefix * 2 + 1, whole - left, rank - left
        codes.append(prefix)
    return n, codes


def percentiles(sketches: DataFrame, keys: Sequence[str], wanted: Sequence[float] = PERCENTILES, of: Shape | None = None) -> DataFrame:
    """(keys, q, n, code, estimate) by descending the resolutions from the coarsest to single codes.

    ``sketches`` has one row for each key (see :func:`build`, :func:`merge`). The estimate of q is the value
    at rank ceil(q n): within ``RELATIVE_ERROR`` of the values that share its code, with a rank within
    ``of.rank_error`` n (see :func:`shape`). A group whose weights sum to nothing gives no rows.
    """
    of, points = of or shape(), tuple(wanted)
    names = [f"k{i}" for i in range(len(keys))]
    ship(sketches.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, qs, ns, codes = [], [], [], []
            for i, sketch in enumerate(batch.column("sketch")):
                cell, weight = _unpack(sketch.as_py())
                sums = np.zeros(of.size, np.int64)
                sums[cell] = weight
                n, found = _descend(of, sums, points)
                if n > 0:
                    at += [i] * len(points)
                    qs += points
                    ns += [n] * len(points)
                    codes += found
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(take) for n in names), pa.array(qs, pa.float64()), pa.array(ns, pa.int64()), pa.array(codes, pa.int64()), pa.array([decode(c) for c in codes], pa.float64())],
                names=[*names, "q", "n", "code", "estimate"],
            )

    schema = _schema(sketches, keys, ("q", T.DoubleType()), ("n", T.LongType()), ("code", T.LongType()), ("estimate", T.DoubleType()))
    return _back(sketches.select(*_keyed(sketches, keys), "sketch").mapInArrow(run, schema), keys, "q", "n", "code", "estimate")


def rank_check(df: DataFrame, keys: Sequence[str], value: str, found: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Hold percentiles against all rows: (keys, q, n, exact_value, within).

    ``exact_value`` is the value at rank ceil(q n) by counting; ``within``: that rank lies in the true
    ranks of the estimate's code, widened by ``tolerance`` of the group (at least one rank). Codes are
    counted and summed up in order first, then values within the one code that holds a rank; no group is
    sorted whole in one task.
    """
    tolerance = shape().rank_error if tolerance is None else tolerance
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.where(is_measurement(F.col(value))).select(*_keyed(df, keys), F.col(value).cast("double").alias("value"), encode(F.col(value)).alias("code"))
    counts = rows.groupBy(*names, "code").agg(F.count(F.lit(1)).alias("weight"))
    summed = running_sum(counts, names, F.shiftright("code", 10), [F.col("code")], F.col("weight"), "upto")
    asked = found.select(*[F.col(k).alias(f"a{i}") for i, k in enumerate(keys)], "q", "n", F.col("code").alias("guess"), F.ceil(F.col("q") * F.col("n")).alias("rank")).groupBy(*[f"a{i}" for i in range(len(keys))]).agg(F.collect_list(F.struct("q", "n", "guess", "rank")).alias("asked"))
    same = lambda left, right: [left[f"k{i}"].eqNullSafe(right[f"a{i}"]) for i in range(len(keys))]
    met = summed.join(asked, same(summed, asked)).select(*names, "code", "weight", "upto", F.inline("asked"))
    below = F.col("upto") - F.col("weight")
    ranks = met.groupBy(*names, "q", "n", "rank").agg(
        F.max(F.when((below < F.col("rank")) & (F.col("rank") <= F.col("upto")), F.struct("code", (F.col("rank") - below).alias("place")))).alias("exact"),
        F.coalesce(F.max(F.when(F.col("code") < F.col("guess"), F.col("upto"))), F.lit(0)).alias("under"),
        F.coalesce(F.max(F.when(F.col("code") <= F.col("guess"), F.col("upto"))), F.lit(0)).alias("through"),
    )
    slack = F.greatest(F.lit(1.0), F.col("n") * tolerance)
    within = (F.col("rank") > F.col("under") - slack) & (F.col("rank") <= F.col("through") + slack)
    ranks = ranks.select(*[F.col(n).alias(f"a{i}") for i, n in enumerate(names)], "q", "n", "exact", within.alias("within"))
    values = rows.groupBy(*names, "code", "value").agg(F.count(F.lit(1)).alias("weight"))
    inside = values.join(ranks, [*same(values, ranks), values["code"] == ranks["exact"]["code"]]).select(*names, "q", "n", "within", "value", "weight", F.col("exact.place").alias("place"))
    so_far = F.sum("weight").over(Window.partitionBy(*names, "q").orderBy("value"))
    reached = inside.withColumn("so_far", so_far).where(F.col("so_far") >= F.col("place"))
    return _back(reached.groupBy(*names, "q", "n", "within").agg(F.min("value").alias("exact_value")), keys, "q", "n", "exact_value", "within")
