"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidframe.functions.time import epoch_micros

#: A parent that was never deleted lives until here (microseconds).
FOREVER = (1 << 63) - 1
#: Lives that ended are cut along time in units of 2**38 microseconds (3.2 days), and what is left of them in
#: units of 2**32 (71 minutes); a word has 64 units.
UNIT_BITS = (38, 32)

_ID = ["parent", "target_id"]


def normal_id(c: Column | str) -> Column:
    """Ids are equal after trimming blanks and lower-casing; blank ids become null."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def references(df: DataFrame, table: str, ref_id: str, target: str, at: str, parent: str) -> DataFrame:
    """Bring one referring table into the common shape (ref_table, ref_id, parent, target_id, at)."""
    return df.select(
        F.lit(table).alias("ref_table"),
        F.col(ref_id).cast("bigint").alias("ref_id"),
        F.lit(parent).alias("parent"),
        normal_id(target).alias("target_id"),
        F.col(at).alias("at"),
    )


def parents(df: DataFrame, parent: str, key: str, created: str, deleted: str) -> DataFrame:
    """Bring one target table into the common shape (parent, target_id, born, died)."""
    return df.select(
        F.lit(parent).alias("parent"),
        normal_id(key).alias("target_id"),
        epoch_micros(created).alias("born"),
        F.coalesce(epoch_micros(deleted), F.lit(FOREVER)).alias("died"),
    )


def _in_units(lives: DataFrame, bits: int) -> DataFrame:
    """Lives with the first whole unit inside them (lo) and the one behind the last (hi); lo > hi for lives inside one unit."""
    return lives.select(*_ID, "born", "died", F.shiftright(F.col("born") + ((1 << bits) - 1), bits).alias("lo"), F.shiftright("died", bits).alias("hi"))


def _whole_units(lives: DataFrame, bits: int) -> DataFrame:
    """(parent, target_id, word, mask): the whole units that some life covers, 64 to a word."""
    first, behind = F.col("lo"), F.col("hi")
    d = _in_units(lives, bits).where(first < behind).select(*_ID, "lo", "hi", F.explode(F.sequence(F.shiftright(first, 6), F.shiftright(behind - 1, 6))).alias("word"))
    low, high = F.greatest(first - F.shiftleft("word", 6), F.lit(0)), F.least(behind - F.shiftleft("word", 6), F.lit(64))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(64) - (high - low)).cast("int"))
    return d.groupBy(*_ID, "word").agg(F.bit_or(F.call_function("shiftleft", ones, low.cast("int"))).alias("mask"))


def _part_units(lives: DataFrame, bits: int) -> DataFrame:
    """(parent, target_id, born, died): what is left of lives without their whole units; each piece lies in one unit."""
    piece = lambda since, until: F.struct(since.alias("born"), until.alias("died"))
    lo, hi, born, died = (F.col(c) for c in ("lo", "hi", "born", "died"))
    start, stop = F.shiftleft(lo, bits), F.shiftleft(hi, bits)
    pieces = F.array_compact(
        F.array(
            F.when((lo <= hi) & (born < start), piece(born, start)),
            F.when((lo <= hi) & (stop < died), piece(stop, died)),
            F.when(lo > hi, piece(born, died)),
        )
    )
    return _in_units(lives, bits).select(*_ID, F.inline(pieces))


def _without(keys: DataFrame, lives: DataFrame, on: list[str], alive) -> DataFrame:
    """Left anti-join on ``on`` and the condition ``alive``, which names columns of ``lives`` with ``__`` before them."""
    right = lives.select(*[F.col(c).alias(f"__{c}") for c in lives.columns])
    condition = alive
    for c in on:
        condition = condition & (keys[c] == right[f"__{c}"])
    return keys.join(right, condition, "left_anti")


def orphan_keys(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (parent, target_id, at) that no live record answers.

    The distinct non-null keys are left-anti-joined to the parents' lives, each time to a table with few
    rows for a key, so no join multiplies a hot id's references by its records:

    1. ids whose records include one never deleted, by the birth of the earliest such (one row per id);
    2. lives that ended, in whole units of each size of UNIT_BITS (one word for 64 units of an id);
    3. the pieces of those lives that fill no unit of the smallest size, by unit.

    Whatever remains was never registered, came later or was deleted. Null or blank ids are no
    references. A reference without time finds no live record. A parent without birth time is never
    alive; equal times count as born (``born <= at < died``).
    """
    left = refs.where(F.col("target_id").isNotNull()).select("parent", "target_id", "at").distinct().withColumn("t", epoch_micros("at"))
    lives = targets.where(F.col("target_id").isNotNull() & (F.col("born") < F.col("died")))
    undying = lives.where(F.col("died") == FOREVER).groupBy(*_ID).agg(F.min("born").alias("since"))
    left = _without(left, undying, _ID, F.col("t") >= F.col("__since"))
    pieces = lives.where(F.col("died") < FOREVER)
    for bits in UNIT_BITS:
        left = left.withColumn("unit", F.shiftright("t", bits)).withColumn("word", F.shiftright("unit", 6))
        left = _without(left, _whole_units(pieces, bits), [*_ID, "word"], F.getbit("__mask", F.pmod("unit", F.lit(64)).cast("int")) == 1)
        pieces = _part_units(pieces, bits)
    rest = pieces.groupBy(*_ID, F.shiftright("born", bits).alias("unit"), "born").agg(F.max("died").alias("died"))
    left = _without(left, rest, [*_ID, "unit"], (F.col("t") >= F.col("__born")) & (F.col("t") < F.col("__died")))
    return left.select("parent", "target_id", "at")


def with_reasons(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """``reason`` of each key: ``missing`` if its id was never registered, else ``not_live`` (deleted or later)."""
    known = targets.where(F.col("target_id").isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in _ID]).distinct()
    joined = keys.join(known, (keys["parent"] == known["__parent"]) & (keys["target_id"] == known["__target_id"]), "left")
    return joined.select(*keys.columns, F.when(F.col("__target_id").isNull(), "missing").otherwise("not_live").alias("reason"))


def orphan_rows(refs: DataFrame, targets: DataFrame, *, reasons: bool = False) -> DataFrame:
    """The referring rows behind :func:`orphan_keys`, joined back, with their reason where asked for."""
    bad = orphan_keys(refs, targets)
    if reasons:
        bad = with_reasons(bad, targets)
    bad = bad.withColumnsRenamed({"parent": "p", "target_id": "i", "at": "a"})
    joined = refs.join(bad, (refs["parent"] == bad["p"]) & (refs["target_id"] == bad["i"]) & refs["at"].eqNullSafe(bad["a"]))
    return joined.select("ref_table", "ref_id", "target_id", "at", *(["reason"] if reasons else []))


def orphan_report(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts per referring table and month of distinct references, orphans and their reasons."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    rows = refs.where(F.col("target_id").isNotNull()).select("ref_table", "ref_id", "target_id", period).distinct()
    total = rows.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_refs"))
    bad = (
        orphan_rows(refs, targets, reasons=True)
        .groupBy("ref_table", "ref_id", "target_id", period)
        .agg(F.min("reason").alias("reason"))
        .groupBy("ref_table", "period")
        .agg(F.count(F.lit(1)).alias("n_orphans"), F.count_if(F.col("reason") == "missing").alias("n_missing"), F.count_if(F.col("reason") == "not_live").alias("n_not_live"))
        .select(F.col("ref_table").alias("t"), F.col("period").alias("p"), "n_orphans", "n_missing", "n_not_live")
    )
    out = total.join(bad, (total["ref_table"] == bad["t"]) & total["period"].eqNullSafe(bad["p"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("ref_table", "period", "n_refs", zero("n_orphans"), zero("n_missing"), zero("n_not_live"))
