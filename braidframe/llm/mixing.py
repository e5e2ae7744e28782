"""Mixing sources to target weights, by weighted fair queueing.

Every use of a text has a virtual finish time: the tokens of its source up to and including it, in
shuffled order, divided by the source's weight. Served in that order each source has at time v given v
times its share, so the order, sorted over all sources and truncated at the total budget, has the target
shares to within one text per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidframe.llm import bpe
from braidframe.operators.ordered import running_sum
from braidframe.session import bounded_rows, cut

#: The target table is read as a control table of at most so many rows.
MOST_SOURCES = 100_000
#: Uses of a source that one task orders at a time.
ROWS_A_BUCKET = 50_000
SEED = 7


def _goals(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))


def supply(docs: DataFrame, targets: DataFrame, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """(source, doc_id, n_tokens) of the texts that may be mixed, each text once.

    Texts of sources without target and texts without tokens are left out. Of equal texts, under any
    ids and sources, the one with the least (source, doc_id) counts, so that repeats are counted by
    text and not by id. Written once, since it is read several times.
    """
    wanted = _goals(targets).select("source").distinct()
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in bounded_rows(wanted, MOST_SOURCES, "mix_targets")], "source string")
    rows = docs.select("doc_id", "source", "text").where(F.col("text").isNotNull() & (F.col("text") != "")).join(F.broadcast(wanted), "source", "left_semi")
    counted = bpe.count_tokens(rows.withColumn("digest", F.sha2("text", 256)), ["doc_id", "source", "digest"], "text", rank_file, source=docs)
    once = counted.groupBy("digest").agg(F.min(F.struct("source", "doc_id", "n_tokens")).alias("d")).select("d.*")
    return cut(once, "supply")


def cutoffs(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None) -> tuple[float, dict[str, tuple[float, int]]]:
    """(virtual time at which the budget is about used up, source -> (weight, uses allowed)) for the sources that have tokens.

    Weights are the target shares of those sources, scaled to sum 1. Without a budget the total is the
    greatest at which every source still reaches its share within its repeats. With one, sources that
    run out stop there and the others go on by their weights until the budget is used up.
    """
    live = {s: targets[s] for s, n in available.items() if n > 0 and s in targets}
    whole = sum(w for w, _ in live.values())
    live = {s: (w / whole, r) for s, (w, r) in live.items()}
    if not live:
        return 0.0, {}
    ends = sorted((available[s] * r / w, available[s] * r, w) for s, (w, r) in live.items())
    if budget is None:
        return ends[0][0], live
    spent, rate = 0.0, 1.0
    for end, tokens, w in ends:
        if spent + rate * end >= budget:
            break
        spent, rate = spent + tokens, rate - w
    else:
        return ends[-1][0], live
    return (budget - spent) / rate, live


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """(source, doc_id, use, n_tokens, finish): each use of a text in the mix, ordered by ``finish``.

    The uses are those from the front of the order whose tokens come to at most ``budget``; without one,
    to the greatest total at which every source with texts still reaches its share within its repeats.

    ``use`` counts from 1 to at most the source's ``max_repeats``; every pass over a source is shuffled
    anew by ``seed``. Targets with a null source, no positive share or no repeats are ignored, of
    several rows for one source the shares add up and the least ``max_repeats`` counts. Empty
    inputs give no rows. The order of a source is cut in buckets of about ``ROWS_A_BUCKET`` uses, so one
    source may hold most of all rows.
    """
    spark = docs.sparkSession
    texts = supply(docs, targets, rank_file)
    sizes = texts.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("n_tokens").alias("longest"))
    sizes = bounded_rows(sizes, MOST_SOURCES, "the sources with targets")
    goal = {r["source"]: (r["w"], r["r"]) for r in bounded_rows(_goals(targets).groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")), MOST_SOURCES, "mix_targets")}
    end, live = cutoffs({r["source"]: r["n_tokens"] for r in sizes}, goal, budget)
    total = int(end * (1 + 1e-12)) if budget is None else budget  # weights sum to 1, so time is tokens while none runs out
    # At ``end`` no source lacks more than a text; what fills that up is served by ``horizon``.
    horizon = end + 2 * len(live) * max([r["longest"] for r in sizes], default=0) / min([w for w, _ in live.values()], default=1.0)
    plan = []
    for r in sizes:
        if r["source"] in live:
            weight, repeats = live[r["source"]]
            passes = min(repeats, int(horizon * weight // r["n_tokens"]) + 1)
            plan.append((r["source"], weight, passes, max(1, r["n_texts"] // ROWS_A_BUCKET)))
    queues = spark.createDataFrame(plan, "source string, weight double, passes int, buckets bigint")
    uses = texts.join(F.broadcast(queues), "source").select("*", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("use"))
    # The place in a pass is a hash; its range is cut evenly, so buckets are of even size.
    place = F.shiftrightunsigned(F.xxhash64("use", "doc_id", F.lit(seed)), 1)
    uses = uses.withColumn("place", place)
    bucket = F.struct(F.col("use"), F.floor(F.col("place") / F.lit(2.0**63) * F.col("buckets")).alias("part"))
    served = running_sum(uses, ["source"], bucket, [F.col("place"), F.col("doc_id")], F.col("n_tokens"), "served")
    queued = served.withColumn("finish", F.col("served") / F.col("weight")).where(F.col("finish") <= horizon)
    # The whole order is summed up in ranges of the finish time, which hold about equal numbers of tokens.
    ranges = max(1, sum(n * k for (_, _, n, _), k in zip(plan, (r["n_texts"] for r in sizes if r["source"] in live), strict=True)) // ROWS_A_BUCKET)
    part = F.floor(F.col("finish") * (ranges / horizon)) if horizon > 0 else F.lit(0)
    summed = running_sum(queued.withColumn("__whole", F.lit(0)), ["__whole"], part, [F.col("finish"), F.col("source"), F.col("use"), F.col("doc_id")], F.col("n_tokens"), "so_far")
    return summed.where(F.col("so_far") <= total).select("source", "doc_id", "use", "n_tokens", "finish").orderBy("finish", "source", "use", "doc_id")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens, uses and texts in the mix, the greatest number of repeats, the share aimed at and the share reached."""
    got = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.count(F.lit(1)).alias("n_texts"), F.max("uses").alias("most_repeats"))
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    table = goal.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("n_tokens"), zero("n_uses"), zero("n_texts"), zero("most_repeats"))
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    return table.withColumn("reached_share", F.coalesce(F.try_divide(F.col("n_tokens"), total), F.lit(0.0)))
