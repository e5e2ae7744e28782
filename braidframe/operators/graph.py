"""Task graphs as edge tables: waves, reachability, cycles, cached status, lineage."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.session import cut, ship

#: Graphs of at most so many edges are levelled whole in one task.
EDGES_A_TASK = 1_000_000
#: A level's result is written every so many rounds, so that plans stay short.
CUT_EVERY = 4


def edges_of(nodes: DataFrame, keys: Sequence[str], node: str, deps: str) -> DataFrame:
    """Distinct (keys, node, dep) of an array column of dependencies; null entries are ignored."""
    return nodes.select(*keys, F.col(node).alias("node"), F.explode(deps).alias("dep")).where(F.col("dep").isNotNull() & F.col("node").isNotNull()).distinct()


def known_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """Edges whose dependency is a node of the same graph; dangling ones are dropped."""
    there = nodes.where(F.col(node).isNotNull()).select(*keys, F.col(node).alias("dep")).distinct()
    return edges.join(there, [*keys, "dep"], "left_semi")


def waves(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, most_edges: int = EDGES_A_TASK) -> DataFrame:
    """(keys, node, wave): 0 without dependencies, else one more than the latest dependency.

    Graphs of at most ``most_edges`` edges are levelled whole, many to a task; larger ones advance
    together, one wave a round, by joins over all executors. (A recursive CTE would enumerate paths.)
    Dependencies that are no nodes are ignored. A cycle raises an error that names it so.
    """
    every = nodes.where(F.col(node).isNotNull()).select(*keys, F.col(node).alias("node")).distinct()
    links = cut(known_edges(edges, nodes, keys, node).select(*keys, "node", "dep"), "edges")
    large = cut(links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).drop("n"), "large")
    if large.isEmpty():
        return _levels_by_graph(every, links, keys)
    if not keys:
        return _levels_by_round(every, links, keys)
    pick = lambda d, how: d.join(large, list(keys), how)
    return _levels_by_graph(pick(every, "left_anti"), pick(links, "left_anti"), keys).unionByName(_levels_by_round(pick(every, "left_semi"), pick(links, "left_semi"), keys))


def _levels_by_graph(every: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kahn's algorithm over buckets of whole graphs; a bucket has about EDGES_A_TASK edges at most."""
    spark = every.sparkSession
    kind = every.schema["node"].dataType
    ship(spark)
    buckets = max(spark.sparkContext.defaultParallelism, links.count() // EDGES_A_TASK + 1)
    rows = every.select(*keys, "node", F.lit(None).cast(kind).alias("dep")).unionByName(links.select(*keys, "node", F.col("dep").cast(kind).alias("dep")))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # nodes of different graphs never meet, so a bucket is levelled as one graph
        owner = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
        number: dict = {}
        own = [number.setdefault((o, n), len(number)) for o, n in zip(owner, pdf["node"], strict=True)]
        after: dict = {}
        waiting = [0] * len(number)
        for i in np.flatnonzero(pdf["dep"].notna().to_numpy()):
            after.setdefault(number[owner[i], pdf["dep"].iat[i]], []).append(own[i])
            waiting[own[i]] += 1
        level = [0] * len(number)
        queue = deque(i for i, k in enumerate(waiting) if k == 0)
        left = len(number)
        while queue:
            n = queue.popleft()
            left -= 1
            for m in after.get(n, ()):
                waiting[m] -= 1
                if waiting[m] == 0:
                    level[m] = level[n] + 1
                    queue.append(m)
        if left:
            raise ValueError("the graph has a cycle")
        first = pdf["dep"].isna().to_numpy()  # each node has one row without dependency
        out = pdf.loc[first, [*keys, "node"]].copy()
        out["wave"] = [level[i] for i, f in zip(own, first, strict=True) if f]
        return out

    schema = T.StructType([*every.select(*keys, "node").schema, T.StructField("wave", T.IntegerType())])
    return rows.groupBy("__bucket").applyInPandas(run, schema)


def _levels_by_round(every: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    waiting = links.select(*keys, "node").distinct()
    done = cut(every.join(waiting, [*keys, "node"], "left_anti").withColumn("wave", F.lit(0)), "wave")
    levels, current, open_ = [done], done, links
    for wave in count(1):
        # an edge stays open until its dependency has a wave; a node is ready when none of its edges is open
        left = cut(open_.join(current.select(*keys, F.col("node").alias("dep")), [*keys, "dep"], "left_anti"), "edges")
        ready = open_.select(*keys, "node").distinct().join(left.select(*keys, "node").distinct(), [*keys, "node"], "left_anti")
        current = cut(ready.withColumn("wave", F.lit(wave)), "wave")
        if current.isEmpty():
            if not left.isEmpty():
                raise ValueError("the graph has a cycle")
            return reduce(DataFrame.unionByName, levels)
        levels.append(current)
        open_ = left


def reachable(edges: DataFrame, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, root, node, distance): everything that the roots depend on, at its least distance; roots at 0."""
    seen = cut(roots.select(*keys, "root", F.col("root").alias("node")).distinct().withColumn("distance", F.lit(0)), "reach")
    front = seen
    for step in count(1):
        hop = front.join(edges, [*keys, "node"]).select(*keys, "root", F.col("dep").alias("node")).distinct()
        front = cut(hop.join(seen, [*keys, "root", "node"], "left_anti").withColumn("distance", F.lit(step)), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if step % CUT_EVERY == 0:
            seen = cut(seen, "reach")


def unreached(nodes: DataFrame, edges: DataFrame, roots: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """Nodes that no root depends on (constructed, but dead)."""
    live = reachable(edges, roots, keys).select(*keys, F.col("node").alias(node)).distinct()
    return nodes.select(*keys, node).distinct().join(live, [*keys, node], "left_anti")


def layout(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column and row of each node for drawing: the wave, and the position within it by node.

    A drawing is of one graph, whose waves fit a task.
    """
    return levels.withColumn("row", F.row_number().over(Window.partitionBy(*keys, "wave").orderBy("node")) - 1)


def cached_status(levels: DataFrame, edges: DataFrame, hits: DataFrame, keys: Sequence[str], opaque: DataFrame | None = None) -> DataFrame:
    """(keys, node, status): cached, will_run or unknown.

    A node is cached if its key is among ``hits`` and all its dependencies are cached; with a
    dependency that is not cached its key cannot be known (unknown); else it will run. ``opaque`` nodes
    have a key that only running them tells (notebooks, scripts), so they are unknown.
    """
    hit = hits.select(*keys, "node").distinct().withColumn("hit", F.lit(True))
    marked = levels.join(hit, [*keys, "node"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if opaque is not None:
        marked = marked.join(opaque.select(*keys, "node").distinct().withColumn("opaque", F.lit(True)), [*keys, "node"], "left")
        marked = marked.withColumn("hit", F.col("hit") & F.col("opaque").isNull())
    never = F.lit(False) if opaque is None else F.col("opaque").isNotNull()
    # not cached spreads along edges: a node is unknown exactly if some ancestor misses
    misses = marked.where(~F.col("hit")).select(*keys, F.col("node").alias("root"))
    forward = edges.select(*keys, F.col("dep").alias("node"), F.col("node").alias("dep"))
    below = _spread(forward, misses, keys)
    status = F.when(F.col("blocked").isNotNull() | never, "unknown").when(F.col("hit"), "cached").otherwise("will_run")
    return marked.join(below.withColumn("blocked", F.lit(True)), [*keys, "node"], "left").select(*keys, "node", status.alias("status"))


def _spread(edges: DataFrame, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node) of everything behind any of the roots, the roots themselves left out unless behind another."""
    front = cut(roots.select(*keys, F.col("root").alias("node")).distinct(), "front")
    seen = None
    for step in count():
        hop = front.join(edges, [*keys, "node"]).select(*keys, F.col("dep").alias("node")).distinct()
        front = cut(hop if seen is None else hop.join(seen, [*keys, "node"], "left_anti"), "front")
        if seen is not None and front.isEmpty():
            return seen
        seen = front if seen is None else seen.unionByName(front)
        if step % CUT_EVERY == CUT_EVERY - 1:
            seen = cut(seen, "front")


def wave_totals(levels: DataFrame, weights: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per graph: the peak over waves of each summed measure, the first wave that reaches it, and the total."""
    per = levels.join(weights, [*keys, "node"]).groupBy(*keys, "wave").agg(*[F.sum(m).alias(m) for m in measures])
    out: list[Column] = [F.count(F.lit(1)).alias("waves")]
    for m in measures:
        out += [F.max(m).alias(f"peak_{m}"), F.max_by("wave", F.struct(F.col(m), -F.col("wave"))).alias(f"peak_{m}_wave"), F.sum(m).alias(f"total_{m}")]
    return per.groupBy(*keys).agg(*out)
