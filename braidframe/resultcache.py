"""Results kept by the fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidframe.operators.history import evict
from braidframe.operators.tabular import key_diff
from braidframe.sources.sinks import content_digest, file_system, move_once

_ENTRIES = "cache_key string, function string, components map<string,string>, path string, schema string, row_count bigint, size bigint, created_at timestamp_ntz"


def components(function: Callable, version: int, inputs: Mapping[str, Any], env: str = "") -> dict[str, str]:
    """What identifies a call: function, its source, version, environment, and one entry per input.

    Inputs are asset version ids, plain values or tables. A table of files counts by its plan and by the
    path, size and time of each file; one made in memory, or of other sources, by its content.
    """
    parts = {"function": f"{function.__module__}.{function.__qualname__}", "version": str(version), "env": env, "source": source_closure(function)}
    for name in sorted(inputs):
        value = inputs[name]
        parts[f"input:{name}"] = table_identity(value) if isinstance(value, DataFrame) else f"{type(value).__name__}:{_sha(json.dumps(value, sort_keys=True, default=str))}"
    return parts


def source_closure(function: Callable) -> str:
    """Digest of the function's source and of all functions of the same top-level package that it names, and so on.

    Functions whose source cannot be read count by name.
    """
    package = function.__module__.partition(".")[0]
    seen: dict[str, str] = {}
    todo = [function]
    while todo:
        f = inspect.unwrap(todo.pop())
        name = f"{f.__module__}.{f.__qualname__}"
        if name in seen:
            continue
        try:
            seen[name] = inspect.getsource(f)
        except (OSError, TypeError):
            seen[name] = ""
        code, scope = getattr(f, "__code__", None), getattr(f, "__globals__", {})
        for n in code.co_names if code else ():
            other = scope.get(n)
            if inspect.isfunction(other) and other.__module__.partition(".")[0] == package:
                todo.append(other)
    return _sha(json.dumps(sorted(seen.items())))


def table_identity(df: DataFrame) -> str:
    """Text that changes when the table's rows can have changed."""
    files = sorted(df.inputFiles())
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    others = [leaf for leaf in _leaves(plan) if leaf.nodeName() in ("LocalRelation", "LogicalRDD", "Range", "OneRowRelation")]
    if not files or others:
        return f"content:{content_digest(df)}"
    stats = []
    for f in files:
        fs, path = file_system(df.sparkSession, unquote(f))
        status = fs.getFileStatus(path)
        stats.append([f, int(status.getLen()), int(status.getModificationTime())])
    return f"files:{_sha(json.dumps([plan.treeString(), df.semanticHash(), stats]))}"


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cache_key(parts: Mapping[str, str]) -> str:
    """Key of a call."""
    return _sha(json.dumps(dict(parts), sort_keys=True))


class ResultCache:
    """Tables by cache key under one folder that all executors see; entries are an append-only table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hits = self.misses = 0

    def entries(self) -> DataFrame:
        """The newest entry of each key that was not cleared."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/entries")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _ENTRIES)
        rows = self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/entries")
        rest = [c for c in rows.columns if c != "cache_key"]
        newest = rows.groupBy("cache_key").agg(F.max_by(F.struct(*rest), "created_at").alias("r")).select("cache_key", "r.*")
        return newest.where(F.col("path").isNotNull())

    def run(self, function: Callable[..., DataFrame], *, version: int = 1, env: str = "", **inputs: Any) -> DataFrame:
        """The kept result of the same call, else call, keep and return it.

        A kept table whose files are gone or of another size counts as a miss and is made again.
        """
        parts = components(function, version, inputs, env)
        key = cache_key(parts)
        row = self.entries().where(F.col("cache_key") == key).first()
        if row is not None and self._exists(row["path"] + "/_SUCCESS") and self._size(row["path"]) == row["size"]:
            self.hits += 1
            return self.spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(row["path"])
        self.misses += 1
        result = function(**inputs)
        aside, path = f"{self.root}/aside/{uuid.uuid4().hex}", f"{self.root}/data/{key}"
        result.write.parquet(aside)
        if self._exists(path):  # what is there did not count as a hit
            self._fs(path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        move_once(self.spark, aside, path)
        kept = self.spark.read.schema(result.schema).parquet(path)
        self._append([(key, parts["function"], parts, path, result.schema.json(), kept.count(), self._size(path), datetime.now(timezone.utc).replace(tzinfo=None))])
        return kept

    def explain(self, function: Callable, *, version: int = 1, env: str = "", **inputs: Any) -> DataFrame:
        """(component, before, after, change) against the function's newest kept call; all ``added`` without one."""
        parts = components(function, version, inputs, env)
        now = self.spark.createDataFrame(list(parts.items()), "component string, digest string")
        last = self.entries().where(F.col("function") == parts["function"]).agg(F.max_by("components", "created_at").alias("c"))
        return key_diff(last.select(F.explode("c").alias("component", "digest")), now, "component", "digest")

    def prune(self, **budget: Any) -> int:
        """Drop entries by :func:`braidframe.operators.history.evict`; returns how many."""
        gone = evict(self.entries(), "cache_key", "size", "created_at", **budget).where("evicted").select("cache_key", "path").toLocalIterator()
        dropped = [(r["cache_key"], r["path"]) for r in gone]
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        if dropped:
            self._append([(k, None, None, None, None, None, None, now) for k, _ in dropped])
        for _, path in dropped:
            self._fs(path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return len(dropped)

    def clear(self) -> int:
        """Drop every entry; returns how many."""
        return self.prune(keep_count=0)

    def _fs(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs(path).exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _size(self, path: str) -> int:
        return int(self._fs(path).getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(path)).getLength())

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _ENTRIES).coalesce(1).write.mode("append").parquet(f"{self.root}/entries")
