"""Catalogue of versioned table assets, kept as append-only Parquet tables.

``versions``, ``aliases`` and ``lineage`` hold facts with the time they were recorded; the present state
is the latest fact per key. A version appears only after its data is written and its checks have passed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidframe.sources.sinks import content_digest, file_system, move_once, write_parquet

#: Kinds of assets and whether consumers get them as live tables.
KINDS = {"table": True, "array": True, "text": True, "model": True, "file": False, "fig": False}

_VERSIONS = "kind string, name string, version_id string, seq bigint, content_hash string, run_id string, producer string, created_at timestamp_ntz, path string, schema string, row_count bigint, metadata map<string,string>"
_ALIASES = "kind string, name string, alias string, version_id string, seq bigint"
_LINEAGE = "version_id string, parent_id string"


@dataclass(frozen=True)
class Asset:
    """What is to be registered: a table, its name and boolean checks over all its rows; how reports group and caption it."""

    frame: DataFrame
    name: str
    kind: str = "table"
    checks: Mapping[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    metadata: Mapping[str, str] = field(default_factory=dict)
    group: str = ""
    caption: str = ""

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if not self.name or ":" in self.name:
            raise ValueError(f"bad asset name {self.name!r}")


def text_asset(spark: SparkSession, name: str, text: str, form: str = "plain", **more: object) -> Asset:
    """A text as an asset of one row; ``form`` is plain, markdown or json (which must be valid)."""
    if form not in ("plain", "markdown", "json"):
        raise ValueError(f"unknown form {form!r}")
    if form == "json":
        json.loads(text)
    return Asset(spark.createDataFrame([(text,)], "text string"), name, "text", metadata={"form": form}, **more)


def array_asset(spark: SparkSession, name: str, values: np.ndarray, rows_a_part: int = 100_000, **more: object) -> Asset:
    """An array as rows of its first axis: (position, values), each a flat list; shape and type are metadata."""
    flat = np.asarray(values).reshape(values.shape[0] if values.ndim else 1, -1)
    kind = {"f": "double", "i": "bigint", "u": "bigint", "b": "boolean"}.get(flat.dtype.kind)
    if kind is None:
        raise TypeError(f"arrays of {values.dtype} are not kept")
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(flat)], f"position bigint, values array<{kind}>")
    parts = max(1, -(-len(flat) // rows_a_part))
    return Asset(rows.repartition(parts, "position"), name, "array", metadata={"shape": json.dumps(list(values.shape)), "dtype": str(values.dtype)}, **more)


def model_asset(spark: SparkSession, name: str, metrics: Mapping[str, float], path: str = "", **more: object) -> Asset:
    """A fitted model by the path it was saved to, with its metrics."""
    rows = spark.createDataFrame([(path, k, float(v)) for k, v in metrics.items()], "path string, metric string, value double")
    return Asset(rows, name, "model", metadata={"path": path}, **more)


def nested_references(value: object) -> list[str]:
    """Asset names ``asset:<kind>:<name>`` anywhere inside lists, tuples and dicts, each once, in order."""
    found: dict[str, None] = {}
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str) and v.startswith("asset:"):
            found[v.removeprefix("asset:")] = None
        elif isinstance(v, Mapping):
            todo += reversed([x for kv in v.items() for x in kv])
        elif isinstance(v, (list, tuple)):
            todo += reversed(v)
    return list(found)


def reserve_names(outputs: DataFrame, task: str, kind: str, name: str, order: Sequence[str], out: str = "asset_name") -> DataFrame:
    """Add ``out``: an output's own name, or ``<task>.<kind>[<index>]`` by order among the unnamed of its task and kind.

    ``duplicate`` is true for every output whose (task, kind, name) another one has too.
    """
    w = Window.partitionBy(task, kind, F.col(name).isNull())
    index = F.row_number().over(w.orderBy(*order)) - 1
    made = F.format_string("%s.%s[%d]", F.col(task), F.col(kind), index)
    same = F.count(F.lit(1)).over(Window.partitionBy(task, kind, name)) > 1
    return outputs.select("*", F.coalesce(F.col(name), made).alias(out), (same & F.col(name).isNotNull()).alias("duplicate"))


class CheckFailed(ValueError):
    """A check was false or null; nothing was published."""


def version_id(kind: str, name: str, content_hash: str, run_id: str) -> str:
    """Deterministic id of a version."""
    return "v" + hashlib.sha256("\x1f".join([kind, name, content_hash, run_id]).encode()).hexdigest()[:16]


class Catalog:
    """Assets under one warehouse folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _append(self, table: str, rows: Sequence[tuple], schema: str) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def versions(self) -> DataFrame:
        """All versions, each once (a version registered twice is one)."""
        every = self._read("versions", _VERSIONS)
        rest = [c for c in every.columns if c != "version_id"]
        return every.groupBy("version_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("version_id", "r.*")

    def aliases(self) -> DataFrame:
        """The present version of each alias."""
        return self._read("aliases", _ALIASES).groupBy("kind", "name", "alias").agg(F.max_by("version_id", "seq").alias("version_id"))

    def lineage(self) -> DataFrame:
        """(version_id, parent_id)."""
        return self._read("lineage", _LINEAGE).distinct()

    def assets(self) -> DataFrame:
        """(kind, name, latest, n_versions): the latest is the one registered last."""
        return self.versions().groupBy("kind", "name").agg(F.max_by("version_id", "seq").alias("latest"), F.count(F.lit(1)).alias("n_versions"))

    def register(self, asset: Asset, *, run_id: str, producer: str = "", parents: Sequence[str] = ()) -> str:
        """Write the data aside, run the checks over what was written, then publish; returns the version id.

        The table is computed once. Data is kept by content: what is there already is never written
        again, so a table read from the catalogue can be registered under another name.
        """
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        try:
            stats = write_parquet(asset.frame, aside)
            written = self.spark.read.schema(asset.frame.schema).parquet(aside)
            if asset.checks:
                # each check is one aggregate, such as bool_and of a row condition or a count above 0
                row = written.agg(*[F.coalesce(c(written), F.lit(False)).alias(k) for k, c in asset.checks.items()]).first()
                failed = [k for k in asset.checks if not row[k]]
                if failed:
                    raise CheckFailed(f"{asset.kind}:{asset.name} fails {', '.join(failed)}")
            digest = content_digest(written)
            path = f"{self.root}/data/{digest}"
            move_once(self.spark, aside, path)
        finally:
            fs, p = file_system(self.spark, aside)
            fs.delete(p, True)
        vid = version_id(asset.kind, asset.name, digest, run_id)
        seq = self._next("versions", _VERSIONS)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        about = {**asset.metadata, **{k: v for k, v in (("group", asset.group), ("caption", asset.caption)) if v}}
        self._append("versions", [(asset.kind, asset.name, vid, seq, digest, run_id, producer, now, path, asset.frame.schema.json(), stats["row_count"], about)], _VERSIONS)
        if parents:
            self._append("lineage", [(vid, p) for p in dict.fromkeys(parents)], _LINEAGE)
        return vid

    def _next(self, table: str, schema: str) -> int:
        """The next number; it is claimed by making a file that only one writer can make."""
        number = int(self._read(table, schema).agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0])
        while True:
            fs, claim = file_system(self.spark, f"{self.root}/claims/{table}-{number}")
            if fs.createNewFile(claim):
                return number
            number += 1

    def set_alias(self, name: str, alias: str, selector: str | None = None) -> None:
        """Point an alias at a version (the latest by default)."""
        kind, bare, vid = self.resolve(name, selector)
        self._append("aliases", [(kind, bare, alias, vid, self._next("aliases", _ALIASES))], _ALIASES)

    def resolve(self, name: str, selector: str | None = None) -> tuple[str, str, str]:
        """(kind, name, version id) of ``kind:name`` or a bare name that only one kind has.

        The selector is an alias, a version id or nothing for the latest; an unknown or ambiguous name
        raises KeyError.
        """
        kind, _, bare = name.rpartition(":")
        found = self.assets().where((F.col("name") == bare) & ((F.lit(kind) == "") | (F.col("kind") == kind))).limit(len(KINDS)).collect()
        if len(found) != 1:
            raise KeyError(f"{name}: {'unknown' if not found else 'ambiguous: ' + ', '.join(sorted(r['kind'] for r in found))}")
        row = found[0]
        if selector is None:
            return row["kind"], bare, row["latest"]
        alias = self.aliases().where((F.col("kind") == row["kind"]) & (F.col("name") == bare) & (F.col("alias") == selector)).first()
        vid = alias["version_id"] if alias else selector
        known = self.versions().where((F.col("version_id") == vid) & (F.col("kind") == row["kind"]) & (F.col("name") == bare))
        if known.isEmpty():
            raise KeyError(f"{name}: no version {selector}")
        return row["kind"], bare, vid

    def read(self, name: str, selector: str | None = None) -> DataFrame:
        """The table of a version."""
        kind, _, vid = self.resolve(name, selector)
        if not KINDS[kind]:
            raise TypeError(f"{name} is kept as bytes, not as a table")
        row = self.versions().where(F.col("version_id") == vid).first()
        return self.spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(row["path"])

    def read_text(self, name: str, selector: str | None = None) -> str:
        """The text of a text asset."""
        return self.read(name, selector).first()["text"]

    def read_array(self, name: str, selector: str | None = None) -> np.ndarray:
        """The array of an array asset, on the driver: for arrays that one process can hold."""
        _, _, vid = self.resolve(name, selector)
        about = self.versions().where(F.col("version_id") == vid).first()["metadata"]
        rows = self.read(name, selector).orderBy("position").toPandas()
        return np.array(rows["values"].tolist(), dtype=about["dtype"]).reshape(json.loads(about["shape"]))

    def referenced(self) -> DataFrame:
        """Distinct content hashes that some version names."""
        return self.versions().select("content_hash").distinct()
