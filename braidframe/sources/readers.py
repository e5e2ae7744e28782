"""Scans: every reader takes an explicit schema or plain text columns, and infers nothing by itself."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, *, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Delimited text with a header; without a schema all columns are strings. Quoted newlines are kept."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(list(path) if not isinstance(path, str) else path)


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """The same with tabs."""
    return read_csv(spark, path, schema, sep="\t")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: str | None = None, *, lines: bool = True) -> DataFrame:
    """JSON lines, or with ``lines=False`` one document per file."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_tagged(spark: SparkSession, paths: Mapping[str, str], tag: str, schema: str, *, sep: str = ",") -> DataFrame:
    """Several delimited files, or folders of them, as one table with a leading column that names each row's.

    One scan of all files; the tag is looked up from the file's path: by its own name, else by its
    folder's. ``paths`` is the caller's list.
    """
    by_name = {p.rstrip("/").rsplit("/", 1)[-1]: t for t, p in paths.items()}
    if len(by_name) < len(paths):
        raise ValueError("files of equal name cannot be told apart")
    df = read_csv(spark, list(paths.values()), schema, sep=sep)
    pairs = [F.lit(x) for kv in by_name.items() for x in kv]
    part = lambda i: F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), i))
    known = F.create_map(*pairs)
    return df.select(F.coalesce(F.try_element_at(known, part(-1)), F.try_element_at(known, part(-2))).alias(tag), "*")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files (compressed ones too) with file name: (file, value)."""
    return spark.read.text(path if isinstance(path, str) else list(path)).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files: (path, size, modified, content); content is only read where it is asked for. Empty files give no rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def tail_lines(text: Column | str, n: int) -> Column:
    """The last ``n`` lines of a text; a newline at the end does not start another line."""
    c = F.col(text) if isinstance(text, str) else text
    body = F.when(c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c)
    parts = F.split(body, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n), "\n")


def byte_prefix(text: Column | str, n: int) -> Column:
    """The first ``n`` bytes of a text ; a character cut in two stays cut."""
    c = F.col(text) if isinstance(text, str) else text
    return F.call_function("substring", c.cast("binary"), F.lit(1), F.lit(n)).cast("string")


def fastq_records(lines: DataFrame, numbered: str = "n") -> DataFrame:
    """Reads of FASTQ lines numbered from 0 per file: (file, read, header, sequence, quality), four lines each."""
    at = F.col(numbered) % 4
    pick = lambda i: F.max(F.when(at == i, F.col("value")))
    return lines.groupBy("file", F.floor(F.col(numbered) / 4).alias("read")).agg(pick(0).alias("header"), pick(1).alias("sequence"), pick(3).alias("quality"))


def caret_records(lines: DataFrame) -> DataFrame:
    """(file, n_lines, n_records): records by the lines that start with ``@``, as a quick count; quality lines may start so too."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").startswith("@")).alias("n_records"))


def read_stats(records: DataFrame, least_length: int = 0) -> DataFrame:
    """Per file: number, total, least, mean and greatest length of the reads with at least ``least_length`` bases."""
    n = F.length("sequence")
    return records.where(n >= least_length).groupBy("file").agg(F.count(F.lit(1)).alias("num_seqs"), F.sum(n).alias("sum_len"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len"))


def pinned_lookup(manifest: DataFrame, table: DataFrame, key: str, order: Column, ordinal: str = "ordinal") -> DataFrame:
    """Rows of ``table`` for the manifest's keys in manifest order; the last duplicate by ``order`` wins; a missing key raises."""
    rest = [c for c in table.columns if c != key]
    last = table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    joined = manifest.join(last, key, "left")
    checked = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col("r"))
    return joined.withColumn("r", checked).select(*manifest.columns, "r.*").orderBy(ordinal)


def random_table(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """Seeded table of uniform doubles c00, c01, ..."""
    return spark.range(rows).select("id", *[F.rand(seed * 1000 + i).alias(f"c{i:02d}") for i in range(columns)])


# --- configuration --------------------------------------------------------------------------------


def load_config(*paths: str) -> dict[str, Any]:
    """TOML, JSON or YAML files, shallowly merged: of equal top keys the last file's counts. YAML needs its package."""
    out: dict[str, Any] = {}
    for p in paths:
        with open(p, "rb") as f:
            if p.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError:
                    raise ValueError(f"{p}: YAML cannot be read here") from None
                out.update(yaml.safe_load(f) or {})
            else:
                out.update(json.load(f) if p.endswith(".json") else tomllib.load(f))
    return out


# Spellings of booleans.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")


def param(name: str, kind: type = str, *, given: Mapping[str, Any] | None = None, config: Mapping[str, Any] | None = None, default: Any = None, choices: Sequence[Any] = (), multiple: bool = False) -> Any:
    """A parameter: the given value before the configured before the default, converted and checked.

    Comma-separated text makes several values where ``multiple``. No value at all, a value that does
    not convert or is no choice raises ValueError.
    """
    for layer in (given or {}, config or {}):
        if layer.get(name) is not None:
            raw = layer[name]
            break
    else:
        if default is None:
            raise ValueError(f"parameter {name!r} has no value")
        raw = default
    if multiple:
        values = raw if isinstance(raw, (list, tuple)) else str(raw).split(",")
        return [_convert(name, v.strip() if isinstance(v, str) else v, kind, choices) for v in values]
    return _convert(name, raw, kind, choices)


def _convert(name: str, raw: Any, kind: type, choices: Sequence[Any]) -> Any:
    if kind is bool and not isinstance(raw, bool):
        word = str(raw).strip().lower()
        if word not in TRUE_WORDS + FALSE_WORDS:
            raise ValueError(f"{name}: {raw!r} is no boolean")
        value: Any = word in TRUE_WORDS
    else:
        try:
            value = raw if isinstance(raw, kind) else kind(raw)
        except (TypeError, ValueError):
            raise ValueError(f"{name}: {raw!r} is no {kind.__name__}") from None
    if choices and value not in choices:
        raise ValueError(f"{name}: {value!r} is none of {list(choices)}")
    return value


def coerce(c: Column, kind: str) -> Column:
    """Cast that raises where a non-null value does not convert."""
    return F.when(c.isNull() | c.try_cast(kind).isNotNull(), c.try_cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), c.cast("string"))).cast(kind))
