"""Sinks: tables, documents, append-only logs and content-addressed stores."""

from __future__ import annotations

import hashlib
import html
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of an address; every scheme that Spark reads works here."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> dict:
    """Write a table and return its schema, row count (read from the files' footers) and size in bytes."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    rows = spark.read.schema(df.schema).parquet(path).count()
    fs, p = file_system(spark, path)
    return {"path": path, "schema": [{"name": f.name, "dtype": f.dataType.simpleString()} for f in df.schema], "row_count": rows, "byte_size": int(fs.getContentSummary(p).getLength())}


def write_csv(df: DataFrame, path: str, *, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Header and rows; ``one_file`` is for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def records(df: DataFrame, order: Sequence[Column], out: str = "document") -> DataFrame:
    """A small table as one JSON array in the given order; the columns keep their order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(ordered).alias(out))


def markdown_table(df: DataFrame, order: Sequence[Column], out: str = "document") -> DataFrame:
    """A small table as Markdown text."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), cells.alias("c")))), lambda x: x["c"])
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return df.agg(F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), lines), "\n").alias(out))


def html_table(df: DataFrame, order: Sequence[Column], out: str = "document") -> DataFrame:
    """A small table as an HTML table."""
    from braidframe.functions.parity import html_table_row

    row = html_table_row(*[F.col(c) for c in df.columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("c")))), lambda x: x["c"])
    head = "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    return df.agg(F.concat(F.lit(head), F.array_join(lines, ""), F.lit("</table>")).alias(out))


def lines_document(df: DataFrame, line: Column, order: Sequence[Column], out: str = "document") -> DataFrame:
    """One line per row, joined in order: a manifest or brief of bounded length."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), line.alias("c")))), lambda x: x["c"])
    return df.agg(F.array_join(lines, "\n").alias(out))


def append_events(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines, keys in sorted order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_once(df: DataFrame, root: str, digest: str) -> str:
    """Content-addressed table: written under its digest unless it is there already; returns the path.

    The table is written aside and moved, so nobody sees half of it and nothing published is touched.
    """
    return publish_once(df.sparkSession, lambda path: df.write.parquet(path), f"{root.rstrip('/')}/{digest[:2]}/{digest}")


def publish_once(spark: SparkSession, write: Callable[[str], object], path: str) -> str:
    """Let ``write`` make a folder and move it to ``path``, unless that exists."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        aside = f"{path}.{uuid.uuid4().hex}"
        write(aside)
        move_once(spark, aside, path)
    return path


def move_once(spark: SparkSession, aside: str, path: str) -> bool:
    """Move a folder to ``path``; where another is there already, that one stays and ``aside`` goes."""
    fs, source = file_system(spark, aside)
    _, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        if not fs.exists(target):
            raise OSError(f"cannot move {aside} to {path}")
        fs.delete(source, True)
        return False
    # a rename onto a folder that another writer has just made would end up inside it
    inside = spark._jvm.org.apache.hadoop.fs.Path(target, source.getName())
    if fs.exists(inside):
        fs.delete(inside, True)
        return False
    return True


def folder_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest, size) of the files below a folder, by path from there; contents are digested where they are read."""
    fs, p = file_system(spark, path)
    root = fs.getFileStatus(p).getPath().toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.substring(F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:(//[^/]*)?", ""), len(root) + 2, 2**31 - 1)
    return files.select(relative.alias("file"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))


def folder_once(spark: SparkSession, path: str, root: str) -> tuple[str, str]:
    """Content-addressed folder of any files: copied under the digest of its manifest unless it is there; (digest, path).

    The manifest has one line for a file. Empty files are not part of it.
    """
    lines = folder_manifest(spark, path).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "digest", "file"))), "\n").alias("m")).first()["m"]
    digest = hashlib.sha256(lines.encode()).hexdigest()
    fs, source = file_system(spark, path)

    def copy(aside: str) -> None:
        to_fs, to = file_system(spark, aside)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, True, spark._jsc.hadoopConfiguration())

    return digest, publish_once(spark, copy, f"{root.rstrip('/')}/{digest[:2]}/{digest}")


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows regardless of their order: sums of the parts of each row's SHA-256, the count and the schema.

    Rows are digested as JSON with nulls kept; columns count by name. Map entries are sorted.
    """
    as_is = [F.array_sort(F.map_entries(c)).alias(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in sorted(df.columns)]
    row = F.sha2(F.to_json(F.struct(*as_is), {"ignoreNullFields": "false"}), 256) if as_is else F.sha2(F.lit(""), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(*[F.sum(part(i)).cast("string").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("n")).first()
    text = json.dumps([*sums, sorted(f.simpleString() for f in df.schema)])
    return hashlib.sha256(text.encode()).hexdigest()
