"""Object stores and other remote folders, through the file systems that Spark reads.

An address is what Spark takes: ``s3a://bucket/key``, ``gs://...``, ``hdfs://...``, ``file:///...``. Tables are
best read in place, where filters and columns are pushed down; staging is for files that need a copy.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from braidframe.session import scratch_dir
from braidframe.sources.sinks import file_system, move_once

# How addresses of object stores are spelled for Spark's file systems.
SCHEMES = {"s3": "s3a", "gs": "gs", "oci": "oci"}


@dataclass(frozen=True)
class RemoteRef:
    """A file or folder somewhere else; ``access`` is stage, stream or empty (decided by size)."""

    uri: str
    version: str = ""
    access: str = ""

    def __post_init__(self) -> None:
        if not re.match(r"[a-z][a-z0-9+.-]*://", self.uri):
            raise ValueError(f"{self.uri!r} is no address")
        if self.access not in ("", "stage", "stream"):
            raise ValueError(f"unknown access {self.access!r}")

    @property
    def spark_path(self) -> str:
        """The address as Spark's file systems spell it."""
        scheme, rest = self.uri.split("://", 1)
        return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def s3(bucket: str, key: str, **more: str) -> RemoteRef:
    """Reference to an object of an S3 store."""
    return RemoteRef(f"s3://{bucket}/{key.lstrip('/')}", **more)


def gs(bucket: str, key: str, **more: str) -> RemoteRef:
    """Reference to an object of a Google store."""
    return RemoteRef(f"gs://{bucket}/{key.lstrip('/')}", **more)


def oci(bucket: str, namespace: str, key: str, **more: str) -> RemoteRef:
    """Reference to an object of an OCI store."""
    return RemoteRef(f"oci://{bucket}@{namespace}/{key.lstrip('/')}", **more)


def stat(spark: SparkSession, ref: RemoteRef) -> dict | None:
    """(path, size, modified, is_folder) of what is there, None if nothing is."""
    fs, path = file_system(spark, ref.spark_path)
    if not fs.exists(path):
        return None
    s = fs.getFileStatus(path)
    size = fs.getContentSummary(path).getLength() if s.isDirectory() else s.getLen()
    return {"path": ref.uri, "size": int(size), "modified": int(s.getModificationTime()), "is_folder": bool(s.isDirectory())}


def listing(spark: SparkSession, ref: RemoteRef, glob: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder, listed by Spark itself; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(ref.spark_path).selectExpr("path", "length AS size", "modificationTime AS modified")


def stage(spark: SparkSession, ref: RemoteRef, root: str | None = None) -> str:
    """Copy to the shared folder, once per address, version, size and time; returns the copy's path."""
    about = stat(spark, ref)
    if about is None:
        raise FileNotFoundError(ref.uri)
    identity = "\x1f".join([ref.uri, ref.version, str(about["size"]), str(about["modified"])])
    path = f"{(root or scratch_dir(spark)).rstrip('/')}/braid-staged/{hashlib.sha256(identity.encode()).hexdigest()}"
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        aside = f"{path}.part"
        source_fs, source = file_system(spark, ref.spark_path)
        _, part = file_system(spark, aside)
        hadoop = spark._jvm.org.apache.hadoop.fs.FileUtil
        hadoop.copy(source_fs, source, fs, part, False, True, spark._jsc.hadoopConfiguration())
        move_once(spark, aside, path)
    return path


def resolve(spark: SparkSession, ref: RemoteRef, large: int = 2 * 2**30, root: str | None = None) -> str:
    """The path to read: in place where asked for or from ``large`` bytes on, else a staged copy."""
    if ref.access == "stream":
        return ref.spark_path
    about = stat(spark, ref)
    if about is None:
        raise FileNotFoundError(ref.uri)
    return ref.spark_path if ref.access != "stage" and about["size"] >= large else stage(spark, ref, root)


def upload(spark: SparkSession, local: str, ref: RemoteRef) -> None:
    """Copy a file or folder that the driver sees to an address; what is there is kept."""
    source_fs, source = file_system(spark, local)
    fs, target = file_system(spark, ref.spark_path)
    if not fs.exists(target):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, fs, target, False, False, spark._jsc.hadoopConfiguration())
