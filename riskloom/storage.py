"""Folders in the store that Spark reads and writes (local disk, HDFS, object stores)."""

from __future__ import annotations

import csv

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there.  Storage errors are raised, never read as "no"."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table: anything that is not a hidden file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return any(not str(s.getPath().getName()).startswith(("_", ".")) for s in fs.listStatus(p))


def children(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a folder) of the entries of a folder, by name."""
    fs, p = _fs(spark, path)
    got = [(str(s.getPath().getName()), str(s.getPath().toString()), bool(s.isDirectory())) for s in fs.listStatus(p)]
    return sorted(got)


def has_file(spark: SparkSession, path: str, suffix: str) -> bool:
    """Whether a file with this ending lies anywhere below the folder."""
    fs, p = _fs(spark, path)
    files = fs.listFiles(p, True)
    while files.hasNext():
        if str(files.next().getPath().getName()).endswith(suffix):
            return True
    return False


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {path} to {to}")


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files below a folder (or one file) by their header line; empty files and hidden ones left out."""
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    files, walk = [], fs.listFiles(p, True)
    root = str(fs.getFileStatus(p).getPath().toString())
    while walk.hasNext():
        f = walk.next().getPath()
        below = str(f.toString())[len(root):].split("/")
        if not any(x.startswith(("_", ".")) and "=" not in x for x in below):
            files.append(f)
    out: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(files, key=lambda x: str(x.toString())):
        stream = fs.open(f)
        codec = codecs.getCodec(f)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            stream if codec is None else codec.createInputStream(stream), "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line and line.strip("\ufeff \r"):
            header = tuple(next(csv.reader([line.lstrip("\ufeff").rstrip("\r")])))
            out.setdefault(header, []).append(str(f.toString()))
    return out
