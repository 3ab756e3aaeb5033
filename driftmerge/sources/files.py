"""Small driver-side files on whatever file system a path names, by Hadoop's client."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what lies in a folder, sorted; empty if there is none."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Written aside and renamed, so a reader sees the old file or the new one."""
    fs, where = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(aside, where)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, where = _at(spark, path)
    if not fs.exists(where):  # the rename of write_json() didn't happen any more
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    source = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return json.loads(text)
