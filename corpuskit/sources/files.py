"""Readers and writers of logs, JSON, CSV, pages and versioned snapshots."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions.text import lines

LEDGER = "line int, category string, post_id string, text string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text logs: a byte-order mark is dropped, CRLF read as LF, and the
    final empty segment kept. A file is one value; split larger logs before."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return t.select("file", F.posexplode(lines(F.col("value"))).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON of a stated schema; rows that do not fit have null fields and their text in
    ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)


def embedded_array(column, schema: str):
    """Items of the JSON array inside ``.push(...[ ])``; null where there is none."""
    return F.from_json(F.regexp_extract(column, r"(?s)\.push\(\.\.\.(\[.*\])\)", 1), f"array<{schema}>", {"mode": "PERMISSIVE"})


def read_pages(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, html) of page files in any encoding Python knows; bytes that do not fit come
    out as replacement characters."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("html"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files, and so a release's inventory."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_csv(rows: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is written for an empty table. Whether it was written."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines; numbers that JSON does not have are refused."""
    odd = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("double", "float")]
    if odd:
        bad = F.lit(False)
        for c in odd:
            bad = bad | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
        if not rows.filter(bad).isEmpty():
            raise ValueError("a report may not hold NaN or infinity")
    rows.write.mode("overwrite").json(path)


def table_digest(rows: DataFrame) -> str:
    """Digest of a table's rows whatever their order: sums of two hashes and the count."""
    cols = sorted(rows.columns)
    h = rows.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)").alias("b")).agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    return hashlib.sha256(json.dumps([str(x) for x in h] + cols).encode()).hexdigest()


class Snapshots:
    """Versioned sets of tables: each is written whole, verified, and only then named active.

    ``root`` is a folder that the session's file system reaches. The name of a snapshot is
    the digest of its tables, so one that exists already is not written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(f"{self.root}/{name}"), False)
        self._fs.rename(self._path(f"{self.root}/{name}.part"), self._path(f"{self.root}/{name}"))

    def publish(self, tables: dict[str, DataFrame]) -> str:
        digests = {k: table_digest(v) for k, v in sorted(tables.items())}
        name = hashlib.sha256(json.dumps(digests).encode()).hexdigest()
        if self._read(f"{name}/manifest.json") is None:
            for k, v in tables.items():
                v.write.mode("overwrite").parquet(f"{self.root}/{name}/{k}.parquet")
                if table_digest(self.spark.read.parquet(f"{self.root}/{name}/{k}.parquet")) != digests[k]:
                    raise ValueError(f"{k} was not written as it is")
            self._write(f"{name}/manifest.json", json.dumps(digests))
        self.activate(name)
        return name

    def activate(self, name: str) -> None:
        if self._read(f"{name}/manifest.json") is None:
            raise ValueError("no such snapshot")
        before = json.loads(self._read("active.json") or "{}").get("active")
        self._write("active.json", json.dumps({"active": name, "before": before}))

    def rollback(self) -> str:
        before = json.loads(self._read("active.json") or "{}").get("before")
        if not before:
            raise ValueError("nothing to go back to")
        self.activate(before)
        return before

    def load(self, name: str | None = None) -> dict[str, DataFrame]:
        name = name or json.loads(self._read("active.json") or "{}").get("active")
        digests = json.loads(self._read(f"{name}/manifest.json") or "null")
        if digests is None:
            raise ValueError("no such snapshot")
        out = {k: self.spark.read.parquet(f"{self.root}/{name}/{k}.parquet") for k in digests}
        for k, v in out.items():
            if table_digest(v) != digests[k]:
                raise ValueError(f"{k} is not what was published")
        return out
