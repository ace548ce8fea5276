"""Cutting lineage with reliable checkpoints, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of our own is set only where the session
    names none and runs on one machine, as in tests; on a cluster that is an error, as other
    machines could not read what one has written."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuskit-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; the result has no lineage and
    survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written as a table into the checkpoint folder and read from there.

    For loops of joins: a checkpoint keeps the planner's estimate of its size, which is a
    product over all joins so far and soon a number too long to multiply; a table has the
    size of its files. Order and partitions are not kept."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_key(c: Column | str) -> Column:
    """Key spelled one way: outer blanks cut, lower case, blank as null."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def attach_by_key(
    rows: DataFrame, table: DataFrame, key: str, size: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and the
    number ``size`` of rows carrying it.

    Keys of more than ``hot_rows`` rows would each land in one task. There are at
    most ``rows / hot_rows`` of them, so they are joined by broadcast, and only the
    other keys are shuffled. Without a hot key the join is a plain one.
    """
    hot = table.filter(F.col(size) > hot_rows)
    if hot.isEmpty():
        return rows.join(table, key)
    small = F.broadcast(hot)
    return rows.join(small, key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
            table.filter(F.col(size) <= hot_rows), key
        )
    )


def salted_join(many: DataFrame, other: DataFrame, key: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join of ``many`` with ``other``, whose rows may be many for a key as well.

    Rows of ``many`` with a key of more than ``hot_rows`` rows are spread over as many tasks,
    to each of which the rows of ``other`` with that key go. There are at most rows /
    ``hot_rows`` such keys; without one the join is a plain one. ``many`` is counted once
    more, so it should be stored."""
    counts = many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    salts = counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    salts = cut(salts)
    if salts.isEmpty():
        return many.join(other, key)
    spread = many.join(F.broadcast(salts), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = other.join(F.broadcast(salts), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copied, [key, "_salt"]).drop("_salt")
