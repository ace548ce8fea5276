"""Operators on ordered records that never order a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuskit.operators.lineage import cut


def numbered(rows: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """``rows`` and their place from 1 in a global order, which should be total.

    Rows are cut into ranges; each range numbers its own and adds the sizes of those before."""
    parts = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row per task.
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(starts), "_p").withColumn(out, F.row_number().over(W.partitionBy("_p").orderBy(*order)) + F.col("_s")).drop("_p", "_s")


def forward_filled(rows: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` and the last value that is not null up to and with each row.

    Ranges fill themselves; what a range begins with comes from the last value of the
    ranges before, one row per task."""
    parts = cut(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_p"), value.alias("_v")))
    own = F.last("_v", ignorenulls=True).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    place = F.struct(*order)
    ends = parts.groupBy("_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_e"))
    carry = ends.withColumn("_c", F.last("_e", ignorenulls=True).over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).drop("_e")
    return parts.withColumn(out, own).join(F.broadcast(carry), "_p").withColumn(out, F.coalesce(out, "_c")).drop("_p", "_v", "_c")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``, ties by all other columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_x")).select(*key, *[F.col("_x")[c].alias(c) for c in rest])


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """(user, begin, end, n_events): runs of events less than ``gap_seconds`` apart."""
    s = events.groupBy(user, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("end"))
    return s.select(user, F.col("w.start").alias("begin"), "end", "n_events")


def systematic(rows: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of the order, from the first."""
    return numbered(rows, order, "_rn").filter((F.col("_rn") - 1) % step == 0).drop("_rn")


def capped(rows: DataFrame, caps: list[tuple[str, int]], hashed: Column) -> DataFrame:
    """At most n rows of each key in hash order, key after key, as a sampling rule.

    A rank within a key is cut as the rows are sorted, so a hot key keeps n rows per task."""
    out = rows.withColumn("_h", hashed)
    for key, n in caps:
        out = out.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_h"))).filter(F.col("_r") <= n).drop("_r")
    return out.drop("_h")


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of ``edges`` (node, head), a forest: each node's last head. Heads are
    doubled in each round, so a chain of n takes about log n; nodes of a cycle are left out."""
    at = cut(edges.select("node", F.col("head").alias("root")).filter("node is not null and head is not null and node <> head"))
    for _ in range(rounds):
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at, open_ = new.select("node", "root"), new.filter("moved").limit(1).count()
        if not open_:
            return at
    # What still moves is on a cycle.
    return at.join(at.select(F.col("node").alias("root")), "root", "left_anti").select("node", "root")


def fronts(rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``rows`` of the first ``depth`` skylines with the number of theirs, from 0."""
    out, rest = None, rows
    for level in range(depth):
        front = cut(skyline(rest, keys).withColumn("front", F.lit(level)))
        out = front if out is None else out.unionByName(front)
        rest = cut(rest.join(front.select(*keys).distinct(), keys, "left_anti"))
        if rest.isEmpty():
            break
    return out


def skyline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no other row equals or exceeds in all of ``keys`` and exceeds in one.

    Points are reduced to the distinct ones; each task keeps its own front, and fronts are
    merged in rounds of ever fewer tasks, so no point meets all others at once."""
    import numpy as np
    import pyarrow as pa

    types = {f.name: f.dataType for f in rows.schema.fields}
    points = rows.select(*[F.col(k).cast("double").alias(k) for k in keys]).dropna().distinct()

    def front(batches):
        best = np.zeros((0, len(keys)))
        for b in batches:
            both = np.vstack([best, np.column_stack([c.to_numpy() for c in b.columns])])
            both = both[np.lexsort([-both[:, i] for i in reversed(range(len(keys)))])]
            if len(keys) == 2:
                # Sorted by the first key, a point stays if it tops all before it in the second.
                top = np.concatenate([[-np.inf], np.maximum.accumulate(both[:-1, 1])]) if len(both) else np.zeros(0)
                best = both[both[:, 1] > top]
                continue
            kept = np.zeros((0, len(keys)))
            for begin in range(0, len(both), 256):
                # A later point cannot beat an earlier one of this order.
                chunk = both[begin : begin + 256]
                chunk = chunk[~(kept[None] >= chunk[:, None]).all(axis=2).any(axis=1)]
                beaten = np.tril((chunk[None] >= chunk[:, None]).all(axis=2), -1).any(axis=1)
                kept = np.vstack([kept, chunk[~beaten]])
            best = kept
        yield pa.record_batch([pa.array(best[:, i]) for i in range(len(keys))], names=keys)

    schema = ", ".join(f"`{k}` double" for k in keys)
    points = cut(points.mapInArrow(front, schema))
    parts = points.rdd.getNumPartitions()
    while parts > 1:
        parts = max(1, parts // 8)
        points = cut(points.coalesce(parts).mapInArrow(front, schema))
    points = points.select(*[F.col(k).cast(types[k]).alias(k) for k in keys])
    return rows.join(points, keys, "left_semi")
