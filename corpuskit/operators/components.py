"""Connected components by union-find in forests, merged level by level.

Every task joins the keys of its own rows (no shuffle), then the roots that one key has in
several forests are linked, and those links form the next, smaller graph. Only links between
roots are ever regrouped, never the members of a root, so a key shared by a third of all rows
costs one link per task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.operators.lineage import cut

#: Links that one union-find task of a higher level takes on average.
LINKS_PER_TASK = 1_000_000


def node_name(kind: str, key: Column) -> Column:
    """Name of a node that begins with a hash, so that the least name of a neighbourhood is
    a random one and each level leaves but a fraction of the nodes; null for a null key."""
    named = F.concat(F.lit(kind + ":"), key)
    return F.when(key.isNotNull(), F.concat(F.lpad(F.hex(F.xxhash64(named)), 16, "0"), named))


def _forest(batches):
    """Union-find over the ``keys`` arrays of one partition: (node, root), root least."""
    ids: dict[str, int] = {}
    names: list[str] = []
    parent: list[int] = []

    def node(name: str) -> int:
        i = ids.get(name)
        if i is None:
            i = ids[name] = len(names)
            names.append(name)
            parent.append(i)
        return i

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for batch in batches:
        for keys in batch.column(0).to_pylist():
            if not keys:
                continue
            a = find(node(keys[0]))
            for other in keys[1:]:
                b = find(node(other))
                if a == b:
                    continue
                if names[a] > names[b]:
                    a, b = b, a
                parent[b] = a
    step = 50_000
    for at in range(0, len(names), step):
        part = range(at, min(at + step, len(names)))
        yield pa.record_batch([pa.array([names[i] for i in part]), pa.array([names[find(i)] for i in part])], names=["node", "root"])


def _level(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forests of the partitions of ``keys``: the least root of each node, and the links
    between the roots that share a node."""
    forest = keys.mapInArrow(_forest, "node string, root string")
    roots = cut(forest.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    links = roots.filter(F.size("roots") > 1).select("root", F.explode("roots").alias("other")).filter("root <> other").distinct()
    return roots.select("node", "root"), cut(links)


def components(keys: DataFrame) -> DataFrame:
    """(node, root) for an array column ``keys`` of node names whose members are tied.

    Nulls inside an array must be removed before; empty arrays tie nothing. Root is the
    least name of the component.
    """
    level, links = _level(keys.select("keys"))
    levels = [level]
    while n := links.count():
        parts = links.repartition(max(1, n // LINKS_PER_TASK), "root").select(F.array("root", "other").alias("keys"))
        level, links = _level(parts)
        levels.append(level)
    out = levels.pop()
    while levels:
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = levels.pop().join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
