"""Problem 1: splits that keep related records together.

Ties are found by the union-find forests of ``operators.components``; the tied sets are then
dealt to the splits, largest first, by a greedy that needs the distribution of sizes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corpuskit.operators.components import components, node_name
from corpuskit.operators.lineage import attach_by_key, clean_key, cut, read_table

SPLITS = ("train", "validation", "test")


def canonical_split(c) -> F.Column:
    """train, validation or test however spelled; null for null and anything else."""
    c = clean_key(c)
    return (
        F.when(c.rlike(r"^(train|training|trn)$"), "train")
        .when(c.rlike(r"^(validation|valid|validate|val|dev|development)$"), "validation")
        .when(c.rlike(r"^(test|tests|testing|tst)$"), "test")
    )


def tied_sets(comparisons: DataFrame) -> DataFrame:
    """(comparisonId, root, recorded): one row per comparison, null ids dropped.

    ``recorded`` is the set of splits named by its rows. Comparisons without any key
    form sets of their own. Repeated rows count once; rows of one id that differ in
    their keys tie all of these.
    """

    ties = {"group": "g", "postId": "p", "family": "f"}
    rows = comparisons.filter("comparisonId is not null").select(
        F.col("comparisonId").alias("comparisonId"),
        node_name("c", F.col("comparisonId")).alias("c"),
        F.array_compact(F.array(*[node_name(kind, clean_key(k)) for k, kind in ties.items()])).alias("others"),
        canonical_split("split").alias("split"),
    )
    ids = rows.groupBy("comparisonId", "c").agg(F.collect_set("split").alias("recorded"))
    roots = components(rows.select(F.concat(F.array("c"), "others").alias("keys")))
    return ids.join(roots.withColumnRenamed("node", "c"), "c").select("comparisonId", "root", "recorded")


def set_sizes(tied: DataFrame) -> DataFrame:
    """(root, size, n_splits) of every tied set, by partial aggregation."""
    return tied.groupBy("root").agg(
        F.count("*").alias("size"),
        (
            F.max(F.array_contains("recorded", "train").cast("int"))
            + F.max(F.array_contains("recorded", "validation").cast("int"))
            + F.max(F.array_contains("recorded", "test").cast("int"))
        ).alias("n_splits"),
    )


def greedy_counts(sizes: list[tuple[int, int]], shares: tuple[float, ...]) -> dict[int, list[int]]:
    """Largest-first greedy on a histogram (size, number of sets of it): how many sets of
    each size go to each split. The same as giving set after set to the split furthest
    below its target, as sets of one size are alike; equal deficits go to the first split.
    """
    total = sum(s * n for s, n in sizes)
    deficit = [share * total for share in shares]
    out = {}
    for size, n in sorted(sizes, reverse=True):
        # Greedy takes the n largest of the numbers deficit - j * size; a level below
        # all but the last few of them is found by bisection, these are then dealt singly.
        taken = [0] * len(shares)
        if n > 8:
            low, high = min(deficit) - size * (n + 1), max(deficit)

            def above(level):
                return [max(0, int((d - level) // size)) for d in deficit]

            for _ in range(200):
                mid = (low + high) / 2
                if sum(above(mid)) > n:
                    low = mid
                else:
                    high = mid
            taken = above(high)
        left = [d - t * size for d, t in zip(deficit, taken)]
        for _ in range(n - sum(taken)):
            k = max(range(len(left)), key=lambda i: (left[i], -i))
            taken[k] += 1
            left[k] -= size
        deficit = left
        out[size] = taken
    return out


def assign_splits(
    tied: DataFrame, shares: tuple[float, ...] = (0.7, 0.2, 0.1), bucket_sets: int = 200_000, seed: str = "split"
) -> DataFrame:
    """(comparisonId, root, size, split): all comparisons of a tied set in one split.

    The driver holds one number pair per distinct set size, of which n rows can have
    at most sqrt(2 n). Which sets of a size go where is settled by their rank in hash
    order; sets of one size are ranked within hash buckets of about ``bucket_sets``, and
    the buckets' starts are added, so no task ranks them all.
    """
    spark = tied.sparkSession
    sets = cut(set_sizes(tied))
    histogram = [(r["size"], r["count"]) for r in sets.groupBy("size").count().collect()]
    dealt = greedy_counts(histogram, shares)
    rows = []
    for size, n in histogram:
        a, b, _ = dealt[size]
        rows.append((size, max(1, -(-n // bucket_sets)), a, a + b))
    plan = spark.createDataFrame(rows or [(0, 1, 0, 0)], "size long, buckets int, to_train long, to_validation long")
    hashed = (
        sets.join(F.broadcast(plan), "size")
        .withColumn("h", F.xxhash64(F.lit(seed), "root"))
        .withColumn("bucket", F.pmod("h", F.col("buckets")))
    )
    starts = hashed.groupBy("size", "bucket").count()
    starts = starts.withColumn(
        "start",
        F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    ranked = hashed.withColumn("rn", F.row_number().over(W.partitionBy("size", "bucket").orderBy("h", "root")))
    rank = F.col("rn") + F.col("start") - 1
    named = ranked.join(starts, ["size", "bucket"]).select(
        "root",
        "size",
        F.when(rank < F.col("to_train"), "train").when(rank < F.col("to_validation"), "validation").otherwise("test").alias("split"),
    )
    return attach_by_key(tied.select("comparisonId", "root"), named, "root", "size")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of tied sets whose recorded splits disagree."""
    tied = cut(tied_sets(read_table(spark, sf_dir, "comparisons")))
    bad = set_sizes(tied).filter("n_splits > 1")
    return attach_by_key(tied, bad, "root", "size").select("comparisonId")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparison with its tied set and its split at 70/20/10."""
    tied = cut(tied_sets(read_table(spark, sf_dir, "comparisons")))
    return assign_splits(tied).select("comparisonId", F.sha2("root", 256).alias("set_id"), F.col("size").alias("set_size"), "split")
