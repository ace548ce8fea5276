"""Clustering, projection, preference model, diversity selection and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


def as_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` and its array column as a vector ``features``; null arrays are dropped."""
    return rows.filter(F.col(column).isNotNull()).withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def _silhouette_sample(rows: DataFrame, n: int) -> DataFrame:
    """A bounded sample in hash order."""
    return rows.withColumn("_h", F.xxhash64(F.col("features").cast("string"))).orderBy("_h").limit(n).drop("_h")


def euclidean_silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; a cluster of one counts 0."""
    d = np.sqrt(np.maximum((points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T, 0))
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    sums = np.stack([d[:, labels == k].sum(1) for k in kinds], axis=1)
    sizes = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[at, own] = np.inf
    b = means.min(1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def cluster_scan(rows: DataFrame, column: str, ks=range(2, 9), seeds=(1729, 29, 41), sample: int = 1_200, starts: int = 10) -> list[tuple[int, float, float]]:
    """(k, mean silhouette, spread between seeds) of k-means, the best of ``starts`` fits by
    their cost for each seed; the silhouette is taken on a sample of a fixed size. The fits
    themselves cover all rows."""
    v = as_vectors(rows, column).select("features").cache()
    few = _silhouette_sample(v, sample).cache()
    out = []
    for k in ks:
        scores = []
        for seed in seeds:
            fits = (KMeans(k=k, seed=seed + 100_003 * i, initMode="k-means||").fit(v) for i in range(starts))
            model = min(fits, key=lambda m: m.summary.trainingCost)
            got = model.transform(few).select(vector_to_array("features").alias("x"), "prediction").toPandas()
            scores.append(euclidean_silhouette(np.array(got.x.tolist()), got.prediction.to_numpy()))
        out.append((k, float(np.mean(scores)), float(np.ptp(scores))))
    v.unpersist()
    few.unpersist()
    return out


def projected(rows: DataFrame, key: str, column: str, k: int = 3) -> DataFrame:
    """(key, component, value, share): principal components of the centred vectors; each
    component's sign is set so that its largest loading is positive."""
    v = as_vectors(rows, column)
    n = v.select(F.size(column)).first()
    if n is None:
        return rows.sparkSession.createDataFrame([], "key long, component int, value double, share double")
    mean = v.select(F.posexplode(F.col(column).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    means = [r.m for r in mean]
    centred = v.withColumn("features", array_to_vector(F.transform(F.col(column).cast("array<double>"), lambda x, i: x - F.element_at(F.array(*[F.lit(m) for m in means]), i + 1))))
    model = PCA(k=min(k, n[0]), inputCol="features", outputCol="pc").fit(centred)
    loads, share = model.pc.toArray(), model.explainedVariance.toArray()
    signs = [float(np.sign(loads[np.abs(loads[:, j]).argmax(), j]) or 1.0) for j in range(loads.shape[1])]
    out = model.transform(centred).select(F.col(key).alias("key"), F.posexplode(vector_to_array("pc")).alias("component", "value"))
    sign, part = F.array(*[F.lit(s) for s in signs]), F.array(*[F.lit(float(s)) for s in share])
    return out.select("key", "component", (F.col("value") * F.element_at(sign, F.col("component") + 1)).alias("value"), F.element_at(part, F.col("component") + 1).alias("share"))


def truncated_svd(rows: DataFrame, key: str, column: str, k: int, most: int = 4_096) -> DataFrame:
    """(key, component, value): rows by their ``k`` largest singular directions, at unit length.

    The product of the matrix with itself is summed over all rows; it has the square of the
    dimension, which may be ``most`` at the most, and is solved on the driver."""
    import pyarrow as pa

    first = rows.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    n = first[0] if first else 0
    if n > most:
        raise ValueError(f"{n} columns; hash them to {most} first")
    if not n:
        return rows.sparkSession.createDataFrame([], "key long, component int, value double")
    values = rows.filter(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x"))

    def gram(batches):
        total = np.zeros((n, n))
        for b in batches:
            m = b.column(1).flatten().to_numpy().reshape(-1, n)
            total += m.T @ m
        yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    total = np.zeros((n, n))
    for r in values.mapInArrow(gram, "i int, row array<double>").toLocalIterator():
        total[r.i] += r.row
    _, vectors = np.linalg.eigh(total)
    basis = vectors[:, ::-1][:, :k]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)

    def project(batches):
        for b in batches:
            y = b.column(1).flatten().to_numpy().reshape(-1, n) @ basis
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            at = np.arange(y.shape[1], dtype=np.int32)
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), len(at))), pa.array(np.tile(at, len(y))), pa.array(y.ravel())], names=["key", "component", "value"])

    return values.mapInArrow(project, "key long, component int, value double")


def preference_model(pairs: DataFrame, penalty: float = 1.0):
    """Logistic regression without intercept on (difference array, won): each pair enters
    with both signs, so no side is favoured; ``penalty`` is the weight of the squared norm."""
    from pyspark.ml.classification import LogisticRegression

    both = pairs.select("difference", F.col("won").cast("double").alias("label")).union(pairs.select(F.transform("difference", lambda x: -x), 1.0 - F.col("won").cast("double")))
    v = as_vectors(both, "difference")
    n = max(v.count(), 1)
    return LogisticRegression(fitIntercept=False, standardization=False, regParam=penalty / n, elasticNetParam=0.0).fit(v)


def mmr(scored: DataFrame, k: int, penalty: float = 1.4, most: int = 200) -> DataFrame:
    """(query, id, rank) of the greedy that takes the item with the best score less
    ``penalty`` times its largest cosine to those taken.

    ``scored`` has (query, id, score, vector) with unit vectors. A greedy is sequential, so
    only the ``most`` best items of a query are gathered, a parameter of the operator."""
    from pyspark.sql import Window as W

    best = scored.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= most).drop("_r")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        x, s = np.array(pdf.vector.tolist(), dtype=float), pdf.score.to_numpy(float)
        near, taken = np.zeros(len(pdf)), []
        for _ in range(min(k, len(pdf))):
            value = s - penalty * near
            value[taken] = -np.inf
            i = int(value.argmax())
            taken.append(i)
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"query": pdf["query"].iloc[taken].to_numpy(), "id": pdf["id"].iloc[taken].to_numpy(), "rank": np.arange(1, len(taken) + 1, dtype="int32")})

    return best.groupBy("query").applyInPandas(pick, "query long, id long, rank int")


def bootstrap_mean(deltas: DataFrame, column: str, rounds: int = 1_000, seed: int = 1729) -> tuple[float, float, float] | None:
    """(mean, low, high): mean and its 95 % interval by the Poisson bootstrap: every row has a
    random count in each round, drawn where it lies, and only sums leave the tasks. None for
    an empty table."""
    import pyarrow as pa

    # Chances of at most 0, 1, 2, ... for a mean of one, and a number for each round.
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
    turn = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)

    def draw(batches):
        total, weight = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            x, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy().view(np.uint64)
            for begin in range(0, len(x), 256):
                # A stream of numbers from the row's own: mixed bits as an even share.
                z = h[begin : begin + 256, None] ^ turn[None]
                z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                n = np.searchsorted(steps, ((z ^ z >> np.uint64(31)) >> np.uint64(11)) / float(1 << 53), side="right")
                total += x[begin : begin + 256] @ n
                weight += n.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(total), pa.array(weight)], names=["r", "t", "w"])

    # Rows are told apart by a number of their own, so that equal values draw apart.
    rows = deltas.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.xxhash64(*deltas.columns, F.monotonically_increasing_id()).alias("h"))
    got = rows.mapInArrow(draw, "r int, t double, w double").groupBy("r").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).filter("w > 0").toPandas()
    if not len(got):
        return None
    means = np.sort((got.t / got.w).to_numpy())
    return float(rows.agg(F.avg("x")).first()[0]), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))
