"""Problem 5: consensus from several annotators' labels.

Iteratively reweighted voting. An annotator of accuracy a votes with the weight
log(a (K - 1) / (1 - a)) for the K choices; the consensus of the others on an item gives
the probability that the annotator's own answer is right, and the smoothed mean of these
leave-one-out probabilities is the next accuracy, until no accuracy moves.

Items of ordinary size are stored as one row of votes each, so a round reads the stored
items and shuffles nothing but one row per task and annotator. Items with more votes, and
populations too large for the driver, take the route by joins, which computes the same sums.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm.votes import CHOICES, latest_answers
from corpuskit.operators.lineage import attach_by_key, cut, read_table, stored

K = len(CHOICES)
START, PRIOR_VOTES = 0.7, 2.0
#: Votes of one item up to which they are kept in one row.
ROW_VOTES = 10_000
#: Annotators up to which the driver holds names and accuracies and broadcasts them: with
#: names of a hundred bytes some 20 MB.
DRIVER_ANNOTATORS = 200_000
#: Accuracy below which answers tell nothing: between a coin and careful work.
USELESS_BELOW = 0.62


@dataclass
class Prepared:
    names: list[str]
    items: DataFrame  # comparisonId, dimension, js array<int>, ks array<int>
    large: DataFrame | None  # comparisonId, dimension, item, annotator, k
    prior: np.ndarray


def weight_of(accuracy):
    return np.log(accuracy * (K - 1) / (1 - accuracy))


def _vote_round(js, ks, starts, accuracy, log_prior):
    """Per vote the chance that it is right given the others, and per item the sums."""
    item = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    a = accuracy[js]
    w = weight_of(a)
    sums = np.bincount(item * K + ks, w, (len(starts) - 1) * K).reshape(-1, K)
    others = sums[item] + log_prior
    others[np.arange(len(js)), ks] -= w
    others -= others.max(axis=1, keepdims=True)
    q = np.exp(others)
    q /= q.sum(axis=1, keepdims=True)
    own = q[np.arange(len(js)), ks]
    right = a * own / (a * own + (1 - a) / (K - 1) * (1 - own))
    return right, sums


def _flat(batch, j, k):
    js, ks = batch.column(j), batch.column(k)
    starts = js.offsets.to_numpy() - js.offsets[0].as_py()
    return js.flatten().to_numpy(), ks.flatten().to_numpy(), starts


def prepare(answers: DataFrame) -> Prepared | DataFrame:
    """Votes by item, or for populations beyond DRIVER_ANNOTATORS the plain answers."""
    spark = answers.sparkSession
    people = answers.groupBy("annotator").count()
    counted = people.limit(DRIVER_ANNOTATORS + 1).collect()
    if len(counted) > DRIVER_ANNOTATORS:
        return answers
    names = sorted(r.annotator for r in counted)
    tally = dict(answers.groupBy("k").count().collect())
    prior = np.array([tally.get(k, 0) + 1.0 for k in range(K)])
    ids = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator string, j int")
    # The bound on annotators bounds this broadcast.
    coded = answers.join(F.broadcast(ids), "annotator")
    sizes = answers.groupBy("comparisonId", "dimension").count().filter(F.col("count") > ROW_VOTES)
    sizes = cut(sizes.drop("count"))
    large = None
    if not sizes.isEmpty():
        key = ["comparisonId", "dimension"]
        item = F.concat_ws("\u0001", *key).alias("item")
        large = cut(answers.join(F.broadcast(sizes), key, "left_semi").select(*key, item, "annotator", "k"))
        coded = coded.join(F.broadcast(sizes), key, "left_anti")
    items = coded.groupBy("comparisonId", "dimension").agg(F.collect_list(F.struct("j", "k")).alias("votes"))
    items = items.select("comparisonId", "dimension", F.col("votes.j").alias("js"), F.col("votes.k").alias("ks"))
    return Prepared(names, cut(items), large, np.log(prior / prior.sum()))


def joined_round(answers: DataFrame, accuracy: DataFrame, log_prior) -> DataFrame:
    """(annotator, right, n) by joins: ``answers`` (item, annotator, k), ``accuracy``
    (annotator, accuracy). Sums per item are combined before the shuffle; items of more
    than a million votes are joined back by broadcast."""
    w = F.log(F.col("accuracy") * (K - 1) / (1 - F.col("accuracy")))
    voted = answers.join(accuracy, "annotator").withColumn("w", w)
    sums = voted.groupBy("item").agg(
        F.count("*").alias("votes"), *[F.sum(F.when(F.col("k") == c, F.col("w")).otherwise(0.0)).alias(f"s{c}") for c in range(K)]
    )
    back = attach_by_key(voted, sums, "item", "votes")
    others = [F.exp(F.col(f"s{c}") + float(log_prior[c]) - F.when(F.col("k") == c, F.col("w")).otherwise(0.0)) for c in range(K)]
    total = others[0]
    for x in others[1:]:
        total = total + x
    own = F.lit(0.0)
    for c in range(K):
        own = F.when(F.col("k") == c, others[c] / total).otherwise(own)
    a = F.col("accuracy")
    right = a * own / (a * own + (1 - a) / (K - 1) * (1 - own))
    return back.groupBy("annotator").agg(F.sum(right).alias("right"), F.count("*").alias("n"))


def fit(ready: Prepared, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy and number of answers of each of ``ready.names``."""
    spark = ready.items.sparkSession
    accuracy = np.full(len(ready.names), START)
    n = np.zeros(len(ready.names))
    place = {name: i for i, name in enumerate(ready.names)}
    prior = ready.prior
    for _ in range(rounds):
        at = spark.sparkContext.broadcast(accuracy)

        def one(batches):
            right, count = np.zeros(len(at.value)), np.zeros(len(at.value))
            for batch in batches:
                js, ks, starts = _flat(batch, 0, 1)
                if len(js):
                    r, _ = _vote_round(js, ks, starts, at.value, prior)
                    right += np.bincount(js, r, len(right))
                    count += np.bincount(js, minlength=len(right))
            seen = np.flatnonzero(count)
            yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(right[seen]), pa.array(count[seen])], names=["j", "right", "n"])

        got = ready.items.select("js", "ks").mapInArrow(one, "j int, right double, n double").groupBy("j").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
        right, n = np.zeros(len(accuracy)), np.zeros(len(accuracy))
        for r in got.toLocalIterator():
            right[r.j], n[r.j] = r.right, r.n
        if ready.large is not None:
            frame = spark.createDataFrame(list(zip(ready.names, accuracy.tolist())), "annotator string, accuracy double")
            for r in joined_round(ready.large, F.broadcast(frame), prior).toLocalIterator():
                right[place[r.annotator]] += r.right
                n[place[r.annotator]] += r.n
        new = np.clip((right + PRIOR_VOTES * START) / (n + PRIOR_VOTES), 0.02, 0.98)
        moved = np.abs(new - accuracy).max(initial=0)
        accuracy = new
        at.destroy()
        if moved < tolerance:
            break
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return accuracy, n


def fit_joined(answers: DataFrame, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """(annotator, accuracy, n) for any number of annotators, by joins alone."""
    answers = stored(answers.withColumn("item", F.concat_ws("\u0001", "comparisonId", "dimension")))
    tally = dict(answers.groupBy("k").count().collect())
    prior = np.array([tally.get(k, 0) + 1.0 for k in range(K)])
    prior = np.log(prior / prior.sum())
    at = stored(answers.groupBy("annotator").agg(F.lit(START).alias("accuracy"), F.count("*").alias("n")))
    for _ in range(rounds):
        new = joined_round(answers, at.select("annotator", "accuracy"), prior).select(
            "annotator",
            F.least(F.lit(0.98), F.greatest(F.lit(0.02), (F.col("right") + PRIOR_VOTES * START) / (F.col("n") + PRIOR_VOTES))).alias("accuracy"),
            "n",
        )
        new = stored(new)
        moved = new.join(at.select("annotator", F.col("accuracy").alias("was")), "annotator").agg(F.max(F.abs(F.col("accuracy") - F.col("was")))).first()[0]
        at = new
        if (moved or 0) < tolerance:
            break
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return at


def reliability(preferences: DataFrame) -> DataFrame:
    """``reliability_of`` the answers that hold."""
    return reliability_of(cut(latest_answers(preferences)))


def reliability_of(answers: DataFrame) -> DataFrame:
    """(annotator, accuracy, n): the share of an annotator's answers that hit the truth,
    estimated from the others' consensus and smoothed by PRIOR_VOTES answers of START.
    An empty table gives no row."""
    ready = prepare(answers)
    spark = answers.sparkSession
    if isinstance(ready, DataFrame):
        return fit_joined(ready)
    accuracy, n = fit(ready)
    return spark.createDataFrame(list(zip(ready.names, accuracy.tolist(), [int(x) for x in n])), "annotator string, accuracy double, n long")


def consensus(preferences: DataFrame) -> DataFrame:
    """(comparisonId, dimension, choice, confidence, n, agreement, corrected).

    ``choice`` has the largest weighted vote, the first in CHOICES on a tie;
    ``confidence`` is its posterior. ``agreement`` is the share of agreeing pairs of
    answers, null for a single answer; ``corrected`` sets it against the agreement that
    chance gives with the dimension's own answer shares (1 complete, 0 chance), which
    needs no complete ratings. Comparisons without any answer have no row.
    """
    answers = cut(latest_answers(preferences))
    people = reliability_of(answers).select("annotator", F.log(F.col("accuracy") * (K - 1) / (1 - F.col("accuracy"))).alias("w"))
    votes = answers.join(people, "annotator")
    items = votes.groupBy("comparisonId", "dimension").agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(F.col("k") == c, F.col("w")).otherwise(0.0)).alias(f"s{c}") for c in range(K)],
        *[F.count(F.when(F.col("k") == c, 1)).alias(f"n{c}") for c in range(K)],
    )
    items = cut(items)
    best = F.greatest(*[F.col(f"s{c}") for c in range(K)])
    choice = F.lit(None).cast("string")
    for c in reversed(range(K)):
        choice = F.when(F.col(f"s{c}") == best, CHOICES[c]).otherwise(choice)
    total = sum((F.exp(F.col(f"s{c}") - best) for c in range(K)), F.lit(0.0))
    pairs = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(K)), F.lit(0))
    agreement = F.when(F.col("n") > 1, pairs / (F.col("n") * (F.col("n") - 1)))
    m = F.col("m")
    chance = (
        items.filter("n > 1")
        .groupBy("dimension")
        .agg(F.sum("n").alias("m"), *[F.sum(f"n{c}").alias(f"m{c}") for c in range(K)])
        .select("dimension", (sum((F.col(f"m{c}") * (F.col(f"m{c}") - 1) for c in range(K)), F.lit(0)) / (m * (m - 1))).alias("chance"))
    )
    return items.join(F.broadcast(chance), "dimension", "left").select(
        "comparisonId", "dimension", choice.alias("choice"), (1 / total).alias("confidence"), "n", agreement.alias("agreement"),
        F.when(F.col("chance") < 1, (agreement - F.col("chance")) / (1 - F.col("chance"))).alias("corrected"),
    )


def agreement(preferences: DataFrame) -> DataFrame:
    """(dimension, n_items, n_answers, observed, chance, coefficient) over the items with two
    answers or more: the share of agreeing pairs, each item weighted by its answers, that of
    the dimension's own answer shares, and the one corrected by the other, which takes any
    number of answers an item (1 complete, 0 chance, null without two items' worth of choice)."""
    n, m = F.col("n"), F.col("m")
    items = latest_answers(preferences).groupBy("comparisonId", "dimension").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("k") == c, 1)).alias(f"n{c}") for c in range(K)]).filter("n > 1")
    same = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(K)), F.lit(0)) / (n - 1)
    sums = items.groupBy("dimension").agg(F.count("*").alias("n_items"), F.sum("n").alias("m"), F.sum(same).alias("same"), *[F.sum(f"n{c}").alias(f"m{c}") for c in range(K)])
    chance = sum((F.col(f"m{c}") * (F.col(f"m{c}") - 1) for c in range(K)), F.lit(0)) / (m * (m - 1))
    out = sums.select("dimension", "n_items", m.alias("n_answers"), (F.col("same") / m).alias("observed"), chance.alias("chance"))
    coefficient = F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance")))
    return out.select("dimension", "n_items", "n_answers", F.round("observed", 6).alias("observed"), F.round("chance", 6).alias("chance"), F.round(coefficient, 6).alias("coefficient"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators whose answers tell nothing about the consensus or contradict it."""
    people = reliability(read_table(spark, sf_dir, "preferences"))
    return people.filter(F.col("accuracy") < USELESS_BELOW).select(F.col("annotator").alias("annotatorId"))


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = reliability(read_table(spark, sf_dir, "preferences"))
    return people.select(F.col("annotator").alias("annotatorId"), F.round("accuracy", 6).alias("reliability"), F.col("n").alias("n_answers"))


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(read_table(spark, sf_dir, "preferences"))


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement of each dimension."""
    return agreement(read_table(spark, sf_dir, "preferences"))
