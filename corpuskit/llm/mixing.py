"""Problem 9: mixing sources to target weights.

Every document has a posterior over the target sources from a classifier trained on labelled
documents and calibrated on others; a recorded source is evidence for it that errs with a
small chance. Document rates, how often a document is taken on average, are fitted by
projected gradient so that the expected tokens of each source match its target: a pass over
all documents sums expected tokens by source, and the scaled residuals move each rate by the
document's own posterior and are cut back to its bounds. The rates are rounded by systematic
sampling, and what rounding leaves is corrected in tokens.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corpuskit.llm.tokens import encode
from corpuskit.operators.lineage import clean_key, cut, read_table

#: Labelled documents that train and calibrate the classifier, the first in hash order.
TRAINING_DOCS = 20_000
#: Share of these that it is calibrated and measured on.
HELD_OUT = 1 / 3
#: Bins of token ids, the classifier's features.
BINS = 16_384
#: Documents' worth of the common distribution in that of each source.
SMOOTHING = 20.0
#: Chance that a recorded source is wrong.
LABEL_ERROR = 0.01
#: Documents of one source and size class that one task ranks.
RANK_ROWS = 200_000
#: Tokens up to which a document may be added or left out to correct a share.
CORRECTION_TOKENS = 4_096
TEMPERATURES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0)


def documents_with_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, bins): source spelled one way, bins the token ids modulo BINS."""
    ids = encode(docs.filter("doc_id is not null"))
    sources = docs.filter("doc_id is not null").select("doc_id", clean_key("source").alias("source"))
    return sources.join(ids, "doc_id").select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids")


def _flat_bins(ids) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of each different bin of a batch of token lists: texts repeat their words."""
    offsets = ids.offsets.to_numpy()
    rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
    keys = np.unique(rows * BINS + ids.values.to_numpy()[offsets[0] : offsets[-1]] % BINS)
    return keys // BINS, keys % BINS


def _scores(ids, weights: np.ndarray) -> np.ndarray:
    """Per document and source the mean log weight of its bins, in units of their root: their
    number grows much faster than what they tell."""
    rows, bins = _flat_bins(ids)
    out = np.zeros((len(ids), len(weights)))
    if len(rows):
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        n = np.diff(np.append(starts, len(rows)))
        out[rows[starts]] = np.add.reduceat(weights.T[bins], starts) / np.maximum(1.0, np.sqrt(n) / 2)[:, None]
    return out


def posteriors(ids, weights: np.ndarray, priors: np.ndarray, temperature: float) -> np.ndarray:
    """Membership of each document of a column of token lists."""
    return _softmax(priors + _scores(ids, weights) / temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train_membership(rows: DataFrame, sources: list[str]):
    """Multinomial naive Bayes over token bins, made soft by the temperature under which the
    held-out documents are likeliest: log weights (sources, BINS), log priors, temperature and
    a report (held_out, accuracy, largest) with the share of the largest source beside."""
    place = {s: i for i, s in enumerate(sources)}
    spark, size = rows.sparkSession, len(sources)
    h = F.xxhash64("doc_id")
    table = spark.createDataFrame(list(place.items()), "source string, s int")
    sample = rows.join(F.broadcast(table), "source").filter("n_tokens > 0").select("s", "ids", h.alias("h")).orderBy("h").limit(TRAINING_DOCS)
    sample = cut(sample.select("s", "ids", (F.pmod(F.xxhash64(F.lit("held"), "h"), F.lit(1000)) < int(1000 * HELD_OUT)).alias("held")))

    def count(batches):
        counts, docs = np.zeros(size * BINS), np.zeros(size)
        for batch in batches:
            s = batch.column(0).to_numpy()
            r, b = _flat_bins(batch.column(1))
            counts += np.bincount(s[r] * BINS + b, minlength=len(counts))
            docs += np.bincount(s, minlength=size)
        at, own = np.flatnonzero(counts), np.flatnonzero(docs)
        yield pa.record_batch([pa.array(np.append(at, -1 - own)), pa.array(np.append(counts[at], docs[own]))], names=["k", "n"])

    # At most (BINS + 1) numbers for each source come to the driver.
    got = sample.filter("not held").select("s", "ids").mapInArrow(count, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    k, n = got.k.to_numpy(np.int64), got.n.to_numpy(float)
    counts, docs = np.zeros(size * BINS), np.ones(size)
    counts[k[k >= 0]] = n[k >= 0]
    docs[-1 - k[k < 0]] += n[k < 0]
    counts = counts.reshape(size, BINS)
    # Small sources lean on what all have, so that a rare bin does not speak for them.
    common = (counts.sum(axis=0) + 0.5) / (docs.sum() + 1.0)
    weights, priors = np.log((counts + SMOOTHING * common) / (docs[:, None] + SMOOTHING)), np.log(docs / docs.sum())

    def judge(batches):
        out = np.zeros((len(TEMPERATURES), 3))
        for batch in batches:
            s = batch.column(0).to_numpy()
            for i, t in enumerate(TEMPERATURES):
                p = posteriors(batch.column(1), weights, priors, t)
                own = p[np.arange(len(s)), s]
                out[i] += len(s), (p.argmax(axis=1) == s).sum(), np.log(np.maximum(own, 1e-12)).sum()
        yield pa.record_batch([pa.array(np.arange(len(out))), *(pa.array(c) for c in out.T)], names=["t", "n", "hit", "log"])

    held = sample.filter("held").select("s", "ids").mapInArrow(judge, "t long, n double, hit double, log double").groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", "hit", "log")]).orderBy(F.desc("log"), "t").first()
    if held is None or not held.n:
        return weights, priors, 4.0, (0, None, float(np.exp(priors).max()))
    return weights, priors, TEMPERATURES[held.t], (int(held.n), held.hit / held.n, float(np.exp(priors).max()))


def fit_rates(soft: DataFrame, caps: np.ndarray, available: np.ndarray, goal: np.ndarray, rounds: int = 100, tolerance: float = 1e-4):
    """(steps, losses) for ``soft`` (n_tokens, cap, q), ``goal`` tokens per source.

    Least squares over the expected totals, each scaled by what the source has; in that scale
    no step overshoots, so each is taken whole. A rate is the cut-back sum of a document's
    steps, so the documents are read once a round and never written. The loss is the mean
    square of the residuals as shares of the goals, of the sources that can still move."""
    size, steps, losses = len(goal), [], []
    for _ in range(rounds):
        expected = np.zeros(size)
        if steps:
            history = np.array(steps)

            def total(batches):
                out = np.zeros(size)
                for batch in batches:
                    q = batch.column(2).flatten().to_numpy().reshape(-1, size)
                    out += (replay(q, batch.column(1).to_numpy(), history) * batch.column(0).to_numpy()) @ q
                yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["s", "e"])

            for r in soft.select("n_tokens", "cap", "q").mapInArrow(total, "s int, e double").groupBy("s").agg(F.sum("e").alias("e")).collect():
                expected[r.s] += r.e
        losses.append(float((((goal - expected) / goal) ** 2).mean()))
        if losses[-1] < tolerance**2 or len(losses) > 2 and losses[-2] - losses[-1] < tolerance * losses[-1]:
            break
        steps.append((goal - expected) / available)
    else:
        warnings.warn(f"no convergence in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return np.array(steps).reshape(-1, size), losses


def replay(q: np.ndarray, caps: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rate of each document after all steps, between 0 and its cap."""
    r = np.zeros(len(q))
    for step in steps:
        r = np.clip(r + q @ step, 0.0, caps)
    return r


def corrections(missing: dict[str, float], sizes) -> list[tuple[str, int, int, int]]:
    """(source, n_tokens, change, documents): which documents of a size to take once more or
    once less, the largest that fit first. ``sizes`` has (source, n_tokens, addable, removable)."""
    by: dict[str, list] = {}
    for s, n, add, remove in sizes:
        by.setdefault(s, []).append((n, add, remove))
    out = []
    for s, left in sorted(missing.items()):
        change = 1 if left > 0 else -1
        left = abs(left)
        for n, add, remove in sorted(by.get(s, []), reverse=True):
            # To the nearest, so that half of the smallest may be left.
            k = min(int(left / n + (0.5 if n == 1 else 0.0)), add if change > 0 else remove)
            if k > 0:
                out.append((s, n, change, k))
                left -= k * n
    return out


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Selection (doc_id, source, n_tokens, repeats, recorded), shares by source, loss by
    round, and the classifier's report.

    Sources that differ in case or outer blanks are one; a source named twice in ``targets``
    has the sum of its weights and the larger number of repeats. Documents of other sources
    are not taken. One without a source counts for its likeliest source, is taken at most
    once and has ``recorded`` false. The size of the mix is the largest at which every source
    that has documents can reach its share within its repeats; the weight of sources without
    documents falls to the others in proportion. Documents without tokens are not taken.
    """
    spark = docs.sparkSession
    wanted = targets.select(clean_key("source").alias("source"), "target_weight", "max_repeats").filter("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("cap"))
    # A table of sources, not of documents.
    wanted = sorted((r.source, float(r.w or 0), int(r.cap or 0)) for r in wanted.collect())
    rows = cut(documents_with_tokens(docs))
    have = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).filter(F.col("source").isin([s for s, _, _ in wanted])).collect()}
    sources = [s for s, w, cap in wanted if have.get(s) and w > 0 and cap > 0]
    if not sources:
        shares = spark.createDataFrame([(s, w, cap, 0, 0.0, 0.0) for s, w, cap in wanted], _SHARES)
        return spark.createDataFrame([], _SELECTION), shares, spark.createDataFrame([], _ROUNDS), (0, None, None, None)
    weight = np.array([w for s, w, _ in wanted if s in sources])
    caps = np.array([float(c) for s, _, c in wanted if s in sources])
    labelled = np.array([float(have[s]) for s in sources])
    goal = weight / weight.sum()
    goal = goal * (caps * labelled / goal).min()
    nb, priors, temperature, report = train_membership(rows, sources)
    size = len(sources)
    table = spark.createDataFrame([(s, i, float(c)) for i, (s, c) in enumerate(zip(sources, caps))], "source string, s int, cap double")
    names = pa.array(sources, pa.string())

    def soften(batches):
        for batch in batches:
            s = batch.column(2).fill_null(-1).to_numpy()
            q = priors + _scores(batch.column(4), nb) / temperature
            known = np.flatnonzero(s >= 0)
            q[known] += np.log(LABEL_ERROR / max(size - 1, 1))
            q[known, s[known]] += np.log(1 - LABEL_ERROR) - np.log(LABEL_ERROR / max(size - 1, 1))
            q = _softmax(q)
            best = np.where(s >= 0, s, q.argmax(axis=1))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(s >= 0), batch.column(3).fill_null(1.0), pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, size, dtype=np.int32)), pa.array(q.ravel()))],
                names=["doc_id", "n_tokens", "source", "recorded", "cap", "q"],
            )

    soft = rows.filter("n_tokens > 0").join(F.broadcast(table), "source", "left").filter("s is not null or source is null")
    soft = soft.select("doc_id", "n_tokens", "s", "cap", "ids").mapInArrow(soften, "doc_id long, n_tokens int, source string, recorded boolean, cap double, q array<double>")
    soft = cut(soft)
    sums = soft.agg(*[F.sum(F.col("n_tokens") * F.col("q")[i]) for i in range(size)]).first()
    steps, losses = fit_rates(soft, caps, np.maximum(np.array(list(sums)), 1.0), goal)

    def rated(batches):
        for batch in batches:
            q = batch.column(5).flatten().to_numpy().reshape(-1, size)
            rate = replay(q, batch.column(4).to_numpy(), steps) if len(q) else np.zeros(0)
            yield pa.record_batch([*batch.columns[:5], pa.array(rate), batch.column(5)], names=["doc_id", "n_tokens", "source", "recorded", "cap", "rate", "q"])

    # Systematic rounding within size classes, in hash order.
    own = soft.mapInArrow(rated, "doc_id long, n_tokens int, source string, recorded boolean, cap double, rate double, q array<double>")
    expected = own.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("q")[i]) for i in range(size)]).first()
    own = own.drop("q").withColumn("class", F.floor(4 * F.log2("n_tokens")).cast("int")).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id"))
    counts = own.groupBy("source", "class").agg(F.ceil(F.count("*") / RANK_ROWS).alias("buckets"))
    # Sources times size classes, of which a text has at most a hundred and odd.
    own = own.join(F.broadcast(counts), ["source", "class"]).withColumn("bucket", F.pmod("h", "buckets"))
    # The strata follow each other, so that a source is off by less than one document and not
    # by one in each stratum; their starts are sums over the table of strata.
    order = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = own.groupBy("source", "class", "bucket").agg(F.sum("rate").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(order), F.lit(0.0))).drop("sum")
    upto = F.sum("rate").over(W.partitionBy("source", "class", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("upto", upto).join(starts, ["source", "class", "bucket"])
    at = F.round(F.col("start") + F.col("upto"), 6)
    taken = F.floor(at + 0.5) - F.floor(F.round(F.col("start") + F.col("upto") - F.col("rate"), 6) + 0.5)
    chosen = cut(own.select("doc_id", "source", "n_tokens", "recorded", "h", "cap", F.greatest(F.lit(0), F.least(taken, F.col("cap"))).cast("int").alias("repeats")))

    # What rounding leaves, in tokens: a few small documents of each source once more or less.
    got = {r.source: float(r.n) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    may_add, may_drop = F.col("repeats") < F.col("cap"), F.col("repeats") > 0
    sizes = chosen.filter(F.col("n_tokens") <= CORRECTION_TOKENS).groupBy("source", "n_tokens").agg(F.count(F.when(may_add, 1)).alias("add"), F.count(F.when(may_drop, 1)).alias("remove"))
    # At most CORRECTION_TOKENS rows for each source.
    plan = corrections({s: g - got.get(s, 0.0) for s, g in zip(sources, goal)}, [tuple(r) for r in sizes.collect()])
    plan = spark.createDataFrame(plan, "source string, n_tokens int, change int, k int")
    able = chosen.join(F.broadcast(plan), ["source", "n_tokens"]).filter(F.when(F.col("change") > 0, may_add).otherwise(may_drop))
    able = able.withColumn("rn", F.row_number().over(W.partitionBy("source", "n_tokens").orderBy("h", "doc_id"))).filter(F.col("rn") <= F.col("k"))
    chosen = chosen.join(able.select("doc_id", "change"), "doc_id", "left")
    selection = chosen.select("doc_id", "source", "n_tokens", (F.col("repeats") + F.coalesce("change", F.lit(0))).cast("int").alias("repeats"), "recorded").filter("repeats > 0")
    selection = cut(selection)

    tokens = {r.source: int(r.n) for r in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    total, soft_total = sum(tokens.values()), sum(expected)
    member = dict(zip(sources, expected))
    shares = [(s, w, cap, tokens.get(s, 0), tokens.get(s, 0) / total if total else 0.0, member.get(s, 0.0) / soft_total if soft_total else 0.0) for s, w, cap in wanted]
    return selection, spark.createDataFrame(shares, _SHARES), spark.createDataFrame(list(enumerate(losses)), _ROUNDS), (*report, temperature)


_SELECTION = "doc_id long, source string, n_tokens int, repeats int, recorded boolean"
_ROUNDS = "round long, loss double"
_SHARES = "source string, target_weight double, max_repeats int, n_tokens long, share double, expected_share double"


def _mix(spark: SparkSession, sf_dir: str):
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken and how often; ``recorded`` is false where the source is the
    likeliest one and not a recorded one."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source reached, and that expected by memberships."""
    return _mix(spark, sf_dir)[1]


def p9_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of the fitted rates after each round."""
    return _mix(spark, sf_dir)[2]


def p9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on held-out labelled documents, the share of the largest source beside; no
    row without such documents."""
    report = _mix(spark, sf_dir)[3]
    return spark.createDataFrame([report] if report[0] else [], "held_out long, accuracy double, largest double, temperature double")
