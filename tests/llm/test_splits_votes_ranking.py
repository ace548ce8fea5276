import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import consensus, ranking, splits
from corpuskit.llm.votes import latest_answers

COMPARISON = "comparisonId string, `group` string, postId string, family string, split string, extra int"
ANSWER = "comparisonId string, annotatorId string, dimension string, choice string, revision int, savedAt timestamp"


def test_tied_sets_case_blanks_nulls_and_repeats(spark):
    rows = [
        ("a", "G1", None, None, "train", 1), ("b", " g1 ", "p1", None, "TEST ", 1), ("c", None, "P1", "", None, 1), ("d", None, None, None, "val", 1),
        ("a", "G1", None, None, "train", 1), (None, "g1", None, None, "train", 1), ("e", None, None, "f", "odd", 1), ("f", None, None, "F", "training", 1),
    ]
    tied = splits.tied_sets(spark.createDataFrame(rows, COMPARISON)).collect()
    root = {r.comparisonId: r.root for r in tied}
    assert len(tied) == 6 and root["a"] == root["b"] == root["c"] and root["e"] == root["f"] and len(set(root.values())) == 3
    sizes = {r.root: (r["size"], r.n_splits) for r in splits.set_sizes(splits.tied_sets(spark.createDataFrame(rows, COMPARISON))).collect()}
    assert sizes[root["a"]] == (3, 2) and sizes[root["e"]] == (2, 1) and sizes[root["d"]] == (1, 1)


def test_greedy_is_that_of_set_after_set():
    random.seed(1)
    for _ in range(60):
        sizes = [(s, random.randrange(1, 40)) for s in random.sample(range(1, 60), random.randrange(1, 7))]
        total = sum(s * n for s, n in sizes)
        shares = (0.7, 0.2, 0.1)
        left, want = [x * total for x in shares], {}
        for s, n in sorted(sizes, reverse=True):
            want[s] = [0, 0, 0]
            for _ in range(n):
                k = max(range(3), key=lambda i: (left[i], -i))
                want[s][k] += 1
                left[k] -= s
        got = splits.greedy_counts(sizes, shares)
        mine = [x * total - sum(s * got[s][i] for s in got) for i, x in enumerate(shares)]
        assert {s: sum(v) for s, v in got.items()} == dict(sizes)
        assert sorted(np.abs(mine)) == pytest.approx(sorted(np.abs(left)), abs=max(s for s, _ in sizes) + 1e-6)


def test_splits_divide_no_set(spark):
    random.seed(2)
    rows = [(f"c{i}", f"g{random.randrange(150)}", None, None, None, 0) for i in range(600)] + [(f"h{i}", "hot", None, None, None, 0) for i in range(300)]
    tied = splits.tied_sets(spark.createDataFrame(rows, COMPARISON))
    got = splits.assign_splits(tied, bucket_sets=20).toPandas()
    assert len(got) == 900 and got.comparisonId.is_unique and (got.groupby("root").split.nunique() == 1).all()
    share = got.split.value_counts(normalize=True)
    assert share["train"] == pytest.approx(0.7, abs=0.02) and share["validation"] == pytest.approx(0.2, abs=0.02)


def test_empty_comparisons(spark):
    assert splits.assign_splits(splits.tied_sets(spark.createDataFrame([], COMPARISON))).count() == 0


def test_latest_answers(spark):
    rows = [
        ("a", " X", "S", "left", 1, None), ("a", "x ", "S", " RIGHT", 2, None), ("a", "y", "S", "left", 1, None), ("a", "y", "S", None, 2, None), ("a", "z", "S", "cannot_judge", 1, None),
        ("a", "w", "S", "tie", 1, None), ("a", "w", "S", "tie", 1, None), (None, "w", "S", "tie", 1, None), ("a", None, "S", "tie", 1, None), ("a", "w", None, "tie", 1, None),
    ]
    got = {(r.annotator, r.k) for r in latest_answers(spark.createDataFrame(rows, ANSWER)).collect()}
    assert got == {("x", 1), ("w", 2)}


def made_up_answers(seed=3, items=300, people=20):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, items)
    accuracy = np.where(np.arange(people) < 4, 0.5, 0.88)
    rows = []
    for i in range(items):
        for j in rng.choice(people, 6, replace=False):
            hit = rng.random() < accuracy[j]
            rows.append((f"c{i}", f"ann{j:02d}", "S", ("left", "right")[truth[i] if hit else 1 - truth[i]], 1, None))
    return rows, truth, accuracy


def test_useless_annotators_and_consensus(spark):
    rows, truth, accuracy = made_up_answers()
    df = spark.createDataFrame(rows, ANSWER)
    people = {r.annotator: r.accuracy for r in consensus.reliability(df).collect()}
    assert {k for k, v in people.items() if v < consensus.USELESS_BELOW} == {f"ann{j:02d}" for j in range(4)}
    got = {r.comparisonId: r for r in consensus.consensus(df).collect()}
    hits = np.mean([got[f"c{i}"].choice == ("left", "right")[t] for i, t in enumerate(truth)])
    assert hits > 0.95
    votes = [r[3] for r in rows if r[0] == "c0"]
    n, k = len(votes), votes.count("left")
    assert got["c0"].agreement == pytest.approx((k * (k - 1) + (n - k) * (n - k - 1)) / (n * (n - 1)))


def test_large_items_and_joins_give_the_same(spark, monkeypatch):
    rows, _, _ = made_up_answers()
    df = spark.createDataFrame(rows, ANSWER)
    a = {r.annotator: r.accuracy for r in consensus.reliability(df).collect()}
    monkeypatch.setattr(consensus, "ROW_VOTES", 5)
    b = {r.annotator: r.accuracy for r in consensus.reliability(df).collect()}
    monkeypatch.setattr(consensus, "DRIVER_ANNOTATORS", 3)
    c = {r.annotator: r.accuracy for r in consensus.reliability(df).collect()}
    assert a == pytest.approx(b, abs=1e-9) and a == pytest.approx(c, abs=1e-9)


def test_no_answers(spark):
    assert consensus.reliability(spark.createDataFrame([], ANSWER)).count() == 0
    assert consensus.consensus(spark.createDataFrame([], ANSWER)).count() == 0


def test_ranking_recovers_strengths_from_uneven_counts(spark):
    rng = np.random.default_rng(5)
    strength = {f"m{i}": 1.5 - i * 0.5 for i in range(6)}
    counts = []
    for a in strength:
        for b in strength:
            if a == b:
                continue
            n = int(rng.integers(5, 400))
            z = np.exp([strength[a] + 0.3, strength[b], -0.5 + (strength[a] + 0.3 + strength[b]) / 2])
            w = rng.multinomial(n, z / z.sum())
            counts.append(("S", a, b, *map(int, w)))
    df = spark.createDataFrame(counts, "dimension string, first string, second string, wins long, losses long, draws long")
    got = ranking.ranking(df).orderBy("rank").collect()
    assert [r.method for r in got] == list(strength)
    assert got[0].first_effect == pytest.approx(0.3, abs=0.1) and got[0].draw_effect == pytest.approx(-0.5, abs=0.15)
    mean = np.mean(list(strength.values()))
    assert all(r.strength == pytest.approx(strength[r.method] - mean, abs=0.15) for r in got)


def test_outcomes_of_repeated_and_odd_comparisons(spark):
    p = [("a", "x", "S", "left", 1, None), ("a", "y", "S", "both_bad", 1, None), ("b", "x", "S", "left", 1, None), ("c", "x", "S", "right", 1, None)]
    c = spark.createDataFrame([("a", "m", "n"), ("a", "m", "n"), ("b", "m", "m"), ("c", None, "n")], "comparisonId string, leftMethod string, rightMethod string")
    got = [tuple(r) for r in ranking.outcome_counts(spark.createDataFrame(p, ANSWER), c).collect()]
    assert got == [("S", "m", "n", 1, 0, 1)]
    assert ranking.ranking(ranking.outcome_counts(spark.createDataFrame([], ANSWER), c)).count() == 0


def made_up_counts(items=4, seed=11):
    rng, rows = random.Random(seed), []
    for i in range(items):
        for j in range(items):
            if i != j and rng.random() < 0.8:
                rows.append(("S", f"m{i}", f"m{j}", rng.randrange(40), rng.randrange(30), rng.randrange(12)))
    return rows


def test_ranking_by_joins_is_that_of_newton(spark, monkeypatch):
    rows = made_up_counts()
    df = spark.createDataFrame(rows, "dimension string, first string, second string, wins long, losses long, draws long")
    want = {r.method: r for r in ranking.ranking(df).collect()}
    monkeypatch.setattr(ranking, "DENSE_ITEMS", 3)
    monkeypatch.setattr(ranking, "BLOCK", 3)
    got = {r.method: r for r in ranking.ranking(df).collect()}
    assert set(got) == set(want) and len(want) == 4
    for m, r in got.items():
        assert r.rank == want[m].rank and r.n_answers == want[m].n_answers
        for k in ("strength", "error", "first_effect", "draw_effect"):
            assert abs(r[k] - want[m][k]) < 1e-6, (m, k)


def test_newton_takes_many_pairs_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    n, pairs = 300, 60_000
    strength = rng.normal(0, 1, n)
    a = rng.integers(0, n, pairs)
    b = (a + rng.integers(1, n, pairs)) % n
    p = 1 / (1 + np.exp(-(strength[a] - strength[b])))
    wins = rng.binomial(20, p)
    tracemalloc.start()
    t, error, d, v = ranking.newton(a, b, np.column_stack([wins, 20 - wins, np.ones(pairs)]).astype(float), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and np.corrcoef(t, strength)[0, 1] > 0.99 and (error > 0).all()
