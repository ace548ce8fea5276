import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import features as X, lineage, models, ordered as O, pyops as P, vectors as V


def test_salted_join_is_a_join(spark, monkeypatch):
    rng = random.Random(2)
    many = [(rng.choice("aaaaaab") if i % 2 else rng.choice("cde"), i) for i in range(300)] + [(None, 1)]
    other = [(rng.choice("abcf"), i) for i in range(20)]
    a, b = spark.createDataFrame(many, "k string, x int"), spark.createDataFrame(other, "k string, y int")
    want = sorted(tuple(r) for r in a.join(b, "k").select("k", "x", "y").collect())
    for hot in (1, 40, 10_000):
        assert sorted(tuple(r) for r in lineage.salted_join(a, b, "k", hot_rows=hot).select("k", "x", "y").collect()) == want


def test_hot_terms_do_not_change_scores(spark, monkeypatch):
    v = spark.createDataFrame([(i, t, 1.0 + i) for i in range(30) for t in ("all", f"t{i % 3}")], "id long, term string, w double")
    q = v.filter("id % 10 = 0")
    want = sorted(tuple(r) for r in V.similarities(q, v).collect())
    plain = lineage.salted_join
    monkeypatch.setattr(V, "salted_join", lambda many, other, key: plain(many, other, key, hot_rows=4))
    assert sorted(tuple(r) for r in V.similarities(q, v).collect()) == want


def test_quantiles_are_those_of_numpy(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.choice([1, 2, 2, 3, 10, 77]) + rng.randrange(3))) for g in ("a", "b", "c") for _ in range(rng.randrange(1, 60))] + [("a", None), ("d", None), (None, 4.0)]
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [r[f"q_{i}"] for i in range(len(shares))] for r in X.quantiles(df, ["g"], "v", shares).collect()}
    # A group is joined with its own size, so a null is none.
    assert set(got) == {"a", "b", "c"}
    for g, q in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert q == pytest.approx(list(np.quantile(own, shares)))
    low = {r.g: r.q_0 for r in X.quantiles(df, ["g"], "v", [0.95], discrete=True).collect()}
    own = sorted(v for k, v in rows if k == "b")
    assert low["b"] == own[int(np.ceil(0.95 * len(own))) - 1]
    assert X.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_longest_common_subsequence_by_bits():
    rng = random.Random(1)
    for _ in range(200):
        x, y = ("".join(rng.choice("ab漢🙂") for _ in range(rng.randrange(12))) for _ in range(2))
        assert P.lcs_length(x, y) == len(P.lcs_pairs(list(x), list(y)))
    assert P.lcs_length("ab" * 10_000, "ba" * 10_000) == 19_999


def test_outside_quotes_by_signs():
    def slow(text):
        out, stack = [], []
        for line in text.split("\n"):
            quoted = line.lstrip()[:1] in (">", "＞") and line.lstrip() != ""
            for c in line:
                inside = bool(stack) or quoted
                if c in "「『":
                    stack.append({"「": "」", "『": "』"}[c])
                    inside = True
                elif stack and c == stack[-1]:
                    stack.pop()
                out.append(" " if inside else c)
            out.append("\n")
        return "".join(out)[:-1]

    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("「」『』>＞ a。\n") for _ in range(rng.randrange(25)))
        assert P._outside_quotes(t) == slow(t), t


def test_skyline_of_three_keys(spark):
    rng = random.Random(8)
    rows = [tuple(rng.randrange(8) for _ in range(3)) for _ in range(600)]
    got = {tuple(r) for r in O.skyline(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"]).collect()}
    beats = lambda q, p: all(x >= y for x, y in zip(q, p)) and q != p
    assert got == {p for p in rows if not any(beats(q, p) for q in rows)}


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3.0, 2.0, 400)
    mean, low, high = models.bootstrap_mean(spark.createDataFrame([(float(v),) for v in x], "delta double"), "delta", rounds=2_000)
    error = x.std() / 20
    assert mean == pytest.approx(x.mean()) and low == pytest.approx(x.mean() - 1.96 * error, abs=0.06) and high == pytest.approx(x.mean() + 1.96 * error, abs=0.06)


def test_digit_readings(spark):
    words = ["ヨロ", "いくぜ", "これ", "むしょ", "あ", "あいう", "ひーふ", "つごみ", None, ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.digit_reading(F.col("w"))).collect()]
    assert got == ["46", "190", None, "64", None, None, "12", "253", None, None]


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())
