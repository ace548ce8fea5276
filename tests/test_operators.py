import math
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import components as C, features as X, models as M, ordered as O, pyops as P, vectors as V
from corpuskit.operators.lineage import attach_by_key


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("value", [None, "", "a", "ab", "日本語の文"])
def test_grams(spark, value):
    got = one(spark, T.grams(F.col("t"), 2), value)
    assert got == (None if value is None else [value[i : i + 2] for i in range(len(value) - 1)])


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.search_key(c), ">>12  Ａ  b　C") == "ａ b c"
    assert one(spark, T.presence_key(c), "あ、い。 (う)") == "あいう"
    assert one(spark, T.script_shape(c), "ひカ漢1Aｶ!") == "hkHDAq!"
    assert one(spark, T.structure(c), "漢字カナと12.5個") == "<TERM>と<NUM><TERM>"
    assert one(spark, T.narration(c), "a「bc」d「e」") == "ad「e」"
    assert one(spark, T.dialogue_share(c), "") == 0
    assert one(spark, T.with_stops(c), "あ\n\nい。") == "あ。\n\nい。"
    assert one(spark, T.reversed_lines(c), "1\n2\n3") == "3\n2\n1"
    assert one(spark, T.lines(c), "a\r\nb\n") == ["a", "b", ""]
    assert one(spark, T.page_text(c), "<style>x</style><p>a &amp;quot; b</p><br>c") == 'a " b\n\nc'
    assert one(spark, T.fragment_lines(c), "a &amp;lt; <b>b</b><br> <br>c") == ["a &lt; b", "c"]
    assert one(spark, T.elements(c, "strong"), "<strong>a</strong>x<strong>b</strong>") == ["a", "b"]
    assert one(spark, T.digit_reading(c), "よろ") == "46"
    assert one(spark, T.tags(c, T.INTENTS), "普通") == ["general"]
    assert one(spark, T.without_anchor_lines(c), ">>12\na") == "\na"


def test_dice(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abc"), ("abcd", "bcde")], "a string, b string")
    got = [r.x for r in df.select(T.dice(T.gram_set(F.col("a")), T.gram_set(F.col("b"))).alias("x")).collect()]
    assert got == [0.0, 1.0, 0.5]


def test_components_against_brute_force(spark):
    random.seed(3)
    rows = [[f"{random.randrange(10**6):06x}{k}" for k in random.sample(range(120), random.choice([1, 2, 2, 3]))] for _ in range(150)]
    rows = [[f"n{int(x[6:])}" for x in r] for r in rows] + [["hub", f"n{i}"] for i in range(0, 120, 7)] + [[]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        for x in r:
            parent[find(x)] = find(r[0])
    got = {r.node: r.root for r in C.components(spark.createDataFrame([(r,) for r in rows], "keys array<string>").repartition(7)).collect()}
    assert set(got) == set(parent)
    for a in parent:
        for b in ("hub", "n1", "n50"):
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_attach_by_key_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(30)] + [("a", 1), ("b", 2)], "k string, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_by_key(rows, table, "k", "n", hot_rows=10).select("k", "v", "n").collect()
    assert sorted(map(tuple, got)) == sorted([("hot", i, 30) for i in range(30)] + [("a", 1, 1), ("b", 2, 1)])


def test_tfidf_geometry(spark):
    docs = spark.createDataFrame([(0, "cats chase mice often"), (1, "cats chase mice daily"), (2, "trucks carry stones uphill"), (3, None), (4, "")], "id long, t string")
    counts = V.term_counts(docs, "id", T.words(F.col("t")))
    vectors = V.vectorise(counts, V.vocabulary(counts, 3, min_df=1, max_ratio=1.0))
    s = {(r["query"], r.id): r.score for r in V.similarities(vectors, vectors).collect()}
    assert s[0, 0] == pytest.approx(1, abs=1e-12) and s[0, 1] > 0.5 and (0, 2) not in s
    labels = spark.createDataFrame([(0, "animal"), (1, "animal"), (2, "vehicle")], "id long, label string")
    c = {(r.id, r.label): r.score for r in V.centroid_scores(vectors, V.centroids(vectors, labels)).collect()}
    assert c[0, "animal"] > c.get((0, "vehicle"), 0)


def test_shingle_classes_against_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choices("abcdefgh", k=40)) for _ in range(12)]
    texts = []
    for b in base:
        texts += [b, b, b + " z", " ".join(b.split()[2:] + ["q"])]
    texts += ["one two", "one two", "", None]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t or "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: (r.class_key, r.n_links) for r in V.shingle_classes(df, "id", T.words(F.col("t"))).collect()}
    assert set(got) == {i for i, s in enumerate(sets) if s}
    near = {i: [j for j in got if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in got}
    for i in got:
        assert got[i][1] == len(near[i])
        assert all(got[i][0] == got[j][0] for j in near[i])


def test_ordered(spark):
    rows = spark.createDataFrame([(i, "x" if i % 10 == 3 else None) for i in range(40)], "i int, v string").repartition(6)
    got = {r.i: r.rn for r in O.numbered(rows, ["i"]).collect()}
    assert got == {i: i + 1 for i in range(40)}
    filled = {r.i: r.t for r in O.forward_filled(rows.withColumn("v", F.when(F.col("v").isNotNull(), F.concat("v", "i"))), ["i"], F.col("v"), "t").collect()}
    assert filled[2] is None and filled[12] == "x3" and filled[39] == "x33"
    assert sorted(r.i for r in O.systematic(rows, ["i"], 7).collect()) == list(range(0, 40, 7))


def test_skyline(spark):
    random.seed(1)
    pts = [(i, random.randrange(30), random.randrange(30)) for i in range(200)] + [(500, None, 3)]
    got = {r.i for r in O.skyline(spark.createDataFrame(pts, "i int, a int, b int").repartition(9), ["a", "b"]).collect()}
    ok = [p for p in pts if p[1] is not None]
    assert got == {p[0] for p in ok if not any(q[1] >= p[1] and q[2] >= p[2] and q[1:] != p[1:] for q in ok)}


def test_average_rank(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 3, 2, 2, 2)], "v int")
    got = sorted((r.v, r.r) for r in X.average_rank(df, "v", "r").collect())
    assert got == [(1, 1), (2, 3), (2, 3), (2, 3), (3, 5.5), (3, 5.5)]


def test_constant_column_has_z_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r.v for r in X.winsorised_z(df, ["v"]).collect()] == [0, 0]


def test_protected_values():
    kinds = [x[0] for x in P.protected_spans("see http://a.b/c?d=1 and x@y.org >>12 Ver2 1100円")]
    assert kinds == ["identifier", "url", "identifier", "email", "anchor", "identifier", "quantity"]
    assert ("quantity", "1100円") in [x[:2] for x in P.protected_spans("1100円")]
    assert P.protected_spans("") == []


def test_quantities():
    q = P.quantities_of("10〜20個以上、-3.50kg")
    assert q[0][6] == "range" and q[1][7] == 0 and q[2][4:6] == ("20", "個")
    assert q[3][3:6] == ("-", "3.50", "kg")


def test_dictionary_never_rescans(spark):
    f = P.dictionary_once([("a", "b"), ("b", "a"), ("ab", "X")])
    got = [r.x for r in spark.createDataFrame([("あabあ「ab」",), (None,), ("",)], "t string").select(f(F.col("t")).alias("x")).collect()]
    # Latin words are identifiers and so protected.
    assert got == ["あabあ「ab」", None, ""]
    g = P.dictionary_once([("あ", "い"), ("い", "あ"), ("あい", "う")])
    assert spark.createDataFrame([("あいいあ「あ」",)], "t string").select(g(F.col("t")).alias("x")).first().x == "うあい「あ」"


def test_edits_rebuild_both_sides():
    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choices("ab c.", k=random.randrange(12))) for _ in range(2))
        e = P.edits_of(a, b)
        assert "".join(x[1] for x in e) == a and "".join(x[2] for x in e) == b
        assert all(x[1] == x[2] for x in e if x[0] == "same")


def test_outside_quotes_keeps_offsets():
    t = "a「b『c』d」e\n> q\nf"
    got = P._outside_quotes(t)
    assert len(got) == len(t) and got.split() == ["a", "e", "f"]


def test_silhouette_and_bootstrap(spark):
    import numpy as np

    pts = np.array([[0.0, 0], [0, 1], [10, 10], [10, 11]])
    assert M.euclidean_silhouette(pts, np.array([0, 0, 1, 1])) > 0.9
    mean, low, high = M.bootstrap_mean(spark.createDataFrame([(float(i % 5),) for i in range(200)], "x double"), "x", rounds=100)
    assert mean == 2.0 and low < 2 < high
    assert M.bootstrap_mean(spark.createDataFrame([], "x double"), "x") is None


def test_mmr_avoids_repeats(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])]
    got = M.mmr(spark.createDataFrame(rows, "query long, id long, score double, vector array<double>"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]


def test_preference_model_is_symmetric(spark):
    rows = [([1.0, 0.0], True), ([-1.0, 0.2], False), ([2.0, -0.1], True), ([0.5, 0.3], True)] * 5
    w = M.preference_model(spark.createDataFrame(rows, "difference array<double>, won boolean")).coefficients
    assert w[0] > 0 and not math.isnan(w[1])


def test_closure(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(50, 20), (60, 61), (61, 60), (7, None)]
    edges = [e for e in edges if e[1] is not None]
    got = {r.node: r.root for r in O.closure(spark.createDataFrame(edges, "node int, head int"), rounds=8).collect()}
    assert got == {**{i: 20 for i in range(1, 20)}, 50: 20}


def test_truncated_svd_is_that_of_the_matrix(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(30, 5)) * [5, 3, 1, 1, 1]
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "k long, x array<double>").repartition(3)
    got = {(r.key, r.component): r.value for r in M.truncated_svd(rows, "k", "x", 2).collect()}
    v = np.linalg.svd(x)[2][:2].T
    y = x @ v
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for j in range(2):
        mine = np.array([got[i, j] for i in range(30)])
        assert min(np.abs(mine - y[:, j]).max(), np.abs(mine + y[:, j]).max()) < 1e-9


def test_cluster_scan_and_bootstrap_are_registered_whole(spark, data, monkeypatch):
    import inspect

    from corpuskit.operators import models
    from corpuskit.plans import advanced

    asked = {}

    def record(name):
        of = inspect.signature(getattr(models, name))

        def call(*a, **k):
            b = of.bind(*a, **k)
            b.apply_defaults()
            asked[name] = b.arguments

        return call

    for name in ("cluster_scan", "bootstrap_mean"):
        monkeypatch.setattr(models, name, record(name))
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: None)
    advanced.kmeans_scan(spark, data)
    advanced.bootstrap_interval(spark, data)
    assert [*asked["cluster_scan"]["ks"]] == [2, 3, 4, 5, 6, 7, 8] and len(asked["cluster_scan"]["seeds"]) == 3 and asked["cluster_scan"]["starts"] == 10
    assert asked["bootstrap_mean"]["rounds"] == 5_000


def test_cluster_scan_keeps_the_cheapest_start(spark):
    from corpuskit.operators import models

    x = spark.createDataFrame([([float(10 * (i % 3)), float(i // 3)],) for i in range(12)], "x array<double>")
    (k, silhouette, spread), = models.cluster_scan(x, "x", ks=[3], seeds=(1,), starts=4)
    assert k == 3 and silhouette > 0.7 and spread == 0
