"""Ties of alike texts against brute force, the bound itself, and that no row is made for each pair."""

import hashlib
import random

import pytest

from corpuskit.operators import alike as A
from corpuskit.plans import styles


def grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)} or {t}


def frame(spark, texts):
    return spark.createDataFrame([(hashlib.md5(t.encode()).digest(), t) for t in texts], "key binary, text string").repartition(3)


def classes(texts, pairs):
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for t in texts:
        out.setdefault(find(t), set()).add(t)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("sizes", [(2_500_000, 500_000, 2_000_000), (900, 300, 50)])
def test_ties_against_brute_force(spark, monkeypatch, sizes):
    rng = random.Random(8)
    texts = ["a", "b", "ab", "abc", "𝒳語", "𝒳語の", "a" * 30, "a" * 400, "ab" * 40]
    while len(texts) < 260:
        t = list(rng.choice(texts) if rng.random() < 0.7 else "".join(rng.choice("abcd語𝒳") for _ in range(rng.randrange(1, 60))))
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcd語𝒳")
        texts.append("".join(t))
    texts = sorted(set(texts))
    alike = {(a, b) for a in texts for b in texts if a < b and 2.0 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))) >= 0.85}
    for name, n in zip(("BLOCK", "SIGNS", "PAIRS"), sizes):
        monkeypatch.setattr(A, name, n)
    by_key = {hashlib.md5(t.encode()).digest(): t for t in texts}
    got = [(by_key[bytes(r.key)], by_key[bytes(r.other)]) for r in A.ties(frame(spark, texts), 0.85).collect()]
    assert {tuple(sorted(p)) for p in got} <= alike
    assert classes(texts, got) == classes(texts, alike)


def test_ties_are_fewer_than_pairs(spark):
    """400 texts of which all 79,800 pairs are alike."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house"
    texts = [f"{base}{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    links = A.ties(frame(spark, texts), 0.85)
    assert 399 <= links.count() < 4 * 400


def test_the_bound_itself_is_alike(spark, tmp_path):
    """17 of 20 trigrams each: 34 / 40 is 0.85, though 17 / 23 is below 0.85 / 1.15 in floating point."""
    a, b = "abcdefghijklmnopqrstuv", "abcdefghijklmnopqrs123"
    assert 2.0 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))) == 0.85
    rows = [("c1", "g1", "p1", "f1", a), ("c2", "g2", "p2", "f2", b), ("c3", "g3", "p3", "f3", "something else"), ("c4", None, None, None, "。"), ("c5", None, None, None, None), ("c6", None, None, None, "。")]
    spark.createDataFrame(rows, "comparisonId string, group string, postId string, family string, source string").write.parquet(f"{tmp_path}/comparisons.parquet")
    got = {r.comparisonId: (r.least, r.size) for r in styles.dice_split_components(spark, str(tmp_path)).collect()}
    assert got == {"c1": ("c1", 2), "c2": ("c1", 2), "c3": ("c3", 1), "c4": ("c4", 1), "c5": ("c5", 1), "c6": ("c6", 1)}


def test_no_texts(spark):
    assert A.ties(spark.createDataFrame([], "key binary, text string"), 0.85).count() == 0
