"""Best matches are found without a row for each pair, and are those of SQL in blocks of any size."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import plain

from corpuskit.operators import scoring as S, vectors as V
from corpuskit.plans import oracle, registry, retrieval

NAMES = ["tfidf_topk_search", "knn_classify", "blended_rank", "nn_length_matched", "bm25_search", "hybrid_retrieval", "novelty_retrieved"]


@pytest.mark.parametrize("name", NAMES)
def test_no_row_for_each_pair(spark, data, monkeypatch, name):
    def pairs(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(V, "similarities", pairs)
    monkeypatch.setattr(V, "bm25", pairs)
    monkeypatch.setattr(retrieval, "salted_join", pairs, raising=False)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "CELLS", 900)
    monkeypatch.setattr(S, "PRODUCTS", 500)
    df = registry.QUERIES[name](spark, data)
    order = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    r = c.execute(oracle.ORACLE[name])
    names = [x[0] for x in r.description]
    assert ours == sorted(tuple(plain(x[names.index(k)]) for k in order) for x in r.fetchall())


def test_rows_of_one_id_are_one_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "b"), (3, "")], "doc_id long, text string")
    texts, rows = S.whole(docs, "doc_id", F.split("text", " "), F.col("text").alias("t"))
    assert {r.id: sorted(r.words) for r in texts.collect()} == {1: ["a", "b", "b", "c"], 2: ["b"], 3: [""]}
    assert sorted((r.id, r.t, len(r.words)) for r in rows.collect()) == [(1, "a b", 4), (1, "b c", 4), (2, "b", 1), (3, "", 1)]


@pytest.mark.parametrize("name", ["near_dup_classes", "leak_anti_join"])
def test_no_broadcast_of_shingles(spark, data, monkeypatch, name):
    stored, plans = V.cut, []

    def watched(df):
        out = stored(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(V, "cut", watched)
    registry.QUERIES[name](spark, data).collect()
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_links_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    texts = []
    for i in range(120):
        base = texts[rng.randrange(len(texts))].split() if texts and i % 3 else [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))]
        texts.append(" ".join(w for w in base if rng.random() > 0.06) or "x")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in map(str.split, texts)]
    for threshold in (0.5, 0.85 / 1.15, 0.8):
        want = {(i, j) for i in range(120) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        ids, _, links = V.shingle_links(docs, "id", F.split("t", " "), n=2, threshold=threshold)
        of = {}
        for r in ids.collect():
            of.setdefault(r.key, []).append(r.id)
        got = {(max(i, j), min(i, j)) for r in links.collect() for i in of[r.key] for j in of[r.other]}
        assert got == want


def test_starts_come_in_blocks(spark, data, monkeypatch):
    whole = sorted(tuple(r) for r in registry.QUERIES["containment_links"](spark, data).collect())
    monkeypatch.setattr(retrieval, "START_BLOCK", 10)
    df = registry.QUERIES["containment_links"](spark, data)
    assert sorted(tuple(r) for r in df.collect()) == whole
    assert "BroadcastHashJoin LeftSemi" in df._jdf.queryExecution().executedPlan().toString() or "LeftSemi, BuildRight" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("caps", [(1_800, 800, 700), (3, 2, 4), (40, 1, 1), (1, 1, 90)])
def test_unions_are_counted_without_pairs(spark, data, monkeypatch, caps):
    def pairs(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(V, "similarities", pairs)
    monkeypatch.setattr(S, "QUERY_BLOCK", 1)
    monkeypatch.setattr(S, "CELLS", 30)
    monkeypatch.setattr(S, "PRODUCTS", 50)
    monkeypatch.setattr(S, "SCORE_BINS", 16)
    ours = sorted(tuple(r) for r in registry.QUERIES["candidate_union"](spark, data, *caps).select("query", "n_candidates").collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    sql = oracle.ORACLE["candidate_union"]
    for name, ours_n in zip(("1800", "800", "700"), caps):
        assert sql.count(f"rn <= {name}") == 1
        sql = sql.replace(f"rn <= {name}", f"rn <= {ours_n}")
    assert ours == sorted(c.execute(f"select query, n_candidates from ({sql})").fetchall())
