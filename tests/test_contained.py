"""Texts found in other texts against brute force, and that sources that begin alike do not meet every post."""

import random

from pyspark.sql import functions as F

from corpuskit.operators import contained as C
from corpuskit.plans import retrieval


def test_holders_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aaab𝒳語") for _ in range(n))
    posts = [(f"{i:03}", word(rng.randrange(6, 120))) for i in range(150)] + [("zz", "a" * 400), ("é", "語" * 70)]
    sources = sorted({word(rng.randrange(6, 9)) for _ in range(60)} | {t[a : a + rng.randrange(6, 60)] for _, t in posts for a in (0, 7)} | {"a" * n for n in range(6, 60)})
    sources = [s for s in sources if len(s) >= 6]
    want = {s: [i for i in sorted(i for i, t in posts if s in t)][:4] for s in sources}
    monkeypatch.setattr(C, "CHARS", 500)
    monkeypatch.setattr(C, "WINDOWS", 40)
    monkeypatch.setattr(C, "HELD", 20)
    prints = C.fingerprints(spark.createDataFrame([(s,) for s in sources], "s string")).toArrow()
    found = C.holders(spark.createDataFrame(posts, "id string, content string").repartition(3), prints, 4).groupBy("text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    got = {r.text: r.ids for r in found.collect()}
    assert set(got) == {s for s in want if want[s]}
    assert all(got[s][:4] == want[s] for s in got)


def test_sources_that_begin_alike(spark, tmp_path):
    """4,000 sources with one beginning and 2,000 posts that have it too were joined to 8,000,000 rows."""
    sources = [f"once upon a time, and then {i}." for i in range(4_000)]
    posts = [(f"p{i:05}", f"So: once upon a time, and then {i % 500}. The end.") for i in range(2_000)]
    spark.createDataFrame([(s,) for s in sources], "source string").write.parquet(f"{tmp_path}/comparisons.parquet")
    spark.createDataFrame(posts, "id string, content string").select("id", F.lit(None).cast("timestamp").alias("ingestedAt"), F.lit("b").alias("board"), "content").write.parquet(f"{tmp_path}/posts.parquet")
    df = retrieval.containment_links(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 500 * 4
    assert most_rows(df._jdf.queryExecution().executedPlan()) < 20_000


def most_rows(plan) -> int:
    """The most rows that an operator of an executed plan gave out."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return most_rows(plan.plan())
    own = plan.metrics().get("numOutputRows")
    children = plan.children()
    return max([own.get().value() if own.isDefined() else 0, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_repeats_that_leave_a_task_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "WINDOWS", 4)
    monkeypatch.setattr(C, "HELD", 1)
    spark.createDataFrame([("aaaaaa",), ("aaaaaaaa",), ("bbbbbbb",)], "source string").write.parquet(f"{tmp_path}/comparisons.parquet")
    spark.createDataFrame([("p", "a" * 50 + "b" * 50)], "id string, content string").select("id", F.lit(None).cast("timestamp").alias("ingestedAt"), F.lit("b").alias("board"), "content").write.parquet(f"{tmp_path}/posts.parquet")
    assert sorted((r.id, r.rn) for r in retrieval.containment_links(spark, str(tmp_path)).collect()) == [("p", 1)] * 3
