"""Queries that SQL cannot express or that run models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import features as X, models as M, pyops as P
from corpuskit.operators.lineage import read_table
from corpuskit.plans.relational import latest_posts
from corpuskit.sources.files import table_digest
from corpuskit.streaming import sessions as S


def _pairs(spark, d):
    c = read_table(spark, d, "comparisons").filter("comparisonId is not null")
    return c.select("comparisonId", "source", "leftText", "rightText").distinct()


def nfkc_search_key(spark, d):
    return latest_posts(spark, d).select("id", T.search_key(P.nfkc("content")).alias("key"))


def outside_quote_measures(spark, d):
    """Characters and stops outside nested quotations and quoted lines."""
    p = latest_posts(spark, d).filter("content is not null").select("id", P.outside_quotes("content").alias("t"))
    return p.select("id", X.filled(F.col("t")).alias("n_outside"), X.count(F.col("t"), "。").alias("periods_outside"))


def protected_missing(spark, d):
    """Protected values of the source that a side lacks, with multiplicity."""
    c = _pairs(spark, d).filter("source is not null")
    sides = c.select("comparisonId", "source", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("leftText").alias("t")), F.struct(F.lit("right").alias("side"), F.col("rightText").alias("t")))).alias("x"))
    sides = sides.select("comparisonId", "source", "x.side", "x.t").filter("t is not null")
    key = ["comparisonId", "side"]
    v = lambda col, n: sides.select(*key, F.explode(P.protected(col)).alias("v")).groupBy(*key, F.col("v.kind").alias("kind"), F.col("v.raw").alias("raw")).agg(F.count("*").alias(n))
    j = v("source", "a").join(v("t", "b"), [*key, "kind", "raw"], "left")
    return j.select(*key, "kind", "raw", (F.col("a") - F.coalesce("b", F.lit(0))).alias("missing")).filter("missing > 0")


def quantity_table(spark, d):
    q = latest_posts(spark, d).filter("content is not null").select("id", F.explode(P.quantities("content")).alias("q"))
    return q.groupBy("q.unit", "q.comparator").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_posts"))


def lcs_edits(spark, d):
    """Kinds of edits between the two sides of each comparison."""
    c = _pairs(spark, d).filter("leftText is not null and rightText is not null")
    e = c.select("comparisonId", F.explode(P.edits("leftText", "rightText")).alias("e"))
    return e.groupBy("comparisonId").agg(*[F.count(F.when(F.col("e.kind") == k, 1)).alias(f"n_{k}") for k in ("same", "replace", "remove", "insert")])


def indel_similarity(spark, d):
    c = _pairs(spark, d).filter("leftText is not null and rightText is not null")
    return c.select("comparisonId", F.round(P.indel_ratio("leftText", "rightText"), 6).alias("ratio")).distinct()


def levenshtein_distance(spark, d):
    c = _pairs(spark, d).filter("leftText is not null and rightText is not null")
    return c.select("comparisonId", F.levenshtein("leftText", "rightText").alias("distance")).distinct()


def dictionary_rewrite(spark, d):
    rules = [("だよな", "だろう"), ("んだが", "のだが"), ("んだよな", "のだろう"), ("らしい", "とのこと")]
    p = latest_posts(spark, d).filter("content is not null")
    return p.select("id", P.dictionary_once(rules)(F.col("content")).alias("rewritten"))


def novelty_classes(spark, d):
    """Outputs of both sides by how close they are to their source: known, adaptation or
    novel, by Dice of trigrams and of structures (against retrieved texts: novelty_retrieved)."""
    c = _pairs(spark, d).select("comparisonId", "source", F.explode(F.array("leftText", "rightText")).alias("out")).filter("source is not null and out is not null")
    a, b = T.dice(T.gram_set(F.col("source")), T.gram_set(F.col("out"))), T.dice(T.gram_set(T.structure(F.col("source"))), T.gram_set(T.structure(F.col("out"))))
    x = c.select(F.round(a, 6).alias("surface"), F.round(b, 6).alias("shape"))
    k = F.when(F.col("surface") > 0.95, "known").when((F.col("surface") > 0.72) | (F.col("shape") > 0.86), "adaptation").otherwise("novel")
    return x.groupBy(k.alias("novelty")).agg(F.count("*").alias("n"))


def kmeans_scan(spark, d):
    got = M.cluster_scan(read_table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame(got, "k int, silhouette double, spread double")


def pca_project(spark, d):
    e = read_table(spark, d, "embeddings")
    return M.projected(e, "vec_id", "embedding", 3)


def svd_project(spark, d):
    return M.truncated_svd(read_table(spark, d, "embeddings"), "vec_id", "embedding", 4).withColumn("value", F.round("value", 6))


def pareto_fronts(spark, d):
    """The first three fronts of parts by size and price."""
    from corpuskit.operators.ordered import fronts

    p = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return fronts(p, ["p_size", "p_retailprice"], 3).select("p_partkey", "front")


def mmr_select(spark, d):
    from corpuskit.plans.vectors import _emb_scores

    s = _emb_scores(spark, d, 40).select("query", "id", "score")
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    v = v.withColumn("vector", F.transform("embedding", lambda x: x.cast("double") / norm)).select("id", "vector")
    return M.mmr(s.join(v, "id"), 5)


def preference_weights(spark, d):
    """Weights of three text measures in who wins on the first dimension."""
    from corpuskit.plans.relational import latest_per_key

    a = latest_per_key(spark, d).filter("dimension = 'S' and choice in ('left', 'right')").groupBy("comparisonId").agg(F.avg((F.col("choice") == "left").cast("double")).alias("w")).filter("w <> 0.5")
    m = lambda c: F.array(F.log1p(F.length(c)), X.count(F.col(c), "[。！？]").cast("double"), X.count(F.col(c), "[0-9]+").cast("double"))
    p = _pairs(spark, d).filter("leftText is not null and rightText is not null").join(a, "comparisonId")
    p = p.select(F.zip_with(m("leftText"), m("rightText"), lambda x, y: x - y).alias("difference"), (F.col("w") > 0.5).alias("won"))
    w = M.preference_model(p).coefficients.toArray()
    return spark.createDataFrame([(n, float(x)) for n, x in zip(("log_length", "stops", "numbers"), w)], "feature string, weight double")


def bootstrap_interval(spark, d):
    c = _pairs(spark, d).filter("leftText is not null and rightText is not null").select("comparisonId", (F.length("leftText") - F.length("rightText")).alias("delta"))
    got = M.bootstrap_mean(c, "delta", rounds=5_000)
    return spark.createDataFrame([got] if got else [], "mean double, low double, high double")


def snapshot_manifest(spark, d):
    return spark.createDataFrame([(t, table_digest(read_table(spark, d, t))) for t in ("boards", "methods", "mix_targets")], "name string, digest string")


def session_windows(spark, d):
    e = read_table(spark, d, "events").filter("user_id is not null and ts is not null")
    return S.session_stream(e).select("user_id", "begin", "end", "n_events", F.round("total", 4).alias("total"))


def sliding_counts(spark, d):
    return S.windowed_counts(read_table(spark, d, "events").filter("ts is not null"))


QUERIES = {
    f.__name__: f
    for f in (
        nfkc_search_key, outside_quote_measures, protected_missing, quantity_table, lcs_edits, indel_similarity, levenshtein_distance, dictionary_rewrite, novelty_classes, kmeans_scan, pca_project, svd_project, pareto_fronts, mmr_select,
        preference_weights, bootstrap_interval, snapshot_manifest, session_windows, sliding_counts,
    )
}
ORACLE = {
    "pareto_fronts": "with p as (select p_partkey, p_size as a, p_retailprice as b from part), f0 as (select * from p x where not exists (select 1 from p y where y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))), r1 as (select * from p where p_partkey not in (select p_partkey from f0)), f1 as (select * from r1 x where not exists (select 1 from r1 y where y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))), r2 as (select * from r1 where p_partkey not in (select p_partkey from f1)), f2 as (select * from r2 x where not exists (select 1 from r2 y where y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))) select p_partkey, 0 as front from f0 union all select p_partkey, 1 from f1 union all select p_partkey, 2 from f2",
    "session_windows": "with e as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as b from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)), k as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as begin, max(ts) + interval 30 minute as \"end\", count(*) as n_events, round(sum(value), 4) as total from k group by user_id, k",
    "sliding_counts": "select b as begin, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 5 minute, ts), time_bucket(interval 5 minute, ts) - interval 5 minute]) as b from events where ts is not null) group by 1, 2",
}
