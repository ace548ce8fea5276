"""TF-IDF vectors in long form, retrieval, classification and near duplicates.

A vector is the rows (id, term, w) of its terms. Scores are equi-joins on the term with sums
combined before the shuffle, so documents that share no term never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuskit.functions.text import let
from corpuskit.operators.components import components, node_name
from corpuskit.operators.lineage import cut, salted_join


def term_counts(docs: DataFrame, doc_id: str, terms: Column) -> DataFrame:
    """(id, term, tf) over an array of terms; null and empty terms are left out."""
    return docs.select(F.col(doc_id).alias("id"), F.explode(terms).alias("term")).filter("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 2, max_ratio: float = 0.96, size: int = 30_000, rank_by: str = "importance") -> DataFrame:
    """(term, df, tf, idf, importance) of the terms kept: in at least ``min_df`` documents
    and at most ``max_ratio`` of them, the first ``size`` by importance, df or tf, ties by
    term. idf = ln((N + 1) / (df + 1)) + 1, importance = idf ln(1 + tf)."""
    return ranked_terms(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), n_docs, min_df, max_ratio, size, rank_by)


def ranked_terms(stats: DataFrame, n_docs: int, min_df: int = 2, max_ratio: float = 0.96, size: int = 30_000, rank_by: str = "importance") -> DataFrame:
    """The vocabulary of (term, df, tf)."""
    v = stats.filter((F.col("df") >= min_df) & (F.col("df") / max(n_docs, 1) <= max_ratio))
    v = v.withColumn("idf", F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1)) + 1)
    v = v.withColumn("importance", F.col("idf") * F.log1p("tf"))
    return v.orderBy(F.desc(rank_by), "term").limit(size)


def vectorise(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln tf) idf, unit length; documents without known terms have none."""
    w = counts.join(vocab.select("term", "idf"), "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def similarities(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, id, score): dot products of the vectors that share a term; terms of very many
    documents are spread over tasks."""
    q = queries.select(F.col("id").alias("query"), "term", F.col("w").alias("qw"))
    return salted_join(vectors, q, "term").groupBy("query", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def top_k(scores: DataFrame, k: int, by: list[str] = ("query",)) -> DataFrame:
    """The k best of each group with their rank, ties by id. Scores are compared as rounded
    to nine digits, as sums may differ in their last bits from run to run."""
    scores = scores.withColumn("score", F.round("score", 9))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, term, w): mean vector of each label's documents, unit length."""
    sizes = labels.groupBy("label").agg(F.countDistinct("id").alias("n"))
    return unit_centroids(vectors.join(labels, "id").groupBy("label", "term").agg(F.sum("w").alias("s")), sizes)


def unit_centroids(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from the sums (label, term, s) and the numbers (label, n) of documents."""
    sums = sums.join(F.broadcast(sizes), "label")
    mean = sums.select("label", "term", (F.col("s") / F.col("n")).alias("w"))
    norms = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return mean.join(F.broadcast(norms), "label").select("label", "term", (F.col("w") / F.col("norm")).alias("w"))


def centroid_scores(queries: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, label, score) of the labels that share a term with the query."""
    c = cents.select("label", "term", F.col("w").alias("cw"))
    return queries.join(c, "term").groupBy("id", "label").agg(F.sum(F.col("w") * F.col("cw")).alias("score"))


def knn_scores(scores: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(query, label, score): 0.65 of the best and 0.35 of the mean of the k best (fewer if
    there are no more) of a label; labels without a hit are missing and count as 0."""
    near = top_k(scores.join(labels, "id"), k, ["query", "label"])
    return near.groupBy("query", "label").agg((0.65 * F.max("score") + 0.35 * F.avg("score")).alias("score"))


def bm25(docs_terms: DataFrame, query_terms: DataFrame, n_docs: int, k1: float = 1.2, b: float = 0.7) -> DataFrame:
    """(query, id, score) by BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5))."""
    length = docs_terms.groupBy("id").agg(F.sum("tf").alias("len"))
    mean = length.agg(F.avg("len")).first()[0] or 1.0
    df = docs_terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    index = cut(docs_terms.join(idf, "term").join(length, "id").select("id", "term", weight.alias("w")))
    return salted_join(index, query_terms, "term").groupBy("query", "id").agg(F.sum("w").alias("score"))


def shingle_links(docs: DataFrame, doc_id: str, tokens: Column, n: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near duplicates by Jaccard similarity of word shingles: (id, key) of each text, one
    representative (key, copies, s) for each set of shingles, and the links (key, other,
    copies, other_copies) between representatives at or above the threshold.

    Exact: representatives meet on their prefix shingles, rarest first, of which any pair at
    or above the threshold shares one, and only if their sizes allow it; every meeting pair
    is verified on the full sets. Texts shorter than ``n`` words are one shingle; texts
    without words have no row.
    """
    # Bound once: inside the function over places the words would be found anew for each.
    grams = let(
        tokens,
        lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))).when(
            F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))
        ),
    )
    sets = docs.select(F.col(doc_id).alias("id"), F.array_sort(F.array_distinct(grams)).alias("s")).filter("s is not null")
    sets = cut(sets.withColumn("key", F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256)))
    # Numbered, as pairs of digests would be the most of what is shuffled.
    reps = cut(sets.groupBy("key").agg(F.count("*").alias("copies"), F.first("s").alias("s")).withColumn("rep", F.monotonically_increasing_id()))
    spread = reps.select("rep", F.size("s").alias("n"), F.explode("s").alias("g"))
    df = spread.groupBy("g").agg(F.count("*").alias("df"))
    # Sizes of arrays are guessed far too low; without the hint they would be broadcast.
    ranked = spread.join(df.hint("merge"), "g").filter("df > 1")
    # Shingles of one representative alone meet nobody but come first in the order.
    alone = F.col("n") - F.count("*").over(W.partitionBy("rep"))
    place = F.row_number().over(W.partitionBy("rep").orderBy("df", "g")) + alone
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).select("rep", "n", "g", "place")
    prefix = cut(prefix)
    other = prefix.select(F.col("rep").alias("other"), F.col("n").alias("m"), "g", F.col("place").alias("at"))
    meet = salted_join(prefix, other.hint("merge"), "g").filter((F.col("rep") < F.col("other")) & (F.least("n", "m") >= threshold * F.greatest("n", "m")))
    # Both have the shingles in one order, so after the last that they share in their prefixes
    # they share at most what is left of the shorter rest.
    met = meet.groupBy("rep", "other").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"), F.max("place").alias("place"), F.max("at").alias("at"))
    most = F.col("k") + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    pairs = met.filter(most >= threshold * (F.col("n") + F.col("m") - most) - 1e-9).select("rep", "other")
    a, b = reps.select("rep", "key", F.col("s").alias("a"), "copies"), reps.select(F.col("rep").alias("other"), F.col("key").alias("other_key"), F.col("s").alias("b"), F.col("copies").alias("other_copies"))
    both = F.size(F.array_intersect("a", "b"))
    links = pairs.join(a.hint("merge"), "rep").join(b.hint("merge"), "other").filter(both / (F.size("a") + F.size("b") - both) >= threshold).select("key", F.col("other_key").alias("other"), "copies", "other_copies")
    return sets.select("id", "key"), reps, cut(links)


def shingle_classes(docs: DataFrame, doc_id: str, tokens: Column, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_key, n_links): near-duplicate classes, the components of ``shingle_links``;
    ``n_links`` counts the documents at or above the threshold, copies included."""
    sets, reps, links = shingle_links(docs, doc_id, tokens, n, threshold)
    ends = links.select(node_name("k", F.col("key")).alias("x"), node_name("k", F.col("other")).alias("y"))
    roots = components(ends.select(F.array("x", "y").alias("keys"))).select(F.substring("node", 19, 64).alias("key"), F.substring("root", 19, 64).alias("root"))
    degree = links.select("key", F.col("other_copies").alias("n")).union(links.select("other", "copies")).groupBy("key").agg(F.sum("n").alias("linked"))
    known = reps.select("key", "copies").join(roots.hint("merge"), "key", "left").join(degree.hint("merge"), "key", "left")
    return sets.join(known.hint("merge"), "key").select("id", F.coalesce("root", "key").alias("class_key"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))


def without_near_matches(docs: DataFrame, doc_id: str, tokens: Column, held_out: Column, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id) of the held-out texts that no other text is similar to at the threshold; texts
    without words are similar to none. ``held_out`` is a condition on the id."""
    sets, _, links = shingle_links(docs, doc_id, tokens, n, threshold)
    held = docs.select(F.col(doc_id).alias("id")).filter(held_out).distinct()
    train = sets.filter(~held_out).select("key").distinct()
    near = links.select("key", "other").union(links.select("other", "key"))
    bad = train.union(near.join(train.select(F.col("key").alias("other")).hint("merge"), "other", "left_semi").select("key")).distinct()
    return held.join(sets.filter(held_out).join(bad.hint("merge"), "key", "left_semi").select("id").distinct().hint("merge"), "id", "left_anti")
