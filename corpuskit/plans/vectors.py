"""Queries of vectors, retrieval, classification and near duplicates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from corpuskit.functions import text as T
from corpuskit.operators import scoring as S, vectors as V
from corpuskit.operators.lineage import cut, read_table


#: Terms that the registered queries keep; an option of the vocabulary, whose default is 30,000.
VOCABULARY = 50_000


def _counts(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang").filter("text is not null")
    return docs, cut(V.term_counts(docs, "doc_id", T.words(F.col("text"))))


def _model(spark, d):
    docs, counts = _counts(spark, d)
    vocab = cut(V.vocabulary(counts, docs.count(), size=VOCABULARY))
    return docs, counts, vocab, cut(V.vectorise(counts, vocab))


def _queries(vectors):
    """Every document whose id is divisible by 50."""
    return vectors.filter("id % 50 = 0")


def tfidf_vocab(spark, d):
    docs, counts = _counts(spark, d)
    return V.vocabulary(counts, docs.count(), size=VOCABULARY).select("term", "df", "tf", F.round("idf", 6).alias("idf"), F.round("importance", 5).alias("importance"))


def _texts(spark, d, *more):
    """The documents with a text, (id, words) by id, and (id, words, more) by row."""
    docs = read_table(spark, d, "documents").filter("text is not null")
    return docs, *S.whole(docs, "doc_id", T.words(F.col("text")), *more)


def _vocabulary(docs, texts):
    """The terms kept and their idf, on the driver."""
    kept = V.ranked_terms(S.term_stats(texts), docs.count(), size=VOCABULARY).select("term", "idf").collect()
    return [r.term for r in kept], np.array([r.idf for r in kept], np.float64)


def _nearest(texts, among, known, k, change=None, group=None, queries=None):
    """The k nearest by cosine of every 50th document ``among`` rows, or of each ``group``."""
    parts = [S.best(among, S.cosine_block(held, *known), S.cosine_weights, k, change, group) for held in S.blocks(_queries(texts if queries is None else queries))]
    return V.top_k(S.union(parts, texts.sparkSession.createDataFrame([], S.MATCH)), k, ["query", "label"] if group else ["query"])


def tfidf_topk_search(spark, d):
    docs, texts, _ = _texts(spark, d)
    return _nearest(texts, texts, _vocabulary(docs, texts), 5).select("query", "id", F.round("score", 5).alias("score"))


def centroid_classify(spark, d):
    docs, _, _, vectors = _model(spark, d)
    labels = docs.filter("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    s = V.centroid_scores(vectors, V.centroids(vectors, labels)).withColumn("score", F.round("score", 6))
    best = s.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "label"))).filter("rn = 1")
    return best.join(labels.withColumnRenamed("label", "own"), "id").groupBy("own", "label").agg(F.count("*").alias("n"))


def _knn(near):
    """(query, label, score): 0.65 of the best and 0.35 of the mean of the three best."""
    return near.groupBy("query", "label").agg((0.65 * F.max("score") + 0.35 * F.avg("score")).alias("score"))


def knn_classify(spark, d):
    docs, texts, rows = _texts(spark, d, F.col("lang").alias("label"))
    near = _nearest(texts, rows.filter("label is not null"), _vocabulary(docs, texts), 3, group="label")
    return _knn(near).select("query", "label", F.round("score", 5).alias("score"))


def blended_rank(spark, d):
    """Rank of each document's own language by 0.35 centroid and 0.65 nearest neighbours."""
    docs, texts, rows = _texts(spark, d, F.col("lang").alias("label"))
    known, among = _vocabulary(docs, texts), rows.filter("label is not null")
    knn = _knn(_nearest(texts, among, known, 3, group="label")).withColumnRenamed("score", "knn")
    sums = S.label_sums(among, *known)
    sizes = docs.filter("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.countDistinct("doc_id").alias("n"))
    cents = cut(V.unit_centroids(sums, sizes))
    cen = V.centroid_scores(S.unit_vectors(_queries(texts), *known), cents).select(F.col("id").alias("query"), "label", F.col("score").alias("cen"))
    both = cen.join(knn, ["query", "label"], "full").select("query", "label", F.round(0.35 * F.coalesce("cen", F.lit(0.0)) + 0.65 * F.coalesce("knn", F.lit(0.0)), 6).alias("score"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "label")))
    own = _queries(docs.filter("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))).withColumnRenamed("id", "query")
    return ranked.join(own, ["query", "label"]).select("query", "label", "rank", F.round("score", 5).alias("score"))


def nn_length_matched(spark, d):
    """Nearest neighbour among documents of half to double the length."""
    docs, texts, rows = _texts(spark, d, F.length("text").alias("n"))

    def change(block, batch, at, scores, _):
        n = batch.column("n").to_numpy(zero_copy_only=False)[at][:, None].astype(np.int64)
        return np.where((2 * n >= block["n"]) & (n <= 2 * block["n"]), scores, 0.0)

    return _nearest(texts, rows, _vocabulary(docs, texts), 1, change, queries=rows).select("query", "id", F.round("score", 5).alias("score"))


def bm25_search(spark, d):
    docs, texts, _ = _texts(spark, d)
    stats, n = cut(S.term_stats(texts)), docs.count()
    total, filled = stats.agg(F.sum("tf")).first()[0], texts.filter("size(words) > 0").count()
    parts = []
    for held in S.blocks(_queries(texts)):
        asked = spark.createDataFrame([(t,) for t in sorted({w for r in held for w in r["words"]})], "term string")
        idf = {r.term: r.idf for r in stats.join(asked, "term").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).collect()}
        parts.append(S.best(texts, S.bm25_block(held, idf, (total or 0) / (filled or 1) or 1.0), S.bm25_weights, 3))
    return V.top_k(S.union(parts, spark.createDataFrame([], S.MATCH)), 3).select("query", "id", F.round("score", 4).alias("score"))


def near_dup_classes(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    c = V.shingle_classes(docs, "doc_id", T.words(F.col("text")))
    # The class is named by its least document.
    least = c.groupBy("class_key").agg(F.min("id").alias("class_id"))
    return c.join(least, "class_key").select(F.col("id").alias("doc_id"), "class_id", "n_links")


def leak_anti_join(spark, d):
    """Held-out documents (id divisible by 10) that no other one is nearly the same as."""
    docs = read_table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    return V.without_near_matches(docs, "doc_id", T.words(F.col("text")), F.col("id") % 10 == 0).select(F.col("id").alias("doc_id"))


def ngram_lm_score(spark, d):
    """Mean log likelihood of each text's trigrams under the add-one model of all texts."""
    p = read_table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(T.marked_grams(F.col("text"), 3)).alias("g"))
    grams = p.groupBy("doc_id", "g").agg(F.count("*").alias("k"))
    grams = cut(grams)
    model = grams.filter(~F.col("g").rlike("^[一-龠々]+$")).groupBy("g").agg(F.sum("k").alias("c"))
    model = cut(model)
    total, vocab = model.agg(F.sum("c"), F.count("*")).first()
    s = grams.join(model, "g", "left").withColumn("s", F.col("k") * (F.log(F.coalesce("c", F.lit(0)) + 1.0) - F.log(F.lit(float((total or 0) + vocab) or 1.0))))
    return s.groupBy("doc_id").agg(F.round(F.sum("s") / F.sum("k"), 5).alias("score"))


def char_ngram_model(spark, d):
    """The hundred commonest grams of sizes 3 and 4, with the totals before the cut."""
    p = read_table(spark, d, "posts").filter("content is not null").select("content")
    g = p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("size"), T.marked_grams(F.col("content"), n).alias("gs")) for n in (3, 4)])).alias("x")).select("x.size", F.explode("x.gs").alias("gram"))
    g = g.filter(~F.col("gram").rlike("^[一-龠々]+$")).groupBy("size", "gram").agg(F.count("*").alias("n"))
    g = cut(g)
    totals = g.groupBy("size").agg(F.sum("n").alias("total"), F.count("*").alias("vocabulary"))
    top = g.withColumn("rn", F.row_number().over(W.partitionBy("size").orderBy(F.desc("n"), "gram"))).filter("rn <= 100")
    return top.join(F.broadcast(totals), "size").select("size", "gram", "n", "total", "vocabulary")


def _unit(c):
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / norm)


def _emb_scores(spark, d, k):
    """Cosines of the query vectors with all vectors; the queries are the ids divisible by
    50, taken in blocks, so a task holds one block of queries and streams all vectors."""
    import pyarrow as pa

    e = read_table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    queries = e.filter("vec_id % 50 = 0").orderBy("vec_id")
    n_dims = e.select(F.size("embedding")).first()
    if n_dims is None:
        return spark.createDataFrame([], "query long, id long, score double, query_label int, label int, rank int")
    # Query blocks of at most 64 MB are broadcast one after the other.
    block = max(1, 64_000_000 // (8 * n_dims[0]))
    rows = queries.select("vec_id", "embedding", "label").toLocalIterator()
    parts, held = [], []

    def search(held):
        ids = np.array([r.vec_id for r in held])
        labels = [r.label for r in held]
        q = np.array([r.embedding for r in held], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, labels, q))

        def run(batches):
            qi, ql, qm = shared.value
            best = [[] for _ in qi]
            for b in batches:
                m = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(len(b), -1)
                if not len(m):
                    continue
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                own, lab = b.column(0).to_numpy(), b.column(2).to_pylist()
                s = np.round(qm @ m.T, 9)
                most = min(k + 1, s.shape[1])
                # All that reach the score of the last place, so that ties are broken by id.
                floor = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                for i in range(len(qi)):
                    at = np.flatnonzero(s[i] >= floor[i])
                    at = at[np.lexsort((own[at], -s[i][at]))][: k + 1]
                    best[i] = sorted(best[i] + [(-s[i][j], int(own[j]), lab[j]) for j in at if own[j] != qi[i]])[:k]
            out = [(int(qi[i]), x[1], -x[0], ql[i], x[2]) for i in range(len(qi)) for x in best[i]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["query", "id", "score", "query_label", "label"])

        # Stored before the next block, so that neither the driver nor a task holds two.
        found = cut(e.mapInArrow(run, "query long, id long, score double, query_label int, label int"))
        shared.destroy()
        return found

    for r in rows:
        held.append(r)
        if len(held) == block:
            parts.append(search(held))
            held = []
    if held:
        parts.append(search(held))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return V.top_k(out, k)


def emb_topk_cosine(spark, d):
    return _emb_scores(spark, d, 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


def emb_mrr_label(spark, d):
    """Mean reciprocal rank of the first of ten neighbours with the query's label."""
    s = _emb_scores(spark, d, 10)
    first = s.groupBy("query").agg(F.min(F.when(F.col("label") == F.col("query_label"), F.col("rank"))).alias("r"))
    return first.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


_TF = r"with c as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as term from documents where text is not null) group by 1, 2), nd as (select count(*) as n from documents where text is not null), "
_VOC = _TF + "v as (select term, df, tf, ln((n + 1.0) / (df + 1)) + 1 as idf, (ln((n + 1.0) / (df + 1)) + 1) * ln(1 + tf) as importance from (select term, count(*) as df, sum(tf) as tf from c group by term), nd where df >= 2 and df / n::double <= 0.96 order by importance desc, term limit 50000) "
_VEC = _VOC + ", w as (select id, c.term, (1 + ln(c.tf)) * idf as w from c join v on c.term = v.term), vec as (select w.id, term, w / norm as w from w join (select id, sqrt(sum(w * w)) as norm from w group by id) n on w.id = n.id), "
_SIM = _VEC + "s as (select q.id as query, v.id as id, round(sum(q.w * v.w), 9) as score from vec q join vec v on q.term = v.term where q.id % 50 = 0 and q.id <> v.id group by 1, 2) "
_LAB = ", l as (select doc_id as id, lang as label from documents where lang is not null and text is not null) "
_CEN = ", cs as (select label, term, sum(w) / max(n) as w from vec join l using (id) join (select label as lb, count(*) as n from l group by 1) z on z.lb = l.label group by 1, 2), cen as (select cs.label, term, w / norm as w from cs join (select label, sqrt(sum(w * w)) as norm from cs group by 1) z on z.label = cs.label) "
_KNN = ", kn as (select query, label, 0.65 * max(score) + 0.35 * avg(score) as score from (select s.*, label, row_number() over (partition by query, label order by score desc, s.id) as rn from s join l on l.id = s.id) where rn <= 3 group by 1, 2) "
_KEY = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), 'ς', 'σ'), '(?:>>|＞＞)[ \\t\\n\\r]*[0-9]+', ' ', 'g'), '(?:>>|＞＞)[ \\t\\n\\r]*[a-zぁ-んァ-ヶ一-龠々ー]{{1,20}}( |\\t|\\n|\\r|$)', ' \\1', 'g'), '[\\t-\\r \\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), ' ', '', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        tfidf_vocab, tfidf_topk_search, centroid_classify, knn_classify, blended_rank, nn_length_matched, bm25_search, near_dup_classes, leak_anti_join, ngram_lm_score, char_ngram_model, emb_topk_cosine, emb_mrr_label,
    )
}
_EMB = "with e as (select vec_id, label, embedding::double[] as x from embeddings), s as (select a.vec_id as query, b.vec_id as id, a.label as ql, b.label as l, round(list_cosine_similarity(a.x, b.x), 9) as score from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by query order by score desc, id) as rank from s) "
_JAC = r"t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') as w from documents where text is not null), g as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i+4], ' ') else array_to_string(w, ' ') end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)), n as (select doc_id, count(*) as n from g group by 1), p as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2), l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where k / (a.n + b.n - k)::double >= 0.8)"
ORACLE = {
    "leak_anti_join": "with " + _JAC + " select doc_id from documents d where text is not null and doc_id % 10 = 0 and not exists (select 1 from l where x = d.doc_id and y % 10 <> 0)",
    "tfidf_vocab": _VOC + "select term, df, tf, round(idf, 6) as idf, round(importance, 5) as importance from v",
    "tfidf_topk_search": _SIM + "select query, id, round(score, 5) as score from (select *, row_number() over (partition by query order by score desc, id) as rn from s) where rn <= 5",
    "centroid_classify": _VEC[:-2] + _LAB + _CEN + ", sc as (select id, label, round(sum(vec.w * cen.w), 6) as score from vec join cen using (term) group by 1, 2), b as (select *, row_number() over (partition by id order by score desc, label) as rn from sc) select l.label as own, b.label, count(*) as n from b join l on l.id = b.id where rn = 1 group by 1, 2",
    "knn_classify": _SIM + _LAB + _KNN + "select query, label, round(score, 5) as score from kn",
    "blended_rank": _SIM + _LAB + _CEN + _KNN + ", sc as (select id as query, label, sum(vec.w * cen.w) as score from vec join cen using (term) where id % 50 = 0 group by 1, 2), bl as (select query, label, round(0.35 * coalesce(sc.score, 0) + 0.65 * coalesce(kn.score, 0), 6) as score from sc full join kn using (query, label)), r as (select *, row_number() over (partition by query order by score desc, label) as rank from bl) select query, r.label, rank, round(score, 5) as score from r join l on l.id = r.query and l.label = r.label",
    "nn_length_matched": _SIM + ", n as (select doc_id, length(text) as n from documents), m as (select s.*, row_number() over (partition by query order by score desc, id) as rn from s join n a on a.doc_id = query join n b on b.doc_id = s.id where 2 * b.n >= a.n and b.n <= 2 * a.n) select query, id, round(score, 5) as score from m where rn = 1",
    "bm25_search": _TF + "ln as (select id, sum(tf) as len from c group by id), a as (select avg(len) as al from ln), dfs as (select term, count(*) as df from c group by term), s as (select q.id as query, c.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c.tf * 2.2 / (c.tf + 1.2 * (0.3 + 0.7 * len / al))), 9) as score from c q join c on q.term = c.term join dfs on dfs.term = c.term join ln on ln.id = c.id, a, nd where q.id % 50 = 0 and q.id <> c.id group by 1, 2) select query, id, round(score, 4) as score from (select *, row_number() over (partition by query order by score desc, id) as rn from s) where rn <= 3",
    "ngram_lm_score": "with t as (select doc_id, '^' || " + _KEY.format("text") + " || '$' as t from documents where text is not null), g as (select doc_id, substring(t, i, 3) as g from (select doc_id, t, unnest(range(1, length(t) - 1)) as i from t)), k as (select doc_id, g, count(*) as k from g group by 1, 2), m as (select g, sum(k) as c from k where not regexp_matches(g, '^[一-龠々]+$') group by g), z as (select sum(c) as total, count(*) as vocab from m) select doc_id, round(sum(k * (ln(coalesce(c, 0) + 1) - ln(total + vocab))) / sum(k), 5) as score from k left join m using (g), z group by doc_id",
    "char_ngram_model": "with t as (select '^' || " + _KEY.format("content") + " || '$' as t from posts where content is not null), g as (select s as size, substring(t, i, s) as gram from (select t, s, unnest(range(1, length(t) - s + 2)) as i from t, (values (3), (4)) z(s))), c as (select size, gram, count(*) as n from g where not regexp_matches(gram, '^[一-龠々]+$') group by 1, 2) select size, gram, n, total, vocabulary from (select *, row_number() over (partition by size order by n desc, gram) as rn, sum(n) over (partition by size) as total, count(*) over (partition by size) as vocabulary from c) where rn <= 100",
    "near_dup_classes": "with recursive " + _JAC + ", r(x, y) as (select doc_id, doc_id from n union select r.x, l.y from r join l on r.y = l.x) select r.x as doc_id, min(r.y) as class_id, (select count(*) from l where l.x = r.x) as n_links from r group by r.x",
    "emb_topk_cosine": _EMB + "select query, id, rank, round(score, 6) as score from r where rank <= 10",
    "emb_mrr_label": _EMB + "select count(*) as n, round(avg(coalesce(1.0 / r, 0)), 6) as mrr from (select query, min(case when l = ql then rank end) as r from r where rank <= 10 group by query)",
}
