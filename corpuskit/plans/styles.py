"""Queries of classifiers, measures, constructions, alignments and audits of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from corpuskit.functions import patterns as R, text as T
from corpuskit.operators import features as X, ordered as O, scoring as S, vectors as V
from corpuskit.operators.lineage import cut, read_table, stored
from corpuskit.plans.features import _BL, _P, _F, ORACLE as _FEATURE_SQL, _posts
from corpuskit.plans.retrieval import CONCEPTS, _CONC, _LINES
from corpuskit.plans.text import ACTS, _tags_sql
from corpuskit.plans.vectors import VOCABULARY, _JAC, _SIM, _nearest, _queries, _texts, _vocabulary

#: A reply mark with a number.
MARK = r"(?:>>|＞＞)[ \t]*[0-9]+"


def _pairs(spark, d):
    c = read_table(spark, d, "comparisons").filter("comparisonId is not null")
    return c.select("comparisonId", "source", "leftText", "rightText").distinct()


def _lines(c):
    return F.filter(F.transform(T.lines(c), lambda x: F.trim(x)), lambda x: x != "")


def digit_readings(spark, d):
    """Words of the posts that read as digits."""
    w = _posts(spark, d).select(F.explode(F.regexp_extract_all("content", F.lit("[ぁ-ゖァ-ヺー]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", T.digit_reading(F.col("word")).alias("digits"), "n").filter("digits is not null")


def quote_families(spark, d):
    return _posts(spark, d).select("id", F.array_join(T.tags(F.col("content"), R.FAMILIES), ",").alias("families")).distinct()


def speech_acts(spark, d):
    """Acts found in a text or in the text without blanks, and the first of them."""
    c, bare = F.col("content"), F.regexp_replace("content", T.BLANK + "+", "")
    acts = F.array_compact(F.array(*[F.when(c.rlike(p) | F.col("_b").rlike(p), F.lit(k)) for k, p in R.SPEECH_ACTS.items()]))
    rows = _posts(spark, d).withColumn("_b", bare).select("id", acts.alias("acts"))
    return rows.select("id", F.array_join("acts", ",").alias("acts"), F.coalesce(F.try_element_at("acts", F.lit(1)), F.lit("unclassified")).alias("primary_act")).distinct()


def act_counts(spark, d):
    """Posts of each act with the ten least ids as examples; the counts are combined before
    the ids are ranked, of which each task keeps ten for an act."""
    t = speech_acts(spark, d).select("id", F.explode(F.split("acts", ",")).alias("act")).filter("act <> ''")
    t = cut(t)
    first = t.withColumn("rn", F.row_number().over(W.partitionBy("act").orderBy("id"))).filter("rn <= 10").groupBy("act").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return t.groupBy("act").agg(F.count("*").alias("n")).join(F.broadcast(first), "act")


def style_dimensions(spark, d):
    c = F.col("content")
    return _posts(spark, d).agg(F.count("*").alias("n_posts"), *[F.count(F.when(c.rlike(p), 1)).alias(k) for k, p in R.STYLE_DIMENSIONS.items()])


def motif_counts(spark, d):
    p = _posts(spark, d).select(F.coalesce("board", F.lit("-")).alias("board"), *[X.count(F.col("content"), p).alias(k) for k, p in R.MOTIFS.items()])
    return p.groupBy("board").agg(*[F.sum(k).alias(k) for k in R.MOTIFS])


def era_profile(spark, d):
    """Posts, first and last ISO date, mean length and marker rates per ten thousand
    characters, by board and for all boards."""
    p = read_table(spark, d, "posts").filter("id is not null and content is not null").groupBy("id", "board").agg(F.max_by(F.struct("content", "date"), F.struct("ingestedAt", "content", "date")).alias("x"))
    p = p.select(F.coalesce("board", F.lit("-")).alias("board"), F.length("x.content").alias("n"), F.when(F.col("x.date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring("x.date", 1, 10)).alias("day"), *[X.count(F.col("x.content"), v).alias(k) for k, v in R.MARKERS.items()])
    g = p.rollup("board").agg(
        F.count("*").alias("posts"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.avg("n"), 2).alias("mean_length"), *[F.round(10000 * F.sum(k) / F.greatest(F.sum("n"), F.lit(1)), 3).alias(k) for k in R.MARKERS], F.grouping("board").alias("g")
    )
    return g.withColumn("board", F.when(F.col("g") == 1, "ALL").otherwise(F.col("board"))).drop("g")


def anchor_constructions(spark, d):
    """Every reply mark of every line by its place in the line and its construction."""
    x = _posts(spark, d).select("id", F.explode(T.lines(F.col("content"))).alias("line")).filter(F.col("line").rlike(MARK))
    x = x.select("id", "line", F.split("line", MARK, -1).alias("parts"), F.regexp_extract_all("line", F.lit(MARK), F.lit(0)).alias("marks"))
    x = x.select("id", "line", "parts", "marks", F.explode(F.sequence(F.lit(1), F.size("marks"))).alias("k"))
    joined = lambda lo, n: F.array_join(F.transform(F.sequence(lo, lo + n - 1), lambda i: F.concat(F.element_at("parts", i), F.coalesce(F.try_element_at("marks", i), F.lit("")))), "")
    k = F.col("k")
    before = F.concat(F.when(k > 1, joined(F.lit(1), k - 1)).otherwise(""), F.element_at("parts", k))
    x = x.select("line", "id", F.size("marks").alias("m"), F.trim(before).alias("before"), F.trim(joined(k + 1, F.size("parts") - k)).alias("after"))
    b, a = F.col("before"), F.col("after")
    kind = F.when(F.col("m") > 1, "coordination").when((b == "") & (a == ""), "standalone_reply")
    for name, p in R.ANCHOR_AFTER.items():
        kind = kind.when(a.rlike(p) | (F.col("line").rlike(R.AGREEING_LINE) if name == "agreement_target" else F.lit(False)), name)
    kind = kind.when((b != "") & (a != ""), "embedded_argument").when(b == "", "prefixed_clause").otherwise("sentence_tail_reference")
    place = F.when((b == "") & (a == ""), "standalone").when(b == "", "prefix").when(a == "", "suffix").otherwise("inline")
    return x.groupBy(place.alias("placement"), kind.alias("construction")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_posts"))


def _measures(spark, d):
    """The measures of a text over its filled lines; those outside quotations leave out
    quotations that hold no other (nested ones: outside_quote_measures)."""
    c = F.col("content")
    rows = _posts(spark, d).withColumns({"_l": _lines(c), "_x": F.regexp_replace("content", "「[^「」『』]*」|『[^「」『』]*』", "")}).withColumn("_n", F.transform("_l", X.filled))
    line = lambda p: F.size(F.filter("_l", lambda x: x.rlike(p)))
    n = lambda t, p: X.count(F.col(t), p)
    return rows.select(
        "id", F.coalesce("board", F.lit("-")).alias("board"), F.greatest(F.lit(1), X.filled(c)).alias("chars"), F.size("_l").alias("n_lines"), n("content", "\n").alias("newlines"), n("content", "。").alias("periods"), n("content", "、").alias("commas"), n("content", "[!！]").alias("exclaims"),
        n("content", "[?？]").alias("questions"), n("_x", "。").alias("outside_periods"), n("_x", "、").alias("outside_commas"), X.filled(F.col("_x")).alias("outside_chars"), line(r"[^。！？!?.…]$").alias("line_no_stop"), line("^[^。、]*$").alias("line_no_jp_punct"),
        line("。$").alias("line_ends_period"), F.coalesce(F.try_element_at("_l", F.lit(-1)).endswith("。"), F.lit(False)).alias("final_period"), (~c.rlike("[。、]")).alias("no_jp_punct"),
        F.round(F.coalesce(F.aggregate("_n", F.lit(0), lambda a, x: a + x) / F.nullif(F.size("_n"), F.lit(0)), F.lit(0.0)), 4).alias("mean_line"), F.coalesce(F.array_max("_n"), F.lit(0)).alias("max_line"),
        F.size(F.filter(T.lines(c), lambda x: F.trim(x) == "")).alias("blank_lines"),
    )


def text_measures(spark, d):
    return _measures(spark, d).drop("board")


def group_summary(spark, d):
    """Sums and ratios of sums by board, never means of ratios."""
    m = _measures(spark, d)
    s = lambda c: F.sum(F.col(c).cast("long"))
    per = lambda a, b: F.round(100 * s(a) / F.greatest(s(b), F.lit(1)), 5)
    return m.groupBy("board").agg(
        F.count("*").alias("posts"), s("chars").alias("chars"), s("n_lines").alias("n_lines"), s("periods").alias("periods"), s("commas").alias("commas"), per("periods", "chars").alias("period_per_100"), per("commas", "chars").alias("comma_per_100"),
        per("newlines", "chars").alias("newline_per_100"), F.round(s("no_jp_punct") / F.count("*"), 5).alias("no_jp_punct_posts"), F.round(s("final_period") / F.count("*"), 5).alias("final_period_posts"),
        F.round(s("line_no_stop") / F.greatest(s("n_lines"), F.lit(1)), 5).alias("no_stop_lines"), per("outside_periods", "outside_chars").alias("outside_period_per_100"), per("outside_commas", "outside_chars").alias("outside_comma_per_100"), per("questions", "chars").alias("question_per_100"),
    )


def text_views(spark, d):
    """Excerpt, text without lines of reply marks alone, tidied text, paragraphs and clauses."""
    c = F.col("content")
    clauses = F.filter(F.split("content", "[、,。！？!?\n]"), lambda x: F.trim(x) != "")
    return _posts(spark, d).select(
        "id", F.md5(T.excerpt(c)).alias("excerpt"), F.md5(T.without_anchor_lines(c)).alias("stripped"), F.md5(T.tidy(c)).alias("tidied"), F.size(F.filter(F.split("content", "\n{2,}"), lambda x: F.trim(x) != "")).alias("n_paragraphs"), F.size(clauses).alias("n_clauses")
    ).distinct()


def abstract_structure(spark, d):
    return _posts(spark, d).groupBy(F.md5(T.structure(F.col("content"))).alias("shape")).agg(F.count("*").alias("n_posts"))


def paragraph_structure(spark, d):
    """Paragraphs of each document, spoken and told, and their lengths."""
    p = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n{2,}"), lambda x: x.rlike("[^ ]"))
    t = read_table(spark, d, "documents").filter("text is not null").select("doc_id", p.alias("p")).filter("size(p) > 0").withColumn("n", F.transform("p", lambda x: F.length(x)))
    spoken = F.size(F.filter("p", lambda x: x.rlike("^[「『]")))
    return t.select(
        "doc_id", F.size("p").alias("n_paragraphs"), spoken.alias("n_dialogue"), F.round(spoken / F.size("p"), 6).alias("dialogue_rate"), F.array_min("n").alias("shortest"), F.array_max("n").alias("longest"),
        F.round(F.aggregate("n", F.lit(0), lambda a, x: a + x) / F.size("n"), 2).alias("mean_length"),
    )


def _prefixed(mark):
    return lambda x: F.concat(F.lit(mark), x)


def prefixed_ngrams(spark, d):
    """Character pairs and triples of the posts with their size before them, punctuation as _."""
    c = F.regexp_replace(F.translate(F.lower("content"), "ς", "σ"), r"[\p{P}\p{S}\p{Z}\t-\r]+", "_")
    g = _posts(spark, d).select(F.explode(F.concat(*[F.transform(T.grams(c, n), _prefixed(f"c{n}:")) for n in (2, 3)])).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def multi_size_terms(spark, d):
    """Grams of two to four characters of the masked view, those of masks, blanks and signs
    alone left out."""
    c = T.masked(F.col("content"), "script")
    g = _posts(spark, d).select("id", F.explode(F.concat(*[T.grams(c, n) for n in (2, 3, 4)])).alias("term")).filter(~F.col("term").rlike(r"^[□\s\p{P}\p{S}]+$"))
    return g.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("id").alias("df"))


def char_tfidf_vocab(spark, d):
    """The 12,000 commonest grams of two to four characters in at least two posts, with
    smoothed idf."""
    p = _posts(spark, d).select("id", T.collapse(F.lower("content")).alias("t"))
    n = p.count()
    g = p.select("id", F.explode(F.concat(*[T.grams(F.col("t"), k) for k in (2, 3, 4)])).alias("term"))
    v = g.groupBy("id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter("df >= 2")
    return v.orderBy(F.desc("tf"), "term").limit(12_000).select("term", "df", "tf", F.round(F.log((1.0 + n) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def expanded_queries(spark, d):
    """The words of every 50th document with all members of the concepts they are members of."""
    w = read_table(spark, d, "documents").filter("doc_id % 50 = 0 and text is not null").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    m = spark.createDataFrame([(x, c) for c, xs in CONCEPTS.items() for x in xs.split()], "word string, concept string")
    # A table of about a hundred members.
    more = w.join(F.broadcast(m), "word").select("doc_id", "concept").distinct().join(F.broadcast(m), "concept").select("doc_id", "word")
    return w.union(more).distinct().groupBy("doc_id").agg(F.count("*").alias("n_words"))


def corpus_counts(spark, d):
    p = read_table(spark, d, "posts")
    return p.agg(
        F.count("*").alias("records"), F.countDistinct("id").alias("posts"), F.countDistinct("threadUrl").alias("threads"), F.count(F.when(F.col("content").isNull() | (F.trim("content") == ""), 1)).alias("empty"), F.count_if("presentInLocalLog").alias("in_log"),
        F.sum(F.coalesce(F.size(T.lines(F.col("content"))), F.lit(0))).alias("n_lines"),
    )


def cluster_profile(spark, d):
    """The eight features by which each board differs most from all, in deviations."""
    f = cut(X.style_features(_posts(spark, d)).select(F.coalesce("board", F.lit("-")).alias("board"), *X.FEATURES))
    long = lambda t: t.select(*[c for c in t.columns if c == "board"], F.explode(F.create_map(*[x for n in X.FEATURES for x in (F.lit(n), F.col(n).cast("double"))])).alias("feature", "v"))
    all_ = long(f).groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    own = long(f).groupBy("board", "feature").agg(F.avg("v").alias("own")).join(F.broadcast(all_), "feature")
    z = own.select("board", "feature", F.round((F.col("own") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 4).alias("deviation"))
    return z.withColumn("rank", F.row_number().over(W.partitionBy("board").orderBy(F.desc(F.abs("deviation")), "feature"))).filter("rank <= 8")


def copy_expansion(spark, d):
    """Share of outputs equal to their source, and characters out over characters in."""
    c = _pairs(spark, d)
    long = c.select("comparisonId", "source", F.explode(F.array("leftText", "rightText")).alias("out")).filter("source is not null and out is not null")
    return long.agg(F.count("*").alias("n"), F.round(F.avg((F.col("source") == F.col("out")).cast("double")), 6).alias("copied"), F.round(F.sum(F.length("out")) / F.greatest(F.sum(F.length("source")), F.lit(1)), 6).alias("expansion"))


def line_context(spark, d):
    """The line of each post that shares most words with its thread's title (an exact hit
    counts 20), and how many lines its context has, the one before and the one after included."""
    p = read_table(spark, d, "posts").filter("id is not null and content is not null and threadTitle is not null").groupBy("id").agg(F.max(F.struct("ingestedAt", "content", "threadTitle")).alias("x")).select("id", "x.content", "x.threadTitle")
    key = lambda c: F.trim(F.lower(c))
    x = p.select("id", _lines(F.col("content")).alias("l"), key("threadTitle").alias("t"), F.array_distinct(T.words(F.col("threadTitle"))).alias("w")).filter("size(l) > 0")
    x = x.select("id", "t", "w", F.size("l").alias("k"), F.posexplode("l").alias("i", "line"))
    exact = F.when(F.contains(key("line"), F.col("t")) | F.contains(F.col("t"), key("line")), 20.0).otherwise(0.0)
    score = exact + F.size(F.array_intersect("w", T.words(F.col("line")))) / F.greatest(F.lit(1), F.size("w"))
    best = x.groupBy("id").agg(F.max(F.struct(F.round(score, 6).alias("score"), (-F.col("i")).alias("i"), "k")).alias("b"))
    i = -F.col("b.i")
    return best.select("id", i.cast("int").alias("line_no"), F.col("b.score").alias("score"), (F.least(i + 2, F.col("b.k")) - F.greatest(i - 1, F.lit(0))).cast("int").alias("n_context"))


def stage_changes(spark, d):
    """How answers change from one revision to the next."""
    a = read_table(spark, d, "preferences").select("comparisonId", "annotatorId", "dimension", "revision", F.coalesce("choice", F.lit("-")).alias("choice")).distinct()
    w = W.partitionBy("comparisonId", "annotatorId", "dimension").orderBy("revision", "choice")
    return a.withColumn("before", F.lag("choice").over(w)).filter("before is not null").groupBy("before", "choice").agg(F.count("*").alias("n"))


def repeated_within_window(spark, d):
    """Posts whose text their author wrote in one of the six posts before.

    Places within an author are differences of global ones, so no author is sorted in one
    task; equal texts of an author meet by their digest."""
    p = read_table(spark, d, "posts").filter("id is not null and posterId is not null and content is not null").groupBy("id", "posterId").agg(F.max(F.struct("ingestedAt", "content")).alias("x")).select("id", "posterId", F.md5("x.content").alias("h"), F.col("x.ingestedAt").alias("at"))
    n = O.numbered(p, ["posterId", "at", "id"])
    before = F.lag("rn").over(W.partitionBy("posterId", "h").orderBy("rn"))
    return n.withColumn("gap", F.col("rn") - before).filter("gap <= 6").select("id", F.col("gap").cast("int").alias("gap"))


def narrative_order(spark, d):
    """Lines of comparisons' sources by the priority of their role, then by place."""
    x = _pairs(spark, d).filter("source is not null").select("comparisonId", F.posexplode(T.sentences_fast(F.col("source"))).alias("n", "s")).distinct()
    role = F.when(F.col("s").rlike("[?？]"), 1).when(F.col("s").rlike("[!！]"), 2).when(F.col("s").rlike("「|“"), 3).otherwise(4)
    w = W.partitionBy("comparisonId").orderBy("role", "n", "s")
    return x.withColumn("role", role).select("comparisonId", F.col("n").alias("place"), (F.row_number().over(w) - 1).alias("new_place"), "role")


def bag_draws(spark, d):
    """Draws from a bag of each source's documents in the order of a digest: none comes again
    before all have come; the first ten."""
    x = read_table(spark, d, "documents").filter("source is not null").select("source", "doc_id", F.sha2(F.concat(F.lit("1729"), F.col("doc_id").cast("string")), 256).alias("h"))
    x = x.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("h"))).filter("k <= 10")
    n = read_table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.least(F.count("*"), F.lit(10)).alias("size"))
    draws = n.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("k", ((F.col("draw") - 1) % F.col("size") + 1).cast("int"))
    return draws.join(x, ["source", "k"]).select("source", "draw", "doc_id")


def multiset_equality(spark, d):
    """Whether reversing the lines keeps the characters and the set of lines of each post."""
    c, r = F.col("content"), T.reversed_lines(F.col("content"))
    same = lambda a, b: F.array_sort(a) == F.array_sort(b)
    return _posts(spark, d).agg(F.count("*").alias("n"), F.count_if(same(F.split(c, ""), F.split(r, ""))).alias("same_chars"), F.count_if(same(F.split(c, "\n", -1), F.split(r, "\n", -1))).alias("same_lines"), F.count_if(c == r).alias("same_text"))


def feature_identity(spark, d):
    """Posts all of whose structural features stay when their lines are reversed."""
    p = _posts(spark, d).filter(F.contains("content", F.lit("\n")))
    names = [c for c in X.structural_features(p.limit(0)).columns if c not in ("id", "board", "content")]
    view = lambda t, k: X.structural_features(t).select("id", "board", F.array(*[F.col(c).cast("double") for c in names]).alias(k))
    both = view(p, "a").join(view(p.withColumn("content", T.reversed_lines(F.col("content"))), "b"), ["id", "board"])
    same = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) < 1e-10), lambda x: x)
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


def rule_board_attestation(spark, d):
    """Rules and boards with a post that attests the rule: a rule is usable on these alone."""
    rules = spark.createDataFrame([(k, p) for t in (R.FAMILIES, R.STYLE_DIMENSIONS) for k, p in t.items()], "rule string, pattern string").dropDuplicates(["rule", "pattern"])
    # A table of rules is small by nature.
    hit = _posts(spark, d).select(F.coalesce("board", F.lit("-")).alias("board"), "content").join(F.broadcast(rules), F.rlike("content", F.col("pattern")))
    return hit.groupBy("rule", "board", F.md5("pattern").alias("pattern")).agg(F.count("*").alias("n"))


def span_overlaps(spark, d):
    """Numbers and the sentences they lie in or cross, by overlap of their spans."""
    def spans(pieces, kept):
        at = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        return F.filter(F.transform(pieces, lambda x, i: F.struct(at(i).alias("a"), (at(i) + F.length(x)).alias("b"), x.alias("x"))), lambda s: s["x"].rlike(kept))

    c = _pairs(spark, d).filter("source is not null").select("comparisonId", "source").distinct()
    s = c.select("comparisonId", "source", F.posexplode(spans(F.regexp_extract_all("source", F.lit("[^。！？\n]+[。！？\n]*|[。！？\n]+"), F.lit(0)), ".")).alias("sentence", "s"))
    q = c.select("comparisonId", "source", F.posexplode(spans(F.regexp_extract_all("source", F.lit("[0-9.,]+|[^0-9.,]+"), F.lit(0)), "[0-9]")).alias("number", "q"))
    j = s.join(q, ["comparisonId", "source"]).filter("s.a < q.b and q.a < s.b")
    return j.groupBy("comparisonId").agg(F.count("*").alias("n_pairs"), F.countDistinct("source", "number").alias("n_numbers"), F.countDistinct("source", "sentence").alias("n_sentences"))


def kwic_concordance(spark, d, before: int = 35, after: int = 65, most: int = 18):
    """The first occurrences of each expression with what stands before and after."""
    e = ["んだよな", "らしい", "のほうが", "からな"]
    p = _posts(spark, d).groupBy("id").agg(F.max("content").alias("content"))
    x = p.select("id", "content", F.explode(F.array(*[F.lit(v) for v in e])).alias("expression")).filter(F.contains("content", F.col("expression")))
    parts = F.split("content", F.col("expression"), -1)
    x = x.withColumn("parts", parts).select("id", "expression", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    right = F.expr("array_join(slice(parts, k + 1, size(parts) - k), expression)")
    x = x.select("id", "expression", "k", F.expr(f"right(array_join(slice(parts, 1, k), expression), {before})").alias("left_context"), F.substring(right, 1, after).alias("right_context"))
    return x.withColumn("rn", F.row_number().over(W.partitionBy("expression").orderBy("id", "k"))).filter(F.col("rn") <= most)


def candidate_union(spark, d, by_vector: int = 1_800, by_term: int = 800, by_act: int = 700):
    """Candidates of every 50th document: the best by vectors, the first holders of each of its
    words and the first of each of its acts; caps are part of the rule.

    Acts go along as words with a sign that no word has. The first holders of a word are those
    with an id up to that of the last of them, so a document tells by itself whether it is one,
    and pairs are counted where they meet."""
    docs = read_table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    acts = F.transform(T.tags(F.col("text"), ACTS), lambda x: F.concat(F.lit("#"), x))
    texts = stored(S.whole(docs, "doc_id", F.concat(T.words(F.col("text")), acts))[0])
    plain = texts.select("id", F.filter("words", lambda x: ~x.startswith("#")).alias("words"))
    stats = cut(S.term_stats(plain))
    kept = V.ranked_terms(stats, docs.count(), size=VOCABULARY).select("term", "idf").collect()
    terms, idf = [r.term for r in kept], np.array([r.idf for r in kept], np.float64)
    known = set(terms)
    last = lambda t, n: t.filter("id is not null").withColumn("rn", F.row_number().over(W.partitionBy("term").orderBy("id"))).filter(F.col("rn") <= n).groupBy("term").agg(F.max("id").alias("id"))
    # Words of more than by_term documents, of which there are at most words / by_term.
    often = stats.filter(F.col("df") > by_term).select("term")
    held = plain.select("id", F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(often), "term", "left_semi")
    cutoff = {r.term: r.id for r in last(held, by_term).union(last(docs.select(F.col("doc_id").alias("id"), F.explode(acts).alias("term")), by_act).select("term", "id")).collect()}
    parts = []
    for held in S.blocks(_queries(texts)):
        others = sorted({w for r in held for w in r["words"]} - known)
        block = S.cosine_block(held, terms, idf, others)
        block["cutoff"] = np.array([cutoff.get(t, np.iinfo(np.int64).max) for t in (*terms, *others)], np.int64)
        parts.append(S.union_sizes(texts, block, S.cosine_weights, by_vector))
    return S.union(parts, spark.createDataFrame([], "query long, n long")).filter("n > 0").select("query", F.col("n").alias("n_candidates"))


def novelty_retrieved(spark, d):
    """Every 50th document by how close its 30 nearest are: known, adaptation or novel, by the
    Dice similarity of trigrams and of structures; the nearest goes along. Texts travel to
    their pairs, as they are smaller than the sets, which are made there."""
    docs, texts, _ = _texts(spark, d)
    near = _nearest(texts, texts, _vocabulary(docs, texts), 30)
    own = docs.select(F.col("doc_id").alias("id"), "text")
    pairs = near.select("query", "id", "rank").join(own, "id").join(_queries(own).select(F.col("id").alias("query"), F.col("text").alias("asked")), "query")
    alike = lambda view: F.round(T.let(F.struct(T.gram_set(view(F.col("text"))).alias("g"), T.gram_set(view(F.col("asked"))).alias("q")), lambda x: T.dice(x["g"], x["q"])), 6)
    x = pairs.select("query", "id", "rank", alike(lambda c: c).alias("surface"), alike(T.structure).alias("shape"))
    m = x.groupBy("query").agg(F.max("surface").alias("surface"), F.max("shape").alias("shape"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("nearest"))
    return m.select("query", "surface", "shape", "nearest", F.when(F.col("surface") > 0.95, "known").when((F.col("surface") > 0.72) | (F.col("shape") > 0.86), "adaptation").otherwise("novel").alias("novelty"))


def output_features(spark, d):
    """Twelve surface measures of each post in its compatibility form."""
    from corpuskit.operators import pyops as P

    p = _posts(spark, d).select("id", "board", P.nfkc("content").alias("t"))
    n = F.length("t")
    some = lambda pattern: F.filter(F.split("t", pattern), lambda x: F.trim(x) != "")
    c = lambda pattern: F.regexp_count("t", F.lit(pattern))
    longest = F.coalesce(F.array_max(F.transform(some("[、,。！？!?]"), lambda x: F.length(x))), F.lit(0))
    ratio = lambda pattern: F.round(c(pattern) / F.greatest(n, F.lit(1)), 6)
    return p.select(
        "id", "board", (n / 240).alias("length"), (F.size(some("[。！？!?]")) / 10).alias("sentences"), (F.size(some("[、,。！？!?]")) / 10).alias("clauses"), (longest / 120).alias("longest_clause"), F.round(n / F.greatest(F.size(some("[。！？!?]")), F.lit(1)) / 120, 6).alias("mean_sentence"),
        F.col("t").rlike(r"(?s)(.{3,12})\1").cast("int").alias("repetition"), ratio(r"[\p{IsHiragana}\p{IsKatakana}]").alias("kana"), ratio(r"\p{IsHan}").alias("kanji"), ratio("[、。！？!?（）「」]").alias("punctuation"),
        (c("より|と比べ|見立て|と同じ") / 10).alias("comparison"), (c("なら|れば|たら") / 10).alias("conditional"), (c("だから|つまり|という|なぜなら") / 10).alias("explanation"),
    )


def dice_split_components(spark, d):
    """Components of comparisons over equal posts, families and groups and over sources whose
    character trigrams have a Dice similarity of 0.85 or more, and their split.

    Texts without punctuation and blanks are one key if equal; between different ones only
    the links that tie them are made (``alike.ties``), not every pair."""
    from corpuskit.operators.alike import ties
    from corpuskit.operators.components import components, node_name

    c = read_table(spark, d, "comparisons").filter("comparisonId is not null").select("comparisonId", "group", "postId", "family", "source")
    plain = F.regexp_replace(F.lower("source"), r"[\p{P}\p{S}\p{Z}\p{C}]+", "")
    texts = c.select(plain.alias("text")).filter("text <> ''").distinct()
    links = ties(texts.select(F.unhex(F.md5("text")).alias("key"), "text"), 0.85)
    # Comparisons are read from the names of their nodes; all others have short names, as those are most of what is shuffled.
    short = lambda k, digest: F.when(digest.isNotNull(), F.concat(F.substring(F.base64(digest), 1, 22), F.lit(k)))
    digest = lambda v: F.unhex(F.md5(v))
    nodes = F.array_compact(F.array(node_name("i", F.col("comparisonId")), *[short(k, digest(v)) for k, v in (("g", F.col("group")), ("p", F.col("postId")), ("f", F.col("family")), ("k", F.when(plain != "", plain)))]))
    edges = c.select(nodes.alias("keys")).unionByName(links.select(F.array(short("k", F.col("key")), short("k", F.col("other"))).alias("keys")))
    roots = components(edges).filter(F.substring("node", 17, 2) == "i:")
    own = roots.select(F.expr("substring(node, 19)").alias("comparisonId"), "root")
    least = own.groupBy("root").agg(F.min("comparisonId").alias("least"), F.count("*").alias("size"))
    h = F.conv(F.substring(F.sha2("least", 256), 1, 8), 16, 10).cast("long") % 10
    return own.join(least, "root").select("comparisonId", "least", "size", F.when(h < 7, "train").when(h < 9, "validation").otherwise("test").alias("split"))


QUERIES = {
    f.__name__: f
    for f in (
        digit_readings, quote_families, speech_acts, act_counts, style_dimensions, motif_counts, era_profile, anchor_constructions, text_measures, group_summary, text_views, abstract_structure, paragraph_structure, prefixed_ngrams, multi_size_terms,
        char_tfidf_vocab, expanded_queries, corpus_counts, cluster_profile, copy_expansion, line_context, stage_changes, repeated_within_window, narrative_order, bag_draws, multiset_equality, feature_identity, rule_board_attestation, span_overlaps,
        kwic_concordance, candidate_union, novelty_retrieved, output_features, dice_split_components,
    )
}


def _n(c, p):
    return f"len(regexp_extract_all({c}, '{p}'))"


_FILLED = "length(regexp_replace({0}, '" + _BL + "', '', 'g'))"
_BARE = "regexp_replace(content, '" + _BL + "', '', 'g')"
_KATA, _HIRA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))
_ACTS = "list_filter([" + ", ".join(f"case when regexp_matches(content, '{p}') or regexp_matches(bare, '{p}') then '{k}' end" for k, p in R.SPEECH_ACTS.items()) + "], lambda x: x is not null)"
_SPEECH = "with " + _P + f", b as (select id, content, {_BARE} as bare from p), sa as (select distinct id, array_to_string({_ACTS}, ',') as acts, coalesce(({_ACTS})[1], 'unclassified') as primary_act from b) "
_TRIM = "list_filter(list_transform(" + _LINES.format("content") + ", lambda x: trim(x)), lambda x: x <> '')"
_MEASURES = "with " + _P + f", q as (select id, coalesce(board, '-') as board, content, {_TRIM} as l, regexp_replace(content, '「[^「」『』]*」|『[^「」『』]*』', '', 'g') as x from p), tm as (select id, board, greatest(1, {_FILLED.replace('{0}', 'content')}) as chars, len(l) as n_lines, {_n('content', chr(92) + 'n')} as newlines, {_n('content', '。')} as periods, {_n('content', '、')} as commas, {_n('content', '[!！]')} as exclaims, {_n('content', '[?？]')} as questions, {_n('x', '。')} as outside_periods, {_n('x', '、')} as outside_commas, {_FILLED.replace('{0}', 'x')} as outside_chars, len(list_filter(l, lambda y: regexp_matches(y, '[^。！？!?.…]$'))) as line_no_stop, len(list_filter(l, lambda y: regexp_matches(y, '^[^。、]*$'))) as line_no_jp_punct, len(list_filter(l, lambda y: regexp_matches(y, '。$'))) as line_ends_period, coalesce(l[-1] like '%。', false) as final_period, not regexp_matches(content, '[。、]') as no_jp_punct, round(case when len(l) = 0 then 0 else list_sum(list_transform(l, lambda y: {_FILLED.replace('{0}', 'y')})) / len(l) end, 4) as mean_line, coalesce(list_max(list_transform(l, lambda y: {_FILLED.replace('{0}', 'y')})), 0) as max_line, len(list_filter({_LINES.format('content')}, lambda y: trim(y) = '')) as blank_lines from q) "
_PER = "round(100 * sum({0}) / greatest(sum({1}), 1), 5) as {2}"
_SHAPE = r"regexp_replace(regexp_replace(regexp_replace({0}, '[0-9]+(?:\.[0-9]+)?', '<NUM>', 'g'), '[\p{{Han}}\p{{Katakana}}ー]+', '<TERM>', 'g'), '(?:<TERM>)+', '<TERM>', 'g')"
_GRAMS = "select {keep}, substring(t, i, {n}) as g from (select {keep}, t, unnest(range(1, length(t) - {m} + 1)) as i from {table})"
_COLLAPSED = "trim(regexp_replace({0}, '" + _BL + "', ' ', 'g'))"
_MASKED = r"regexp_replace(" + _COLLAPSED.replace('{0}', r"regexp_replace(content, 'https?://[^ \t\n\r\x{3000}]+|>>[0-9]+', '□', 'g')") + r", '[\p{Han}\p{Katakana}ーA-Za-z0-9]+', '□', 'g')"
_REVERSED = "array_to_string(list_reverse(string_split(content, chr(10))), chr(10))"
_RULES = ", ".join(f"('{k}', '{p}')" for k, p in dict.fromkeys((k, p) for t in (R.FAMILIES, R.STYLE_DIMENSIONS) for k, p in t.items()))
_PLAIN = r"regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]+', '', 'g')"
_TRI = "list_distinct(case when length({0}) >= 3 then list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)) when length({0}) > 0 then [{0}] else []::varchar[] end)"
_DICE = "round(case when len({0}) + len({1}) = 0 then 0 else 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) end, 6)"
_PARTS = "list_transform(range(1, len({0}) + 1), lambda i: struct_pack(a := coalesce(list_sum(list_transform({0}[1:i-1], lambda y: length(y))), 0), b := coalesce(list_sum(list_transform({0}[1:i], lambda y: length(y))), 0), x := {0}[i]))"
_AFTER = "array_to_string(list_transform(range(k + 1, len(parts) + 1), lambda i: parts[i] || coalesce(marks[i], '')), '')"
_BEFORE = "array_to_string(list_transform(range(1, k), lambda i: parts[i] || coalesce(marks[i], '')), '') || parts[k]"
_CONSTRUCTION = "case when m > 1 then 'coordination' when b = '' and a = '' then 'standalone_reply' " + " ".join(
    f"when regexp_matches(a, '{p}')" + (f" or regexp_matches(line, '{R.AGREEING_LINE}')" if k == "agreement_target" else "") + f" then '{k}'" for k, p in R.ANCHOR_AFTER.items()
) + " when b <> '' and a <> '' then 'embedded_argument' when b = '' then 'prefixed_clause' else 'sentence_tail_reference' end"
_SQL_MARK = MARK.replace("\\t", chr(92) + "t")
ORACLE: dict[str, str] = {
    "digit_readings": "with " + _P + f", w as (select word, count(*) as n from (select unnest(regexp_extract_all(content, '[ぁ-ゖァ-ヺー]+')) as word from p) group by 1), h as (select word, n, regexp_replace(translate(word, '{_KATA}', '{_HIRA}'), '[ーぁぃぅぇぉゃゅょっ]', '', 'g') as h from w), x as (select *, translate(h, '{''.join(R.DIGIT_KANA)}', '{''.join(v * len(k) for k, v in R.DIGIT_KANA.items())}') as digits from h) select word, digits, n from x where length(h) between 2 and 3 and h not in ({', '.join(repr(w) for w in R.NO_READING)}) and regexp_matches(digits, '^[0-9]+$')",
    "quote_families": "with " + _P + f" select distinct id, array_to_string({_tags_sql(R.FAMILIES, 'content', 'general')}, ',') as families from p",
    "speech_acts": _SPEECH + "select * from sa",
    "act_counts": _SPEECH + ", t as (select id, unnest(string_split(acts, ',')) as act from sa), r as (select *, row_number() over (partition by act order by id) as rn from t where act <> '') select act, count(*) as n, string_agg(case when rn <= 10 then id end, ',' order by id) as examples from r group by act",
    "style_dimensions": "with " + _P + " select count(*) as n_posts, " + ", ".join(f"count(case when regexp_matches(content, '{p}') then 1 end) as {k}" for k, p in R.STYLE_DIMENSIONS.items()) + " from p",
    "motif_counts": "with " + _P + " select coalesce(board, '-') as board, " + ", ".join(f"sum({_n('content', p)}) as {k}" for k, p in R.MOTIFS.items()) + " from p group by 1",
    "era_profile": "with e as (select id, board, arg_max(struct_pack(c := content, d := date), struct_pack(a := ingestedAt, b := content, c := date)) as x from posts where id is not null and content is not null group by 1, 2), q as (select coalesce(board, '-') as board, length(x.c) as n, case when regexp_matches(x.d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then substring(x.d, 1, 10) end as day, "
    + ", ".join(f"{_n('x.c', p)} as {k}" for k, p in R.MARKERS.items()) + " from e) select case when grouping(board) = 1 then 'ALL' else board end as board, count(*) as posts, min(day) as first_day, max(day) as last_day, round(avg(n), 2) as mean_length, " + ", ".join(f"round(10000 * sum({k}) / greatest(sum(n), 1), 3) as {k}" for k in R.MARKERS) + " from q group by rollup(board)",
    "anchor_constructions": "with " + _P + f", x as (select id, unnest({_LINES.format('content')}) as line from p), y as (select id, line, string_split_regex(line, '{_SQL_MARK}') as parts, regexp_extract_all(line, '{_SQL_MARK}') as marks from x where regexp_matches(line, '{_SQL_MARK}')), z as (select *, unnest(range(1, len(marks) + 1)) as k from y), t as (select id, line, len(marks) as m, trim({_BEFORE}) as b, trim({_AFTER}) as a from z) select case when b = '' and a = '' then 'standalone' when b = '' then 'prefix' when a = '' then 'suffix' else 'inline' end as placement, {_CONSTRUCTION} as construction, count(*) as n, count(distinct id) as n_posts from t group by 1, 2",
    "text_measures": _MEASURES + "select * exclude (board) from tm",
    "group_summary": _MEASURES + "select board, count(*) as posts, " + ", ".join(f"sum({k}) as {k}" for k in ("chars", "n_lines", "periods", "commas")) + ", " + ", ".join(_PER.format(*x) for x in (("periods", "chars", "period_per_100"), ("commas", "chars", "comma_per_100"), ("newlines", "chars", "newline_per_100"), ("outside_periods", "outside_chars", "outside_period_per_100"), ("outside_commas", "outside_chars", "outside_comma_per_100"), ("questions", "chars", "question_per_100")))
    + ", round(sum(no_jp_punct::int) / count(*), 5) as no_jp_punct_posts, round(sum(final_period::int) / count(*), 5) as final_period_posts, round(sum(line_no_stop) / greatest(sum(n_lines), 1), 5) as no_stop_lines from tm group by board",
    "text_views": "with " + _P + " select distinct id, md5(substring(" + _COLLAPSED.replace("{0}", "content") + r", 1, 180)) as excerpt, md5(regexp_replace(regexp_replace(content, '(?m)^(?:>>|＞＞)[0-9]+[ 　]*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as stripped, md5(regexp_replace(regexp_replace(content, '[ 　]+([。、！？,.!?])', '\1', 'g'), '。{2,}', '。', 'g')) as tidied, len(list_filter(string_split_regex(content, '\n{2,}'), lambda x: trim(x) <> '')) as n_paragraphs, len(list_filter(string_split_regex(content, '[、,。！？!?\n]'), lambda x: trim(x) <> '')) as n_clauses from p",
    "abstract_structure": "with " + _P + f" select md5({_SHAPE.format('content')}) as shape, count(*) as n_posts from p group by 1",
    "paragraph_structure": r"with t as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{2,}'), lambda x: regexp_matches(x, '[^ ]')) as p from documents where text is not null), n as (select doc_id, p, list_transform(p, lambda x: length(x)) as n, len(list_filter(p, lambda x: regexp_matches(x, '^[「『]'))) as s from t where len(p) > 0) select doc_id, len(p) as n_paragraphs, s as n_dialogue, round(s / len(p), 6) as dialogue_rate, list_min(n) as shortest, list_max(n) as longest, round(list_sum(n) / len(n), 2) as mean_length from n",
    "prefixed_ngrams": "with " + _P + r", t as (select regexp_replace(replace(lower(content), 'ς', 'σ'), '[\p{P}\p{S}\p{Z}\t-\r]+', '_', 'g') as t, 1 as one from p), g as (" + " union all ".join(f"select 'c{n}:' || g as g from (" + _GRAMS.format(keep="one", n=n, m=n - 1, table="t") + ")" for n in (2, 3)) + ") select g as gram, count(*) as n from g group by 1",
    "multi_size_terms": "with " + _P + f", t as (select id, {_MASKED} as t from p), g as (" + " union all ".join(_GRAMS.format(keep="id", n=n, m=n - 1, table="t") for n in (2, 3, 4)) + r") select g as term, count(*) as tf, count(distinct id) as df from g where not regexp_matches(g, '^[□\s\p{P}\p{S}]+$') group by 1",
    "char_tfidf_vocab": "with " + _P + f", t as (select id, board, {_COLLAPSED.replace('{0}', 'lower(content)')} as t from p), g as (" + " union all ".join(_GRAMS.format(keep="id", n=n, m=n - 1, table="t") for n in (2, 3, 4)) + "), v as (select g as term, count(distinct id) as df, count(*) as tf from g group by 1 having count(distinct id) >= 2 order by tf desc, term limit 12000) select term, df, tf, round(ln((1.0 + (select count(*) from t)) / (1 + df)) + 1, 6) as idf from v",
    "expanded_queries": f"with m(ord, word, concept) as (values {_CONC})" + r", w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as word from documents where doc_id % 50 = 0 and text is not null), a as (select * from w union select w.doc_id, n.word from w join m using (word) join m n on n.concept = m.concept) select doc_id, count(*) as n_words from a group by 1",
    "corpus_counts": f"select count(*) as records, count(distinct id) as posts, count(distinct threadUrl) as threads, count(case when content is null or trim(content) = '' then 1 end) as empty, count(case when presentInLocalLog then 1 end) as in_log, sum(coalesce(len({_LINES.format('content')}), 0)) as n_lines from posts",
    "cluster_profile": _F.replace("f as (select id, ", "f as (select coalesce(board, '-') as board, ") + ", l as (" + " union all ".join(f"select board, '{k}' as feature, {k}::double as v from f" for k in X.FEATURES) + "), a as (select feature, avg(v) as m, stddev_pop(v) as sd from l group by 1), z as (select board, feature, round((avg(v) - max(m)) / case when max(sd) = 0 then 1 else max(sd) end, 4) as deviation from l join a using (feature) group by 1, 2), r as (select *, row_number() over (partition by board order by abs(deviation) desc, feature) as rank from z) select * from r where rank <= 8",
    "copy_expansion": "with c as (select distinct comparisonId, source, leftText, rightText from comparisons where comparisonId is not null), o as (select source, unnest([leftText, rightText]) as o from c) select count(*) as n, round(avg((source = o)::int), 6) as copied, round(sum(length(o)) / greatest(sum(length(source)), 1), 6) as expansion from o where source is not null and o is not null",
    "line_context": r"with lp as (select id, max(struct_pack(a := ingestedAt, c := content, t := threadTitle)) as x from posts where id is not null and content is not null and threadTitle is not null group by 1), q as (select id, x.c as content, trim(lower(x.t)) as t, list_distinct(regexp_extract_all(lower(x.t), '[\p{L}\p{M}\p{N}_]+')) as w from lp), l as (select *, " + _TRIM + r" as l from q), y as (select id, t, w, l, unnest(range(1, len(l) + 1)) - 1 as i from l), s as (select id, i, len(l) as k, round(case when contains(trim(lower(l[i + 1])), t) or contains(t, trim(lower(l[i + 1]))) then 20.0 else 0 end + len(list_intersect(w, regexp_extract_all(lower(l[i + 1]), '[\p{L}\p{M}\p{N}_]+'))) / greatest(1, len(w)), 6) as score from y), r as (select *, row_number() over (partition by id order by score desc, i) as rn from s) select id, i as line_no, score, least(i + 2, k) - greatest(i - 1, 0) as n_context from r where rn = 1",
    "stage_changes": "with a as (select distinct comparisonId, annotatorId, dimension, revision, coalesce(choice, '-') as choice from preferences), w as (select choice, lag(choice) over (partition by comparisonId, annotatorId, dimension order by revision, choice) as before from a) select before, choice, count(*) as n from w where before is not null group by 1, 2",
    "repeated_within_window": "with q as (select id, posterId, max(struct_pack(a := ingestedAt, c := content)) as x from posts where id is not null and posterId is not null and content is not null group by 1, 2), n as (select id, posterId, x.c as c, row_number() over (partition by posterId order by x.a, id) as rn from q), g as (select id, rn - lag(rn) over (partition by posterId, c order by rn) as gap from n) select id, gap from g where gap <= 6",
    "narrative_order": r"with c as (select distinct comparisonId, regexp_extract_all(source, '[^.!?。！？\n]+[.!?。！？]*') as l from comparisons where comparisonId is not null and source is not null), x as (select distinct comparisonId, n - 1 as place, l[n] as s from (select *, unnest(range(1, len(l) + 1)) as n from c)), r as (select *, case when regexp_matches(s, '[?？]') then 1 when regexp_matches(s, '[!！]') then 2 when regexp_matches(s, '「|“') then 3 else 4 end as role from x) select comparisonId, place, row_number() over (partition by comparisonId order by role, place, s) - 1 as new_place, role from r",
    "bag_draws": "with x as (select source, doc_id, row_number() over (partition by source order by sha256('1729' || doc_id)) as k from documents where source is not null), n as (select source, least(count(*), 10) as size from x group by 1), w as (select source, size, unnest(range(1, 11)) as draw from n) select w.source, draw, doc_id from w join x on x.source = w.source and x.k = (draw - 1) % size + 1",
    "multiset_equality": "with " + _P + f", r as (select content as c, {_REVERSED} as r from p) select count(*) as n, count(case when list_sort(string_split(c, '')) = list_sort(string_split(r, '')) then 1 end) as same_chars, count(case when list_sort(string_split(c, chr(10))) = list_sort(string_split(r, chr(10))) then 1 end) as same_lines, count(case when c = r then 1 end) as same_text from r",
    "rule_board_attestation": "with " + _P + f", r(rule, pattern) as (values {_RULES}) select rule, coalesce(board, '-') as board, md5(pattern) as pattern, count(*) as n from p join r on regexp_matches(content, r.pattern) group by 1, 2, 3",
    "span_overlaps": "with c as (select distinct comparisonId, source, regexp_extract_all(source, '[^。！？\\n]+[。！？\\n]*|[。！？\\n]+') as sp, regexp_extract_all(source, '[0-9.,]+|[^0-9.,]+') as np from comparisons where comparisonId is not null and source is not null), s as (select comparisonId, source, unnest(list_filter(" + _PARTS.format("sp") + ", lambda z: regexp_matches(z.x, '.'))) as s from c), q as (select comparisonId, source, unnest(list_filter(" + _PARTS.format("np") + ", lambda z: regexp_matches(z.x, '[0-9]'))) as q from c) select comparisonId, count(*) as n_pairs, count(distinct (source, q.a)) as n_numbers, count(distinct (source, s.a)) as n_sentences from s join q using (comparisonId, source) where s.a < q.b and q.a < s.b group by 1",
    "kwic_concordance": "with " + _P + ", u as (select id, max(content) as content from p group by 1), e as (select id, content, unnest(['んだよな', 'らしい', 'のほうが', 'からな']) as expression from u), x as (select id, content, expression, string_split(content, expression) as parts from e where contains(content, expression)), k as (select *, unnest(range(1, len(parts))) as k from x), c as (select id, expression, k, right(substring(content, 1, upto), 35) as left_context, substring(content, upto + length(expression) + 1, 65) as right_context from (select *, (list_sum(list_transform(parts[1:k], lambda y: length(y))) + (k - 1) * length(expression))::bigint as upto from k)), r as (select *, row_number() over (partition by expression order by id, k) as rn from c) select * from r where rn <= 18",
    "candidate_union": _SIM + ", vv as (select query, id from (select *, row_number() over (partition by query order by score desc, id) as rn from s) where rn <= 1800), t as (select id, term, row_number() over (partition by term order by id) as rn from c), wd as (select q.id as query, t.id from c q join t using (term) where q.id % 50 = 0 and rn <= 800), ac as (select doc_id as id, unnest(" + _tags_sql(ACTS, "text", "general") + ") as act from documents where text is not null), ar as (select *, row_number() over (partition by act order by id) as rn from ac), aw as (select q.id as query, ar.id from ac q join ar using (act) where q.id % 50 = 0 and rn <= 700) select query, count(distinct id) as n_candidates from (select * from vv union select * from wd union select * from aw) where query <> id group by 1",
    "novelty_retrieved": _SIM + ", near as (select *, row_number() over (partition by query order by score desc, id) as rank from s), st as (select doc_id as id, " + _PLAIN.format("text") + " as a, " + _PLAIN.format(_SHAPE.format("text")) + " as b from documents where text is not null), g as (select id, " + _TRI.format("a") + " as g, " + _TRI.format("b") + " as h from st), x as (select query, near.id, rank, " + _DICE.format("g.g", "q.g") + " as surface, " + _DICE.format("g.h", "q.h") + " as shape from near join g on g.id = near.id join g q on q.id = query where rank <= 30), m as (select query, max(surface) as surface, max(shape) as shape, max(case when rank = 1 then id end) as nearest from x group by 1) select *, case when surface > 0.95 then 'known' when surface > 0.72 or shape > 0.86 then 'adaptation' else 'novel' end as novelty from m",
    "dice_split_components": 'with recursive c as (select distinct comparisonId, "group" as gr, postId, family, source, ' + _PLAIN.format("source") + ' as a from comparisons where comparisonId is not null), tx as (select source, ' + _TRI.format("a") + " as g from (select distinct source, a from c where length(a) > 0)), gs as (select source, unnest(g) as t, len(g) as n from tx), lk as (select x.source as s1, y.source as s2 from gs x join gs y on x.t = y.t and x.source < y.source group by 1, 2 having 2.0 * count(*) / (max(x.n) + max(y.n)) >= 0.85), "
    "e as (select distinct comparisonId as c, unnest(list_filter(['g' || gr, 'p' || postId, 'f' || family, case when length(a) > 0 then 's' || source end], lambda x: x is not null)) as k from c union select c.comparisonId, 'l' || s1 || chr(1) || s2 from lk join c on c.source in (s1, s2)), r(c, d) as (select distinct comparisonId, comparisonId from c union select r.c, b.c from r join e a on a.c = r.d join e b on b.k = a.k), m as (select c, min(d) as least, count(distinct d) as size from r group by 1) select c as comparisonId, least, size, case when h < 7 then 'train' when h < 9 then 'validation' else 'test' end as split from (select *, ('0x' || substr(sha256(least), 1, 8))::bigint % 10 as h from m)",
    "novelty_classes": "with c as (select distinct comparisonId, source, leftText, rightText from comparisons where comparisonId is not null), o as (select source, unnest([leftText, rightText]) as o from c), p as (select " + _PLAIN.format("source") + " as a, " + _PLAIN.format("o") + " as b, " + _PLAIN.format(_SHAPE.format("source")) + " as c, " + _PLAIN.format(_SHAPE.format("o")) + " as d from o where source is not null and o is not null), g as (select " + ", ".join(_TRI.format(k) + f" as {k}" for k in "abcd") + " from p), x as (select " + _DICE.format("a", "b") + " as surface, " + _DICE.format("c", "d") + " as shape from g) select case when surface > 0.95 then 'known' when surface > 0.72 or shape > 0.86 then 'adaptation' else 'novel' end as novelty, count(*) as n from x group by 1",
}
