"""Queries of features, profiles and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import features as X
from corpuskit.operators.lineage import read_table


def _posts(spark, d):
    """One row per post: its last ingested version."""
    p = read_table(spark, d, "posts").filter("id is not null and content is not null")
    return p.groupBy("id", "board").agg(F.max_by("content", F.struct("ingestedAt", "content")).alias("content"))


def text_features(spark, d):
    return X.style_features(_posts(spark, d)).drop("content", "board")


def feature_baseline(spark, d):
    return X.baseline(X.style_features(_posts(spark, d)), X.FEATURES)


def structural_features(spark, d):
    return X.structural_features(_posts(spark, d)).drop("content", "board")


def source_profile_rollup(spark, d):
    """Counts, mean length and marker rates per ten thousand characters, by board and for all
    boards; the total row has board ALL."""
    p = _posts(spark, d).select(F.coalesce("board", F.lit("-")).alias("board"), F.length("content").alias("n"), *[X.count(F.col("content"), X.RATES[k]).alias(k) for k in ("first_person", "connective", "certainty")])
    g = p.rollup("board").agg(
        F.count("*").alias("posts"), F.round(F.avg("n"), 4).alias("mean_length"), *[F.round(10000 * F.sum(k) / F.sum("n"), 3).alias(k) for k in ("first_person", "connective", "certainty")], F.grouping("board").alias("g")
    )
    return g.withColumn("board", F.when(F.col("g") == 1, "ALL").otherwise(F.col("board"))).drop("g")


def quantile_profile(spark, d):
    docs = read_table(spark, d, "documents").filter("text is not null").select(F.coalesce("lang", F.lit("-")).alias("lang"), F.length("text").cast("double").alias("n"))
    q = X.quantiles(docs, ["lang"], "n", [0.0, 0.25, 0.5, 0.75, 0.95, 1.0])
    return docs.groupBy("lang").agg(F.count("*").alias("k"), F.round(F.avg("n"), 4).alias("mean")).join(q, "lang").select(
        "lang", "k", "mean", *[F.round(F.col(f"q_{i}"), 4).alias(name) for i, name in enumerate(("low", "q25", "median", "q75", "q95", "high"))]
    )


def winsor_zscore(spark, d):
    x = X.style_features(_posts(spark, d)).select("id", F.col("length").cast("double").alias("length"), "mean_sentence", "diversity")
    return X.winsorised_z(x, ["length", "mean_sentence", "diversity"]).select("id", *[F.round(c, 4).alias(c) for c in ("length", "mean_sentence", "diversity")])


def overlapping_groups(spark, d):
    """Summaries of groups that share posts: each post is counted in all of its groups."""
    p = _posts(spark, d).select("content", F.length("content").alias("n"), F.coalesce("board", F.lit("-")).alias("board"))
    bins = F.when(F.col("n") < 50, "len:0-49").when(F.col("n") < 150, "len:50-149").when(F.col("n") < 400, "len:150-399").otherwise("len:400+")
    groups = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("board:"), "board"), bins, F.when(F.col("content").rlike("「|『"), "quoting"), F.when(F.col("content").rlike("https?://"), "linking"), F.when(~F.col("content").rlike("[。、]"), "no_punctuation")))
    x = p.select(F.explode(groups).alias("grp"), "n", X.count(F.col("content"), "。").alias("k"))
    sums = x.groupBy("grp").agg(F.count("*").alias("posts"), F.sum("n").alias("chars"), F.round(100 * F.sum("k") / F.greatest(F.sum("n"), F.lit(1)), 5).alias("periods_100"))
    return sums.join(X.quantiles(x, ["grp"], "n", [0.5]), "grp").select("grp", "posts", "chars", "periods_100", F.round("q_0", 2).alias("median_chars"))


def spearman(spark, d):
    """Spearman correlation of length and lexical diversity."""
    x = X.style_features(_posts(spark, d)).select("id", "length", "diversity")
    x = X.average_rank(X.average_rank(x, "length", "ra"), "diversity", "rb")
    return x.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def ari_contingency(spark, d):
    """Adjusted Rand index of language and script class, from the contingency counts."""
    c = read_table(spark, d, "documents").filter("text is not null and lang is not null")
    cls = F.when(F.col("text").rlike("[ぁ-んァ-ヴ]"), "kana").when(F.col("text").rlike("[가-힣]"), "hangul").when(F.col("text").rlike("[一-龯]"), "han").otherwise("other")
    t = c.groupBy("lang", cls.alias("cls")).agg(F.count("*").alias("n"))
    two = lambda x: x * (x - 1) / 2
    cells = t.agg(F.sum(two(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    a = t.groupBy("lang").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    b = t.groupBy("cls").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    # Three tables of one row each.
    one = lambda x: x.withColumn("one", F.lit(1))
    z = one(cells).join(one(a), "one").join(one(b), "one")
    e = F.col("a") * F.col("b") / two(F.col("n"))
    return z.select(F.col("n"), F.round((F.col("c") - e) / ((F.col("a") + F.col("b")) / 2 - e), 6).alias("ari"))


def auc_with_ties(spark, d):
    """Area under the curve of document length for the texts with kana against the others,
    ties one half, by average ranks; null if a side is empty."""
    x = read_table(spark, d, "documents").filter("text is not null").select(F.length("text").alias("n"), F.col("text").rlike("[ぁ-んァ-ヴ]").alias("pos"))
    r = X.average_rank(x, "n", "r").agg(F.count(F.when(F.col("pos"), 1)).alias("p"), F.count(F.when(~F.col("pos"), 1)).alias("q"), F.sum(F.when(F.col("pos"), F.col("r"))).alias("s"))
    return r.select("p", "q", F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0)), 6).alias("auc"))


def nearest_rank_p95(spark, d):
    e = read_table(spark, d, "events")
    q = X.quantiles(e, ["event_type"], "value", [0.95], discrete=True)
    return e.groupBy("event_type").agg(F.count("value").alias("n")).join(q, "event_type", "left").select("event_type", "n", F.col("q_0").alias("p95"))


def surface_report(spark, d):
    """The forty commonest bracketed remarks and the share of texts that end in a stop."""
    x = _posts(spark, d).select(F.explode(F.regexp_extract_all("content", F.lit("（[^（）\n]{1,30}）"), F.lit(0))).alias("remark"))
    return x.groupBy("remark").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "remark").limit(40)


def retained_fragments(spark, d):
    """Share of the source's 8-grams that each side of a comparison keeps; 0 below 12 characters."""
    c = read_table(spark, d, "comparisons").select("comparisonId", "source", "leftText", "rightText").distinct()
    g = F.array_distinct(T.grams(F.col("source"), 8))
    keep = lambda t: F.round(F.when(F.length("source") < 12, 0.0).otherwise(F.size(F.filter("_g", lambda x: F.contains(F.col(t), x))) / F.size("_g")), 6)
    return c.filter("source is not null and leftText is not null and rightText is not null").withColumn("_g", g).select("comparisonId", keep("leftText").alias("kept_left"), keep("rightText").alias("kept_right")).distinct()


def dice_similarity(spark, d):
    """Dice similarity of the character trigrams of both sides."""
    c = read_table(spark, d, "comparisons").filter("leftText is not null and rightText is not null").select("comparisonId", "leftText", "rightText").distinct()
    return c.select("comparisonId", F.round(T.dice(T.gram_set(F.col("leftText")), T.gram_set(F.col("rightText"))), 6).alias("dice")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        text_features, feature_baseline, structural_features, source_profile_rollup, quantile_profile, winsor_zscore, overlapping_groups, spearman, ari_contingency, auc_with_ties, nearest_rank_p95, surface_report,
        retained_fragments, dice_similarity,
    )
}

_BL = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_P = "p as (select id, board, arg_max(content, struct_pack(a := ingestedAt, b := content)) as content from posts where id is not null and content is not null group by 1, 2)"


def _n(c, p):
    return f"len(regexp_extract_all({c}, '{p}'))"


_F = (
    "with " + _P + f", q as (select *, greatest(length(regexp_replace(content, '{_BL}', '', 'g')), 1) as n, "
    r"regexp_extract_all(content, '[^.!?。！？\n]+[.!?。！？]*') as s, regexp_extract_all(lower(content), '[\p{L}\p{M}\p{N}_]+') as w from p), "
    "f as (select id, length(content) as length, len(s) as sentence_count, round(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) / greatest(len(s), 1), 4) as mean_sentence, "
    + ", ".join(f"round({_n('content', p)} / n, 6) as {k}" for k, p in X.RATES.items())
    + r", round(len(regexp_extract_all(content, '（[^）]*）|\([^)]*\)')) / greatest(len(s), 1), 6) as parenthetical, round(len(regexp_extract_all(content, '[？?]')) / greatest(len(s), 1), 6) as question, round(len(list_distinct(w)) / greatest(len(w), 1), 6) as diversity from q) "
)
_SET = r"list_distinct(case when length({0}) >= 3 then list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)) when length({0}) > 0 then [{0}] else []::varchar[] end)"
ORACLE = {
    "text_features": _F + "select * from f",
    "feature_baseline": _F + " union all ".join(f"select '{k}' as feature, round(avg({k}), 6) as mean, round(stddev_pop({k}), 6) as sd from f" for k in X.FEATURES),
    "structural_features": "with " + _P + f", q as (select id, content as c, greatest(length(regexp_replace(content, '{_BL}', '', 'g')), 1) as n, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from p) select id, round(ln(1 + n), 6) as log_chars, round(ln(1 + greatest(len(l), 1)), 6) as log_lines, round(ln(1 + case when len(l) = 0 then 0 else list_sum(list_transform(l, lambda x: length(regexp_replace(x, '{_BL}', '', 'g')))) / len(l) end), 6) as log_mean_line, round(ln(1 + coalesce(list_max(list_transform(l, lambda x: length(regexp_replace(x, '{_BL}', '', 'g')))), 0)), 6) as log_max_line, round((len(string_split(c, chr(10))) - 1) * 100 / n, 6) as newlines, "
    + ", ".join(f"round({_n('c', p)} * 100 / n, 6) as d_{k}" for k, p in X.DENSITIES.items())
    + ", round(len(list_filter(l, lambda x: regexp_matches(x, '[^。！？!?.…]$'))) / greatest(len(l), 1), 6) as no_stop_lines, round(len(list_filter(l, lambda x: regexp_matches(x, '^[^。、]*$'))) / greatest(len(l), 1), 6) as no_punct_lines, round(len(list_filter(l, lambda x: regexp_matches(x, '。$'))) / greatest(len(l), 1), 6) as period_lines from q",
    "source_profile_rollup": "with " + _P + ", q as (select coalesce(board, '-') as board, length(content) as n, " + ", ".join(f"{_n('content', X.RATES[k])} as {k}" for k in ("first_person", "connective", "certainty"))
    + " from p) select case when grouping(board) = 1 then 'ALL' else board end as board, count(*) as posts, round(avg(n), 4) as mean_length, " + ", ".join(f"round(10000 * sum({k}) / sum(n), 3) as {k}" for k in ("first_person", "connective", "certainty")) + " from q group by rollup(board)",
    "quantile_profile": "select coalesce(lang, '-') as lang, count(*) as k, round(avg(length(text)::double), 4) as mean, " + ", ".join(f"round(quantile_cont(length(text)::double, {q}), 4) as {k}" for q, k in ((0, "low"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.95, "q95"), (1, "high"))) + " from documents where text is not null group by 1",
    "winsor_zscore": _F + ", c as (select " + ", ".join(f"quantile_cont({k}::double, 0.99) as c_{k}" for k in ("length", "mean_sentence", "diversity")) + " from f), z as (select id, " + ", ".join(f"least({k}::double, c_{k}) as {k}" for k in ("length", "mean_sentence", "diversity"))
    + " from f, c) select id, " + ", ".join(f"round(({k} - avg({k}) over ()) / coalesce(nullif(stddev_pop({k}) over (), 0), 1), 4) as {k}" for k in ("length", "mean_sentence", "diversity")) + " from z",
    "overlapping_groups": "with " + _P + ", q as (select unnest(list_filter(['all', 'board:' || coalesce(board, '-'), case when n < 50 then 'len:0-49' when n < 150 then 'len:50-149' when n < 400 then 'len:150-399' else 'len:400+' end, case when regexp_matches(content, '「|『') then 'quoting' end, case when regexp_matches(content, 'https?://') then 'linking' end, case when not regexp_matches(content, '[。、]') then 'no_punctuation' end], lambda x: x is not null)) as grp, n, k from (select content, board, length(content) as n, length(content) - length(replace(content, '。', '')) as k from p)) select grp, count(*) as posts, sum(n) as chars, round(100 * sum(k) / greatest(sum(n), 1), 5) as periods_100, round(median(n), 2) as median_chars from q group by grp",
    "spearman": _F + ", r as (select rank() over (order by length) + (count(*) over (partition by length) - 1) / 2.0 as ra, rank() over (order by diversity) + (count(*) over (partition by diversity) - 1) / 2.0 as rb from f) select count(*) as n, round(corr(ra, rb), 6) as rho from r",
    "ari_contingency": "with t as (select lang, case when regexp_matches(text, '[ぁ-んァ-ヴ]') then 'kana' when regexp_matches(text, '[가-힣]') then 'hangul' when regexp_matches(text, '[一-龯]') then 'han' else 'other' end as cls, count(*) as n from documents where text is not null and lang is not null group by 1, 2), z as (select (select sum(n * (n - 1) / 2) from t) as c, (select sum(n) from t) as n, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by lang)) as a, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by cls)) as b) select n, round((c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) as ari from z",
    "auc_with_ties": "with x as (select length(text) as n, regexp_matches(text, '[ぁ-んァ-ヴ]') as pos from documents where text is not null) select (select count(*) from x where pos) as p, (select count(*) from x where not pos) as q, round(avg(case when a.n > b.n then 1.0 when a.n = b.n then 0.5 else 0 end), 6) as auc from x a, x b where a.pos and not b.pos",
    "nearest_rank_p95": "select event_type, count(value) as n, quantile_disc(value, 0.95) as p95 from events group by 1",
    "surface_report": "with " + _P + r" select remark, count(*) as n from (select unnest(regexp_extract_all(content, '（[^（）\n]{1,30}）')) as remark from p) group by 1 order by n desc, remark limit 40",
    "retained_fragments": "with c as (select distinct comparisonId, source, leftText, rightText, list_distinct(list_transform(range(1, greatest(length(source) - 6, 1)), lambda i: substring(source, i, 8))) as g from comparisons where source is not null and leftText is not null and rightText is not null) select distinct comparisonId, round(case when length(source) < 12 then 0 else len(list_filter(g, lambda x: contains(leftText, x))) / len(g) end, 6) as kept_left, round(case when length(source) < 12 then 0 else len(list_filter(g, lambda x: contains(rightText, x))) / len(g) end, 6) as kept_right from c",
    "dice_similarity": r"with c as (select distinct comparisonId, regexp_replace(lower(leftText), '[\p{P}\p{S}\p{Z}\p{C}]+', '', 'g') as a, regexp_replace(lower(rightText), '[\p{P}\p{S}\p{Z}\p{C}]+', '', 'g') as b from comparisons where leftText is not null and rightText is not null), g as (select comparisonId, " + _SET.format("a") + " as a, " + _SET.format("b") + " as b from c) select distinct comparisonId, round(case when len(a) + len(b) > 0 then 2 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0 end, 6) as dice from g",
}
