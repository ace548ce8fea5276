"""Queries of scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.lineage import read_table

# A marker pack for Latin text, as the packs are data.
ACTS = {
    "question": r"[?？]", "exclamation": r"[!！]", "reply": r">>[0-9]+", "address": r"https?://", "measure": r"[0-9]+(?:\.[0-9]+)?(?:kg|km|%|％|倍|回|枚)",
    "quotation": r"[「『“„«]", "version": r"[Vv](?:er\.)?[0-9]+\.[0-9]+",
}
LETTERS_SQL = r"[\p{L}\p{M}\p{N}_]+"
BLANK_SQL = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _docs(spark, d):
    return read_table(spark, d, "documents")


def _posts(spark, d):
    return read_table(spark, d, "posts")


def log_line_counts(spark, d):
    x = T.lines(F.col("text"))
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(x).alias("n_lines"), F.size(F.filter(x, lambda s: s.rlike("[^ ]"))).alias("n_filled"))


def html_headings(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"<h1>([^\n]*?)</h1>"), F.lit(1))).alias("pos", "heading"))


def html_text_lengths(spark, d):
    return _docs(spark, d).filter("text like '%<%'").select("doc_id", F.length(F.regexp_replace(F.regexp_replace("text", r"</h[1-6]>", "\n"), r"<[^>]+>", "")).alias("n"))


def search_key(spark, d):
    return _posts(spark, d).select("id", T.search_key(F.col("content")).alias("key")).distinct()


def presence_key(spark, d):
    return _posts(spark, d).select("id", T.presence_key(F.col("content")).alias("key")).distinct()


def sentence_counts(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(T.sentences_fast(F.col("text"))).alias("n"))


def word_freq_topk(spark, d):
    w = _docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def masked_view(spark, d):
    return _posts(spark, d).select("id", T.masked(F.col("content")).alias("masked")).distinct()


def structure_view(spark, d):
    c = F.regexp_replace("content", r"[0-9]+(?:\.[0-9]+)?", "<NUM>")
    return _posts(spark, d).filter("content is not null").groupBy(F.md5(c).alias("shape")).agg(F.countDistinct("id").alias("n_posts"))


def dialogue_share(spark, d):
    c = F.col("content")
    return _posts(spark, d).filter("content is not null").select("id", F.size(T.dialogue(c)).alias("n_quotes"), F.round(T.dialogue_share(c), 6).alias("share"), F.length(T.narration(c)).alias("n_narration")).distinct()


def punct_signature_match(spark, d):
    s = T.punctuation_signature(F.col("content"))
    return _posts(spark, d).filter("content is not null").groupBy(s.alias("signature")).agg(F.countDistinct("id").alias("n")).filter("n > 1")


def multilabel_tags(spark, d):
    return _posts(spark, d).filter("content is not null").select("id", F.array_join(T.tags(F.col("content"), T.INTENTS), ",").alias("tags")).distinct()


def tag_counts_examples(spark, d):
    """Posts per act, with the three least ids as examples."""
    t = _posts(spark, d).filter("content is not null").select("id", F.explode(T.tags(F.col("content"), ACTS)).alias("act")).distinct()
    from pyspark.sql import Window as W

    ranked = t.withColumn("rn", F.row_number().over(W.partitionBy("act").orderBy("id")))
    # Only the first three of each act are gathered; the counts are combined before the shuffle.
    first = ranked.filter("rn <= 3").groupBy("act").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return t.groupBy("act").agg(F.count("*").alias("n")).join(F.broadcast(first), "act")


def anchor_occurrences(spark, d):
    """Reply marks by line, with what stands before and after them."""
    x = _posts(spark, d).filter("content is not null").select("id", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line")).distinct()
    m = x.select("id", "line_no", "line", F.regexp_extract("line", r"^(.*?)>>([0-9]+)(.*)$", 1).alias("before"), F.regexp_extract("line", r"^(.*?)>>([0-9]+)(.*)$", 2).alias("target"), F.regexp_extract("line", r"^(.*?)>>([0-9]+)(.*)$", 3).alias("after")).filter("target <> ''")
    b, a = F.trim("before"), F.trim("after")
    placement = F.when((b == "") & (a == ""), "standalone").when(b == "", "prefix").when(a == "", "suffix").otherwise("inline")
    return m.groupBy(placement.alias("placement")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_posts"))


def line_category_counts(spark, d):
    return read_table(spark, d, "sections").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("line").alias("n_lines"))


def perturbation_delta(spark, d):
    """How much the lengths and stop rates of contents move under three perturbations."""
    c = F.col("content")
    rate = lambda t: F.regexp_count(t, F.lit("。")) / F.greatest(F.length(F.regexp_replace(t, r"[ \n]", "")), F.lit(1))
    views = {"reversed": T.reversed_lines(c), "flattened": T.flattened(c), "stopped": T.with_stops(c)}
    base = _posts(spark, d).filter("content is not null").select("id", "content").distinct()
    long = base.select("id", rate(c).alias("r0"), F.explode(F.create_map(*[x for k, v in views.items() for x in (F.lit(k), rate(v))])).alias("kind", "r1"))
    delta = F.col("r1") - F.col("r0")
    return long.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.avg((F.abs(delta) < 0.01).cast("double")), 6).alias("share_small"), F.count(F.when(F.abs(delta) < 1e-10, 1)).alias("n_same")
    )


def negation_counts(spark, d):
    """Negations left after idioms that only look like one are removed."""
    c = F.regexp_replace("content", "しかない|に違いない|かもしれない|じゃないのか|はずなんだ", "")
    return _posts(spark, d).filter("content is not null").select("id", F.regexp_count(c, F.lit("ない|ません|なかった|not |n’t |nicht |pas ")).alias("n")).distinct()


def hash_split(spark, d):
    """The split of each text by the first 32 bits of its SHA-256."""
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8), 16, 10).cast("long") % 10
    return _docs(spark, d).select("doc_id", F.when(h < 7, "train").when(h < 9, "validation").otherwise("test").alias("split"))


_LINES = r"string_split(replace(text, chr(13)||chr(10), chr(10)), chr(10))"
_TAGS = "case when len(t) = 0 then ['{d}'] else t end"


def _tags_sql(rules, col, default):
    items = ", ".join(f"case when regexp_matches({col}, '{p}') then '{k}' end" for k, p in rules.items())
    return f"case when len(list_filter([{items}], lambda x: x is not null)) = 0 then ['{default}'] else list_filter([{items}], lambda x: x is not null) end"


_KEY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(content), 'ς', 'σ'), '(?:>>|＞＞)[ \\t\\n\\r]*[0-9]+', ' ', 'g'), "
    "'(?:>>|＞＞)[ \\t\\n\\r]*[a-zぁ-んァ-ヶ一-龠々ー]{1,20}( |\\t|\\n|\\r|$)', ' \\1', 'g'), '" + BLANK_SQL + "+', ' ', 'g'))"
)
_RATE = "(length({0}) - length(replace({0}, '。', ''))) / greatest(length(regexp_replace({0}, '[ \\n]', '', 'g')), 1)"
_STOPPED = "array_to_string(list_transform(string_split(content, chr(10)), lambda x: case when regexp_matches(trim(x), '[^。！？!?.…]$') then x || '。' else x end), chr(10))"

QUERIES = {
    f.__name__: f
    for f in (
        log_line_counts, html_headings, html_text_lengths, search_key, presence_key, sentence_counts, word_freq_topk, masked_view, structure_view, dialogue_share,
        punct_signature_match, multilabel_tags, tag_counts_examples, anchor_occurrences, line_category_counts, perturbation_delta, negation_counts, hash_split,
    )
}

ORACLE = {
    "log_line_counts": f"select doc_id, len({_LINES}) as n_lines, len(list_filter({_LINES}, lambda x: regexp_matches(x, '[^ ]'))) as n_filled from documents where text is not null",
    "html_headings": r"select doc_id, pos - 1 as pos, h[pos] as heading from (select doc_id, h, unnest(range(1, len(h) + 1)) as pos from (select doc_id, regexp_extract_all(text, '<h1>([^\n]*?)</h1>', 1) as h from documents))",
    "html_text_lengths": r"select doc_id, length(regexp_replace(regexp_replace(text, '</h[1-6]>', chr(10), 'g'), '<[^>]+>', '', 'g')) as n from documents where text like '%<%'",
    "search_key": f"select distinct id, {_KEY} as key from posts",
    "presence_key": f"select distinct id, regexp_replace({_KEY}, '[ 。、，．！？!?「」『』（）()【】\\[\\]]+', '', 'g') as key from posts",
    "sentence_counts": r"select doc_id, len(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*')) as n from documents where text is not null",
    "word_freq_topk": f"select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{LETTERS_SQL}')) as word from documents) group by word order by n desc, word limit 100",
    "masked_view": "select distinct id, trim(regexp_replace(regexp_replace(content, 'https?://[^ \\t\\n\\r\\x{3000}]+|>>[0-9]+', '□', 'g'), '" + BLANK_SQL + "+', ' ', 'g')) as masked from posts",
    "structure_view": r"select md5(regexp_replace(content, '[0-9]+(?:\.[0-9]+)?', '<NUM>', 'g')) as shape, count(distinct id) as n_posts from posts where content is not null group by 1",
    "dialogue_share": "select distinct id, len(q) as n_quotes, round(coalesce(list_sum(list_transform(q, lambda x: length(x))), 0) / greatest(length(content), 1), 6) as share, length(regexp_replace(content, '「[^」]{2,}」|『[^』]{2,}』', '', 'g')) as n_narration from (select id, content, regexp_extract_all(content, '「[^」]{2,}」|『[^』]{2,}』') as q from posts where content is not null)",
    "punct_signature_match": r"select regexp_replace(content, '[^。、，．！？!?,.…\n]', '', 'g') as signature, count(distinct id) as n from posts where content is not null group by 1 having count(distinct id) > 1",
    "multilabel_tags": f"select distinct id, array_to_string({_tags_sql(T.INTENTS, 'content', 'general')}, ',') as tags from posts where content is not null",
    "tag_counts_examples": f"with t as (select distinct id, unnest({_tags_sql(ACTS, 'content', 'general')}) as act from posts where content is not null), r as (select *, row_number() over (partition by act order by id) as rn from t) select act, count(*) as n, string_agg(case when rn <= 3 then id end, ',' order by id) as examples from r group by act",
    "anchor_occurrences": r"with x as (select distinct id, line_no, ls[line_no] as line from (select id, ls, unnest(range(1, len(ls) + 1)) as line_no from (select id, string_split(replace(content, chr(13)||chr(10), chr(10)), chr(10)) as ls from posts where content is not null))), m as (select id, trim(regexp_extract(line, '^(.*?)>>([0-9]+)(.*)$', 1)) as b, trim(regexp_extract(line, '^(.*?)>>([0-9]+)(.*)$', 3)) as a from x where regexp_matches(line, '>>[0-9]')) select case when b = '' and a = '' then 'standalone' when b = '' then 'prefix' when a = '' then 'suffix' else 'inline' end as placement, count(*) as n, count(distinct id) as n_posts from m group by 1",
    "line_category_counts": "select category, count(*) as n, count(distinct line) as n_lines from sections group by category",
    "perturbation_delta": "with b as (select distinct id, content from posts where content is not null), v as (select id, content, 'reversed' as kind, array_to_string(list_reverse(string_split(content, chr(10))), chr(10)) as v from b union all select id, content, 'flattened', replace(content, chr(10), '') from b union all select id, content, 'stopped', "
    + _STOPPED + " from b), r as (select kind, " + _RATE.format("v") + " - " + _RATE.format("content") + " as d from v) select kind, count(*) as n, round(avg(d), 6) as mean_delta, round(avg((abs(d) < 0.01)::int::double), 6) as share_small, count(case when abs(d) < 1e-10 then 1 end) as n_same from r group by kind",
    "negation_counts": "select distinct id, len(regexp_extract_all(regexp_replace(content, 'しかない|に違いない|かもしれない|じゃないのか|はずなんだ', '', 'g'), 'ない|ません|なかった|not |n’t |nicht |pas ')) as n from posts where content is not null",
    "hash_split": "select doc_id, case when h < 7 then 'train' when h < 9 then 'validation' else 'test' end as split from (select doc_id, ('0x' || substr(sha256(coalesce(text, '')), 1, 8))::bigint % 10 as h from documents)",
}
