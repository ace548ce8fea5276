"""Queries of joins, windows, sets, samples and evaluation data."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corpuskit.functions import text as T
from corpuskit.operators import ordered as O
from corpuskit.operators.components import components, node_name
from corpuskit.operators.lineage import clean_key, cut, read_table
from corpuskit.plans.text import ACTS


def _t(name):
    return lambda spark, d: read_table(spark, d, name)


posts, docs, sections, comparisons, preferences, boards, methods, events = map(_t, "posts documents sections comparisons preferences boards methods events".split())


def latest_posts(spark, d):
    """The last ingested version of each post."""
    return O.latest(posts(spark, d).filter("id is not null").select("id", "ingestedAt", "board", "content"), ["id"], ["ingestedAt"])


def posts_with_board(spark, d):
    """Left join to the board's name and language, counted."""
    p = posts(spark, d).join(boards(spark, d), "board", "left")
    return p.groupBy(F.coalesce("boardName", F.lit("unknown")).alias("board_name"), F.col("lang")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def known_board_semi(spark, d):
    return posts(spark, d).join(boards(spark, d), "board", "left_semi").groupBy("board").agg(F.countDistinct("id").alias("n"))


def unknown_board_anti(spark, d):
    return posts(spark, d).join(boards(spark, d), "board", "left_anti").select("id", "board").distinct()


def post_series_bridge(spark, d):
    """One row per post with the split names that its comparisons carry."""
    c = comparisons(spark, d).select(F.col("postId").alias("id"), clean_key("split").alias("s")).filter("s is not null").distinct()
    return posts(spark, d).select("id").distinct().join(c, "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("splits"))


def token_lexicon_semi(spark, d):
    """Documents that have a method name part as a whole word."""
    lex = methods(spark, d).select(F.explode(F.split("method", "-")).alias("word")).distinct()
    w = docs(spark, d).select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return w.join(F.broadcast(lex), "word").groupBy("word").agg(F.count("*").alias("n_docs"))


def length_band_join(spark, d):
    """For each comparison with an id hash divisible by 50 the number of sources of half to
    double its length: lengths are counted first, bands meet on their power of two."""
    n = comparisons(spark, d).select("comparisonId", F.length("source").alias("n")).distinct().filter("n > 0")
    q = n.filter(F.conv(F.substring(F.sha2("comparisonId", 256), 1, 8), 16, 10).cast("long") % 50 == 0)
    sizes = n.groupBy("n").agg(F.count("*").alias("k")).withColumn("band", F.floor(F.log2("n")))
    near = q.withColumn("band", F.explode(F.sequence(F.floor(F.log2("n")) - 1, F.floor(F.log2("n")) + 1)))
    s = near.join(sizes.select(F.col("n").alias("m"), "k", "band"), "band").filter("2 * m >= n and m <= 2 * n")
    return s.groupBy("comparisonId").agg((F.sum("k") - 1).alias("n_near"))


def section_forward_fill(spark, d):
    """The title that each ledger line stands under, by line."""
    s = sections(spark, d).filter("line is not null").groupBy("line").agg(F.min(F.struct("category", "text")).alias("x")).select("line", "x.category", "x.text")
    f = O.forward_filled(s, ["line"], F.when(F.col("category") == "section_title", F.col("text")), "title")
    return f.groupBy("title").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


def full_outer_mismatch(spark, d):
    """Posts whose number of comparisons differs from that of their section lines."""
    c = comparisons(spark, d).filter("postId is not null").groupBy(F.col("postId").alias("id")).agg(F.countDistinct("comparisonId").alias("a"))
    s = sections(spark, d).filter("post_id is not null").groupBy(F.col("post_id").alias("id")).agg(F.countDistinct("line").alias("b"))
    return c.join(s, "id", "full").select("id", F.coalesce("a", F.lit(0)).alias("n_comparisons"), F.coalesce("b", F.lit(0)).alias("n_lines")).filter("n_comparisons <> n_lines")


def exact_dedup_keep_first(spark, d):
    """Each document's first copy; copies are found by digest and its collisions by text."""
    x = docs(spark, d).filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    first = x.groupBy("h", "text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return x.join(first, ["h", "text"]).select("doc_id", "first_id", "copies")


def dup_group_counts(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).filter("n > 1").groupBy("n").agg(F.count("*").alias("n_groups"))


def multiset_difference(spark, d):
    """Numbers of the source that the left text does not repeat as often."""
    c = comparisons(spark, d).filter("source is not null and leftText is not null").select("comparisonId", "source", "leftText").distinct()
    num = lambda col: F.explode(F.regexp_extract_all(col, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("v")
    a = c.select("comparisonId", num("source")).groupBy("comparisonId", "v").agg(F.count("*").alias("a"))
    b = c.select("comparisonId", num("leftText")).groupBy("comparisonId", "v").agg(F.count("*").alias("b"))
    return a.join(b, ["comparisonId", "v"], "left").select("comparisonId", "v", (F.col("a") - F.coalesce("b", F.lit(0))).alias("missing")).filter("missing > 0")


def latest_per_key(spark, d):
    """The answer of the highest revision for each comparison, annotator and dimension."""
    p = preferences(spark, d).filter("comparisonId is not null").select("comparisonId", clean_key("annotatorId").alias("annotator"), "dimension", "revision", "savedAt", clean_key("choice").alias("choice"))
    return O.latest(p, ["comparisonId", "annotator", "dimension"], ["revision", "savedAt"])


def annotator_disagreement(spark, d):
    """Share of the items with several answers whose answers differ; null without any."""
    x = latest_per_key(spark, d).filter("choice is not null").groupBy("comparisonId", "dimension").agg(F.count("*").alias("n"), F.countDistinct("choice").alias("k")).filter("n > 1")
    return x.groupBy("dimension").agg(F.count("*").alias("n_items"), F.round(F.avg((F.col("k") > 1).cast("double")), 6).alias("disagreement"))


def choice_histogram(spark, d):
    return latest_per_key(spark, d).groupBy("dimension", "choice").agg(F.count("*").alias("n"), F.countDistinct("annotator").alias("n_annotators"))


def review_completeness(spark, d):
    """Comparisons by how many of the three dimensions have an answer."""
    n = latest_per_key(spark, d).filter("choice is not null").groupBy("comparisonId").agg(F.countDistinct("dimension").alias("k"))
    c = comparisons(spark, d).select("comparisonId").distinct().join(n, "comparisonId", "left")
    return c.groupBy(F.coalesce("k", F.lit(0)).alias("n_dimensions")).agg(F.count("*").alias("n"))


def status_algebra(spark, d):
    """Status of a comparison: a failed check before an unknown before a passed one."""
    c = comparisons(spark, d)
    checks = F.array(F.when(F.col("source").isNull() | F.col("leftText").isNull(), "unknown").when(F.col("leftText") == F.col("source"), "fail").otherwise("pass"), F.when(F.col("rightText").isNull(), "unknown").when(F.col("rightText") == F.col("source"), "fail").otherwise("pass"))
    s = F.when(F.array_contains(checks, "fail"), "rejected").when(F.array_contains(checks, "unknown"), "needs_review").otherwise("passed")
    return c.groupBy(s.alias("status")).agg(F.countDistinct("comparisonId").alias("n"))


def leakage_check(spark, d):
    """Groups whose records carry several splits."""
    c = comparisons(spark, d).select(clean_key("group").alias("grp"), clean_key("split").alias("s")).filter("grp is not null and s is not null")
    return c.groupBy("grp").agg(F.countDistinct("s").alias("n_splits")).filter("n_splits > 1")


def blind_pairs(spark, d):
    """Pairs of methods shown on one source, the side to flip by hash parity, id of 24 digits."""
    m = comparisons(spark, d).filter("leftMethod is not null and rightMethod is not null and `group` is not null").select(F.col("group").alias("g"), F.least("leftMethod", "rightMethod").alias("a"), F.greatest("leftMethod", "rightMethod").alias("b")).distinct()
    h = F.sha2(F.concat_ws(":", "g", "a", "b"), 256)
    return m.select(F.substring(h, 1, 24).alias("pair_id"), "g", "a", "b", (F.conv(F.substring(h, 64, 1), 16, 10).cast("int") % 2 == 1).alias("flip"))


def move_transitions(spark, d):
    """The forty commonest steps between acts of successive lines, equal ones collapsed,
    lines without an act dropped, contents with at least two acts."""
    p = latest_posts(spark, d).filter("content is not null").select("id", F.posexplode(T.lines(F.col("content"))).alias("n", "line"))
    acts = F.lit(None).cast("string")
    for k, v in reversed(ACTS.items()):
        acts = F.when(F.col("line").rlike(v), k).otherwise(acts)
    m = p.select("id", "n", acts.alias("act")).filter("act is not null")
    w = W.partitionBy("id").orderBy("n")
    m = m.withColumn("before", F.lag("act").over(w)).filter("before is not null and before <> act")
    return m.groupBy(F.col("before"), F.col("act")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "before", "act").limit(40)


def kwic_following(spark, d):
    """What follows an expression: counts of the class of the next sign, per expression."""
    out = []
    p = latest_posts(spark, d).filter("content is not null").select("id", "content")
    for word in ("んだよな", "らしい", "のほうが", "からな"):
        hit = p.filter(F.contains("content", F.lit(word)))
        out.append(hit.select(F.lit(word).alias("expression"), F.explode(F.slice(F.split("content", word, -1), 2, 2**31 - 1)).alias("after")))
    x = out[0]
    for o in out[1:]:
        x = x.unionByName(o)
    x = x.withColumn("head", F.substring("after", 1, 1))
    cls = F.when(F.col("head") == "", "end").when(F.col("head").isin("。", "！", "？", "、"), "stop").when(F.col("head") == "\n", "line").when(F.col("head").rlike("[ぁ-ん]"), "kana").otherwise("other")
    return x.groupBy("expression", cls.alias("following")).agg(F.count("*").alias("n"))


def actor_carry_forward(spark, d):
    """Lines of each thread under the last named poster, in order of response. Threads are
    filled in ranges of a common order, as one thread may be large."""
    p = latest_rows(spark, d)
    named = F.when(F.col("name").isNotNull(), F.struct("threadUrl", "name"))
    f = O.forward_filled(p, ["threadUrl", "r", "id"], named, "last")
    return f.select("id", F.when(F.col("last.threadUrl") == F.col("threadUrl"), F.col("last.name")).otherwise("nobody").alias("actor"))


def latest_rows(spark, d):
    p = posts(spark, d).filter("id is not null and threadUrl is not null").select("id", "ingestedAt", "threadUrl", F.coalesce(F.col("responseNumber").try_cast("int"), F.lit(0)).alias("r"), "name")
    return O.latest(p, ["id"], ["ingestedAt"])


def first_after(spark, d):
    """Per thread the first response, the first named one after it and their distance."""
    p = latest_rows(spark, d)
    a = p.groupBy("threadUrl").agg(F.min("r").alias("opening"))
    b = p.join(a, "threadUrl").filter("r > opening and name is not null").groupBy("threadUrl", "opening").agg(F.min("r").alias("named"))
    return b.withColumn("distance", F.col("named") - F.col("opening"))


def modal_surface(spark, d):
    """The commonest spelling of each source, ties to the least."""
    s = docs(spark, d).filter("source is not null").groupBy(clean_key("source").alias("key"), "source").agg(F.count("*").alias("n"))
    first = F.array_min(F.collect_list(F.struct((-F.col("n")).alias("m"), "source")))["source"]
    # Spellings of one source, not its documents, are gathered.
    return s.groupBy("key").agg(first.alias("surface"), F.sum("n").alias("n"), F.count("*").alias("n_spellings"))


def support_shortest_two(spark, d):
    """Per act the posts that show it and the two shortest of them."""
    p = latest_posts(spark, d).filter("content is not null").select("id", F.length("content").alias("n"), F.explode(T.tags(F.col("content"), ACTS)).alias("act"))
    top = p.withColumn("rn", F.row_number().over(W.partitionBy("act").orderBy("n", "id"))).filter("rn <= 2").groupBy("act").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias("evidence"))
    return p.groupBy("act").agg(F.countDistinct("id").alias("support")).join(F.broadcast(top), "act")


def systematic_sample(spark, d):
    """Every seventh document of 12 to 360 characters, by id."""
    x = docs(spark, d).filter(F.length("text").between(12, 360)).select("doc_id")
    return O.systematic(x, ["doc_id"], 7)


def capped_hash_sample(spark, d):
    """At most two posts of a poster and then twelve of a thread, in hash order."""
    p = latest_poster(spark, d)
    return O.capped(p, [("posterId", 2), ("threadUrl", 12)], F.sha2(F.concat(F.lit("audit:"), "id"), 256)).select("id")


def latest_poster(spark, d):
    p = posts(spark, d).filter("id is not null and threadUrl is not null and posterId is not null").select("id", "ingestedAt", "threadUrl", "posterId")
    return O.latest(p, ["id"], ["ingestedAt"])


def hash_ordered_sample(spark, d):
    """The hundred documents that come first in hash order, a seeded sample."""
    return docs(spark, d).select("doc_id", F.sha2(F.concat(F.lit("seed:"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(100)


def diversity_pick(spark, d):
    """Ten documents by length, first of unseen languages, then the longest that are left."""
    x = docs(spark, d).filter("text is not null and lang is not null").select("doc_id", "lang", F.length("text").alias("n"))
    x = x.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "doc_id"))).filter("k <= 10")
    return x.orderBy((F.col("k") > 1).cast("int"), F.desc("n"), "doc_id").limit(10).select("doc_id", "lang", "n")


def pareto_front(spark, d):
    """Orders that no other equals or exceeds in price and date and exceeds in one."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").cast("string").alias("day"), F.unix_timestamp("o_orderdate").alias("t"))
    return O.skyline(o, ["o_totalprice", "t"]).select("o_orderkey", "o_totalprice", "day")


def group_split_components(spark, d):
    """Comparisons tied by group, post or family; the split of a tied set by the hash of its ids."""
    c = comparisons(spark, d).filter("comparisonId is not null").select(node_name("c", F.col("comparisonId")).alias("c"), "comparisonId", *[node_name(k, F.col(n)).alias(k) for k, n in (("g", "group"), ("p", "postId"), ("f", "family"))])
    roots = cut(components(c.select(F.array_compact(F.array("c", "g", "p", "f")).alias("keys"))))
    m = c.select("c", "comparisonId").distinct().join(roots.withColumnRenamed("node", "c"), "c")
    # The least member names a set; gathering all members of a hot set would be unbounded.
    least = m.groupBy("root").agg(F.min("comparisonId").alias("least"), F.count("*").alias("n"))
    h = F.conv(F.substring(F.sha2("least", 256), 1, 8), 16, 10).cast("long") % 10
    return m.join(least, "root").select("comparisonId", F.col("least").alias("set_id"), "n", F.when(h < 7, "train").when(h < 9, "validation").otherwise("test").alias("split"))


def sessionize_30m(spark, d):
    s = O.sessions(events(spark, d).filter("user_id is not null and ts is not null"), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("most_events"))


def recent20_per_user(spark, d):
    e = events(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 20")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.round(F.sum("value"), 4).alias("total"))


def json_props(spark, d):
    """Fields of a JSON column."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, d).groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def mean_all_finite(spark, d):
    """Mean of a user's values, null unless all are there."""
    e = events(spark, d).groupBy("user_id").agg(F.when((F.count("*") == F.count("value")), F.round(F.avg("value"), 4)).alias("mean"))
    return e


def star_revenue(spark, d):
    """Revenue by region and year over the star schema, partial sums before the joins."""
    l = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("rev"))
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("r_name", "y").agg(F.round(F.sum("rev"), 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_posts, posts_with_board, known_board_semi, unknown_board_anti, post_series_bridge, token_lexicon_semi, length_band_join, section_forward_fill, full_outer_mismatch, exact_dedup_keep_first, dup_group_counts,
        multiset_difference, latest_per_key, annotator_disagreement, choice_histogram, review_completeness, status_algebra, leakage_check, blind_pairs, move_transitions, kwic_following, actor_carry_forward, first_after,
        modal_surface, support_shortest_two, systematic_sample, capped_hash_sample, hash_ordered_sample, diversity_pick, pareto_front, group_split_components, sessionize_30m, recent20_per_user, json_props, mean_all_finite, star_revenue,
    )
}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x{{3000}}\x{{00a0}}]+|[\s\x{{3000}}\x{{00a0}}]+$', '', 'g')), '')"
_LP = "lp as (select id, ingestedAt, board, content from (select *, row_number() over (partition by id order by ingestedAt desc nulls last, board desc nulls last, content desc nulls last) as rn from posts where id is not null) where rn = 1)"
_LA = "la as (select * exclude rn from (select comparisonId, annotator, dimension, revision, savedAt, choice, row_number() over (partition by comparisonId, annotator, dimension order by revision desc nulls last, savedAt desc nulls last, choice desc nulls last) as rn from (select comparisonId, " + _KEY.format("annotatorId") + " as annotator, dimension, revision, savedAt, " + _KEY.format("choice") + " as choice from preferences where comparisonId is not null)) where rn = 1)"
_LR = "lr as (select id, threadUrl, r, name from (select id, threadUrl, coalesce(try_cast(responseNumber as int), 0) as r, name, row_number() over (partition by id order by ingestedAt desc nulls last, threadUrl desc nulls last, coalesce(try_cast(responseNumber as int), 0) desc, name desc nulls last) as rn from posts where id is not null and threadUrl is not null) where rn = 1)"
_ACT = "case " + " ".join(f"when regexp_matches(line, '{v}') then '{k}'" for k, v in ACTS.items()) + " end"
_ACTL = "list_filter([" + ", ".join(f"case when regexp_matches(content, '{v}') then '{k}' end" for k, v in ACTS.items()) + "], lambda x: x is not null)"
_CLS = "case when h = '' then 'end' when h in ('。', '！', '？', '、') then 'stop' when h = chr(10) then 'line' when regexp_matches(h, '[ぁ-ん]') then 'kana' else 'other' end"
ORACLE = {
    "latest_posts": "with " + _LP + " select * from lp",
    "posts_with_board": "select coalesce(boardName, 'unknown') as board_name, lang, count(*) as n, count(distinct id) as n_ids from posts p left join boards b on p.board = b.board group by 1, 2",
    "known_board_semi": "select board, count(distinct id) as n from posts where board in (select board from boards) group by 1",
    "unknown_board_anti": "select distinct id, board from posts p where not exists (select 1 from boards b where b.board = p.board)",
    "post_series_bridge": "select id, string_agg(s, ',' order by s) as splits from (select distinct postId as id, " + _KEY.format("split") + " as s from comparisons) where s is not null and id in (select id from posts) group by id",
    "token_lexicon_semi": r"select word, count(*) as n_docs from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as word from documents) where word in (select unnest(string_split(method, '-')) from methods) group by word",
    "length_band_join": "with n as (select distinct comparisonId, length(source) as n from comparisons where length(source) > 0) select a.comparisonId, count(*) - 1 as n_near from n a join n b on 2 * b.n >= a.n and b.n <= 2 * a.n where ('0x' || substr(sha256(a.comparisonId), 1, 8))::bigint % 50 = 0 group by 1",
    "modal_surface": "with s as (select " + _KEY.format("source") + " as key, source, count(*) as n from documents where source is not null group by 1, 2) select key, arg_min(source, struct_pack(m := -n, s := source)) as surface, sum(n) as n, count(*) as n_spellings from s group by key",
    "group_split_components": "with recursive e as (select distinct comparisonId as c, unnest(list_filter(['g' || \"group\", 'p' || postId, 'f' || family], lambda x: x is not null)) as k from comparisons where comparisonId is not null), r(c, d) as (select distinct comparisonId, comparisonId from comparisons where comparisonId is not null union select r.c, b.c from r join e a on a.c = r.d join e b on b.k = a.k), m as (select c, min(d) as set_id, count(*) as n from r group by c), h as (select *, ('0x' || substr(sha256(set_id), 1, 8))::bigint % 10 as h from m) select c as comparisonId, set_id, n, case when h < 7 then 'train' when h < 9 then 'validation' else 'test' end as split from h",
    "section_forward_fill": "with s as (select line, min(struct_pack(category := category, text := text)) as x from sections where line is not null group by line), f as (select line, last_value(case when x.category = 'section_title' then x.text end ignore nulls) over (order by line rows between unbounded preceding and current row) as title from s) select title, count(*) as n_lines, min(line) as first_line from f group by title",
    "full_outer_mismatch": "with c as (select postId as id, count(distinct comparisonId) as a from comparisons where postId is not null group by 1), s as (select post_id as id, count(distinct line) as b from sections where post_id is not null group by 1) select id, coalesce(a, 0) as n_comparisons, coalesce(b, 0) as n_lines from c full join s using (id) where coalesce(a, 0) <> coalesce(b, 0)",
    "exact_dedup_keep_first": "select doc_id, min(doc_id) over (partition by text) as first_id, count(*) over (partition by text) as copies from documents where text is not null",
    "dup_group_counts": "select n, count(*) as n_groups from (select text, count(*) as n from documents group by text having count(*) > 1) group by n",
    "multiset_difference": r"with c as (select distinct comparisonId, source, leftText from comparisons where source is not null and leftText is not null), a as (select comparisonId, v, count(*) as a from (select comparisonId, unnest(regexp_extract_all(source, '[0-9]+(?:\.[0-9]+)?')) as v from c) group by 1, 2), b as (select comparisonId, v, count(*) as b from (select comparisonId, unnest(regexp_extract_all(leftText, '[0-9]+(?:\.[0-9]+)?')) as v from c) group by 1, 2) select comparisonId, v, a - coalesce(b, 0) as missing from a left join b using (comparisonId, v) where a - coalesce(b, 0) > 0",
    "latest_per_key": "with " + _LA + " select * from la",
    "annotator_disagreement": "with " + _LA + " select dimension, count(*) as n_items, round(avg((k > 1)::int::double), 6) as disagreement from (select comparisonId, dimension, count(*) as n, count(distinct choice) as k from la where choice is not null group by 1, 2) where n > 1 group by 1",
    "choice_histogram": "with " + _LA + " select dimension, choice, count(*) as n, count(distinct annotator) as n_annotators from la group by 1, 2",
    "review_completeness": "with " + _LA + " select coalesce(k, 0) as n_dimensions, count(*) as n from (select distinct comparisonId from comparisons) c left join (select comparisonId, count(distinct dimension) as k from la where choice is not null group by 1) using (comparisonId) group by 1",
    "status_algebra": "select case when leftText = source or rightText = source then 'rejected' when source is null or leftText is null or rightText is null then 'needs_review' else 'passed' end as status, count(distinct comparisonId) as n from comparisons group by 1",
    "leakage_check": "select grp, count(distinct s) as n_splits from (select " + _KEY.format('"group"') + " as grp, " + _KEY.format("split") + " as s from comparisons) where grp is not null and s is not null group by grp having count(distinct s) > 1",
    "blind_pairs": "select substr(h, 1, 24) as pair_id, g, a, b, ('0x' || substr(h, 64, 1))::int % 2 = 1 as flip from (select *, sha256(g || ':' || a || ':' || b) as h from (select distinct \"group\" as g, least(leftMethod, rightMethod) as a, greatest(leftMethod, rightMethod) as b from comparisons where leftMethod is not null and rightMethod is not null and \"group\" is not null))",
    "move_transitions": "with " + _LP + ", l as (select id, n, ls[n] as line from (select id, ls, unnest(range(1, len(ls) + 1)) as n from (select id, string_split(replace(content, chr(13)||chr(10), chr(10)), chr(10)) as ls from lp where content is not null))), m as (select id, n, " + _ACT + " as act from l), b as (select act, lag(act) over (partition by id order by n) as before from m where act is not null) select before, act, count(*) as n from b where before is not null and before <> act group by 1, 2 order by n desc, before, act limit 40",
    "kwic_following": "with " + _LP + ", e as (select unnest(['んだよな', 'らしい', 'のほうが', 'からな']) as expression), x as (select expression, unnest(string_split(content, expression)[2:]) as after from lp, e where contains(content, expression)), h as (select expression, substring(after, 1, 1) as h from x) select expression, " + _CLS + " as following, count(*) as n from h group by 1, 2",
    "actor_carry_forward": "with " + _LR + " select id, coalesce(last_value(name ignore nulls) over (partition by threadUrl order by r, id rows between unbounded preceding and current row), 'nobody') as actor from lr",
    "first_after": "with " + _LR + ", a as (select threadUrl, min(r) as opening from lr group by 1) select threadUrl, opening, min(r) as named, min(r) - opening as distance from lr join a using (threadUrl) where r > opening and name is not null group by 1, 2",
    "support_shortest_two": "with " + _LP + ", p as (select id, length(content) as n, unnest(case when len(" + _ACTL + ") = 0 then ['general'] else " + _ACTL + " end) as act from lp where content is not null), r as (select *, row_number() over (partition by act order by n, id) as rn from p) select act, count(distinct id) as support, string_agg(case when rn <= 2 then id end, ',' order by rn) as evidence from r group by act",
    "systematic_sample": "select doc_id from (select doc_id, row_number() over (order by doc_id) as rn from documents where length(text) between 12 and 360) where (rn - 1) % 7 = 0",
    "capped_hash_sample": "with p as (select id, threadUrl, posterId, sha256('audit:' || id) as h from (select *, row_number() over (partition by id order by ingestedAt desc nulls last, threadUrl desc, posterId desc) as rn from posts where id is not null and threadUrl is not null and posterId is not null) where rn = 1), a as (select *, row_number() over (partition by posterId order by h) as k from p), b as (select *, row_number() over (partition by threadUrl order by h) as m from a where k <= 2) select id from b where m <= 12",
    "hash_ordered_sample": "select doc_id, sha256('seed:' || doc_id::varchar) as h from documents order by h limit 100",
    "diversity_pick": "select doc_id, lang, n from (select doc_id, lang, length(text) as n, row_number() over (partition by lang order by length(text) desc, doc_id) as k from documents where text is not null and lang is not null) order by (k > 1)::int, n desc, doc_id limit 10",
    "pareto_front": "select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day from orders a where not exists (select 1 from orders b where b.o_totalprice >= a.o_totalprice and b.o_orderdate >= a.o_orderdate and (b.o_totalprice > a.o_totalprice or b.o_orderdate > a.o_orderdate))",
    "sessionize_30m": "with s as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as b from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)), n as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from s), c as (select user_id, k, count(*) as n from n group by 1, 2) select user_id, count(*) as n_sessions, max(n) as most_events from c group by 1",
    "recent20_per_user": "select user_id, count(*) as n, min(event_id) as least, round(sum(value), 4) as total from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 20 group by 1",
    "json_props": "select (props->>'$.k')::int % 10 as bucket, count(*) as n, sum((props->>'$.k')::int) as total from events group by 1",
    "mean_all_finite": "select user_id, case when count(*) = count(value) then round(avg(value), 4) end as mean from events group by 1",
    "star_revenue": "select r_name, year(o_orderdate) as y, round(sum((l_extendedprice * (1 - l_discount))::decimal(18,4)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
}
