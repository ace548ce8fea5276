"""Stylometric features and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuskit.functions import text as T

# Rates per character that is not blank.
RATES = {
    "halfwidth_kana": "[ｦ-ﾟ]", "fullwidth_latin": "[Ａ-Ｚａ-ｚ]", "first_person": "俺|おれ|僕|私", "second_person": "お前|おまえ",
    "connective": "やはり|しかも|さらに|だが|なので|だから|ところが|すると|その結果", "certainty": "明らか|確実|絶対|真実|事実|決ま|間違いない|高確率",
    "comparison": "最強|圧倒|一級|一般人|格|ランク|上|下|より|違い", "amplification": "かなり|超|最強|圧倒|絶望|致命|ものすご|すさまじ|大量|巨大", "punctuation": "[。、！？!?]",
}
# Rates per hundred characters of the structural profile.
DENSITIES = {
    "periods": "。", "commas": "、", "questions": "[?？]", "exclaims": "[!！]", "quotes": "[「『]", "parens": "[（(]", "ellipsis": "[.．・]{2,}|[…‥]+", "ascii_commas": "[,，]", "spaces": "[ 　]",
    "hiragana": "[ぁ-ゖ]", "kanji": "[一-龯々]", "katakana": "[ァ-ヺ]", "half_kana": "[ｦ-ﾟ]", "latin": "[a-zA-Zａ-ｚＡ-Ｚ]", "digits": "[0-9０-９]",
    "polite": "です|ます|でした|ました|ません|でしょう", "first_person": "俺|おれ|オレ|私|僕", "second_person": "お前|おまえ|おまい|君|あんた", "connective": "だから|しかし|だが|さらに|しかも|やはり|なので|ところが|すると",
    "quotative": "という|と言う|といった|と言った|と言うと|と聞く", "hedge": "かもしれ|たぶん|多分|おそらく|思う|みたい|らしい", "nda_ga": "んだが", "karana": "からな",
    "repeat_symbol": "!{2,}|[?]{2,}|！{2,}|？{2,}|ｗ{2,}|w{2,}|ー{2,}|～{2,}", "be": r"だべ|べ[?？]|べ\n?\z",
}


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def filled(c: Column) -> Column:
    """Number of characters that are not blank."""
    return F.length(F.regexp_replace(c, T.BLANK + "+", ""))


def style_features(docs: DataFrame, text: str = "content") -> DataFrame:
    """``docs`` and the fifteen style features, ratios rounded to six digits and mean
    sentence length to four; denominators are at least one. Null texts have null features."""
    c = F.col(text)
    n, s, w = F.greatest(filled(c), F.lit(1)), T.sentences_fast(c), T.words(c)
    rows = docs.withColumns({"_n": n, "_s": s, "_w": w})
    k = F.greatest(F.size("_s"), F.lit(1))
    out = {
        "length": F.length(c), "sentence_count": F.size("_s"),
        "mean_sentence": F.round(F.aggregate("_s", F.lit(0), lambda a, x: a + F.length(x)) / k, 4),
        **{name: F.round(count(c, p) / F.col("_n"), 6) for name, p in RATES.items()},
        "parenthetical": F.round(count(c, r"（[^）]*）|\([^)]*\)") / k, 6), "question": F.round(count(c, "[？?]") / k, 6),
        "diversity": F.round(F.size(F.array_distinct("_w")) / F.greatest(F.size("_w"), F.lit(1)), 6),
    }
    return rows.withColumns(out).drop("_n", "_s", "_w")


FEATURES = ["sentence_count", "mean_sentence", *RATES, "parenthetical", "question", "diversity"]


def structural_features(docs: DataFrame, text: str = "content") -> DataFrame:
    """``docs`` and the 33 structural features: logarithmic lengths, densities per hundred
    characters and line ratios."""
    c = F.col(text)
    lines = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.withColumns({"_n": F.greatest(filled(c), F.lit(1)), "_l": lines, "_k": F.transform(lines, filled)})
    k = F.greatest(F.size("_l"), F.lit(1))
    mean_line = F.coalesce(F.aggregate("_k", F.lit(0), lambda a, x: a + x) / F.nullif(F.size("_k"), F.lit(0)), F.lit(0.0))
    share = lambda p: F.size(F.filter("_l", lambda x: x.rlike(p))) / k
    out = {
        "log_chars": F.log1p(F.col("_n")), "log_lines": F.log1p(k), "log_mean_line": F.log1p(mean_line), "log_max_line": F.log1p(F.coalesce(F.array_max("_k"), F.lit(0))), "newlines": count(c, "\n") * 100 / F.col("_n"),
        **{f"d_{name}": count(c, p) * 100 / F.col("_n") for name, p in DENSITIES.items()},
        "no_stop_lines": share(r"[^。！？!?.…]$"), "no_punct_lines": share("^[^。、]*$"), "period_lines": share("。$"),
    }
    return rows.withColumns({k2: F.round(v, 6) for k2, v in out.items()}).drop("_n", "_l", "_k")


def baseline(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, sd): mean and population deviation, six digits; null values left out."""
    long = features.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("feature", "v"))
    return long.groupBy("feature").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


def quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float], discrete: bool = False) -> DataFrame:
    """(group, q_0, q_1, ...): exact quantiles of a value in each group, linear between two
    values or, if ``discrete``, the least value that as large a share does not exceed. Null values
    and groups with a null key are left out.

    Equal values are counted first; the distinct ones are ordered in ranges whose starts are
    added, so that no task holds the values of a group."""
    from corpuskit.operators.lineage import cut

    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    parts = cut(counts.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()))
    # One row per task and group.
    sums = parts.groupBy(*group, "_p").agg(F.sum("_k").alias("_t"))
    whole = W.partitionBy(*group)
    sums = sums.withColumn("_n", F.sum("_t").over(whole)).withColumn("_s", F.coalesce(F.sum("_t").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    upto = F.sum("_k").over(W.partitionBy("_p", *group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = parts.withColumn("_u", upto).join(sums, [*group, "_p"]).withColumn("_u", F.col("_u") + F.col("_s"))
    n, out, finish = F.col("_n"), [], []
    for i, p in enumerate(shares):
        place = F.ceil(F.lit(p) * n) - 1 if discrete else F.lit(p) * (n - 1)
        place = F.greatest(place, F.lit(0))
        at = lambda x: F.max(F.when((F.col("_u") - F.col("_k") <= x) & (x < F.col("_u")), F.col("_v")))
        out += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.first(place - F.floor(place)).alias(f"_f{i}")]
        between = F.when(F.col(f"_f{i}") == 0, F.col(f"_lo{i}")).otherwise(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
        finish.append((F.col(f"_lo{i}") if discrete else between).alias(f"q_{i}"))
    return ranked.groupBy(*group).agg(*out).select(*group, *finish)


def winsorised_z(rows: DataFrame, names: list[str], p: float = 0.99) -> DataFrame:
    """Each column cut at its ``p`` quantile (linear) and set against mean and population
    deviation of the cut values; a constant column has deviation 1, so z 0."""
    long = rows.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("_name", "_value"))
    # One row per column.
    cuts = {r["_name"]: r.q_0 for r in quantiles(long, ["_name"], "_value", [p]).collect()}
    cut = rows.withColumns({n: F.least(F.col(n).cast("double"), F.lit(cuts.get(n))) for n in names})
    m = cut.agg(*[x for n in names for x in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]).first()
    return cut.withColumns({n: (F.col(n) - F.lit(m[f"m_{n}"])) / F.lit(m[f"s_{n}"] or 1.0) for n in names})


def average_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` and the average rank of a value. Equal values are counted first; only the
    distinct values are ordered, in ranges whose starts are added."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_k"))
    parts = counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    from corpuskit.operators.lineage import cut

    parts = cut(parts)
    sizes = parts.groupBy("_p").agg(F.sum("_k").alias("_t"))
    # One row per task.
    starts = sizes.withColumn("_b", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    below = F.coalesce(F.sum("_k").over(W.partitionBy("_p").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = parts.withColumn("_w", below).join(F.broadcast(starts), "_p").select(value, (F.col("_b") + F.col("_w") + (F.col("_k") + 1) / 2).alias(out))
    return rows.join(ranks, value)
