"""Scalar text functions as column expressions; everything stays in the JVM.

Null gives null and empty text gives empty text or an empty array unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Blanks of every kind, spelled out, so that other engines read the pattern alike.
BLANK = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Function words that content-only tokens leave out.
STOP_WORDS = "こと これ それ あれ ため もの よう ところ いる ある する なる れる られる せる させる です ます でした ました ない だ で た は が を に へ と も の から まで より や か ね よ な し て でしょ".split()
# Intents and the patterns that show them.
INTENTS = {
    "anger": "怒|むかつ|腹が立|不愉快|うざ|ウザ|嫌|憎|許せ",
    "conflict": "勝|負け|戦|攻撃|防御|敵|倒|弱|強|殴|蹴|ボコ|競争",
    "praise": "良い|すご|素晴|見事|上手|優秀|尊敬|感心|褒め|最高",
    "criticism": "悪い|だめ|駄目|下手|間違|馬鹿|愚か|問題|失敗",
    "achievement": "成功|実力|仕事|達成|完成|手に入|取得|合格|勝利",
    "timing": "時間|遅|早|一瞬|間に合|開始|終了|急|速度|すぐ",
    "social": "仲間|友達|家族|同僚|みんな|全員|信頼|人気|学校|会社",
    "explanation": "理由|証拠|事実|真実|説明|論理|理解|判明|明らか",
    "request": "お願い|頼|ください|してほしい|必要|べき|なければ",
    "uncertainty": "たぶん|多分|おそらく|かもしれ|思う|気がする",
    "temperature": "寒|冷え|気温|低温|鳥肌",
}


def collapse(c: Column) -> Column:
    """Runs of any blanks as one space, ends cut."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def search_key(c: Column) -> Column:
    """Lower case without reply marks (a number, or a name of up to 20 signs before a blank),
    blanks collapsed. Compatibility forms are folded by ``operators.python.nfkc`` before."""
    # One small sigma, wherever it stands in a word.
    c = F.translate(F.lower(c), "ς", "σ")
    c = F.regexp_replace(c, r"(?:>>|＞＞)[ \t\n\r]*[0-9]+", " ")
    return collapse(F.regexp_replace(c, r"(?:>>|＞＞)[ \t\n\r]*[a-zぁ-んァ-ヶ一-龠々ー]{1,20}( |\t|\n|\r|$)", " $1"))


def presence_key(c: Column) -> Column:
    """The search key without blanks, punctuation and brackets."""
    return F.regexp_replace(search_key(c), r"[ 。、，．！？!?「」『』（）()【】\[\]]+", "")


def lines(c: Column) -> Column:
    """Lines with CRLF read as LF and the final empty segment kept."""
    return F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)


def sentences_fast(c: Column) -> Column:
    """Runs up to and with their terminator; no regard to quotations."""
    return F.regexp_extract_all(c, F.lit(r"[^.!?。！？\n]+[.!?。！？]*"), F.lit(0))


def words(c: Column, content_only: bool = False) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    out = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.filter(out, lambda x: ~x.isin(STOP_WORDS) & ~x.rlike("^[ぁ-ん]$")) if content_only else out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(c: Column, n: int) -> Column:
    """Character n-grams in order; none if the text is shorter than n.

    The text is split into its characters once; a substring would count them from the
    start of the text for every gram."""
    signs = F.when(c != "", F.split(c, "")).when(c.isNotNull(), F.array().cast("array<string>"))
    return let(
        signs,
        lambda a: F.when(
            F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.concat(*[F.element_at(a, i + k) for k in range(n)]))
        ).when(a.isNotNull(), F.array().cast("array<string>")),
    )


def marked_grams(c: Column, n: int) -> Column:
    """N-grams of the search key without blanks, between ^ and $."""
    return grams(F.concat(F.lit("^"), F.regexp_replace(search_key(c), " ", ""), F.lit("$")), n)


def gram_set(c: Column, n: int = 3) -> Column:
    """Distinct n-grams without punctuation and blanks; a shorter text is its own gram."""
    plain = F.regexp_replace(F.lower(c), r"[\p{P}\p{S}\p{Z}\p{C}]+", "")
    return let(
        plain, lambda t: F.array_distinct(F.when(F.length(t) >= n, grams(t, n)).when(F.length(t) > 0, F.array(t)).when(t.isNotNull(), F.array().cast("array<string>")))
    )


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two sets; 0 if both are empty."""
    return F.when((F.size(a) + F.size(b)) > 0, 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def masked(c: Column, view: str = "raw") -> Column:
    """Addresses and reply marks as a box; ``script`` masks runs of ideographs, katakana,
    Latin letters and digits as well."""
    out = collapse(F.regexp_replace(c, r"https?://[^ \t\n\r\x{3000}]+|>>[0-9]+", "□"))
    return out if view == "raw" else F.regexp_replace(out, r"[\p{IsHan}\p{IsKatakana}ーA-Za-z0-9]+", "□")


def script_shape(c: Column) -> Column:
    """Each character as its script: h hiragana, k katakana, q half-width kana, H ideograph,
    D digit, A other letter; all else stays."""
    # Signs in a private range first, so that no letter put in is taken for one of the text.
    signs = {"[ァ-ヺ]": "\ue000", "[ぁ-ゖ]": "\ue001", "[ｦ-ﾟ]": "\ue002", "[一-龯々]": "\ue003", r"\p{Nd}": "\ue004", r"\p{L}": "A"}
    return F.translate(cascade(c, list(signs.items())), "\ue000\ue001\ue002\ue003\ue004", "khqHD")


def structure(c: Column) -> Column:
    """Numbers and runs of ideographs or katakana as placeholders, repeats collapsed."""
    c = F.regexp_replace(c, r"[0-9]+(?:\.[0-9]+)?", "<NUM>")
    c = F.regexp_replace(c, r"[\p{IsHan}\p{IsKatakana}ー]+", "<TERM>")
    return F.regexp_replace(c, r"(?:<TERM>)+", "<TERM>")


def narration(c: Column) -> Column:
    """Text without quotations of two characters or more."""
    return F.regexp_replace(c, r"「[^」]{2,}」|『[^』]{2,}』", "")


def dialogue(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"「[^」]{2,}」|『[^』]{2,}』"), F.lit(0))


def dialogue_share(c: Column) -> Column:
    """Characters in quotations over all characters; 0 for an empty text."""
    return F.aggregate(dialogue(c), F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.length(c), F.lit(1))


def punctuation_signature(c: Column) -> Column:
    """Punctuation and line ends alone, in order."""
    return F.regexp_replace(c, r"[^。、，．！？!?,.…\n]", "")


def cascade(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Replacement rules in order, each on what the one before left."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, c)


def tidy(c: Column) -> Column:
    """No blanks before punctuation, no doubled full stops."""
    return cascade(c, [(r"[ 　]+([。、！？,.!?])", "$1"), (r"。{2,}", "。")])


def excerpt(c: Column, n: int = 180) -> Column:
    return F.substring(collapse(c), 1, n)


def without_anchor_lines(c: Column) -> Column:
    """Lines that hold a reply mark alone are dropped, runs of empty lines made one."""
    return F.regexp_replace(F.regexp_replace(c, r"(?md)^(?:>>|＞＞)[0-9]+[ 　]*$", ""), r"\n{3,}", "\n\n")


def digit_reading(c: Column) -> Column:
    """Two or three kana of either script read as digits, small kana and length marks left
    out; null for other words and for those that are never meant so."""
    from corpuskit.functions.patterns import DIGIT_KANA, NO_READING

    kana = F.translate(c, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))
    word = F.regexp_replace(kana, "[ーぁぃぅぇぉゃゅょっ]", "")
    digits = F.translate(word, "".join(DIGIT_KANA), "".join(d * len(k) for k, d in DIGIT_KANA.items()))
    return F.when(F.length(word).between(2, 3) & ~word.isin(NO_READING) & digits.rlike("^[0-9]+$") & ~word.rlike("[0-9]"), digits)


def reversed_lines(c: Column) -> Column:
    return F.array_join(F.reverse(F.split(c, "\n", -1)), "\n")


def flattened(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(""))


def with_stops(c: Column) -> Column:
    """A full stop after every line that is not blank and lacks one."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(F.trim(x).rlike(r"[^。！？!?.…]$"), F.concat(x, F.lit("。"))).otherwise(x)), "\n")


def tags(c: Column, rules: dict[str, str], default: str = "general") -> Column:
    """Names of all rules whose pattern is found, in the rules' order, else the default."""
    found = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in rules.items()]))
    return F.when(F.size(found) > 0, found).when(c.isNotNull(), F.array(F.lit(default)))


def page_text(c: Column) -> Column:
    """HTML as text: scripts and styles dropped, breaks and block ends as line ends, tags
    stripped, six entities decoded (``&amp;`` before quotes), runs of empty lines as one."""
    rules = [
        (r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", ""), (r"(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6]|dd)>", "\n"), (r"<[^>]+>", ""),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", "\""), ("&#39;", "'"), ("\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ]
    return F.trim(cascade(c, rules))


def fragment_lines(c: Column) -> Column:
    """Lines of an HTML fragment that are not blank; ``&amp;`` is decoded last."""
    t = cascade(c, [(r"(?i)<br[^>]*>", "\n"), (r"<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")])
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def elements(c: Column, tag: str) -> Column:
    """Inner HTML of each element of a tag."""
    return F.regexp_extract_all(c, F.lit(rf"<{tag}[^>]*>([^<]*(?:<[^/][^<]*)*)</{tag}>"), F.lit(1))
