"""Problem 10: template residue, filler, error pages and script notices.

Placeholders are found by one grammar per delimiter, outside code and outside lines near an
explanation of the notation. The other kinds are told by what a line says, not by how it is
worded: an error joins a thing of the web with a failure, a notice joins scripts with a
demand, filler joins a part of a text with its being provisional; a line is of a kind if
such words make up most of it. A document is a case if hardly any letters stay when its
lines of a kind are taken away, and with them the machinery of pages: lines that recur with
many authors and mostly stand beside lines of a kind, which is learned from all documents.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuskit.functions.text import let
from corpuskit.operators.lineage import cut, read_table

# Names that fields of page templates carry.
FIELD_NAMES = (
    "name user username author title subject body content text message price count number total date time guild item item_name "
    "thread thread_no id email address city company phone url link link_here "
    "本文 名前 氏名 投稿者 品名 件名 日付 時刻 題名 金額 価格 住所 会社名 電話番号"
).split()
_FIELD = "(?:" + "|".join(FIELD_NAMES) + ")"
_ID = r"[\p{L}_][\p{L}\p{N}_.]*+"

# One grammar per delimiter.
PLACEHOLDERS = {
    "mustache": rf"\{{\{{\{{?[#/^&]?\s*{_ID}(?:\s*\|\s*{_ID})?\s*\}}\}}\}}?",
    "dollar": rf"\$\{{\s*{_ID}\s*\}}",
    "hash": rf"#\{{\s*{_ID}\s*\}}",
    "erb": rf"<%[=\-#]?\s*{_ID}\s*-?%>",
    "tag": rf"\{{%-?\s*\p{{L}}+(?:\s+{_ID})*\s*-?%\}}",
    "percent": rf"(?<![0-9０-９\p{{L}}%])%{_ID}%(?![0-9])",
    "printf": r"(?<![0-9０-９%A-Za-z])%[sd](?![A-Za-z0-9%])",
    "at": rf"@@{_ID}@@",
    "underscore": rf"(?<![\p{{L}}\p{{N}}_])__(?:[A-Z][A-Z0-9_]*?|{_FIELD})__(?![\p{{L}}\p{{N}}_])",
    "double_bracket": rf"\[\[\s*(?:[a-z]+(?:_[a-z]+)*|{_FIELD})\s*\]\]",
    "bracket": rf"(?<!\[)\[(?:(?i:insert |your |enter )[^\[\]\n]+|(?i:{_FIELD}))\](?![\](])",
    "index": r"(?<![\p{L}\p{N}}$#{])\{[0-9]\}(?!\})",
    "unset": r"【[^【】\n]+未(?:設定|入力|定義)】",
    "enter_here": r"<[^<>\n]*\s?をここに入力>|<(?i:insert|enter|your) [^<>\n]+>",
}

#: Lines before and after an explanation that it covers.
WINDOW = 2
# What a line says that explains a notation instead of leaving it unfilled.
EXPLAINS = (
    r"と書くと|と書けば|と書いて|と入力すると|置き換わ|置換され|書式では|記法|構文|テンプレート変数"
    r"|(?i:\byou (?:write|type|put)\b|\bswaps? in\b|\bgets? replaced\b|\bis replaced\b|\bsyntax\b|\bplaceholders?\b|\btemplate variables?\b)"
    r"|(?i:\bschreibt man\b|\bPlatzhalter\b|\bon écrit\b|\best remplacé\b)|占位符|替换成"
)
_CODE = r"(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)|<code>.*?</code>|<pre>.*?</pre>"
_INLINE = r"`[^`\n]+`"

def _tree(words: list[str]) -> str:
    """One pattern for any of the words, the longest first, common beginnings matched once."""
    by = {}
    for w in words:
        by.setdefault(w[:1], set()).add(w[1:])
    ends = by.pop("", None) is not None
    unit = lambda c: "[ '’]?" if c == "~" else re.escape(c)
    branches = [unit(c) + _tree(sorted(rest)) for c, rest in sorted(by.items())]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?" if ends else "")


def _words(*lists: tuple[str, str], endings: str = r"[\p{IsLatin}\p{IsDevanagari}]{0,4}") -> str:
    """A pattern for any of the words of (spaced, joined) lists: ``spaced`` ones stand alone,
    but for an ending; ``joined`` ones, of scripts without blanks, may stand anywhere. A tilde
    is a blank or an apostrophe or nothing; words with other signs are patterns."""
    out = []
    for k, (begin, end) in enumerate(((r"(?<![\p{L}\p{M}])", endings + r"(?![\p{IsLatin}\p{IsDevanagari}\p{M}])"), ("", ""))):
        words = sorted({w for pair in lists for w in pair[k].split()})
        odd = [w.replace("~", "[ '’]?") for w in words if re.search(r"[\[({?+\\]", w)]
        plain = [w for w in words if not re.search(r"[\[({?+\\]", w)]
        # Most places are passed over by their first sign.
        first = "".join(sorted({w[0] for w in plain}))
        any_of = "|".join([*([f"(?=[{first}]){_tree(plain)}"] if plain else []), *odd])
        if any_of:
            out.append(f"{begin}(?:{any_of}){end}")
    return "(?:" + "|".join(out) + ")"


# The vocabularies of the kinds, by what a word means. A word stands for all
# that begin like it.
THINGS = (
    "page url link file document thread topic board post article site website server service request address content database connection access session browser gateway host index upstream parameter "
    "seite server datei dokument beitrag thema dienst anfrage adresse inhalt datenbank verbindung zugriff sitzung page fichier document sujet serveur service demande requête adresse contenu base accès session connexion lien "
    "पृष्ठ पेज सर्वर स्थान फ़ाइल अनुरोध",
    "ページ サイト サーバ スレッド ファイル データベース アクセス リクエスト アドレス 記事 投稿 掲示板 接続 コンテンツ 画面 権限 内部 页面 网页 服务器 链接 文件 帖子 连接 数据库 请求 页 페이지 서버 요청 파일 게시 주소 연결 접속 หน้า เซิร์ฟเวอร์ ไฟล์ เว็บ คำขอ",
)
FAILURES = (
    "not~found could~n[o']t~(?:be~)?(?:found|find|open|load|reach|connect|display|process) couldn~t can~?not can~t unable fail does~n[o']t~exist doesn~t no~longer unavailable not~available denied forbidden unauthorized blocked refused "
    "timed~out time-?out did~not~answer did~not~respond too~many went~wrong error exception overload busy removed deleted moved missing invalid bad expired temporarily~(?:down|unavailable) try~again "
    "nicht~gefunden nicht~erreichbar nicht~verfügbar nicht~gefunden~werden existiert~nicht verweigert gesperrt fehler fehlgeschlagen überlastet gelöscht ungültig abgelaufen "
    "introuvable n~existe~pas indisponible inaccessible refusé interdit erreur échou échec expiré supprimé surchargé नहीं~मिल उपलब्ध~नहीं त्रुटि विफल अस्वीकृत",
    "見つか(?:りません|らない|らず)(?:でした)? 存在し(?:ません|ない) ありません 表示(?:でき(?:ません|ない)|に失敗) 利用(?:いただけません|できません) 開けません エラー 失敗 拒否 混雑 集中 発生し 落ち 停止 つなが(?:りません|らない) 削除 移動 権限がありません 期限 無効 "
    "不存在 找不到 未找到 无法 错误 出错 失败 拒绝 超时 已删除 已被删除 찾을~?수~?없 존재하지~?않 없습니다 오류 실패 거부 삭제 이용할~?수~?없 ไม่พบ ไม่สามารถ ข้อผิดพลาด ปฏิเสธ ล้มเหลว",
)
SCRIPTS = ("java~?scripts? scripts? scripting noscript browser~check dynamic जावास्क्रिप्ट स्क्रिप्ट", "スクリプト ｽｸﾘﾌﾟﾄ ジャバスクリプト 脚本 자바스크립트 스크립트 จาวาสคริปต์ สคริปต์")
DEMANDS = (
    "enable turn activate allow switch requir need must necessary disabled turned off not~support does~n[o']t~support without loaded checking aktivier benötig erforderlich einschalten deaktiviert ausgeschaltet notwendig erlauben "
    "activ autoris nécessaire requis désactivé besoin requiert सक्षम चालू आवश्यक",
    "有効 必要 無効 オン オフ 許可 未対応 対応していません 動作しません 启用 开启 打开 需要 禁用 允许 支持 켜 활성화 비활성화 필요 허용 사용 เปิด ต้อง จำเป็น อนุญาต",
)
PARTS = (
    "text copy content body paragraph sentence headline heading title caption description image article section placeholder topic blindtext mustertext fülltext platzhalter absatz überschrift beschreibung inhalt texte paragraphe titre contenu légende पाठ सामग्री शीर्षक",
    "テキスト 本文 見出し 段落 説明 タイトル 文章 文 内容 コメント 画像 紹介 文字 文本 正文 标题 内容 段落 텍스트 본문 내용 제목 문장 문구 설명 ข้อความ เนื้อหา หัวข้อ",
)
PROVISIONAL = (
    "sample dummy placeholder filler goes~here here to~follow follows to~come to~be~(?:added|written|replaced|inserted|determined|announced) will~(?:be|appear|follow|go|come) replace insert write type layout only later shortly soon coming example mock lorem edit~this add~your your "
    "hier stelle folgt ersetzen einfügen blindtext platzhalter muster beispiel später ici provisoire factice exemple remplacer venir insérer saisir यहाँ नमूना उदाहरण बाद",
    "サンプル ダミー 仮 ここ このあたり この部分 こちらに 入ります 入る 入れ 差し替え 置き換え 置い あと 後で 後日 予定 追加 記入 入力 例文 此处 这里 示例 占位 替换 待补 稍后 填写 여기 예시 샘플 임시 나중 추후 입력 ตัวอย่าง ที่นี่ ภายหลัง",
)
PENDING = (
    "under~construction coming~soon work~in~progress to~be~(?:announced|determined|written|confirmed|continued) tbd tba tbc wip not~yet check~back stay~tuned in~(?:arbeit|kürze|bearbeitung|vorbereitung) im~aufbau demnächst en~(?:construction|travaux|préparation|cours) bientôt prochainement à~venir निर्माणाधीन जल्द",
    "工事中 準備中 作成中 制作中 製作中 執筆中 整備中 調整中 改装中 近日 未定 公開予定 乞うご期待 しばらくお待ち 建设中 施工中 敬请期待 即将 待定 준비~?중 공사~?중 제작~?중 작성~?중 곧 미정 อยู่ระหว่าง กำลังปรับปรุง กำลังจัดทำ เร็วๆ~?นี้",
)
TRIALS = ("tests? testing testpost asdf\\w*+ qwert\\w*+ foo bar blah x{3,} ｔｅｓｔ ｔｅｓｔｉｎｇ prueba essai versuch टेस्ट परीक्षण", "テスト てすと ﾃｽﾄ 测试 試驗 테스트 ทดสอบ")
# What stands around such words and says nothing of its own.
SMALL = (
    "a an the this that these those is are was were be been it its to of in on at by for from with without and or but as if then than please sorry oops you your we our i my us can could may might will would should has have had do does did not no so before after again back go return check reload "
    "retry refresh settings configuration minutes? seconds? moment home contact administrator admin owner webmaster site~owner more again~later some any all there here what which who when where something anything just now currently still view display show continue load loading see read visit use using properly viewed requested looking moved removed deleted "
    "der die das den dem ein eine einen bitte um zu und oder ist sind wird werden wurde diese dieser dieses ihr ihre ihren sie es im in an auf mit von für nicht derzeit anzuzeigen angezeigt forum le la les un une des de du ce cet cette ces est sont pour et ou dans sur vous votre veuillez pas afficher fil affichage demandée? actuellement temporairement momentanément यह है हैं कृपया के को का की में और से नहीं करें",
    "この その あの お使い ご確認 確認 再度 再読み込み もう一度 お試し 時間 設定 管理者 連絡 お探し 申し訳 ただいま 現在 ご迷惑 しばらく お待ち ください 下さい 过去 过去ログ 過去ログ 倉庫 格納 閲覧 表示 実行 读取 您 请 本 该 此 的 了 在 是 后 再 访问 查看 抱歉 对不起 重新 刷新 이 그 저 을 를 이 가 은 는 에 의 하려면 보려면 주세요 하세요 하십시오 합니다 습니다 입니다 원하신 요청하신 죄송 이용 게시판 발생 잠시 후 다시 시도 확인 กรุณา โปรด ที่ คุณ ต้องการ ใน และ ของ ได้ ใช้งาน หน้านี้ กลับ ลอง ใหม่ ขออภัย",
)
# Forms that servers and programs give their messages, whatever the words.
FORMS = (
    r"(?:HTTP|Error|Status|Code|ERROR|Erreur|Fehler|エラー|错误|오류)?[\p{L}/.]*[ :：#]*(?<![0-9])[45][0-9]{2}(?![0-9])[ :：\-–]*\p{Lu}[\p{L}\-]+(?:[ \-]\p{Lu}[\p{L}\-]+){0,6}"
    r"|(?:ERROR|Error|Erreur|Fehler|エラー|错误|오류|त्रुटि|HTTP)[ :：#]*[0-9]+[ :：]|Traceback \([^)\n]*\)|File \"[^\"\n]+\", line [0-9]+(?:, in \w+)?|[\p{L}_.$]+(?:Error|Exception|Warning) ?:|(?:Warning|Notice|Fatal error|Parse error|Deprecated): "
    r"|at [\w$.]+\([\w.]+:[0-9]+\)|Segmentation fault|core dumped|Stack trace:"
)
# How servers sign their pages.
SIGNATURE = r"^[^\p{L}\p{N}]*[A-Za-z][\w\-]*/[0-9][\w.]*(?: \([^()\n]*\))?(?: (?:Server )?at \S+ port [0-9]+)?$"
# The words of the customary Latin filler.
LATIN_FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Share of the letters that may stay when lines of a kind and page machinery are taken away.
RESIDUE_SHARE = 0.2
#: Share of the letters of a line that may be other words than those of its kind.
OTHER_WORDS = 0.35
#: The same of a line that begins like a message of a server or program.
FORM_WORDS = 0.7
#: Words of Latin filler that make a line of it.
LATIN_WORDS = 4
#: Authors with whom a line must recur to be page machinery, and the share of the documents
#: with it that must have a line of a kind.
MACHINERY_AUTHORS, MACHINERY_SHARE = 5, 0.5

_LINE = "[ \\t　]*\\n[ \\t　]*"


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", ""))


def _explained(text: Column) -> Column:
    """The text without code and without the lines near an explanation of a notation."""
    bare = F.regexp_replace(F.regexp_replace(text, _CODE, " "), _INLINE, " ")
    near = rf"(?m)(?:^.*\n){{0,{WINDOW}}}^.*(?:{EXPLAINS}).*$(?:\n.*$){{0,{WINDOW}}}"
    return F.when(bare.rlike(EXPLAINS), F.regexp_replace(bare, near, " ")).otherwise(bare)


def placeholder_counts(text: Column) -> Column:
    """Struct of the number of unfilled placeholders by delimiter, outside code and explanations."""
    t = _explained(text)
    return F.struct(*[F.regexp_count(t, F.lit(p)).alias(k) for k, p in PLACEHOLDERS.items()])


def has_placeholder(text: Column) -> Column:
    # The characters every grammar needs; most texts have none and skip the grammars.
    return F.when(text.rlike(r"[{}%@\[【<]|__"), _explained(text).rlike("|".join(f"(?:{p})" for p in PLACEHOLDERS.values()))).otherwise(False)


def line_kind(line: Column) -> Column:
    """error, notice, stand_in, filler or signature if a line is of that kind, else null; a
    signature or bar of links makes no case alone.

    What a line quotes is not what it says, and addresses and paths are no words; kana endings
    count neither for nor against a kind."""
    own = "(?iu)" + "|".join((_words(FAILURES, THINGS, SCRIPTS, DEMANDS, PROVISIONAL, PARTS, PENDING), _words(TRIALS, SMALL, endings="")))
    latin = r"(?i)(?<!\p{L})(?:" + "|".join(LATIN_FILLER) + r")(?!\p{L})"
    said = F.regexp_replace(line, r"『[^『』]*+』|「[^「」]*+」|“[^“”]*+”|\"[^\"]*+\"|https?://\S+|(?<![\p{L}])/[\w./?=&-]+|(?<!\S)[^\s@]++@\S++", " ")
    other = lambda t, p: F.length(F.regexp_replace(F.regexp_replace(t, p, " "), r"[^\p{L}]+|[ぁ-ん]+", ""))

    def of(t):
        says = lambda *p: reduce(lambda a, b: a & b, [t.rlike("(?iu)" + _words(*x)) for x in p])
        # Loops over words are not left to patterns, which would go as deep as a line is long.
        parts = (F.regexp_count(t, F.lit("(?iu)" + _words(PARTS))) >= 3) & (F.regexp_replace(t, rf"(?iu){_words(PARTS)}|\P{{L}}+", "") == "")
        again = let(F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.size(w) > 1) & (F.size(F.array_distinct(w)) == 1) & (F.length(F.try_element_at(w, F.lit(1))) > 1))
        kind = (
            F.when(says((SCRIPTS,), (DEMANDS, FAILURES)), "notice").when(says((FAILURES,), (THINGS,)), "error").when(says((PENDING,)), "stand_in").when(says((PROVISIONAL,), (PARTS,)), "filler").when(t.rlike("(?iu)" + _words(TRIALS, endings="")), "stand_in")
            .when(parts | again, "filler")
        )
        words = other(t, "^$")
        return let(kind, lambda k: F.when(k.isNotNull() & (other(t, own) <= OTHER_WORDS * F.greatest(words, F.lit(1))), k))

    form = line.rlike(rf"^[^\p{{L}}\p{{N}}]*(?:{FORMS})")
    formed = other(line, rf"^[^\p{{L}}\p{{N}}]*(?:{FORMS})|{own}") <= FORM_WORDS * F.greatest(other(line, "^$"), F.lit(1))
    # Most of its words, as other languages have some of them.
    filled = (F.regexp_count(line, F.lit(latin)) >= LATIN_WORDS) & (other(line, latin) <= OTHER_WORDS * other(line, "^$"))
    # Bars of links: three names or more between separators, with no stop.
    bar = ~line.rlike("[.。!?！？]") & let(F.split(line, "[|>»›]"), lambda x: (F.size(x) > 2) & ~F.exists(x, lambda y: F.trim(y) == ""))
    return F.when(line.rlike(SIGNATURE) | bar, "signature").when(form & formed, "error").when(filled, "filler").otherwise(let(said, of))


def _gate() -> str:
    """What every line of a kind has at least one of."""
    lone = r"(?<!\p{L})(?:" + "|".join(LATIN_FILLER[:2] + ["amet", "adipiscing", "tempor", "incididunt", "nostrud", "veniam"]) + r")(?!\p{L})"
    words, parts = "|".join((_words(FAILURES, SCRIPTS, PROVISIONAL, PENDING), _words(TRIALS, endings=""))), _words(PARTS)
    return rf"(?m)(?iu:{words}|{lone}|{parts}\P{{L}}*+{parts}\P{{L}}*+{parts})|^[^\p{{L}}\p{{N}}\n]*(?:{FORMS})|(?<!\p{{L}})(\p{{L}}{{2,}}+)[\s,、　]+\1(?!\p{{L}})"


def residue_cases(docs: DataFrame, text: str = "text", author: str | None = "author_id") -> DataFrame:
    """(key, residue): the md5 of each different text that is a case, and its kind.

    Lines are read with their digits as one and their outer blanks cut. What machinery is, is
    counted over all documents: of each line the documents it is in, those of them with a line
    of a kind, and the authors, by 64 classes of their names. Without authors every document
    counts as another one.
    """
    raw = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    who = F.col(author) if author else F.md5(F.col(text))
    rows = docs.filter(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.md5(F.col(text)).alias("key"), raw.alias("t"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(who), F.lit(64)).cast("int")).alias("who"))
    # Words with a digit in them as one: numbers, dates, digests.
    fold = lambda x: F.xxhash64(F.regexp_replace(x, "(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]++", "0"))
    lines = F.array_distinct(F.split(F.trim("t"), _LINE))
    told = F.transform(F.split(F.trim("t"), _LINE), lambda x: F.struct(fold(x).alias("h"), letters(x).alias("n"), line_kind(x).alias("kind")))
    # One struct, made once: a filter on its parts would be pushed down and make them anew.
    row = F.struct("key", "who", has_placeholder(F.col("t")).alias("open"), F.when(F.col("t").rlike(_gate()), told).alias("lines"))
    case = lambda x: x["open"] | F.coalesce(F.exists(x["lines"], lambda y: y["kind"] != "signature"), F.lit(False))
    marked = cut(rows.select(F.explode(F.filter(F.array(row), case)).alias("x")).select("x.*"))
    beside = marked.filter("not open").select("key", "who", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["kind"].isNull()), lambda x: x["h"]))).alias("h"))
    beside = beside.groupBy("h").agg(F.count("*").alias("near"), F.bit_or("who").alias("who")).filter(F.bit_count("who") >= MACHINERY_AUTHORS)
    every = rows.select(F.explode(F.transform(lines, fold)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    machinery = every.join(beside, "h").filter(F.col("near") >= MACHINERY_SHARE * F.col("n")).select("h")
    # Of each text that is not a placeholder's: its letters, and those of lines of no kind.
    one = marked.groupBy("key").agg(F.max("open").alias("open"), F.first("lines").alias("lines"))
    one = one.withColumn("all", F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]))
    kinds = F.transform(F.filter("lines", lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), k) for k in ("error", "notice", "stand_in", "filler")])
    one = one.withColumn("kind", kind)
    left = one.filter("not open").select("key", F.explode(F.filter("lines", lambda x: x["kind"].isNull() & (x["n"] > 0))).alias("x")).select("key", "x.h", "x.n")
    left = left.join(machinery, "h", "left_anti").groupBy("key").agg(F.sum("n").alias("left"))
    done = one.select("key", "open", "kind", "all").join(left, "key", "left")
    case = F.when(F.col("open"), "placeholder").when(F.coalesce("left", F.lit(0)) <= RESIDUE_SHARE * F.col("all"), F.col("kind"))
    return done.select("key", case.alias("residue")).filter("residue is not null")


def residue_kind(docs: DataFrame, text: str = "text", author: str | None = None) -> DataFrame:
    """``docs`` and a column ``residue``: placeholder, error, notice, stand_in, filler or null.

    The first kind that applies, in this order. Null, empty and blank texts have none.
    """
    cases = residue_cases(docs, text, author).withColumnRenamed("key", "_key")
    return docs.withColumn("_key", F.md5(F.col(text))).join(cases, "_key", "left").drop("_key")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "author_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue of page production instead of content."""
    docs = _documents(spark, sf_dir)
    cases = residue_cases(docs)
    return docs.select("doc_id", F.md5("text").alias("key")).join(cases, "key", "left_semi").select("doc_id").distinct()


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents fit to keep, whole."""
    docs = _documents(spark, sf_dir)
    return docs.withColumn("key", F.md5("text")).join(residue_cases(docs).select("key"), "key", "left_anti").select("doc_id", "text")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents of each kind of residue."""
    docs = residue_kind(_documents(spark, sf_dir), author="author_id")
    return docs.groupBy(F.coalesce("residue", F.lit("none")).alias("residue")).agg(F.count("*").alias("n"))
