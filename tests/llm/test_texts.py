import os
import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import lookalike, mixing, mojibake, residue, sentences, tokens


# --- problem 2


@pytest.fixture(scope="module")
def model(spark, data):
    stored = mojibake.scan(mojibake.fields(spark.read.parquet(f"{data}/posts.parquet")))
    return mojibake.model_of(stored.filter("kind in ('pair', 'char')").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas())


@pytest.mark.parametrize("text", ["昨日の深夜に黒帆の船長が沈んだ鐘楼で銀のコンパスを拾った。", "The naïve recruit said ‘no’ – isn’t it?", "Kurz vor fünf hat der Türmer zwei Münzen geöffnet."])
def test_round_trip_of_garbled_text(model, text):
    bad = mojibake.garble(text)
    assert len(bad) >= 4
    restored = 0
    for b in bad:
        garbled, got, chain = mojibake.judge_texts([b], model, mojibake.LEAST_MARGIN)[0]
        assert garbled, b
        assert got in (None, text) or "�" in b or chain
        restored += got == text
    assert restored >= len(bad) / 2


def test_intended_oddities_are_no_case(model):
    odd = ["¥¥¥ 1€ ½ ±3° ©harbour", "SÃO ÂNCORA とかいう港の名前", "ｷﾀ━━━(ﾟ∀ﾟ)━━━!!", "ﾏｼﾞﾃﾞｽｶ", "ÇA VA À BORDÉES", "costs $5", "", "\n", "еvеrу lеttеr"]
    assert [x[0] for x in mojibake.judge_texts(odd, model, 15.0)] == [False] * len(odd)


def test_part_of_a_text_and_lost_characters(model):
    good, bad = "雨の止み間に見習い召喚士が渡し場で星図の写しを配った。", "春の合同演習に港の両替屋が旧校舎で錆びた鍵を隠した。"
    text = good + "\n" + bad.encode().decode("latin-1")
    assert mojibake.judge_texts([text], model, 4.0)[0][:2] == (True, good + "\n" + bad)
    assert mojibake.judge_texts(["caf� owner"], model, 4.0)[0] == (True, None, None)


def test_long_lines_take_linear_time(model):
    import time

    for text in ("x" * 200_000 + "é", "漢" * 200_000 + "ﾃｽ", "ã\x81" + "a " * 100_000, "ÃÃ" * 50_000):
        began = time.time()
        mojibake.judge_texts([text], model, 15.0)
        assert time.time() - began < 20


def test_a_single_garbled_character_is_found_and_left_out_of_the_model(spark):
    clean = ["The guild clerk doesn’t trust the chalk set, she said.", "昨日の深夜に黒帆の船長が灯台の屋上で鈴を拾った。", "远征归途，图书塔管理员在吊桥边把条纹披风弄丢了！", "Don’t ask; it’s the captain’s bell."] * 50
    bad = ["The clerk doesn’t trust it.".encode().decode("cp932"), "Don’t ask the captain.".encode().decode("gb18030"), "Fine line.\n" + "She doesn’t trust it.".encode().decode("cp932")]
    rows = [(f"c{i}", "content", t) for i, t in enumerate(clean)] + [(f"b{i}", "content", t) for i, t in enumerate(bad)]
    got = {r.id: r.restored for r in mojibake.detect(spark.createDataFrame(rows, "id string, field string, text string")).collect()}
    assert got == {"b0": "The clerk doesn’t trust it.", "b1": "Don’t ask the captain.", "b2": "Fine line.\nShe doesn’t trust it."}


def test_the_margin_lies_in_the_gap_of_all_gains():
    margin, report = mojibake.margin_of({20: 3, 24: 1, 30: 2, 90: 5}, 25.0)
    assert 30 / 4 < margin < 90 / 4 and report["doubtful"] == 6
    assert mojibake.LEAST_MARGIN <= mojibake.margin_of({}, 25.0)[0] <= 25
    assert mojibake.margin_of({}, 2.0)[0] >= mojibake.LEAST_MARGIN


def test_chains_of_different_steps(model):
    good = "昨日の深夜に黒帆の船長が沈んだ鐘楼で銀のコンパスを拾った。"
    twice = good.encode().decode("latin-1").encode().decode("mac_roman")
    assert mojibake.judge_texts([twice], model, 15.0)[0] == (True, good, "mac_roman>utf-8+cp1252>utf-8")


def test_what_any_chain_can_read_is_traced():
    for text in ("ship 🙂 ahoy", "Привет", "“No”", "été"):
        for wrong in ("cp932", "gb18030"):
            bad = text.encode().decode(wrong, "ignore")
            if any(new == text for _, new in mojibake.candidates(bad)):
                assert mojibake.traced_lines([bad])[0], (wrong, bad)
    assert mojibake.traced_lines(["カタカナ".encode("euc_jp").decode("cp932")])[0]
    assert not mojibake.traced_lines(["plain text", "ｱｲ", "The naïve recruit"]).any()


def test_detect_handles_nulls_repeats_and_empty(spark):
    assert mojibake.detect(spark.createDataFrame([], "id string, field string, text string")).count() == 0
    posts = spark.createDataFrame([("a", None, "t"), ("b", "", None), (None, "x", "x"), ("c", "caf�", "ok"), ("c", "caf�", "ok")], "id string, content string, threadTitle string")
    assert {(r.id, r.field) for r in mojibake.detect(mojibake.fields(posts)).collect()} == {("c", "content")}


# --- problem 4


UNITS = [
    ("Dr. Quenby paid 69.64 marks, approx. 50 percent more than No. 55 did. Is it J. R. Odrin?! “No. Go,” he said.", ["Dr. Quenby paid 69.64 marks, approx. 50 percent more than No. 55 did.", "Is it J. R. Odrin?!", "“No. Go,” he said."]),
    ("See http://a.example/t?id=8&v=6.2 for rope, wax, etc. Velk opens at 3 a.m. on weekdays. At 7:24 p.m. A week ago.", ["See http://a.example/t?id=8&v=6.2 for rope, wax, etc.", "Velk opens at 3 a.m. on weekdays.", "At 7:24 p.m.", "A week ago."]),
    ("Am 23. Dezember ca. 75,77 Mark. „Nein. her“, zum 17. Mal. Er führt z. B. Nr. 5 usw. mit.", ["Am 23. Dezember ca. 75,77 Mark.", "„Nein. her“, zum 17. Mal.", "Er führt z. B. Nr. 5 usw. mit."]),
    ("うそ！？と叫んだ。マジか！うちの団長（前は門担当。今は引退。）だ．Ver.3.15から。。。\nでも…本気か！", ["うそ！？と叫んだ。", "マジか！", "うちの団長（前は門担当。今は引退。）だ．", "Ver.3.15から。。。", "でも…本気か！"]),
    ("他说“太重了！”就走了。《录》（第3卷。旧版。）里。真的……吗？！走。", ["他说“太重了！”就走了。", "《录》（第3卷。旧版。）里。", "真的……吗？！", "走。"]),
    ("दाम 31.48 है और डॉ. क्वेन चुप हैं। दूत आया!", ["दाम 31.48 है और डॉ. क्वेन चुप हैं।", "दूत आया!"]),
    ("นายท่าขาย175ใบ บรรณารักษ์คัดลอก", ["นายท่าขาย175ใบ", "บรรณารักษ์คัดลอก"]),
    ("", []), (" \n　", []), ("no stop", ["no stop"]), (None, None),
]


def test_units(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(UNITS)], "i int, t string")
    got = {r.i: (r.t, r.s) for r in df.select("i", "t", sentences.sentence_spans(F.col("t")).alias("s")).collect()}
    for i, (_, want) in enumerate(UNITS):
        t, s = got[i]
        assert (None if s is None else [t[x.start : x.end] for x in s]) == want


def test_stops_after_a_nested_pair_are_masked(spark):
    whole = ["「彼は『うん』と言った。そして帰った」", "(see [1] now. And b)", "“He said (yes) now. Then left.”"]
    texts = whole + [f"“A. B” c\n{t}" for t in whole]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sentences.sentence_spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [texts[r.i][r.s[-1].start : r.s[-1].end] for r in got] == whole * 2


def test_abbreviations_before_other_signs_than_blanks(spark):
    for text in ["Mr.田中が来た。", "apples, etc., and pears", "डॉ.क्वेन चुप", "(wax, etc.) and rope"]:
        s = spark.createDataFrame([(text,)], "t string").select(sentences.sentence_spans(F.col("t")).alias("s")).first().s
        assert [text[x.start : x.end] for x in s] == [text]


def test_very_long_text(spark):
    text = "これは文だ。 " * 5_000
    s = spark.createDataFrame([(text,)], "t string").select(sentences.sentence_spans(F.col("t")).alias("s")).first().s
    assert len(s) == 5_000 and [text[x.start : x.end] for x in s[-2:]] == ["これは文だ。"] * 2


# --- problem 6


def test_folding_is_canonical_composition():
    random.seed(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x345), *range(0x1E00, 0x1F00), *range(0xAC00, 0xAC40), *range(0x1100, 0x1112), *range(0x1161, 0x1175), *range(0x11A8, 0x11C0), *range(0x304B, 0x3070), 0x3099, *range(0x915, 0x960), *range(0xFF61, 0xFFA0)]]
    texts = ["".join(random.choices(pool, k=random.randrange(12))) for _ in range(5_000)]
    got = lookalike.fold_texts(pa.array(texts)).to_pylist()
    assert got == [unicodedata.normalize("NFC", "".join(chr(x) for c in t for x in lookalike._fold(ord(c)))) for t in texts]


def test_what_looks_alike_and_what_does_not():
    fold = lambda *t: lookalike.fold_texts(pa.array(t)).to_pylist()
    assert len({*fold("ﾊﾟｶﾞ é A", "パガ é​ А", "パガ　é Ａ")}) == 1
    assert len({*fold("a", "A", "á", "b", "1", "a\n", "は", "ば", "0", "O")}) == 10
    assert fold(None, "", "​") == [None, "", ""]
    assert lookalike.fold_texts(pa.array(["x", "é"])[1:]).to_pylist() == ["é"]


def test_pairs_against_brute_force(spark, tmp_path):
    texts = ["a b", "a b", "ａ b", "a b", "c", "c", "", "​", None, "а b"]
    posts = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("p0", "a b")], "id string, content string")
    posts.write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame([(1, "x"), (2, "ｘ"), (2, "ｘ")], "line int, text string").write.parquet(f"{tmp_path}/sections.parquet")
    got = {tuple(r) for r in lookalike.p6_found(spark, str(tmp_path)).collect()}
    form = lookalike.fold_texts(pa.array(texts)).to_pylist()
    want = {("posts", f"p{i}", f"p{j}") for i in range(10) for j in range(i + 1, 10) if form[i] and form[i].strip() and form[i] == form[j] and texts[i] != texts[j]}
    assert got == want | {("sections", "1", "2")}
    links = {r.id: r.n_links for r in lookalike.p6_classes(spark, str(tmp_path)).filter("src = 'posts'").collect()}
    assert links == {f"p{i}": sum(f"p{i}" in w for w in want) for i in range(10) if any(f"p{i}" in w for w in want)}


def test_the_form_covers_posts_and_sections(spark, tmp_path):
    spark.createDataFrame([("p", "ａ"), ("q", None)], "id string, content string").write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame([(1, "ﾊﾟ"), (2, "")], "line int, text string").write.parquet(f"{tmp_path}/sections.parquet")
    got = {tuple(r) for r in lookalike.p6_normalised(spark, str(tmp_path)).collect()}
    assert got == {("posts", "p", "a"), ("posts", "q", None), ("sections", "1", "パ"), ("sections", "2", "")}


# --- problem 8


def test_ids_are_the_tokenizer_s(spark, data):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + [None, "", " ", "\n\n  x", "<|endoftext|> it's", "　 a\u0085b", "x" * 3_000, "\x1c\x1d a", "🙂" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [got[i] for i in range(len(texts))] == [w.ids for w in want]
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df), tokens.token_table(spark)).collect()}
    assert [back[i] for i in range(len(texts))] == [x or "" for x in texts]


def test_small_chunks_and_empty(spark, monkeypatch):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.ids)) for r in tokens.encode(df).collect())
    assert got == [(0, 1), (1, 3), (1, 3), (2, 0)]


# --- problem 9


def test_mix_reaches_its_targets(spark):
    random.seed(7)
    docs, i = [], 0
    for source, n in (("big", 300), ("Small ", 30), ("other", 50)):
        for _ in range(n):
            docs.append((i, " ".join(random.choices(["wave", "port", "mast"] if source == "big" else ["salt", "wind", "rope"], k=random.randrange(5, 60))), source))
            i += 1
    docs += [(i + k, "salt wind rope", None) for k in range(10)] + [(i + 20, None, "big"), (i + 21, "", "big"), (None, "x", "big")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("gone", 0.1, 2)], "source string, target_weight double, max_repeats int")
    sel, shares, *_ = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets)
    s = {r.source: r for r in shares.collect()}
    assert s["big"].share == pytest.approx(2 / 3, abs=0.04) and s["small"].expected_share == pytest.approx(1 / 3, abs=0.04) and s["gone"].n_tokens == 0
    rows = sel.collect()
    assert {r.source for r in rows} <= {"big", "small", None} and len({r.doc_id for r in rows}) == len(rows)
    cap = {"big": 1, "small": 4, None: 1}
    assert all(1 <= r.repeats <= cap[r.source] for r in rows)


def test_membership_on_held_out_documents(spark):
    """Sources of one language each are told apart; those that share a language are not."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = mixing.documents_with_tokens(spark.read.parquet(path))
    names = ["ghat-crawl", "hafen-export", "kisen-mirror", "quai-export"]
    train = rows.filter("doc_id % 3 <> 0")
    w, p, temperature, (held_out, accuracy, largest) = mixing.train_membership(train, names)
    assert held_out > 20 and accuracy > 0.6 and largest < 0.6
    test = [r for r in rows.filter("doc_id % 3 = 0").collect() if r.source in names and r.n_tokens > 20]
    best = mixing.posteriors(pa.array([r.ids for r in test], pa.list_(pa.int32())), w, p, temperature).argmax(axis=1)
    hit = [names[i] == r.source for i, r in zip(best, test)]
    assert len(hit) >= 20 and np.mean(hit) > 0.75


def test_shares_are_met_in_tokens_and_sum_to_one(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    sel, shares, rounds, _ = mixing._mix(spark, path)
    got = [r for r in shares.collect() if r.n_tokens]
    reachable = sum(r.target_weight for r in got)
    assert sum(r.share for r in got) == pytest.approx(1.0)
    assert all(r.share == pytest.approx(r.target_weight / reachable, rel=0.02) for r in got)
    losses = [r.loss for r in rounds.orderBy("round").collect()]
    assert losses == sorted(losses, reverse=True)
    assert sum(r.n_tokens * r.repeats for r in sel.collect()) == sum(r.n_tokens for r in got)


def test_corrections_take_the_largest_that_fit():
    sizes = [("a", 10, 3, 0), ("a", 4, 1, 9), ("a", 1, 2, 2), ("b", 7, 5, 1)]
    assert mixing.corrections({"a": 36.0, "b": -9.0}, sizes) == [("a", 10, 1, 3), ("a", 4, 1, 1), ("a", 1, 1, 2), ("b", 7, -1, 1)]


def test_no_targets_or_documents(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    sel, shares, *_ = mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), t)
    assert sel.count() == 0 and shares.first().share == 0


# --- problem 10


RESIDUE = [
    ("Dear {{ name }}, your order is ready.", "placeholder"), ("${price} gold", "placeholder"), ("#{user} / %title% / <%= x %>", "placeholder"), ("次回の集合は【日付未設定】です。", "placeholder"), ("<h1>%s</h1>", "placeholder"),
    ("[[author]]さん", "placeholder"), ("{2}さんが[ITEM_NAME]を", "placeholder"), ("__NAME__: @@date@@", "placeholder"), ("In the wiki you write ${name} and the bot swaps in the recruit.", None), ("```\n{{ name }}\n```\ncode above", None),
    ("50%増し、つまり40%引き", None), ("[TOP] [一覧] [過去ログ]\n本日は晴天なり。よい日だった。", None), ("404 Not Found\nThe requested URL /x was not found on this server.", "error"), ("ホーム | 掲示板 | 検索 | ヘルプ\nエラー: 閲覧する権限がありません（コード 414）", "error"),
    ("団長が404の画面を貼って「ページが見つかりません」と騒いでいたが、綴り間違いだった。", None), ("Please enable JavaScript to view this board.", "notice"), ("With JavaScript off the map still works, as she showed.", None), ("TBD...", "stand_in"), ("工事中\n\n- - -\n", "stand_in"),
    ("ＴＥＳＴ ＴＥＳＴ ＴＥＳＴ", "stand_in"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("The running joke is that she speaks only lorem ipsum after two mugs of mead.", None), ("ダミーの段落です。 サンプルの文です。", "filler"), ("", None), (" \n", None), (None, None),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(RESIDUE)], "doc_id long, text string, residue_note string")
    got = {r.doc_id: r.residue for r in residue.residue_kind(df).collect()}
    assert [(RESIDUE[i][0], got[i]) for i in range(len(RESIDUE))] == RESIDUE


def test_queries_run_on_empty_tables(spark, data, tmp_path):
    from corpuskit.llm import oracle, queries

    for f in os.listdir(data):
        spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(f"{tmp_path}/{f}")
    assert set(oracle.ORACLE) <= set(queries.QUERIES)
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_queries_run_on_the_small_tables(spark, data):
    from corpuskit.llm import queries

    for name, q in queries.QUERIES.items():
        assert q(spark, data).count() > 0, name


# Wordings that stand nowhere in the test tables.
HELD_OUT = [
    "Sorry, we couldn't find that page. It may have been moved or deleted.",
    'JavaScript is disabled in your browser. Please turn it on to see this site.',
    'このページは現在ご利用いただけません。時間をおいて再度アクセスしてください。',
    'Text will be added here shortly.',
    '内容は後日追加します。',
    'Seite konnte nicht gefunden werden.',
    "Cette page n'existe pas ou plus.",
    '页面无法显示，请稍后再试。',
    '서버 오류가 발생했습니다. 잠시 후 다시 시도해 주세요.',
    'Something went wrong while loading this page.',
    'You must allow scripts to use this site.',
    'スクリプトをオンにしてご覧ください。',
    'Dummy text for the intro section.',
    'このサイトは現在準備中です。',
    'Insert headline here',
    'Hier folgt später ein Text.',
    'Page under construction - check back soon',
    'java.lang.NullPointerException: null\n  at board.View.render(View.java:44)',
    '503 Service Temporarily Unavailable\nnginx/1.18.0',
    'ここにタイトルを入力してください',
    'Der Server ist überlastet. Bitte versuchen Sie es später erneut.',
    'หน้าเว็บนี้ต้องใช้ JavaScript',
    'इस पृष्ठ के लिए जावास्क्रिप्ट आवश्यक है।',
    'Le serveur est temporairement indisponible.',
    'hello testing testing',
    'テスト投稿',
    '내용 준비 중입니다.',
    '正文稍后补充。',
    "ERROR 1045: Access denied for user 'board'@'localhost'",
    'Ce site requiert JavaScript pour fonctionner.',
    "nginx/1.18.0\n502 Bad Gateway",
    "Bitte schalten Sie Skripte ein oder aktivieren Sie JavaScript.",
    "Une erreur est survenue, le document est introuvable.",
    "このファイルは削除されたか、存在しません。",
]
TALK = [
    'I wrote a page about how the server broke last night: it said 404 Not Found and everyone in the guild laughed for an hour before the smith fixed it.',
    '昨日サーバーが落ちて『ページが見つかりません』と出たけど、みんなで釣りに行って楽しかったよ。',
    'The tutorial shows how to greet users.\nWrite the name between double braces,\nlike {{ name }} in the greeting,\nand the template engine replaces the placeholder with the value.',
    'The key was not found in the old mill.',
    'Der Server hat heute Brot gebracht.',
    'We tested the new bow all week and the captain approved.',
    'Please enable the lantern before you enter the mine.',
    "The moderator read the page aloud and the thread went on for days.",
    "ここに来れば本文の続きを聞けると船長が言ったので皆で港へ行った。",
]


def test_residue_in_other_words(spark):
    """Recall of at least 95 % on wordings of our own, none of the texts that talk of them."""
    df = spark.createDataFrame(list(enumerate(HELD_OUT + TALK)), "id int, text string")
    got = {r.id: r.residue for r in residue.residue_kind(df).collect()}
    found = [got[i] is not None for i in range(len(HELD_OUT))]
    assert sum(found) >= 0.95 * len(found), [x for x, f in zip(HELD_OUT, found) if not f]
    assert not [TALK[i - len(HELD_OUT)] for i in range(len(HELD_OUT), len(got)) if got[i]]


def test_machinery_is_learned_and_content_beside_an_error_is_kept(spark):
    bar, banner = "Zork ~ Quux ~ Frobnicate ~ Plugh", "powered by blorple engine 7"
    rows = [(f"a{i}", f"{bar}\n404 Not Found\n{banner}") for i in range(20)] + [(f"b{i}", f"We sailed on day {i}.\nThe bell was found again.") for i in range(30)]
    rows += [("c", f"{bar}\nThe captain read us the whole story of the drowned belfry.\n404 Not Found")]
    df = spark.createDataFrame([(i, t, a) for i, (a, t) in enumerate(rows)], "id int, text string, author_id string")
    got = {r.id: r.residue for r in residue.residue_kind(df, author="author_id").collect()}
    assert all(got[i] == "error" for i in range(20)) and all(got[i] is None for i in range(20, 51))


def test_residue_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (1, " \n ", "k"), (1, "404 Not Found", "k"), (1, "404 Not Found", "k"), (2, "k" * 200_000, None), (2, "@" * 50_000 + "『" * 50_000, None), (2, "page boat " * 10_000, None)], "id int, text string, key string")
    got = residue.residue_kind(df).collect()
    assert sorted((r.id, r.text is None, r.residue or "") for r in got if r.residue) == [(1, False, "error")] * 2 and len(got) == 8
    assert residue.residue_kind(df.limit(0)).count() == 0


def test_gains_of_garbled_copies_are_those_of_candidates(model):
    lines = ["Naïve café", "Grüße aus Köln, schöne Straße", "Ещё одна проверка текста", "これはテストです。", "ｱｲｳ と ソース", "tab\tet là", "prix: 12 €\r", "안녕하세요 여러분", "中文测试文本", "x \x85 é", "plain with one ’ only", "a\x01é", "🙂 ok"]
    got = sorted(g for which, gains in mojibake.true_gains(lines, model) for g in gains)
    want = []
    for line in lines:
        for bad in mojibake.garble(line):
            if any(new == line for _, new in mojibake.candidates(bad)):
                want.append(model.score(line) - model.score(bad))
    assert len(got) == len(want) > 100
    assert got == pytest.approx(sorted(want), abs=0.01)


def test_margin_is_bounded_by_every_clean_record(spark, model):
    texts = [f"été {i}\nsüß {i % 7}" for i in range(900)] + ["plain", "caf\ufffd", None]
    rows = mojibake.fields(spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "id string, content string, threadTitle string"))
    shared = spark.sparkContext.broadcast((model.pairs, model.chars))
    counts = {r.bin: r.n for r in mojibake.gain_counts(rows, shared).collect()}
    ways = [len(w) for w, _ in mojibake.true_gains(["été 1", "süß 1"], model)]
    assert sum(counts.values()) == 900 * sum(ways) > 10_000
    assert mojibake.least_true_gain({64: 999, -3: 1}) == -3 / 64 and mojibake.least_true_gain({64: 1_000_000, -3: 5}) == 1.0 and mojibake.least_true_gain({}) > 0


def test_margin_is_bounded_by_clean_records_that_show_a_doubtful_trace(spark, model):
    texts = ["远征归途，图书塔管理员在吊桥边把条纹披风弄丢了！", "昨日の深夜に黒帆の船長が灯台の屋上で鈴を拾った。", "été"]
    bad = "The clerk doesn’t trust it.".encode().decode("gb18030")
    both = [*texts, bad]
    points, rows = mojibake._laid_out(both)
    traced = mojibake.traced_rows(points, rows, 4) & ~mojibake.surely_traced_rows(points, rows, 4)
    assert traced[0] or traced[1]
    schema = "id string, field string, text string"
    shared = spark.sparkContext.broadcast((model.pairs, model.chars))
    counts = mojibake.clean_gains(spark.createDataFrame([(str(i), "content", t) for i, t in enumerate(both)], schema), spark.createDataFrame([("3", "content", bad)], schema), shared)
    want = [g for _, gains in mojibake.true_gains(texts, model) for g in gains]
    assert sum(counts.values()) == len(want) > 20
    assert min(counts) == int(np.floor(min(want) * mojibake.TRUE_BINS))


def test_tables_of_code_points_are_made_once_per_process_and_are_the_codecs():
    import pickle

    from pyspark import cloudpickle

    assert pickle.loads(cloudpickle.dumps(mojibake.trace_flags))() is mojibake.trace_flags()
    rng = random.Random(1)
    for name in mojibake.MULTI:
        first, second = mojibake.byte_tables(name)
        for c in [0x80, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x10FFFF, *(rng.randrange(0x80, 0xD800) for _ in range(3_000))]:
            raw = mojibake._encodes(chr(c), name) or b"\0"
            if name != "cp932" or c < 0x10000:
                assert (first[c], second[c]) == (raw[0], raw[1] if len(raw) > 1 else 0), (name, hex(c))


def test_readings_of_lines_taken_together_are_those_of_each(model):
    rng = random.Random(3)
    good = ["昨日の深夜に黒帆の船長が沈んだ鐘楼で銀のコンパスを拾った。", "The naïve recruit said ‘no’ – isn’t it?", "Kurz vor fünf hat der Türmer zwei Münzen geöffnet.", "远征归途，图书塔管理员在吊桥边把条纹披风弄丢了！", "Ещё одна проверка текста"]
    lines = [b[:i] + x + b[i:] for g in good for b in mojibake.garble(g) for x in ("", "�", "\x85", "é", "ãÐ") for i in [rng.randrange(len(b))]] + good
    together = mojibake.repair_lines(lines, model, 4.0)
    assert together == [mojibake.repair_line(line, model, 4.0) for line in lines] and sum(x[1] != "" for x in together) > 50
    # One after the other, as bytes: what a run of a one-byte codec holds of UTF-8, where UTF-8 forbids none of it.
    for line in lines:
        for wrong in mojibake.SINGLE[1:]:
            codecs = mojibake.Codecs.get()
            want, at, parts = line, 0, []
            for run in codecs.runs[wrong][0].finditer(line):
                raw = run.group(0).translate(codecs.to_byte[wrong]).encode("latin-1")
                for x in codecs.utf8.finditer(raw):
                    try:
                        new = x.group(0).decode()
                    except UnicodeDecodeError:
                        continue
                    parts += [line[at : run.start() + x.start()], new]
                    at = run.start() + x.end()
            want = "".join(parts) + line[at:]
            assert dict(mojibake.candidates(line)).get(f"{wrong}>utf-8", line) == want


def test_pieces_of_a_batch_share_no_work_but_keep_their_verdicts(model):
    bad = "Don’t ask the captain.".encode().decode("gb18030")
    texts = ["plain", bad, "远征归途，图书塔管理员在吊桥边把条纹披风弄丢了！", f"plain\n{bad}", bad]
    assert mojibake.readable(texts, model) == [mojibake.readable([t], model)[0] for t in texts]
    assert mojibake.readable(texts, model)[1:] == [True, False, True, True]


def test_a_long_line_is_read_once():
    # A stretch that is read, and then sequences that begin within a character: what lies
    # between was once decoded anew for each of them.
    tail = (bytes.fromhex("b0c3b0b0") * 200_000).decode("gb18030")
    line = "中文".encode().decode("gb18030") + tail
    began = time.process_time()
    assert dict(mojibake.candidates(line))["gb18030>utf-8"] == "中文" + tail
    assert time.process_time() - began < 10


def test_stops_of_abbreviations_are_those_of_the_words_themselves(spark):
    kinds = [sentences.ALWAYS, sentences.BEFORE_NUMBER, sentences.MAYBE_LAST, ["A", "z", "\U00010400", "am 3", "jeder 123", "3", "12", "𝟏𝟐"]]
    words = [unicodedata.normalize(form, w) for own in kinds for w in own for form in ("NFC", "NFD")]
    after = ["", ".", " ", " next", " Next", " 7", "7", ", and", "; x", ")", " - a", "-B", " März", "田", "\n", " März"]
    texts = [f"{before}{w}.{a}" for w in words for before in ("", "so ", "x", "(", "4", "1,") for a in after]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.regexp_replace(t, sentences._dots(), sentences._DOT).alias("a"), sentences._dots_masked_softly(t).alias("b")).collect()
    assert [r.t for r in rows if r.a != r.b] == [] and sum(r.a != r.t for r in rows) > 2_000
