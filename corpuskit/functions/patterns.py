"""Pattern tables by which lines and texts are classified; the first of a table that fits leads."""

from __future__ import annotations

# Families of quotations.
FAMILIES = {
    "anger": "怒|切れ|有頂天|逆鱗|ふるかい|不快|謝", "lament": "悲し|絶望|寿命|一巻の終わり|いくえ不明|手遅れ", "warning": "危険|気をつけ|死|骨になる|病院|裏世界|犯罪|逮捕",
    "victory": "勝|論破|カウンター|これで勝つる|最強|唯一ぬに", "humility": "謙虚|それほどでもない|一歩引く|心が広", "evidence": "証拠|証明|事実|ノンフィクション|見ろ|確定",
    "prediction": "予知|最初から|目に見えて|シュミレート|発覚", "comparison": "対等|格が違|対して|よりも|ナンバー|一般社会", "surprise": "びび|ギク|驚|ほう・・|おいィ|何いきなり",
    "power": "パワー|破壊力|ワンパン|パンチ|ノーリスク|加速|攻撃力", "instruction": "見習|べき|勉強|注意|改心|義務|しきたり", "denial": "関係ない|はげていない|狩られる側じゃない|大反対|ノーなんで",
}
# Speech acts.
SPEECH_ACTS = {
    "gratitude": "感謝|ありがと|お礼|礼を言",
    "agreement": "賛成|同意|禿同|同じ意見|激しく同意|支持|確かにな",
    "attention_call": "おいィ|聞こえたか|見ろ[、,]|ほらみた|何いきなり|先に言っておく|覚えておけ",
    "apology_contract": "謝罪|謝る|あやま|約束|誓い|改心|許して|守られなければ",
    "grievance": "ずるい|卑怯|ヒキョウ|汚い|きたない|不公平|おかしい|恥知らず|非常に人をふるかい",
    "opponent_evaluation": "馬鹿|バカ|雑魚|ザコ|偽者|弱かった|弱々しい|烏合|浅はか|愚か|醜い|必死だな|反乱者|カス猿|口だけ",
    "social_typing": "チーム|四天王|タイプ|ミニオン|使う奴|使いがいた|性格が悪|反乱者|人気者|孤高の|○○美|不良界|一般人",
    "pseudo_logic": "公式が成り立|＝|=|だから|なので|なぜなら|ようするに|というのが|という事|結果だった|つまり|同然|証拠",
    "paradox_repetition": "稀にだがよく|普通は普通|唯一ぬに|パワーの力|破壊力.{0,12}破壊力|最強.{0,16}最強|前門の.{0,12}前門の",
    "lexical_reanalysis": "名誉既存|真骨董|多勢に風情|ぎゃくりん|だんぺん|ぜいいん|じょうずく|ヨミヨミ|ホイッスル|役不足|確信犯|太公望は釣竿|女王の守りというのが女",
    "withdrawal_closure": "一歩引く|シャッタアウト|じゃあな|闇系の仕事|このスレはしんだ|もう来なくて|幕を閉じ|これで終わり",
    "fear_submission": "怖い|震え|完敗|言い返す言葉|泣き|諦め|なす術なし|グーの音|黙った",
    "challenge_retort": "牙抜いて|ライバル視|張り合|勝負|相手になら|何いきなり|口だけ|カウンター",
    "threat_warning": "死ぬ|殺|殴|蹴|骨になる|病院|幕を閉じ|ボコ|危険|手遅れ|注意|謝るべき|やめろ馬鹿|仏の顔|バラバラ|ズタズタ",
    "denial_disclaimer": "ではない|じゃない|関係ない|偽者|捏造|無実|ノーなんで|違う|話は別|ノーダメージ|はげていない",
    "evidence": "証拠|証明|明らか|見ろ|ノンフィクション|事実|決定打|信頼性|見ればわか",
    "self_rank": "一級|最高|最強|ナンバー[１1]|Ｐ[ｽス]キル|憧れ|人気者|伝説|唯一ぬに|格が違|一般人|頼りにされる|誘いがあっては一人の時間",
    "power_action": "パワー|攻撃|パンチ|破壊|加速|雷属性|ホーリ|論破|封印|鉄の塊|防御|盾|武器|スウィフト|スウィスト|キラーマッシン|強すぎ|つよすぎ",
    "victory_result": "勝つる|勝率|圧勝|勝利|完全.{0,4}(?:解決|論破)|倒し|返した|終了|成功",
    "praise_humility": "それほどでもない|謙虚|誉め|褒め|感心|関心|見事|憧れ|すごいですね|心が広大|心配り|人気の秘訣|god job",
    "lament_crisis": "悲し|絶望|寿命|手遅れ|いくえ不明|ゲームオーバー|ｹﾞｰﾑｵｰﾊﾞｰ|一巻の終わり|顔面蒼白",
    "prediction_certainty": "予知夢|わかってた|目に見えて|シュミレート|確定的|最初から|間違いなく|決まって",
    "instruction": "するべき|すべき|するな|やめろ|注意|謝るべき|改心|見習|覚えておけ|知らないか",
    "reaction_inference": "びび|ギク|黙った|笑顔|表情|驚|グーの音|肩に暖か|泣き|恐怖|諦め|拳を上げ|誰それ|外人|歌[？?]",
    "metalinguistic": "英語でいう|って意味|という意味|読み方|文字|名前|名誉既存|役不足|確信犯",
    "repair_correction": "間違|勘違い|訂正|だった馬鹿|ちょっとミス|焦ってれば|言い間違",
}
# Dimensions of style.
STYLE_DIMENSIONS = {
    "viewpoint": "俺|おれ|お前|おまえ", "orthography": "[ｦ-ﾟ]|ぜいいん|すぐる|どちか|あもりにも", "connective": "やはり|しかも|さらに|だが|という話なんだが", "certainty": "事実|真実|明らか|決ま|高確率|確実",
    "amplification": "かなり|圧倒|最強|一級|超|致命的|絶望的|あもりにも|すぐる|本気を出", "signature": "有頂天|時既に|ｶｶッ|ばつ牛ﾝ|忍者きたない|アワレ|遅れをとる|騒ぐと危険",
    "reaction": "リアルでビビ|顔真っ赤|青ざめ|眼差し|らしい|震え|指先|手足|体温|吐く息|身体の動き", "rank": "一般人|一級|ランク|格の違い",
}
# Motifs of longer texts.
MOTIFS = {
    "storyLead": "これは.+(?:話|こと)なんだが|昔の話で|先日の話", "contrast": "普通なら|一般人なら|だが|しかし|ところが", "selfRank": "一級|最強|プロ|実力|ランク|一般人", "reactionInference": "ビビった|顔真っ赤|青ざめ|驚き|眼差し|圧倒された",
    "evidenceClaim": "事実|真実|証拠|明らか|判明|決まって", "expansion": "やはり|しかも|さらに|その結果|という事", "realWorldBridge": "リアル|現実|学校|仕事|クラス|店長|病院", "aside": r"（[^）]+）|\([^)]*\)",
}
# Markers whose rates make the profile of a series.
MARKERS = {
    "halfwidthKana": "[ｦ-ﾟ]", "beQuestion": "べ[？?]", "certainty": "確定的|決定的|明らか|証明", "canonical": "黄金の鉄|一般人|Ｐスキル|ﾌﾟﾚｲﾔｰｽｷﾙ|遅れをとる", "narrative": "いたんだが|見ていたら|案の定|思い出したので|アワレ", "semicolonEmoticon": "[＾^]{2}[；;]{2,}",
}
# Constructions of a reply mark, told by what follows it (after), the line or both.
ANCHOR_AFTER = {
    "fused_performative": r"^(?:感謝|ありがとう|乙|謝罪|祝福)(?:\b|$)", "agreement_target": "^(?:に|の意見に)(?:超)?(?:賛成|同意|禿同)", "evidence_source": "^(?:に|で|が|を|の).{0,24}(?:証拠|証明|言うように|見て|内容|信頼性)",
    "evaluation_target": "^(?:は|が|お前).{0,32}(?:賢|馬鹿|バカ|偽者|嘘|死ぬ|能力|雑魚|必死)", "vocative": "^(?:よ[、,]?|お前)",
}
AGREEING_LINE = "(?:賛成|同意|禿同)$"
# Kana read as digits, and words that are none.
DIGIT_KANA = {"れぜお": "0", "いひ": "1", "にふつ": "2", "さみ": "3", "しよ": "4", "ごこ": "5", "ろむ": "6", "な": "7", "はや": "8", "くき": "9"}
NO_READING = "これ それ あれ こいつ って きた んで たら".split()
