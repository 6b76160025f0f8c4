"""Sentences written by hand for training `sentences` beside a corpus: their boundaries are known without any rule. Tests use
other ones."""

from __future__ import annotations

import random

# Ordinary sentences, one a line.
WRITTEN = {
    "zh": """今天天气很好。
我昨天去了图书馆。
你吃饭了吗？
他正在学习中文。
我们明天一起去公园吧！
这本书是我朋友送给我的。
她在北京工作了三年。
请问，地铁站在哪里？
妈妈做的菜非常好吃。
学校门口有一家小商店。
弟弟不喜欢喝牛奶。
老师说下个星期有考试。
因为下雨，所以我没有出门。
你觉得这件衣服怎么样？
火车八点半出发。
他们已经到家了。
我想买一台新的电脑。
公司的会议改到星期五了。
这个问题很难回答。
春天来了，花都开了。
爷爷每天早上去散步。
别忘了给他打电话！
医生让我多休息。
北京是中国的首都。
我的手机没电了。
他跑得很快。
谁知道答案呢？
那只猫在桌子下面睡着了。""",
    "ja": """今日はとても暑いです。
昨日、友達と映画を見ました。
明日は何時に起きますか？
私は東京に住んでいます。
この本はとても面白かった。
駅までどうやって行きますか？
母は料理が上手です。
弟はまだ学校から帰っていません。
来週、京都へ旅行に行きます。
コーヒーを一杯ください。
雨が降っているので、出かけたくない。
彼は毎朝走っています。
猫が窓のそばで寝ている。
会議は三時から始まります。
ここで写真を撮ってもいいですか？
日本語は難しいけれど、楽しい。
新しい電話を買いました。
先生は本を読むように言った。
電車が遅れているようだ。
春になると桜が咲きます。
彼女は歌を歌うのが好きだ。
この問題は簡単ではない。
お名前は何ですか？
兄は大学で働いています。
荷物は明日届くでしょう。
どうぞ座ってください。""",
    "lt": """Šiandien labai šalta.
Vakar lijo visą dieną.
Rytoj važiuosime prie ežero.
Ar tu jau pavalgei?
Mano brolis dirba ligoninėje.
Ji gyvena Kaune ir mokosi universitete.
Mes ilgai laukėme autobuso.
Kur padėjai mano knygą?
Kaimynai pardavė seną namą.
Vaikai žaidžia kieme.
Tai buvo geriausia metų diena.
Aš nežinau, ką jam pasakyti.
Kodėl jis taip vėlai grįžo?
Mokytoja paprašė tylos.
Po pamokų einame į biblioteką.
Jie susitiko prie upės.
Mama iškepė obuolių pyragą.
Kitą savaitę prasidės atostogos.
Jeigu lis, liksime namuose.
Oras greitai keičiasi.
Tėvas taiso dviratį garaže.
Kas atidarė langą?
Miesto centre statomas naujas tiltas.
Buvo tylu ir ramu.
Seneliai mums parašė laišką.
Tada visi nuėjo miegoti.
Man labai patinka šis filmas.
Neseniai grįžome iš kelionės.""",
    "en": """The train was late again this morning.
She bought bread and milk on the way home.
What time does the shop open?
My brother works in a small hotel near the sea.
We waited for an hour in the rain.
Nobody knew where the key was.
After lunch they went for a walk.
It was a quiet evening.
He never answers my letters.
Did you see the new bridge?
There is a garden behind the house.
They sold the old car last week.
I think we should leave now.
The children were playing in the yard.
When the lights went out, everyone laughed.
Please close the window.
Her answer surprised us all.
Then the music started.
This book is too long for me.
If it rains we will stay at home.""",
    "de": """Heute ist es sehr kalt.
Wir haben lange auf den Bus gewartet.
Wo hast du das Buch gekauft?
Mein Bruder arbeitet in einem Hotel.
Die Kinder spielen im Garten.
Nach dem Essen gingen sie spazieren.
Das war ein schöner Abend.
Sie wohnt seit drei Jahren in Köln.
Niemand wusste die Antwort.
Warum kommt er immer zu spät?
Morgen fahren wir ans Meer.
Es regnet schon den ganzen Tag.
Ich habe meinen Schlüssel vergessen.
Dann fing die Musik an.
Der Zug fährt um acht Uhr ab.""",
    "pl": """Dzisiaj jest bardzo zimno.
Długo czekaliśmy na autobus.
Gdzie kupiłeś tę książkę?
Mój brat pracuje w szpitalu.
Dzieci bawią się w ogrodzie.
Po obiedzie poszli na spacer.
Ona mieszka w Krakowie od trzech lat.
Nikt nie znał odpowiedzi.
Jutro jedziemy nad morze.
Dlaczego on zawsze się spóźnia?
To był piękny wieczór.
Wczoraj padał deszcz.
Zapomniałem kluczy.
Potem zaczęła grać muzyka.""",
    "ru": """Сегодня очень холодно.
Мы долго ждали автобус.
Где ты купил эту книгу?
Мой брат работает в больнице.
Дети играют во дворе.
После обеда они пошли гулять.
Она живёт в Москве три года.
Никто не знал ответа.
Завтра мы едем к морю.
Почему он всегда опаздывает?
Вчера шёл дождь.
Это был тихий вечер.
Я забыл ключи дома.
Потом заиграла музыка.""",
}


# Parts of Chinese sentences (who, when, what, how it ends), as its sentences can't be told by gaps.
CHINESE = (
    "我 你 他 她 我们 你们 他们 老师 妈妈 爸爸 弟弟 妹妹 朋友 医生 学生 孩子 小王 李先生 那个人 大家".split(),
    "今天 昨天 明天 每天 早上 晚上 下午 现在 已经 常常 上个星期 去年 有时候".split() + [""] * 6,
    "去商店 回家 看书 学习中文 喝茶 吃饭 写信 打电话 在家休息 去学校 坐火车 买东西 做饭 听音乐 看电影 跑步 上班 很高兴 很忙 不舒服 不想出门 没有来 住在北京 喜欢唱歌 会说英语 找不到钥匙".split(),
    ["了", "了", "", "", "", "吗", "吧", "呢"],
)


def _chinese(rng: random.Random) -> str:
    who, when, what, end = (rng.choice(x) for x in CHINESE)
    return rng.choice([who + when, when + who]) + what + end + ("？" if end in ("吗", "呢") else rng.choice("。。。！"))


def written(rng: random.Random) -> tuple[str, set[int]]:
    """A text of some sentences of one language, and where each but the first begins."""
    lang = rng.choice([*WRITTEN, "zh", "zh", "ja", "lt", "lt"])
    lines = WRITTEN[lang].split("\n")
    text, at = "", set()
    for k in range(rng.randrange(2, 12)):
        if k:
            text += "" if lang in ("zh", "ja") else rng.choice([" ", " ", " ", "\n"])
            at.add(len(text))
        text += _chinese(rng) if lang == "zh" and rng.random() < 0.7 else rng.choice(lines)
    return text, at
