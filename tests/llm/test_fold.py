import random
import unicodedata

import pytest

from linkspark.llm.fold import consistent_values, disguised, with_consistent

CASES = {
    "塔冬ヨネキ一ロデザイン株式会社": "塔冬ヨネキーロデザイン株式会社",
    "萩亀エ業": "萩亀工業",
    "エ房会館": "工房会館",
    "ﾀﾞｸﾋﾞｴ薬品": "ダクビエ薬品",
    "カ二エ会館二階": "カニエ会館二階",
    "ハ口一会館五階": "ハロー会館五階",
    "タワー一階": "タワー一階",
    "ビル二階": "ビル二階",
    "五丁目ニ十七番": "五丁目二十七番",
    "3ー13ー35": "3-13-35",
    "１２３－４": "123-4",
    "honсho": "honcho",
    "Ήλιoς": "Ήλιος",
    "Вектор": "Вектор",
    "Oрбита": "Орбита",
    "システム一般社団法人": "システム一般社団法人",
    "霧岡本‍\U000e0100町︀2丁目": "霧岡本町2丁目",
    "été x": "été x",
    "社社⾧": "社社長",
    "力丸プラザ": "力丸プラザ",
    "工": "工",
    "": "",
    "㈱ソニー": "(株)ソニー",
    "㍿": "株式会社",
    "①番": "1番",
    "ﬁrm²": "firm2",
    "℡": "TEL",
    "Ⅷ": "VIII",
    "㌔": "キロ",
    "Ꭺpple": "Apple",
    "Ⲣark": "Park",
    "ꓟario": "Mario",
    "ηasutomi": "hasutomi",
    "βappahiida": "bappahiida",
    "вeктор": "вектор",
    "μm": "μm",
    "きたかわずゆー精機": "きたかわずゆー精機",
    "ほんちょうー丁目": "ほんちょう一丁目",
}


def test_cases_and_edges(spark):
    rows = [(i, v, None, v * 3000 if i < 3 else v, "x") for i, v in enumerate(CASES)] + [(99, None, None, None, "x")]
    df = spark.createDataFrame(rows + rows[:2], "id bigint, name string, name_normalized string, address string, v string")
    got = consistent_values(df, "id", ["name", "name_normalized"]).collect()
    assert len(got) == len(CASES) + 2 and all(r.consistent == CASES[r.value] for r in got)
    found = [(r.id, r.field_name) for r in disguised(df).where("field_name = 'name'").collect()]
    want = [i for i, (a, b) in enumerate(CASES.items()) if a != b]
    assert sorted(x for x, _ in found) == sorted(want + [i for i in (0, 1) if i in want])
    new = with_consistent(df, ["name"]).where("id < 90").dropDuplicates(["id"]).collect()
    assert {r.id: r.name for r in new} == dict(enumerate(CASES.values())) and all(r.v == "x" for r in new)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, name string, name_normalized string, address string")
    assert disguised(df).count() == 0 and with_consistent(df, ["name"]).count() == 0


@pytest.mark.parametrize("text", [v for v in CASES.values() if v])
def test_consistent_form_is_stable(spark, text):
    df = spark.createDataFrame([(1, text)], "id bigint, name string")
    assert consistent_values(df, "id", ["name"]).first().consistent == text


PLAIN = ["株式会社ネキーロデザイン", "萩亀工業 Hagikame", "清瀬本町3-13-35", "タワー一階 Northgate", "ハロー会館五階", "Вектор", "Ήλιος", "カニエダクグ薬品", "ギガバイト", "Acme Trading K.K."]


def disguise(text, rnd):
    """The text with other characters that look the same, planted by tables of their own."""
    way = rnd.randrange(6)
    if way == 0:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "\u3000" if c == " " else c for c in text)
    if way == 1:
        at = rnd.randrange(len(text) + 1)
        return text[:at] + rnd.choice("\u200b\u200d\u2060\ufeff\u00ad\ufe00\u200e") + text[at:]
    if way == 2:
        return unicodedata.normalize("NFD", text)
    if way == 3:
        return text.replace(" ", rnd.choice("\u00a0\u2009\u202f\u2002")).replace("-", rnd.choice("\u2010\u2013\u2212\uff0d"))
    if way == 4:
        return text.replace("社", "\ufa4c").replace("目", "\u2f6c").replace("工業", "\u2f2f業")
    half = {unicodedata.normalize("NFKC", chr(c)): chr(c) for c in range(0xFF71, 0xFF9E)} | {"ー": "ｰ"}
    return "".join(half.get(c, c) for c in text) if not any("A" <= c <= "z" for c in text) else text.replace("a", "\u0430").replace("o", "\u03bf")


def test_planted_disguises(spark):
    rnd = random.Random(13)
    pairs = [(p, disguise(p, rnd)) for p in PLAIN for _ in range(40)]
    df = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(pairs)], "id bigint, name string")
    got = {r.id: (r.value, r.consistent) for r in consistent_values(df, "id", ["name"]).collect()}
    assert [got[i] for i, (p, d) in enumerate(pairs) if got[i][1] != p] == []
    found = {r.id for r in disguised(df, fields=["name"]).collect()}
    assert found == {i for i, (p, d) in enumerate(pairs) if p != d} and len(found) > 150
