import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import kana, phonetic, romaji, similarity, text

SUFFIXED = [
    ("Ｓｏｎｙ", "sony"), ("１２３", "123"), ("Sony  Group   Corp", "sony group"), ("Sony\t\tGroup\nInc", "sony group"), ("  Sony  ", "sony"),
    ("monaco", "mona"), ("cocoa", "coa"), ("visa", "vi"), ("saab", "ab"), ("co", "co"), ("", ""), (None, ""), ("Straße GmbH", "strasse"), ("ソニー株式会社", "ソニー"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_normalize(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SUFFIXED)], "i int, t string, want string")
    got = {r.i: r.n for r in text.with_normalized(df, "t", "n").collect()}
    assert got == {i: b for i, (_, b) in enumerate(SUFFIXED)}


def test_normalize_japanese_and_english(spark):
    df = spark.createDataFrame([("有限会社テスト",), ("テスト合同会社",), ("特定非営利活動法人テスト",), ("テ ス　ト株式会社",)], "t string")
    assert {r.n for r in text.with_normalized_japanese(df, "t", "n").collect()} == {"テスト"}
    df = spark.createDataFrame([(x,) for x in ("Sony Corporation", "sony Inc.", "Sony K.K.", "SONY LLC", "Sony GmbH")], "t string")
    assert {r.n for r in text.with_normalized_english(df, "t", "n").collect()} == {"sony"}


def test_normalize_against_plain_python(spark):
    def plain(s):
        def strip(t, forms):
            t = t.strip()
            low = t.casefold()
            for f in forms:
                if low.endswith(f) and t[: len(t) - len(f)].strip():
                    return t[: len(t) - len(f)].strip()
                if low.startswith(f) and t[len(f) :].strip():
                    return t[len(f) :].strip()
            return t

        s = strip(unicodedata.normalize("NFKC", s or ""), text.JAPANESE_FORMS).casefold()
        return " ".join(strip(s, text.ENGLISH_FORMS).split())

    names = [r.name for r in spark.read.parquet("/root/testdata/sf0.001/companies.parquet").select("name").collect()]
    names += [r.en_name for r in spark.read.parquet("/root/testdata/sf0.001/companies.parquet").select("en_name").collect()]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, t string")
    assert {r.i: r.n for r in text.with_normalized(df, "t", "n").collect()} == {i: plain(n) for i, n in enumerate(names)}


def test_trigrams(spark):
    df = spark.createDataFrame([("sony",), ("a",), ("ab",), ("",), (None,)], "t string")
    assert [sorted(r.g) for r in df.select(text.trigrams(F.col("t")).alias("g")).collect()] == [["$so", "ny$", "ony", "son"], ["$a$"], ["$ab", "ab$"], [], []]


@pytest.mark.parametrize(
    ("t", "language", "script"),
    [("ソニー", "ja", "katakana"), ("ありがとう", "ja", "hiragana"), ("東京銀行", "ja", "kanji"), ("Sony", "en", "latin"), ("ソニーSony", "ja", "mixed"), ("", "unknown", "latin"), ("  ", "unknown", "latin"), (None, "unknown", "latin"), ("123", "unknown", "mixed")],
)
def test_language_and_script(spark, t, language, script):
    df = spark.createDataFrame([(t,)], "t string")
    assert rows(df.select(text.detect_language(F.col("t")), text.script(F.col("t")))) == [(language, script)]


def test_phonetic_keys(spark):
    df = spark.createDataFrame([(x,) for x in ("sony", "soni", "Sony", "sony!", "so-ny", "", "123", None, "pfister")], "t string")
    assert [r[0] for r in df.select(phonetic.phonetic_key(F.col("t"))).collect()] == ["S50000"] * 5 + ["", "", "", "P23400"]
    pairs = spark.createDataFrame([("S500", "S530"), ("", ""), ("S500", "")], "a string, b string")
    assert [r[0] for r in pairs.select(phonetic.compare_keys(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, 0.0]


def test_romaji(spark):
    words = ["ソニー", "トヨタ", "きょうと", "がっこう", "ファン", "っ", "", "ーあー", "シェフ", "東京タワー"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", romaji.to_romaji(F.col("t")).alias("r")).collect()}
    assert got[0] == "sonii" and got[2] == "kyouto" and got[3] == "gakkou"
    assert got == {i: kana.kana_romaji(w).lower() for i, w in enumerate(words)}
    assert df.where("i = 9").select(romaji.to_romaji(F.col("t"), {"東京": "トウキョウ"})).first()[0] == "toukyoutawaa"
    v = spark.createDataFrame([("sonii",), ("",)], "t string").select(romaji.romaji_variants(F.col("t"))).collect()
    assert v[0][0] == ["sonii", "soni"] and v[1][0] == []


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def plain_jaro_winkler(a, b):
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, met = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.append(j)
                met.append(c)
                break
    m = len(met)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(met, sorted(used))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@settings(max_examples=400, deadline=None)
@given(st.text("abcあ ", max_size=20), st.text("abcあ ", max_size=20))
def test_kernels(a, b):
    assert similarity.indel_ratio_of(a, b) == pytest.approx(plain_indel(a, b))
    assert similarity.jaro_winkler_of(a, b) == pytest.approx(plain_jaro_winkler(a, b))


def test_engines_agree(spark):
    pairs = [("sony", "soni"), ("sony", "toyota"), ("", ""), ("sony", ""), ("martha", "marhta"), ("Dixon", "dicksonx"), ("sony group", "group sony"), ("東京 銀行", "銀行 東京")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", similarity.jaro_winkler(a, b), similarity.jaro_winkler(a, b, "column"), similarity.token_sort(a, b), similarity.token_sort(a, b, "column")).collect():
        assert r[1] == pytest.approx(r[2]) and r[3] == pytest.approx(r[4])
    assert df.select(similarity.levenshtein(F.lit("cat"), F.lit("hat"))).first()[0] == pytest.approx(2 / 3)


def test_lexicon_of_ideographs(spark):
    from linkspark.functions.romaji import to_romaji
    from linkspark.operators.readings import company_lexicon, lexicon_of

    compounds = {"富雪": "トミユキ", "富岡": "トミオカ", "白雪": "シロユキ", "白岡": "シロオカ", "富菊": "トミキク", "白菊": "シロキク"}
    rows = [(f"ビエダク{k}", f"ビエダク{v}") for k, v in compounds.items()] + [(f"{k}ドサエケ商事", f"{v}ドサエケショウジ") for k, v in compounds.items()] + [(None, "ア"), ("", None)]
    lexicon = company_lexicon(spark.createDataFrame(rows, "name string, furigana string"))
    df = spark.createDataFrame([("東京",), ("富雪銀行",), ("白岡ソニー",), ("龍",), (None,), ("",)], "w string")
    got = {r.w: r.r for r in df.select("w", to_romaji(F.col("w"), lexicon).alias("r")).collect()}
    assert got == {"東京": "toukyou", "富雪銀行": "tomiyukiginkou", "白岡ソニー": "shirookasonii", "龍": "龍", None: "", "": ""}
    assert lexicon_of(spark.createDataFrame([("a", "b"), (None, "c"), ("d", None)], "ideograph string, reading string")) == {"a": "b"}


def test_kernels_of_many_pairs_give_each_pairs_own_score():
    import random

    from linkspark.functions import similarity

    rnd = random.Random(5)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    pairs = [(word(letters, n), word(letters, n)) for letters in ("ab", "abcdefgh ", "a\0漢😀") for n in (1, 5, 30, 64, 80) for _ in range(150)]
    pairs += [("a" * n, "a" * m) for n in (63, 64, 65) for m in (63, 64, 65)]
    for kernel, together in ((similarity.jaro_winkler_of, similarity._jaro_winkler_together), (similarity.indel_ratio_of, similarity._indel_ratio_together)):
        assert similarity._scores(*map(list, zip(*pairs)), kernel, together).tolist() == [kernel(a, b) for a, b in pairs]
