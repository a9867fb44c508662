import random
import re

import pytest

from linkspark.functions.kana import kana_romaji
from linkspark.llm.addresses import AddressParser, _meeting_towns, number, same_place, same_place_pairs
from linkspark.llm.lexicons import Lexicons, learnt
from linkspark.llm.names import NameParser, _near, one_slip, same_organisation, segment_join
from linkspark.llm.readings import plain_spelling, reading_lexicon

PREFECTURES = [("13", "岡東県", "Okahigashi"), ("07", "道秋県", "Michiaki")]
LEXICON = dict(zip("林岡富雪白菊若坂宮広市島", "hayashi oka tomi yuki shiro kiku waka saka miya hiro shi shima".split()))
ADDRESS = "corporate_number string, prefecture_code string, city string, address string, name string, furigana string, k string"


def place(p, c, a):
    return AddressParser(PREFECTURES, LEXICON).parse(p, c, a)


@pytest.mark.parametrize(("text", "value"), [("12", 12), ("三六三", 363), ("二十七", 27), ("十", 10), ("百二", 102), ("二百三十一", 231), ("一〇", 10)])
def test_numbers(text, value):
    assert number(text) == value


def test_writings_of_a_place():
    ways = [
        ("13", "宮広市", "富雪町5丁目26番9号"), ("13", None, "宮広市富雪町 5-26-9 ビエタワー3階"), (None, None, "岡東県宮広市富雪五丁目二十六番九号"), ("13", "宮広", "富雪5の26の9"),
        ("13", "宮広市", "とみゆきちょう5丁目26-9"), ("13", None, "5-26-9, Tomiyuki-cho, Miyahiro-shi"), ("13", "宮広市", "Caféビル8階808号室 富雪町５－26－9".replace("５－", "5-").replace("－", "-")), ("13", "岡東県宮広市", "大字富雪町 5丁目26の9"),
    ]
    for w in ways:
        got = place(*w)
        assert (got["prefecture"], got["city_read"], got["town_read"], got["kind"], got["lots"]) == ("13", "miyahiro", "tomiyuki", "", "5-26-9"), w
    assert place("13", "宮広市", "富雪本町5-26-9")["kind"] == "h"
    for nowhere in (None, "", "  ", "富雪町", "富雪町5丁目", "富雪"):
        assert place("13", "宮広市", nowhere) is None


def test_same_place(spark):
    rows = [
        ("a", "13", "宮広市", "富雪町5丁目26番9号"), ("b", "13", None, "宮広市富雪5-26-9"), ("b", "13", None, "宮広市富雪5-26-9"), ("c", None, "宮広市", "富雪町5の26の9 ビエタワー"),
        ("d", "13", "宮広市", "富雪本町5-26-9"), ("e", "13", "宮広市", "富雪町5-26-8"), ("f", "07", "宮広市", "富雪町5-26-9"), ("g", "13", "若島市", "富雪町5-26-9"),
        ("h", "13", "宮広市", None), (None, "13", "宮広市", "富雪町5-26-9"), ("i", "13", "宮広市", "富雪町"), ("j", "13", "宮広市", "白菊町200番地3"), ("k", "13", "宮広市", "白菊200-3"), ("l", "13", "宮広市", "白" * 20_000),
    ]
    df = spark.createDataFrame([(*r, "n", "f", "x") for r in rows], ADDRESS)
    pref = spark.createDataFrame(PREFECTURES, "prefecture_code string, pref_name string, pref_romaji string")
    got = {tuple(r) for r in same_place(df, pref).collect()}
    # c has no prefecture and would fit the places of a and of f, which are two
    assert got == {("a", "b"), ("j", "k")}
    without_f = {tuple(r) for r in same_place(df.where("corporate_number <> 'f'"), pref).collect()}
    assert without_f == {("a", "b"), ("a", "c"), ("b", "c"), ("j", "k")}
    assert same_place(df.limit(0), pref).count() == 0


def test_missing_parts_join_no_two_places(spark):
    rows = [
        ("a", "13", "宮広市", "富雪町5-26-9"), ("b", "07", "若島市", "富雪町5-26-9"), ("c", None, None, "富雪町5-26-9"), ("d", None, None, "富雪町5の26の9"),
        ("e", "13", "宮広市", "白菊町1-2-3"), ("f", None, "宮広市", "白菊町1-2-3"), ("g", "13", None, "白菊町1-2-3"), ("h", None, None, "白菊1-2-3"),
        ("i", None, "若島市", "林岡町7-8-9"), ("j", "07", None, "林岡町7-8-9"), ("k", None, None, "林岡町7-8-9"),
    ]
    df = spark.createDataFrame([(*r, "n", "f", "x") for r in rows], ADDRESS)
    pref = spark.createDataFrame(PREFECTURES, "prefecture_code string, pref_name string, pref_romaji string")
    got = {tuple(r) for r in same_place(df, pref).collect()}
    assert got == {("c", "d")} | {(x, y) for group in ("efgh", "ijk") for x in group for y in group if x < y}


def test_same_place_pairs_against_brute_force(spark):
    rnd, forms = random.Random(5), []
    towns = [("本宮", "motomiya"), ("本官", "motomiya"), ("もとみや", "motomiya"), ("motomija", "motomija"), ("omtomiyo", "omtomiyo"), ("白", "siro"), ("富岡野", "tomiokano"), ("富岡乃", None), ("tomoikano", "tomoikano"), ("tomiokan", "tomiokan")]
    for i in range(25):
        city = "".join(rnd.choice("aeiou") + rnd.choice("kstnhm") for _ in range(4))
        for town, read in rnd.sample(towns, 4):
            forms.append((rnd.choice(["13", "07", None]), city, city, town, read, rnd.choice(["", "", "h"]), "1-1-1"))
    forms += [(p, None, None, town, read, "", "1-1-1") for town, read in towns for p in ("13", None)]
    forms = list(enumerate(dict.fromkeys(forms)))
    df = spark.createDataFrame([(i, *f) for i, f in forms], "id bigint, prefecture string, city string, city_read string, town string, town_read string, kind string, lots string")

    def alike(x, y, u, v, loosely=False):
        if x == y or loosely and len(x) == len(y) <= 3 and naive(x, y) <= 1:
            return True
        if not u or not v:
            return False
        d = naive(u, v)
        d = 1 if d == 2 and len(u) == len(v) and sorted(u) == sorted(v) else d
        return d <= 1 and max(len(u), len(v)) >= 4 or loosely and d <= 2 and max(len(u), len(v)) >= 7

    def may_be_one(p, c, cr, t, tr, q, d, dr, u, ur):
        if p and q and p != q:
            return False
        if not c or not d:
            return alike(t, u, tr, ur)
        city, town = alike(c, d, cr, dr), alike(t, u, tr, ur)
        return city and alike(t, u, tr, ur, True) or town and (city or bool(p and q) and alike(c, d, cr, dr, True))

    wanted = set()
    for i, (p, c, cr, t, tr, kind, lots) in forms:
        for j, (q, d, dr, u, ur, other, lots2) in forms[:i]:
            if (kind, lots) == (other, lots2) and may_be_one(p, c, cr, t, tr, q, d, dr, u, ur):
                wanted.add((j, i))
    got = {(min(r), max(r)) for r in same_place_pairs(df).select("a", "b").collect()}
    assert len(wanted) > 300 and got == wanted, (len(wanted), len(got), len(got & wanted))


def test_town_and_lots_in_many_cities(spark):
    names = [a + b for a in "林岡富雪" for b in "白菊若坂宮"]
    rows = [(str(i), "13" if i == 19 else "07", n + "市", "広島町1-1-1") for i, n in enumerate(names)] + [("none", "13", None, "広島町1-1-1")]
    df = spark.createDataFrame([(*r, "n", "f", "x") for r in rows], ADDRESS)
    pref = spark.createDataFrame(PREFECTURES, "prefecture_code string, pref_name string, pref_romaji string")
    assert ("19", "none") in {tuple(r) for r in same_place(df, pref).collect()}


def test_readings(spark):
    compounds = {"富雪": "トミユキ", "富岡": "トミオカ", "白雪": "シロユキ", "白岡": "シロオカ", "富菊": "トミキク", "白菊": "シロキク"}
    rows = [(f"ビエダク{k}", f"ビエダク{v}") for k, v in compounds.items()] + [(f"{k}ドサエケ商事", f"{v}ドサエケショウジ") for k, v in compounds.items()] + [(None, "ア"), ("", None)]
    got = reading_lexicon(spark.createDataFrame(rows, "name string, furigana string"))
    assert {"富": "tomi", "雪": "yuki", "岡": "oka", "白": "shiro", "菊": "kiku"}.items() <= got.items()
    assert plain_spelling("Toukyoo Shinjuku") == plain_spelling("tokyo sinzyuku")


def test_name_parser():
    p = NameParser(LEXICON)
    lines, given, forms = p.parse("株式会社ビエダク富雪商事", "ビエダクトミユキショウジ", "Biedaku Tomiyuki Trading K.K.", None)
    assert (lines, given, forms) == (["商事"], "", ["biedakutomiyuki"])
    assert p.parse("富雪ビエダク商(株)", None, "Trdg., Tomiyuki-Biedaku", None)[:2] == (["商事"], "")
    assert p.parse("チャック=ビエダク富雪製作所", None, "C. Biedaku-Tomiyuki Mfg.", None)[:2] == (["製作所"], "チャールズ")
    assert p.parse("テッド・ビエダク富雪製作所", None, None, None)[1] == ""
    for nothing in (None, "", "  ", "株式会社", "・", "-", "x" * 20_000):
        p.parse(nothing, nothing, nothing, nothing)


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_segment_join_against_brute_force(spark):
    rnd, units = random.Random(8), ["bie", "daku", "tomi", "yuki", "siro", "kiku", "osa", "dosa", "mimu", "minu"]

    def slip(s):
        i = rnd.randrange(len(s))
        return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("aiku") + s[i:], s[:i] + rnd.choice("aiku") + s[i + 1 :], s[i:] + s[:i]])

    forms = {"".join(rnd.choice(units) for _ in range(rnd.randint(3, 5))) for _ in range(60)}
    forms |= {slip(f) for f in forms for _ in range(2)} | {slip(slip(f)) for f in forms}
    forms = sorted(f for f in forms if len(f) >= 8)
    df = spark.createDataFrame([(i, rnd.choice("xy") if i % 9 == 0 else "x", f) for i, f in enumerate(forms)], "id bigint, block string, form string")
    block = {r.id: r.block for r in df.collect()}
    got = {frozenset((r.a, r.b)) for r in segment_join(df).collect()}
    for i, s in enumerate(forms):
        for j in range(i):
            t = forms[j]
            k = 2 if min(len(s), len(t)) >= 12 else 1
            if block[i] == block[j] and naive(s, t) <= k and (naive(s, t) < 2 or one_slip(s, t) and one_slip(t, s)):
                assert frozenset((i, j)) in got, (s, t)
    for pair in got:
        a, b = pair
        assert block[a] == block[b] and any(naive(forms[a], forms[b][r:] + forms[b][:r]) <= 2 for r in range(len(forms[b])))
    assert segment_join(df.limit(0)).count() == 0


def test_segment_join_finds_turned_spellings_with_two_edits(spark):
    rnd, units = random.Random(11), ["bie", "daku", "tomi", "yuki", "siro", "ki", "osa", "do", "mimu", "nu"]
    forms = {"tomiyukibiedaku", "biedakutoyuki"}
    for _ in range(40):
        parts = [rnd.choice(units) for _ in range(rnd.randint(4, 6))]
        cut = rnd.randint(1, len(parts) - 1)
        gone = rnd.randrange(len(parts))
        slipped = [x if i != gone else x[: len(x) - 2] for i, x in enumerate(parts)]
        forms |= {"".join(parts), "".join(slipped[cut:] + slipped[:cut])}
    forms = sorted(f for f in forms if len(f) >= 8)
    df = spark.createDataFrame(list(enumerate(forms)), "id bigint, form string").selectExpr("id", "'x' AS block", "form")
    got = {frozenset((r.a, r.b)) for r in segment_join(df).collect()}
    wanted = set()
    for i, s in enumerate(forms):
        for j, t in enumerate(forms):
            # the longer one stands, or the smaller id of equals
            if (-len(s), i) < (-len(t), j) and len(s) - len(t) <= 2:
                turns = [t[r:] + t[:r] for r in range(len(t))]
                k = 2 if len(t) >= 12 else 1
                if any((d := naive(s, x)) < 2 or d <= k and one_slip(s, x) for x in turns):
                    wanted.add(frozenset((i, j)))
    assert frozenset((forms.index("tomiyukibiedaku"), forms.index("biedakutoyuki"))) in wanted
    assert len(wanted) == 25 and got == wanted, (len(wanted), len(got), len(got & wanted))


def test_near():
    assert _near("abcd", "abdc", 1) and not _near("abcd", "badc", 1) and _near([], [], 0)
    assert one_slip("kikuhosizanpi", "kikuhotuzanpi") and not one_slip("kanemasasagubo", "kanemasasabudo")


def test_same_organisation(spark):
    rows = [
        ("1", "株式会社ビエダク富雪商事", "ビエダクトミユキショウジ", "Biedaku Tomiyuki Trading K.K."), ("2", "富雪ビエダク商事(株)", "トミユキビエダクショウジ", None), ("3", None, None, "Trdg., Tomiyuki-Biedku"),
        ("4", "株式会社ビエダク富雪工業", "ビエダクトミユキコウギョウ", None), ("4", "株式会社ビエダク富雪工業", "ビエダクトミユキコウギョウ", None), ("5", None, None, None), ("6", "", " ", "x"), (None, "株式会社ビエダク富雪商事", None, None),
        ("7", "びえだくとみゆきこうぎょう有限会社", None, "Biedaku Tomiyuki Industries Ltd."), ("8", "y" * 10_000, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "corporate_number string, name string, furigana string, en_name string, k string")
    got = {tuple(r) for r in same_organisation(df).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("4", "7")}
    assert same_organisation(df.limit(0)).count() == 0
    assert kana_romaji("ビエダク") == "biedaku"


def test_short_names_link_by_equality_only(spark):
    rows = [
        ("1", "ヤマダ商事株式会社", "ヤマダショウジ", "Yamada Trading K.K."), ("2", "ヤマダ商事株式会社", "ヤマダショウジ", "Yamada Trading K.K."), ("3", "ヤマナ商事株式会社", "ヤマナショウジ", "Yamana Trading K.K."),
        ("4", "ヤマダ工業株式会社", "ヤマダコウギョウ", "Yamada Industries K.K."), ("5", "株式会社ビエダク富雪ヤマダ商事", "ビエダクトミユキヤマダショウジ", None),
    ]
    df = spark.createDataFrame(rows, "corporate_number string, name string, furigana string, en_name string")
    assert {tuple(r) for r in same_organisation(df).collect()} == {("1", "2")}


NAMES = "corporate_number string, name string, furigana string, en_name string"


def test_missing_given_name_joins_no_two_organisations(spark):
    rows = [
        ("1", "ロバート・ビエダク富雪商事", "ロバートビエダクトミユキショウジ", "Robert Biedaku-Tomiyuki Trading"), ("2", "ウィリアム・ビエダク富雪商事", "ウィリアムビエダクトミユキショウジ", "William Biedaku-Tomiyuki Trading"),
        ("3", "ビエダク富雪商事", "ビエダクトミユキショウジ", "Biedaku-Tomiyuki Trading"), ("4", "ボブ・ビエダク富雪商事", None, "Bob Biedaku-Tomiyuki Trdg."),
        ("5", "エリザベス・シロキク岡工業", "エリザベスシロキクオカコウギョウ", None), ("6", "シロキク岡工業(株)", "シロキクオカコウギョウ", None),
    ]
    got = {tuple(r) for r in same_organisation(spark.createDataFrame(rows, NAMES)).collect()}
    assert got == {("1", "4"), ("5", "6")}


def test_lines_and_given_names_are_learnt(spark):
    rnd, rows = random.Random(3), []
    lines = [("陶芸", "トウゲイ", "Pottery", "Pott."), ("造園", "ゾウエン", "Gardens", "Gdns."), ("ヨット", "ヨット", "Yachts", "Ychts.")]
    syllables = ["ビエ", "ダク", "オサ", "ヨネ", "ミム", "ロヒ", "ザン", "ピヨ", "グダ", "セザ"]
    given = [("ハインリヒ", "Heinrich"), ("ハイニ", "Heini"), ("ヨハネス", "Johannes"), ("ハネス", "Hannes")]
    for i in range(300):
        brand = "".join(rnd.choice(syllables) for _ in range(4))
        native, kana, word, short = lines[i % 3]
        roman = kana_romaji(brand).title()
        g = given[i // 3 % 4] if i % 3 == 0 else None
        for again in range(2 if g else 1):
            if again:
                g = given[given.index(g) ^ 1]
            front = (g[0] + "・" if g else "", g[0] if g else "", g[1] + " " if g else "")
            rows.append((front[0] + brand + native + "株式会社", front[1] + brand + kana, f"{front[2]}{roman[:6]} {roman[6:]} {short if i % 4 == 0 else word} K.K."))
    rows += [(None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "n string, f string, e string")
    got = learnt(df, Lexicons.none())
    assert {k: set(v) for k, v in got.lines.items()} == {n: {k, w.lower(), s.lower().strip(".")} for n, k, w, s in lines}
    canonical = lambda x: got.given[x]
    assert canonical("ハイニ") == canonical("ハインリヒ") == canonical("heini") and canonical("ハネス") == canonical("hannes") != canonical("ハイニ")
    # lists come first, and what is learnt is added
    both = learnt(df, Lexicons())
    assert both.lines["商事"] == ("ショウジ", "trading", "trdg") and "陶芸" in both.lines and both.given["bob"] == "ロバート"
    assert learnt(df.limit(0), Lexicons.none()) == Lexicons.none()


def test_very_long_names(spark):
    rows = [("1", "ビエ" * 30_000, None, None), ("2", "ビエ" * 30_000, None, None), ("3", None, None, " ".join(f"w{i}" for i in range(20_000))), ("4", "ビエダク富雪" * 2_000 + "商事", None, None)]
    assert {tuple(r) for r in same_organisation(spark.createDataFrame(rows, NAMES)).collect()} == {("1", "2")}


def test_long_names_link_by_a_slip(spark):
    rng = random.Random(5)
    kana = "".join(rng.choice("カキクケコサシスセソタチツテトナニヌネノ") for _ in range(900))
    other = "".join(rng.choice("カキクケコサシスセソタチツテトナニヌネノ") for _ in range(900))
    writings = [kana, kana[:300] + "ハ" + kana[301:], kana[500:] + kana[:500], other, other[:100] + "ハ" + other[101:700] + "ヒ" + other[701:]]
    rows = [(str(i), x, None, None) for i, x in enumerate(writings)]
    assert {tuple(r) for r in same_organisation(spark.createDataFrame(rows, NAMES)).collect()} == {("0", "1"), ("0", "2"), ("1", "2")}


def test_rolling_hashes_find_what_substrings_find(spark, monkeypatch):
    rng = random.Random(6)
    forms = set()
    for _ in range(60):
        x = "".join(rng.choice("kstnaiueo") for _ in range(rng.randint(8, 24)))
        forms.add(x)
        for _ in range(3):
            i = rng.randrange(len(x))
            y = x[:i] + rng.choice(["", "k", "sa", x[i + 1 : i + 2] + x[i]]) + x[i + 1 :]
            turn = rng.choice([0, rng.randrange(len(y))])
            forms.add(y[turn:] + y[:turn])
    df = spark.createDataFrame([(i, rng.choice("pq"), x) for i, x in enumerate(sorted(forms)) if len(x) >= 8], "id long, block string, form string").cache()
    found = {tuple(r) for r in segment_join(df).collect()}
    assert len(found) > 40
    for longest in (1, 15):
        monkeypatch.setattr("linkspark.llm.names.LONGEST", longest)
        assert {tuple(r) for r in segment_join(df).collect()} == found


def planned_joins(df, key):
    """Names of the planned joins on the key."""
    return set(re.findall(rf"(\w+Join)\b[^\n]*\b{key}#", df._jdf.queryExecution().executedPlan().toString()))


def test_exploded_windows_of_spellings_are_not_broadcast(spark):
    forms = spark.range(40).selectExpr("id", "'x' AS block", "concat('tomiyukibiedaku', substring('aiueoaiueo', CAST(id % 5 AS INT), 3)) AS form")
    assert planned_joins(segment_join(forms, 20), "h") == {"SortMergeJoin"}


def test_exploded_pieces_of_towns_are_not_broadcast(spark):
    forms = spark.range(40).selectExpr("id", "'13' AS prefecture", "'x' AS city", "'x' AS city_read", "concat('tomi', id) AS town", "concat('tomi', id) AS town_read", "'' AS kind", "'1-1' AS lots")
    assert planned_joins(_meeting_towns(forms), "h") == {"SortMergeJoin"}
