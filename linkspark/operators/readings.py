"""Readings of ideographs learnt from a table of names with their kana, as a lexicon for romanisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A reading counts if it explains at least this share of an ideograph's compounds; so many are kept at most.
LEAST_SHARE = 0.15
MOST_READINGS = 4
#: Rows of a lexicon that may be taken to the driver and into expressions.
MOST_WORDS = 100_000

# Common words of names and their readings.
COMMON_WORDS = dict(x.split() for x in """
東京 とうきょう|大阪 おおさか|京都 きょうと|横浜 よこはま|神戸 こうべ|札幌 さっぽろ|福岡 ふくおか|広島 ひろしま|仙台 せんだい|名古屋 なごや|北海道 ほっかいどう
日本 にほん|東洋 とうよう|関西 かんさい|関東 かんとう|九州 きゅうしゅう|中央 ちゅうおう|三菱 みつびし|三井 みつい|住友 すみとも|日立 ひたち|松下 まつした|富士 ふじ
株式会社 かぶしきがいしゃ|有限会社 ゆうげんがいしゃ|合同会社 ごうどうがいしゃ|銀行 ぎんこう|製作所 せいさくしょ|工業 こうぎょう|商事 しょうじ|建設 けんせつ
電機 でんき|電気 でんき|自動車 じどうしゃ|化学 かがく|食品 しょくひん|運輸 うんゆ|通信 つうしん|保険 ほけん|証券 しょうけん|出版 しゅっぱん|印刷 いんさつ|不動産 ふどうさん
""".replace("\n", "|").split("|") if x)  # fmt: skip


def _kana_case() -> tuple[str, str]:
    hira = "".join(chr(c) for c in range(0x3041, 0x3097))
    return hira, "".join(chr(ord(c) + 0x60) for c in hira)


def learn_readings(rows: DataFrame, name: str, reading: str) -> DataFrame:
    """``(ideograph, reading)`` from names that hold compounds of two ideographs between kana, beside their kana.

    The kana of the name anchor the compound's part of the reading. Every cut of that part is a hypothesis; a cut is as
    good as the number of other compounds that support both of its halves; the best cut of each compound votes. Nothing
    is gathered but the result, which the number of ideographs bounds.
    """
    katakana = F.translate(F.col(reading), *_kana_case())
    named = F.translate(F.col(name), *_kana_case())
    kana = "[ァ-ヺー]"
    pair = "[\\u4E00-\\u9FFF]{2}"
    base = rows.where(F.col(name).isNotNull() & F.col(reading).isNotNull()).select(named.alias("n"), katakana.alias("r"))
    # kana before the compound, the compound, kana or nothing known after it
    m = f"({kana}{{3,}})({pair})"
    parts = base.select(F.regexp_extract("n", m, 1).alias("anchor"), F.regexp_extract("n", m, 2).alias("pair"), "n", "r", F.lit(True).alias("before"))
    n2 = f"(?:^|[^\\u4E00-\\u9FFF])({pair})({kana}{{3,}})"
    after = base.select(F.regexp_extract("n", n2, 2).alias("anchor"), F.regexp_extract("n", n2, 1).alias("pair"), "n", "r", F.lit(False).alias("before"))
    at = F.expr("locate(anchor, r)")
    head = after.where("pair <> ''").select("pair", F.expr("substring(r, 1, locate(anchor, r) - 1)").alias("r"), at.alias("at"))
    tail = parts.where("pair <> '' AND NOT n RLIKE '[\\\\u4E00-\\\\u9FFF]{3}'").select("pair", F.expr("substring(r, locate(anchor, r) + length(anchor))").alias("r"), at.alias("at"))
    seen = head.unionByName(tail).where("at > 0 AND length(r) BETWEEN 2 AND 10").where(F.col("r").rlike(f"^{kana}+$"))
    compounds = seen.groupBy("pair", "r").agg(F.count("*").alias("n"))
    most = Window.partitionBy("pair").orderBy(F.desc("n"), "r")
    compounds = compounds.withColumn("i", F.row_number().over(most)).where("i <= 2").select("pair", "r")
    cuts = compounds.select("pair", "r", F.explode(F.sequence(F.lit(1), F.length("r") - 1)).alias("i")).select(
        "pair", "r",
        F.substring("pair", 1, 1).alias("c1"), F.expr("substring(r, 1, i)").alias("r1"),
        F.substring("pair", 2, 1).alias("c2"), F.expr("substring(r, i + 1)").alias("r2"),
    )
    halves = cuts.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("r1").alias("h"), F.col("c2").alias("other")), F.struct(F.col("c2").alias("c"), F.col("r2").alias("h"), F.col("c1").alias("other")))).alias("x")).select("x.*")
    support = halves.groupBy("c", "h").agg(F.countDistinct("other").alias("s"))
    one = support.select(F.col("c").alias("c1"), F.col("h").alias("r1"), F.col("s").alias("s1"))
    two = support.select(F.col("c").alias("c2"), F.col("h").alias("r2"), F.col("s").alias("s2"))
    scored = cuts.join(one, ["c1", "r1"]).join(two, ["c2", "r2"]).withColumn("score", F.col("s1") * F.col("s2"))
    best = scored.groupBy("pair", "r").agg(F.max_by(F.struct("c1", "r1", "c2", "r2"), F.struct("score", "r1")).alias("b"))
    votes = best.select(F.explode(F.array(F.struct(F.col("b.c1").alias("c"), F.col("b.r1").alias("h")), F.struct(F.col("b.c2").alias("c"), F.col("b.r2").alias("h")))).alias("x")).select("x.*")
    counted = votes.groupBy("c", "h").agg(F.count("*").alias("n"))
    of_c = Window.partitionBy("c")
    ranked = counted.withColumn("share", F.col("n") / F.sum("n").over(of_c)).withColumn("i", F.row_number().over(of_c.orderBy(F.desc("n"), "h")))
    return ranked.where(f"share >= {LEAST_SHARE} AND i <= {MOST_READINGS}").select(F.col("c").alias("ideograph"), F.col("h").alias("reading"), "i")


def _kana_case() -> tuple[str, str]:
    hira = "".join(chr(c) for c in range(0x3041, 0x3097))
    return hira, "".join(chr(ord(c) + 0x60) for c in hira)


def lexicon_of(words: DataFrame, word: str = "ideograph", reading: str = "reading") -> dict[str, str]:
    """A lexicon given as a table, for expressions; one of more than MOST_WORDS rows is refused. Nulls are left out."""
    rows = words.where(F.col(word).isNotNull() & F.col(reading).isNotNull()).select(F.col(word).alias("w"), F.col(reading).alias("r")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a lexicon has at most {MOST_WORDS} words")
    return {r["w"]: r["r"] for r in sorted(rows, reverse=True)}


def company_lexicon(entities: DataFrame, name: str = "name", reading: str = "furigana") -> dict[str, str]:
    """The common words, and the commonest reading of each ideograph that the table teaches."""
    return lexicon_of(learn_readings(entities, name, reading).where("i = 1")) | COMMON_WORDS
