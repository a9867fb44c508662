"""Hepburn spelling of kana, as plain Python over strings and as the tables the Column functions use."""

from __future__ import annotations

# The kana rows with their Hepburn syllables.
ROWS = {
    "あいうえお": "a i u e o",
    "かきくけこ": "ka ki ku ke ko",
    "がぎぐげご": "ga gi gu ge go",
    "さしすせそ": "sa shi su se so",
    "ざじずぜぞ": "za ji zu ze zo",
    "たちつてと": "ta chi tsu te to",
    "だぢづでど": "da ji zu de do",
    "なにぬねの": "na ni nu ne no",
    "はひふへほ": "ha hi fu he ho",
    "ばびぶべぼ": "ba bi bu be bo",
    "ぱぴぷぺぽ": "pa pi pu pe po",
    "まみむめも": "ma mi mu me mo",
    "やゆよ": "ya yu yo",
    "らりるれろ": "ra ri ru re ro",
    "わゐゑを": "wa i e o",
    "ぁぃぅぇぉ": "a i u e o",
    "ゃゅょゎ": "ya yu yo wa",
    "んゔ": "n vu",
}
# I-row kana that join a small ya, yu or yo, and their stems.
JOINING = dict(zip("きぎしじちぢにひびぴみり", "ky gy sh j ch j ny hy by py my ry".split()))


def syllables() -> dict[str, str]:
    """Hiragana and their syllables, with the joined ones of two characters."""
    table = {k: s for row, text in ROWS.items() for k, s in zip(row, text.split())}
    for kana, stem in JOINING.items():
        table |= {kana + small: stem + vowel for small, vowel in zip("ゃゅょ", "auo")}
    # a small vowel takes the place of the vowel before it
    for kana, vowel in zip("ふてでうゔ", ["f", "t", "d", "w", "v"]):
        table |= {kana + small: vowel + v for small, v in zip("ぁぃぅぇぉ", "aiueo")}
    for kana, stem in (("し", "sh"), ("じ", "j"), ("ち", "ch")):
        table[kana + "ぇ"] = stem + "e"
    return table


SYLLABLES = syllables()


def to_hiragana(text: str) -> str:
    """Katakana as hiragana; everything else stays."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def kana_romaji(text: str) -> str:
    """Hepburn of the kana in ``text``; other characters stay. A long mark repeats the vowel before it."""
    text, out, i = to_hiragana(text), [], 0
    double = False
    while i < len(text):
        c = text[i]
        if c == "っ":
            double, i = True, i + 1
            continue
        s = SYLLABLES.get(text[i : i + 2]) if i + 1 < len(text) else None
        step = 2 if s else 1
        s = s or SYLLABLES.get(c)
        if s is None:
            if c == "ー":
                s = out[-1][-1] if out and out[-1][-1:] in set("aiueo") else ""
            else:
                s = c
        elif double and s[0] not in "aiueon":
            s = s[0] + s
        double = False
        out.append(s)
        i += step
    return "".join(out)
