"""Which records denote the same place, however its address is written (problem 2).

Every address is taken apart into prefecture, city, town, kind of town and lot numbers; building, floor and room are
dropped. Equal writings are one form from then on. Forms are then compared in multi-pass sorted neighbourhoods: each
pass sorts by another order of the components (the first ones of which must agree and are the block), and every form is
compared with the next ``WINDOW`` ones. What windows and blocks leave out is met by a join of towns: equal ones, short
ones but for one character, and readings that share one of three segments, of which two edits leave one whole; every
pair that the rule accepts is found. A pair is one place if all lot numbers and the kind of town are strictly equal
and town and city agree up to a transposition-tolerant edit distance, in their characters or in their readings. Places
are the connected components of pairs that lack the same parts; a record without prefecture or city then joins the only
place that it fits, and none where several would do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.fold import with_consistent
from linkspark.llm.readings import column_or_null, plain_spelling, reading_lexicon, spell
from linkspark.llm.spread import spread
from linkspark.operators.components import attach_incomplete, connected_components, pairs_within
from linkspark.sources.tables import cut

#: Forms that follow in a sorted block and are compared with a form.
WINDOW = 12

_NUM = "(?:[0-9]+|[一二三四五六七八九十百〇]+)"
_LOTS = [
    (re.compile(f"({_NUM})丁目 ?({_NUM})(?:番地の|番地|番|-|の)({_NUM})"), 3),
    (re.compile(f"({_NUM})[-の]({_NUM})[-の]({_NUM})"), 3),
    (re.compile(f"({_NUM})丁目 ?({_NUM})"), 2),
    (re.compile(f"({_NUM})番地?の?({_NUM})"), 2),
    (re.compile(f"({_NUM})[-の]({_NUM})"), 2),
]
_BUILDING = re.compile(
    r"(?:[A-Za-zÀ-ɏͰ-ϿЀ-ӿァ-ヺー']+|(?:^|(?<=[ 0-9号市区町村]))[一-鿿]{2}|)(?:ビル|タワー|プラザ|マンション|センター|会館)"
    rf"(?: ?{_NUM}(?:階|F))?(?:{_NUM}号室)?"
)
_FLOOR = re.compile(rf" {_NUM}(?:階|F)(?:{_NUM}号室)?")
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_SUFFIX = re.compile("[市区町村]$")
_LATIN_SUFFIX = re.compile(r"-(shi|ku|cho|machi|mura|son)$")


def number(text: str) -> int:
    """A number in digits, in positional ideographs or in ideographs with tens and hundreds."""
    if text[0].isdigit():
        return int(text)
    if not set(text) & set("十百"):
        return int("".join(str(_DIGITS[c]) for c in text))
    total, last = 0, 0
    for c in text:
        if c in "十百":
            total, last = total + (last or 1) * (10 if c == "十" else 100), 0
        else:
            last = _DIGITS[c]
    return total + last


def _town(text: str) -> tuple[str, str]:
    """The town's stem and its kind, ``h`` for a main town; the plain kind may be left out in writing."""
    text = re.sub("^(大字|字)", "", text.replace(" ", ""))
    for ending, kind in (("本町", "h"), ("ほんちょう", "h"), ("ほんまち", "h"), ("町", ""), ("ちょう", ""), ("まち", "")):
        if text.endswith(ending) and len(text) > len(ending):
            return text[: -len(ending)], kind
    return text, ""


class AddressParser:
    """Components of one address at a time. prefectures: rows of (code, name, romaji), a fixed table of the country."""

    def __init__(self, prefectures: list[tuple[str, str, str]], lexicon: dict[str, str]):
        self.lexicon = lexicon
        self.by_name = {name: code for code, name, _ in prefectures if name}
        self.by_spelling = {plain_spelling(romaji): code for code, _, romaji in prefectures if romaji}

    def parse(self, prefecture: str | None, city: str | None, address: str | None) -> dict | None:
        """Components, or None if the address denotes no location."""
        if not address or not address.strip():
            return None
        text = re.sub(r"\s+", " ", address).strip()
        code = (prefecture or "").strip().zfill(2) if (prefecture or "").strip() else None
        city = (city or "").strip() or None
        if city:
            for name, c in self.by_name.items():
                if city.startswith(name) and len(city) > len(name):
                    code, city = code or c, city[len(name) :].strip()
                    break
        latin = re.search(r"[A-Za-z]{3}", re.sub(_BUILDING, " ", text)) and not re.search("[一-鿿ぁ-ゖ]", re.sub(_BUILDING, " ", text))
        found = self._latin(text) if latin else self._native(text, city)
        if found is None:
            return None
        town, kind, lots, own_city, own_code = found
        city = city or own_city
        stem = _SUFFIX.sub("", city) if city and len(city) > 2 else city
        if stem and re.fullmatch("[A-Za-z' -]+", stem):
            stem = _LATIN_SUFFIX.sub("", stem.strip().lower())
        return {
            "prefecture": code or own_code,
            "city": stem or None,
            "city_read": self._read(stem),
            "town": town,
            "town_read": self._read(town),
            "kind": kind,
            "lots": "-".join(map(str, lots)),
        }

    def _read(self, text: str | None) -> str | None:
        return spell(text, self.lexicon) or None if text else None

    def _latin(self, text: str):
        text = _BUILDING.sub(" ", text)
        m = re.search(r"(\d+)-(\d+)(?:-(\d+))?", text)
        if not m:
            return None
        lots = [int(x) for x in m.groups() if x]
        rest = [x.strip(" .") for x in re.split(",", text[: m.start()] + "," + text[m.end() :])]
        rest = [x for x in rest if re.search("[A-Za-z]", x)]
        if not rest:
            return None
        town, city, code = rest[0].lower(), None, None
        for x in rest[1:]:
            x = x.lower()
            if _LATIN_SUFFIX.search(x):
                city = x
            elif plain_spelling(x) in self.by_spelling:
                code = self.by_spelling[plain_spelling(x)]
            else:
                city = city or x
        kind = "h" if re.search(r"-?hon-?(cho|machi)$", town) else ""
        town = re.sub(r"-?hon-?(cho|machi)$|-(cho|machi)$", "", town)
        return (town, kind, lots, city, code) if town else None

    def _native(self, text: str, city: str | None):
        text = _FLOOR.sub(" ", _BUILDING.sub(" ", text)).strip()
        best = None
        for pattern, n in _LOTS:
            m = pattern.search(text)
            if m and m.start() > 0 and (best is None or m.start() < best[0].start() or (m.start() == best[0].start() and n > best[1])):
                best = (m, n)
        if best is None:
            return None
        m = best[0]
        lots = [number(x) for x in m.groups()]
        head = text[: m.start()].strip()
        if "丁目" in m.group() and "百" in m.group(1):  # no town has a hundred blocks: the sign ends the town's name
            at = m.group(1).rindex("百") + 1
            if at == len(m.group(1)):
                return None
            head, lots[0] = head + m.group(1)[:at], number(m.group(1)[at:])
        head = head.replace("大字", "")
        code = None
        for name, c in self.by_name.items():
            if head.startswith(name) or head.startswith(name[:-1] + " "):
                code, head = c, head[len(name) :].strip()
                break
        # leftovers of a building stand apart from the town
        head = re.sub("[A-Za-zÀ-ɏͰ-ϿЀ-ӿァ-ヺー]+", " ", head).strip()
        own = None
        if city and head.startswith(city):
            head = head[len(city) :]
        elif city and head.replace(" ", "").startswith(_SUFFIX.sub("", city)) and len(head.replace(" ", "")) > len(city) + 1:
            head = re.sub("^[市区町村]", "", head.replace(" ", "")[len(_SUFFIX.sub("", city)) :])
        else:
            parts = head.split()
            if len(parts) > 1:
                own, head = parts[0], "".join(parts[1:])
            else:
                cutting = re.match("^(.{2,}?[市区町村])(.{2,})$", head)
                if cutting and not re.fullmatch("本?町", cutting.group(2)):
                    own, head = cutting.groups()
                elif re.fullmatch("[一-鿿]{4}(本?町)?", head) and not re.fullmatch("[一-鿿]{2}本町", head):
                    own, head = head[:2], head[2:]
                elif re.fullmatch("[一-鿿]{2}[ぁ-ゖ]{3,}(本?町)?", head):
                    own, head = head[:2], head[2:]
            if own and city:
                own = None
        town, kind = _town(head)
        return (town, kind, lots, own, code) if town else None


_FIELDS = ["prefecture", "city", "city_read", "town", "town_read", "kind", "lots"]


def parse_addresses(df: DataFrame, prefectures: DataFrame, key: str = "corporate_number") -> DataFrame:
    """``(k, prefecture, city, city_read, town, town_read, kind, lots)`` of the rows that denote a location."""
    spark = df.sparkSession
    columns = {"k": F.col(key), "p": column_or_null(df, "prefecture_code"), "c": column_or_null(df, "city"), "a": column_or_null(df, "address"), "n": column_or_null(df, "name"), "f": column_or_null(df, "furigana")}
    rows = with_consistent(spread(df.select(*[c.alias(n) for n, c in columns.items()])), ["c", "a", "n", "f"])
    rows = cut(rows.where("k IS NOT NULL"))
    lexicon = reading_lexicon(rows, "n", "f")
    country = [tuple(r) for r in prefectures.select("prefecture_code", "pref_name", "pref_romaji").collect()]  # a fixed table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = AddressParser(country, lexicon)
        for b in batches:
            out = []
            for k, p, c, a in zip(b["k"], b["p"], b["c"], b["a"]):
                if found := parser.parse(p, c, a):
                    out.append([k, *[found[x] for x in _FIELDS]])
            yield pd.DataFrame(out, columns=["k", *_FIELDS])

    kind = df.schema[key].dataType.simpleString()
    return rows.select("k", "p", "c", "a").mapInPandas(run, f"k {kind}, " + ", ".join(f"{f} string" for f in _FIELDS))


def osa_distance(a: Column, b: Column, limit: int) -> Column:
    """Banded edit distance, -1 beyond the limit; one swap of neighbours counts one where nothing else differs."""
    plain = F.levenshtein(a, b, limit)
    # the swap: equal multisets of characters within an edit distance of two and equal lengths
    swapped = (F.levenshtein(a, b, 2) == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(plain >= 0, F.when(swapped, F.lit(1)).otherwise(plain)).when(swapped, F.lit(1)).otherwise(F.lit(-1))


def _alike(part: str, closely: bool) -> Column:
    """Whether two parts agree in their characters or in their readings: closely, or else with up to two slips or another ideograph."""
    x, y = F.col(f"l.{part}"), F.col(f"r.{part}")
    u, v = F.col(f"l.{part}_read"), F.col(f"r.{part}_read")
    longer = F.greatest(F.length(u), F.length(v))
    close = F.coalesce(x == y, F.lit(False)) | F.coalesce((osa_distance(u, v, 1) >= 0) & (longer >= 4), F.lit(False))
    if closely:
        return close
    written = (F.length(x) == F.length(y)) & (F.length(x) <= 3) & (F.levenshtein(x, y, 1) >= 0)
    return close | F.coalesce(written, F.lit(False)) | F.coalesce((longer >= 7) & (osa_distance(u, v, 2) >= 0), F.lit(False))


def _one_place() -> Column:
    """Whether forms l and r of equal lots and kind may be one place.

    A missing prefecture or city fits any here; what follows from it is decided by ``place_of_forms``. Two slips or
    another ideograph are taken in one part only: in the town where both have a city, in the city where both have a
    prefecture.
    """
    prefecture = F.col("l.prefecture") == F.col("r.prefecture")
    city_open = F.col("l.city").isNull() | F.col("r.city").isNull()
    city, town = _alike("city", True), _alike("town", True)
    loose = ~city_open & city & _alike("town", False) | F.coalesce(prefecture, F.lit(False)) & ~city_open & _alike("city", False) & town
    return F.coalesce(prefecture, F.lit(True)) & (town & (city_open | city) | loose)


def _rank() -> Column:
    """How much a form lacks: 0 nothing, 1 the prefecture, 2 the city, 3 both."""
    return F.col("prefecture").isNull().cast("int") + 2 * F.col("city").isNull().cast("int")


#: Keys on which towns of both sides meet that are equal, or up to three characters long and differ in one.
_WRITTEN = """concat(array(concat('=', town)), CASE WHEN length(town) <= 3 THEN transform(sequence(1, length(town)),
    i -> concat('~', substring(town, 1, i - 1), '*', substring(town, i + 1))) ELSE array() END)"""
#: The three segments of a reading of four letters and more.
_SEGMENTS = """CASE WHEN length(town_read) >= 4 THEN transform(sequence(0, 2), i -> concat_ws('|', length(town_read), i, substring(town_read,
    CAST(floor(i * length(town_read) / 3) AS INT) + 1, CAST(floor((i + 1) * length(town_read) / 3) - floor(i * length(town_read) / 3) AS INT)))) ELSE array() END"""
#: A reading's own parts where a segment of an equal or up to two letters longer one can lie, two edits away at most.
_PARTS = """CASE WHEN length(town_read) >= 2 THEN flatten(transform(sequence(greatest(4, length(town_read)), length(town_read) + 2), n ->
    flatten(transform(sequence(0, 2), i -> transform(filter(sequence(-2, 2), x -> CAST(floor(i * n / 3) AS INT) + x >= 0), x -> concat_ws('|', n, i, substring(town_read,
    CAST(floor(i * n / 3) AS INT) + x + 1, CAST(floor((i + 1) * n / 3) - floor(i * n / 3) AS INT)))))))) ELSE array() END"""


def _meeting_towns(forms: DataFrame) -> DataFrame:
    """``(a, b)`` of all forms that are one place, complete by the pigeonhole principle: a reading's slip is two edits at most.

    Only ids meet, each as the hash of lots, kind and a piece of the town; the forms are fetched for distinct pairs.
    """

    def side(keys: str, name: str) -> DataFrame:
        every = F.array_distinct(F.concat(F.expr(_WRITTEN), F.expr(keys)))
        return forms.select(F.col("id").alias(name), "lots", "kind", F.explode(every).alias("key")).select(F.xxhash64("lots", "kind", "key").alias("h"), name)

    # merged, never broadcast: estimates count an exploded row as one, so that either side may be many times what it is taken for
    met = side(_SEGMENTS, "x").join(side(_PARTS, "y").hint("merge"), "h").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    fields = F.struct("id", *_FIELDS)
    whole = met.join(forms.select(F.col("id").alias("a"), fields.alias("l")), "a").join(forms.select(F.col("id").alias("b"), fields.alias("r")), "b")
    return whole.where((F.col("l.lots") == F.col("r.lots")) & (F.col("l.kind") == F.col("r.kind")) & _one_place()).select("a", "b")


def same_place_pairs(forms: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(a, b)`` of form ids that are one place, a < b: sorted neighbourhoods in five component orders, and what they leave out."""
    read = F.coalesce("town_read", "town")
    city = F.coalesce("city_read", "city", F.lit(""))
    passes = [
        (["lots", "kind", F.substring(read, 1, 3)], [read, city]),
        (["lots", "kind", F.reverse(F.substring(F.reverse(read), 1, 3))], [F.reverse(read), city]),
        (["lots", "kind", F.substring(city, 1, 3)], [read, city]),
        (["lots", "kind", F.substring("town", 1, 1)], ["town", city]),
        (["lots", "kind", F.reverse(F.substring(F.reverse("town"), 1, 1))], [F.reverse("town"), city]),
    ]
    fields = F.struct("id", *_FIELDS)
    found = _meeting_towns(forms)
    for block, order in passes:
        w = Window.partitionBy(*block).orderBy(*order, "id").rowsBetween(1, window)
        near = forms.select(fields.alias("l"), F.collect_list(fields).over(w).alias("rs")).select("l", F.explode("rs").alias("r"))
        found = found.unionByName(near.where(_one_place()).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")))
    return found.distinct()


def place_of_forms(forms: DataFrame) -> DataFrame:
    """``(id, place)`` of every form ``(id, <fields>)``.

    Forms that lack the same parts are one place if they may be. A form that lacks more than another one joins it only
    if no other place would do as well: what fits places in two prefectures doesn't make them one.
    """
    pairs = cut(same_place_pairs(forms))
    rank = forms.select("id", _rank().alias("rank"))
    ranked = cut(
        pairs.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    )
    groups = cut(connected_components(ranked.where("ra = rb").select("a", "b")))
    component = cut(rank.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "rank", F.coalesce("component", "id").alias("component")))
    more = ranked.where("ra <> rb").select(F.expr("IF(ra > rb, a, b)").alias("more"), F.expr("IF(ra > rb, b, a)").alias("less"))
    links = more.join(component.select(F.col("id").alias("more"), "component"), "more").join(component.select(F.col("id").alias("less"), F.col("component").alias("other")), "less")
    labels = attach_incomplete(component.select("component", "rank"), cut(links.select("component", "other").distinct()), 4)
    return component.join(labels, "component").select("id", F.col("label").alias("place"))


def places(df: DataFrame, prefectures: DataFrame, key: str = "corporate_number") -> DataFrame:
    """``(<key>, place)``: the records that denote a location; records of one place have equal ``place``.

    Defined cases: a record whose address is null, blank or without a complete lot number denotes no location and has
    no row; a record without prefecture or city joins the one place of complete records that it fits, and stays apart
    where several fit; rows with a null key are left out; a key whose rows have different addresses has a row for each
    place; an empty table yields no rows.
    """
    parsed = cut(parse_addresses(df, prefectures, key))
    form = F.xxhash64(*[F.coalesce(F.col(f), F.lit("\x01")) for f in _FIELDS])
    placed = parsed.withColumn("id", form)
    forms = cut(placed.select("id", *_FIELDS).dropDuplicates(["id"]))
    return placed.select(F.col("k").alias(key), "id").distinct().join(place_of_forms(forms), "id").select(key, "place").distinct()


def same_place(df: DataFrame, prefectures: DataFrame, key: str = "corporate_number", a: str = "number_a", b: str = "number_b") -> DataFrame:
    """``(number_a, number_b)``: every pair of distinct keys at one place, equal writings included, a < b."""
    return pairs_within(cut(places(df, prefectures, key)), "place", key, a, b)
