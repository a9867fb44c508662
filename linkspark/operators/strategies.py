"""Similarity strategies by name, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions import phonetic, similarity


def _no_details(query: Column, candidate: Column, score: Column) -> Column:
    return F.create_map().cast("map<string,string>")


def _as_it_is(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class Strategy:
    """A similarity of a query's and a candidate's text, both Columns, and the weight it has in an ensemble.

    ``prepare`` is applied to every text once, before queries meet candidates; score and details get what it gives.
    """

    name: str
    score: Callable[[Column, Column], Column]
    weight: float = 1.0
    prepare: Callable[[Column], Column] = _as_it_is
    #: Strategies with the same preparation share its columns under this name; by default it is the strategy's own.
    prepared_as: str = ""
    #: From both prepared texts and the score, a map of strings.
    details: Callable[[Column, Column, Column], Column] = _no_details
    #: Whether it compares phonetic forms rather than texts.
    phonetic: bool = False


class StrategyRegistry:
    """Strategies in the order of their registration."""

    def __init__(self) -> None:
        self._by_name: dict[str, Strategy] = {}

    def register(self, strategy: Strategy) -> None:
        if strategy.name in self._by_name:
            raise ValueError(f"strategy {strategy.name!r} is registered already")
        self._by_name[strategy.name] = strategy

    def unregister(self, name: str) -> None:
        if name not in self._by_name:
            raise KeyError(f"no strategy {name!r}")
        del self._by_name[name]

    def get(self, name: str) -> Strategy:
        if name not in self._by_name:
            raise KeyError(f"no strategy {name!r}")
        return self._by_name[name]

    def all(self) -> list[Strategy]:
        return list(self._by_name.values())

    @classmethod
    def default(cls, engine: str = "kernel", phonetic_mode: str = "compat") -> StrategyRegistry:
        """The four strategies.

        engine: ``kernel`` (vectorised) or ``column`` (no Python worker). phonetic_mode: ``compat`` encodes the phonetic
        forms, which are keys already, once more, as the service does; ``keys`` compares the keys themselves.
        """
        text = lambda c: c.cast("string")
        jw, indel = similarity.jaro_winkler_prepared(engine), similarity.indel_prepared(engine)
        out = cls()
        out.register(Strategy("jaro_winkler", jw, 0.30, F.lower, "lower", lambda a, b, s: F.create_map(F.lit("raw_similarity"), text(s))))
        out.register(
            Strategy(
                "levenshtein", similarity.levenshtein_prepared, 0.25, F.lower, "lower",
                lambda a, b, s: F.create_map(F.lit("edit_distance"), text(F.levenshtein(a, b)), F.lit("normalized_similarity"), text(s)),
            )
        )
        out.register(Strategy("token_sort", indel, 0.25, similarity.sorted_tokens, "tokens", lambda a, b, s: F.create_map(F.lit("raw_ratio"), text(s * 100))))
        key = _as_it_is if phonetic_mode == "keys" else phonetic.phonetic_key
        keys = lambda a, b, s: F.create_map(F.lit("query_phonetic_key"), a, F.lit("candidate_phonetic_key"), b)
        out.register(Strategy("phonetic", phonetic.compare_keys, 0.20, key, "key", keys, True))
        return out
