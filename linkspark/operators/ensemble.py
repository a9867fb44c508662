"""A weighted average of strategies, each by its best pair of forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.entity_types import PHONETIC_PAIRS, TEXT_PAIRS
from linkspark.operators.strategies import StrategyRegistry

RESULT = "struct<strategy_name:string,score:double,query_form:string,candidate_form:string,details:map<string,string>>"


class Ensemble:
    """Scores pairs of form maps.

    A form that is null is absent. A strategy takes the best of its pairs whose forms are both there, the first of
    equals; without any it counts 0 with its full weight.
    """

    def __init__(
        self,
        registry: StrategyRegistry | None = None,
        weights: dict[str, float] | None = None,
        text_pairs: Sequence[tuple[str, str]] = TEXT_PAIRS,
        phonetic_pairs: Sequence[tuple[str, str]] = PHONETIC_PAIRS,
    ) -> None:
        self.registry = registry or StrategyRegistry.default()
        self.weights = weights or {}
        self.text_pairs, self.phonetic_pairs = list(text_pairs), list(phonetic_pairs)

    def weight(self, name: str) -> float:
        return self.weights.get(name, self.registry.get(name).weight)

    def pairs(self, name: str) -> list[tuple[str, str]]:
        return self.phonetic_pairs if self.registry.get(name).phonetic else self.text_pairs

    def prepare(self, df: DataFrame, forms: dict[str, Column], side: str) -> DataFrame:
        """``df`` with ``<side>_<preparation>_<form>`` for every form that a strategy compares on that side (``q`` or ``c``)."""
        made = {}
        for s in self.registry.all():
            for form in dict.fromkeys(p[side == "c"] for p in self.pairs(s.name)):
                if form in forms:
                    made[f"{side}_{s.prepared_as or s.name}_{form}"] = F.when(forms[form].isNotNull(), s.prepare(forms[form]))
        return df.withColumns(made)

    def _sides(self, name: str, columns: Sequence[str]) -> list[tuple[int, str, str, str, str]]:
        kind = self.registry.get(name).prepared_as or name
        found = [(i, q, c, f"q_{kind}_{q}", f"c_{kind}_{c}") for i, (q, c) in enumerate(self.pairs(name))]
        return [x for x in found if x[3] in columns and x[4] in columns]

    def score(self, df: DataFrame) -> DataFrame:
        """``df``, prepared on both sides, with ``score_<strategy>_<pair>`` for every pair and ``final_score``."""
        scores, total, weights = {}, F.lit(0.0), 0.0
        for s in self.registry.all():
            mine = []
            sides = self._sides(s.name, df.columns)
            for i, _, _, q, c in sides:
                # an earlier pair of the same texts has the same score and wins the tie
                earlier = [F.col(q) == F.col(x[3]) for x in sides if x[0] < i and x[4] == c]
                text = F.when(~F.coalesce(F.greatest(*earlier) if len(earlier) > 1 else earlier[0], F.lit(False)), F.col(q)) if earlier else F.col(q)
                scores[f"score_{s.name}_{i}"] = F.when(text.isNotNull() & F.col(c).isNotNull(), s.score(text, F.col(c)))
                mine.append(F.col(f"score_{s.name}_{i}"))
            best = F.greatest(*mine) if len(mine) > 1 else mine[0] if mine else F.lit(None).cast("double")
            total = total + F.coalesce(best, F.lit(0.0)) * self.weight(s.name)
            weights += self.weight(s.name)
        return df.withColumns(scores).withColumn("final_score", total / weights if weights > 0 else F.lit(0.0))

    def explain(self, df: DataFrame) -> DataFrame:
        """``df`` of score() with ``result``: ``struct<final_score, strategy_results, best_strategy, query_forms_used, candidate_forms_used>``."""
        results = []
        for s in self.registry.all():
            tried = [
                F.when(
                    F.col(f"score_{s.name}_{i}").isNotNull(),
                    F.struct(F.col(f"score_{s.name}_{i}").alias("score"), F.lit(-i).alias("place"), F.lit(qf).alias("query_form"), F.lit(cf).alias("candidate_form"), F.col(q).alias("q"), F.col(c).alias("c")),
                )
                for i, qf, cf, q, c in self._sides(s.name, df.columns)
            ]
            none = F.lit(None).cast("struct<score:double,place:int,query_form:string,candidate_form:string,q:string,c:string>")
            df = df.withColumn(f"best_{s.name}", F.array_max(F.array(*tried)) if tried else none)
            b = F.col(f"best_{s.name}")
            details = F.when(b.isNull(), F.create_map(F.lit("note"), F.lit("no compatible form pairs found"))).otherwise(s.details(b.q, b.c, b.score))
            results.append(
                F.struct(
                    F.lit(s.name).alias("strategy_name"), F.coalesce(b.score, F.lit(0.0)).alias("score"), F.coalesce(b.query_form, F.lit("")).alias("query_form"),
                    F.coalesce(b.candidate_form, F.lit("")).alias("candidate_form"), details.alias("details"),
                )
            )
        df = df.withColumn("strategy_results", F.array(*results) if results else F.array().cast(f"array<{RESULT}>"))
        every = F.col("strategy_results")
        first = F.array_max(F.transform(every, lambda r, i: F.struct(r.score.alias("score"), (-i).alias("place"), r.strategy_name.alias("name"))))

        def used(which: str) -> Column:
            return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda r: r.getField(which)), lambda x: x != "")))

        best = F.coalesce(first.getField("name"), F.lit(""))
        result = F.struct("final_score", "strategy_results", best.alias("best_strategy"), used("query_form").alias("query_forms_used"), used("candidate_form").alias("candidate_forms_used"))
        return df.withColumn("result", result)
