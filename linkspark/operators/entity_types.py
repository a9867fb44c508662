"""Declarative descriptions of the kinds of entities that can be resolved."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.functions.text import ENGLISH_FORMS, JAPANESE_FORMS

# Forms of a query and of a candidate that are compared, in the order in which ties are decided.
TEXT_PAIRS = [
    ("normalized", "name_normalized"), ("normalized", "en_name_normalized"), ("romaji", "name_romaji"),
    ("romaji", "en_name_normalized"), ("original", "name_normalized"),
]
PHONETIC_PAIRS = [("phonetic", "phonetic_key")]

KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType()}


@dataclass(frozen=True)
class FieldDef:
    """A column of an entity table."""

    name: str
    type: str = "string"
    nullable: bool = True
    indexed: bool = False
    unique: bool = False

    def as_struct_field(self) -> T.StructField:
        return T.StructField(self.name, KINDS[self.type], self.nullable, {"indexed": self.indexed, "unique": self.unique})


def company_candidate_forms() -> dict[str, Column]:
    """Forms of a stored company: the first is always there, the others only when they aren't empty."""
    optional = ("en_name_normalized", "name_romaji", "phonetic_key")
    return {"name_normalized": F.coalesce("name_normalized", F.lit("")), **{c: F.nullif(F.col(c), F.lit("")) for c in optional}}


def company_forms_as_candidate(forms: dict[str, Column]) -> dict[str, Column]:
    """Forms of a query in the places of a candidate's, for comparing two names."""
    return {"name_normalized": forms["normalized"], "en_name_normalized": forms["normalized"], "name_romaji": forms["romaji"], "phonetic_key": forms["phonetic"]}


@dataclass(frozen=True)
class EntityTypeConfig:
    """Everything that the resolver has to know of a kind of entity."""

    name: str
    fields: tuple[FieldDef, ...]
    table: str
    display_field: str = "name"
    ngram_fields: tuple[str, ...] = ("name_normalized",)
    text_pairs: tuple[tuple[str, str], ...] = tuple(TEXT_PAIRS)
    phonetic_pairs: tuple[tuple[str, str], ...] = tuple(PHONETIC_PAIRS)
    japanese_forms: tuple[str, ...] = tuple(JAPANESE_FORMS)
    english_forms: tuple[str, ...] = tuple(ENGLISH_FORMS)
    candidate_forms: Callable[[], dict[str, Column]] = company_candidate_forms
    as_candidate: Callable[[dict[str, Column]], dict[str, Column]] = field(default=company_forms_as_candidate)

    def schema(self) -> T.StructType:
        """id, the declared fields and the time of creation."""
        return T.StructType([T.StructField("id", T.LongType(), False), *[f.as_struct_field() for f in self.fields], T.StructField("created_at", T.TimestampNTZType())])

    def ngram_schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType(), False), T.StructField(f"{self.name}_id", T.LongType(), False), T.StructField("ngram", T.StringType(), False), T.StructField("source_field", T.StringType(), False)])

    def ddl(self, buckets: int | None = None) -> list[str]:
        """CREATE TABLE statements of the entity table and its n-gram index, the index bucketed by n-gram on demand."""
        out = []
        for table, schema in ((self.table, self.schema()), (f"{self.name}_ngrams", self.ngram_schema())):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
            bucketed = f" CLUSTERED BY (ngram) INTO {buckets} BUCKETS" if buckets and table.endswith("_ngrams") else ""
            out.append(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{bucketed}")
        return out

    def project(self, df: DataFrame) -> DataFrame:
        """id and the declared fields, in their order."""
        return df.select("id", *[f.name for f in self.fields])


COMPANY = EntityTypeConfig(
    name="company",
    table="companies",
    fields=(
        FieldDef("corporate_number", nullable=False, indexed=True, unique=True),
        FieldDef("name", nullable=False),
        FieldDef("name_normalized", nullable=False),
        *[FieldDef(n) for n in ("furigana", "en_name", "en_name_normalized", "name_romaji")],
        FieldDef("phonetic_key", indexed=True),
        *[FieldDef(n) for n in ("prefecture_code", "city", "address")],
    ),
    ngram_fields=("name_normalized", "en_name_normalized", "name_romaji"),
)


class EntityTypeRegistry:
    """Kinds of entities by name; registering a name again replaces it."""

    def __init__(self, types: Sequence[EntityTypeConfig] = ()) -> None:
        self._by_name = {t.name: t for t in types}

    def register(self, config: EntityTypeConfig) -> None:
        self._by_name[config.name] = config

    def get(self, name: str) -> EntityTypeConfig:
        if name not in self._by_name:
            raise KeyError(f"unknown entity type {name!r}; there are {sorted(self._by_name)}")
        return self._by_name[name]

    def all(self) -> list[EntityTypeConfig]:
        return list(self._by_name.values())

    def names(self) -> list[str]:
        return list(self._by_name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    @classmethod
    def default(cls) -> EntityTypeRegistry:
        return cls([COMPANY])
