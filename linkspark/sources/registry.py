"""Raw registry lines to an entity table and its n-gram index; readers and writers around them."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions.phonetic import phonetic_key
from linkspark.functions.romaji import to_romaji
from linkspark.functions.text import strip, with_normalized
from linkspark.operators.blocking import ngram_index
from linkspark.operators.entity_types import COMPANY, EntityTypeConfig
from linkspark.sources.tables import cut

# The positions (from 0) of the columns of a registry line, and the number of its columns.
POSITIONS = {"corporate_number": 1, "latest": 3, "name": 6, "furigana": 7, "prefecture_code": 8, "city": 9, "address": 10, "en_name": 24}
WIDTH = 30
ENCODING = "cp932"


def read_registry_csv(spark: SparkSession, path: str, encoding: str = ENCODING) -> DataFrame:
    """Lines of positional CSV files without a header, as ``(row_no, <POSITIONS>)``; columns that a line lacks are null.

    row_no follows the order of files and of lines in them. UTF-8 files are split among tasks; Spark reads no other
    encoding of this kind, so that a file in one is decoded by one task, as a stream of lines.
    """
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        schema = ", ".join(f"_c{i} string" for i in range(WIDTH))
        lines = spark.read.csv(path, schema=schema, header=False, enforceSchema=True)
        return lines.select(F.monotonically_increasing_id().alias("row_no"), *[F.col(f"_c{i}").alias(n) for n, i in POSITIONS.items()])
    return _decoded(spark, path, encoding, zipped=False)


def read_registry_zip(spark: SparkSession, path: str, encoding: str = ENCODING) -> DataFrame:
    """Lines of zipped CSV files: the first .csv member of each, undecodable bytes replaced; as read_registry_csv gives them."""
    return _decoded(spark, path, encoding, zipped=True)


def _decoded(spark: SparkSession, path: str, encoding: str, zipped: bool) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = list(POSITIONS)

    def lines_of(raw: io.BufferedIOBase) -> Iterator[list]:
        text = io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline="")
        for i, line in enumerate(csv.reader(text)):
            yield [i, *[line[p] if p < len(line) else None for p in POSITIONS.values()]]

    def members(content: bytes) -> Iterator[list]:
        if not zipped:
            yield from lines_of(io.BytesIO(content))
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
            if member is not None:
                with z.open(member) as raw:
                    yield from lines_of(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                lines = members(content)
                while some := list(itertools.islice(lines, 10_000)):
                    out = pd.DataFrame(some, columns=["line", *names])
                    out.insert(0, "file", file)
                    yield out

    lines = files.mapInPandas(run, "file string, line bigint, " + ", ".join(f"{n} string" for n in names))
    return lines.select(F.struct("file", "line").alias("row_no"), *names)


def registry_rows(df: DataFrame) -> DataFrame:
    """Lines of a table with columns ``row_no, c1 .. c24`` under the names of POSITIONS."""
    given = {"corporate_number": "c1", "latest": "c3", "name": "c6", "furigana": "c7", "prefecture_code": "c8", "city": "c9", "address": "c10", "en_name": "c24"}
    return df.select("row_no", *[F.col(c).alias(n) for n, c in given.items()])


def latest_lines(lines: DataFrame) -> DataFrame:
    """Valid lines, the first one of each number: ``(row_no, corporate_number, name, furigana, prefecture_code, city, address, en_name)``.

    A line counts if it is long enough (a prefecture code, perhaps empty), is the latest (``0``) and has a number and a
    name. Every text loses its outer white space; optional ones that are empty then are null.
    """
    texts = [n for n in POSITIONS if n != "latest"]
    stripped = lines.where("prefecture_code IS NOT NULL").select("row_no", strip(F.col("latest")).alias("latest"), *[strip(F.col(n)).alias(n) for n in texts])
    valid = stripped.where((F.col("latest") == "0") & (F.col("corporate_number") != "") & (F.col("name") != ""))
    order = Window.partitionBy("corporate_number").orderBy("row_no")
    first = valid.withColumn("__i", F.row_number().over(order)).where("__i = 1")
    kept = [F.col(n) if n in ("corporate_number", "name") else F.nullif(F.col(n), F.lit("")).alias(n) for n in texts]
    return first.select("row_no", *kept)


def numbered(df: DataFrame, order: str, start: int = 0, name: str = "id") -> DataFrame:
    """``df`` with ``name``: start + 1, start + 2, ... in the order of a column, which is unique.

    Rows are sorted by ranges and written once; only the number of rows of each range goes to the driver, so that no
    task ever counts through the whole table.
    """
    placed = cut(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, offsets = start, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    spark = df.sparkSession
    offset = F.broadcast(spark.createDataFrame(offsets, "__p bigint, __before bigint"))
    inside = F.col("__at") - F.shiftleft(F.col("__p"), 33)
    out = placed.withColumn("__p", part.cast("long")).join(offset, "__p").withColumn(name, F.col("__before") + inside + 1)
    return out.drop("__p", "__before", "__at")


def not_yet_there(lines: DataFrame, standing: DataFrame, key: str = "corporate_number") -> DataFrame:
    """The lines whose key has no row in the standing table: an insert ignores the others. Null keys are kept out."""
    return lines.where(F.col(key).isNotNull()).join(standing.select(key).distinct(), key, "left_anti")


def prepare_entities(lines: DataFrame, config: EntityTypeConfig = COMPANY, lexicon: dict[str, str] | None = None, strip_before_romaji: bool = False, start: int = 0) -> DataFrame:
    """The entity table of latest_lines, with ids from start + 1 on in the order of the lines and the derived columns.

    The romanised name is that of the raw name, legal form included, unless strip_before_romaji is set.
    """
    out = with_normalized(lines, "name", "name_normalized", config.japanese_forms, config.english_forms)
    out = with_normalized(out, "en_name", "en_name_normalized", config.japanese_forms, config.english_forms)
    out = out.withColumn("en_name_normalized", F.when(F.col("en_name").isNotNull(), F.col("en_name_normalized")))
    out = out.withColumn("name_romaji", to_romaji(F.col("name_normalized" if strip_before_romaji else "name"), lexicon))
    out = out.withColumn("phonetic_key", phonetic_key(F.col("name_romaji")))
    derived = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("name_romaji", "phonetic_key")]
    rest = [F.col(f.name) for f in config.fields if f.name not in ("name_romaji", "phonetic_key")]
    return config.project(numbered(out.select("row_no", *rest, *derived), "row_no", start))


def write_registry(entities: DataFrame, config: EntityTypeConfig, path: str, mode: str = "append") -> None:
    """The entity table and its n-gram index as parquet under ``path``."""
    entities.write.mode(mode).parquet(f"{path}/{config.table}")
    ngram_index(entities, config.ngram_fields).repartitionByRange("ngram").write.mode(mode).parquet(f"{path}/{config.name}_ngrams")


def insert_lines(spark: SparkSession, lines: DataFrame, config: EntityTypeConfig, path: str) -> int:
    """Adds the entities of latest_lines that ``path`` doesn't hold yet, and their postings; gives how many.

    Numbers that stand already keep their row and id; new ids go on behind the largest one.
    """
    start = 0
    try:
        standing = spark.read.parquet(f"{path}/{config.table}")
    except AnalysisException:  # the first load
        standing = None
    if standing is not None:
        start = standing.agg(F.max("id")).first()[0] or 0
        lines = not_yet_there(lines, standing)
    new = cut(prepare_entities(lines, config, start=start))
    write_registry(new, config, path)
    return new.count()


def write_answers(answers: DataFrame, path: str, form: str = "json", mode: str = "overwrite") -> None:
    """Matches, comparisons or batch results as files: ``json`` and ``parquet`` keep lists and maps, ``csv`` holds them as JSON text."""
    if form == "csv":
        nested = [f.name for f in answers.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        answers = answers.withColumns({n: F.to_json(n) for n in nested})
    answers.write.mode(mode).options(**({"header": "true"} if form == "csv" else {})).format(form).save(path)


def by_id(entities: DataFrame, config: EntityTypeConfig, entity_id: int) -> DataFrame:
    """The row of an id, in the declared columns."""
    return config.project(entities.where(F.col("id") == entity_id))


def by_ids(entities: DataFrame, config: EntityTypeConfig, ids: DataFrame, id_column: str = "id", order: str = "ord") -> DataFrame:
    """The rows of ids in the order of ``ids``; ids that don't exist are left out."""
    wanted = ids.select(F.col(id_column).alias("id"), F.col(order).alias("__ord"))
    return config.project(entities.join(wanted, "id").orderBy("__ord"))


def stats(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``(entity_count, ngram_count)`` summed over entity types, each given as (entities, ngrams)."""
    parts = [e.select(F.lit(1).alias("e"), F.lit(0).alias("n")).unionAll(n.select(F.lit(0), F.lit(1))) for e, n in tables.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return union.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("entity_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("ngram_count"))
