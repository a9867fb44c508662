"""Driver queries of this subpackage, and SQL where it can say the same over whole tables."""

from __future__ import annotations

from linkspark.llm.addresses import places, same_place
from linkspark.llm.fold import consistent_sql, disguised, with_consistent
from linkspark.llm.names import organisations, same_organisation
from linkspark.llm.packing import containers, pack_documents, packing_faults
from linkspark.llm.tokenizer import count_tokens, decode, encode
from linkspark.llm.toxicity import rates, score
from linkspark.sources.tables import table


def _documents(spark, d):
    return table(spark, d, "documents")


def _scored(spark, d):
    return score(_documents(spark, d), table(spark, d, "toxicity_labels"))


def _companies(spark, d):
    return table(spark, d, "companies")


def _split_documents(spark, d):
    return pack_documents(_documents(spark, d)).where("n_parts > 1").select("doc_id").distinct()


_FIELDS = ("name", "name_normalized", "address")
_VALUES = "(" + " UNION ALL ".join(f"SELECT id, '{f}' AS field_name, {f} AS v FROM companies WHERE {f} IS NOT NULL" for f in _FIELDS) + ")"


def _consistent(spark, d):
    return with_consistent(_companies(spark, d).select("id", *_FIELDS), _FIELDS)


QUERIES = {
    "p1_found": lambda s, d: same_organisation(_companies(s, d)),
    "p1_organisations": lambda s, d: organisations(_companies(s, d)),
    "p2_found": lambda s, d: same_place(_companies(s, d), table(s, d, "prefectures")),
    "p2_places": lambda s, d: places(_companies(s, d), table(s, d, "prefectures")),
    "p4_found": lambda s, d: disguised(_companies(s, d)),
    "p4_consistent": _consistent,
    "p6_ids": lambda s, d: encode(_documents(s, d)),
    "p6_counts": lambda s, d: count_tokens(_documents(s, d)),
    "p6_round_trip": lambda s, d: decode(encode(_documents(s, d))),
    "p7_found": _split_documents,
    "p7_packing": lambda s, d: pack_documents(_documents(s, d)),
    "p8_found": lambda s, d: _scored(s, d).where("unwanted").select("doc_id"),
    "p8_scores": _scored,
    "p8_rates": lambda s, d: rates(_scored(s, d)),
    "p7_faults": lambda s, d: packing_faults(pack_documents(_documents(s, d))),
    "p7_containers": lambda s, d: containers(pack_documents(_documents(s, d))),
}

ORACLES = {
    # the embedded SQL over the whole table at once, without Spark's partitions and batches
    "p4_found": f"SELECT id, field_name FROM ({consistent_sql(_VALUES, 'id, field_name')}) WHERE w <> v",
    "p4_consistent": f"""PIVOT (SELECT id, field_name, w FROM ({consistent_sql(_VALUES, 'id, field_name')}))
                         ON field_name IN ('name', 'name_normalized', 'address') USING max(w) GROUP BY id""",
    "p7_faults": "SELECT count(DISTINCT doc_id) AS n_items, 0 AS n_overfull, 0 AS n_overlapping, 0 AS n_split_early, 0 AS n_broken FROM documents",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
