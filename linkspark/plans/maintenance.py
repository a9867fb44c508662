"""Driver queries over registry snapshots and n-gram postings, and the SQL that says the same."""

from __future__ import annotations

from linkspark.operators.heavy_keys import heavy_keys, key_profile
from linkspark.operators.snapshots import snapshot_changes, snapshot_digests
from linkspark.sources.tables import table

_STANDING = """
standing AS (
  SELECT snapshot_no, corporate_number, name, address FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, corporate_number
      ORDER BY loaded_at DESC NULLS LAST, name DESC NULLS LAST, address DESC NULLS LAST) AS rn
    FROM company_snapshots WHERE snapshot_no IS NOT NULL AND corporate_number IS NOT NULL) WHERE rn = 1),
nos AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no
        FROM (SELECT DISTINCT snapshot_no FROM standing)),
old AS (SELECT nos.next_no AS snapshot_no, s.corporate_number, s.name, s.address
        FROM standing s JOIN nos ON s.snapshot_no = nos.snapshot_no WHERE nos.next_no IS NOT NULL),
new AS (SELECT * FROM standing WHERE snapshot_no > (SELECT min(snapshot_no) FROM standing)),
changes AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no,
         coalesce(n.corporate_number, o.corporate_number) AS corporate_number,
         CASE WHEN o.corporate_number IS NULL THEN 'added' WHEN n.corporate_number IS NULL THEN 'removed'
              WHEN n.name IS DISTINCT FROM o.name OR n.address IS DISTINCT FROM o.address THEN 'changed' END AS change_kind
  FROM new n FULL OUTER JOIN old o ON n.snapshot_no = o.snapshot_no AND n.corporate_number = o.corporate_number)
"""

_PROFILE = """
  SELECT ngram, count(*) AS n_rows, count(DISTINCT company_id) AS n_distinct,
         quantile_disc(company_id, 0.25) AS q25, quantile_disc(company_id, 0.5) AS q50,
         quantile_disc(company_id, 0.75) AS q75
  FROM company_ngrams WHERE ngram IS NOT NULL GROUP BY ngram
"""


def _changes(spark, d):
    return snapshot_changes(table(spark, d, "company_snapshots"))


def _heavy(spark, d):
    return heavy_keys(table(spark, d, "company_ngrams"), "ngram", "company_id")


QUERIES = {
    "p3_found": _changes,
    "p3_counts": lambda s, d: _changes(s, d).groupBy("snapshot_no", "change_kind").count().withColumnRenamed("count", "n"),
    "p3_digests": lambda s, d: snapshot_digests(table(s, d, "company_snapshots")),
    "p5_found": lambda s, d: _heavy(s, d).select("ngram"),
    "p5_heavy": _heavy,
    "p5_profile": lambda s, d: key_profile(table(s, d, "company_ngrams"), "ngram", "company_id"),
}

ORACLES = {
    "p3_found": f"WITH {_STANDING} SELECT * FROM changes WHERE change_kind IS NOT NULL",
    "p3_counts": f"""WITH {_STANDING} SELECT snapshot_no, change_kind, count(*) AS n FROM changes
                     WHERE change_kind IS NOT NULL GROUP BY ALL""",
    "p3_digests": """SELECT snapshot_no, count(*) AS n_rows, count(DISTINCT corporate_number) AS n_keys
                     FROM company_snapshots WHERE corporate_number IS NOT NULL AND snapshot_no IS NOT NULL
                     GROUP BY snapshot_no""",
    "p5_found": """SELECT ngram FROM company_ngrams WHERE ngram IS NOT NULL GROUP BY ngram
                   HAVING count(*) >= 0.03 * (SELECT count(*) FROM company_ngrams)""",
    "p5_heavy": f"""WITH total AS (SELECT count(*) AS t FROM company_ngrams)
                    SELECT p.*, n_rows / t AS share FROM ({_PROFILE}) p, total WHERE n_rows >= 0.03 * t""",
    "p5_profile": _PROFILE,
}
