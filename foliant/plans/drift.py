"""Queries on drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators import schema_drift
from foliant.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.found(table(spark, d, "raw_records"), table(spark, d, "raw_files"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Every change with types, cost and whether the projections follow it."""
    return schema_drift.schema_changes(table(spark, d, "raw_records"), table(spark, d, "raw_files"))


def _family(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return schema_drift.consistent_table(table(spark, d, "raw_records"), table(spark, d, "raw_files"), name)

    return query


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_canonical_models": _family("canonical_model"),
    "p1_manual_labels": _family("manual_label"),
    "p1_fixture_thresholds": _family("fixture_metadata"),
}

_P1_SQL = """
  WITH f AS (SELECT file_id, family, lag(file_id) OVER (PARTITION BY series ORDER BY written_at NULLS FIRST, file_id) AS prev FROM raw_files),
  good AS (SELECT r.file_id, r.record_id, f.family, r.payload FROM raw_records r JOIN f USING (file_id) WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
  leaf AS (SELECT g.file_id, CASE family WHEN 'canonical_model' THEN payload ->> '$.document_id' WHEN 'manual_label' THEN payload ->> '$.sentence_id' ELSE payload ->> '$.fixture' END AS rec,
      replace(substring(t.fullkey, 3), '"', '') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS type, CAST(t.value AS VARCHAR) AS value
    FROM good g, json_tree(g.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
  present AS (SELECT file_id, path, list_sort(list(DISTINCT type)) AS types FROM leaf GROUP BY ALL),
  pair AS (SELECT file_id, prev FROM f WHERE prev IS NOT NULL),
  old AS (SELECT pair.file_id, path, types FROM pair JOIN present ON present.file_id = pair.prev),
  new AS (SELECT pair.file_id, path, types FROM pair JOIN present ON present.file_id = pair.file_id),
  diff AS (SELECT file_id, path, old.types AS o, new.types AS n FROM old FULL JOIN new USING (file_id, path)),
  gone AS (SELECT file_id, path FROM diff WHERE n IS NULL), come AS (SELECT file_id, path FROM diff WHERE o IS NULL),
  recs AS (SELECT DISTINCT file_id, rec FROM leaf WHERE rec IS NOT NULL),
  common AS (SELECT pair.file_id, a.rec FROM pair JOIN recs a ON a.file_id = pair.prev JOIN recs b ON b.file_id = pair.file_id AND b.rec = a.rec),
  ov AS (SELECT DISTINCT gone.file_id, leaf.rec, leaf.path, leaf.type, leaf.value FROM gone JOIN pair USING (file_id) JOIN leaf ON leaf.file_id = pair.prev AND leaf.path = gone.path JOIN common ON common.file_id = gone.file_id AND common.rec = leaf.rec),
  nv AS (SELECT DISTINCT come.file_id, leaf.rec, leaf.path, leaf.type, leaf.value FROM come JOIN leaf ON leaf.file_id = come.file_id AND leaf.path = come.path JOIN common ON common.file_id = come.file_id AND common.rec = leaf.rec),
  eq AS (SELECT file_id, ov.path AS old_path, nv.path AS new_path, count(*) AS n FROM ov JOIN nv USING (file_id, rec, type, value) GROUP BY ALL),
  renamed AS (SELECT file_id, old_path, new_path FROM eq WHERE n = (SELECT count(*) FROM ov WHERE ov.file_id = eq.file_id AND ov.path = eq.old_path) AND n = (SELECT count(*) FROM nv WHERE nv.file_id = eq.file_id AND nv.path = eq.new_path))
  SELECT file_id, 'retyped' AS change_kind, path AS old_path, path AS new_path FROM diff WHERE o <> n
  UNION ALL SELECT file_id, 'renamed', old_path, new_path FROM renamed
  UNION ALL SELECT file_id, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.old_path = g.path)
  UNION ALL SELECT file_id, 'added', '', path FROM come c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = c.file_id AND r.new_path = c.path)"""

ORACLE_SQL = {"p1_found": _P1_SQL}
