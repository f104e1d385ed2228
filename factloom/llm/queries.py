"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import credentials, leakage, matching, packing, pii, survivors
from factloom.sources.tables import table


def _credential_texts(spark: SparkSession, d: str) -> DataFrame:
    return credentials.texts_of(table(spark, d, "entities"), table(spark, d, "connection_clients"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(_credential_texts(spark, d)).drop("end_char")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with only the credentials masked."""
    return credentials.redacted(_credential_texts(spark, d))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matching client-item pairs with their posterior as confidence, and whether the exact check holds."""
    return matching.match(table(spark, d, "connection_clients"), table(spark, d, "infra_inventory"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).where("stated").select("client_id", "item_id")


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """The survivor of every group, field by field, with the record each value comes from."""
    return survivors.project_survivors(*(table(spark, d, t) for t in ("entities", "connections", "source_ranks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_fields(spark, d).where(F.col("dominant") & F.col("differing")).select("table_name", "group_id", "field_name", "record_id")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records: one row per group with the chosen values."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value"))))
    return p4_fields(spark, d).groupBy("table_name", "group_id").agg(pairs.alias("survivor"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of whole texts (or pieces of oversized ones) to containers of each capacity."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.report(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans_of(table(spark, d, "documents")).select("doc_id", "pii_kind", "start_char")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts with typed placeholders."""
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p3_redacted, p4_found, p4_fields, p4_survivors, p7_packed, p7_report, p8_found, p9_found, p9_redacted)}
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\s_\-]', '', 'g'), '^service\.', ''),
 '/(\{{[^/}}]*\}}|<[^/>]*>|:[^/]+|\[[^/\]]*\])', '/{{}}', 'g'), '/+$', '')"""
_P4 = rf"""
WITH ent AS (
  SELECT DISTINCT 'entities' AS table_name, project_id || chr(1) || type || chr(1) || {_NORM.format(c="service")} || chr(1) || {_NORM.format(c="name")} AS g,
         entity_id AS id, coalesce(r.trust_rank, 1000000) AS rk, coalesce(confidence, -1e300) AS cf, coalesce(epoch_us(observed_at), -4611686018427387904) AS tm,
         [platform, operation_kind, summary, instance_ref.host, instance_ref.database] AS vals
  FROM entities LEFT JOIN source_ranks r ON r.rank_scope = 'instance_source' AND r.rank_label = lower(trim(instance_ref.source))),
con AS (
  SELECT DISTINCT 'connections' AS table_name, lower(trim(from_exposure_id)) || chr(1) || lower(trim(to_dependency_id)) || chr(1) || coalesce(path_signature, '') AS g,
         connection_id AS id, coalesce(r.trust_rank, 1000000) AS rk, coalesce(confidence, -1e300) AS cf, coalesce(epoch_us(created_at), -4611686018427387904) AS tm,
         [summary, condition_expr] AS vals
  FROM connections LEFT JOIN source_ranks r ON r.rank_scope = 'connection_status' AND r.rank_label = coalesce(nullif(lower(trim(status)), ''), 'verified')
  WHERE trim(from_exposure_id) <> '' AND trim(to_dependency_id) <> ''),
allr AS (SELECT * FROM ent UNION ALL SELECT * FROM con),
grp AS (SELECT table_name, g, min(id) AS group_id FROM allr GROUP BY ALL),
holders AS (
  SELECT table_name, g, id, rk, cf, tm, f.field_name, f.v FROM (
    SELECT table_name, g, id, rk, cf, tm, unnest(CASE table_name WHEN 'entities' THEN [
        {{'field_name': 'platform', 'v': trim(vals[1])}}, {{'field_name': 'operation_kind', 'v': trim(vals[2])}}, {{'field_name': 'summary', 'v': trim(vals[3])}},
        {{'field_name': 'host', 'v': trim(vals[4])}}, {{'field_name': 'database', 'v': trim(vals[5])}}]
      ELSE [{{'field_name': 'summary', 'v': trim(vals[1])}}, {{'field_name': 'condition_expr', 'v': trim(vals[2])}}] END) AS f FROM allr)
  WHERE f.v <> ''),
best AS (
  SELECT *, min(rk) OVER w AS brk, max(cf) OVER w AS bcf, max(tm) OVER w AS btm, min(v) OVER w AS lo, max(v) OVER w AS hi FROM holders
  WINDOW w AS (PARTITION BY table_name, g, field_name)),
top AS (SELECT *, count(*) OVER (PARTITION BY table_name, g, field_name) AS n FROM best WHERE rk = brk AND cf = bcf AND tm = btm AND lo <> hi)
SELECT t.table_name, grp.group_id, t.field_name, t.id AS record_id FROM top t JOIN grp ON grp.table_name = t.table_name AND grp.g = t.g WHERE t.n = 1
"""
ORACLE: dict[str, str] = {"p4_found": _P4}
