"""Queries of the training-data operators in the core: nested records, snapshots, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import references, shredding, snapshots
from factloom.sources.tables import table

IDENTITY = ("id", "name", "status", "from", "to")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return shredding.project_texts(table(spark, d, "service_docs"), table(spark, d, "entities"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = shredding.adjacency(_texts(spark, d), shredding.SPECS, IDENTITY, wrap={"entities": "details"})
    return shredding.records(nodes, pivot={}).select("table_name", "root_id", "record_path", "record_id", "parent_id").distinct()


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency table itself, with all scalars. Redelivered texts are left out before they are taken apart.

    Node numbers are those of one text: of two texts of one root text_hash tells which.
    """
    return shredding.adjacency(_texts(spark, d).distinct(), shredding.SPECS, wrap={"entities": "details"})


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of fields: path and query parameters, headers, body properties, fields in details."""
    nodes = shredding.adjacency(_texts(spark, d), shredding.SPECS, ("name", "type", "required", "nullable", "source.file", "source.line"), wrap={"entities": "details"})
    pivot = {"field_name": "name", "field_type": "type", "required": "required", "nullable": "nullable"}
    rows = shredding.records(nodes, pivot).where(F.col("record_path").rlike(r"(params|headers|fields|properties)$"))
    return rows.drop("ordinal").distinct()


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the thirteen kinds of objects, one row each."""
    nodes = shredding.adjacency(_texts(spark, d), shredding.SPECS, ("id", "kind", "name", "status", "confidence"))
    rows = shredding.records(nodes, {"kind": "kind", "name": "name", "confidence": "confidence"})
    return rows.where(F.col("record_path").rlike(r"^objects\.[a-z_]+$")).drop("ordinal").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.contract_changes(table(spark, d, "contract_fields"), table(spark, d, "graph_runs"))
    return found.drop("before", "after")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes with the values before and after."""
    found = snapshots.contract_changes(table(spark, d, "contract_fields"), table(spark, d, "graph_runs"))
    sides = [F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in ("before", "after") for n in ("type", "required", "nullable")]
    return found.select(*(c for c in found.columns if c not in ("before", "after")), *sides)


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return references.dangling_references(*(table(spark, d, t) for t in ("connections", "job_attempts", "entities", "refresh_jobs")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, column and month."""
    return _dangling(spark, d).groupBy("child_table", "child_column", "period").agg(
        F.count("*").alias("dangling"), F.countDistinct("ref_key").alias("missing_keys")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_fields, p1_objects, p5_found, p5_changes, p6_found, p6_report)}

_P5 = r"""
WITH good AS (
  SELECT project_id, run_id,
         lag(run_id) OVER (PARTITION BY project_id ORDER BY started_at, run_id) AS prev_run,
         lead(run_id) OVER (PARTITION BY project_id ORDER BY started_at, run_id) AS next_run
  FROM graph_runs WHERE lower(trim(coalesce(status, ''))) <> 'failed' AND started_at IS NOT NULL),
latest AS (
  SELECT f.project_id, f.run_id, f.service, f.endpoint_id, f.location, f.name, g.prev_run, g.next_run,
         lower(trim(coalesce(f.type, ''))) AS type, coalesce(f.required, false) AS required, coalesce(f.nullable, false) AS nullable
  FROM contract_fields f JOIN good g ON f.project_id = g.project_id AND f.run_id = g.run_id
  QUALIFY row_number() OVER (PARTITION BY f.project_id, f.run_id, f.service, f.endpoint_id, f.location, f.name
                             ORDER BY f.ingested_at DESC) = 1),
both_sides AS (
  SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.prev_run, b.run_id) AS from_run_id,
         coalesce(a.run_id, b.next_run) AS to_run_id, coalesce(a.service, b.service) AS service,
         coalesce(a.endpoint_id, b.endpoint_id) AS endpoint_id, coalesce(a.location, b.location) AS location,
         coalesce(a.name, b.name) AS name, a.run_id AS ra, b.run_id AS rb,
         b.type AS before_type, b.required AS before_required, b.nullable AS before_nullable,
         a.type AS after_type, a.required AS after_required, a.nullable AS after_nullable
  FROM (SELECT * FROM latest WHERE prev_run IS NOT NULL) a
  FULL JOIN (SELECT * FROM latest WHERE next_run IS NOT NULL) b
    ON a.project_id = b.project_id AND a.run_id = b.next_run AND a.service IS NOT DISTINCT FROM b.service
   AND a.endpoint_id IS NOT DISTINCT FROM b.endpoint_id AND a.location IS NOT DISTINCT FROM b.location
   AND a.name IS NOT DISTINCT FROM b.name)
SELECT project_id, from_run_id, to_run_id, service, endpoint_id, location, name,
       CASE WHEN rb IS NULL THEN 'added' WHEN ra IS NULL THEN 'removed' ELSE 'modified' END AS change,
       CASE WHEN ra IS NULL OR rb IS NULL THEN '' ELSE concat_ws(',',
         CASE WHEN before_nullable <> after_nullable THEN 'nullable' END,
         CASE WHEN before_required <> after_required THEN 'required' END,
         CASE WHEN before_type <> after_type THEN 'type' END) END AS changed_fields {more}
FROM both_sides
WHERE ra IS NULL OR rb IS NULL OR before_type <> after_type OR before_required <> after_required OR before_nullable <> after_nullable
"""

_P6 = r"""
WITH refs AS (
  SELECT 'connections' AS child_table, 'from_exposure_id' AS child_column, connection_id AS child_key,
         lower(trim(from_exposure_id)) AS ref_key, strftime(created_at, '%Y-%m') AS period, 'exposure' AS want FROM connections
  UNION ALL SELECT 'connections', 'to_dependency_id', connection_id, lower(trim(to_dependency_id)), strftime(created_at, '%Y-%m'), 'dependency' FROM connections
  UNION ALL SELECT 'job_attempts', 'job_id', attempt_id, lower(trim(job_id)), strftime(started_at, '%Y-%m'), 'job' FROM job_attempts),
parents AS (
  SELECT kind AS want, lower(trim(entity_id)) AS k FROM entities WHERE deleted_at IS NULL
  UNION ALL SELECT 'job', lower(trim(job_id)) FROM refresh_jobs WHERE deleted_at IS NULL),
found AS (
  SELECT DISTINCT child_table, child_column, child_key, ref_key, period FROM refs
  WHERE ref_key <> '' AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.want = refs.want AND p.k = refs.ref_key))
"""

ORACLE = {
    "p5_found": _P5.format(more=""),
    "p5_changes": _P5.format(more=", before_type, before_required, before_nullable, after_type, after_required, after_nullable"),
    "p6_found": _P6 + "SELECT * FROM found",
    "p6_report": _P6 + "SELECT child_table, child_column, period, count(*) AS dangling, count(DISTINCT ref_key) AS missing_keys FROM found GROUP BY ALL",
}
