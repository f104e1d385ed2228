"""Documents, runs, snapshots, packs, catalog and the event log on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose schema names another kind or version are left out.
SCHEMA_PATTERN = r"\.service\.v1$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc variant, schema, service): one row per service document; other schemas are left out."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    return d.select("path", "doc", F.expr("try_variant_get(doc, '$.schema', 'string')").alias("schema"), F.expr("try_variant_get(doc, '$.service.name', 'string')").alias("service")).where(F.col("schema").rlike(SCHEMA_PATTERN))


def read_run_dir(spark: SparkSession, path: str) -> DataFrame:
    """(kind, type, item) of a run folder: `exposures/<type>.json` and the like, the file's name is the type."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("p"), F.try_parse_json("value").alias("v"))
    items = d.select(F.regexp_extract("p", r"/([^/]+)/[^/]+\.json$", 1).alias("kind"), F.regexp_extract("p", r"([^/]+)\.json$", 1).alias("type"), F.expr("try_cast(v as array<variant>)").alias("a"))
    return items.select("kind", "type", F.explode("a").alias("item"))


def latest_runs(runs: DataFrame, key: str = "project_id") -> DataFrame:
    """The newest good run of each project; the id decides between equal times."""
    r = runs.where(F.col("status").isin("succeeded", "completed"))
    return r.groupBy(key).agg(F.max_by(F.struct(*r.columns), F.struct("finished_at", "run_id")).alias("r")).select("r.*")


def load_snapshot(rows: DataFrame, runs: DataFrame, run_id: str | None = None, project: str | None = None) -> DataFrame:
    """Rows of an explicit good run, else of each project's newest good run; a failed or unknown run gives none."""
    r = runs.where(F.col("run_id") == run_id).where(F.col("status").isin("succeeded", "completed")) if run_id else latest_runs(runs)
    if project:
        r = r.where(F.col("project_id") == project)
    return rows.join(r.select("project_id", "run_id").distinct(), ["project_id", "run_id"], "left_semi")


def write_snapshot(df: DataFrame, path: str) -> None:
    """An immutable snapshot per project and run, each written to a path of its own; a run that is there already is an error.

    A snapshot is one run, or the few that are ready together.
    """
    cols = [c for c in df.columns if c not in ("project_id", "run_id")]
    for r in df.select("project_id", "run_id").distinct().orderBy("project_id", "run_id").collect():
        own = df.where(F.col("project_id").eqNullSafe(r.project_id) & F.col("run_id").eqNullSafe(r.run_id)).select(cols)
        try:
            own.write.mode("errorifexists").parquet(f"{path}/project_id={r.project_id}/run_id={r.run_id}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_ALREADY_EXISTS":
                raise FileExistsError(f"run {r.run_id} of {r.project_id} is already stored") from e
            raise


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same multiset of rows."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        return False
    x, y = a.select(cols), b.select(cols)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def catalog_import(catalog: DataFrame, found: DataFrame, key: str, fields: list[str], owner: str = "owner") -> DataFrame:
    """Full outer merge of a durable catalog with a run's facts: what a person wrote stays, else the run's value if it has one."""
    c = catalog.select(key, F.col(owner).alias("c_owner"), *(F.col(f).alias(f"c_{f}") for f in fields))
    n = found.select(key, *(F.col(f).alias(f"n_{f}") for f in fields), F.lit(True).alias("is_found"))
    j = c.join(n, key, "full_outer")
    manual = F.coalesce(F.col("c_owner") == "manual", F.lit(False))
    pick = [F.when(manual, F.coalesce(f"c_{f}", f"n_{f}")).otherwise(F.coalesce(f"n_{f}", f"c_{f}")).alias(f) for f in fields]
    state = F.when(F.col("c_owner").isNull(), "added").when(F.col("is_found").isNull(), "kept").when(manual, "manual").otherwise("updated")
    return j.select(key, F.coalesce("c_owner", F.lit("automation")).alias(owner), *pick, state.alias("outcome"))


def append_events(df: DataFrame, path: str) -> None:
    """Appends events as JSON lines, one folder per run."""
    df.write.mode("append").partitionBy("run_id").json(path)


def replay_events(spark: SparkSession, path: str, schema: str, run_id: str | None = None) -> DataFrame:
    """Stored events in order of their sequence."""
    e = spark.read.schema(schema).json(path)
    return (e.where(F.col("run_id") == run_id) if run_id else e).orderBy("run_id", "sequence")


def verify_copy(rows: DataFrame, before: DataFrame, after: DataFrame, scope: str = "project_id") -> DataFrame:
    """Per scope: rows stored, keys, and how many rows one copy has that the other hasn't, both ways, repeated rows counted."""
    alone = lambda a, b, n: a.exceptAll(b).groupBy(scope).agg(F.count("*").alias(n))
    g = rows.groupBy(scope).agg(F.count("*").alias("stored"), F.countDistinct("job_id").alias("jobs"))
    j = g.join(alone(before, after, "lost"), scope, "left").join(alone(after, before, "unknown"), scope, "left")
    return j.select(scope, "stored", "jobs", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("lost", "unknown")))
