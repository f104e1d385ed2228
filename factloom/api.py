"""What callers can ask: one method per read tool, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import graph as G
from factloom.operators import snapshots
from factloom.operators import traverse as T
from factloom.plans import base as B
from factloom.sources import store
from factloom.sources.tables import table

PAGE, MAX_PAGE, HITS, MAX_HITS = 100, 500, 50, 200


class GraphStore:
    """Read access to the fact tables of one folder, optionally restricted to some projects."""

    def __init__(self, spark: SparkSession, root: str, visible: list[str] | None = None):
        self.spark, self.root, self.visible = spark, root, visible

    def _mine(self, df: DataFrame) -> DataFrame:
        return df if self.visible is None else df.where(F.col("project_id").isin(self.visible))

    def facts(self, project: str | None = None) -> DataFrame:
        f = self._mine(B.facts(self.spark, self.root))
        return f.where(F.col("project_id") == project) if project else f

    def edges(self, project: str | None = None) -> DataFrame:
        return G.aggregated(G.typed_edges(self.facts(project)))

    def list_projects(self) -> DataFrame:
        return self._mine(table(self.spark, self.root, "graph_runs")).groupBy("project_id").agg(F.count("*").alias("runs"), F.max("finished_at").alias("last_run"))

    def get_graph_summary(self, project: str | None = None) -> DataFrame:
        e = self.edges(project)
        return G.nodes(self.facts(project), e).groupBy("node_kind").agg(F.count("*").alias("nodes"))

    def list_services(self, project: str | None = None) -> DataFrame:
        return self.facts(project).groupBy("service").agg(F.count_if(F.col("kind") == "exposure").alias("entrypoints"), F.count_if(F.col("kind") == "dependency").alias("dependencies"), F.max("tag").alias("team"))

    def get_service(self, service: str, project: str | None = None) -> DataFrame:
        s = N.service_name(F.lower("service"))
        return self.facts(project).where(s == service.lower()).select("entity_id", "kind", "type", "name", "confidence")

    def get_dependencies(self, node: str, direction: str = "both", project: str | None = None, offset: int = 0, size: int = HITS) -> DataFrame:
        out, into = F.col("src") == node, F.col("dst") == node
        keep = {"outbound": out, "inbound": into, "both": out | into}[direction]
        return self.edges(project).where(keep).orderBy("src", "dst", "edge_type").offset(offset).limit(min(size, MAX_HITS))

    def search_architecture(self, text: str, project: str | None = None, size: int = HITS) -> DataFrame:
        """Hits in order of discovery, capped, then sorted."""
        t = text.strip().lower()
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t))
        f = self.facts(project)
        hits = f.where(has("name") | has("details") | has("service")).select("entity_id", "type", "name", "service")
        return hits.orderBy("entity_id").limit(min(size, MAX_HITS)).orderBy("name", "entity_id")

    def get_contracts(self, project: str, run: str | None = None, service: str | None = None) -> DataFrame:
        fields = self._mine(table(self.spark, self.root, "contract_fields"))
        rows = store.load_snapshot(fields, table(self.spark, self.root, "graph_runs"), run, project)
        return rows.where(F.col("service") == service) if service else rows

    def compare_contracts(self, project: str) -> DataFrame:
        """Changes between all consecutive snapshots of a project."""
        runs = table(self.spark, self.root, "graph_runs").where(F.col("project_id") == project)
        return self._mine(snapshots.contract_changes(table(self.spark, self.root, "contract_fields"), runs))

    def get_impact(self, target: str, project: str | None = None, depth: int = 6, nodes: int = 500) -> DataFrame:
        return T.blast_radius(G.impact_edges(self.edges(project)), target, depth, nodes)

    def list_graph_runs(self, project: str | None = None, offset: int = 0, size: int = PAGE) -> DataFrame:
        r = self._mine(table(self.spark, self.root, "graph_runs"))
        r = r.where(F.col("project_id") == project) if project else r
        return r.orderBy(F.desc("started_at"), "run_id").offset(offset).limit(min(size, MAX_PAGE))

    def compare_graphs(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Added, removed and modified edges between two edge tables."""
        k = ["src", "dst", "edge_type"]
        a, b = before.select(*k, F.struct("facts", "confidence").alias("before")), after.select(*k, F.struct("facts", "confidence").alias("after"))
        j = a.join(b, k, "full_outer")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
        return j.withColumn("change", change).where("change is not null")

    def find_dependency_path(self, start: str, end: str, project: str | None = None, depth: int = 6) -> DataFrame:
        t = self.spark.createDataFrame([(end,)], "node string")
        return T.shortest_path(self.edges(project), start, t, depth)

    def get_object_trace(self, entity_id: str) -> DataFrame:
        l = B.links(self.spark, self.root).where((F.col("src") == entity_id) | (F.col("dst") == entity_id))  # noqa: E741
        return self._mine(l).select("connection_id", "src", "dst", "status", "confidence").orderBy("connection_id")
