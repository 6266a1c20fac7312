"""The engine's surface: the tools by which programs ask for a project's graph, each a plan over the stored tables."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import flows as L
from graphloom.operators import graph as G
from graphloom.operators import navigation as V
from graphloom.operators import search as S
from graphloom.plans import cypher
from graphloom.sources import derive
from graphloom.sources.store import GraphStore

#: Rows that each tool gives unless told otherwise.
LIMITS = {"search_graph": 20, "find_symbol": 10, "find_references": 30, "impact_analysis": 50, "find_routes": 20, "search_code": 20, "find_tests_for_target": 10, "trace_data_flow": 10, "find_entrypoints": 10, "suggest_next_reads": 10, "suggest_project_links": 10}
#: Steps of a trace and of an impact analysis.
TRACE_DEPTH, IMPACT_DEPTH = 5, 3
#: Neighbours of one kind that the details of a symbol list, and the kinds.
DETAILS = 10
DETAIL_KINDS = {
    "callers": (("CALLS", "ASYNC_CALLS", "HTTP_CALLS"), True), "callees": (("CALLS", "ASYNC_CALLS", "HTTP_CALLS"), False), "imports": (("IMPORTS",), False), "imported_by": (("IMPORTS",), True), "parents": (("INHERITS", "IMPLEMENTS"), False), "children": (("INHERITS", "IMPLEMENTS"), True), "members": (("CONTAINS",), False), "tests": (("TESTS",), True),
}


class Engine:
    """The tools over tables ``read(name)`` gives: nodes, edges, file_hashes, projects, project_links, decisions, code_content."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], store: GraphStore | None = None):
        self.spark, self.read, self.store = spark, read, store

    @classmethod
    def of(cls, store: GraphStore) -> Engine:
        """An engine over a store, which also takes its changes."""
        return cls(store.spark, store.read, store)

    def _nodes(self, project: str | None = None) -> DataFrame:
        nodes = self.read("nodes")
        return nodes if project is None else nodes.where(F.col("project") == project)

    def _edges(self, project: str | None = None) -> DataFrame:
        edges = self.read("edges")
        return edges if project is None else edges.where(F.col("project") == project)

    def _limited(self, df: DataFrame, tool: str, limit: int | None, *order) -> DataFrame:
        return df.orderBy(*order).limit(LIMITS[tool] if limit is None else limit)

    # projects
    def list_projects(self) -> DataFrame:
        """(name, indexed_at, root_path, nodes) of every project."""
        held = self._nodes().groupBy(F.col("project").alias("name")).agg(F.count("*").alias("nodes"))
        return self.read("projects").join(held, "name", "left").select("name", "indexed_at", "root_path", F.coalesce("nodes", F.lit(0)).alias("nodes")).orderBy("name")

    def index_status(self, project: str) -> DataFrame:
        """(nodes, edges, files) of a project."""
        n, e = self._nodes(project).agg(F.count("*").alias("nodes")), self._edges(project).agg(F.count("*").alias("edges"))
        f = self.read("file_hashes").where((F.col("project") == project) & ~F.coalesce("is_deleted", F.lit(False))).agg(F.count_distinct("rel_path").alias("files"))
        return n.join(e).join(f)  # one row each

    def index_repository(self, project: str, root: str) -> int:
        """Read a source tree into the store: its files, their hashes and symbols; what is held already stays."""
        from graphloom.sources.extract import symbols
        from graphloom.sources.repository import repository_files

        files = repository_files(self.spark, root)
        found = symbols(files.select("rel_path", "language", "content"))
        name = C.qualified_name(F.lit(project), F.col("rel_path"), F.col("name"))
        nodes = found.select(F.xxhash64(F.lit(project), name).alias("id"), F.lit(project).alias("project"), "label", "name", name.alias("qualified_name"), F.col("rel_path").alias("file_path"), "start_line", "end_line", F.to_json(F.struct("signature", "is_test", "is_exported", "decorators")).alias("properties"))
        self.store.put("file_hashes", files.select(F.lit(project).alias("project"), "rel_path", "sha256", "size", F.lit(False).alias("is_deleted")))
        self.store.put("projects", self.spark.range(1).select(F.lit(project).alias("name"), F.current_timestamp().cast("string").alias("indexed_at"), F.lit(root).alias("root_path")))
        return self.store.insert("nodes", nodes, "start_line")

    def delete_project(self, project: str) -> None:
        """Delete a project's rows."""
        self.store.delete_project(project)

    def detect_changes(self, root: str) -> DataFrame:
        """(rel_path): the files of a working tree that differ from its last commit."""
        out = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", "HEAD"], capture_output=True, text=True, check=True).stdout
        return self.spark.createDataFrame([(p,) for p in out.split("\0") if p], "rel_path string")

    def manage_adr(self, project: str, title: str | None = None, content: str = "", id_: int = 0, created_at: str = "") -> DataFrame:
        """Record a decision if a title is given; the project's decisions in the order in which they were made."""
        if title is not None:
            self.store.put("decisions", self.spark.createDataFrame([(id_, project, title, content, created_at)], "id bigint, project string, title string, content string, created_at string"))
        return self.read("decisions").where(F.col("project") == project).orderBy("created_at", "id")

    def link_project(self, a: str, b: str) -> int:
        """Link two projects, in both directions."""
        return self.store.link(a, b)

    def list_project_links(self, project: str) -> DataFrame:
        """(target_project) of a project's links."""
        return self.read("project_links").where(F.col("source_project") == project).select("target_project").orderBy("target_project")

    def suggest_project_links(self, limit: int | None = None) -> DataFrame:
        """(a, b, score, reasons) of projects that may belong together and aren't linked."""
        held = self.read("project_links").select(F.least("source_project", "target_project").alias("a"), F.greatest("source_project", "target_project").alias("b")).distinct()
        return self._limited(S.link_suggestions(self.read("projects"), self._nodes()).join(held, ["a", "b"], "left_anti"), "suggest_project_links", limit, F.desc("score"), "a", "b")

    # search
    def get_graph_schema(self, project: str | None = None) -> DataFrame:
        """(what, value, n): labels and edge types with their numbers."""
        n = self._nodes(project).groupBy(F.lit("label").alias("what"), F.col("label").alias("value")).agg(F.count("*").alias("n"))
        return n.unionByName(self._edges(project).groupBy(F.lit("type").alias("what"), F.col("type").alias("value")).agg(F.count("*").alias("n")))

    def search_graph(self, project: str, query: str, label: str | None = None, limit: int | None = None) -> DataFrame:
        """Nodes whose name or qualified name holds all words of the query, then those whose properties do."""
        n = self._nodes(project)
        n = n if label is None else n.where(F.col("label") == label)
        held = n.where(S.matches(query)), n.where(F.contains(F.lower("properties"), F.lit(query.lower())))
        return S.layered([x.select("id", "label", "name", "qualified_name", "file_path", "start_line") for x in held], "id", LIMITS["search_graph"] if limit is None else limit)

    def search_linked_projects(self, project: str, query: str, limit: int | None = None) -> DataFrame:
        """The same in the projects linked from a project, all together within the limit."""
        linked = self.read("project_links").where(F.col("source_project") == project).select(F.col("target_project").alias("project")).distinct()
        return self._limited(self._nodes().join(linked, "project").where(S.matches(query)).select("project", "id", "label", "name", "qualified_name"), "search_graph", limit, "project", "qualified_name")

    def query_graph(self, text: str, compatible: bool = True) -> DataFrame:
        """A path pattern."""
        return cypher.run(text, self._nodes(), self._edges(), compatible=compatible)

    def search_code(self, project: str, pattern: str, limit: int | None = None) -> DataFrame:
        """(qualified_name, line_no, line): the lines of snippets that hold a text."""
        lines = self.read("code_content").where(F.col("project") == project).select("qualified_name", F.posexplode(F.split("content", "\n")).alias("i", "line"))
        return self._limited(lines.where(F.contains("line", F.lit(pattern))).select("qualified_name", (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line")), "search_code", limit, "qualified_name", "line_no")

    def get_code_snippet(self, project: str, qualified_name: str) -> DataFrame:
        """(content) of a symbol."""
        return self.read("code_content").where((F.col("project") == project) & (F.col("qualified_name") == qualified_name)).select("content")

    def find_symbol(self, project: str, query: str, label: str | None = None, limit: int | None = None) -> DataFrame:
        """Symbols ranked by how well their names fit."""
        return S.ranked_symbols(self._nodes(project).withColumn("file_path", F.coalesce("file_path", F.lit(""))), query, LIMITS["find_symbol"] if limit is None else limit, label)

    def _named(self, project: str, qualified_name: str) -> DataFrame:
        return self._nodes(project).where(F.col("qualified_name") == qualified_name)

    def get_symbol_details(self, project: str, qualified_name: str) -> DataFrame:
        """(kind, qualified_name): up to DETAILS neighbours of each kind, by name."""
        return V.details(self._nodes(), self._edges(), self._named(project, qualified_name), DETAIL_KINDS, DETAILS)

    def find_references(self, project: str, qualified_name: str, limit: int | None = None) -> DataFrame:
        """(type, name, file_path) of what refers to a symbol."""
        t = self._named(project, qualified_name).select(F.col("id").alias("target_id"))
        e = self._edges().join(t, "target_id", "left_semi").select("source_id", "type").distinct()
        return self._limited(e.join(self._nodes().select(F.col("id").alias("source_id"), "name", "file_path"), "source_id").select("type", "name", "file_path"), "find_references", limit, "file_path", "name", "type")

    def get_architecture(self, project: str) -> DataFrame:
        """(layer, files) of a project, by the words of its paths."""
        files = self._nodes(project).where("file_path <> ''").select("file_path").distinct()
        return files.groupBy(F.coalesce(C.layer(F.col("file_path")), F.lit("other")).alias("layer")).agg(F.count("*").alias("files"))

    def explain_index_result(self, project: str, file_path: str) -> DataFrame:
        """(file_path, message): what is odd about the index of a file; none if nothing is."""
        return V.file_messages(self._nodes(project), self._edges(project), self.read("file_hashes").where(F.col("project") == project)).where(F.col("file_path") == file_path)

    # flows and navigation
    def trace_call_path(self, project: str, source: str, depth: int = TRACE_DEPTH) -> DataFrame:
        """(id, depth) of what the functions whose name holds a text call."""
        seeds = self._nodes(project).where(F.contains("name", F.lit(source)) & F.col("label").isin("Function", "Method"))
        return G.frontier(self._edges(project).where(F.col("type").isin("CALLS", "ASYNC_CALLS")), seeds, depth)

    def impact_analysis(self, project: str, qualified_name: str, depth: int = IMPACT_DEPTH, limit: int | None = None) -> DataFrame:
        """(id, depth) of what depends on a symbol, over all edges and projects."""
        return self._limited(G.frontier(self._edges(), self._named(project, qualified_name), depth, reverse=True).where("depth > 0"), "impact_analysis", limit, "depth", "id")

    def trace_data_flow(self, project: str, source: str, flow: str = "any", depth: int = TRACE_DEPTH, target: str | None = None, limit: int | None = None) -> DataFrame:
        """(source, last, path, steps, score) of the best paths from a symbol."""
        goal = None if target is None else self._named(project, target)
        return self._limited(L.scored_paths(self._nodes(), self._edges(), self._named(project, source), flow, depth, goal), "trace_data_flow", limit, F.desc("score"), "steps", "path")

    def find_routes(self, project: str, scope: str | None = None, method: str | None = None, limit: int | None = None) -> DataFrame:
        """Routes with their handlers."""
        return self._limited(L.find_routes(self._nodes().where(F.col("project") == project), self._edges(), self.read("file_hashes"), method, scope), "find_routes", limit, F.desc("score"), "path", "method")

    def trace_backend_flow(self, project: str, scope: str | None = None, method: str | None = None) -> DataFrame:
        """(route_id, id, depth, layer) of the best fitting route's request."""
        return L.backend_flow(self._nodes(), self._edges(), self.find_routes(project, scope, method, 1))

    def find_entrypoints(self, project: str, kind: str = "any", limit: int | None = None) -> DataFrame:
        """Entry points by score."""
        return self._limited(V.entry_points(self._nodes(project), kind), "find_entrypoints", limit, F.desc("score"), "qualified_name")

    def suggest_next_reads(self, project: str, qualified_name: str, goal: str = "understand", limit: int | None = None) -> DataFrame:
        """Neighbours worth reading."""
        return self._limited(V.next_reads(self._nodes(), self._edges(), self._named(project, qualified_name), goal), "suggest_next_reads", limit, F.desc("score"), "qualified_name")

    def get_file_overview(self, project: str, file_path: str) -> DataFrame:
        """What a file holds and imports."""
        return V.file_overview(self._nodes(project), self._edges(project)).where(F.col("file_path") == file_path)

    def find_tests_for_target(self, project: str, file_path: str, limit: int | None = None) -> DataFrame:
        """Test files of a file."""
        files = self._nodes(project).where("file_path <> ''").select("project", "file_path").distinct()
        return self._limited(V.test_files(files).where(F.col("file_path") == file_path), "find_tests_for_target", limit, F.desc("score"), "test_path")

    def find_pipelines(self, project: str) -> DataFrame:
        """Pipelines of a project and of the linked ones."""
        return V.over_links(V.pipelines(self._nodes(), self._edges()), self.read("project_links"), project, ["ci_system", "file_path", "pipeline"])

    def find_infrastructure(self, project: str, kind: str | None = None) -> DataFrame:
        """Infrastructure of a project and of the linked ones."""
        return V.over_links(V.infrastructure(self._nodes(), kind), self.read("project_links"), project, ["kind", "name", "file_path"])

    def ingest_traces(self, project: str, traces: str) -> DataFrame:
        """(source_id, target_id) of recorded calls given as JSON."""
        return derive.trace_edges(self.spark.createDataFrame([(project, traces)], "project string, traces string"), self._nodes())
