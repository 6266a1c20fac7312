"""Routes with their handlers, and flows of requests, data and rendering through the layers of a program."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import fixed
from graphloom.operators import graph as G

#: Edge types of each kind of flow; "any" follows all.
FLOWS = {"request": ("CALLS", "ASYNC_CALLS", "HTTP_CALLS", "HANDLES_ROUTE"), "render": ("RENDERS", "CALLS"), "data": ("CALLS", "ASYNC_CALLS", "IMPORTS", "USES")}
FRONTEND = ("RENDERS", "INJECTS", "SELECTS", "CALLS")


def prop(name: str, column: str = "properties") -> Column:
    return F.get_json_object(column, f"$.{name}")


def first_neighbour(edges: DataFrame, nodes: DataFrame, type_: str, inbound: bool) -> DataFrame:
    """(at, name, qualified_name, file_path) of the neighbour behind each node's first edge of a type (least edge id)."""
    at, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    first = edges.where(F.col("type") == type_).groupBy(F.col(at).alias("at")).agg(F.min_by(other, "id").alias("other"))
    n = nodes.select(F.col("id").alias("other"), "name", "qualified_name", "file_path")
    return first.join(n, "other").drop("other")


def find_routes(nodes: DataFrame, edges: DataFrame, hashes: DataFrame | None = None, method: str | None = None, scope: str | None = None) -> DataFrame:
    """(project, route_id, method, path, handler, handler_qn, file_path, request_dto, response_dto, confidence, score).

    The handler is the node behind HANDLES_ROUTE (confidence 1.0), else the name a route carries (0.7), else the last part
    of its qualified name (0.5). DTOs come from ACCEPTS_DTO and RETURNS_DTO edges, else from the route's properties.
    ``hashes`` drops routes whose file is known to be gone, ``method`` compares without regard to case, and ``scope`` keeps
    what its score fits in path, file or handler. Joined are only the edges of the three types; each is grouped first.
    """
    r = nodes.where("label = 'Route'").select("project", F.col("id").alias("at"), "name", F.col("qualified_name").alias("route_qn"), F.coalesce("file_path", F.lit("")).alias("route_file"), "properties")
    r = r.withColumn("method", F.coalesce(prop("http_method"), F.lit(""))).withColumn("path", F.coalesce(prop("path"), F.lit("")))
    if method is not None:
        r = r.where(F.lower("method") == method.lower())
    side = {"h": ("HANDLES_ROUTE", True), "q": ("ACCEPTS_DTO", False), "s": ("RETURNS_DTO", False)}
    for tag, (type_, inbound) in side.items():
        found = first_neighbour(edges, nodes, type_, inbound)
        r = r.join(found.select("at", *[F.col(c).alias(f"{tag}_{c}") for c in ("name", "qualified_name", "file_path")]), "at", "left")
    given, linked = prop("method_name"), F.col("h_name").isNotNull()
    derived = F.element_at(F.split("route_qn", r"\."), -1)
    file_path = F.when(linked & (F.coalesce("h_file_path", F.lit("")) != ""), F.col("h_file_path")).otherwise(F.col("route_file"))
    out = r.select(
        "project", F.col("at").alias("route_id"), "method", "path", F.coalesce("h_name", given, derived).alias("handler"), F.coalesce("h_qualified_name", "route_qn").alias("handler_qn"), file_path.alias("file_path"),
        F.coalesce("q_name", prop("request_dto_type")).alias("request_dto"), F.coalesce("s_name", prop("response_dto_type")).alias("response_dto"), F.when(linked, 1.0).when(given.isNotNull(), 0.7).otherwise(0.5).alias("confidence"), "route_file",
    )
    if hashes is not None:
        live = hashes.where("not coalesce(is_deleted, false)").select("project", F.col("rel_path").alias("file_path")).distinct().withColumn("live", F.lit(True))
        out = out.join(live, ["project", "file_path"], "left").where("live or file_path = ''").drop("live")
    score = F.lit(1.0)
    if scope is not None:
        score = F.greatest(*[C.scope_score(scope, F.col(c)) for c in ("path", "file_path", "handler", "route_file")])
    return out.withColumn("score", score).where("score is not null").drop("route_file")


def layer_of(path: Column, name: Column, properties: Column | None = None) -> Column:
    """The layer of a symbol on the way of a request: as its properties say, else by the words of its path and name."""
    p, n = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    ends = lambda *words: reduce(lambda a, b: a | b, [n.endswith(w) for w in words])
    out = F.when(C.any_of(p, ("lambda", "/handlers/", "\\handlers\\", "serverless")), "handler")
    out = out.when(C.any_of(p, ("controller", "/api/")) | ends("controller", "resource"), "controller").when(C.any_of(p, ("service", "usecase")) | ends("service"), "service")
    out = out.when(C.any_of(p, ("repo", "dao", "/store/")) | ends("repository", "repo"), "repository").when(F.contains(p, F.lit("dto")) | ends("dto", "request", "response"), "dto").otherwise("unknown")
    if properties is None:
        return out
    said = F.get_json_object(properties, "$.layer")
    known = F.when(said.isin("controller", "handler", "service", "repository", "config"), said).when(said.isin("dto", "entity", "model"), "dto").otherwise("unknown")
    return F.when(said.isNotNull(), known).otherwise(out)


def path_score(paths: Column) -> Column:
    """The score of a flow path from the file paths of its steps.

    With two or more steps of known rank that never go back: 0.7 and 0.05 for each, at most 0.95; otherwise 0.5 and 0.03 a
    step, at most 0.7; a single step has 0.5.
    """
    known = F.filter(F.transform(paths, C.flow_rank), lambda x: x.isNotNull())
    rising = F.forall(F.sequence(F.lit(2), F.size(known)), lambda i: F.element_at(known, i) >= F.element_at(known, i - 1))
    chain = 0.5 + F.least(F.size(paths) * 0.03, F.lit(0.2))
    return F.when(F.size(paths) < 2, F.lit(0.5)).when((F.size(known) >= 2) & rising, 0.7 + F.least(F.size(known) * 0.05, F.lit(0.25))).otherwise(chain)


def path_pattern(paths: Column) -> Column:
    """The names of the ranks a path passes, repeats in a row left out."""
    names = F.create_map(*[F.lit(x) for pair in fixed.RANK_NAMES.items() for x in pair])
    known = F.filter(F.transform(paths, C.flow_rank), lambda x: x.isNotNull())
    kept = F.filter(known, lambda x, i: (i == 0) | (x != F.element_at(known, F.greatest(i, F.lit(1)))))
    return F.array_join(F.transform(kept, lambda x: names[x]), ">")


def scored_paths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, flow: str = "any", depth: int = 5, target: DataFrame | None = None) -> DataFrame:
    """(source, last, path, steps, score): the best path from each seed to each node it reaches within ``depth`` steps.

    Of the simple paths to one node the best score counts, then the shortest, then the least ids. With ``target`` (id) only
    paths that end there. A step's file path is joined once to the steps of all paths.
    """
    used = edges.where(F.col("type").isin(*FLOWS[flow])) if flow in FLOWS else edges
    found = G.paths(used, seeds, depth)
    if target is not None:
        found = found.join(target.select(F.col("id").alias("goal")), F.element_at("path", -1) == F.col("goal"), "left_semi")
    files = nodes.select(F.col("id").alias("step"), F.coalesce("file_path", F.lit("")).alias("file"))
    steps = found.select("path", F.posexplode("path").alias("at", "step")).join(files, "step").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "file"))).alias("s"))
    scored = steps.select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("last"), "path", (F.size("path") - 1).alias("steps"), F.round(path_score(F.transform("s", lambda x: x["file"])), 4).alias("score"))
    best = W.partitionBy("source", "last").orderBy(F.desc("score"), "steps", "path")
    return scored.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def backend_flow(nodes: DataFrame, edges: DataFrame, routes: DataFrame, depth: int = 5) -> DataFrame:
    """(route_id, id, depth, layer): what each route's request passes: the handler, and what it calls within ``depth``.

    All routes are walked together, one join a level for the pairs of route and newly reached node.
    """
    from graphloom.plans.lineage import SharedTables

    tables = SharedTables(edges.sparkSession, "backend")
    first = edges.where("type = 'HANDLES_ROUTE'").groupBy(F.col("target_id").alias("route_id")).agg(F.min_by("source_id", "id").alias("handler_id"))
    start = routes.select("route_id").distinct().join(first, "route_id", "left").select("route_id", F.coalesce("handler_id", "route_id").alias("id"), F.lit(0).alias("depth"))
    hop = edges.where(F.col("type").isin("CALLS", "ASYNC_CALLS")).select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct()
    levels = [tables.put(start)]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("route_id", "id")
        new = levels[-1].join(hop, "id").select("route_id", F.col("to").alias("id")).distinct().join(seen, ["route_id", "id"], "left_anti")
        level, n = tables.counted(new.withColumn("depth", F.lit(d)))
        if not n:
            break
        levels.append(level)
    n = nodes.select("id", layer_of(F.col("file_path"), F.col("name"), F.col("properties")).alias("layer"), F.col("label").alias("__label"))
    return reduce(DataFrame.unionByName, levels).join(n, "id").select("route_id", "id", "depth", F.when(F.col("__label") == "Route", "route").otherwise(F.col("layer")).alias("layer"))


def flow_summary(flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, flow_type, confidence, validations) of each backend flow.

    The confidence goes by how many of the four layers are passed: three give 0.95, two 0.75, one 0.55; none or all four
    0.3. Validations are called symbols whose name tells of one.
    """
    has = lambda layer: F.max((F.col("layer") == layer).cast("int")) == 1
    order = ("controller", "handler", "service", "repository")
    called = F.lower("name")
    checks = (F.col("depth") > 0) & C.any_of(called, ("valid", "guard", "check"))
    named = flow.join(nodes.select("id", "name"), "id")
    by = named.groupBy("route_id").agg(*[has(x).alias(x) for x in order], F.count_if(checks).alias("validations"))
    found = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in order]))
    n = F.size(found)
    return by.select("route_id", F.when(n == 0, "unknown").otherwise(F.array_join(found, "-")).alias("flow_type"), F.when(n == 3, 0.95).when(n == 2, 0.75).when(n == 1, 0.55).otherwise(0.3).alias("confidence"), "validations")


def frontend_flow(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(id, depth): what components reach by rendering, injecting, selecting and calling."""
    return G.frontier(edges.where(F.col("type").isin(*FRONTEND)), seeds, depth)
