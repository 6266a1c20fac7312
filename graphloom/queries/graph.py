"""Queries over nodes and edges: patterns, filters, joins, aggregates and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.functions import columns as C
from graphloom.plans import cypher
from graphloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (nodes, edges) under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(table(spark, d, "nodes"), table(spark, d, "edges"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pattern(name: str, text: str, sql: str) -> None:
    """Register a path pattern."""
    QUERIES[name] = lambda spark, d: cypher.run(text, table(spark, d, "nodes"), table(spark, d, "edges"))
    ORACLES[name] = sql


pattern(
    "j1_pattern_calls", "MATCH (a:Method)-[r:CALLS]->(b:Function) WHERE a.name STARTS WITH 're' RETURN a.qualified_name AS caller, b.qualified_name AS callee",
    "SELECT DISTINCT s.id, t.id AS tid, s.qualified_name AS caller, t.qualified_name AS callee FROM edges e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id WHERE e.type = 'CALLS' AND s.label = 'Method' AND t.label = 'Function' AND s.name ILIKE 're%'",
)
ORACLES["j1_pattern_calls"] = f"SELECT caller, callee FROM ({ORACLES['j1_pattern_calls']})"
pattern(
    "j1_pattern_two_hops", "MATCH (f:File)-[:IMPORTS]->(g)<-[:CONTAINS]-(d:Folder) WHERE d.name <> 'src' AND NOT f.name CONTAINS 'test' RETURN d.qualified_name AS folder, COUNT(*) AS n",
    "SELECT d.qualified_name AS folder, count(*) AS n FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'IMPORTS') i JOIN nodes f ON f.id = i.source_id AND f.label = 'File' JOIN nodes g ON g.id = i.target_id JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CONTAINS') c ON c.target_id = g.id JOIN nodes d ON d.id = c.source_id AND d.label = 'Folder' WHERE d.name <> 'src' AND NOT contains(lower(f.name), 'test') GROUP BY 1",
)
pattern(
    "fp_pattern_conditions", "MATCH (n) WHERE (n.label IN ['Class', 'Interface'] AND n.start_line >= 20) OR (n.label = 'Enum' AND n.name ENDS WITH 't') RETURN n.id AS id, n.label AS label, n.name AS name",
    "SELECT id, label, name FROM nodes WHERE (label IN ('Class', 'Interface') AND start_line >= 20) OR (label = 'Enum' AND lower(name) LIKE '%t')",
)
pattern("a2_pattern_count", "MATCH (n:Function) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM nodes WHERE label = 'Function'")
pattern("a2_pattern_count_groups", "MATCH (n) RETURN n.project AS project, n.label AS label, COUNT(n) AS n", "SELECT project, label, count(*) AS n FROM nodes GROUP BY ALL")
pattern(
    "t1_pattern_top", "MATCH (n:Class) RETURN n.qualified_name AS qn, n.end_line AS last ORDER BY last DESC, qn LIMIT 10",
    "SELECT qualified_name AS qn, end_line AS last FROM nodes WHERE label = 'Class' ORDER BY last DESC, qn LIMIT 10",
)


@query("SELECT id, label, name, qualified_name FROM nodes WHERE project = 'meridian-core'")
def sc7_project_nodes(nodes, edges):
    return nodes.where("project = 'meridian-core'").select("id", "label", "name", "qualified_name")


@query("SELECT source_id, target_id, type, min(id) AS id FROM edges GROUP BY ALL")
def sc9_first_edges(nodes, edges):
    return G.unique_edges(edges).select("source_id", "target_id", "type", "id")


@query("SELECT id, source_id, target_id, type FROM edges WHERE NOT starts_with(type, 'I')")
def sc15_edges_without_prefix(nodes, edges):
    return edges.where(~F.col("type").startswith("I")).select("id", "source_id", "target_id", "type")


@query("SELECT project, file_path, id, name, start_line FROM nodes WHERE label NOT IN ('File', 'Folder', 'Project') AND file_path IS NOT NULL")
def sc25_symbols_by_file(nodes, edges):
    return nodes.where(~F.col("label").isin("File", "Folder", "Project") & F.col("file_path").isNotNull()).select("project", "file_path", "id", "name", "start_line")


@query("SELECT project, qualified_name, label FROM nodes WHERE label IN ('Module', 'Package', 'Folder', 'Project')")
def sc26_containers(nodes, edges):
    return nodes.where(F.col("label").isin("Module", "Package", "Folder", "Project")).select("project", "qualified_name", "label")


@query("SELECT id, name FROM nodes WHERE (contains(lower(name), 'core') OR contains(lower(qualified_name), 'core')) AND (contains(lower(name), 'batch') OR contains(lower(qualified_name), 'batch'))")
def fp6_multi_token_search(nodes, edges):
    return nodes.where(S.matches("core batch")).select("id", "name")


@query("SELECT id, name FROM nodes WHERE label = 'Class' AND (contains(lower(name), 'ledger') OR contains(lower(qualified_name), 'ledger'))")
def fp7_label_search(nodes, edges):
    return nodes.where(S.matches("ledger") & (F.col("label") == "Class")).select("id", "name")


@query("SELECT id, qualified_name FROM nodes WHERE qualified_name = 'index' OR ends_with(qualified_name, '.index')")
def fp8_suffix(nodes, edges):
    return nodes.where(S.suffix_of("index")).select("id", "qualified_name")


@query("SELECT id, name FROM nodes WHERE json_extract_string(properties, '$.language') = 'rust' AND TRY_CAST(json_extract_string(properties, '$.line_count') AS BIGINT) >= 100")
def fp11_metadata_filter(nodes, edges):
    return nodes.where((F.get_json_object("properties", "$.language") == "rust") & (F.expr("try_cast(get_json_object(properties, '$.line_count') as bigint)") >= 100)).select("id", "name")


@query("SELECT id, file_path, start_line FROM nodes WHERE regexp_matches(file_path, '^[^/]*/lib/') AND label NOT IN ('Folder', 'Project')")
def fp12_directory(nodes, edges):
    return nodes.where(F.col("file_path").rlike("^[^/]*/lib/") & ~F.col("label").isin("Folder", "Project")).select("id", "file_path", "start_line")


@query("SELECT e.id, e.type, s.qualified_name AS source, t.qualified_name AS target FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE contains(lower(e.properties), 'a') OR e.properties IS NULL")
def j1_edges_with_ends(nodes, edges):
    return G.with_ends(edges, nodes).where("properties is null or contains(lower(properties), 'a')").select("id", "type", F.col("s_qualified_name").alias("source"), F.col("t_qualified_name").alias("target"))


@query("""
WITH u AS (SELECT DISTINCT source_id, target_id, type FROM edges), c AS (SELECT id FROM nodes WHERE label = 'Class')
SELECT 'out' AS way, u.source_id AS id, u.target_id AS other, u.type FROM u JOIN c ON c.id = u.source_id
UNION ALL SELECT 'in', u.target_id, u.source_id, u.type FROM u JOIN c ON c.id = u.target_id""")
def j2_one_hop(nodes, edges):
    u, c = G.unique_edges(edges), nodes.where("label = 'Class'").select("id")
    out = u.drop("id").join(c, F.col("source_id") == F.col("id")).select(F.lit("out").alias("way"), "id", F.col("target_id").alias("other"), "type")
    return out.unionByName(u.drop("id").join(c, F.col("target_id") == F.col("id")).select(F.lit("in").alias("way"), "id", F.col("source_id").alias("other"), "type"))


@query("SELECT t.qualified_name AS target, e.type, count(*) AS n, count(DISTINCT e.source_id) AS sources FROM edges e JOIN nodes t ON t.id = e.target_id WHERE t.label IN ('Function', 'Method') GROUP BY ALL")
def j3_incoming_references(nodes, edges):
    t = nodes.where(F.col("label").isin("Function", "Method")).select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"))
    return edges.join(t, "target_id").groupBy("target", "type").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@query("SELECT e.id FROM edges e SEMI JOIN (SELECT id FROM nodes WHERE label <> 'File') a ON a.id = e.source_id SEMI JOIN (SELECT id FROM nodes WHERE label <> 'File') b ON b.id = e.target_id")
def j8_visible_edges(nodes, edges):
    shown = nodes.where("label <> 'File'").select(F.col("id").alias("v"))
    return edges.join(shown, F.col("source_id") == F.col("v"), "left_semi").join(shown, F.col("target_id") == F.col("v"), "left_semi").select("id")


@query("SELECT n.id, n.qualified_name FROM nodes n ANTI JOIN (SELECT source_id FROM edges WHERE type = 'CONTAINS') e ON e.source_id = n.id WHERE n.label IN ('Folder', 'Class', 'Interface')")
def j9_empty_containers(nodes, edges):
    holds = edges.where("type = 'CONTAINS'").select("source_id")
    return nodes.where(F.col("label").isin("Folder", "Class", "Interface")).join(holds, F.col("id") == F.col("source_id"), "left_anti").select("id", "qualified_name")


@query("""
WITH s AS (SELECT id, project, file_path, start_line, end_line FROM nodes WHERE label IN ('Class', 'Interface', 'Impl', 'Function', 'Method') AND start_line <= end_line AND start_line >= 0),
sites AS (SELECT id AS site, project, file_path, start_line + 1 AS line FROM nodes WHERE label IN ('Function', 'Method') AND file_path IS NOT NULL)
SELECT a.site, arg_max(s.id, s.start_line::BIGINT * 100000000 - s.id) FILTER (WHERE a.line BETWEEN s.start_line AND s.end_line) AS span_id
FROM sites a LEFT JOIN s ON s.project = a.project AND s.file_path = a.file_path GROUP BY a.site""")
def j6_enclosing(nodes, edges):
    key = F.concat_ws("|", "project", "file_path").alias("file")
    spans = nodes.where(F.col("label").isin("Class", "Interface", "Impl", "Function", "Method")).select(key, "id", "start_line", "end_line")
    sites = nodes.where(F.col("label").isin("Function", "Method") & F.col("file_path").isNotNull()).select(key, F.col("id").alias("site"), (F.col("start_line") + 1).alias("line"))
    return G.enclosing(sites, spans).select("site", "span_id")


@query("""
SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.project = b.project AND a.file_path = b.file_path AND a.start_line <= b.end_line AND a.end_line >= b.start_line
WHERE a.label IN ('Class', 'Impl') AND b.label IN ('Function', 'Method')""")
def j7_overlaps(nodes, edges):
    key = F.concat_ws("|", "project", "file_path").alias("file")
    spans = lambda *labels: nodes.where(F.col("label").isin(*labels) & F.col("project").isNotNull() & F.col("file_path").isNotNull()).select(key, "id", "start_line", "end_line")
    return G.overlapping(spans("Class", "Impl"), spans("Function", "Method"))


@query("SELECT 'label' AS what, label AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY ALL")
def a1_histograms(nodes, edges):
    return nodes.groupBy(F.lit("label").alias("what"), F.col("label").alias("value")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("type").alias("what"), F.col("type").alias("value")).agg(F.count("*").alias("n")))


@query("SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target_id, 1, 0 FROM edges) GROUP BY id")
def a3_degrees(nodes, edges):
    return G.degrees(edges)


@query("""
WITH d AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM (SELECT DISTINCT source_id, target_id, type FROM edges) UNION ALL SELECT target_id, 1, 0 FROM (SELECT DISTINCT source_id, target_id, type FROM edges)) GROUP BY id),
m AS (SELECT max(fan_in + fan_out) AS m FROM d)
SELECT n.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, round(coalesce(fan_in + fan_out, 0) / m.m, 3) AS centrality FROM nodes n LEFT JOIN d ON d.id = n.id, m""")
def ep25_enrichment(nodes, edges):
    d = G.degrees(G.unique_edges(edges))
    top = d.agg(F.max(F.col("fan_in") + F.col("fan_out")).alias("m"))
    return nodes.select("id").join(d, "id", "left").join(F.broadcast(top)).select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.round(F.coalesce(F.col("fan_in") + F.col("fan_out"), F.lit(0)) / F.col("m"), 3).alias("centrality"))


@query("""
SELECT n.project, n.file_path, count(DISTINCT n.id) AS symbols, count(e.id) FILTER (WHERE e.source_id = n.id) AS n_out, count(e.id) FILTER (WHERE e.target_id = n.id) AS n_in
FROM nodes n LEFT JOIN (SELECT id, source_id AS node, source_id, target_id FROM edges UNION ALL SELECT id, target_id, source_id, target_id FROM edges WHERE source_id <> target_id) e ON e.node = n.id
WHERE n.file_path IS NOT NULL GROUP BY ALL""")
def a4_file_diagnostics(nodes, edges):
    d = G.degrees(edges)
    return nodes.where("file_path is not null").join(d, "id", "left").groupBy("project", "file_path").agg(F.count("*").alias("symbols"), F.coalesce(F.sum("fan_out"), F.lit(0)).alias("n_out"), F.coalesce(F.sum("fan_in"), F.lit(0)).alias("n_in"))


@query("SELECT project, json_extract_string(properties, '$.language') AS language, count(*) AS n FROM nodes WHERE label = 'File' GROUP BY ALL")
def a6_languages(nodes, edges):
    return nodes.where("label = 'File'").groupBy("project", F.get_json_object("properties", "$.language").alias("language")).agg(F.count("*").alias("n"))


def _layer_sql(path: str) -> str:
    from graphloom.functions import fixed

    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({path}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in fixed.LAYERS) + " END"


@query(f"""
WITH f AS (SELECT DISTINCT project, file_path, coalesce({_layer_sql('file_path')}, 'other') AS layer FROM nodes WHERE file_path IS NOT NULL AND file_path <> '')
SELECT project, layer, count(*) AS files, array_to_string(list_sort(list(file_path))[1:10], ',') AS first_files FROM f GROUP BY ALL""")
def a13_layers(nodes, edges):
    # the ten first files of each layer are ranked before they are gathered, so no task holds a whole layer
    f = nodes.where("file_path is not null and file_path <> ''").select("project", "file_path").distinct().withColumn("layer", F.coalesce(C.layer(F.col("file_path")), F.lit("other")))
    first = G.top_per_group(f, ["project", "layer"], ["file_path"], 10).groupBy("project", "layer").agg(F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("first_files"))
    return f.groupBy("project", "layer").agg(F.count("*").alias("files")).join(first, ["project", "layer"])


@query("SELECT s.project AS project, s.file_path AS source_file, t.file_path AS target_file, count(*) AS weight, array_to_string(list_sort(list_distinct(list(e.type))), ',') AS types FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.file_path <> t.file_path GROUP BY ALL")
def a16_file_links(nodes, edges):
    e = G.with_ends(edges, nodes, ("project", "file_path")).where("s_file_path <> t_file_path")
    return e.groupBy(F.col("s_project").alias("project"), F.col("s_file_path").alias("source_file"), F.col("t_file_path").alias("target_file")).agg(F.count("*").alias("weight"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


@query("""
SELECT qualified_name, name, tier, round(score, 6) AS score FROM (
  SELECT *, tier - CASE WHEN regexp_matches(lower(file_path), '/test/|/tests/|\\.test\\.|\\.spec\\.|_test\\.') THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(lower(file_path), 'mock|fixture|fake|stub') THEN 0.3::DOUBLE ELSE 0 END AS score FROM (
    SELECT *, (CASE WHEN qualified_name = 'batch' THEN 1.0 WHEN name = 'batch' THEN 0.9 WHEN ends_with(qualified_name, '.batch') THEN 0.7 WHEN contains(lower(name), 'batch') OR contains(lower(qualified_name), 'batch') THEN 0.4 END)::DOUBLE AS tier FROM nodes))
WHERE tier IS NOT NULL AND score >= 0.3 ORDER BY score DESC, qualified_name, id LIMIT 25""")
def t7_ranked_symbols(nodes, edges):
    return S.ranked_symbols(nodes.withColumn("file_path", F.coalesce("file_path", F.lit(""))), "batch", 25).select("qualified_name", "name", "tier", F.round("score", 6).alias("score"))


ORACLES["t7_ranked_symbols"] = ORACLES["t7_ranked_symbols"].replace("lower(file_path)", "lower(coalesce(file_path, ''))")


@query("""
WITH x AS (SELECT id, 0 AS layer FROM nodes WHERE name = 'ledger' UNION ALL SELECT id, 1 FROM nodes WHERE contains(lower(name), 'ledger') UNION ALL SELECT id, 2 FROM nodes WHERE contains(lower(properties), 'ledger'))
SELECT id, min(layer)::INT AS layer FROM x GROUP BY id ORDER BY 2, 1 LIMIT 50""")
def t6_layered_search(nodes, edges):
    has = lambda c: F.contains(F.lower(c), F.lit("ledger"))
    return S.layered([nodes.where(c).select("id") for c in (F.col("name") == "ledger", has("name"), has("properties"))], "id", 50).select("id", "layer")


_CALLS = "SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CALLS'"


@query(f"""
WITH RECURSIVE c AS ({_CALLS}),
r AS (SELECT id, 0 AS depth FROM nodes WHERE label = 'Function' AND starts_with(name, 'render') UNION SELECT c.target_id, r.depth + 1 FROM r JOIN c ON c.source_id = r.id WHERE r.depth < 4)
SELECT id, min(depth)::INT AS depth FROM r GROUP BY id""")
def g1_trace_calls(nodes, edges):
    return G.frontier(edges.where("type = 'CALLS'"), nodes.where("label = 'Function' and startswith(name, 'render')"), 4)


def _impact(nodes, edges):
    hit = G.frontier(edges, nodes.where("label = 'Interface'"), 3, reverse=True).where("depth > 0").join(nodes.select("id", "project", "file_path"), "id")
    by = hit.groupBy("project").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.count_distinct("file_path").alias("files"))
    return by.withColumn("risk", F.when((F.col("direct") > 10) | (F.col("files") > 10), "high").when(F.col("direct") > 3, "medium").otherwise("low"))


@query("""
WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges),
r AS (SELECT id, 0 AS depth FROM nodes WHERE label = 'Interface' UNION SELECT c.source_id, r.depth + 1 FROM r JOIN c ON c.target_id = r.id WHERE r.depth < 3),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT n.project, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect, count(DISTINCT n.file_path) AS files,
  CASE WHEN count(*) FILTER (WHERE depth = 1) > 10 OR count(DISTINCT n.file_path) > 10 THEN 'high' WHEN count(*) FILTER (WHERE depth = 1) > 3 THEN 'medium' ELSE 'low' END AS risk
FROM m JOIN nodes n ON n.id = m.id WHERE depth > 0 GROUP BY n.project""")
def g2_impact(nodes, edges):
    """Impact of all interfaces over all edge types."""
    return _impact(nodes, edges)


#: Edge types of each flow; "any" follows all.
FLOWS = {"request": ("CALLS", "ASYNC_CALLS", "HTTP_CALLS", "HANDLES_ROUTE"), "render": ("RENDERS", "CALLS"), "data": ("CALLS", "ASYNC_CALLS", "IMPORTS", "USES")}
#: Steps of a flow path.
FLOW_STEPS = 5


def flow_paths(nodes, edges, flow: str = "any"):
    """(path, steps): every simple path of 1 to FLOW_STEPS steps from any node over the edges of a flow type."""
    p = G.paths(edges.where(F.col("type").isin(*FLOWS[flow])) if flow in FLOWS else edges, nodes, FLOW_STEPS)
    return p.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), (F.size("path") - 1).alias("steps"))


@query("""
WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS', 'IMPORTS', 'USES')),
r AS (SELECT [id] AS path FROM nodes UNION ALL SELECT list_append(r.path, c.target_id) FROM r JOIN c ON c.source_id = r.path[-1] WHERE len(r.path) <= 5 AND NOT list_contains(r.path, c.target_id))
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS steps FROM r WHERE len(path) > 1""")
def g3_data_flow_paths(nodes, edges):
    return flow_paths(nodes, edges, "data")


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE type = 'INHERITS'), n AS (SELECT a AS id FROM d UNION SELECT b FROM d),
reach AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON d.a = r.b), bad AS (SELECT a AS id FROM reach WHERE a = b),
stuck AS (SELECT id FROM bad UNION SELECT r.a FROM reach r JOIN bad ON bad.id = r.b),
l AS (SELECT id, 0 AS level FROM n ANTI JOIN stuck USING (id) UNION SELECT d.a, l.level + 1 FROM l JOIN d ON d.b = l.id ANTI JOIN stuck s ON s.id = d.a)
SELECT id, max(level)::INT AS level FROM l GROUP BY id UNION ALL SELECT id, -1 FROM stuck""")
def g6_topological_levels(nodes, edges):
    return G.levels(edges.where("type = 'INHERITS'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("""
WITH u AS (SELECT DISTINCT source_id, target_id, type FROM edges),
x AS (SELECT 'out' AS way, source_id AS id, type, target_id AS other FROM u UNION ALL SELECT 'in', target_id, type, source_id FROM u),
r AS (SELECT x.*, n.qualified_name AS qn, row_number() OVER (PARTITION BY x.id, x.way, x.type ORDER BY n.qualified_name, n.id) AS rn FROM x JOIN nodes n ON n.id = x.other JOIN nodes m ON m.id = x.id WHERE m.label = 'Class')
SELECT id, way, type, qn, rn FROM r WHERE rn <= 10""")
def g8_symbol_details(nodes, edges):
    u = G.unique_edges(edges)
    both = u.select(F.explode(F.array(F.struct(F.lit("out").alias("way"), F.col("source_id").alias("id"), F.col("target_id").alias("other"), "type"), F.struct(F.lit("in").alias("way"), F.col("target_id").alias("id"), F.col("source_id").alias("other"), "type"))).alias("x")).select("x.*")
    kept = both.join(nodes.where("label = 'Class'").select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other"), F.col("qualified_name").alias("qn")), "other")
    from pyspark.sql import Window as W

    return kept.withColumn("rn", F.row_number().over(W.partitionBy("id", "way", "type").orderBy("qn", "other"))).where("rn <= 10").select("id", "way", "type", "qn", "rn")


@query("""
WITH RECURSIVE l AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type = 'INHERITS' UNION SELECT target_id, source_id FROM edges WHERE type = 'INHERITS'),
r AS (SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
SELECT id, min(other) AS component FROM r GROUP BY id""")
def g9_components(nodes, edges):
    return G.components(edges.where("type = 'INHERITS'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("""
WITH k AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('CALLS', 'HTTP_CALLS', 'ASYNC_CALLS', 'USES')),
x AS (SELECT k.target_id AS id, 'caller' AS side, n.name FROM k JOIN nodes n ON n.id = k.source_id UNION SELECT k.source_id, 'callee', n.name FROM k JOIN nodes n ON n.id = k.target_id)
SELECT id, side, name FROM x""")
def g10_neighbour_names(nodes, edges):
    k = edges.where(F.col("type").isin("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "USES")).select("source_id", "target_id").distinct()
    n = nodes.select(F.col("id").alias("nid"), "name")
    a = k.join(n, F.col("source_id") == F.col("nid")).select(F.col("target_id").alias("id"), F.lit("caller").alias("side"), "name")
    return a.unionByName(k.join(n, F.col("target_id") == F.col("nid")).select(F.col("source_id").alias("id"), F.lit("callee").alias("side"), "name")).distinct()


@query("""
SELECT e.source_id, e.target_id, CASE WHEN regexp_matches(lower(t.qualified_name), 'requests|axios|httpx|aiohttp|urllib|superagent|node-fetch|undici|got|fetch|http\\.client|reqwest|hyper|surf') THEN 'HTTP_CALLS'
  WHEN regexp_matches(lower(t.qualified_name), 'kafka|amqp|rabbitmq|redis|celery|bull|nats|pulsar|lapin|rdkafka') THEN 'ASYNC_CALLS' WHEN regexp_matches(lower(t.qualified_name), 'dotenv|config|viper|configparser|pydantic_settings|figment|envy') THEN 'CONFIGURES' ELSE 'CALLS' END AS kind
FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CALLS') e JOIN nodes t ON t.id = e.target_id""")
def ep8_service_patterns(nodes, edges):
    calls = edges.where("type = 'CALLS'").select("source_id", "target_id").distinct()
    return calls.join(nodes.select(F.col("id").alias("target_id"), "qualified_name"), "target_id").select("source_id", "target_id", C.service_kind(F.col("qualified_name")).alias("kind"))


@query("""
WITH l AS (SELECT DISTINCT e.source_id, e.target_id, s.project AS sp, t.project AS tp FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.label IN ('Class', 'Interface') AND t.label IN ('Class', 'Interface')),
x AS (SELECT a.name, a.project AS pa, b.project AS pb, a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.name = b.name AND a.project < b.project AND a.label IN ('Class', 'Interface') AND b.label = a.label)
SELECT pa, pb, count(*) AS shared, count(DISTINCT name) AS names FROM x GROUP BY ALL""")
def ep26_shared_types(nodes, edges):
    # names are counted per project before projects meet, so a name held by very many types isn't expanded pairwise
    t = nodes.where(F.col("label").isin("Class", "Interface")).groupBy("name", "label", "project").agg(F.count("*").alias("n"))
    b = t.select("name", "label", F.col("project").alias("pb"), F.col("n").alias("nb"))
    return t.join(b, ["name", "label"]).where("project < pb").groupBy(F.col("project").alias("pa"), "pb").agg(F.sum(F.col("n") * F.col("nb")).alias("shared"), F.count_distinct("name").alias("names"))


@query("""
WITH refs AS (SELECT DISTINCT regexp_extract(qualified_name, '[^.]+\\.[^.]+$') AS ref FROM nodes WHERE label IN ('Method', 'Function')),
last AS (SELECT regexp_extract(qualified_name, '[^.]*$') AS l, count(*) AS n, min(id) AS id FROM nodes GROUP BY 1)
SELECT r.ref, coalesce(e.id, l.id) AS id FROM refs r LEFT JOIN (SELECT qualified_name, min(id) AS id FROM nodes GROUP BY 1) e ON e.qualified_name = r.ref
LEFT JOIN last l ON l.n = 1 AND l.l = regexp_extract(r.ref, '[^.]*$') WHERE coalesce(e.id, l.id) IS NOT NULL""")
def ep36_name_resolution(nodes, edges):
    refs = nodes.where(F.col("label").isin("Method", "Function")).select(F.regexp_extract("qualified_name", r"[^.]+\.[^.]+$", 0).alias("ref"))
    return G.qualified_matches(refs, nodes)


@query("SELECT s.project, s.name AS source, t.name AS target, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.type = 'TESTS' GROUP BY ALL")
def ep23_tests(nodes, edges):
    return G.with_ends(edges.where("type = 'TESTS'"), nodes, ("project", "name")).groupBy(F.col("s_project").alias("project"), F.col("s_name").alias("source"), F.col("t_name").alias("target")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT s.project, s.name AS sn, t.name AS tn FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.type = 'TESTS'),
first AS (SELECT project, name, min(id) AS id FROM nodes GROUP BY ALL)
SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM t JOIN first a ON a.project = t.project AND a.name = t.sn JOIN first b ON b.project = t.project AND b.name = t.tn""")
def sc21_ingest_traces(nodes, edges):
    t = G.with_ends(edges.where("type = 'TESTS'"), nodes, ("project", "name")).select(F.col("s_project").alias("project"), "s_name", "t_name").distinct()
    first = nodes.groupBy("project", "name").agg(F.min("id").alias("nid"))
    a, b = first.select("project", F.col("name").alias("s_name"), F.col("nid").alias("source_id")), first.select("project", F.col("name").alias("t_name"), F.col("nid").alias("target_id"))
    return t.join(a, ["project", "s_name"]).join(b, ["project", "t_name"]).select("source_id", "target_id").distinct()


@query("SELECT label, count(*) FILTER (WHERE file_path IS NULL OR file_path = '') AS without_file, count(*) FILTER (WHERE properties IS NULL OR properties = '{}') AS without_properties, count(*) FILTER (WHERE start_line > end_line) AS bad_range FROM nodes GROUP BY label")
def sv10_index_diagnostics(nodes, edges):
    return nodes.groupBy("label").agg(F.count_if(F.col("file_path").isNull() | (F.col("file_path") == "")).alias("without_file"), F.count_if(F.col("properties").isNull() | (F.col("properties") == "{}")).alias("without_properties"), F.count_if(F.col("start_line") > F.col("end_line")).alias("bad_range"))
