"""Queries of routes, flows, navigation, pipelines, the usage log and project lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import fixed
from graphloom.operators import flows as L
from graphloom.operators import graph as G
from graphloom.operators import navigation as V
from graphloom.operators import similarity as M
from graphloom.plans.lineage import SharedTables
from graphloom.queries.samples import SAMPLES, Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(rules, holds) -> str:
    """The rules as a CASE without its END; ``holds`` gives the SQL of one word."""
    return "CASE " + " ".join("WHEN " + " OR ".join(holds(w) for w in words) + f" THEN '{name}'" for name, words in rules)


def _scope_sql(field: str, scope: str) -> str:
    bare, mine = "".join(c for c in scope if c not in "-_./{}"), [p for p in "".join(" " if c in "-_./" else c for c in scope).split() if p]
    parts = f"list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace({field}, '(\\p{{Lu}})', ' \\1', 'g'), '[-_./]', ' ', 'g')), ' '), lambda x: x <> ''))"
    met = f"len(list_intersect({parts}, [{', '.join(repr(m) for m in mine)}]))::DOUBLE"
    near = f"{met} / (len({parts}) + {len(mine)} - {met})"
    return f"CASE WHEN contains(lower({field}), '{scope}') THEN 1.0::DOUBLE WHEN contains(lower(regexp_replace({field}, '[-_./{{}}]', '', 'g')), '{bare}') THEN 0.8::DOUBLE WHEN {near} > 0.3 THEN {near} * 0.6 END"


_ROUTES = """
h AS (SELECT target_id AS at, arg_min(source_id, id) AS o FROM edges WHERE type = 'HANDLES_ROUTE' GROUP BY 1), q AS (SELECT source_id AS at, arg_min(target_id, id) AS o FROM edges WHERE type = 'ACCEPTS_DTO' GROUP BY 1),
s AS (SELECT source_id AS at, arg_min(target_id, id) AS o FROM edges WHERE type = 'RETURNS_DTO' GROUP BY 1), live AS (SELECT DISTINCT project, rel_path FROM file_hashes WHERE NOT coalesce(is_deleted, false)),
x AS (SELECT r.project, r.id AS route_id, coalesce(json_extract_string(r.properties, '$.http_method'), '') AS method, coalesce(json_extract_string(r.properties, '$.path'), '') AS path,
  coalesce(hn.name, json_extract_string(r.properties, '$.method_name'), string_split(r.qualified_name, '.')[-1]) AS handler, coalesce(nullif(hn.file_path, ''), r.file_path, '') AS file_path,
  coalesce(qn.name, json_extract_string(r.properties, '$.request_dto_type')) AS request_dto, coalesce(sn.name, json_extract_string(r.properties, '$.response_dto_type')) AS response_dto,
  CASE WHEN hn.id IS NOT NULL THEN 1.0 WHEN json_extract_string(r.properties, '$.method_name') IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, r.file_path AS route_file
  FROM nodes r LEFT JOIN h ON h.at = r.id LEFT JOIN nodes hn ON hn.id = h.o LEFT JOIN q ON q.at = r.id LEFT JOIN nodes qn ON qn.id = q.o LEFT JOIN s ON s.at = r.id LEFT JOIN nodes sn ON sn.id = s.o WHERE r.label = 'Route')
"""


@R.sample("nodes", "edges", "file_hashes", sql=f"WITH {_ROUTES} SELECT x.* EXCLUDE (route_file) FROM x WHERE file_path = '' OR EXISTS (SELECT 1 FROM live WHERE live.project = x.project AND live.rel_path = x.file_path)")
def rt1_find_routes(nodes, edges, hashes):
    return L.find_routes(nodes, edges, hashes).drop("handler_qn", "score")


@R.sample("nodes", "edges", "file_hashes", sql=f"WITH {_ROUTES} SELECT route_id, round(score, 6) AS score FROM (SELECT route_id, greatest({', '.join(_scope_sql(f, 'user-controller') for f in ('path', 'file_path', 'handler', 'route_file'))}) AS score FROM x WHERE lower(method) = 'get') WHERE score IS NOT NULL")
def rt1_scoped_routes(nodes, edges, hashes):
    return L.find_routes(nodes, edges, None, method="GET", scope="user-controller").select("route_id", F.round("score", 6).alias("score"))


@R.sample("nodes", "edges", sql="WITH f AS (SELECT target_id AS at, arg_min(source_id, id) AS o FROM edges WHERE type = 'HANDLES_ROUTE' GROUP BY 1) SELECT f.at, n.name, n.qualified_name, n.file_path FROM f JOIN nodes n ON n.id = f.o")
def j15_route_handlers(nodes, edges):
    return L.first_neighbour(edges, nodes, "HANDLES_ROUTE", True)


_LAYER = """CASE WHEN json_extract_string({p}, '$.layer') IS NOT NULL THEN CASE WHEN json_extract_string({p}, '$.layer') IN ('controller', 'handler', 'service', 'repository', 'config') THEN json_extract_string({p}, '$.layer') WHEN json_extract_string({p}, '$.layer') IN ('dto', 'entity', 'model') THEN 'dto' ELSE 'unknown' END
  WHEN regexp_matches(lower(coalesce({f}, '')), 'lambda|/handlers/|serverless') THEN 'handler' WHEN regexp_matches(lower(coalesce({f}, '')), 'controller|/api/') OR regexp_matches(lower({n}), '(controller|resource)$') THEN 'controller'
  WHEN regexp_matches(lower(coalesce({f}, '')), 'service|usecase') OR regexp_matches(lower({n}), 'service$') THEN 'service' WHEN regexp_matches(lower(coalesce({f}, '')), 'repo|dao|/store/') OR regexp_matches(lower({n}), '(repository|repo)$') THEN 'repository'
  WHEN contains(lower(coalesce({f}, '')), 'dto') OR regexp_matches(lower({n}), '(dto|request|response)$') THEN 'dto' ELSE 'unknown' END"""
_BACKEND = f"""
WITH RECURSIVE r AS (SELECT id AS route_id FROM nodes WHERE label = 'Route'), h AS (SELECT target_id AS at, arg_min(source_id, id) AS o FROM edges WHERE type = 'HANDLES_ROUTE' GROUP BY 1),
c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS')),
w AS (SELECT route_id, coalesce(h.o, route_id) AS id, 0 AS depth FROM r LEFT JOIN h ON h.at = r.route_id UNION SELECT w.route_id, c.target_id, w.depth + 1 FROM w JOIN c ON c.source_id = w.id WHERE w.depth < 5),
f AS (SELECT w.route_id, w.id, min(w.depth)::INT AS depth, CASE WHEN any_value(n.label) = 'Route' THEN 'route' ELSE any_value({_LAYER.format(p='n.properties', f='n.file_path', n='n.name')}) END AS layer, any_value(n.name) AS name FROM w JOIN nodes n ON n.id = w.id GROUP BY 1, 2)
"""


def _routes(nodes):
    return nodes.where("label = 'Route'").select(F.col("id").alias("route_id"))


@R.sample("nodes", "edges", sql=_BACKEND + "SELECT route_id, id, depth, layer FROM f")
def g4_backend_flow(nodes, edges):
    return L.backend_flow(nodes, edges, _routes(nodes))


@R.sample("nodes", "edges", sql=_BACKEND + """, g AS (SELECT route_id, list_filter(['controller', 'handler', 'service', 'repository'], lambda l: list_contains(list(layer), l)) AS found, count(*) FILTER (WHERE depth > 0 AND regexp_matches(lower(name), 'valid|guard|check')) AS validations FROM f GROUP BY route_id)
SELECT route_id, CASE WHEN len(found) = 0 THEN 'unknown' ELSE array_to_string(found, '-') END AS flow_type, CASE len(found) WHEN 3 THEN 0.95 WHEN 2 THEN 0.75 WHEN 1 THEN 0.55 ELSE 0.3 END::DOUBLE AS confidence, validations FROM g""")
def g4_flow_summary(nodes, edges):
    return L.flow_summary(L.backend_flow(nodes, edges, _routes(nodes)), nodes)


@R.sample("nodes", "edges", sql="""
WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('RENDERS', 'INJECTS', 'SELECTS', 'CALLS')),
w AS (SELECT id, 0 AS depth FROM nodes WHERE label = 'Class' AND name LIKE '%Component' UNION SELECT c.target_id, w.depth + 1 FROM w JOIN c ON c.source_id = w.id WHERE w.depth < 4) SELECT id, min(depth)::INT AS depth FROM w GROUP BY id""")
def g5_frontend_flow(nodes, edges):
    return L.frontend_flow(edges, nodes.where("label = 'Class' and endswith(name, 'Component')"))


_RANK = "CASE " + " ".join(f"WHEN contains(lower(coalesce(file_path, '')), '{w}') THEN {r}" for w, r in fixed.FLOW_RANKS) + " END"
_PATHS = f"""
WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN {{types}}), k AS (SELECT id, {_RANK} AS rk FROM nodes),
w AS (SELECT [id] AS path FROM ({{seeds}}) UNION ALL SELECT list_append(w.path, c.target_id) FROM w JOIN c ON c.source_id = w.path[-1] WHERE len(w.path) <= {{depth}} AND NOT list_contains(w.path, c.target_id)),
p AS (SELECT path, unnest(path) AS step, unnest(generate_series(1, len(path))) AS pos FROM w WHERE len(path) > 1), q AS (SELECT path, list(rk ORDER BY pos) FILTER (WHERE rk IS NOT NULL) AS ranks FROM p JOIN k ON k.id = p.step GROUP BY path),
s AS (SELECT path, round(CASE WHEN len(coalesce(ranks, [])) >= 2 AND list_sort(ranks) = ranks THEN 0.7 + least(len(ranks) * 0.05, 0.25) ELSE 0.5 + least(len(path) * 0.03, 0.2) END, 4)::DOUBLE AS score FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY score DESC, len(path), path) AS rn FROM s)
SELECT path[1] AS source, path[-1] AS last, array_to_string(path, '>') AS path, len(path)::INT - 1 AS steps, score FROM t WHERE rn = 1
"""


def _shown(paths):
    return paths.select("source", "last", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "steps", "score")


@R.sample("nodes", "edges", sql=_PATHS.format(types="('CALLS', 'ASYNC_CALLS', 'HTTP_CALLS', 'HANDLES_ROUTE')", seeds="SELECT id FROM nodes", depth=5))
def g3_scored_request_paths(nodes, edges):
    return _shown(L.scored_paths(nodes, edges, nodes, "request"))


@R.whole("nodes", "edges", sql=_PATHS.format(types="('CALLS', 'ASYNC_CALLS', 'IMPORTS', 'USES')", seeds="SELECT id FROM nodes WHERE label IN ('Interface', 'Enum', 'File')", depth=2))
def g3_scored_data_paths(nodes, edges):
    return _shown(L.scored_paths(nodes, edges, nodes.where("label in ('Interface', 'Enum', 'File')"), "data", 2))


@R.whole("nodes", sql=f"SELECT layer, count(*) AS n FROM (SELECT {_LAYER.format(p='properties', f='file_path', n='name')} AS layer FROM nodes) GROUP BY layer")
def sv8_flow_layers(nodes):
    return nodes.groupBy(L.layer_of(F.col("file_path"), F.col("name"), F.col("properties")).alias("layer")).agg(F.count("*").alias("n"))


@R.whole("ts_symbols", sql=f"""
SELECT DISTINCT symbol_id, coalesce(list_filter(list_transform(coalesce(decorators, []), lambda a: {_case(fixed.SPRING_ANNOTATIONS, lambda w: f"regexp_extract(a, '^@?([A-Za-z0-9_]*)', 1) = '{w}'")} END), lambda x: x IS NOT NULL)[1],
  {_case(fixed.SPRING_SUFFIXES, lambda w: f"ends_with(lower(name), '{w}')")} END, {_case(fixed.SPRING_FOLDERS, lambda w: f"contains(lower(file_path), '{w}')")} END) AS spring,
  coalesce({_case(fixed.GO_FOLDERS, lambda w: f"contains('/' || lower(file_path), '{w}')")} END, {_case(fixed.GO_SUFFIXES, lambda w: f"ends_with(lower(name), '{w}')")} END) AS go FROM ts_symbols""")
def ep37_layers(symbols):
    name, path = F.col("name"), F.col("file_path")
    return symbols.select("symbol_id", C.spring_layer(name, F.col("decorators"), path).alias("spring"), C.go_layer(name, path).alias("go")).distinct()


_SIGNED = [(1, "UserThing", ["Entity"], "x.java"), (2, "UserResource", None, "x.java"), (3, "x", ["@Cached", "@Service"], "a/repo/x.java"), (4, "x", [], "a/domain/x.java"), (5, "x", [], "x.java"), (6, "OrderValidator", ["Other"], "a/api/x")]


@R.expected("id bigint, layer string", [(1, "entity"), (2, "controller"), (3, "service"), (4, "entity"), (5, None), (6, "validator")], symbols=("id bigint, name string, annotations array<string>, path string", _SIGNED))
def ep37_spring_layer_cases(symbols):
    return symbols.select("id", C.spring_layer(F.col("name"), F.col("annotations"), F.col("path")).alias("layer"))


@R.whole("ts_symbols", sql="SELECT DISTINCT symbol_id, CASE WHEN starts_with(name, 'Test') AND length(name) > 4 THEN 'test' WHEN starts_with(name, 'Benchmark') AND length(name) > 9 THEN 'benchmark' WHEN starts_with(name, 'Example') THEN 'example' END AS kind FROM ts_symbols WHERE language = 'go'")
def ex26_go_test_kinds(symbols):
    return symbols.where("language = 'go'").select("symbol_id", C.go_test_kind(F.col("name")).alias("kind")).distinct()


_IMPORTS = [("fmt", True, None), ("net/http", True, "net/http"), ("github.com/gin-gonic/gin", False, "gin"), ("github.com/labstack/echo/v4", False, "echo"), ("github.com/go-chi/chi", False, "chi"), ("github.com/gofiber/fiber/v2", False, "fiber"), ("github.com/gorilla/mux", False, "gorilla"), ("github.com/onsi/gomega", False, "ginkgo"), ("own", True, None), ("own/pkg", False, None)]


@R.expected("path string, standard boolean, framework string", _IMPORTS, imports=("path string", [(p,) for p, _, _ in _IMPORTS]))
def ex26_go_imports(imports):
    return imports.select("path", C.go_standard(F.col("path")).alias("standard"), C.go_framework(F.col("path")).alias("framework"))


_CALLED = [("GET", "GET"), ("Post", "POST"), ("Any", "ANY"), ("Handle", None), ("OPTIONS", "OPTIONS")]


@R.expected("call string, method string", _CALLED, calls=("call string", [(c,) for c, _ in _CALLED]))
def ex26_go_verbs(calls):
    return calls.select("call", C.go_verb(F.col("call")).alias("method"))


_HOLDS = lambda *w: "regexp_matches(said, '" + "|".join(w) + "')"
_ENTRY = f"""
WITH n AS (SELECT *, lower(name) AS nm, lower(coalesce(file_path, '')) AS fp, coalesce(properties, '{{}}') AS said FROM nodes WHERE label NOT IN {_in(V.NO_SYMBOLS)}),
a AS (SELECT *, {_HOLDS('RestController')} AS rest, {_HOLDS('Controller')} AND NOT {_HOLDS('ControllerAdvice')} AND NOT {_HOLDS('RestController')} AS ctl, {_HOLDS('(Get|Post|Put|Patch|Delete|Request)Mapping')} AS map, regexp_matches(fp, 'controller|/api/') AS api, regexp_matches(fp, 'route|handler') AS way, nm IN {_in(fixed.BOOTSTRAP_NAMES)} AS boot, label = 'Route' AS rt FROM n),
p AS (SELECT *, CASE WHEN rest THEN 40 WHEN ctl THEN 35 ELSE 0 END + CASE WHEN map THEN 30 ELSE 0 END - CASE WHEN {_HOLDS('"Test"', '@Test')} OR starts_with(nm, 'test') THEN 40 ELSE 0 END - CASE WHEN {_HOLDS('Configuration')} THEN 25 ELSE 0 END - CASE WHEN {_HOLDS('ExceptionHandler', 'ControllerAdvice')} THEN 25 ELSE 0 END
  + CASE WHEN rt THEN 35 ELSE 0 END + CASE WHEN api THEN 20 WHEN way THEN 15 ELSE 0 END - CASE WHEN regexp_matches(fp, '/test/|/tests/|\\.test\\.|\\.spec\\.') THEN 30 ELSE 0 END + CASE WHEN boot THEN 25 ELSE 0 END AS points FROM a)
SELECT project, qualified_name, label, coalesce(nullif(array_to_string(list_filter([CASE WHEN rest THEN '@RestController' WHEN ctl THEN '@Controller' END, CASE WHEN map THEN 'HTTP mapping' END, CASE WHEN api THEN 'controller/api package' WHEN way THEN 'route/handler path' END, CASE WHEN boot THEN 'bootstrap-style name' END, CASE WHEN rt THEN 'Route node' END], lambda x: x IS NOT NULL), ', '), ''), 'matched entry pattern') AS reason, round(least(points / 100.0, 1.0), 2)::DOUBLE AS score FROM p WHERE points > 0"""


@R.sample("nodes", sql=_ENTRY)
def sv1_entry_point_reasons(nodes):
    return V.entry_points(nodes)


@R.whole("nodes", sql=_ENTRY)
def sv1_entry_points(nodes):
    return V.entry_points(nodes)


@R.sample("nodes", sql=_ENTRY + " AND (nm = 'main' OR contains(nm, 'command') OR contains(fp, 'cli'))")
def sv1_command_lines(nodes):
    return V.entry_points(nodes, "cli")


def _reads_sql(goal: str, origin: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {'target_id' if back else 'source_id'} AS origin, {'source_id' if back else 'target_id'} AS other, {i} AS rank, '{way}' AS way, {V.READ_SCORES[way].get(goal, V.READ_SCORES[way][''])}::DOUBLE AS score FROM edges WHERE type IN {_in(types)}{' ' if len(types) > 1 else ' '}"
        for i, (way, types, back) in enumerate(V.READ_WAYS)
    )
    return f"WITH f AS ({each.replace(',)', ')')}), o AS ({origin}), x AS (SELECT f.origin, n.qualified_name, way, score, row_number() OVER (PARTITION BY f.origin, n.qualified_name ORDER BY rank) AS rn FROM f JOIN nodes n ON n.id = f.other WHERE f.origin IN (SELECT id FROM o)) SELECT origin, qualified_name, way, score FROM x WHERE rn = 1"


@R.sample("nodes", "edges", sql=_reads_sql("debug", "SELECT id FROM nodes"))
def sv2_next_reads(nodes, edges):
    return V.next_reads(nodes, edges, nodes, "debug")


@R.whole("nodes", "edges", sql=_reads_sql("understand", "SELECT id FROM nodes WHERE label IN ('Class', 'Interface')"))
def sv2_next_reads_of_types(nodes, edges):
    return V.next_reads(nodes, edges, nodes.where("label in ('Class', 'Interface')"))


@R.whole("nodes", "edges", sql=f"""
WITH o AS (SELECT * FROM nodes WHERE file_path IS NOT NULL AND file_path <> ''), s AS (SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY start_line, name, id) AS rn FROM o WHERE label NOT IN {_in(V.NO_SYMBOLS)}),
a AS (SELECT project, file_path, array_to_string(list(name ORDER BY rn) FILTER (WHERE rn <= 10), ',') AS symbols, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT o.project, o.file_path, e.type, e.target_id FROM edges e JOIN o ON o.id = e.source_id),
t AS (SELECT project, file_path, array_to_string(list_sort(list(type || ':' || n)), ',') AS types FROM (SELECT project, file_path, type, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL),
i AS (SELECT e.project, e.file_path, count(DISTINCT o.file_path) AS n FROM e JOIN o ON o.id = e.target_id WHERE e.type = 'IMPORTS' AND o.file_path <> e.file_path GROUP BY ALL)
SELECT f.project, f.file_path, coalesce(a.symbols, '') AS symbols, coalesce(a.n, 0) AS n_symbols, coalesce(i.n, 0) AS imports, coalesce(t.types, '') AS edge_types FROM (SELECT DISTINCT project, file_path FROM o) f LEFT JOIN a USING (project, file_path) LEFT JOIN t USING (project, file_path) LEFT JOIN i USING (project, file_path)""")
def sv3_file_overview(nodes, edges):
    return V.file_overview(nodes, edges)


_TESTED = [(p, f) for p, f in [("p", "src/a.ts"), ("p", "src/a.test.ts"), ("p", "tests/a.ts"), ("p", "test/a.test.ts"), ("p", "src/__tests__/a.ts"), ("p", "src/b.ts"), ("q", "a.spec.go"), ("q", "a.go"), ("q", "x/test_b.py"), ("q", "x/b.py"), ("q", None)]]
_TEST_ROWS = [
    ("p", "src/a.ts", "src/a.test.ts", 0.95), ("p", "src/a.ts", "tests/a.ts", 0.95), ("p", "src/a.ts", "test/a.test.ts", 0.95), ("p", "src/a.ts", "src/__tests__/a.ts", 0.95), ("p", "src/b.ts", "src/a.test.ts", 0.8), ("p", "src/a.test.ts", "src/a.test.ts", 0.8), ("q", "a.go", "a.spec.go", 0.95), ("q", "x/b.py", "x/test_b.py", 0.8), ("q", "x/test_b.py", "x/test_b.py", 0.8),
    ("p", "src/__tests__/a.ts", "src/__tests__/a.ts", 0.8), ("p", "test/a.test.ts", "test/a.test.ts", 0.8), ("p", "src/a.test.ts", "test/a.test.ts", 0.95),
]


@R.expected("project string, file_path string, test_path string, score double", [*_TEST_ROWS], files=("project string, file_path string", _TESTED))
def sv4_test_file_tiers(files):
    return V.test_files(files).drop("reason")


@R.sample("nodes", "edges", sql="""
WITH g AS (SELECT n.project, max((label = 'Route' AND json_extract_string(properties, '$.source') IS NULL)::INT) AS plain, max((label = 'File' AND lower(json_extract_string(properties, '$.language')) IN ('java', 'kotlin'))::INT) AS java, list(json_extract_string(properties, '$.source')) FILTER (WHERE label = 'Route') AS src, list(json_extract_string(properties, '$.framework')) AS fw FROM nodes n GROUP BY 1),
a AS (SELECT DISTINCT project FROM edges WHERE type IN ('SELECTS', 'INJECTS'))
SELECT g.project, array_to_string(list_filter([CASE WHEN plain = 1 AND java = 1 THEN 'Spring Boot' END, CASE WHEN list_contains(src, 'nextjs') THEN 'Next.js' END, CASE WHEN list_contains(src, 'lambda') THEN 'AWS Lambda' END, CASE WHEN list_contains(src, 'serverless') THEN 'Serverless' END, CASE WHEN list_contains(src, 'express') THEN 'Express' END, CASE WHEN a.project IS NOT NULL THEN 'Angular' END], lambda x: x IS NOT NULL), ',') AS frameworks,
  array_to_string(list_filter([CASE WHEN list_contains(fw, 'react') THEN 'React' END, CASE WHEN list_contains(fw, 'solid') THEN 'Solid.js' END, CASE WHEN list_contains(fw, 'vue') THEN 'Vue' END], lambda x: x IS NOT NULL), ',') AS libraries FROM g LEFT JOIN a ON a.project = g.project""")
def sv9_frameworks(nodes, edges):
    return V.frameworks(nodes, edges)


@R.sample("nodes", sql="SELECT DISTINCT project, json_extract_string(properties, '$.source') AS source FROM nodes WHERE label = 'Route'")
def a7_route_sources(nodes):
    return nodes.where("label = 'Route'").select("project", L.prop("source").alias("source")).distinct()


# the usage log
@R.sample("tool_calls", sql="SELECT 'source' AS what, source AS value, count(*) AS calls FROM tool_calls GROUP BY ALL UNION ALL SELECT 'agent', coalesce(agent_name, 'unknown'), count(*) FROM tool_calls WHERE source = 'mcp' GROUP BY ALL UNION ALL SELECT 'model', coalesce(model_name, 'unknown'), count(*) FROM tool_calls WHERE source = 'mcp' GROUP BY ALL")
def a9_calls_by_source_agent_model(calls):
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    each = [(calls, "source", F.col("source")), (calls.where("source = 'mcp'"), "agent", unknown("agent_name")), (calls.where("source = 'mcp'"), "model", unknown("model_name"))]
    first, *rest = [df.groupBy(F.lit(what).alias("what"), value.alias("value")).agg(F.count("*").alias("calls")) for df, what, value in each]
    return first.unionByName(rest[0]).unionByName(rest[1])


@R.sample("tool_calls", sql="SELECT coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(response_bytes), 0)::BIGINT AS response_bytes FROM tool_calls WHERE source = 'mcp'")
def a10_token_sums(calls):
    return calls.where("source = 'mcp'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "response_bytes")])


_COSTS = "CASE tool_name " + " ".join(f"WHEN '{t}' THEN {c}" for c, tools in fixed.TOOL_COSTS.items() for t in tools) + f" ELSE {fixed.OTHER_TOOL_COST} END"
_SAVED = f"SELECT used, greatest(w, used) AS without, greatest(w, used) - used AS saved FROM (SELECT count(*) * 50 + coalesce(sum(response_bytes), 0)::BIGINT // 4 AS used, coalesce(sum({_COSTS}), 0)::BIGINT AS w FROM tool_calls WHERE source = 'mcp')"


def _saved(calls):
    cost = F.lit(fixed.OTHER_TOOL_COST)
    for price, tools in fixed.TOOL_COSTS.items():
        cost = F.when(F.col("tool_name").isin(*tools), price).otherwise(cost)
    x = calls.where("source = 'mcp'").agg((F.count("*") * 50 + F.expr("coalesce(sum(response_bytes), 0) div 4")).alias("used"), F.coalesce(F.sum(cost), F.lit(0)).alias("w"))
    return x.select("used", F.greatest("w", "used").alias("without"), (F.greatest("w", "used") - F.col("used")).alias("saved"))


@R.sample("tool_calls", sql=_SAVED)
def a11_savings_by_tool(calls):
    return _saved(calls)


@R.sample("tool_calls", sql=f"WITH m AS (SELECT tool_name, count(*) AS n, avg(duration_ms) AS d FROM tool_calls GROUP BY 1), s AS ({_SAVED}) SELECT round(sum(n * d) / sum(n), 4) AS mean_ms, (SELECT round(100.0 * saved / without, 1) FROM s)::DOUBLE AS saved_percent FROM m")
def a12_usage_means(calls):
    by = calls.groupBy("tool_name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("d"))
    return by.agg(F.round(F.sum(F.col("n") * F.col("d")) / F.sum("n"), 4).alias("mean_ms")).join(_saved(calls).select(F.round(100 * F.col("saved") / F.col("without"), 1).alias("saved_percent")))


@R.sample("tool_calls", sql="SELECT id, tool_name, coalesce(request_body, '') AS request_body, coalesce(response_body, '') AS response_body FROM tool_calls WHERE id = 4")
def a18_call_detail(calls):
    return calls.where("id = 4").select("id", "tool_name", F.coalesce("request_body", F.lit("")).alias("request_body"), F.coalesce("response_body", F.lit("")).alias("response_body"))


@R.sample("tool_calls", sql="SELECT id, strlen(coalesce(response_body, '')) // 4 AS output_estimate, NOT contains(coalesce(response_body, ''), '\"error\"') AS succeeded, coalesce(input_tokens, strlen(tool_name) // 4 + 50) AS input_tokens FROM tool_calls")
def tk1_token_estimates(calls):
    body = F.coalesce("response_body", F.lit(""))
    return calls.select("id", V.estimated_tokens(body).alias("output_estimate"), (~F.contains(body, F.lit('"error"'))).alias("succeeded"), F.coalesce("input_tokens", V.estimated_tokens(F.col("tool_name")) + 50).alias("input_tokens"))


@R.sample("tool_calls", sql="SELECT id, coalesce(agent_name, 'session-' || source, 'unknown') AS agent, coalesce(model_name, 'unknown') AS model, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens FROM tool_calls")
def tk2_call_context(calls):
    return calls.select("id", F.coalesce("agent_name", F.concat(F.lit("session-"), "source"), F.lit("unknown")).alias("agent"), F.coalesce("model_name", F.lit("unknown")).alias("model"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])


@R.whole("nodes", "edges", sql="""
SELECT t.id, s.file_path, count(*) AS n, array_to_string(list_sort(list(s.name || ':' || e.type)), ',') AS "references" FROM (SELECT DISTINCT source_id, target_id, type FROM edges) e JOIN nodes t ON t.id = e.target_id AND t.label = 'Interface' JOIN nodes s ON s.id = e.source_id GROUP BY ALL""")
def a14_references_by_file(nodes, edges):
    e = edges.select("source_id", "target_id", "type").distinct().join(nodes.where("label = 'Interface'").select(F.col("id").alias("target_id")), "target_id")
    s = nodes.select(F.col("id").alias("source_id"), "file_path", "name")
    return e.join(s, "source_id").groupBy(F.col("target_id").alias("id"), "file_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "type"))), ",").alias("references"))


@R.whole("nodes", "edges", sql="""
WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges), r AS (SELECT id, 0 AS depth FROM nodes WHERE label = 'Enum' UNION SELECT c.source_id, r.depth + 1 FROM r JOIN c ON c.target_id = r.id WHERE r.depth < 3), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0),
x AS (SELECT count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect, count(DISTINCT n.project || '|' || n.file_path) AS files, count(DISTINCT split_part(n.file_path, '/', 1)) AS modules, count(DISTINCT n.project) - 1 AS cross_projects FROM m JOIN nodes n ON n.id = m.id)
SELECT *, CASE WHEN cross_projects > 0 OR direct > 10 OR files > 10 THEN 'high' WHEN direct > 3 THEN 'medium' ELSE 'low' END AS risk FROM x""")
def a15_impact_summary(nodes, edges):
    hit = G.frontier(edges, nodes.where("label = 'Enum'"), 3, reverse=True).where("depth > 0").join(nodes.select("id", "project", "file_path"), "id")
    x = hit.agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.count_distinct(F.concat("project", F.lit("|"), "file_path")).alias("files"), F.count_distinct(F.split("file_path", "/")[0]).alias("modules"), (F.count_distinct("project") - 1).alias("cross_projects")
    )
    return x.withColumn("risk", F.when((F.col("cross_projects") > 0) | (F.col("direct") > 10) | (F.col("files") > 10), "high").when(F.col("direct") > 3, "medium").otherwise("low"))


@R.whole("nodes", "edges", sql="""
SELECT file_path, 'label' AS what, label AS value, count(*) AS n FROM nodes WHERE file_path IS NOT NULL GROUP BY ALL UNION ALL SELECT n.file_path, 'out', e.type, count(*) FROM edges e JOIN nodes n ON n.id = e.source_id WHERE n.file_path IS NOT NULL GROUP BY ALL UNION ALL SELECT n.file_path, 'in', e.type, count(*) FROM edges e JOIN nodes n ON n.id = e.target_id WHERE n.file_path IS NOT NULL GROUP BY ALL""")
def a4_type_counts(nodes, edges):
    own = nodes.where("file_path is not null")
    labels = own.groupBy("file_path", F.lit("label").alias("what"), F.col("label").alias("value")).agg(F.count("*").alias("n"))
    for what, end in (("out", "source_id"), ("in", "target_id")):
        labels = labels.unionByName(edges.join(own.select(F.col("id").alias(end), "file_path"), end).groupBy("file_path", F.lit(what).alias("what"), F.col("type").alias("value")).agg(F.count("*").alias("n")))
    return labels


# limits, orders and unions of tools
def _neighbours_sql(first: bool) -> str:
    kept = "" if first else "WHERE type IN ('CALLS')"
    return f"SELECT source_id AS id, target_id AS other, type FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM edges {kept}) WHERE rn <= 2 {'AND type = ' + repr('CALLS') if first else ''}"


@R.whole("nodes", "edges", sql=_neighbours_sql(False))
def t5_filter_then_limit(nodes, edges):
    return V.neighbours(nodes, edges, ("CALLS",), 2)


@R.whole("nodes", "edges", sql=_neighbours_sql(True))
def t5_limit_then_filter(nodes, edges):
    return V.neighbours(nodes, edges, ("CALLS",), 2, limit_first=True)


@R.sample("nodes", "project_links", sql="SELECT n.project, n.qualified_name, CASE WHEN n.project = 'web' THEN 'own' ELSE 'linked' END AS origin FROM nodes n WHERE contains(lower(n.name), 'user') AND (n.project = 'web' OR n.project IN (SELECT target_project FROM project_links WHERE source_project = 'web')) ORDER BY n.project <> 'web', n.project, n.qualified_name LIMIT 8")
def t10_linked_search(nodes, links):
    seen = links.where("source_project = 'web'").select(F.col("target_project").alias("project")).distinct().withColumn("origin", F.lit("linked"))
    found = nodes.where(F.contains(F.lower("name"), F.lit("user")))
    both = found.where("project = 'web'").withColumn("origin", F.lit("own")).select("project", "qualified_name", "origin").unionByName(found.join(seen, "project").select("project", "qualified_name", "origin"))
    return both.orderBy(F.col("origin") != "own", "project", "qualified_name").limit(8)


@R.whole("nodes", "edges", sql="WITH d AS (SELECT id, count(*) AS size FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) SELECT n.id, coalesce(d.size, 0) AS size FROM nodes n LEFT JOIN d ON d.id = n.id ORDER BY 2 DESC, 1 LIMIT 500")
def t11_layout_nodes(nodes, edges):
    d = G.degrees(edges).select("id", (F.col("fan_in") + F.col("fan_out")).alias("size"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("size", F.lit(0)).alias("size")).orderBy(F.desc("size"), "id").limit(500)


_LAYER_ORDER = ("controllers", "components", "services", "repositories", "models")


@R.whole("nodes", sql=f"""
WITH f AS (SELECT DISTINCT project, file_path, coalesce({_case(fixed.LAYERS, lambda w: f"contains(lower(file_path), '{w}')")} END, 'other') AS layer FROM nodes WHERE file_path <> ''), g AS (SELECT layer, count(*) AS files FROM f GROUP BY layer)
SELECT layer, files, row_number() OVER (ORDER BY coalesce(list_position([{', '.join(repr(x) for x in _LAYER_ORDER)}], layer), 99), layer) AS place FROM g""")
def t12_layers_in_order(nodes):
    f = nodes.where("file_path <> ''").select("project", "file_path").distinct().groupBy(F.coalesce(C.layer(F.col("file_path")), F.lit("other")).alias("layer")).agg(F.count("*").alias("files"))
    rank = F.lit(99)
    for i, name in enumerate(_LAYER_ORDER, 1):
        rank = F.when(F.col("layer") == name, i).otherwise(rank)
    return f.withColumn("place", F.row_number().over(W.orderBy(rank, "layer")).cast("bigint"))  # as many rows as layers


@R.sample("projects", "project_links", sql="""
WITH l AS (SELECT p, count(DISTINCT o) AS links FROM (SELECT source_project AS p, target_project AS o FROM project_links UNION SELECT target_project, source_project FROM project_links) GROUP BY p)
SELECT name, coalesce(links, 0) AS links, row_number() OVER (ORDER BY coalesce(links, 0) > 0 DESC, coalesce(links, 0) DESC, name) AS place FROM projects LEFT JOIN l ON l.p = name""")
def t13_project_order(projects, links):
    both = links.select(F.col("source_project").alias("name"), F.col("target_project").alias("o")).unionByName(links.select(F.col("target_project").alias("name"), F.col("source_project").alias("o"))).distinct()
    each = projects.select("name").join(both.groupBy("name").agg(F.count("*").alias("links")), "name", "left").select("name", F.coalesce("links", F.lit(0)).alias("links"))
    return each.withColumn("place", F.row_number().over(W.orderBy((F.col("links") > 0).desc(), F.desc("links"), "name")).cast("bigint"))


@R.sample("project_links", sql="SELECT DISTINCT least(source_project, target_project) AS a, greatest(source_project, target_project) AS b FROM project_links")
def t14_undirected_links(links):
    return links.select(F.least("source_project", "target_project").alias("a"), F.greatest("source_project", "target_project").alias("b")).distinct()


@R.sample("projects", "project_links", sql="""
WITH RECURSIVE l AS (SELECT source_project AS a, target_project AS b FROM project_links UNION SELECT target_project, source_project FROM project_links), r AS (SELECT name AS p, name AS o FROM projects UNION SELECT r.p, l.b FROM r JOIN l ON l.a = r.o)
SELECT p AS project, min(o) AS component FROM r GROUP BY p""")
def g9_project_components(projects, links):
    """Components of linked projects; a project without links is one of its own."""
    found = G.components(links.select(F.col("source_project").alias("a"), F.col("target_project").alias("b")))
    return projects.select(F.col("name").alias("project")).join(found.withColumnRenamed("id", "project"), "project", "left").select("project", F.coalesce("component", "project").alias("component"))


@R.whole("nodes", "file_hashes", sql="""
WITH live AS (SELECT project, rel_path FROM (SELECT project, rel_path, arg_max(coalesce(is_deleted, false), observed_at) AS gone FROM file_hashes GROUP BY ALL) WHERE NOT gone)
SELECT n.id, l.rel_path IS NOT NULL AS "exists" FROM nodes n LEFT JOIN live l ON l.project = n.project AND l.rel_path = n.file_path""")
def pj5_existence(nodes, hashes):
    live = hashes.groupBy("project", F.col("rel_path").alias("file_path")).agg(F.max_by(F.coalesce("is_deleted", F.lit(False)), "observed_at").alias("gone")).where("not gone").select("project", "file_path", F.lit(True).alias("e"))
    return nodes.select("id", "project", "file_path").join(live, ["project", "file_path"], "left").select("id", F.coalesce("e", F.lit(False)).alias("exists"))


@R.sample("nodes", sql="WITH r AS (SELECT name FROM nodes WHERE label = 'Class' ORDER BY name LIMIT 4) SELECT list(name ORDER BY name)::VARCHAR[] IS NOT NULL AS has_rows, count(*) AS count, count(*) = 4 AS has_more FROM r")
def pj6_envelope(nodes):
    rows = nodes.where("label = 'Class'").select("name").orderBy("name").limit(4)
    return rows.agg((F.size(F.collect_list("name")) > 0).alias("has_rows"), F.count("*").alias("count"), (F.count("*") == 4).alias("has_more"))


@R.whole("nodes", "edges", sql="""
WITH v AS (SELECT id FROM nodes ORDER BY id LIMIT 5000), e AS (SELECT id, source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v) ORDER BY id LIMIT 15000) SELECT * FROM e""")
def pj7_canvas_edges(nodes, edges):
    """The edges that a canvas of at most 5,000 nodes shows, at most three for each."""
    shown = nodes.select("id").orderBy("id").limit(5000)
    a, b = shown.select(F.col("id").alias("source_id")), shown.select(F.col("id").alias("target_id"))
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi").select("id", "source_id", "target_id", "type").orderBy("id").limit(15000)


@R.sample("nodes", "edges", sql="""
WITH p AS (SELECT project, coalesce(json_extract_string(properties, '$.pipeline_name'), name) AS pipeline, json_extract_string(properties, '$.ci_system') AS ci_system, file_path FROM nodes WHERE label = 'Pipeline'),
s AS (SELECT project, json_extract_string(properties, '$.pipeline_name') AS pipeline, array_to_string(list(name ORDER BY json_extract_string(properties, '$.order')::INT, name), ',') AS stages FROM nodes WHERE label = 'Stage' GROUP BY ALL),
d AS (SELECT e.source_id AS job, array_to_string(list_sort(list(DISTINCT n.name)), '+') AS needs FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'DEPENDS_ON' GROUP BY 1),
j AS (SELECT project, json_extract_string(properties, '$.pipeline_name') AS pipeline, array_to_string(list_sort(list(name || '@' || json_extract_string(properties, '$.stage') || coalesce('<' || needs, ''))), ',') AS jobs FROM nodes LEFT JOIN d ON d.job = id WHERE label = 'Job' GROUP BY ALL)
SELECT p.*, s.stages, j.jobs FROM p LEFT JOIN s USING (project, pipeline) LEFT JOIN j USING (project, pipeline)""")
def g7_pipelines(nodes, edges):
    return V.pipelines(nodes, edges)


@R.sample("nodes", "edges", "project_links", sql="""
WITH x AS (SELECT project, file_path, name, json_extract_string(properties, '$.ci_system') AS ci_system, CASE WHEN project = 'web' THEN 0 ELSE 1 END AS via FROM nodes WHERE label = 'Pipeline' AND (project = 'web' OR project IN (SELECT target_project FROM project_links WHERE source_project = 'web')))
SELECT ci_system, file_path, name AS pipeline, arg_min(project, via) AS project FROM x GROUP BY ALL""")
def g11_linked_pipelines(nodes, edges, links):
    return V.over_links(V.pipelines(nodes, edges), links, "web", ["ci_system", "file_path", "pipeline"]).select("ci_system", "file_path", "pipeline", "project")


@R.sample("nodes", "edges", sql="""
WITH RECURSIVE d AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type = 'DEPENDS_ON'), n AS (SELECT a AS id FROM d UNION SELECT b FROM d), l AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT a FROM d) UNION SELECT d.a, l.level + 1 FROM l JOIN d ON d.b = l.id)
SELECT id, max(level)::INT AS level FROM l GROUP BY id""")
def g6_job_order(nodes, edges):
    return G.levels(edges.where("type = 'DEPENDS_ON'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@R.sample("nodes", sql="SELECT project, name, json_extract_string(properties, '$.resource_type') AS resource_type, json_extract_string(properties, '$.infra_type') AS kind, file_path FROM nodes WHERE label = 'Infra' AND json_extract_string(properties, '$.infra_type') = 'kubernetes'")
def in1_infrastructure(nodes):
    return V.infrastructure(nodes, "kubernetes")


@R.sample("nodes", "project_links", sql="""
WITH x AS (SELECT project, name, json_extract_string(properties, '$.infra_type') AS kind, file_path, CASE WHEN project = 'web' THEN 0 ELSE 1 END AS via FROM nodes WHERE label = 'Infra' AND (project = 'web' OR project IN (SELECT target_project FROM project_links WHERE source_project = 'web'))) SELECT name, kind, file_path, arg_min(project, via) AS project FROM x GROUP BY ALL""")
def in1_linked_infrastructure(nodes, links):
    return V.over_links(V.infrastructure(nodes), links, "web", ["kind", "name", "file_path"]).select("name", "kind", "file_path", "project")


# MinHash
_MASKED = M.MASKED.replace("'", "''")
_SIGS = f"""
s AS (SELECT symbol_id, list_distinct(list_filter(string_split_regex(regexp_replace(body_text, '{_MASKED}', ' ', 'g'), '{M.SEPARATORS}'), lambda t: t <> '')) AS t FROM (SELECT DISTINCT symbol_id, body_text FROM ts_symbols WHERE label IN ('Function', 'Method') AND len(string_split(body_text, chr(10))) >= {M.LEAST_LINES})),
h AS (SELECT symbol_id, list_transform(t, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM s WHERE len(t) > 0),
m AS (SELECT symbol_id, list_transform(generate_series(1, {M.SLOTS}), lambda i: list_min(list_transform(h, lambda x: (x * ((1103515245 * i + 12345) % {M.P - 1} + 1) + (1664525 * i + 1013904223) % {M.P}) % {M.P}))) AS sig FROM h)
"""


def _signatures(symbols):
    wanted = symbols.where(F.col("label").isin("Function", "Method") & (F.size(F.split("body_text", "\n")) >= M.LEAST_LINES)).select("symbol_id", "body_text").distinct()
    hashed = wanted.select("symbol_id", M.token_hashes(M.structural_tokens(F.col("body_text"))).alias("h"))
    return M.signatures(hashed, "symbol_id", "h").withColumnRenamed("id", "symbol_id")


@R.whole("ts_symbols", sql=f"WITH {_SIGS.split('h AS (')[0].rstrip().rstrip(',')} SELECT symbol_id, array_to_string(list_sort(t), ' ') AS tokens FROM s")
def ft5_structural_tokens(symbols):
    wanted = symbols.where(F.col("label").isin("Function", "Method") & (F.size(F.split("body_text", "\n")) >= M.LEAST_LINES)).select("symbol_id", "body_text").distinct()
    return wanted.select("symbol_id", F.array_join(F.sort_array(F.array_distinct(M.structural_tokens(F.col("body_text")))), " ").alias("tokens"))


@R.whole("ts_symbols", sql=f"WITH {_SIGS} SELECT symbol_id, sig[1] AS first, sig[64] AS middle, sig[128] AS last, list_sum(sig)::BIGINT AS total FROM m")
def ft6_minhash_signatures(symbols):
    sig = F.col("sig")
    return _signatures(symbols).select("symbol_id", sig[0].alias("first"), sig[63].alias("middle"), sig[127].alias("last"), F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def _links_sql(rows: str) -> str:
    return f"""{rows}, c AS (SELECT sig, min(symbol_id) AS rep, count(DISTINCT symbol_id) AS copies FROM m GROUP BY sig),
p AS (SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep < b.rep WHERE len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) >= 90), q AS (SELECT a AS rep FROM p UNION ALL SELECT b FROM p), n AS (SELECT rep, count(*) AS links FROM q GROUP BY rep)
SELECT DISTINCT m.symbol_id AS id, c.copies, coalesce(n.links, 0) AS links FROM m JOIN c ON c.sig = m.sig LEFT JOIN n ON n.rep = c.rep"""


@R.whole("ts_symbols", sql=_links_sql(f"WITH {_SIGS}"))
def ep24_similar_functions(symbols):
    """Of each function of eight or more lines how many have an equal signature, and how many others a similar one."""
    made = SharedTables(symbols.sparkSession, "signatures").put(_signatures(symbols))
    return M.class_links(*M.similar_signatures(made, "symbol_id", "sig"))


@R.whole("fingerprints", sql=_links_sql("WITH m AS (SELECT symbol_id, hashes AS sig FROM fingerprints WHERE len(hashes) = 128)"))
def j12_similar_fingerprints(fingerprints):
    return M.class_links(*M.similar_signatures(fingerprints, "symbol_id", "hashes"))


_OWN = [("a", "Run"), ("a", "Stop"), ("a", "Go"), ("b", "Run"), ("c", "Run"), ("c", "Stop")]
_NEEDS = [("X", "Run"), ("X", "Stop"), ("Y", "Go"), ("Z", "Run"), ("W", "Fly"), ("W", "Run")]


@R.sample(sql="SELECT o.owner, n.need FROM (SELECT DISTINCT owner FROM owners) o, (SELECT need, count(*) AS size FROM needs GROUP BY 1) n WHERE (SELECT count(*) FROM owners a JOIN needs b ON b.member = a.member WHERE a.owner = o.owner AND b.need = n.need) = n.size", owners=("owner string, member string", _OWN), needs=("need string, member string", _NEEDS))
def ep14_interface_satisfaction(owners, needs):
    """Types whose methods include all of an interface's: relational division."""
    return G.supersets(owners, needs)


def _pattern(text: str):
    from graphloom.plans import cypher

    return lambda nodes, edges: cypher.run(text, nodes, edges, compatible=True)


@R.whole("nodes", "edges", sql="SELECT qualified_name AS \"n.qualified_name\" FROM nodes WHERE label = 'Class' ORDER BY qualified_name LIMIT 100")
def t2_default_limit(nodes, edges):
    return _pattern("MATCH (n:Class) RETURN n.qualified_name ORDER BY n.qualified_name")(nodes, edges)


@R.sample("nodes", "edges", sql="SELECT a.name AS \"a.name\", a.label AS \"a.label\", a.qualified_name AS \"a.qualified_name\", b.name AS \"b.name\", b.label AS \"b.label\", b.qualified_name AS \"b.qualified_name\", e.type FROM (SELECT DISTINCT source_id, target_id, type FROM edges) e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.type = 'CALLS'")
def pj4_relationship_columns(nodes, edges):
    return _pattern("MATCH (a)-[r:CALLS]->(b) RETURN a.name")(nodes, edges)


@R.sample("nodes", "edges", sql="SELECT name AS \"n.oddity\" FROM nodes WHERE name = 'main'")
def pj3_unknown_property(nodes, edges):
    return _pattern("MATCH (n) WHERE n.whatever = 'main' RETURN n.oddity")(nodes, edges)


@R.sample("nodes", "edges", sql="SELECT id AS \"n.id\", label AS \"n.label\", name AS \"n.name\", qualified_name AS \"n.qualified_name\", file_path AS \"n.file_path\", start_line AS \"n.start_line\", end_line AS \"n.end_line\" FROM nodes WHERE label = 'Route'")
def pj2_whole_nodes(nodes, edges):
    from graphloom.plans import cypher

    return cypher.run("MATCH (n:Route) RETURN n", nodes, edges)


@R.sample("nodes", "edges", sql="SELECT id FROM nodes WHERE (TRY_CAST(json_extract_string(properties, '$.complexity') AS DOUBLE) >= 7 OR json_extract_string(properties, '$.framework') IN ('10', 'react') OR start_line IN (4, 5)) AND name <> '10'")
def fp1_typed_comparisons(nodes, edges):
    from graphloom.plans import cypher

    return cypher.run("MATCH (n) WHERE (n.complexity >= 7 OR n.framework IN [10, 'react'] OR n.start_line IN [4, 5]) AND n.name <> 10 RETURN n.id AS id", nodes, edges)


_NAMES = f"p AS (SELECT name, list_filter(string_split_regex(lower(name), '[-_.]'), lambda x: len(x) > 2 AND x NOT IN {_in(fixed.GENERIC_NAME_WORDS)}) AS k, regexp_replace(lower(name), '{'|'.join(fixed.PROJECT_SUFFIXES)}', '', 'g') AS stem FROM projects)"


@R.whole("projects", "nodes", sql=f"""
WITH {_NAMES}, t AS (SELECT DISTINCT project, name FROM nodes WHERE label IN ('Class', 'Interface')), s AS (SELECT a.project AS pa, b.project AS pb, count(*) AS n FROM t a JOIN t b ON a.name = b.name AND a.project < b.project GROUP BY ALL),
x AS (SELECT x.name AS a, y.name AS b, contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) OR x.stem = y.stem AS rel, coalesce(s.n, 0) AS n, len(list_filter(x.k, lambda w: list_contains(y.k, w))) AS c FROM p x JOIN p y ON x.name < y.name LEFT JOIN s ON s.pa = x.name AND s.pb = y.name),
y AS (SELECT *, CASE WHEN rel THEN 25 ELSE 0 END + least(30, 10 * n) + least(15, 8 * c) AS points FROM x)
SELECT a, b, round(points / 100.0, 2)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN rel THEN 'related names' END, CASE WHEN n > 0 THEN n || ' shared types' END, CASE WHEN c > 0 THEN 'common words' END], lambda v: v IS NOT NULL), ', ') AS reasons FROM y WHERE points > 0""")
def sv5_link_reasons(projects, nodes):
    from graphloom.operators.search import link_suggestions

    return link_suggestions(projects, nodes)


def _details_sql(kinds, limit: int) -> str:
    each = " UNION ".join(f"SELECT {'target_id' if back else 'source_id'} AS origin, '{kind}' AS kind, {'source_id' if back else 'target_id'} AS other FROM edges WHERE type IN ({', '.join(repr(t) for t in types)})" for kind, (types, back) in kinds.items())
    return f"WITH e AS ({each}), r AS (SELECT e.origin, e.kind, n.qualified_name, row_number() OVER (PARTITION BY e.origin, e.kind ORDER BY n.qualified_name, n.id) AS rn FROM e JOIN nodes n ON n.id = e.other JOIN nodes o ON o.id = e.origin WHERE o.label IN ('Class', 'Interface', 'Function')) SELECT origin, kind, qualified_name FROM r WHERE rn <= {limit}"


from graphloom.api import DETAIL_KINDS, DETAILS, Engine  # noqa: E402


@R.whole("nodes", "edges", sql=_details_sql(DETAIL_KINDS, DETAILS))
def g8_eight_lists(nodes, edges):
    return V.details(nodes, edges, nodes.where("label in ('Class', 'Interface', 'Function')"), DETAIL_KINDS, DETAILS)


@R.whole("nodes", "edges", sql=_details_sql({"caller": (("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "USES"), True), "callee": (("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "USES"), False)}, 5))
def g10_first_neighbours(nodes, edges):
    used = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "USES")
    return V.details(nodes, edges, nodes.where("label in ('Class', 'Interface', 'Function')"), {"caller": (used, True), "callee": (used, False)}, 5)


@R.whole("nodes", "edges", "file_hashes", sql=f"""
WITH h AS (SELECT rel_path AS file_path, bool_or(NOT coalesce(is_deleted, false)) AS live FROM file_hashes GROUP BY 1), o AS (SELECT * FROM nodes WHERE file_path <> ''), c AS (SELECT file_path, count(*) FILTER (WHERE label NOT IN {_in(V.NO_SYMBOLS)}) AS symbols, count(*) FILTER (WHERE start_line > end_line) AS bad FROM o GROUP BY 1),
x AS (SELECT source_id AS id, 1 AS o FROM edges UNION ALL SELECT target_id, 0 FROM edges), l AS (SELECT o.file_path, count(*) AS ends, sum(x.o) AS outs FROM x JOIN o ON o.id = x.id GROUP BY 1),
f AS (SELECT coalesce(h.file_path, c.file_path) AS file_path, h.live, coalesce(symbols, 0) AS symbols, coalesce(bad, 0) AS bad, coalesce(ends, 0) AS ends, coalesce(outs, 0) AS outs FROM h FULL JOIN c ON c.file_path = h.file_path LEFT JOIN l ON l.file_path = coalesce(h.file_path, c.file_path))
SELECT file_path, unnest(list_filter([CASE WHEN live IS NULL THEN 'no hash on record' END, CASE WHEN NOT live THEN 'file is deleted' END, CASE WHEN symbols = 0 THEN 'no symbols' END, CASE WHEN symbols > 0 AND ends = 0 THEN 'symbols without edges' END, CASE WHEN ends > 0 AND outs = 0 THEN 'only incoming edges' END, CASE WHEN bad > 0 THEN 'lines out of order' END], lambda v: v IS NOT NULL)) AS message FROM f""")
def sv10_file_messages(nodes, edges, hashes):
    return V.file_messages(nodes, edges, hashes)


_TOOLS = {
    "list_projects": (4, lambda e: e.list_projects()), "get_graph_schema": (23, lambda e: e.get_graph_schema("web")), "search_graph": (5, lambda e: e.search_graph("web", "users")), "query_graph": (3, lambda e: e.query_graph("MATCH (n:Route) WHERE n.name STARTS WITH 'GET' RETURN n.name")), "index_status": (1, lambda e: e.index_status("web")),
    "trace_call_path": (4, lambda e: e.trace_call_path("web", "getUsers")), "get_architecture": (7, lambda e: e.get_architecture("web")), "get_code_snippet": (1, lambda e: e.get_code_snippet("web", "web.main")), "search_code": (2, lambda e: e.search_code("web", "run")), "ingest_traces": (1, lambda e: e.ingest_traces("web", '[{"source": "main", "target": "getUsers"}]')),
    "manage_adr": (2, lambda e: e.manage_adr("web")), "list_project_links": (1, lambda e: e.list_project_links("web")), "search_linked_projects": (2, lambda e: e.search_linked_projects("web", "user")), "find_symbol": (1, lambda e: e.find_symbol("web", "findAllUsers")), "get_symbol_details": (5, lambda e: e.get_symbol_details("web", "web.UserController.getUsers")),
    "find_references": (3, lambda e: e.find_references("web", "web.UserController.getUsers")), "impact_analysis": (5, lambda e: e.impact_analysis("web", "web.UserController.getUsers")), "explain_index_result": (1, lambda e: e.explain_index_result("web", "src/lib/validate.ts")), "get_file_overview": (1, lambda e: e.get_file_overview("web", "src/main.ts")),
    "find_entrypoints": (7, lambda e: e.find_entrypoints("web")), "suggest_next_reads": (3, lambda e: e.suggest_next_reads("web", "web.UserController.getUsers")), "trace_data_flow": (6, lambda e: e.trace_data_flow("web", "web.UserController.getUsers")), "find_tests_for_target": (0, lambda e: e.find_tests_for_target("web", "src/main.ts")),
    "suggest_project_links": (0, lambda e: e.suggest_project_links()), "find_routes": (3, lambda e: e.find_routes("web")), "trace_backend_flow": (4, lambda e: e.trace_backend_flow("web", "users")), "find_pipelines": (1, lambda e: e.find_pipelines("web")), "find_infrastructure": (2, lambda e: e.find_infrastructure("web")),
}


@R.expected("tool string, n bigint", [(k, n) for k, (n, _) in _TOOLS.items()], **{t: SAMPLES[t] for t in ("nodes", "edges", "file_hashes", "projects", "project_links")}, decisions=("id bigint, project string, title string, content string, created_at string", [(1, "web", "b", "", "2"), (2, "web", "a", "", "1"), (3, "api", "c", "", "1")]), code_content=("project string, qualified_name string, content string", [("web", "web.main", "run()\nrun2()\n"), ("api", "api.x", "run")]))
def api_tools(*tables):
    """Every read-only tool over the samples, with the number of its rows."""
    names = ("nodes", "edges", "file_hashes", "projects", "project_links", "decisions", "code_content")
    engine = Engine(tables[0].sparkSession, dict(zip(names, tables)).__getitem__)
    counted = [tool(engine).agg(F.count("*").alias("n")).select(F.lit(name).alias("tool"), "n") for name, (_, tool) in _TOOLS.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


_WALK = "WITH RECURSIVE c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS')), r AS (SELECT id, 0 AS depth FROM nodes WHERE {seeds} UNION SELECT c.target_id, r.depth + 1 FROM r JOIN c ON c.source_id = r.id WHERE r.depth < {depth}), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), p AS (SELECT DISTINCT e.source_id, e.target_id, e.type, m.depth + 1 AS depth FROM edges e JOIN m ON m.id = e.source_id WHERE e.type IN ('CALLS', 'ASYNC_CALLS') AND m.depth < {depth})"


@R.whole("nodes", "edges", sql=_WALK.format(seeds="label = 'Function' AND starts_with(name, 'render')", depth=3) + " SELECT source_id, target_id, type, depth::INT AS depth FROM p")
def g1_traced_edges(nodes, edges):
    return G.traversed(edges.where("type in ('CALLS', 'ASYNC_CALLS')"), nodes.where("label = 'Function' and startswith(name, 'render')"), 3)


@R.sample("nodes", "edges", sql=_WALK.format(seeds="name = 'main'", depth=5) + " SELECT source_id, target_id, type, depth::INT AS depth FROM p WHERE depth <= coalesce((SELECT min(p.depth) FROM p JOIN nodes n ON n.id = p.target_id WHERE n.name = 'AppComponent'), 5)")
def g1_traced_to_a_target(nodes, edges):
    return G.traversed(edges.where("type in ('CALLS', 'ASYNC_CALLS')"), nodes.where("name = 'main'"), 5, nodes.where("name = 'AppComponent'"))


@R.whole("nodes", "edges", sql=f"""
WITH f AS (SELECT DISTINCT project, file_path, coalesce({_case(fixed.LAYERS, lambda w: f"contains(lower(file_path), '{w}')")} END, 'other') AS layer FROM nodes WHERE file_path <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY project, layer ORDER BY file_path) AS rn, count(*) OVER (PARTITION BY project, layer) AS files FROM f),
t AS (SELECT * FROM k WHERE rn <= 10), x AS (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges), e AS (SELECT n.project, n.file_path, sum(x.o) AS o, sum(x.i) AS i FROM x JOIN nodes n ON n.id = x.id WHERE n.file_path <> '' GROUP BY ALL)
SELECT t.project, t.layer, max(t.files) AS files, coalesce(sum(e.o), 0)::BIGINT AS n_out, coalesce(sum(e.i), 0)::BIGINT AS n_in FROM t LEFT JOIN e USING (project, file_path) GROUP BY ALL""")
def a13_layer_edges(nodes, edges):
    """Files of each layer, and the edges of its first ten files by path."""
    own = nodes.where("file_path <> ''")
    f = own.select("project", "file_path").distinct().withColumn("layer", F.coalesce(C.layer(F.col("file_path")), F.lit("other")))
    count = f.groupBy("project", "layer").agg(F.count("*").alias("files"))
    each = own.join(G.degrees(edges), "id").groupBy("project", "file_path").agg(F.sum("fan_out").alias("o"), F.sum("fan_in").alias("i"))
    first = G.top_per_group(f, ["project", "layer"], ["file_path"], 10).join(each, ["project", "file_path"], "left").groupBy("project", "layer").agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n_out"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_in"))
    return count.join(first, ["project", "layer"])


@R.expected("project string, name string, test_path string, score double", [("p", "load", "tests/a.py", 0.65), ("p", "save", "b.test.ts", 0.65), ("p", "save", "tests/a.py", 0.65)],
    targets=("project string, name string", [("p", "load"), ("p", "save"), ("p", "none"), ("q", "load")]),
    symbols=("project string, file_path string, name string", [("p", "tests/a.py", "test_load_twice"), ("p", "tests/a.py", "Saved"), ("p", "b.test.ts", "saves"), ("p", "src/a.py", "load"), ("p", "tests/a.py", "load2")]))
def sv4_referencing_tests(targets, symbols):
    return V.referencing_tests(targets, symbols)


@R.whole("documents", sql="SELECT path, line_no, content FROM (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS content, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE path IS NOT NULL AND project = 'meridian-core') WHERE contains(content, 'ledger')")
def sc19_grep_of_a_project(documents):
    lines = documents.where("path is not null and project = 'meridian-core'").select("path", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return lines.where(F.contains("content", F.lit("ledger"))).select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "content")
