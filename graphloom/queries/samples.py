"""Small tables that hold a case for each branch of operators the large tables have no rows for, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Rows = tuple[str, list[tuple]]

N = "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string"
E = "id bigint, project string, source_id bigint, target_id bigint, type string, properties string"

_NODES = [
    (1, "web", "Route", "GET /users", "web.route.users", "src/api/UserController.ts", 1, 1, '{"http_method": "GET", "path": "/users", "source": "express"}'),
    (2, "web", "Method", "getUsers", "web.UserController.getUsers", "src/controller/UserController.ts", 5, 20, '{"decorator": "@GetMapping", "layer": "controller"}'),
    (3, "web", "Method", "findAllUsers", "web.UserService.findAllUsers", "src/service/UserService.ts", 3, 12, "{}"),
    (4, "web", "Method", "findAll", "web.UserRepository.findAll", "src/repository/UserRepository.ts", 2, 9, None),
    (5, "web", "Class", "UserDto", "web.UserDto", "src/dto/UserDto.ts", 1, 8, "{}"),
    (6, "web", "Route", "POST /orders/:id", "web.route.orders.create", "src/routes/orders.ts", 4, 4, '{"http_method": "post", "path": "/orders/:id", "method_name": "createOrder", "request_dto_type": "OrderDto", "source": "nextjs"}'),
    (7, "web", "Route", "DELETE /stale", "web.route.stale", "src/gone.ts", 1, 1, '{"http_method": "DELETE", "path": "/stale"}'),
    (8, "web", "Function", "validateUser", "web.validateUser", "src/lib/validate.ts", 1, 9, '{"is_exported": "true", "complexity": "7"}'),
    (9, "web", "Class", "AppComponent", "web.AppComponent", "src/app/app.component.ts", 1, 30, '{"framework": "angular", "layer": "component"}'),
    (10, "web", "Class", "ListComponent", "web.ListComponent", "src/app/list.component.ts", 1, 30, '{"framework": "react", "selector": "app-list"}'),
    (11, "web", "Selector", "app-list", "web.selector.app-list", "src/app/list.component.ts", 0, 0, '{"selector": "app-list", "component": "ListComponent"}'),
    (12, "web", "Function", "main", "web.main", "src/main.ts", 1, 5, '{"is_entry_point": "true"}'),
    (13, "web", "Function", "test_users", "web.test_users", "tests/users.test.ts", 1, 5, '{"is_test": "true"}'),
    (14, "api", "Route", "GET /users/{userId}", "api.route.user", "app/handlers/user.go", 1, 1, '{"http_method": "GET", "path": "/users/{userId}"}'),
    (15, "api", "Function", "GetUser", "api.GetUser", "app/handlers/user.go", 3, 9, None),
    (16, "api", "Channel", "order.created", "api.channel.order", "app/events.go", 1, 1, '{"event_name": "order.created", "kafka_topic": "orders"}'),
    (17, "web", "Channel", "order.created", "web.channel.order", "src/events.ts", 1, 1, '{"kafka_topic": "orders", "redis_channel": "news"}'),
    (18, "api", "Channel", "news", "api.channel.news", "app/events.go", 2, 2, '{"rabbitmq_queue": "news"}'),
    (19, "web", "Route", "GET /cart/:id", "web.route.cart", "src/cart.ts", 3, 3, '{"http_method": "GET", "path": "/users/:id"}'),
    (20, "api", "Pipeline", "CI", "api.pipeline.ci", ".gitlab-ci.yml", 1, 1, '{"ci_system": "gitlab", "pipeline_name": "CI", "triggers": "push,merge_request"}'),
    (21, "api", "Stage", "build", "api.stage.build", ".gitlab-ci.yml", 2, 2, '{"pipeline_name": "CI", "order": "0"}'),
    (22, "api", "Stage", "test", "api.stage.test", ".gitlab-ci.yml", 3, 3, '{"pipeline_name": "CI", "order": "1"}'),
    (23, "api", "Job", "compile", "api.job.compile", ".gitlab-ci.yml", 5, 8, '{"pipeline_name": "CI", "stage": "build", "image": "rust:1.75"}'),
    (24, "api", "Job", "unit", "api.job.unit", ".gitlab-ci.yml", 9, 12, '{"pipeline_name": "CI", "stage": "test"}'),
    (25, "api", "Job", "lint", "api.job.lint", ".gitlab-ci.yml", 13, 15, '{"pipeline_name": "CI", "stage": "test"}'),
    (26, "web", "Pipeline", "CI", "web.pipeline.ci", ".gitlab-ci.yml", 1, 1, '{"ci_system": "gitlab", "pipeline_name": "CI"}'),
    (27, "api", "Infra", "web-svc", "api.infra.web", "k8s/web.yaml", 1, 9, '{"infra_type": "kubernetes", "resource_type": "Deployment"}'),
    (28, "api", "Infra", "db", "api.infra.db", "main.tf", 1, 9, '{"infra_type": "terraform", "resource_type": "aws_db_instance"}'),
    (29, "web", "Infra", "web-svc", "web.infra.web", "k8s/web.yaml", 1, 9, '{"infra_type": "kubernetes", "resource_type": "Deployment"}'),
    (30, "web", "File", "orders.ts", "web.src.routes.orders", "src/routes/orders.ts", 1, 40, '{"language": "TypeScript"}'),
    (31, "api", "File", "Main.java", "api.Main", "src/Main.java", 1, 40, '{"language": "Java"}'),
    (32, "web", "Class", "AdminController", "web.AdminController", "src/admin.ts", 1, 40, '{"decorators": ["@RestController"], "note": "RequestMapping"}'),
    (33, "web", "Class", "ErrorAdvice", "web.ErrorAdvice", "src/advice.ts", 1, 9, '{"decorators": ["@ControllerAdvice", "@ExceptionHandler"]}'),
    (34, "web", "Interface", "Store", "web.Store", "src/types.ts", 1, 9, None),
]
_EDGES = [
    (1, "web", 2, 1, "HANDLES_ROUTE", None), (2, "web", 8, 1, "HANDLES_ROUTE", None), (3, "web", 2, 3, "CALLS", None), (4, "web", 3, 4, "CALLS", '{"url_path": "/users"}'), (5, "web", 2, 8, "ASYNC_CALLS", None), (6, "web", 1, 5, "RETURNS_DTO", None), (7, "web", 8, 2, "CALLS", None),
    (8, "web", 9, 10, "RENDERS", None), (9, "web", 11, 10, "SELECTS", None), (10, "web", 10, 3, "INJECTS", None), (11, "web", 12, 9, "CALLS", None), (12, "web", 13, 2, "TESTS", None), (13, "api", 15, 14, "HANDLES_ROUTE", None), (14, "web", 30, 34, "IMPORTS", None), (15, "web", 9, 34, "IMPLEMENTS", None),
    (16, "api", 21, 22, "NEXT_STAGE", None), (17, "api", 23, 21, "BELONGS_TO_STAGE", None), (18, "api", 24, 22, "BELONGS_TO_STAGE", None), (19, "api", 24, 23, "DEPENDS_ON", None), (20, "api", 25, 24, "DEPENDS_ON", None), (21, "api", 25, 22, "BELONGS_TO_STAGE", None), (22, "api", 20, 21, "CONTAINS", None),
    (23, "web", 5, 34, "INHERITS", None), (24, "web", 4, 5, "USES", None), (25, "web", 3, 8, "CALLS", None), (26, "web", 12, 2, "HTTP_CALLS", None),
]

SAMPLES: dict[str, Rows] = {
    "nodes": (N, _NODES),
    "edges": (E, _EDGES),
    "file_hashes": (
        "project string, rel_path string, is_deleted boolean",
        [("web", p, None) for p in ("src/api/UserController.ts", "src/controller/UserController.ts", "src/routes/orders.ts", "src/cart.ts")] + [("web", "src/gone.ts", True), ("api", "app/handlers/user.go", False)],
    ),
    "project_links": ("source_project string, target_project string", [("web", "api"), ("api", "web"), ("api", "ops")]),
    "projects": ("name string, indexed_at string, root_path string", [("web", "2024-01-01", "/r/web"), ("api", None, "/r/api/"), ("ops", "2024-01-03", "/r/ops"), ("zoo", None, "/r/zoo")]),
    "tool_calls": (
        "id bigint, tool_name string, project string, source string, duration_ms bigint, success boolean, agent_name string, model_name string, input_tokens bigint, output_tokens bigint, response_bytes bigint, request_body string, response_body string",
        [
            (1, "search_graph", "web", "mcp", 10, True, "a", "m1", 100, 20, 4000, "{}", "x"), (2, "find_references", "web", "mcp", 30, True, "a", None, None, 10, 200, None, None), (3, "trace_call_path", None, "ui", 20, False, None, None, None, None, None, "q", '{"error": "no"}'),
            (4, "get_code_snippet", "web", "mcp", 40, True, "b", "m1", 5, 5, 90, None, ""), (5, "get_symbol_details", "api", "mcp", 5, True, "b", "m2", 7, 1, 800, "r", None), (6, "unheard_of", "api", "mcp", 6, True, None, "m2", 1, None, 0, None, None), (7, "list_projects", None, "mcp", 1, True, "a", "m1", 1, 1, 12, None, None),
        ],
    ),
}


def _literal(value, kind: str) -> str:
    if value is None:
        return f"NULL::{kind}"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"{value}::{kind}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_literal(v, kind.removesuffix("[]")) for v in value) + f"]::{kind}"
    return "'" + str(value).replace("'", "''") + "'"


def _kinds(schema: str) -> list[tuple[str, str]]:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]"}
    return [(c.split()[0], names[c.split()[1]]) for c in schema.split(", ")]


def values(rows: Rows) -> str:
    """The rows as a SELECT over VALUES, with the types of the schema."""
    kinds = _kinds(rows[0])
    if not rows[1]:
        return "SELECT " + ", ".join(f"NULL::{k} AS {n}" for n, k in kinds) + " WHERE false"
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, kinds)) + ")" for r in rows[1])
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(n for n, _ in kinds)})"


def frame(spark: SparkSession, rows: Rows) -> DataFrame:
    return spark.createDataFrame(rows[1], rows[0])


class Registry:
    """Queries over samples and whole tables, with their SQL."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLES: dict[str, str] = {}

    def sample(self, *tables: str, sql: str, **own: Rows):
        """Register a function of the named sample tables and of tables of its own; the SQL sees them under their names."""

        def add(f):
            used = {**{t: SAMPLES[t] for t in tables}, **own}
            self.QUERIES[f.__name__] = lambda spark, d: f(*[frame(spark, rows) for rows in used.values()])
            head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
            body = sql.replace("WITH RECURSIVE ", ", ", 1) if sql.lstrip().startswith("WITH RECURSIVE ") else sql.lstrip().replace("WITH ", ", ", 1) if sql.lstrip().startswith("WITH ") else sql
            self.ORACLES[f.__name__] = head + ", ".join(f"{n} AS ({values(rows)})" for n, rows in used.items()) + " " + body
            return f

        return add

    def whole(self, *tables: str, sql: str | None = None):
        """Register a function of whole tables of the directory."""
        from graphloom.tables import table

        def add(f):
            self.QUERIES[f.__name__] = lambda spark, d: f(*[table(spark, d, t) for t in tables])
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return add

    def expected(self, schema: str, rows: list[tuple], **own: Rows):
        """Register a function of tables of its own whose rows are known; the SQL is these rows."""

        def add(f):
            self.QUERIES[f.__name__] = lambda spark, d: f(*[frame(spark, x) for x in own.values()])
            self.ORACLES[f.__name__] = values((schema, rows))
            return f

        return add
