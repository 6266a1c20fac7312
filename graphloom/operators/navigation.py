"""What to read next: entry points, neighbours worth reading, overviews of files, tests of files, pipelines, infrastructure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import fixed
from graphloom.operators.flows import prop

#: Labels that are no symbols.
NO_SYMBOLS = ("Module", "File", "Folder", "Project", "Package")
CALL_TYPES, IMPORT_TYPES, PARENT_TYPES = ("CALLS", "ASYNC_CALLS", "HTTP_CALLS"), ("IMPORTS",), ("INHERITS", "IMPLEMENTS")
# What each way to a neighbour scores by the reader's goal; the first goes for goals not named.
READ_SCORES = {
    "callee": {"": 0.9, "understand": 0.95, "trace": 0.95}, "caller": {"": 0.85, "debug": 0.95, "refactor": 0.95}, "imports": {"": 0.8, "understand": 0.9, "refactor": 0.85}, "imported_by": {"": 0.7, "refactor": 0.9}, "parent": {"": 0.85},
}
# Which edges lead to which kind of neighbour, in the order in which one that is several counts.
READ_WAYS = (("callee", CALL_TYPES, False), ("caller", CALL_TYPES, True), ("imports", IMPORT_TYPES, False), ("imported_by", IMPORT_TYPES, True), ("parent", PARENT_TYPES, False))


def entry_points(nodes: DataFrame, kind: str = "any") -> DataFrame:
    """(project, qualified_name, label, reason, score) of the symbols by which a program is entered.

    Points for annotations, for words of the path and for the name are added up; what is left above zero counts, divided
    by 100 and at most 1. ``kind`` (http, cli, lambda, bootstrap, public_api) keeps one sort of entry.
    """
    n, p, said = F.lower("name"), F.lower(F.coalesce("file_path", F.lit(""))), F.coalesce("properties", F.lit("{}"))
    holds = lambda *words: C.any_of(said, words)
    route, bootstrap = F.col("label") == "Route", n.isin(*fixed.BOOTSTRAP_NAMES)
    rest, controller, mapping = holds("RestController"), holds("Controller") & ~holds("ControllerAdvice"), holds("GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping", "RequestMapping")
    api, way = C.any_of(p, ("controller", "/api/")), C.any_of(p, ("route", "handler"))
    annotated = (
        F.when(rest, 40).when(controller, 35).otherwise(0) + F.when(mapping, 30).otherwise(0) - F.when(holds('"Test"', "@Test") | n.startswith("test"), 40).otherwise(0) - F.when(holds("Configuration"), 25).otherwise(0)
        - F.when(holds("ExceptionHandler", "ControllerAdvice"), 25).otherwise(0) + F.when(route, 35).otherwise(0)
    )
    placed = F.when(api, 20).when(way, 15).otherwise(0) - F.when(C.any_of(p, ("/test/", "/tests/", ".test.", ".spec.")), 30).otherwise(0)
    points = annotated + placed + F.when(bootstrap, 25).otherwise(0)
    wanted = {
        "http": (annotated > 0) | route | C.any_of(p, ("controller", "route", "handler")), "cli": (n == "main") | F.contains(n, F.lit("command")) | F.contains(p, F.lit("cli")), "lambda": (n == "handler") | C.any_of(p, ("handler", "lambda")),
        "bootstrap": bootstrap, "public_api": F.col("label").isin("Function", "Class", "Interface"),
    }.get(kind, F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(rest, "@RestController").when(controller, "@Controller"), F.when(mapping, "HTTP mapping"), F.when(api, "controller/api package").when(way, "route/handler path"), F.when(bootstrap, "bootstrap-style name"), F.when(route, "Route node")
    ))
    kept = nodes.where(~F.col("label").isin(*NO_SYMBOLS)).withColumn("points", points).where(wanted & (F.col("points") > 0))
    reason = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("matched entry pattern")
    return kept.select("project", "qualified_name", "label", reason.alias("reason"), F.round(F.least(F.col("points") / 100, F.lit(1.0)), 2).alias("score"))


def next_reads(nodes: DataFrame, edges: DataFrame, origins: DataFrame, goal: str = "understand", per_way: int | None = None) -> DataFrame:
    """(origin, qualified_name, way, score): the neighbours of each origin (id) worth reading for a goal, each by its first way.

    ``per_way`` keeps as many neighbours of one way, by name; without it all.
    """
    parts = []
    for i, (way, types, inbound) in enumerate(READ_WAYS):
        at, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
        score = READ_SCORES[way].get(goal, READ_SCORES[way][""])
        parts.append(edges.where(F.col("type").isin(*types)).select(F.col(at).alias("origin"), F.col(other).alias("other"), F.lit(i).alias("rank"), F.lit(way).alias("way"), F.lit(score).alias("score")))
    found = reduce(DataFrame.unionByName, parts).join(origins.select(F.col("id").alias("origin")), "origin", "left_semi").distinct()
    named = found.join(nodes.select(F.col("id").alias("other"), "qualified_name"), "other")
    if per_way is not None:
        named = named.withColumn("rn", F.row_number().over(W.partitionBy("origin", "way").orderBy("qualified_name", "other"))).where(F.col("rn") <= per_way)
    first = W.partitionBy("origin", "qualified_name").orderBy("rank")
    return named.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("origin", "qualified_name", "way", "score")


def file_overview(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(project, file_path, symbols, n_symbols, imports, edge_types) of every file.

    ``symbols`` are the first ``limit`` names by line; ``imports`` the files that its nodes import; ``edge_types`` the
    types of edges that leave it with their numbers. Only ranked rows are gathered, so a large file stays in bounds.
    """
    own = nodes.where("file_path is not null and file_path <> ''")
    symbols = own.where(~F.col("label").isin(*NO_SYMBOLS))
    ranked = symbols.withColumn("rn", F.row_number().over(W.partitionBy("project", "file_path").orderBy("start_line", "name", "id"))).where(F.col("rn") <= limit)
    first = ranked.groupBy("project", "file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ",").alias("symbols"))
    count = symbols.groupBy("project", "file_path").agg(F.count("*").alias("n_symbols"))
    out = edges.join(own.select(F.col("id").alias("source_id"), F.col("project").alias("p"), "file_path"), "source_id")
    types = out.groupBy(F.col("p").alias("project"), "file_path", "type").agg(F.count("*").alias("n")).groupBy("project", "file_path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "type", F.col("n").cast("string")))), ",").alias("edge_types"))
    to = out.where("type = 'IMPORTS'").join(own.select(F.col("id").alias("target_id"), F.col("file_path").alias("to")), "target_id").where("to <> file_path")
    imports = to.groupBy(F.col("p").alias("project"), "file_path").agg(F.count_distinct("to").alias("imports"))
    files = own.select("project", "file_path").distinct()
    for part in (first, count, types, imports):
        files = files.join(part, ["project", "file_path"], "left")
    return files.select("project", "file_path", F.coalesce("symbols", F.lit("")).alias("symbols"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("edge_types", F.lit("")).alias("edge_types"))


def test_files(files: DataFrame) -> DataFrame:
    """(project, file_path, test_path, score, reason): test files of each file of ``files(project, file_path)``.

    A test file named after the file, beside it or in a mirrored folder, scores 0.95; one in the same folder 0.80.
    """
    path = F.col("file_path")
    base, ext, name = C.strip_extension(path), F.regexp_extract("file_path", r"\.[^./]*$", 0), F.regexp_extract("file_path", "[^/]*$", 0)
    rest = F.when(path.startswith("src/"), F.substring(path, 5, 100_000))
    bare = C.strip_extension(rest)
    folder = F.regexp_extract("file_path", "^.*/", 0)
    near = [F.when(ext != "", F.concat(base, F.lit(k), ext)) for k in (".test", ".spec")]
    mirrored = [F.concat(F.lit(r), rest) for r in ("tests/", "test/")] + [F.when(ext != "", F.concat(F.lit(r), bare, F.lit(".test"), ext)) for r in ("tests/", "test/")]
    candidates = F.array_distinct(F.array_compact(F.array(*near, *mirrored, F.when(folder != "", F.concat(folder, F.lit("__tests__/"), name)))))
    every = files.select("project", "file_path").where("file_path is not null").distinct()
    by_name = every.select("project", "file_path", F.explode(candidates).alias("test_path")).join(every.select("project", F.col("file_path").alias("test_path")), ["project", "test_path"], "left_semi")
    tests = every.where(C.is_test_path(path)).select("project", F.col("file_path").alias("test_path"), folder.alias("folder"))
    beside = every.where(folder != "").withColumn("folder", folder).join(tests, ["project", "folder"]).select("project", "file_path", "test_path")
    both = by_name.withColumn("score", F.lit(0.95)).unionByName(beside.withColumn("score", F.lit(0.8)))
    best = both.groupBy("project", "file_path", "test_path").agg(F.max("score").alias("score"))
    return best.select("*", F.when(F.col("score") == 0.95, "test file naming convention").otherwise("test file in same directory").alias("reason"))


def pipelines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, pipeline, ci_system, file_path, stages, jobs): every pipeline with its stages in order and its jobs.

    A job is listed with its stage and what it depends on; stages and jobs belong by the pipeline_name of their properties.
    """
    named = nodes.withColumn("pipeline", prop("pipeline_name"))
    p = named.where("label = 'Pipeline'").select("project", F.coalesce("pipeline", "name").alias("pipeline"), prop("ci_system").alias("ci_system"), "file_path")
    stage = named.where("label = 'Stage'").select("project", "pipeline", F.coalesce(prop("order").cast("int"), F.lit(0)).alias("o"), "name")
    stages = stage.groupBy("project", "pipeline").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]), ",").alias("stages"))
    job = named.where("label = 'Job'").select("project", "pipeline", F.col("id").alias("job"), "name", F.coalesce(prop("stage"), F.lit("")).alias("stage"))
    needs = edges.where("type = 'DEPENDS_ON'").select(F.col("source_id").alias("job"), F.col("target_id").alias("needed")).join(nodes.select(F.col("id").alias("needed"), F.col("name").alias("need")), "needed")
    needed = needs.groupBy("job").agg(F.array_join(F.sort_array(F.collect_set("need")), "+").alias("needs"))
    text = F.concat(F.col("name"), F.lit("@"), F.col("stage"), F.when(F.col("needs").isNotNull(), F.concat(F.lit("<"), F.col("needs"))).otherwise(""))
    jobs = job.join(needed, "job", "left").groupBy("project", "pipeline").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("jobs"))
    return p.join(stages, ["project", "pipeline"], "left").join(jobs, ["project", "pipeline"], "left")


def over_links(rows: DataFrame, links: DataFrame, project: str, key: list[str]) -> DataFrame:
    """Rows of a project and of those linked from it, each key once: the project's own first, then by the linked one's name."""
    seen = links.where((F.col("source_project") == project) & (F.col("target_project") != project)).select(F.col("target_project").alias("project")).distinct().withColumn("via", F.lit(1))
    own = rows.where(F.col("project") == project).withColumn("via", F.lit(0))
    both = own.unionByName(rows.join(seen, "project"))
    return both.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("via", "project"))).where("rn = 1").drop("rn", "via")


def infrastructure(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """(project, name, resource_type, kind, file_path) of the Infra nodes, of one infra_type or of all."""
    found = nodes.where("label = 'Infra'").select("project", "name", F.coalesce(prop("resource_type"), F.lit("")).alias("resource_type"), F.coalesce(prop("infra_type"), F.lit("")).alias("kind"), "file_path")
    return found if kind is None else found.where(F.col("kind") == kind)


def frameworks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, frameworks, libraries) that the routes, edges and tags of a project tell of."""
    route = F.col("label") == "Route"
    source, any_of = prop("source"), lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    java = (F.col("label") == "File") & F.lower(prop("language")).isin("java", "kotlin")
    by = nodes.groupBy("project").agg(
        any_of(route & source.isNull()).alias("plain"), any_of(java).alias("java"), *[any_of(route & (source == s)).alias(s) for s in ("nextjs", "lambda", "serverless", "express")], *[any_of(prop("framework") == f).alias(f) for f in ("react", "solid", "vue")]
    )
    angular = edges.where("type in ('SELECTS', 'INJECTS')").select("project").distinct().withColumn("angular", F.lit(True))
    each = by.join(angular, "project", "left")
    named = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs])), ",")
    return each.select(
        "project", named([("Spring Boot", F.col("plain") & F.col("java")), ("Next.js", F.col("nextjs")), ("AWS Lambda", F.col("lambda")), ("Serverless", F.col("serverless")), ("Express", F.col("express")), ("Angular", F.coalesce("angular", F.lit(False)))]).alias("frameworks"),
        named([("React", F.col("react")), ("Solid.js", F.col("solid")), ("Vue", F.col("vue"))]).alias("libraries"),
    )


def neighbours(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], limit: int, limit_first: bool = False) -> DataFrame:
    """(id, other, type): up to ``limit`` outgoing neighbours of each node over the given edge types, by edge id.

    ``limit_first`` cuts to the limit before the types are looked at, as tools do that limit in their storage query.
    """
    order = W.partitionBy("source_id").orderBy("id")
    chosen = edges if limit_first else edges.where(F.col("type").isin(*types))
    cut = chosen.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    if limit_first:
        cut = cut.where(F.col("type").isin(*types))
    return cut.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "type")


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text, taken to be a quarter of its bytes."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def details(nodes: DataFrame, edges: DataFrame, origins: DataFrame, kinds: dict[str, tuple[tuple[str, ...], bool]], limit: int) -> DataFrame:
    """(origin, kind, qualified_name): up to ``limit`` neighbours of each kind (edge types, inbound) of the origins, by name."""
    parts = []
    for kind, (types, inbound) in kinds.items():
        at, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
        parts.append(edges.where(F.col("type").isin(*types)).select(F.col(at).alias("origin"), F.col(other).alias("other"), F.lit(kind).alias("kind")))
    found = reduce(DataFrame.unionByName, parts).join(origins.select(F.col("id").alias("origin")), "origin", "left_semi").distinct()
    named = found.join(nodes.select(F.col("id").alias("other"), "qualified_name"), "other")
    return named.withColumn("rn", F.row_number().over(W.partitionBy("origin", "kind").orderBy("qualified_name", "other"))).where(F.col("rn") <= limit).select("origin", "kind", "qualified_name")


def file_messages(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_path, message): what is odd about the index of the files on record or in the graph."""
    live = hashes.groupBy(F.col("rel_path").alias("file_path")).agg(F.max(~F.coalesce("is_deleted", F.lit(False))).alias("live"))
    own = nodes.where("file_path <> ''")
    count = own.groupBy("file_path").agg(F.count_if(~F.col("label").isin(*NO_SYMBOLS)).alias("symbols"), F.count_if((F.col("start_line") > F.col("end_line"))).alias("bad"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    linked = ends.join(own.select("id", "file_path"), "id").groupBy("file_path").agg(F.count("*").alias("ends"), F.sum("o").alias("out"))
    each = live.join(count, "file_path", "full").join(linked, "file_path", "left").select("file_path", "live", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("symbols", "bad", "ends", "out")])
    said = F.array_compact(F.array(
        F.when(F.col("live").isNull(), "no hash on record"), F.when(~F.col("live"), "file is deleted"), F.when(F.col("symbols") == 0, "no symbols"), F.when((F.col("symbols") > 0) & (F.col("ends") == 0), "symbols without edges"), F.when((F.col("ends") > 0) & (F.col("out") == 0), "only incoming edges"), F.when(F.col("bad") > 0, "lines out of order"),
    ))
    return each.select("file_path", F.explode(said).alias("message"))


def referencing_tests(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, name, test_path, score) of the test files that hold a symbol whose name contains a target's name.

    ``targets(project, name)`` is a stated set of names; ``symbols(project, file_path, name)``. Names meet by their first
    three letters, those of fewer letters by what they have.
    """
    low = F.lower("name")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    held = symbols.where(C.is_test_path(F.concat(F.lit("/"), "file_path")) & (F.col("name") != "")).select("project", "file_path", low.alias("own"), F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    wanted = targets.where("name <> ''").select("project", "name", F.substring(low, 1, 3).alias("gram")).distinct()
    met = wanted.join(held, ["project", "gram"]).where(F.contains("own", F.lower("name")))
    return met.select("project", "name", F.col("file_path").alias("test_path"), F.lit(0.65).alias("score")).distinct()
