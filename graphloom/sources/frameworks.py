"""Routes, components and injected services that web frameworks declare in source text, as rows of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import forward

EDGE = "array<struct<type: string, source: string, target: string>>"
SCRIPTS = ("typescript", "tsx", "javascript")
# Decorators of the component framework and the layer of the classes they mark.
DECORATORS = {"Component": "component", "Injectable": "service", "Directive": "directive", "Pipe": "pipe", "NgModule": "module", "Guard": "service", "Resolver": "service", "Interceptor": "service"}
# Types that a constructor takes without their being injected services.
NOT_INJECTED = "string number boolean any String Number Boolean Object void EventEmitter ElementRef ChangeDetectorRef Renderer2 Injector TemplateRef ViewContainerRef NgZone".split()
# Tags of plain markup.
HTML_TAGS = (
    "a abbr address area article aside audio b base blockquote body br button canvas caption cite code col data dd del details dialog div dl dt em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label legend li link main map meta nav object ol "
    "option output p param picture pre progress q s script section select slot small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video component transition keep-alive router-view router-link"
).split()
# Types that wrap another or are no data of a request.
WRAPPERS = "ResponseEntity Optional CompletableFuture Mono Flux List Set Collection Map".split()
NO_DTO = "String Object Map List Set Collection void Void Unit Any Integer Int Long Boolean Double Float Short Byte Character int long boolean double float short byte char ResponseEntity Optional CompletableFuture Mono Flux".split()


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def next_routes(files: DataFrame) -> DataFrame:
    """(project, rel_path, method, path) of file-based routes: route files below app/ and files below pages/api/.

    Groups in parentheses are no part of a path, ``[id]`` and ``[...rest]`` are parameters. A route file answers the
    methods it exports, GET if it exports none; a file of pages/api any.
    """
    rel = forward(F.col("rel_path"))
    route_file = r"^(?:.*?/)?(?:src/)?app/(?:(.*)/)?route\.(?:ts|tsx|js|jsx)$"
    api_file = r"^(?:.*?/)?(?:src/)?pages/api/(.*)\.(?:ts|tsx|js|jsx)$"
    parts = F.filter(F.split(F.regexp_extract(rel, route_file, 1), "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda s: F.when(s.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), F.regexp_replace(s, r"[\[\].]", ""))).otherwise(s))
    exported = F.array_distinct(F.concat(_all(F.col("content"), r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"), _all(F.col("content"), r"export\s+const\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b")))
    app = F.when(rel.rlike(route_file), F.transform(F.when(F.size(exported) > 0, exported).otherwise(F.array(F.lit("GET"))), lambda m: F.struct(m.alias("method"), F.concat(F.lit("/"), F.array_join(named, "/")).alias("path"))))
    pages = F.when(rel.rlike(api_file), F.array(F.struct(F.lit("ANY").alias("method"), F.concat(F.lit("/api/"), F.regexp_extract(rel, api_file, 1)).alias("path"))))
    rows = files.where(F.col("language").isin(*SCRIPTS) & F.col("content").isNotNull()).select("project", "rel_path", F.explode(F.coalesce(app, pages)).alias("r"))
    return rows.select("project", "rel_path", "r.method", "r.path").distinct()


def joined_path(base: Column, path: Column) -> Column:
    """A class's path and a method's, with one slash between them."""
    b, p = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", ""), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", "")
    return F.when((b == "") & (p == ""), "/").when(b == "", F.concat(F.lit("/"), p)).when(p == "", b).otherwise(F.concat(b, F.lit("/"), p))


def data_type(type_: Column) -> Column:
    """The type inside of wrappers such as lists and responses, null if it is no type of the program's own."""
    inner = F.trim(type_)
    for _ in range(4):
        inner = F.regexp_replace(inner, r"^(?:" + "|".join(WRAPPERS) + r")<\s*(?:\?\s*extends\s+)?(.*?)\s*>$", "$1")
    bare = F.regexp_extract(inner, r"^([A-Za-z_]\w*)", 1)
    return F.when((bare != "") & ~bare.isin(*NO_DTO), bare)


def spring_routes(files: DataFrame) -> DataFrame:
    """(project, rel_path, method, path, handler, request_dto, response_dto) of annotated controller methods.

    The path of a class, where its annotation names one, comes before those of its methods. Java and Kotlin alike; a file
    is taken to hold one controller.
    """
    text = F.col("content")
    base = F.regexp_extract(text, r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+|open\s+)*class\b", 1)
    args = r"(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:\"([^\"]*)\")?[^)]*\))?"
    head = r"@(Get|Post|Put|Patch|Delete)Mapping" + args + r"\s*(?:@\w+(?:\([^)]*\))?\s*)*"
    inside = r"\(((?:[^()]|\([^()]*\))*)\)"
    java = head + r"(?:public\s+|private\s+|protected\s+)([\w<>,.\[\]? ]+?)\s+(\w+)\s*" + inside
    kotlin = head + r"(?:public\s+|suspend\s+)*fun\s+(\w+)\s*" + inside + r"(?:\s*:\s*([\w<>,.? ]+?))?\s*[{=\n]"
    field = lambda p, g: _all(text, p, g)
    shape = lambda p, order: F.transform(F.arrays_zip(*[field(p, g).alias(n) for n, g in order.items()]), lambda x: F.struct(*[x[n].alias(n) for n in ("verb", "path", "returns", "name", "params")]))
    rows = files.where("content is not null").select(
        "project", "rel_path", base.alias("base"), F.col("language"),
        F.explode(F.when(F.col("language") == "java", shape(java, {"verb": 1, "path": 2, "returns": 3, "name": 4, "params": 5})).when(F.col("language") == "kotlin", shape(kotlin, {"verb": 1, "path": 2, "name": 3, "params": 4, "returns": 5}))).alias("m"),
    )
    body = F.when(F.col("language") == "java", F.regexp_extract("m.params", r"@RequestBody\s+(?:@\w+\s+)?(?:final\s+)?([\w<>,.? ]+?)\s+\w+\s*(?:,|$)", 1)).otherwise(F.regexp_extract("m.params", r"@RequestBody\s+\w+\s*:\s*([\w<>?]+)", 1))
    return rows.select("project", "rel_path", F.upper("m.verb").alias("method"), joined_path(F.col("base"), F.col("m.path")).alias("path"), F.col("m.name").alias("handler"), data_type(body).alias("request_dto"), data_type(F.col("m.returns")).alias("response_dto"))


def go_routes(files: DataFrame) -> DataFrame:
    """(project, rel_path, method, path, handler) of routes that Go routers register, with the prefix of their group.

    Known are a method named after the verb, ``HandleFunc`` with or without a verb in its pattern, and ``Methods`` behind it.
    """
    text = F.col("content")
    groups = F.map_from_entries(F.transform(F.arrays_zip(_all(text, r"(\w+)\s*:?=\s*\w+\.(?:Group|Route)\(\s*\"([^\"]*)\"", 1).alias("n"), _all(text, r"(\w+)\s*:?=\s*\w+\.(?:Group|Route)\(\s*\"([^\"]*)\"", 2).alias("p")), lambda x: F.struct(x["n"], x["p"])))
    verb = r"\b(\w+)\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Head|Options|Any)\(\s*\"(/[^\"]*|)\"\s*,\s*(?:[^)]*[,\s])?([\w.]+)\s*\)"
    handle = r"\b(\w+)\.(?:HandleFunc|Handle)\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+)?(/[^\"]*)\"\s*,\s*([\w.]+)[^)]*\)(?:\.Methods\(\s*\"(\w+)\")?"
    take = lambda p, fields: F.transform(F.arrays_zip(*[_all(text, p, g).alias(n) for n, g in fields.items()]), lambda x: F.struct(*[(x[n] if n in fields else F.lit("")).alias(n) for n in ("router", "verb", "path", "handler", "late")]))
    rows = files.where("language = 'go' and content is not null").select(
        "project", "rel_path", groups.alias("g"), F.explode(F.concat(take(verb, {"router": 1, "verb": 2, "path": 3, "handler": 4}), take(handle, {"router": 1, "verb": 2, "path": 3, "handler": 4, "late": 5}))).alias("r")
    )
    method = F.upper(F.when(F.col("r.verb") != "", F.col("r.verb")).when(F.col("r.late") != "", F.col("r.late")).otherwise("ANY"))
    return rows.select("project", "rel_path", method.alias("method"), joined_path(F.col("g")[F.col("r.router")], F.col("r.path")).alias("path"), F.regexp_extract("r.handler", r"(\w+)$", 1).alias("handler")).distinct()


def flask_routes(files: DataFrame) -> DataFrame:
    """(project, rel_path, method, path) of ``@app.route`` declarations with their list of methods, GET without one."""
    pattern = r"@\w+\.route\(\s*['\"]([^'\"]+)['\"]([^)]*)\)"
    each = F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("path"), _all(F.col("content"), pattern, 2).alias("rest"))).alias("r")
    rows = files.where("language = 'python'").select("project", "rel_path", each)
    named = F.regexp_extract_all(F.regexp_extract("r.rest", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    return rows.select("project", "rel_path", F.explode(F.when(F.size(named) > 0, F.transform(named, lambda m: F.upper(m))).otherwise(F.array(F.lit("GET")))).alias("method"), F.col("r.path").alias("path")).distinct()


def kebab(name: Column) -> Column:
    """CamelCase as words joined by dashes."""
    return F.lower(F.regexp_replace(name, r"(?<=.)(\p{Lu})", "-$1"))


def component_classes(files: DataFrame) -> DataFrame:
    """(project, rel_path, name, decorator, layer, selector, template, injected) of decorated classes; one for each decorator."""
    text = F.col("content")
    pattern = r"@(" + "|".join(DECORATORS) + r")\s*\(([\s\S]*?)\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
    each = F.arrays_zip(_all(text, pattern, 1).alias("d"), _all(text, pattern, 2).alias("a"), _all(text, pattern, 3).alias("c"))
    rows = files.where(F.col("language").isin("typescript", "tsx")).select("project", "rel_path", "content", F.explode(each).alias("k"))
    layer = F.create_map(*[F.lit(x) for pair in DECORATORS.items() for x in pair])
    quoted = lambda key: F.regexp_extract("k.a", key + r"\s*:\s*(['\"`])([\s\S]*?)\1", 2)
    body = F.expr("substring_index(content, concat('class ', k.c), -1)")
    taken = F.regexp_extract_all(F.regexp_extract(body, r"constructor\s*\(([^)]*)\)", 1), F.lit(r"(?:private|protected|public|readonly)\s+\w+\s*:\s*(\w+)"), F.lit(1))
    return rows.select(
        "project", "rel_path", F.col("k.c").alias("name"), F.col("k.d").alias("decorator"), layer[F.col("k.d")].alias("layer"), F.nullif(quoted("selector"), F.lit("")).alias("selector"), quoted("template").alias("template"), F.array_except(taken, F.array(*[F.lit(x) for x in NOT_INJECTED])).alias("injected")
    )


def component_edges(files: DataFrame) -> DataFrame:
    """(project, type, source, target): SELECTS from selector to class, INJECTS to services, RENDERS to the classes of the
    selectors that an inline template holds."""
    k = component_classes(files)
    selects = k.where("selector is not null").select("project", F.lit("SELECTS").alias("type"), F.col("selector").alias("source"), F.col("name").alias("target"))
    injects = k.select("project", F.lit("INJECTS").alias("type"), F.col("name").alias("source"), F.explode("injected").alias("target"))
    tags = k.select("project", F.col("name").alias("source"), F.explode(F.array_distinct(_all(F.col("template"), r"<(\w+-[\w-]+)"))).alias("selector"))
    renders = tags.join(k.where("selector is not null").select("project", "selector", F.col("name").alias("target")), ["project", "selector"]).select("project", F.lit("RENDERS").alias("type"), "source", "target")
    return selects.unionByName(injects).unionByName(renders).distinct()


def vue_edges(files: DataFrame) -> DataFrame:
    """(project, type, source, target) of single-file components: SELECTS from the dashed name, INJECTS of composables, and
    RENDERS of the components whose tags a template holds, by what the script imports or by their dashed names."""
    v = files.where("language = 'vue' and content is not null")
    stem = F.regexp_extract("rel_path", r"([^/]+)\.vue$", 1)
    given = F.regexp_extract("content", r"\bname\s*:\s*['\"](\w+)['\"]", 1)
    pascal = F.regexp_replace(F.initcap(F.regexp_replace(stem, "[-_]", " ")), " ", "")
    name = F.when(given != "", given).when(stem.rlike("[-_]"), pascal).otherwise(stem)
    k = v.select("project", name.alias("name"), F.regexp_extract("content", r"<script[^>]*>([\s\S]*?)</script>", 1).alias("script"), F.regexp_extract("content", r"<template[^>]*>([\s\S]*)</template>", 1).alias("template"))
    selects = k.select("project", F.lit("SELECTS").alias("type"), kebab(F.col("name")).alias("source"), F.col("name").alias("target"))
    injects = k.select("project", F.lit("INJECTS").alias("type"), F.col("name").alias("source"), F.explode(_all(F.col("script"), r"\b(use[A-Z]\w*)\s*\(")).alias("target"))
    tags = F.filter(F.array_distinct(_all(F.col("template"), r"<([A-Za-z][\w-]*)")), lambda t: ~F.lower(t).isin(*HTML_TAGS) & t.rlike("^[A-Z]|-"))
    imported = F.array_distinct(F.concat(_all(F.col("script"), r"import\s+(\w+)\s+from"), F.flatten(F.transform(_all(F.col("script"), r"import\s*\{([^}]*)\}"), lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"(\w+)\s*$", 1))))))
    used = k.select("project", F.col("name").alias("source"), F.transform(imported, lambda i: F.struct(kebab(i).alias("tag"), i.alias("target"))).alias("imports"), tags.alias("tags")).select("project", "source", "imports", F.explode("tags").alias("tag")).withColumn("dashed", F.when(F.col("tag").rlike("^[A-Z]"), kebab(F.col("tag"))).otherwise(F.col("tag")))
    by_import = F.try_element_at(F.filter("imports", lambda i: i["tag"] == F.col("dashed")), F.lit(1))["target"]
    known = k.select("project", kebab(F.col("name")).alias("dashed"), F.col("name").alias("known")).distinct()
    renders = used.withColumn("by_import", by_import).join(known, ["project", "dashed"], "left").select("project", F.lit("RENDERS").alias("type"), "source", F.coalesce("by_import", "known").alias("target")).where("target is not null")
    return selects.unionByName(injects).unionByName(renders).distinct()


def jsx_edges(files: DataFrame) -> DataFrame:
    """(project, framework, type, source, target): what the components of script files render, of files that import a JSX
    framework; the first function or class in capitals is the file's component."""
    text = F.col("content")
    react, solid = text.rlike(r"from\s+['\"]react(?:['\"]|/)"), text.rlike(r"from\s+['\"]solid-js")
    framework = F.when(solid & (~react | text.rlike("createSignal|createMemo")), "solid").when(react, "react")
    root = F.regexp_extract(text, r"(?:function|class|const)\s+([A-Z]\w*)", 1)
    tags = F.filter(F.array_distinct(_all(text, r"<([A-Z]\w*)[\s/>]")), lambda t: (t != "Fragment") & ~t.startswith("Suspense"))
    rows = files.where(F.col("language").isin(*SCRIPTS) & ~F.col("rel_path").rlike(r"\.component\.tsx?$")).select("project", framework.alias("framework"), root.alias("source"), F.explode(tags).alias("target"))
    return rows.where("framework is not null and source <> '' and source <> target").select("project", "framework", F.lit("RENDERS").alias("type"), "source", "target").distinct()


def ci_system(path: Column) -> Column:
    """The CI system whose pipeline a file holds, by its path, else null."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    yaml = path.rlike(r"\.ya?ml$")
    return (
        F.when(path == ".gitlab-ci.yml", "gitlab").when(path.startswith(".github/workflows/") & yaml, "github").when((name == "Jenkinsfile") | name.endswith(".jenkinsfile"), "jenkins").when(path == ".circleci/config.yml", "circleci")
        .when((path == "azure-pipelines.yml") | (path.startswith(".azure-pipelines/") & yaml), "azure").when(path == "bitbucket-pipelines.yml", "bitbucket")
    )


def deployments(jobs: DataFrame) -> DataFrame:
    """(job, type, summary) of ``jobs(job, script)``: DEPLOYS and BUILDS_IMAGE by the commands of a script, each once a job."""
    text = F.col("script")
    kinds = F.array_compact(F.array(F.when(text.rlike(r"terraform (?:apply|plan)|kubectl apply|helm (?:install|upgrade)"), "DEPLOYS"), F.when(text.rlike("docker (?:build|push)"), "BUILDS_IMAGE")))
    first = F.trim(F.split(text, "\n")[0])
    return jobs.select("job", F.explode(kinds).alias("type"), F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 77), F.lit("..."))).otherwise(first).alias("summary"))


def iac_kind(path: Column, content: Column) -> Column:
    """The infrastructure tool that a file belongs to, by its name and content, else null."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    return (
        F.when(name == "cdk.json", "cdk").when(name.rlike(r"Stack\.(?:ts|py)$"), "cdk").when(name.rlike(r"^Pulumi\.(?:.*\.)?ya?ml$"), "pulumi").when(name.endswith(".tf"), "terraform").when(name == "Chart.yaml", "helm")
        .when(name.rlike(r"^(?:.*\.)?template\.ya?ml$") | content.contains("AWSTemplateFormatVersion"), "cloudformation")
    )


def matlab_or_not(content: Column) -> Column:
    """The language of a ``.m`` file by the markers in its first 4,096 characters, else by its comments."""
    head = F.substring(F.coalesce(content, F.lit("")), 1, 4096)
    held = lambda words: sum((F.contains(head, F.lit(w)).cast("int") for w in words[1:]), F.contains(head, F.lit(words[0])).cast("int"))
    # What tells the languages apart.
    objc = held(("#import", "#include", "@interface", "@implementation", "@protocol", "@property", "NSObject", "NSString"))
    magma, matlab = held(("intrinsic", "forward", "declare verbose")), held(("function ", "classdef ", "end\n", "end\r"))
    percent, slashes = F.regexp_count(head, F.lit(r"(?m)^\s*%")), F.regexp_count(head, F.lit(r"(?m)^\s*//"))
    return F.when(objc >= 2, "objectivec").when(magma >= 1, "magma").when(matlab >= 1, "matlab").when(percent > slashes, "matlab").when(slashes > 0, "objectivec").otherwise("matlab")


def configured_language(path: Column, found: Column, *mappings: dict[str, str]) -> Column:
    """The language of a file by the users' mappings of extensions, later ones first, else the one found."""
    merged = {k.lower().lstrip("."): v for m in mappings for k, v in m.items()}
    if not merged:
        return found
    table = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))], found)


def async_topics(nodes: DataFrame) -> DataFrame:
    """(project, id, topic, kind) of the channels that properties name for a broker; a node may name several."""
    # Property and broker.
    kinds = {"kafka_topic": "kafka", "rabbitmq_queue": "rabbitmq", "redis_channel": "redis"}
    each = F.array(*[F.struct(F.get_json_object("properties", f"$.{k}").alias("topic"), F.lit(v).alias("kind")) for k, v in kinds.items()])
    return nodes.where("label = 'Channel'").select("project", "id", F.explode(each).alias("t")).select("project", "id", "t.topic", "t.kind").where("topic is not null")
