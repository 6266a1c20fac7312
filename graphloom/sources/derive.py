"""Edges derived from source text: imports, routes, channels, and the links between projects that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import route_template

# Import statements by language; group 1 is what they name.
IMPORTS = {
    "python": (r"(?m)^\s*from\s+([\w.]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)"),
    "javascript": (r"\bfrom\s+['\"]([^'\"\n]+)['\"]", r"\brequire\(\s*['\"]([^'\"\n]+)['\"]", r"(?m)^\s*import\s+['\"]([^'\"\n]+)['\"]"),
    "rust": (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",),
    "go": (r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"\n]+)\"", r"(?m)^\s+(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
    "c": (r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",),
    "csharp": (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",),
}
# Languages that share import statements.
SAME_IMPORTS = {"typescript": "javascript", "tsx": "javascript", "vue": "javascript", "svelte": "javascript", "kotlin": "java", "scala": "java", "groovy": "java", "cpp": "c", "objectivec": "c"}
# Route declarations of web frameworks; groups 1 and 2 are method and path.
ROUTES = (
    r"\b(?:app|router|server|r|e|g|mux|api|group|engine)\.(get|post|put|patch|delete|head|options|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*[\"'`](/[^\"'`\n]*)[\"'`]",
    r"@(?:\w+\.)?(get|post|put|patch|delete|Get|Post|Put|Patch|Delete)(?:Mapping)?\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"'](/?[^\"'\n]*)[\"']",
    r"HandleFunc\(\s*\"(GET|POST|PUT|PATCH|DELETE)\s+(/[^\"\n]*)\"",
)
# Calls that send to or listen on a channel of a literal name; group 1 is the name.
EMITS = r"\b\w+\.(?:emit|publish|send|dispatch|trigger|produce|basicPublish)\(\s*[\"'`]([\w.:/-]+)[\"'`]"
LISTENS = r"\b\w+\.(?:on|once|subscribe|addEventListener|addListener|consume|listen)\(\s*[\"'`]([\w.:/-]+)[\"'`]"


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports(files: DataFrame) -> DataFrame:
    """(rel_path, target): what each of ``files(rel_path, language, content)`` imports; other languages import nothing."""
    family, found = F.col("language"), F.array().cast("array<string>")
    for lang, other in SAME_IMPORTS.items():
        family = F.when(F.col("language") == lang, other).otherwise(family)
    for lang, patterns in IMPORTS.items():
        found = F.when(F.col("family") == lang, F.concat(*[_every(F.col("content"), p) for p in patterns])).otherwise(found)
    return files.withColumn("family", family).select("rel_path", F.explode(found).alias("target")).distinct()


def routes(files: DataFrame) -> DataFrame:
    """(project, rel_path, method, path, template) of the routes that ``files(project, rel_path, content)`` declare."""
    pairs = [F.arrays_zip(_every(F.col("content"), p).alias("m"), _every(F.col("content"), p, 2).alias("p")) for p in ROUTES]
    same = [F.transform(x, lambda e: F.struct(e["m"].alias("m"), e["p"].alias("p"))) for x in pairs]
    each = files.select("project", "rel_path", F.explode(F.concat(*same)).alias("r"))
    path = F.when(F.col("r.p").startswith("/"), F.col("r.p")).otherwise(F.concat(F.lit("/"), F.col("r.p")))
    return each.select("project", "rel_path", F.upper("r.m").alias("method"), path.alias("path"), route_template(path).alias("template")).distinct()


def channels(files: DataFrame) -> DataFrame:
    """(project, rel_path, way, channel), way EMITS or LISTENS; names that aren't literal are left out."""
    return files.select("project", "rel_path", F.explode(F.concat(_tagged(EMITS, "EMITS"), _tagged(LISTENS, "LISTENS"))).alias("c")).select("project", "rel_path", "c.way", "c.channel").distinct()


def _tagged(pattern: str, way: str) -> Column:
    return F.transform(_every(F.col("content"), pattern), lambda c: F.struct(F.lit(way).alias("way"), c.alias("channel")))


def shared_between_projects(rows: DataFrame, key: list[str], links: DataFrame) -> DataFrame:
    """(source_project, target_project, key..., n): what linked projects have in common, in both directions.

    Rows are counted per project and key before projects meet, so a key that very many rows hold isn't paired row by row.
    ``links(source_project, target_project)`` is read as undirected; a project isn't paired with itself.
    """
    held = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).groupBy("project", *key).agg(F.count("*").alias("n"))
    both = links.select("source_project", "target_project").unionByName(links.select(F.col("target_project").alias("source_project"), F.col("source_project").alias("target_project"))).where("source_project <> target_project").distinct()
    a, b = held.select(F.col("project").alias("source_project"), *key, F.col("n").alias("na")), held.select(F.col("project").alias("target_project"), *key, F.col("n").alias("nb"))
    return both.join(a, "source_project").join(b, ["target_project", *key]).select("source_project", "target_project", *key, (F.col("na") * F.col("nb")).alias("n"))


def cross_routes(declared: DataFrame, called: DataFrame, links: DataFrame) -> DataFrame:
    """Linked projects that hold the same method and route template, over declared and called routes together."""
    cols = ["project", "rel_path", "method", "template"]
    return shared_between_projects(declared.select(*cols).unionByName(called.select(*cols)), ["method", "template"], links)


def linked_pairs(rows: DataFrame, key: list[str], links: DataFrame) -> DataFrame:
    """(source_id, target_id) of ``rows(project, id, key...)`` of linked projects that agree in the key, in both directions."""
    both = links.select("source_project", "target_project").unionByName(links.select(F.col("target_project").alias("source_project"), F.col("source_project").alias("target_project"))).where("source_project <> target_project").distinct()
    held = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    a, b = held.select(F.col("project").alias("source_project"), *key, F.col("id").alias("source_id")), held.select(F.col("project").alias("target_project"), *key, F.col("id").alias("target_id"))
    return both.join(a, "source_project").join(b, ["target_project", *key]).select("source_id", "target_id").distinct()


def trace_edges(traces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id) of ``traces(project, traces)``, JSON lists of objects with source and target names.

    A name stands for the node of the least id that has it in the project; entries that name no node are left out.
    """
    each = traces.select("project", F.explode(F.from_json("traces", "array<struct<source: string, target: string>>")).alias("t")).select("project", "t.source", "t.target")
    first = nodes.groupBy("project", "name").agg(F.min("id").alias("id"))
    a, b = first.select("project", F.col("name").alias("source"), F.col("id").alias("source_id")), first.select("project", F.col("name").alias("target"), F.col("id").alias("target_id"))
    return each.join(a, ["project", "source"]).join(b, ["project", "target"]).select("source_id", "target_id").distinct()
