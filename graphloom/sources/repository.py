"""Reading a source tree: walk with ignore rules, languages, content hashes."""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.columns import language
from graphloom.plans.lineage import SharedTables

# CI files that are read even where they are ignored.
CI_FILES = (".gitlab-ci.yml", "Jenkinsfile", "azure-pipelines.yml", "bitbucket-pipelines.yml", ".circleci/config.yml")


def ignore_pattern(line: str) -> tuple[re.Pattern, bool] | None:
    """An ignore rule as (pattern over the relative path, whether it takes back), or None for blanks and comments."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule.removeprefix("\\")
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule, out, i = rule.lstrip("/"), "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return re.compile(("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")), negated


def ignored(path: str, rules: list[tuple[str, re.Pattern, bool]]) -> bool:
    """Whether a path is ignored: of the rules (folder, pattern, negated) whose folder holds it, the last that fits decides."""
    out = False
    for folder, pattern, negated in rules:
        if path.startswith(folder) and pattern.match(path[len(folder) :]):
            out = not negated
    return out


def listed_tree(spark: SparkSession, base: str) -> DataFrame:
    """(rel_path, rules): the files below a mounted folder, with the text of those that hold ignore rules.

    A folder is listed by one task and its sub-folders in the next round, so there are as many rounds as the tree is deep.
    """
    tables = SharedTables(spark, "tree")
    entered = frozenset(fixed.EXCLUDED_FOLDERS)

    def entries(batches):
        for pdf in batches:
            rows = []
            for folder in pdf["folder"]:
                with os.scandir(os.path.join(base, folder)) as found:
                    for e in found:
                        path, rules = folder + e.name, None
                        if e.is_dir(follow_symlinks=False):
                            if e.name not in entered:
                                rows.append((path + "/", True, None))
                            continue
                        if e.name == ".gitignore":
                            with open(e.path, encoding="utf-8", errors="replace") as f:
                                rules = f.read()
                        rows.append((path, False, rules))
            yield pd.DataFrame(rows, columns=["rel_path", "is_folder", "rules"])

    folders, levels = spark.createDataFrame([("",)], "folder string"), []
    while not folders.isEmpty():
        level = tables.put(folders.mapInPandas(entries, "rel_path string, is_folder boolean, rules string"))
        levels.append(level.where("not is_folder").select("rel_path", "rules"))
        folders = level.where("is_folder").select(F.col("rel_path").alias("folder")).repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, levels)


def repository_files(spark: SparkSession, root: str, content: bool = True, known_only: bool = True) -> DataFrame:
    """(rel_path, language, size, sha256, content) of a source tree.

    The tree must be on a file system that all executors mount. Executors list it level by level and read contents, the
    latter only of files that remain; the driver holds the ignore rules alone. Folders of version control, caches and
    dependencies aren't entered, ignored files are left out by the tree's own rules (nested ones included), CI files are
    read regardless. Files of unknown language are left out unless ``known_only`` is false.
    """
    base = root.rstrip("/").removeprefix("file:")
    # Spark's own file sources skip names that begin with a dot or underscore, which source trees are full of
    listing = listed_tree(spark, base)
    rules = []
    for r in listing.where(F.col("rules").isNotNull()).select("rel_path", "rules").collect():  # one row for each ignore file
        rules += [(r["rel_path"].removesuffix(".gitignore"), *rule) for line in r["rules"].splitlines() if (rule := ignore_pattern(line))]

    def read(batches):
        for pdf in batches:
            bodies = []
            for path in pdf["rel_path"]:
                with open(os.path.join(base, path), "rb") as f:
                    bodies.append(f.read())
            yield pdf.assign(size=[len(b) for b in bodies], content=bodies)

    shared = spark.sparkContext.broadcast(rules)

    def keep(batches):
        for pdf in batches:
            yield pdf[[not ignored(p, shared.value) or p in CI_FILES or p.startswith(".github/workflows/") for p in pdf["rel_path"]]]

    ci = F.col("rel_path").isin(*CI_FILES) | F.col("rel_path").startswith(".github/workflows/")
    named = listing.select("rel_path").withColumn("language", language(F.col("rel_path")))
    wanted = named.where((F.col("language") != "unknown") | ci) if known_only else named
    kept = wanted.mapInPandas(keep, "rel_path string, language string") if rules else wanted
    files = kept.mapInPandas(read, "rel_path string, language string, size bigint, content binary")
    text = F.decode("content", "UTF-8").alias("content")
    return files.select("rel_path", "language", "size", F.sha2("content", 256).alias("sha256"), *([text] if content else []))
