"""The history of a repository: its log as rows, and what files change how often and together."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates commits and fields in the log that is read.
COMMIT, FIELD = "\x1e", "\x1f"
#: Commits that two files must share to be linked.
TOGETHER = 3


def read_log(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(log): the log of a repository on the driver's file system, one row a commit; ``limit`` keeps the latest ones."""
    command = ["git", "-C", root, "log", "--numstat", f"--format={COMMIT}%H{FIELD}%ct", *([f"-{limit}"] if limit is not None else [])]
    out = subprocess.run(command, capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(c,) for c in out.split(COMMIT) if c.strip()], "log string")


def changes(logs: DataFrame) -> DataFrame:
    """(commit, at, path, added, removed) of ``logs(log)``; binary files have no counts."""
    rows = logs.select(F.split("log", "\n").alias("lines")).select(F.split(F.col("lines")[0], FIELD).alias("head"), F.explode("lines").alias("line"))
    fields = F.split("line", "\t")
    kept = rows.where(F.size(fields) == 3).select(F.col("head")[0].alias("commit"), F.col("head")[1].cast("bigint").alias("at"), fields.alias("f"))
    return kept.select("commit", "at", F.col("f")[2].alias("path"), F.col("f")[0].try_cast("bigint").alias("added"), F.col("f")[1].try_cast("bigint").alias("removed"))


def file_statistics(changed: DataFrame) -> DataFrame:
    """(path, commits, churn, last_at, last_commit) of each file: how often and how much it changed, and when last."""
    churn = F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))
    return changed.groupBy("path").agg(F.count_distinct("commit").alias("commits"), F.sum(churn).alias("churn"), F.max("at").alias("last_at"), F.max_by("commit", F.struct("at", "commit")).alias("last_commit"))


def changed_together(changed: DataFrame, least: int = TOGETHER) -> DataFrame:
    """(a, b, together) of files that share ``least`` commits or more.

    Files of fewer commits are left out first: none of their pairs can count. A commit that touches very many files makes
    as many pairs as it has of them.
    """
    held = changed.select("commit", "path").distinct()
    often = held.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("path")
    kept = held.join(often, "path", "left_semi")
    a, b = kept.select("commit", F.col("path").alias("a")), kept.select("commit", F.col("path").alias("b"))
    return a.join(b, "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def recently_modified(changed: DataFrame, symbols: DataFrame, since: int) -> DataFrame:
    """(id, commits): symbols of files that changed at or after a time, with the number of such commits."""
    late = changed.where(F.col("at") >= since).groupBy(F.col("path").alias("file_path")).agg(F.count_distinct("commit").alias("commits"))
    return symbols.join(late, "file_path").select("id", "commits")
