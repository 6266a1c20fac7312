"""Graph tables on disk: first-writer inserts, upserts and deletes, each a new part of a versioned target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.incremental import VersionedTarget


def first_of_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of the rows of each key the first by ``order``."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__rn = 1").drop("__rn")


def insert_first(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Old rows and those new ones whose key is not held yet; of several new rows of a key the first by ``order``."""
    return old.unionByName(first_of_key(new, key, order).join(old.select(*key), list(key), "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows, and the old ones of other keys."""
    return old.join(new.select(*key), list(key), "left_anti").select(*new.columns).unionByName(new)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """The columns of a later schema: missing ones added, nulls filled, with the defaults' values."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


class GraphStore:
    """Tables (nodes, edges, file_hashes, project_links, decisions, tool_calls) below one folder, each a versioned target.

    A write appends a part with the rows and keys it touches and publishes it; readers keep the version they began with,
    and a failed write changes nothing.
    """

    KEYS = {"nodes": ["project", "qualified_name"], "edges": ["source_id", "target_id", "type"], "file_hashes": ["project", "rel_path"], "projects": ["name"], "project_links": ["source_project", "target_project"], "decisions": ["project", "id"], "code_content": ["project", "qualified_name"], "tool_calls": ["id"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _target(self, name: str) -> VersionedTarget:
        return VersionedTarget(self.spark, f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        """The current rows of a table."""
        df = self._target(name).read()
        if df is None:
            raise KeyError(f"table {name} has no version yet")
        return df

    def _append(self, name: str, rows: DataFrame | None, touched: DataFrame, gone: bool = False) -> int:
        target, key = self._target(name), self.KEYS[name]
        at = target.version()
        keys = touched.select(*key).distinct().withColumns({"version": F.lit(None).cast("string"), "gone": F.lit(gone)})
        return target.append(rows, keys, key, at)

    def insert(self, name: str, rows: DataFrame, order: str) -> int:
        """Insert rows of keys not held yet (first writer wins; of several new rows of a key the first by ``order``)."""
        key = self.KEYS[name]
        held = self._target(name).state(key)
        fresh = first_of_key(rows, key, order)
        if held is not None:
            fresh = fresh.join(held.select("__key"), F.struct(*key) == F.col("__key"), "left_anti")
        return self._append(name, fresh, fresh)

    def put(self, name: str, rows: DataFrame) -> int:
        """Insert or replace rows by key."""
        return self._append(name, rows, rows)

    def delete(self, name: str, condition) -> int:
        """Delete the rows of a condition: their keys are marked as gone, nothing is rewritten."""
        return self._append(name, None, self.read(name).where(condition), gone=True)

    def link(self, a: str, b: str) -> int:
        """Link two projects in both directions; again has no effect."""
        rows = self.spark.createDataFrame([(a, b), (b, a)], "source_project string, target_project string")
        return self.put("project_links", rows)

    def unlink(self, a: str, b: str) -> int:
        """Remove the link of two projects."""
        return self.delete("project_links", F.struct("source_project", "target_project").isin(F.struct(F.lit(a), F.lit(b)), F.struct(F.lit(b), F.lit(a))))

    def delete_edges(self, prefix: str = "") -> int:
        """Delete the edges whose type starts with a prefix; without one all edges."""
        return self.delete("edges", F.col("type").startswith(prefix))

    def delete_project(self, project: str) -> None:
        """Delete a project's rows from all tables that have versions."""
        held = lambda name: self._target(name).version()
        for name in self.KEYS:
            if name != "project_links" and held(name):
                self.delete(name, F.col("name" if name == "projects" else "project") == project)
        if held("project_links"):
            self.delete("project_links", (F.col("source_project") == project) | (F.col("target_project") == project))

    def sizes(self) -> dict[str, int]:
        """Bytes of each table that has versions, all kept parts included."""
        fs = lambda n: self._target(n)
        return {n: fs(n)._fs.getContentSummary(fs(n)._path(f"{self.root}/{n}")).getLength() for n in self.KEYS if fs(n).version()}
