"""Queries over the graph store and source trees: what inserts, upserts, links, deletes and walks leave behind."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from graphloom.operators.incremental import run_increment
from graphloom.operators.incremental import VersionedTarget
from graphloom.plans.lineage import shared_dir
from graphloom.queries.samples import SAMPLES, Registry, frame, values
from graphloom.sources.repository import repository_files
from graphloom.sources.store import GraphStore, with_defaults
from graphloom.streaming import calls as stream
from graphloom.tables import table

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES


def _store(spark) -> GraphStore:
    return GraphStore(spark, f"{shared_dir(spark)}/graphloom/store-{uuid.uuid4().hex}")


def stored(sql: str):
    """Register a function of an empty store and the directory."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(_store(spark), spark, d)
        ORACLES[f.__name__] = sql
        return f

    return add


@stored("SELECT project, qualified_name, min(id) AS id FROM nodes GROUP BY ALL")
def sc8_batch_insert_of_nodes(store, spark, d):
    """All nodes, inserted in three batches of which the later ones repeat keys: the first batch's rows stay."""
    nodes = table(spark, d, "nodes")
    for rest in (0, 1, 2):
        store.insert("nodes", nodes.where(F.col("id") % 3 >= rest if rest == 0 else F.col("id") % 3 == rest), "id")
    return store.read("nodes").select("project", "qualified_name", "id")


@stored("SELECT source_id, target_id, type, min(id) AS id FROM edges GROUP BY ALL")
def sc9_batch_insert_of_edges(store, spark, d):
    edges = table(spark, d, "edges")
    store.insert("edges", edges, "id")
    store.insert("edges", edges.withColumn("id", F.col("id") + 1_000_000_000), "id")
    return store.read("edges").select("source_id", "target_id", "type", "id")


@stored("SELECT name, CASE WHEN length(name) % 2 = 0 THEN '/moved' ELSE root_path END AS root_path FROM projects UNION ALL SELECT 'added', '/added'")
def sc11_upserted_projects(store, spark, d):
    projects = table(spark, d, "projects").select("name", "root_path")
    store.put("projects", projects)
    store.put("projects", projects.where("length(name) % 2 = 0").select("name", F.lit("/moved").alias("root_path")).unionByName(spark.createDataFrame([("added", "/added")], "name string, root_path string")))
    return store.read("projects")


@stored("SELECT 'nodes' AS what, count(*) AS n FROM nodes WHERE project <> 'meridian-core' UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT source_id, target_id, type FROM edges WHERE project <> 'meridian-core') UNION ALL SELECT 'links', 1")
def sc14_after_deleting_a_project(store, spark, d):
    store.put("nodes", table(spark, d, "nodes"))
    store.insert("edges", table(spark, d, "edges"), "id")
    store.put("projects", table(spark, d, "projects"))
    store.link("meridian-core", "other")
    store.put("project_links", spark.createDataFrame([("x", "y")], "source_project string, target_project string"))
    store.delete_project("meridian-core")
    count = lambda name, what: store.read(name).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("nodes", "nodes").unionByName(count("edges", "edges")).unionByName(count("project_links", "links"))


@stored("SELECT 0::BIGINT AS n, true AS sized")
def sc28_cleared_edges(store, spark, d):
    """No edge is left after clearing them before a rebuild; the store still tells its size."""
    store.insert("edges", table(spark, d, "edges"), "id")
    store.delete_edges()
    return store.read("edges").agg(F.count("*").alias("n"), F.lit(store.sizes()["edges"] > 0).alias("sized"))


@stored("SELECT id, source_id, target_id, type FROM (SELECT min(id) AS id, source_id, target_id, type FROM edges GROUP BY ALL) WHERE NOT starts_with(type, 'T')")
def sc15_deleted_edge_prefix(store, spark, d):
    store.insert("edges", table(spark, d, "edges").select("id", "source_id", "target_id", "type"), "id")
    store.delete_edges("T")
    return store.read("edges")


@stored(values(("source_project string, target_project string", [("a", "c"), ("c", "a")])))
def sc27_linked_and_unlinked(store, spark, d):
    for pair in (("a", "b"), ("a", "c"), ("b", "a")):
        store.link(*pair)
    store.unlink("b", "a")
    return store.read("project_links")


@stored(values(("id bigint, title string", [(2, "first"), (1, "second")])))
def sc31_single_inserts(store, spark, d):
    schema = "id bigint, project string, title string, created_at string"
    for row in ((1, "p", "second", "2024-02-01"), (2, "p", "early", "2024-01-01"), (2, "p", "first", "2024-01-01")):
        store.put("decisions", spark.createDataFrame([row], schema))
    return store.read("decisions").orderBy("created_at").select("id", "title")


@stored(values(("id bigint, agent_name string, model_name string, input_tokens bigint", [(r[0], r[6] or "unknown", r[7] or "unknown", r[8] or 0) for r in SAMPLES["tool_calls"][1]] + [(99, "unknown", "unknown", 0)])))
def sc30_migrated_calls(store, spark, d):
    """Calls recorded under an earlier schema beside those of the present one, with the later columns' defaults."""
    store.put("tool_calls", spark.createDataFrame([(99, "list_projects")], "id bigint, tool_name string"))
    store.put("tool_calls", frame(spark, SAMPLES["tool_calls"]))
    return with_defaults(store.read("tool_calls"), {"agent_name": "unknown", "model_name": "unknown", "input_tokens": 0}).select("id", "agent_name", "model_name", "input_tokens")


_TREE = {
    "src/a.py": "x = 1\n", "node_modules/b.js": "x", "build/c.ts": "x", "build/keep.ts": "y", ".gitignore": "build/*\n*.yml\n!build/keep.ts\n", ".gitlab-ci.yml": "a: b", ".github/workflows/ci.yml": "on: push", "d.unknown": "x", "Dockerfile": "FROM a", "sub/.gitignore": "local.py\n", "sub/local.py": "1", "sub/deep/local.py": "2", "sub/other.py": "3", "Pods/x.swift": "4",
}


def _tree(spark) -> str:
    """The sample tree, written to the shared folder, which must be mounted."""
    root = f"{shared_dir(spark)}/graphloom/tree-{uuid.uuid4().hex}".removeprefix("file://")
    for name, text in _TREE.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    return root


_KEPT = [("src/a.py", "python"), ("build/keep.ts", "typescript"), (".gitlab-ci.yml", "yaml"), (".github/workflows/ci.yml", "yaml"), ("Dockerfile", "dockerfile"), ("sub/other.py", "python")]


@stored(values(("rel_path string, language string", _KEPT)))
def sc1_walked_tree(store, spark, d):
    return repository_files(spark, _tree(spark), content=False).select("rel_path", "language")


@stored(values(("rel_path string", [(p,) for p, _ in _KEPT if p.startswith(".git")])))
def sc2_rescued_ci_files(store, spark, d):
    return repository_files(spark, _tree(spark), content=False).where(F.col("language") == "yaml").select("rel_path")


@stored(values(("rel_path string, sha string, size bigint", [("src/a.py", "6a8ae3ee4f9fd9e0", 6)])).replace("'6a8ae3ee4f9fd9e0'", "substr(sha256('x = 1' || chr(10)), 1, 16)"))
def sc1_hashed_contents(store, spark, d):
    return repository_files(spark, _tree(spark)).where("rel_path = 'src/a.py'").select("rel_path", F.substring("sha256", 1, 16).alias("sha"), "size")


@stored("SELECT project, rel_path, arg_max(coalesce(lower(sha256), ''), observed_at) AS sha FROM file_hashes GROUP BY ALL")
def st3_index_after_increments(store, spark, d):
    """The index that increments over the scans leave: each key in the version of the last one."""
    log, target = table(spark, d, "file_hashes"), VersionedTarget(spark, f"{store.root}/index")
    scans = log.agg(F.max("scan_id")).first()[0] or 0
    for upto in (scans // 2, scans):
        state = log.where(F.col("scan_id") <= upto).groupBy("project", "rel_path").agg(F.max_by(F.coalesce(F.lower("sha256"), F.lit("")), "observed_at").alias("sha"))
        run_increment(state, target, ("project", "rel_path"), "sha", lambda changed: changed)
    return target.read()


@stored("SELECT event_type AS tool, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS calls FROM events GROUP BY ALL")
def st2_streamed_windows(store, spark, d):
    """The usage log as a stream, read to its end, its windows written out complete."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d if not os.path.isdir(path) else path).select(F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("ms"))
    out = f"{store.root}/windows"
    written = stream.call_windows(events).writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    written.option("checkpointLocation", f"{store.root}/stream").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("tool", "start", "calls")


@stored(values(("root string, files bigint", [("a", 2), ("a", 1), ("b", 1)])))
def st1_debounced_changes(store, spark, d):
    """Bursts of file events that end after two quiet seconds."""
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "y", "2024-01-01 00:00:01"), ("a", "x", "2024-01-01 00:00:02"), ("a", "x", "2024-01-01 00:00:09"), ("b", "x", "2024-01-01 00:00:03")]
    events = spark.createDataFrame(rows, "root string, rel_path string, t string").withColumn("ts", F.to_timestamp("t"))
    return stream.debounced(events).select("root", "files")
