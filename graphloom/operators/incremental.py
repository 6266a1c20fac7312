"""Processing only new or changed records: the published target is the state.

The target stores key and version of every source record it was made from. A run anti-joins the source against them in
both directions, processes what has no counterpart, and publishes the next target version by one atomic create; whatever
fails before leaves the previous version current, so nothing is skipped or repeated.

A version is a manifest of parts. A part holds the output rows of one run and the keys it processed or found gone, so a
run writes as much as has changed; a reader takes of each key the rows of the last part that names it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.lineage import SharedTables, delete_path

KEY = ("project", "rel_path")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key and version the other side doesn't hold; null equals null."""
    r = right.select(*[F.col(c).alias(f"__{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(r, cond, "left_anti")


def changed_records(source: DataFrame, target: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Keys that are new, changed or gone, with ``change`` in (new, changed, gone), one row each.

    ``source`` and ``target`` hold one row per key; further columns are ignored. Rows of the source without an equal
    (key, version) in the target are new or changed, and keys of the target without a row in the source are gone.
    Null keys and versions compare as values; empty tables are valid on either side.
    """
    s, t = source.select(*key, version), target.select(*key, version)
    fresh = unmatched(s, t, [*key, version]).select(*key, F.lit(True).alias("in_source"), F.lit(False).alias("in_target"))
    old = unmatched(t, s, [*key, version]).select(*key, F.lit(False).alias("in_source"), F.lit(True).alias("in_target"))
    both = fresh.unionByName(old).groupBy(*key).agg(F.max("in_source").alias("a"), F.max("in_target").alias("b"))
    return both.select(*key, F.when(F.col("a") & F.col("b"), "changed").when(F.col("a"), "new").otherwise("gone").alias("change"))


def file_versions(log: DataFrame) -> DataFrame:
    """The state of each file over the scans: (project, rel_path, version, from_scan, to_scan), absent states left out.

    The state after a scan is taken from the row observed last among those delivered up to that scan, whatever order
    they came in; version is its sha256 in lower case. ``to_scan`` is the first scan with a later state, or null.
    Defined cases: is_deleted null means present; sha256 null counts as blank; rows without a scan_id can't be placed and
    are left out; observed_at null is older than any time; rows delivered twice count once.
    """
    state = F.struct(F.col("observed_at").alias("t"), F.when(F.coalesce("is_deleted", F.lit(False)), F.lit(None)).otherwise(F.lower(F.coalesce("sha256", F.lit("")))).alias("v"))
    # one exchange by file serves the grouping by scan and the windows
    per_scan = log.where("scan_id is not null").select(*KEY, "scan_id", "observed_at", "is_deleted", "sha256").repartition(*KEY).groupBy(*KEY, "scan_id").agg(F.max(state).alias("s"))
    order = W.partitionBy(*KEY).orderBy("scan_id")
    running = per_scan.select(*KEY, F.col("scan_id").alias("from_scan"), F.max("s").over(order).alias("s"), F.lead("scan_id").over(order).alias("to_scan"))
    return running.select(*KEY, F.col("s.v").alias("version"), "from_scan", "to_scan").where("version is not null")


def successful_runs(runs: DataFrame) -> DataFrame:
    """(run_id, project, at_scan, before_scan): runs that kept their results, with the scan of the project's previous one."""
    done = runs.where("status = 'success' and run_id is not null and scan_id is not null").select("run_id", F.col("project").alias("run_project"), F.col("scan_id").alias("at_scan")).distinct()
    return done.withColumn("before_scan", F.lag("at_scan").over(W.partitionBy("run_project").orderBy("run_id")))


def replay_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (run_id, project, rel_path): what each successful run had to process.

    The runs are replayed as increments into a target: the k-th successful runs of all projects are one increment, whose
    source is the state of their projects at their scans. In the replay files and versions go by numbers, given once where
    the states are made, so that what each increment moves is narrow. Failed, aborted and running runs publish nothing, so their
    files stay due. There are as many increments as a project has successful runs; each reads the states once, without a
    shuffle, and joins them with what the target holds of the same projects.
    """
    spark = log.sparkSession
    tables = SharedTables(spark, "replay")
    numbered = file_versions(log).withColumn("id", F.monotonically_increasing_id())
    least = lambda *by: F.min("id").over(W.partitionBy(*by))
    states = tables.put(numbered.select(*KEY, "from_scan", "to_scan", least(*KEY).alias("file"), least(*KEY, "version").alias("version")))
    order = W.partitionBy("run_project").orderBy("run_id")
    ranked = tables.put(successful_runs(runs).withColumn("nth", F.row_number().over(order)))
    target, published = VersionedTarget(spark, f"{tables.root}/target"), []
    for nth in range(1, (ranked.agg(F.max("nth")).first()[0] or 0) + 1):
        due = ranked.where(F.col("nth") == nth)
        holds = (F.col("from_scan") <= F.col("at_scan")) & (F.col("to_scan").isNull() | (F.col("at_scan") < F.col("to_scan")))
        source = states.join(due, F.col("project").eqNullSafe(F.col("run_project")) & holds).select("project", "file", "version")
        before = target.version()
        if run_increment(source, target, ("project", "file"), "version", None, scope=due.select(F.col("run_project").alias("project")), compact_after=None) > before:
            published.append((before + 1, nth))
    if not published:
        return states.select(F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), *KEY).limit(0)
    nth_of = reduce(lambda column, x: column.when(F.col("__part") == x[0], x[1]), published[1:], F.when(F.col("__part") == published[0][0], published[0][1]))
    changes = target.changes().select("project", "file", nth_of.alias("change_nth"))
    placed = changes.join(ranked, F.col("project").eqNullSafe(F.col("run_project")) & (F.col("nth") == F.col("change_nth"))).select("run_id", "file")
    return placed.join(states.select("file", *KEY).distinct(), "file").select("run_id", *KEY)


class VersionedTarget:
    """A target table whose versions are published atomically.

    ``<root>/log/<number>`` is the manifest of a version: its parts in order, each with a number, a folder of output rows
    and a folder of keys (key, version, gone). Manifests are created exclusively, so of two writers that start from the
    same version one fails; a reader sees the whole old or the whole new version. Files of a run that failed before its
    manifest are never read, and ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _numbers(self) -> list[int]:
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(log) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The number of the current version; 0 before the first."""
        return max(self._numbers(), default=0)

    def parts(self, number: int | None = None) -> list[dict]:
        """The parts of the current (or a given) version, oldest first."""
        at = self.version() if number is None else number
        if not at:
            return []
        stream = self._fs.open(self._path(f"{self.root}/log/{at:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _each(self, parts: list[dict], which: str) -> DataFrame | None:
        """The rows of several parts with their part's number; parts of one schema are one scan, and none is inferred."""
        by_schema: dict[str, list[str]] = {}
        for p in parts:
            if p[which]:
                by_schema.setdefault(p[f"{which}_schema"], []).append(f"{self.root}/{p[which]}")
        scans = [self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths) for schema, paths in by_schema.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else None

    def changes(self, number: int | None = None) -> DataFrame | None:
        """(key..., version, gone, __part): all that the runs behind a version processed or found gone."""
        return self._each(self.parts(number), "keys")

    def state(self, key: Sequence[str], number: int | None = None) -> DataFrame | None:
        """(__key, version): key (as a struct) and version of every source record the target was made from."""
        every = self.changes(number)
        if every is None:
            return None
        last = every.groupBy(F.struct(*key).alias("__key")).agg(F.max_by(F.struct("version", "gone"), "__part").alias("s"))
        return last.where("not s.gone").select("__key", F.col("s.version").alias("version"))

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of the current (or a given) version, or None before the first."""
        parts = self.parts(number)
        if not parts:
            return None
        rows = self._each(parts, "rows")
        later = [p for p in parts[1:] if p["keys"]]
        if rows is None or not later:
            return rows if rows is None else rows.drop("__part")
        key = parts[-1]["key"]
        named = self._each(later, "keys").groupBy(F.struct(*key).alias("__key")).agg(F.max("__part").alias("__last"))
        kept = rows.withColumn("__own", F.struct(*key)).join(named, F.col("__own") == F.col("__key"), "left")
        return kept.where("__last is null or __part >= __last").drop("__part", "__own", "__key", "__last")

    def publish(self, rows: DataFrame, based_on: int) -> int:
        """Write a whole version and make it current; raises if another writer published since ``based_on``."""
        return self._commit(rows, None, (), [], based_on)

    def append(self, rows: DataFrame | None, keys: DataFrame, key: Sequence[str], based_on: int, unless_empty: bool = False) -> int:
        """Publish the version ``based_on`` with a further part: rows, and keys (key..., version, gone) they replace.

        With ``unless_empty`` a part without keys is no new version, and ``based_on`` stays the current one.
        """
        return self._commit(rows, keys, key, self.parts(based_on), based_on, unless_empty)

    def compact(self, key: Sequence[str], based_on: int) -> int:
        """Publish the version ``based_on`` again as one part."""
        state = self.state(key, based_on)
        keys = state and state.select("__key.*", "version", F.lit(False).alias("gone"))
        return self._commit(self.read(number=based_on), keys, key, [], based_on)

    def _commit(self, rows: DataFrame | None, keys: DataFrame | None, key: Sequence[str], parts: list[dict], based_on: int, unless_empty: bool = False) -> int:
        name, number = uuid.uuid4().hex, based_on + 1
        part = {"part": number, "key": list(key), "rows": None, "keys": None}
        for which, df in (("rows", rows), ("keys", keys)):
            if df is not None:
                part[which], numbered = f"{which}/{name}", df.withColumn("__part", F.lit(number))
                part[f"{which}_schema"] = numbered.schema.json()
                numbered.write.parquet(f"{self.root}/{part[which]}")
        if unless_empty and not self._each([part], "keys").count():
            delete_path(self.spark, f"{self.root}/{part['keys']}")
            return based_on
        if not self._create(f"{self.root}/log/{number:012d}", json.dumps([*parts, part])):
            for which in ("rows", "keys"):
                delete_path(self.spark, f"{self.root}/{which}/{name}")
            raise RuntimeError(f"version {number} was published by another writer")
        return number

    def _create(self, name: str, text: str) -> bool:
        """Create a file with its whole content, or return False if it exists; one step for other writers and readers.

        On a local file system a hard link does it, elsewhere a rename that doesn't replace. Object stores without either
        need a file system client that makes rename exclusive.
        """
        entry, part = self._path(name), self._path(f"{self.root}/pending/{uuid.uuid4().hex}")
        self._fs.mkdirs(entry.getParent())
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                file = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(file(entry), file(part))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(part, entry, self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            if self._fs.exists(entry):
                return False
            raise
        finally:
            self._fs.delete(part, False)
        return True

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> int:
        """Remove all but the last ``keep`` versions and the folders that none of these names; returns how many folders.

        Folders changed within ``older_than_s`` are left, since a writer may be about to publish them.
        """
        numbers = self._numbers()
        named = {p[w] for n in numbers[-keep:] for p in self.parts(n) for w in ("rows", "keys") if p[w]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{n:012d}"), False)
        gone, now = 0, time.time()
        for which in ("rows", "keys"):
            folder = self._path(f"{self.root}/{which}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{which}/{s.getPath().getName()}" not in named and now - s.getModificationTime() / 1000 >= older_than_s:
                    gone += self._fs.delete(s.getPath(), True)
        return gone


def run_increment(
    source: DataFrame,
    target: VersionedTarget,
    key: Sequence[str],
    version: str,
    process: Callable[[DataFrame], DataFrame] | None,
    scope: DataFrame | None = None,
    compact_after: int | None = 32,
) -> int:
    """One run: process the source records whose (key, version) the target lacks, and publish the next target version.

    Source and target meet in one full join over keys and versions, which is the anti-join in both directions; only what
    it finds different is processed and written. ``process`` gets the new and changed source rows and must keep the key
    columns; its output may hold any number of rows a record. Without ``process`` the target holds keys and versions
    alone, which ``changes`` gives. Output of records that changed or are gone is dropped.
    ``scope`` names the values of a prefix of the key for which the source is complete (all by default); keys of the
    target outside it are left as they are. After ``compact_after`` parts the target is written anew as one part.
    Returns the current version; if nothing changed, no version is written. A run that dies before publishing has no
    effect, and repeating it does the same work once.
    Defined cases: null keys and versions compare as values; the source holds one row for each key (of several, each
    that differs from the target is processed); an empty source makes all of the target gone; an empty target all new.
    """
    at = target.version()
    offered = source.select(F.struct(*key).alias("__key"), F.col(version).alias("offered"), F.lit(True).alias("in_source"))
    held = target.state(key, at)
    if held is None:
        change = offered.select("__key", "offered", F.lit("new").alias("change"))
    else:
        if scope is not None:
            inside = scope.select(F.struct(*scope.columns).alias("__scope")).distinct()
            held = held.join(inside, F.struct(*[F.col(f"__key.{c}").alias(c) for c in scope.columns]) == F.col("__scope"), "left_semi")
        held = held.select(F.col("__key").alias("__held"), F.col("version").alias("held"))
        both = offered.join(held, F.col("__key") == F.col("__held"), "full").where("in_source is null or __held is null or not (offered <=> held)")
        kind = F.when(F.col("__held").isNull(), "new").when(F.col("in_source").isNull(), "gone").otherwise("changed")
        change = both.select(F.coalesce("__key", "__held").alias("__key"), "offered", kind.alias("change"))
    as_keys = lambda df: df.select("__key.*", F.col("offered").alias("version"), (F.col("change") == "gone").alias("gone"))
    if process is None:
        now = target.append(None, as_keys(change), key, at, unless_empty=True)
    else:
        tables = SharedTables(source.sparkSession, "increment")
        change, n = tables.counted(change)
        if not n:
            tables.close()
            return at
        wanted = change.where("change <> 'gone'").select(F.col("__key").alias("__due"))
        now = target.append(process(source.join(wanted, F.struct(*key) == F.col("__due"), "left_semi")), as_keys(change), key, at)
        tables.close()
    if compact_after is not None and len(target.parts(now)) > compact_after:
        now = target.compact(key, now)
    return now
