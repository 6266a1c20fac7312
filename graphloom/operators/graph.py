"""Graph operators: neighbours, frontiers, paths, components, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.lineage import SharedTables


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge (least id) of each source, target and type."""
    return edges.groupBy("source_id", "target_id", "type").agg(F.min("id").alias("id"))


def with_ends(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("name", "label", "qualified_name", "file_path", "project")) -> DataFrame:
    """Edges with columns of both ends, prefixed ``s_`` and ``t_``."""
    s = nodes.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = nodes.select(F.col("id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return edges.join(s, "source_id").join(t, "target_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node that an edge touches; one exchange for both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def frontier(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth): every node within ``depth`` steps of the seeds (column id), with its least number of steps.

    One join of the new nodes with the edges a level; nodes seen before are anti-joined away. Each level is written to
    the shared folder, so plans don't grow with depth. Null ids and edges with a null end are never reached.
    """
    tables = SharedTables(edges.sparkSession, "frontier")
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    hop = edges.select(F.col(a).alias("from"), F.col(b).alias("to"))
    levels = [tables.put(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))]
    for d in range(1, depth + 1):
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        reached = levels[-1].join(hop, F.col("id") == F.col("from")).select(F.col("to").alias("id")).where("id is not null").distinct()
        new, n = tables.counted(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if not n:
            break
        levels.append(new)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path): every simple path of 1 to ``depth`` steps from the seeds, as an array of ids."""
    tables = SharedTables(edges.sparkSession, "paths")
    hop = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to")).distinct()
    level, out = seeds.select(F.array("id").alias("path")).distinct(), None
    for _ in range(depth):
        level = tables.put(level.join(hop, F.element_at("path", -1) == F.col("from")).where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path")))
        out = level if out is None else out.unionByName(level)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of ``links(a, b)`` is connected with.

    Alternating large and small stars: links are moved to the least neighbour, of the greater neighbours in one step and of
    the others in the next, until every node hangs from the least one of its component. The steps grow with the logarithm
    of the nodes, not with the diameter. The centre of a star is a hot key only on the side of the links; the other side
    has one row for it, so adaptive execution may split it.
    """
    tables = SharedTables(links.sparkSession, "components")
    given = links.where("a is not null and b is not null").select("a", "b")
    nodes = tables.put(given.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    current = tables.replace(given.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    before = mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = tables.replace(large)
        down = current.groupBy("u").agg(F.min("v").alias("m"))  # every link runs from the greater to the lesser id
        moved = current.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = tables.replace(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = mark(current)
        if now == before:
            break
        before = now
    return nodes.join(current.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def levels(depends: DataFrame) -> DataFrame:
    """(id, level) of a dependency graph ``depends(a, b)``, a needing b: 0 without needs, else 1 + the needs' greatest level.

    Nodes that need a cycle or lie on one have level -1. Rounds end when none can be placed.
    """
    tables = SharedTables(depends.sparkSession, "levels")
    need = tables.put(depends.where("a is not null and b is not null").select("a", "b").distinct())
    rest = tables.put(need.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    placed, level = [], 0
    while True:
        blocked = need.join(rest.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        ready, n = tables.counted(rest.join(blocked, "id", "left_anti").select("id", F.lit(level).alias("level")))
        if not n:
            break
        placed.append(ready)
        rest, level = tables.put(rest.join(ready.select("id"), "id", "left_anti")), level + 1
    out = rest.select("id", F.lit(-1).alias("level"))
    for part in placed:
        out = out.unionByName(part)
    return out


def enclosing(sites: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """Each site (file, line, ...) with the id of the latest-starting span (file, id, start_line, end_line) around it, or null.

    Spans are spread over buckets of ``width`` lines, so the range join becomes an equi-join on file and bucket; no further
    than to the last site of the file, whatever end a dirty row names. Ties of start_line go to the least id; spans with a
    null or negative range hold nothing.
    """
    last = sites.groupBy(F.col("file").alias("f")).agg(F.max("line").alias("last"))
    valid = spans.where("start_line <= end_line and start_line >= 0").join(last, F.col("file") == F.col("f")).where("start_line <= last")
    spread = valid.select("file", "id", "start_line", "end_line", F.explode(F.expr(f"sequence(start_line div {width}, least(end_line, last) div {width})")).alias("bucket"))
    marked = sites.withColumn("bucket", F.expr(f"line div {width}"))
    hit = marked.join(spread, ["file", "bucket"], "left").withColumn("inside", F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.max_by(F.when(F.col("inside"), F.col("id")), F.when(F.col("inside"), F.struct("start_line", -F.col("id"))))
    return hit.groupBy(*[c for c in sites.columns]).agg(best.alias("span_id"))


def overlapping(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """(a, b) of the spans (file, id, start_line, end_line) of both sides that share a line of a file.

    Both are spread over buckets of lines, and a pair is kept in the bucket in which the later one starts, so each comes
    out once. Spans reach no further than the last start of the other side in the file.
    """

    def spread(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        last = other.groupBy(F.col("file").alias("f")).agg(F.max(F.greatest("start_line", F.lit(0))).alias("last"))
        valid = side.where("start_line <= end_line and start_line >= 0").join(last, F.col("file") == F.col("f"))
        bucket = F.explode(F.expr(f"sequence(start_line div {width}, greatest(start_line, least(end_line, last)) div {width})"))
        return valid.select("file", bucket.alias("bucket"), F.col("id").alias(name), F.col("start_line").alias(f"{name}_start"), F.col("end_line").alias(f"{name}_end"))

    both = spread(a, b, "a").join(spread(b, a, "b"), ["file", "bucket"])
    return both.where(f"a_start <= b_end and b_start <= a_end and greatest(a_start, b_start) div {width} = bucket").select("a", "b")


def qualified_matches(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each reference (ref) with the id of the node of that qualified name, else of the only node whose last part it ends in."""
    exact = nodes.groupBy(F.col("qualified_name").alias("ref")).agg(F.min("id").alias("exact_id"))
    last = nodes.groupBy(F.element_at(F.split("qualified_name", r"\."), -1).alias("last")).agg(F.count("*").alias("n"), F.min("id").alias("only_id")).where("n = 1")
    keyed = refs.select("ref").distinct().withColumn("last", F.element_at(F.split("ref", r"\."), -1))
    return keyed.join(exact, "ref", "left").join(last, "last", "left").select("ref", F.coalesce("exact_id", "only_id").alias("id")).where("id is not null")


def supersets(owners: DataFrame, needs: DataFrame) -> DataFrame:
    """(owner, need) where the owner's members (owner, member) include all members of the need (need, member).

    Candidates come from the member of each need that fewest owners hold, so a member that very many hold makes no pairs
    unless a need has nothing rarer; the other members are looked up for the candidates only.
    """
    held, wanted = owners.select("owner", "member").distinct(), needs.select("need", "member").distinct()
    often = held.groupBy("member").agg(F.count("*").alias("owners"))
    known = wanted.join(often, "member", "left").groupBy("need").agg(F.count("*").alias("size"), F.min_by("member", F.struct(F.coalesce("owners", F.lit(0)), "member")).alias("member"))
    candidates = known.join(held, "member").select("owner", "need", "size")
    met = candidates.join(wanted, "need").join(held, ["owner", "member"]).groupBy("owner", "need", "size").agg(F.count("*").alias("n"))
    return met.where("n = size").select("owner", "need")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def traversed(edges: DataFrame, seeds: DataFrame, depth: int, targets: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, type, depth): every edge that a walk from the seeds passes, with the step that passes it.

    Edges to nodes seen before count as well. With ``targets`` (id) the walk ends with the step that first reaches one.
    """
    reached = frontier(edges, seeds, depth)
    passed = edges.select("source_id", "target_id", "type").distinct().join(reached.where(F.col("depth") < depth).select(F.col("id").alias("source_id"), (F.col("depth") + 1).alias("depth")), "source_id")
    if targets is None:
        return passed
    hit = passed.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi").agg(F.coalesce(F.min("depth"), F.lit(depth)).alias("last"))
    return passed.join(F.broadcast(hit)).where("depth <= last").drop("last")  # one row
