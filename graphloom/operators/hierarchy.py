"""Parent-child links to full hierarchies: root, depth, path and descendants of every member, cycles told apart.

The roots are the first frontier. Each level joins the frontier with the links below it, which extends root, depth and
path by one step; every link is used once, and the rows of a level are never read again but for the result. Members that
no level reaches are those that lead into a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import SharedTables

G, NODE, PAR, ANC, LOW = "link", "node_id", "par", "anc", "low"


def close_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Rows (link, node_id, root_id, depth, path) for every id that is parent or child in ``links(link, parent, child)``.

    depth counts the steps from the root, which has depth 0; for an id on a cycle or below one, root_id is the smallest
    id on that cycle, depth is -1 and path is null. path (only ``with_path``) lists the ids from the root to the node.

    There are as many rounds as the deepest tree has levels. A round joins one level, which is small against the links,
    by parent; a parent of very many children is a hot key on the links' side alone, which adaptive execution splits.

    Defined cases: a row with a null parent or child is no link; repeated rows count once; of several parents of one
    child the smallest id counts; an id that is its own parent is a cycle of one; a null link is a hierarchy of its own; no
    links give no rows; further columns are ignored.
    """
    tables = SharedTables(links.sparkSession, "hierarchy")
    both = links.where("parent is not null and child is not null").select(
        G, F.explode(F.array(F.struct(F.col("child").alias(NODE), F.col("parent").alias(PAR)), F.struct(F.col("parent").alias(NODE), F.lit(None).cast("bigint").alias(PAR)))).alias("x")
    )
    start, members = tables.counted(both.groupBy(G, F.col(f"x.{NODE}").alias(NODE)).agg(F.min(f"x.{PAR}").alias(PAR)))
    below = start.where(f"{PAR} is not null").select(F.col(G).alias("down_link"), F.col(PAR).alias("up"), F.col(NODE).alias("down"))
    top = [F.col(NODE).alias("root_id"), F.lit(0).cast("bigint").alias("depth"), *([F.array(NODE).alias("path")] if with_path else [])]
    frontier, reached = tables.counted(start.where(f"{PAR} is null").select(G, NODE, *top))
    levels, new = [frontier], reached
    while new and reached < members:
        step = below.join(frontier, F.col(G).eqNullSafe(F.col("down_link")) & (F.col(NODE) == F.col("up"))).select(
            G, F.col("down").alias(NODE), "root_id", (F.col("depth") + 1).alias("depth"), *([F.concat("path", F.array("down")).alias("path")] if with_path else [])
        )
        frontier, new = tables.counted(step)
        levels.append(frontier)
        reached += new
    out = reduce(DataFrame.unionByName, levels)
    if reached < members:  # a level brought nothing new: the rest leads into cycles
        known = out.select(F.col(G).alias("known_link"), F.col(NODE).alias("known"))
        lost = start.join(known, F.col(G).eqNullSafe(F.col("known_link")) & (F.col(NODE) == F.col("known")), "left_anti")
        cyclic = _cycle_roots(lost, tables).select(G, NODE, "root_id", F.lit(-1).cast("bigint").alias("depth"), *([F.lit(None).cast("array<bigint>").alias("path")] if with_path else []))
        out = out.unionByName(cyclic)
    return out


def _cycle_roots(looped: DataFrame, tables: SharedTables) -> DataFrame:
    """The smallest id of the cycle that each node leads into.

    Each round doubles the stride: ``anc`` is the node 2^k steps on and ``low`` the smallest id of the steps before it.
    Once 2^k steps reach round the cycle, the low of anc is the cycle's smallest id and agrees along every link.
    """
    current = tables.replace(looped.select(G, NODE, PAR, F.col(PAR).alias(ANC), F.col(NODE).alias(LOW)))
    while True:
        ahead = current.select(F.col(G).alias("up_link"), F.col(NODE).alias("up"), F.col(ANC).alias("up_anc"), F.col(LOW).alias("up_low"))
        step = current.join(ahead, F.col(G).eqNullSafe(F.col("up_link")) & (F.col(ANC) == F.col("up"))).select(
            G, NODE, PAR, F.col("up_anc").alias(ANC), F.least(LOW, "up_low").alias(LOW), F.col("up_low").alias("root_id")
        )
        current = tables.replace(step)
        above = current.select(F.col(G).alias("up_link"), F.col(NODE).alias("above"), F.col("root_id").alias("above_root"))
        differing = current.join(above, F.col(G).eqNullSafe(F.col("up_link")) & (F.col(PAR) == F.col("above"))).where("root_id <> above_root")
        if not differing.limit(1).count():
            return current.select(G, NODE, "root_id")


def descendants(closed: DataFrame) -> DataFrame:
    """Rows (link, ancestor_id, node_id, distance) of every ancestor pair, from ``close_hierarchy(..., with_path=True)``.

    Members of cycles have no ancestors here. The pairs of one node are made from its own path, so no group is collected.
    """
    return closed.where("path is not null and size(path) > 1").select(
        G, NODE, F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor_id"), F.size("path").alias("n")
    ).select(G, "ancestor_id", NODE, (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"))


def links_of_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links (link, parent, child) of a code graph: CONTAINS and INHERITS edges and the parent names of symbols.

    CONTAINS runs from parent to child, INHERITS from derived class to base. A parent name is resolved within project and
    file to a symbol that is neither Function nor Method; a name that finds none gives no link.
    """
    kinds = edges.where(F.col("type").isin("CONTAINS", "INHERITS"))
    down = F.col("type") == "CONTAINS"
    by_edge = kinds.select(
        F.col("type").alias(G), F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"), F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child")
    )
    children = symbols.where("parent_name is not null").select(
        F.col("project").alias("p"), F.col("file_path").alias("f"), F.col("parent_name").alias("n"), F.col("symbol_id").alias("child")
    )
    parents = symbols.where(~F.col("label").isin("Function", "Method")).select(
        F.col("project").alias("p"), F.col("file_path").alias("f"), F.col("name").alias("n"), F.col("symbol_id").alias("parent")
    )
    by_name = children.join(parents, ["p", "f", "n"]).select(F.lit("PARENT_NAME").alias(G), "parent", "child")
    return by_edge.unionByName(by_name)
