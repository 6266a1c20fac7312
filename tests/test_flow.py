import random

import pytest

from graphloom.queries import graph as Q
from tests.test_graph import EDGES, NODES

TYPES = ("CALLS", "ASYNC_CALLS", "HTTP_CALLS", "HANDLES_ROUTE", "RENDERS", "IMPORTS", "USES", "INHERITS", "TESTS", "CONTAINS")
WANTED = {"request": {"CALLS", "ASYNC_CALLS", "HTTP_CALLS", "HANDLES_ROUTE"}, "render": {"RENDERS", "CALLS"}, "data": {"CALLS", "ASYNC_CALLS", "IMPORTS", "USES"}, "any": set(TYPES)}


def simple_paths(pairs, starts, depth):
    level, out = {(s,) for s in starts}, set()
    for _ in range(depth):
        level = {(*p, b) for p in level for a, b in pairs if a == p[-1] and b not in p}
        out |= level
    return out


@pytest.fixture
def graph(frame):
    rng = random.Random(5)
    links = [(i, "p", rng.randrange(12), rng.randrange(12), rng.choice(TYPES), None) for i in range(30)] + [(90, "p", 20, 21, "CALLS", None), (91, "p", 21, 22, "USES", None), (92, "p", 22, 23, "CALLS", None), (93, "p", 23, 24, "ASYNC_CALLS", None), (94, "p", 24, 25, "CALLS", None), (95, "p", 25, 26, "CALLS", None), (96, "p", 30, 31, "IMPORTS", None), (97, "p", 20, 21, "CALLS", None)]
    ids = [*range(12), *range(20, 27), 30, 31]
    labels = ("Function", "Method", "File", "Class")
    nodes = frame([(i, "p", labels[i % 4], f"n{i}", f"p.n{i}", "a.rs", 1, 2, None) for i in ids], NODES)
    return nodes, frame(links, EDGES), ids, links


@pytest.mark.parametrize("flow", sorted(WANTED))
def test_flow_types(graph, flow):
    nodes, edges, ids, links = graph
    want = simple_paths({(a, b) for _, _, a, b, t, _ in links if t in WANTED[flow]}, ids, 5)
    got = [(r["path"], r["steps"]) for r in Q.flow_paths(nodes, edges, flow).collect()]
    assert sorted(got) == sorted((">".join(map(str, p)), len(p) - 1) for p in want)


def test_data_flow_query(graph, spark, tmp_path):
    nodes, edges, _, _ = graph
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    edges.write.parquet(f"{tmp_path}/edges.parquet")
    got = {r["path"] for r in Q.QUERIES["g3_data_flow_paths"](spark, str(tmp_path)).collect()}
    assert {"20>21>22>23>24>25", "30>31"} <= got and "20>21>22>23>24>25>26" not in got
