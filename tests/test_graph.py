import random
from collections import defaultdict

import pytest

from graphloom.operators import graph as G
from graphloom.plans import cypher

NODES = "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string"
EDGES = "id bigint, project string, source_id bigint, target_id bigint, type string, properties string"


@pytest.fixture
def mini(frame):
    nodes = frame([(1, "p", "Function", "alpha", "p.alpha", "a.rs", 1, 10, '{"k": 5}'), (2, "p", "Function", "beta", "p.beta", "b.rs", 5, 20, None), (3, "p", "Class", "Gamma", "p.Gamma", "g.rs", 1, 50, "{}")], NODES)
    return nodes, frame([(1, "p", 1, 2, "CALLS", None), (2, "p", 1, 2, "CALLS", None)], EDGES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (n:Function) RETURN n.name", {("alpha",), ("beta",)}),
        ("MATCH (n:Function) RETURN COUNT(n)", {(2,)}),
        ("match (n:Function) where n.name = 'alpha' return n.filePath as f", {("a.rs",)}),
        ("MATCH (a:Function)-[r:CALLS]->(b) RETURN a.name, type(r), b.name", {("alpha", "CALLS", "beta")}),
        ("MATCH (a)<-[:CALLS]-(b) RETURN a.name", {("beta",)}),
        ("MATCH (a)-[:CALLS]-(b) RETURN a.name", {("alpha",), ("beta",)}),
        ("MATCH (n) WHERE NOT (n.label = 'Class' OR n.name CONTAINS 'ET') RETURN n.name", {("alpha",)}),
        ("MATCH (n) WHERE n.k = 5 RETURN n.k AS k", {("5",)}),
        ("MATCH (n) RETURN n.name AS x ORDER BY x DESC LIMIT 1", {("beta",)}),
    ],
)
def test_patterns(mini, text, want):
    assert {tuple(r) for r in cypher.run(text, *mini).collect()} == want


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "MATCH (n) RETURN m.name", "RETURN 1", "MATCH (n) WHERE n.name = RETURN n", "MATCH (n) RETURN n LIMIT 1 extra"])
def test_bad_patterns(mini, text):
    with pytest.raises(cypher.CypherError):
        cypher.run(text, *mini)


def test_frontier_against_bfs(frame):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(50)]
    edges = frame([(i, "p", a, b, "CALLS", None) for i, (a, b) in enumerate(pairs)], EDGES)
    out, dist, now = defaultdict(set), {0: 0}, {0}
    for a, b in pairs:
        out[a].add(b)
    for d in range(1, 4):
        now = {y for x in now for y in out[x]} - set(dist)
        dist |= {y: d for y in now}
    got = G.frontier(edges, frame([(0,), (None,)], "id bigint"), 3)
    assert {r["id"]: r["depth"] for r in got.collect()} == dist


def test_components_and_levels(frame):
    links = frame([(1, 2), (3, 2), (5, 4), (7, 7), (None, 1)], "a bigint, b bigint")
    assert {r["id"]: r["component"] for r in G.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}
    assert {r["id"]: r["level"] for r in G.levels(links).collect()} == {2: 0, 1: 1, 3: 1, 4: 0, 5: 1, 7: -1}
    assert G.components(links.limit(0)).count() == 0 and G.levels(links.limit(0)).count() == 0


def test_enclosing_and_supersets(frame):
    spans = frame([("f", 1, 1, 500), ("f", 2, 10, 20), ("f", 3, 10, 12), ("f", 4, 30, 20)], "file string, id bigint, start_line int, end_line int")
    sites = frame([("f", 11), ("f", 15), ("f", 300), ("f", 600), ("g", 5)], "file string, line int")
    assert {(r["file"], r["line"]): r["span_id"] for r in G.enclosing(sites, spans).collect()} == {("f", 11): 2, ("f", 15): 2, ("f", 300): 1, ("f", 600): None, ("g", 5): None}
    owners, needs = frame([("A", "x"), ("A", "y"), ("B", "x")], "owner string, member string"), frame([("I", "x"), ("I", "y"), ("J", "x")], "need string, member string")
    assert {tuple(r) for r in G.supersets(owners, needs).collect()} == {("A", "I"), ("A", "J"), ("B", "J")}


def test_paths_have_no_repeats(frame):
    edges = frame([(1, "p", 1, 2, "C", None), (2, "p", 2, 1, "C", None), (3, "p", 2, 3, "C", None)], EDGES)
    assert {tuple(r["path"]) for r in G.paths(edges, frame([(1,)], "id bigint"), 5).collect()} == {(1, 2), (1, 2, 3)}
