from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators.hierarchy import close_hierarchy, descendants, links_of_graph

SCHEMA = "link string, parent bigint, child bigint"


def brute(pairs):
    parent = {}
    for p, c in pairs:
        parent[c] = min(p, parent.get(c, p))
    out = {}
    for x in {i for pair in pairs for i in pair}:
        seen, y = [], x
        while y in parent and y not in seen:
            seen.append(y)
            y = parent[y]
        out[x] = (min(seen[seen.index(y) :]), -1) if y in seen else (y, len(seen))
    return out


def closed(frame, pairs, **kw):
    return close_hierarchy(frame([("L", p, c) for p, c in pairs], SCHEMA), **kw)


def as_dict(df):
    return {r["node_id"]: (r["root_id"], r["depth"]) for r in df.collect()}


def test_chain_tree_and_cycles(frame):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (200, 200), (200, 201), (1, 60), (1, 60)]
    assert as_dict(closed(frame, pairs)) == brute(pairs)


def test_empty_nulls_and_extra_columns(frame):
    assert closed(frame, []).count() == 0
    df = frame([("L", 1, 2, "x"), ("L", None, 3, "y"), ("L", 4, None, "z"), ("M", 2, 1, "x")], SCHEMA + ", depth string")
    assert {(r["link"], r["node_id"], r["root_id"], r["depth"]) for r in close_hierarchy(df).collect()} == {("L", 1, 1, 0), ("L", 2, 1, 1), ("M", 2, 2, 0), ("M", 1, 2, 1)}


def test_paths_and_descendants(frame):
    df = closed(frame, [(1, 2), (2, 3), (1, 4), (9, 9)], with_path=True)
    assert {r["node_id"]: r["path"] for r in df.collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4], 9: None}
    assert {(r["ancestor_id"], r["node_id"], r["distance"]) for r in descendants(df).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 14), st.integers(1, 14)), max_size=16))
def test_random_graphs(frame, pairs):
    assert as_dict(closed(frame, pairs)) == brute(pairs)


def test_links_of_graph(frame):
    edges = frame([(1, "p", 1, 2, "CONTAINS"), (2, "p", 3, 4, "INHERITS"), (3, "p", 5, 6, "CALLS")], "id bigint, project string, source_id bigint, target_id bigint, type string")
    symbols = frame([(10, "p", "f", "A", "Class", None), (11, "p", "f", "m", "Method", "A"), (12, "p", "g", "m", "Method", "A"), (13, "p", "f", "k", "Method", "m")], "symbol_id bigint, project string, file_path string, name string, label string, parent_name string")
    assert {(r["link"], r["parent"], r["child"]) for r in links_of_graph(edges, symbols).collect()} == {("CONTAINS", 1, 2), ("INHERITS", 4, 3), ("PARENT_NAME", 10, 11)}


def test_null_link_and_clashing_columns(frame):
    df = frame([(None, 1, 2, 9, 9, "x"), (None, 2, 3, 9, 9, "x"), (None, 5, 6, 9, 9, "x"), (None, 6, 5, 9, 9, "x"), ("L", 2, 1, 9, 9, "x")], SCHEMA + ", node_id bigint, root_id bigint, par string")
    assert {(r["link"], r["node_id"], r["root_id"], r["depth"]) for r in close_hierarchy(df).collect()} == {(None, 1, 1, 0), (None, 2, 1, 1), (None, 3, 1, 2), (None, 5, 5, -1), (None, 6, 5, -1), ("L", 2, 2, 0), ("L", 1, 2, 1)}


def test_deep_and_wide(frame):
    pairs = [(i, i + 1) for i in range(120)] + [(7, 1000 + i) for i in range(3000)]
    assert as_dict(closed(frame, pairs)) == brute(pairs)
