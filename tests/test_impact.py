from graphloom.queries import graph as Q
from tests.test_graph import EDGES, NODES


def test_impact_follows_every_edge_type(frame, spark, tmp_path):
    labels = {1: "Interface", 2: "File", 3: "File", 4: "Folder", 5: "Function", 6: "Method", 7: "Project", 8: "Function", 9: "Class"}
    frame([(i, "p", label, f"n{i}", f"p.n{i}", f"f{i}.rs", 1, 2, None) for i, label in labels.items()], NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    links = [(2, 1, "CONTAINS"), (5, 1, "TESTS"), (6, 1, "CALLS"), (8, 1, "OTHER"), (3, 2, "IMPORTS"), (4, 3, "CONTAINS"), (7, 4, "CONTAINS"), (1, 9, "USES")]
    frame([(i, "p", a, b, t, None) for i, (a, b, t) in enumerate(links)], EDGES).write.parquet(f"{tmp_path}/edges.parquet")
    got = Q.QUERIES["g2_impact"](spark, str(tmp_path)).collect()
    assert [(r["project"], r["direct"], r["indirect"], r["files"], r["risk"]) for r in got] == [("p", 4, 2, 6, "medium")]  # 7 lies 4 steps away
