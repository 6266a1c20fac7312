import subprocess

import pytest

from graphloom.api import Engine
from graphloom.operators.search import stem
from graphloom.plans import cypher
from graphloom.sources import extract, history
from graphloom.sources.store import GraphStore
from tests.test_graph import EDGES, NODES


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_indexing_and_changes(spark, tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("class A:\n    def run(self):\n        pass\n")
    (root / "b.rs").write_text("fn main() {}\n")
    git(tmp_path, "init", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-m", "x")
    (root / "b.rs").write_text("fn main() { 1 }\n")
    store = GraphStore(spark, str(tmp_path / "g"))
    engine = Engine.of(store)
    assert [r[0] for r in engine.detect_changes(str(root)).collect()] == ["b.rs"]
    engine.index_repository("p", str(root))
    engine.index_repository("p", str(root))
    assert {(r["label"], r["qualified_name"]) for r in store.read("nodes").collect()} == {("Class", "p.src.a.A"), ("Method", "p.src.a.run"), ("Function", "p.b.main")}
    assert store.read("file_hashes").count() == 2 and engine.find_symbol("p", "run").count() == 1
    engine.manage_adr("p", "second", id_=2, created_at="2024-02")
    assert [r["title"] for r in engine.manage_adr("p", "first", id_=1, created_at="2024-01").collect()] == ["first", "second"]
    engine.delete_project("p")
    assert store.read("nodes").count() == 0 and store.read("projects").count() == 0
    log = history.read_log(spark, str(root))
    assert sorted((r["path"], r["added"]) for r in history.changes(log).collect()) == [("b.rs", 1), ("src/a.py", 3)]


def test_unconnected_patterns(frame, monkeypatch):
    nodes = frame([(i, "p", "A" if i % 2 else "B", f"n{i}", f"p.n{i}", "f", 1, 2, None) for i in range(6)], NODES)
    edges = frame([], EDGES)
    text = "MATCH (a:A), (b:B) RETURN a.name AS x, b.name AS y"
    assert cypher.run(text, nodes, edges).count() == 9
    monkeypatch.setattr(cypher, "UNCONNECTED_ROWS", 2)
    with pytest.raises(cypher.CypherError):
        cypher.run(text, nodes, edges)


@pytest.mark.parametrize("language", [*extract.GRAMMARS, *extract.INDENTED, "unknown"])
@pytest.mark.parametrize("text", ["", "\n", "{", "}}}", "class", "fn (", "def", "func (a", "\"", "'", "/*", "`${`", "class A {", "interface <", "fn f<", "@", "#[", "const a =", "a(b", "x = {" * 500, "é ☃ \x00"])
def test_odd_sources(language, text):
    lines = text.count("\n") + 1
    assert all(1 <= s.start <= s.end <= lines for s in extract.source_symbols(text, language))


def test_long_sources():
    text = "".join(f"function f{i}(a) {{ if (a) {{ return '}}'; }} }}\n" for i in range(5000))
    found = extract.source_symbols(text, "javascript")
    assert len(found) == 5000 and all(s.start == s.end for s in found)
    assert len(extract.end_lines(text, list(range(5000)))) == 5000


def test_stems():
    # Words and stems of the algorithm's published examples.
    assert {w: stem(w) for w in ("conflated", "troubled", "sized", "falling", "hissing", "failing", "conditional", "rational", "valenci", "digitizer", "operator", "feudalism", "decisiveness", "formaliti", "sensibiliti", "electriciti", "goodness", "revival", "inference", "airliner", "replacement", "communism", "effective", "rate", "cease", "a", "x1")} == {
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "falling": "fall", "hissing": "hiss", "failing": "fail", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "formaliti": "formal",
        "sensibiliti": "sensibl", "electriciti": "electr", "goodness": "good", "revival": "reviv", "inference": "infer", "airliner": "airlin", "replacement": "replac", "communism": "commun", "effective": "effect", "rate": "rate", "cease": "ceas", "a": "a", "x1": "x1",
    }
