import pytest

from graphloom.llm import doc_pairs as P
from graphloom.llm.residue import residue, residues


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("# {{ title }}\n\nText", ["placeholder"]), ("Contact <your name here> for access.", ["placeholder"]), ("The layout is in ${VERSION}.", ["placeholder"]), ("Thank you for choosing [TODO: fill in name].", ["placeholder"]), ("Owner: TBD", ["placeholder"]),
        ("The renderer replaces `{{date}}` with the date.", []), ("Example:\n```html\n<h1>{{title}}</h1>\n```\ndone", []), ("export const f = (r) => `x ${r.a} of ${b}`;", []), ("Remove the TODO entries once it has an owner.", []),
        ("Hello undefined, your cart has NaN open items.", ["value"]), ("Owner: null null", ["value"]), ("The function returns undefined if the list is empty.", []), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", ["filler"]),
        ("The linter warns when lorem ipsum is left in a page, and the build then fails.", []), ("asdf qwer jkl foo foo blah asdf", ["filler"]), ("- Item one\n- Item two\n- Item text", ["filler"]), ("404 Not Found\n\nnginx", ["error"]),
        ("A missing page is answered with 404 Not Found only after the cache was searched.", []), ("Intro.\n\nAccess denied. Your account may not view this.", ["error"]), ("Access denied errors are counted per user.", []), ("Please turn on JavaScript in your browser to see this page.", ["script"]),
        ("The preview works with JavaScript disabled, because it is rendered on the server.", []), ("<noscript>You have to allow scripts for it to load.</noscript>", ["script"]), ("", []), (None, []), ("  \n", []), ("plain words " * 20000, []),
    ],
)
def test_residue(text, kinds):
    assert residue(text) == kinds


def test_residues(frame):
    df = frame([(1, "{{x}}", "a"), (1, "{{x}}", "a"), (2, None, "b"), (None, "Oops! We could not find the page you were looking for.", "c")], "doc_id bigint, text string, kinds string")
    assert sorted((str(r["doc_id"]), tuple(r["kinds"])) for r in residues(df).collect()) == [("1", ("placeholder",)), ("1", ("placeholder",)), ("None", ("error",))]
    assert residues(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name, doc, told",
    [
        ("load_map", "Loads the map.", False), ("load_map", "Load map function", False), ("loadMap", "The load map method.", False), ("load_map", "Reads the map from disk and caches it.", True), ("f", "TODO: document this", False), ("f", "Like g, but faster.\nTODO: tune", True),
        ("f", "====\nf\n====", False), ("f", "/**\n * @param x\n * @return\n */", False), ("f", "@return the number of open slots", True), ("f", "noqa: C901", False), ("f", "Copyright the x contributors.", False), ("f", "x = g(y); return x;", False),
        ("f", "See above.", False), ("f", "Prüft den Wert.", True), ("f", "", False), (None, "Sorts by key.", True), ("f", "Author: the x team\nCreated: 2023-01-01", False),
    ],
)
def test_description(name, doc, told):
    assert bool(P.description(doc, name)) is told


def test_assignment_within_a_text():
    text = "# Adds two numbers.\ndef add(a, b):\n    return a + b\n\n\n# stray note about nothing\nx = 1\n\ndef sub(a, b):\n    '''Takes b from a.\n\n    :param a: left\n    '''\n    # later note\n    return a - b\n\ndef bare(a):\n    return a\n"
    assert [(f.name, P.plain(c).split("\n")[0]) for f, c in P.documented(text)] == [("add", "Adds two numbers."), ("sub", "Takes b from a."), ("bare", "")]
    assert P.assign([[1.0, 3.0], [2.0, 2.5]]) == {0: 1, 1: 0}


def test_pairs(frame):
    rows = [
        (1, "Function", "f", None, None, "// Sums the parts.\nfn f() {}"), (1, "Function", "f", None, None, "// Sums the parts.\nfn f() {}"), (2, "Method", "g", "g()", " /** */ ", "def g():\n    \"\"\"Opens the gate.\"\"\"\n"), (3, "Class", "C", None, "Holds things.", "class C"),
        (4, "Function", "h", None, "Closes it down.", None), (5, "Function", "k", None, None, ""), (6, "Function", "m", None, None, "fn m() {\n  // inner note\n}"),
    ]
    df = frame([(*r, "x") for r in rows], "symbol_id bigint, label string, name string, signature string, docstring string, body_text string, description string")
    assert [r[0] for r in P.described_symbols(df).orderBy("symbol_id").collect()] == [1, 2]
    assert {(r["symbol_id"], P.plain(r["description"])) for r in P.code_description_pairs(df).collect()} == {(1, "Sums the parts."), (2, "Opens the gate.")}
    assert P.described_symbols(df.limit(0)).count() == 0


def test_links_by_name_and_blocks():
    text = "# Notes on total: sums the parts.\nimport x\n\n# Splits a list.\ndef split(a):\n    pass\n\n\ndef total(a):\n    return 1\n"
    assert [(f.name, P.plain(c)) for f, c in P.documented(text)] == [("split", "Splits a list."), ("total", "")]
    text = "# total sums the parts.\nx = 1\ndef total(a):\n    return 1\n"
    assert [(f.name, P.plain(c)) for f, c in P.documented(text)] == [("total", "total sums the parts.")]
    many = "".join(f"# Does step {i} of the plan.\ndef step{i}(a):\n    return {i}\n\n" for i in range(3000))
    assert all(c for _, c in P.documented(many))


def test_assignment_is_best():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        score = [[rng.choice([0.0, 0.0, 1.0, 2.5, 3.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        best = max(sum(score[i][j] for i, j in zip(range(n), p) if j < m) for p in itertools.permutations(range(m + n), n))
        got = P.assign(score)
        assert len(set(got.values())) == len(got) and abs(sum(score[i][j] for i, j in got.items()) - best) < 1e-9


def test_recorded_documentation_competes():
    body = "// Closes the gate.\nfn shut() {}"
    assert P.describe("shut", None, body) == "Closes the gate."
    assert P.describe("shut", "Locks it for good.", body) == "Locks it for good."
    assert P.describe("shut", " /** */ ", body) == "Closes the gate."
    assert P.describe("other", "Locks it for good.", "???") == "Locks it for good." and P.describe("other", None, "???") == ""


def test_file_pairs(frame):
    text = "// Adds two numbers.\nfunc add(a int) int {\n  return a // }\n}\n\nfunc bare() {}\n\n/* TODO */\nfunc later() {\n}\n"
    rows = P.file_pairs(frame([("a.go", text, 1), ("b.go", None, 2), ("c.go", "", 3)], "rel_path string, content string, code int")).collect()
    assert [tuple(r) for r in rows] == [("a.go", "add", 2, "func add(a int) int {\n  return a // }\n}", "Adds two numbers.")]
