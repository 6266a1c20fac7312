import pytest

from graphloom.llm import source_filter as S


def test_not_hand_written(frame):
    paths = {
        "src/vendor/lib/a.go": "vendored", "src/main/java/vendor/VendorA.java": None, "app/vendors/AController.ts": None, "node_modules/x/index.js": "vendored", "web/js/lib-1.2.3.js": "vendored", "web/js/page-2024.js": None, "a/x.pb.go": "generated", "a/x_pb2.py": "generated",
        "tools/generator/emit.py": None, "src/generated/a.rs": "generated", "js/a.min.js": "minified", "js/a-min-height.js": None, "js/app.1a2b3c4d.js": "minified", "src/big.js": "minified", "data/x_blob.js": "data", "src/h1.ts": "generated", "src/h2.ts": "vendored",
        "src/h3.ts": None, ".\\third_party\\x.c": "vendored", "src/plain.ts": None,
    }
    headers = {"src/h1.ts": "// Code generated by x. DO NOT EDIT.", "src/h2.ts": "/* Bundled copy of x 1.2, send changes upstream */", "src/h3.ts": "// Do not edit the list without a review."}
    hashes = frame([("p", p, 90000 if p == "src/big.js" else 2000, "x") for p in [*paths, "src/plain.ts"]] + [("p", None, 1, "x")], "project string, rel_path string, size bigint, header string")
    nodes = frame([(1, "p", "File", "./" + p.replace("\\", "/").removeprefix("./"), 1, 50, f'{{"line_count": {2 if p == "src/big.js" else 50}, "header": "{headers[p]}"}}' if p in headers or p == "src/big.js" and not headers.update({p: ""}) else None) for p in paths if "blob" not in p], "id bigint, project string, label string, file_path string, start_line int, end_line int, properties string")
    got = {r["rel_path"]: r["reason"] for r in S.not_hand_written(hashes, nodes).collect()}
    assert got == {p: r for p, r in paths.items() if r}
    assert S.not_hand_written(hashes.limit(0), nodes.limit(0)).count() == 0


def test_layout_of_texts(frame):
    plain = "def f(a):\n    b = a + 1\n    return b\n\n\nclass K:\n    def m(self):\n        # note\n        return self.f(2)\n" * 4
    minified = "function f(a){var b=a+1;if(b>2){return b}else{return g(b,a)}};" * 60
    data = "x = [" + ", ".join(f'"{i * 7919:08d}"' for i in range(800)) + "]\n"
    printed = "".join(f"pub const K{i}: u8 = {i};\n" for i in range(60))
    files = [("p", "a.py", plain), ("p", "b.js", minified), ("p", "c.py", data), ("p", "d.rs", printed), ("p", "e.py", None), ("p", "f.py", "")]
    texts = frame(files, "project string, rel_path string, content string")
    hashes = frame([("p", f[1], len(f[2] or "")) for f in files], "project string, rel_path string, size bigint")
    nodes = frame([], "id bigint, project string, label string, file_path string, start_line int, end_line int, properties string")
    assert {r["rel_path"]: r["reason"] for r in S.not_hand_written(hashes, nodes, texts).collect()} == {"b.js": "minified", "c.py": "data", "d.rs": "generated"}


@pytest.mark.parametrize("text", ["", "\n\n", "'''open", "/* open", "\"\\"])
def test_odd_texts(text):
    lines, canonical, share, shape = S.layout(text)
    assert lines >= 0 and canonical >= 0 and 0 <= share <= 1 and 0 <= shape <= 1


def test_fragments(frame):
    rows = [("p", "a.py", "x = [" + ", ".join(f'"{i * 7919:08d}"' for i in range(400)) + "]\n")] * 2 + [("p", "b.py", "def f(a):\n    b = a + 1\n    return b\n")] * 9
    hashes = frame([("p", "a.py", 9000), ("p", "b.py", 900), ("p", "c.js", 9000)], "project string, rel_path string, size bigint")
    nodes = frame([(1, "p", "File", "c.js", 1, 3, None)], "id bigint, project string, label string, file_path string, start_line int, end_line int, properties string")
    texts = frame(rows, "project string, rel_path string, content string")
    got = {r["rel_path"]: r["reason"] for r in S.not_hand_written(hashes, nodes, texts, fragments=True).collect()}
    assert got == {"a.py": "data", "c.js": "minified"}
    by_file = {r["lr"]: r for r in S.file_layouts(texts).collect()}
    assert by_file["b.py"]["lines"] == 27 and by_file["b.py"]["expansion"] == 1.0
