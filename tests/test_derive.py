from graphloom.sources import derive as D

FILES = "project string, rel_path string, language string, content string"


def test_imports(frame):
    rows = [
        ("p", "a.py", "python", "import os.path\nfrom a.b import c\nx = 'import z'\n"), ("p", "b.ts", "typescript", "import {x} from './x';\nconst y = require(\"@s/y\");\nimport 'z';\n"), ("p", "c.rs", "rust", "use a::b;\nmod m;\n"),
        ("p", "d.go", "go", 'import (\n\t"fmt"\n\tx "a/b"\n)\n'), ("p", "e.cpp", "cpp", '#include <v>\n#include "w.h"\n'), ("p", "f.txt", "text", "import q"), ("p", "g.py", "python", None), ("p", "h.kt", "kotlin", "import a.b.C\n"),
    ]
    got = {tuple(r) for r in D.imports(frame(rows, FILES)).collect()}
    assert got == {("a.py", "os.path"), ("a.py", "a.b"), ("b.ts", "./x"), ("b.ts", "@s/y"), ("b.ts", "z"), ("c.rs", "a::b"), ("c.rs", "m"), ("d.go", "fmt"), ("d.go", "a/b"), ("e.cpp", "v"), ("e.cpp", "w.h"), ("h.kt", "a.b.C")}


def test_routes_and_channels_between_projects(frame):
    rows = [
        ("p", "a.js", "javascript", "app.get('/users/:id', h);\nbus.emit('user.made', x);\nbus.emit(name)"), ("q", "b.py", "python", "@app.get('/Users/{userId}/')\ndef f(): pass\nbus.on('user.made', g)"), ("r", "c.java", "java", '@GetMapping("/users/{x}")\nvoid f() {}'),
        ("q", "d.go", "go", 'mux.HandleFunc("POST /orders", h)'), ("q", "e.go", "go", None),
    ]
    files, links = frame(rows, FILES), frame([("p", "q"), ("q", "p"), ("p", "p")], "source_project string, target_project string")
    routes = D.routes(files)
    assert {(r["project"], r["method"], r["template"]) for r in routes.collect()} == {("p", "GET", "/users/{param}"), ("q", "GET", "/users/{param}"), ("r", "GET", "/users/{param}"), ("q", "POST", "/orders")}
    both = D.cross_routes(routes, routes.limit(0), links)
    assert {tuple(r) for r in both.collect()} == {("p", "q", "GET", "/users/{param}", 1), ("q", "p", "GET", "/users/{param}", 1)}
    channels = D.channels(files)
    assert {(r["project"], r["way"], r["channel"]) for r in channels.collect()} == {("p", "EMITS", "user.made"), ("q", "LISTENS", "user.made")}
    assert {tuple(r) for r in D.shared_between_projects(channels, ["channel"], links).collect()} == {("p", "q", "user.made", 1), ("q", "p", "user.made", 1)}
    assert D.shared_between_projects(channels.limit(0), ["channel"], links).count() == 0
