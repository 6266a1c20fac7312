from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.sources import configs, extract
from graphloom.sources.repository import ignore_pattern, ignored, repository_files
from graphloom.sources.store import GraphStore, with_defaults
from graphloom.streaming import calls


def test_ignore_rules():
    rules = [("", *ignore_pattern(x)) for x in ("*.log", "/out", "tmp/", "!keep.log", "docs/**/x.md")] + [("sub/", *ignore_pattern("local.py"))]
    wanted = {"a.log": True, "keep.log": False, "d/keep.log": False, "out/x": True, "d/out/x": False, "tmp/a.py": True, "d/tmp/a.py": True, "docs/a/b/x.md": True, "docs/x.md": True, "sub/local.py": True, "local.py": False, "sub/d/local.py": True}
    assert {p: ignored(p, rules) for p in wanted} == wanted
    assert ignore_pattern("# note") is None and ignore_pattern("  ") is None


def test_repository(spark, tmp_path):
    files = {"src/a.py": "x = 1\n", "node_modules/b.js": "x", "build/c.ts": "x", ".gitignore": "build/\n*.yml\n", ".gitlab-ci.yml": "a: b", "d.unknown": "x", "Dockerfile": "FROM a"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["rel_path"]: r["language"] for r in repository_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "python", ".gitlab-ci.yml": "yaml", "Dockerfile": "dockerfile"}


def test_extractors(frame):
    python = "class A:\n    '''Doc.'''\n    def m(self):\n        return 1\n\ndef test_x():\n    pass\n"
    rust = "pub struct S {\n  a: u8,\n}\nimpl S {\n    pub fn go(&self) -> u8 {\n        if x { 1 }\n    }\n}\n"
    ts = "export class K {\n  async run(a: string): void {\n    call(a);\n  }\n}\nexport const f = (x) => {\n  return x;\n};\n"
    df = frame([("a.py", "python", python), ("b.rs", "rust", rust), ("c.ts", "typescript", ts), ("d.go", "go", None)], "rel_path string, language string, content string")
    got = {(r["rel_path"], r["name"], r["label"], r["start_line"], r["end_line"], r["parent_name"]) for r in extract.symbols(df).collect()}
    assert got == {
        ("a.py", "A", "Class", 1, 4, None), ("a.py", "m", "Method", 3, 4, "A"), ("a.py", "test_x", "Function", 6, 7, None), ("b.rs", "S", "Class", 1, 3, None), ("b.rs", "S", "Impl", 4, 8, None), ("b.rs", "go", "Method", 5, 7, "S"),
        ("c.ts", "K", "Class", 1, 5, None), ("c.ts", "run", "Method", 2, 4, "K"), ("c.ts", "f", "Function", 6, 8, None),
    }


def test_configs(frame):
    gitlab = "stages: [build, test]\ncompile:\n  stage: build\n  script: [make]\nunit:\n  needs: [compile]\n.hidden:\n  script: [x]\n"
    docker = "FROM a:1 AS base\nFROM b\nCOPY --from=base /x /y\nCOPY --from=0 /x /z\n"
    tf = 'resource "aws_vpc" "main" {\n  cidr = "x"\n}\nresource "aws_subnet" "s" {\n  vpc = aws_vpc.main.id\n}\n'
    k8s = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: web\nspec:\n  containers:\n  - image: nginx:1\n    envFrom:\n    - configMapRef:\n        name: cfg\n"
    df = frame([(".gitlab-ci.yml", gitlab), ("Dockerfile", docker), ("m.tf", tf), ("k.yaml", k8s), ("bad.yml", ":\n- ["), ("x.yaml", None)], "rel_path string, content string")
    nodes, edges = configs.config_graph(df)
    assert {(r["kind"], r["label"], r["name"]) for r in nodes.collect()} >= {("gitlab", "Stage", "build"), ("gitlab", "Job", "unit"), ("dockerfile", "Docker_Image", "stage-1"), ("terraform", "Infra", "aws_vpc.main"), ("kubernetes", "Resource", "web")}
    assert {(r["type"], r["source"], r["target"]) for r in edges.collect()} == {
        ("NEXT_STAGE", "build", "test"), ("BELONGS_TO_STAGE", "compile", "build"), ("BELONGS_TO_STAGE", "unit", "test"), ("DEPENDS_ON", "unit", "compile"), ("BUILDS_FROM", "base", "a:1"), ("BUILDS_FROM", "stage-1", "b"), ("COPIES_FROM", "stage-1", "base"),
        ("DEPENDS_ON", "aws_subnet.s", "aws_vpc.main"), ("USES_IMAGE", "web", "nginx:1"), ("MOUNTS_CONFIG", "web", "cfg"),
    }
    assert configs.manifest("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"@s/b": "2"}}') == ["@s/b", "a"]
    assert configs.manifest("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n") == ["github.com/a/b"]
    assert configs.compile_commands('[{"file": "a.c", "command": "cc -Iinc -DX=1 -std=c11 a.c"}]') == [("a.c", ["inc"], ["X=1"], "c11")]
    assert configs.github("on:\n  push:\njobs:\n  a: {}\n  b:\n    needs: a\n")[1] == [("DEPENDS_ON", "b", "a")]


def test_store(spark, frame, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    schema = "project string, qualified_name string, name string, seq int"
    store.insert("nodes", frame([("p", "p.a", "second", 2), ("p", "p.a", "first", 1)], schema), "seq")
    store.insert("nodes", frame([("p", "p.a", "late", 1), ("q", "q.b", "b", 1)], schema), "seq")
    assert {(r["project"], r["name"]) for r in store.read("nodes").collect()} == {("p", "first"), ("q", "b")}
    store.put("nodes", frame([("p", "p.a", "new", 9)], schema))
    store.link("p", "q")
    store.link("p", "q")
    assert store.read("project_links").count() == 2
    store.delete_project("p")
    assert [r["name"] for r in store.read("nodes").collect()] == ["b"] and store.read("project_links").count() == 0
    assert with_defaults(frame([(None,)], "a string"), {"a": "x", "b": 0}).first().asDict() == {"a": "x", "b": 0}


def test_columns(frame):
    df = frame([("p", "src/main.rs", "main"), ("p", "lib/__init__.py", "Foo"), ("p", "a\\b.ts", "c")], "p string, path string, n string")
    assert [r[0] for r in df.select(C.qualified_name(F.col("p"), F.col("path"), F.col("n"))).collect()] == ["p.src.main.main", "p.lib.Foo", "p.a.b.c"]
    code = frame([("fn a() { 1 }",), ("if a {\n} else if b {\n}\n// if x\n/* for\n while */\nfor x in y && z || w ? 1 : 2",), (None,)], "t string")
    assert [r[0] for r in code.select(C.complexity(F.col("t"))).collect()] == [1, 7, None]
    names = frame([("TravelRequestController",), ("x",)], "n string")
    assert [r[0] for r in names.select(C.scope_score("travel-request", F.col("n"))).collect()] == [0.8, None]
    routes = frame([("/users/:id",), ("/Users/{userId}/",)], "r string")
    assert {r[0] for r in routes.select(C.route_template(F.col("r"))).collect()} == {"/users/{param}"}


def test_streams(spark, frame, tmp_path):
    rows = frame([("find", "a", 10, "2024-01-01 00:05:00"), ("find", "a", 30, "2024-01-01 00:50:00"), ("find", "b", 20, "2024-01-01 03:00:00")], "tool string, agent string, ms int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = calls.call_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    batch = calls.call_windows(rows)
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in batch.collect()}
    assert sorted(r["calls"] for r in calls.call_sessions(rows).collect()) == [1, 1, 1]
