"""Queries of source text: symbols by language, imports, routes and components of frameworks, calls and types, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import fixed
from graphloom.operators import graph as G
from graphloom.operators import resolve as P
from graphloom.operators import search
from graphloom.queries.samples import Registry
from graphloom.sources import configs, derive, extract
from graphloom.sources import frameworks as K
from graphloom.sources import history
from graphloom.tables import table

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES

#: Languages whose functions stand in a class of their own when a body is read alone.
_IN_CLASS = ("java", "csharp", "dart")


def _bodies(name: str, *languages: str) -> None:
    """Register the extraction of the functions of some languages from the bodies of all symbols.

    A body is read as a file of its own, within a class where the language needs one; its first symbol must be the function.
    """

    def run(spark, d):
        s = table(spark, d, "ts_symbols").where(F.col("label").isin("Function", "Method") & F.col("body_text").isNotNull() & F.col("language").isin(*languages))
        text = F.when(F.col("language").isin(*_IN_CLASS) | (F.col("label") == "Method"), F.concat(F.lit("class Holder {\n"), "body_text", F.lit("\n}"))).otherwise(F.col("body_text"))
        text = F.when(F.col("language").isin("python", "go", "rust"), F.col("body_text")).otherwise(text)
        files = s.select(F.col("symbol_id").cast("string").alias("rel_path"), "language", text.alias("content")).distinct()
        found = extract.symbols(files).where(F.col("label").isin("Function", "Method"))
        first = found.groupBy("rel_path", "language").agg(F.min_by("name", "start_line").alias("name"))
        return first.select(F.col("rel_path").cast("bigint").alias("symbol_id"), "language", "name")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT DISTINCT symbol_id, language, name FROM ts_symbols WHERE label IN ('Function', 'Method') AND body_text IS NOT NULL AND language IN ({', '.join(repr(x) for x in languages)})"


_bodies("ex1_script_functions", "typescript", "tsx", "javascript")
_bodies("ex2_python_functions", "python")
_bodies("ex3_rust_functions", "rust")
_bodies("ex4_c_functions", "c", "cpp")
_bodies("ex5_csharp_functions", "csharp")
_bodies("ex12_java_functions", "java")
_bodies("ex14_go_functions", "go")
_bodies("ex23_all_functions", "typescript", "tsx", "javascript", "python", "rust", "c", "cpp", "csharp", "java", "go", "dart")

_SYMBOL = "name string, label string, start_line int, end_line int, parent_name string, returns string, parameters string, bases string, docstring string"


def _language(name: str, language: str, text: str, rows: list[tuple]) -> None:
    """Register the extraction of one source text, with the symbols it holds."""

    def run(spark, d):
        found = extract.symbols(spark.createDataFrame([("f", language, text)], "rel_path string, language string, content string"))
        parameters = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"])), ",")
        return found.select("name", "label", "start_line", "end_line", "parent_name", F.col("return_type").alias("returns"), parameters.alias("parameters"), F.array_join("base_classes", ",").alias("bases"), "docstring")

    QUERIES[name] = run
    from graphloom.queries.samples import values

    ORACLES[name] = values((_SYMBOL, rows))


_language(
    "ex1_typescript_symbols", "typescript", '/** Runs it. */\n@Injectable({ a: 1 })\nexport class K extends Base implements A {\n  constructor(private http: Http) {}\n  async run(a: string, b?: number): Promise<void> {\n    if (a) { call("}"); } // {\n  }\n}\nexport interface P { go(a: string): void; }\nexport enum E { A }\nexport type T = { a: string };\nexport const f = async (x: number): number => {\n  return x;\n};\n',
    [("K", "Class", 3, 8, None, None, "", "Base,A", "Runs it."), ("constructor", "Method", 4, 4, "K", None, "http:Http", "", None), ("run", "Method", 5, 7, "K", "Promise<void>", "a:string,b:number", "", None), ("P", "Interface", 9, 9, None, None, "", "", None), ("go", "Method", 9, 9, "P", "void", "a:string", "", None), ("E", "Enum", 10, 10, None, None, "", "", None),
     ("T", "TypeAlias", 11, 11, None, None, "", "", None), ("f", "Function", 12, 14, None, "number", "x:number", "", None)],
)
_language(
    "ex2_python_symbols", "python", 'class A(B):\n    """Doc."""\n    @dec\n    async def m(self, a: int, *, k=1) -> str:\n        return 1\n\ndef test_x(): pass\nf = lambda q: q\n',
    [("A", "Class", 1, 5, None, None, "", "B", "Doc."), ("m", "Method", 4, 5, "A", "str", "a:int,k", "", None), ("test_x", "Function", 7, 7, None, None, "", "", None), ("f", "Function", 8, 8, None, None, "q", "", None)],
)
_language(
    "ex3_rust_symbols", "rust", "/// A store.\n#[derive(Debug)]\npub struct S { a: u8 }\npub trait T: Send { fn go(&self) -> u8; }\nimpl<X> T for S {\n    pub fn go(&self, n: u32) -> Result<u8, E> {\n        let c = '{'; // {\n        1\n    }\n}\nenum E { A }\n",
    [("S", "Class", 3, 3, None, None, "", "", "A store."), ("T", "Interface", 4, 4, None, None, "", "Send", None), ("go", "Method", 4, 4, "T", "u8", "", "", None), ("S", "Impl", 5, 10, None, None, "", "T", None), ("go", "Method", 6, 9, "S", "Result<u8, E>", "n:u32", "", None), ("E", "Enum", 11, 11, None, None, "", "", None)],
)
_language(
    "ex4_cpp_symbols", "cpp", "namespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x) {}\n  int get() const { return x_; }\n};\nint A::other(int s) {\n  return 1;\n}\n}\nstruct P { int x; };\nstatic int helper(int a, char b) { return a; }\nint proto(int a);\n",
    [("n", "Module", 1, 10, None, None, "", "", None), ("A", "Class", 2, 6, None, None, "", "B", None), ("A", "Method", 4, 4, "A", None, "x:int", "", None), ("get", "Method", 5, 5, "A", "int", "", "", None), ("other", "Method", 7, 9, "A", "int", "s:int", "", None), ("P", "Class", 11, 11, None, None, "", "", None), ("helper", "Function", 12, 12, None, "int", "a:int,b:char", "", None)],
)
_language(
    "ex5_csharp_symbols", "csharp", "namespace A.B {\n  [ApiController]\n  public class C : Base, I {\n    public async Task<int> Get(int id) { return 1; }\n    private string Name(string a) => a;\n  }\n  public interface I { void Go(); }\n}\n",
    [("A.B", "Module", 1, 8, None, None, "", "", None), ("C", "Class", 3, 6, None, None, "", "Base,I", None), ("Get", "Method", 4, 4, "C", "Task<int>", "id:int", "", None), ("Name", "Method", 5, 5, "C", "string", "a:string", "", None), ("I", "Interface", 7, 7, None, None, "", "", None), ("Go", "Method", 7, 7, "I", "void", "", "", None)],
)
_language(
    "ex6_ruby_symbols", "ruby", "# A thing.\nclass A < B\n  def go(x, y = 1)\n    if x\n      1\n    end\n  end\n  def self.make\n    new\n  end\nend\nmodule M\n  def help; end\nend\n",
    [("A", "Class", 2, 11, None, None, "", "B", "A thing."), ("go", "Method", 3, 7, "A", None, "x,y", "", None), ("make", "Method", 8, 10, "A", None, "", "", None), ("M", "Module", 12, 14, None, None, "", "", None), ("help", "Function", 13, 13, "M", None, "", "", None)],
)
_language(
    "ex7_php_symbols", "php", "<?php\nnamespace App\\Http;\nclass C extends Base implements I {\n  public function show(int $id, $q): string { return '}'; }\n}\ntrait T { function t() {} }\nfunction helper($a) { return 1; }\n",
    [("App\\Http", "Module", 2, 2, None, None, "", "", None), ("C", "Class", 3, 5, None, None, "", "Base,I", None), ("show", "Method", 4, 4, "C", "string", "id:int,q", "", None), ("T", "Interface", 6, 6, None, None, "", "", None), ("t", "Method", 6, 6, "T", None, "", "", None), ("helper", "Function", 7, 7, None, None, "a", "", None)],
)
_language(
    "ex8_swift_symbols", "swift", "protocol P { func go() }\npublic class V: UIView, P {\n  override func layout(_ a: Int, with b: String) -> Bool { return true }\n}\nenum E { case a }\n",
    [("P", "Interface", 1, 1, None, None, "", "", None), ("go", "Method", 1, 1, "P", None, "", "", None), ("V", "Class", 2, 4, None, None, "", "UIView,P", None), ("layout", "Method", 3, 3, "V", "Bool", "a:Int,b:String", "", None), ("E", "Enum", 5, 5, None, None, "", "", None)],
)
_language(
    "ex9_scala_symbols", "scala", "package a.b\nobject M extends App {\n  def f(x: Int): Int = x + 1\n  def g(y: String) = {\n    y\n  }\n}\ntrait T { def z: Int }\n",
    [("a.b", "Module", 1, 1, None, None, "", "", None), ("M", "Class", 2, 7, None, None, "", "App", None), ("f", "Method", 3, 3, "M", "Int", "x:Int", "", None), ("g", "Method", 4, 6, "M", None, "y:String", "", None), ("T", "Interface", 8, 8, None, None, "", "", None), ("z", "Method", 8, 8, "T", "Int", "", "", None)],
)
_language(
    "ex10_elixir_symbols", "elixir", 'defmodule A.B do\n  @doc "Adds."\n  def add(a, b) do\n    a + b\n  end\n  defp hid(x), do: x\nend\ndefprotocol P do\nend\n',
    [("A.B", "Module", 1, 7, None, None, "", "", None), ("add", "Method", 3, 5, "A.B", None, "a,b", "", "Adds."), ("hid", "Method", 6, 6, "A.B", None, "x", "", None), ("P", "Interface", 8, 9, None, None, "", "", None)],
)
_language(
    "ex11_bash_symbols", "bash", '#!/bin/bash\n# Builds.\nbuild() {\n  echo "$1 {"\n}\nfunction deploy {\n  build $2\n}\n',
    [("build", "Function", 3, 5, None, None, "", "", "Builds."), ("deploy", "Function", 6, 8, None, None, "", "", None)],
)
_language(
    "ex12_java_symbols", "java", '/** A service. */\n@Service\npublic class S extends Base implements I, J<K> {\n  public S(Repo repo) { this.repo = repo; }\n  @GetMapping("/x")\n  public List<User> all(@PathVariable Long id, String q) throws E {\n    for (int i = 0; i < 3; i++) { foo(i); }\n    return repo.find(id);\n  }\n  abstract void none();\n}\nenum C { A }\n',
    [("S", "Class", 3, 11, None, None, "", "Base,I,J", "A service."), ("S", "Method", 4, 4, "S", None, "repo:Repo", "", None), ("all", "Method", 6, 9, "S", "List<User>", "id:Long,q:String", "", None), ("none", "Method", 10, 10, "S", "void", "", "", None), ("C", "Enum", 12, 12, None, None, "", "", None)],
)
_language(
    "ex13_kotlin_symbols", "kotlin", "@RestController\nclass C(val r: Repo) : Base(), I {\n  fun one(id: Long): User = r.get(id)\n  suspend fun two(a: String) {\n    x()\n  }\n}\nobject O { fun z() {} }\nfun String.ext(): Int { return 1 }\n",
    [("C", "Class", 2, 7, None, None, "", "Base,I", None), ("one", "Method", 3, 3, "C", "User", "id:Long", "", None), ("two", "Method", 4, 6, "C", None, "a:String", "", None), ("O", "Class", 8, 8, None, None, "", "", None), ("z", "Method", 8, 8, "O", None, "", "", None), ("ext", "Function", 9, 9, None, "Int", "", "", None)],
)
_language(
    "ex14_go_symbols", "go", 'package x\n// Server serves.\ntype Server struct { a int }\ntype Iface interface { Go() error }\nfunc (s *Server) Run(ctx context.Context, n int) (int, error) {\n\treturn 1, nil\n}\nfunc TestRun(t *testing.T) { s := "}" }\n',
    [("Server", "Class", 3, 3, None, None, "", "", "Server serves."), ("Iface", "Interface", 4, 4, None, None, "", "", None), ("Run", "Method", 5, 7, "Server", "(int, error)", "ctx:context.Context,n:int", "", None), ("TestRun", "Function", 8, 8, None, None, "t:testing.T", "", None)],
)

_FILE = "project string, rel_path string, language string, content string"


@R.expected("rel_path string, name string, end_line int", [("a.rs", "f", 3), ("b.rb", "g", 4), ("c.c", "h", 1), ("d.js", "k", 5)], files=(_FILE, [
    ("p", "a.rs", "rust", 'fn f() {\n  let s = "}"; // }\n}\n'), ("p", "b.rb", "ruby", "def g\n  x do\n  end\nend\n"), ("p", "c.c", "c", "int h(int a) { return a; }\n"), ("p", "d.js", "javascript", "function k(a = {b: 1},\n  c) {\n  `${`}`}`;\n  /* } */\n}\n")]))
def ex16_end_lines(files):
    return extract.symbols(files).select("rel_path", "name", "end_line")


@R.whole("file_hashes", sql="""
WITH p AS (SELECT DISTINCT project, regexp_replace(replace(rel_path, '\\', '/'), '^\\./', '') AS f FROM file_hashes), s AS (SELECT project, f, string_split(f, '/') AS s FROM p),
e AS (SELECT project, CASE WHEN len(s) = 1 THEN '' ELSE array_to_string(s[1:-2], '/') END AS parent, f AS child, 'File' AS label FROM s UNION SELECT project, CASE WHEN i = 1 THEN '' ELSE array_to_string(s[1:i - 1], '/') END, array_to_string(s[1:i], '/'), 'Folder' FROM (SELECT project, s, unnest(generate_series(1, len(s) - 1)) AS i FROM s)) SELECT * FROM e""")
def ex20_structure_edges(hashes):
    """CONTAINS rows of folders and files; the project's own folder is the empty path."""
    f = hashes.select("project", C.forward(F.col("rel_path")).alias("f")).distinct().withColumn("s", F.split("f", "/"))
    up_to = lambda i: F.array_join(F.slice("s", F.lit(1), i), "/")
    files = f.select("project", up_to(F.size("s") - 1).alias("parent"), F.col("f").alias("child"), F.lit("File").alias("label"))
    folders = f.where(F.size("s") > 1).select("project", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("i")).select("project", up_to(F.col("i") - 1).alias("parent"), up_to(F.col("i")).alias("child"), F.lit("Folder").alias("label"))
    return files.unionByName(folders).distinct()


@R.expected("rel_path string, name string, type string", [("a.ts", "svc", "UserService"), ("b.py", "repo", "Repo"), ("c.rs", "x", "Thing"), ("d.go", "s", "Server"), ("E.java", "orders", "OrderRepo"), ("f.c", "n", "node")], files=("rel_path string, language string, content string", [
    ("a.ts", "typescript", "const svc: UserService = a;\nlet n: number = 1;\n"), ("b.py", "python", "repo: Repo = x()\nn: int = 1\n"), ("c.rs", "rust", "let mut x: &Thing = y; let z: u8 = 1;"), ("d.go", "go", "var s *app.Server\nvar n int"), ("E.java", "java", "  private final OrderRepo orders;\n  private int n;\n"), ("f.c", "c", "struct node *n;\nint a;\n"), ("g.txt", "text", "const a: B")]))
def ex21_annotated_types(files):
    return P.annotated_types(files)


_TYPES = ("file string, name string, type string", [("a", "x", "A1"), ("b", "x", "B1"), ("b", "y", "B2"), ("c", "y", "C2")])
_REACHED = ("file string, target string", [("a", "b"), ("a", "c"), ("d", "c"), ("d", "b")])


@R.sample(sql="""
SELECT u.file, u.name, coalesce((SELECT min(type) FROM types t WHERE t.file = u.file AND t.name = u.name), (SELECT arg_min(t.type, t.file) FROM imports i JOIN types t ON t.file = i.target WHERE i.file = u.file AND t.name = u.name)) AS type FROM uses u""",
    uses=("file string, name string", [("a", "x"), ("a", "y"), ("d", "y"), ("d", "x"), ("b", "q"), ("c", "x")]), types=_TYPES, imports=_REACHED)
def ex25_resolved_types(uses, types, imports):
    return P.resolved_types(uses, types, imports)


@R.expected("file string, name string, target_id bigint", [("a", "run", 1), ("a", "stop", 5), ("a", "both", 6), ("a", "both", 7), ("b", "run", 1), ("b", "run", 2)],
    calls=("file string, name string", [("a", "run"), ("a", "stop"), ("a", "both"), ("b", "run"), ("a", "String"), ("a", "nothing")]),
    symbols=("id bigint, name string, file string, qualified_name string", [(1, "run", "x", "p.x.run"), (2, "run", "y", "p.y.run"), (4, "stop", "z", "p.z.Car.stop"), (5, "stop", "w", "p.w.Bus.stop"), (6, "both", "x", "p.x.both"), (7, "both", "x", "p.x2.both"), (8, "String", "x", "p.x.String")]),
    imports=("file string, target string", [("a", "x"), ("b", "q")]), types=("file string, name string, type string", [("a", "stop", "Bus")]))
def ep2_call_targets(calls, symbols, imports, types):
    return P.call_targets(calls, symbols, imports, types)


@R.whole("ts_symbols", "nodes", "edges", sql=r"""
WITH s AS (SELECT DISTINCT symbol_id, project, file_path, name, label, body_text FROM ts_symbols), q AS (SELECT id, qualified_name FROM nodes),
c AS (SELECT DISTINCT project, file_path, unnest(regexp_extract_all(body_text, '(\w+)\s*\(', 1)) AS name FROM s WHERE label IN ('Function', 'Method') AND body_text IS NOT NULL),
i AS (SELECT DISTINCT a.project, a.file_path AS f, b.file_path AS t FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.type = 'IMPORTS' AND a.project = b.project),
k AS (SELECT c.project, c.file_path AS file, c.name, s.symbol_id AS target_id, i.t IS NOT NULL AS imp FROM c JOIN s ON s.project = c.project AND s.name = c.name LEFT JOIN i ON i.project = c.project AND i.f = c.file_path AND i.t = s.file_path),
m AS (SELECT *, count(*) FILTER (WHERE imp) OVER (PARTITION BY project, file, name) AS n FROM k) SELECT DISTINCT project || '|' || file AS file, name, target_id FROM m WHERE n <> 1 OR imp""")
def ep2_call_targets_of_all(symbols, nodes, edges):
    key = lambda f: F.concat("project", F.lit("|"), f)
    s = symbols.select("project", "symbol_id", "name", "file_path").distinct()
    calls = symbols.where(F.col("label").isin("Function", "Method") & F.col("body_text").isNotNull()).select(key("file_path").alias("file"), "project", F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("name"))
    # names are looked up within a project, so the project is part of the name
    named = lambda df: df.withColumn("name", F.concat("project", F.lit("|"), "name"))
    e = G.with_ends(edges.where("type = 'IMPORTS'"), nodes, ("project", "file_path")).where("s_project = t_project").select(F.concat("s_project", F.lit("|"), "s_file_path").alias("file"), F.concat("t_project", F.lit("|"), "t_file_path").alias("target"))
    types = calls.select("file", "name", F.lit(None).cast("string").alias("type")).limit(0)
    found = P.call_targets(named(calls), named(s.select("project", F.col("symbol_id").alias("id"), "name", key("file_path").alias("file"), F.lit("").alias("qualified_name"))), e, types)
    return found.select("file", F.regexp_extract("name", r"^[^|]*\|(.*)$", 1).alias("name"), "target_id").distinct()


_IMPORTING = ("project string, rel_path string, language string, content string", [
    ("p", "a.py", "python", "import os\nfrom pkg.sub import x\nimport numpy as np\n"), ("p", "src/b.ts", "typescript", "import {a} from './lib/c';\nimport x from '@s/core/deep';\nconst y = require('lodash');\nimport '../index';\n"), ("p", "d.rs", "rust", "use crate::a::b;\nmod c;\n"), ("p", "E.java", "java", "import static a.b.C;\nimport d.E;\n"),
    ("p", "f.go", "go", 'import (\n\t"fmt"\n\tx "github.com/a/b"\n)\n'), ("p", "g.c", "c", '#include <stdio.h>\n#include "x/y.h"\n'), ("p", "h.txt", "text", "import x"), ("p", "src/lib/c.ts", "typescript", ""), ("p", "index.ts", "typescript", None)])


@R.expected("rel_path string, target string", [("a.py", "os"), ("a.py", "pkg.sub"), ("a.py", "numpy"), ("src/b.ts", "./lib/c"), ("src/b.ts", "@s/core/deep"), ("src/b.ts", "lodash"), ("src/b.ts", "../index"), ("d.rs", "crate::a::b"), ("d.rs", "c"), ("E.java", "a.b.C"), ("E.java", "d.E"), ("f.go", "fmt"), ("f.go", "github.com/a/b"), ("g.c", "stdio.h"), ("g.c", "x/y.h")], files=_IMPORTING)
def ep3_imports(files):
    return derive.imports(files)


@R.expected("rel_path string, target string, qualified_name string", [("src/b.ts", "@s/core/deep", "p.core"), ("src/b.ts", "lodash", "p.vendor.lodash")], files=_IMPORTING, packages=("specifier string, qualified_name string", [("@s/core", "p.core"), ("lodash", "p.vendor.lodash"), ("unused", "p.unused")]))
def ep3_package_targets(files, packages):
    return P.package_targets(derive.imports(files), packages)


@R.expected("rel_path string, target string, file string", [("src/b.ts", "./lib/c", "src/lib/c.ts"), ("src/b.ts", "../index", "index.ts")], files=_IMPORTING)
def ep3_relative_targets(files):
    return P.relative_targets(derive.imports(files), files)


@R.expected("rel_path string, name string, base string, type string", [("a.ts", "K", "Base", "INHERITS"), ("a.ts", "K", "A", "IMPLEMENTS"), ("a.ts", "K", "B", "IMPLEMENTS"), ("b.py", "C", "D", "INHERITS"), ("b.py", "C", "m.E", "INHERITS"), ("c.rb", "F", "G::H", "INHERITS"), ("d.rs", "S", "T", "IMPLEMENTS")],
    files=("rel_path string, language string, content string", [("a.ts", "typescript", "export class K<T> extends Base implements A, B<X> {}\nclass Plain {}"), ("b.py", "python", "class C(D, m.E):\n    pass\nclass N(object): pass\n"), ("c.rb", "ruby", "class F < G::H\nend"), ("d.rs", "rust", "impl<X> T for S {}\nimpl S {}\n"), ("e.go", "go", "class X extends Y")]))
def ep4_declared_bases(files):
    return P.declared_bases(files)


@R.whole("ts_symbols", sql="""
WITH d AS (SELECT DISTINCT symbol_id, project, unnest(decorators) AS d FROM ts_symbols), t AS (SELECT DISTINCT symbol_id, project, name, label FROM ts_symbols),
r AS (SELECT d.symbol_id AS source_id, t.symbol_id AS target_id, row_number() OVER (PARTITION BY d.symbol_id, d.d ORDER BY CASE WHEN t.label IN ('Function', 'Class') THEN 0 ELSE 1 END, t.symbol_id) AS rn FROM d JOIN t ON t.project = d.project AND t.name = regexp_extract(d.d, '^@?([A-Za-z0-9_]*)', 1)) SELECT DISTINCT source_id, target_id FROM r WHERE rn = 1""")
def ep5_decorators(symbols):
    """DECORATES: the symbol of the project that a decorator names, functions and classes first."""
    from pyspark.sql import Window as W

    d = symbols.select("symbol_id", "project", F.explode("decorators").alias("d")).distinct().withColumn("name", F.regexp_extract("d", r"^@?(\w*)", 1))
    t = symbols.select("project", "name", F.col("symbol_id").alias("target_id"), "label").distinct()
    first = W.partitionBy("symbol_id", "d").orderBy(F.when(F.col("label").isin("Function", "Class"), 0).otherwise(1), "target_id")
    return d.join(t, ["project", "name"]).withColumn("rn", F.row_number().over(first)).where("rn = 1").select(F.col("symbol_id").alias("source_id"), "target_id").distinct()


@R.expected("source_id bigint, target_id bigint, type string", [(1, 11, "OVERRIDES"), (2, 12, "OVERRIDES"), (3, 13, "DELEGATES_TO")],
    files=("rel_path string, content string", [("A.java", "class A {\n  @Override\n  public void run() {\n  }\n"), ("b.kt", "class B {\n  override fun stop() {\n  }\n}\n"), ("c.ts", "class C {\n  go() {\n    this.inner.send(1);\n    self.x.none();\n  }\n}\n"), ("d.ts", None)]),
    symbols=("id bigint, name string, label string, file_path string, start_line int, end_line int", [(1, "run", "Method", "A.java", 3, 4), (2, "stop", "Method", "b.kt", 2, 3), (3, "go", "Method", "c.ts", 2, 5), (11, "run", "Method", "P.java", 1, 2), (12, "stop", "Method", "p.kt", 1, 2), (13, "send", "Method", "i.ts", 1, 2), (14, "send", "Function", "j.ts", 1, 2), (15, "run", "Function", "q.ts", 1, 2)]))
def ep6_overrides(files, symbols):
    return P.overriding(files, symbols)


_SITES = (_FILE, [
    ("p", "app/(shop)/cart/[id]/route.ts", "typescript", "export async function GET() {}\nexport const POST = x;"), ("p", "src/app/route.js", "javascript", "const x = 1"), ("p", "pages/api/users/list.ts", "typescript", "export default h"), ("p", "src/app/docs/[...slug]/route.tsx", "tsx", "export function DELETE() {}"), ("p", "src/route.ts", "typescript", "x"),
    ("p", "UserController.java", "java", '@RestController\n@RequestMapping("/api/")\npublic class UserController {\n  @GetMapping("/users/{id}")\n  public ResponseEntity<List<UserDto>> one(@PathVariable Long id) { return null; }\n  @PostMapping\n  public void add(@Valid @RequestBody OrderDto order, int n) {}\n}\n'),
    ("p", "Shop.kt", "kotlin", '@RestController\nclass Shop {\n  @PutMapping("/carts")\n  fun put(@RequestBody cart: CartDto): Optional<CartView> {\n  }\n}\n'),
    ("p", "main.go", "go", 'func main() {\n  v1 := r.Group("/v1")\n  v1.GET("/users", auth, h.List)\n  r.Post("/x", create)\n  mux.HandleFunc("DELETE /y/{id}", remove)\n  m.HandleFunc("/z", all).Methods("PATCH")\n  m.HandleFunc("/w", any)\n}\n'),
    ("p", "app.py", "python", "@app.route('/a', methods=['GET', \"post\"])\ndef a(): pass\n@bp.route('/b')\ndef b(): pass\n"),
    ("p", "server.ts", "typescript", "app.get('/health', h);\nrouter.post(`/orders`, h);\nio.emit('ready', 1);\nbus.on(\"ready\", f);\nbus.on(name, f);\n"),
    ("p", "list.component.ts", "typescript", "@Component({\n  selector: 'app-list',\n  template: `<app-row></app-row><div></div>`\n})\nexport class ListComponent {\n  constructor(private api: ApiService, private el: ElementRef) {}\n}\n"),
    ("p", "row.component.ts", "typescript", "@Component({ selector: 'app-row', templateUrl: './r.html' })\nexport class RowComponent {}\n"), ("p", "api.service.ts", "typescript", "@Injectable()\nexport class ApiService {}\n"),
    ("p", "src/UserCard.vue", "vue", "<script setup>\nimport Avatar from './Avatar.vue'\nimport { BaseButton as Btn } from './b'\nconst s = useStore()\n</script>\n<template><div><Avatar/><btn/><user-badge/></div></template>\n"), ("p", "src/user-badge.vue", "vue", "<template><p>x</p></template>"),
    ("p", "App.tsx", "tsx", "import React from 'react';\nimport { Nav } from './Nav';\nexport function App() {\n  return <><Nav /><Main>x</Main><Fragment></Fragment></>;\n}\n"), ("p", "S.tsx", "tsx", "import { createSignal } from 'solid-js';\nconst S = () => <Show when={a}></Show>;\n"), ("p", "T.tsx", "tsx", "const T = () => <Show />;"),
])


@R.expected("rel_path string, method string, path string", [("app/(shop)/cart/[id]/route.ts", "GET", "/cart/:id"), ("app/(shop)/cart/[id]/route.ts", "POST", "/cart/:id"), ("src/app/route.js", "GET", "/"), ("pages/api/users/list.ts", "ANY", "/api/users/list"), ("src/app/docs/[...slug]/route.tsx", "DELETE", "/docs/:slug")], files=_SITES)
def ep10_file_routes(files):
    return K.next_routes(files).drop("project")


@R.expected("method string, path string, handler string, request_dto string, response_dto string", [("GET", "/api/users/{id}", "one", None, "UserDto"), ("POST", "/api", "add", "OrderDto", None), ("PUT", "/carts", "put", "CartDto", "CartView")], files=_SITES)
def ep13_controller_routes(files):
    return K.spring_routes(files).drop("project", "rel_path")


@R.expected("method string, path string, handler string", [("GET", "/v1/users", "List"), ("POST", "/x", "create"), ("DELETE", "/y/{id}", "remove"), ("PATCH", "/z", "all"), ("ANY", "/w", "any")], files=_SITES)
def ep12_go_routes(files):
    return K.go_routes(files).drop("project", "rel_path")


@R.expected("method string, path string", [("GET", "/a"), ("POST", "/a"), ("GET", "/b")], files=_SITES)
def ep9_flask_routes(files):
    return K.flask_routes(files).drop("project", "rel_path")


@R.expected("method string, path string", [("GET", "/health"), ("POST", "/orders")], files=(_FILE, _SITES[1][9:10]))
def ep9_router_routes(files):
    return derive.routes(files).select("method", "path")


@R.expected("rel_path string, way string, channel string", [("server.ts", "EMITS", "ready"), ("server.ts", "LISTENS", "ready")], files=(_FILE, _SITES[1][9:10]))
def ep18_emits_and_listens(files):
    return derive.channels(files).drop("project")


@R.expected("name string, decorator string, layer string", [("ListComponent", "Component", "component"), ("RowComponent", "Component", "component"), ("ApiService", "Injectable", "service")], files=_SITES)
def ep15_decorated_classes(files):
    return K.component_classes(files).select("name", "decorator", "layer")


@R.expected("type string, source string, target string", [("SELECTS", "app-list", "ListComponent"), ("SELECTS", "app-row", "RowComponent"), ("INJECTS", "ListComponent", "ApiService"), ("RENDERS", "ListComponent", "RowComponent")], files=_SITES)
def ep15_component_edges(files):
    return K.component_edges(files).drop("project")


@R.expected("type string, source string, target string", [("SELECTS", "user-card", "UserCard"), ("SELECTS", "user-badge", "UserBadge"), ("INJECTS", "UserCard", "useStore"), ("RENDERS", "UserCard", "Avatar"), ("RENDERS", "UserCard", "UserBadge")], files=_SITES)
def ep16_single_file_components(files):
    return K.vue_edges(files).drop("project")


@R.expected("framework string, source string, target string", [("react", "App", "Nav"), ("react", "App", "Main"), ("solid", "S", "Show")], files=_SITES)
def ep17_rendered_components(files):
    return K.jsx_edges(files).select("framework", "source", "target")


_CONFIG = ("rel_path string, content string", [("a.json", '{\n  "cacheSize": 1,\n  "cacheSize": 2,\n  "x y": 3\n}'), ("b.yml", "renderQueue: 1\n  inner: 2\n"), ("c.toml", "[s]\ntimeout = 1\r\nname=2\n"), (".env", "DATABASE_URL=x\n# C=1\n"), ("d.txt", "key: 1"), ("e.ini", None)])


@R.expected("rel_path string, key string", [("a.json", "cacheSize"), ("b.yml", "renderQueue"), ("c.toml", "timeout"), ("c.toml", "name"), (".env", "DATABASE_URL")], files=_CONFIG)
def ep46_config_keys(files):
    return P.config_keys(files)


@R.expected("rel_path string, key string, id bigint", [("c.toml", "name", 3)], files=_CONFIG, names=("id bigint, name string", [(1, "other"), (3, "name")]))
def ep19_keys_of_that_name(files, names):
    return P.config_keys(files).join(names.select("id", F.col("name").alias("key")), "key").select("rel_path", "key", "id")


_TOKENS = [("cacheBatchSize", "cache batch size"), ("DATABASE_URL_2", "database url 2"), ("config.stream.cursor.json", "stream cursor"), ("settings.a-b_c", "a b c"), ("plain", "plain"), (".env.X", "x")]


@R.expected("key string, tokens string", _TOKENS, keys=("key string", [(k,) for k, _ in _TOKENS]))
def ep20_key_tokens(keys):
    return keys.select("key", F.array_join(P.key_tokens(F.col("key")), " ").alias("tokens"))


@R.whole("nodes", "file_hashes", sql="""
WITH k AS (SELECT DISTINCT regexp_replace(regexp_extract(rel_path, '[^/\\\\]*$'), '\\.[^.]*$', '') AS key FROM file_hashes), s AS (SELECT key, CASE WHEN regexp_matches(key, '^[\\p{Lu}_0-9]+$') AND regexp_matches(key, '\\p{L}') THEN replace(key, '_', ' ') ELSE regexp_replace(regexp_replace(regexp_replace(key, '^(?:\\.env\\.)*(?:config\\.)*(?:settings\\.)*', ''), '(\\p{Lu})', ' \\1', 'g'), '[_.-]', ' ', 'g') END AS t FROM k),
x AS (SELECT key, list_filter(string_split(lower(t), ' '), lambda v: v <> '') AS t FROM s), n AS (SELECT id, lower(name) AS name FROM nodes WHERE label = 'Enum' AND name <> ''),
y AS (SELECT key, id, len(list_filter(t, lambda v: contains(name, v)))::DOUBLE / len(t) AS s FROM x, n WHERE len(t) > 0) SELECT key, id, round(s, 3) AS confidence FROM y WHERE s > 0.5""")
def ep20_links_of_file_names(nodes, hashes):
    """File names without their endings, as keys, and the names of all enums."""
    keys = hashes.select(F.regexp_replace(F.regexp_extract("rel_path", r"[^/\\]*$", 0), r"\.[^.]*$", "").alias("key")).distinct()
    return P.config_links(keys, nodes.where("label = 'Enum'").select("id", "name"))


@R.whole("ts_symbols", sql=r"""
WITH s AS (SELECT DISTINCT symbol_id, project, file_path, name, label, body_text FROM ts_symbols), b AS (SELECT * FROM s WHERE label IN ('Function', 'Method') AND body_text IS NOT NULL),
w AS (SELECT DISTINCT symbol_id, project, file_path, unnest(regexp_extract_all(body_text, '\w+')) AS w FROM b), c AS (SELECT DISTINCT symbol_id, unnest(regexp_extract_all(body_text, '\b(\w+)\s*\(', 1)) AS w FROM b), u AS (SELECT * FROM w ANTI JOIN c USING (symbol_id, w))
SELECT DISTINCT u.symbol_id AS source_id, s.symbol_id AS target_id FROM u JOIN s ON s.project = u.project AND s.name = u.w AND s.file_path <> u.file_path""")
def ep22_usages(symbols):
    return P.usages(symbols)


@R.whole("ts_symbols", sql=r"""
WITH s AS (SELECT DISTINCT symbol_id, project, name, label, body_text, coalesce(is_test, false) OR regexp_matches(lower(file_path), '\.test\.|\.spec\.|__tests__/|/tests/|/test/|test_') OR regexp_matches(lower(file_path), '_test\.(go|rs)$') AS t FROM ts_symbols),
w AS (SELECT DISTINCT symbol_id, project, unnest(regexp_extract_all(body_text, '\w+')) AS w FROM s WHERE t AND label IN ('Function', 'Method') AND body_text IS NOT NULL) SELECT DISTINCT w.symbol_id AS source_id, s.symbol_id AS target_id FROM w JOIN s ON s.project = w.project AND s.name = w.w AND NOT s.t WHERE s.symbol_id <> w.symbol_id""")
def ep23_derived_tests(symbols):
    return P.tests_of(symbols, F.coalesce("is_test", F.lit(False)) | C.is_test_path(F.col("file_path")))


@R.sample("nodes", "project_links", sql="""
WITH r AS (SELECT project, id, upper(json_extract_string(properties, '$.http_method')) AS m, regexp_replace(regexp_replace(lower(json_extract_string(properties, '$.path')), ':[a-z0-9_]+', '{param}', 'g'), '\\{[^}]*\\}', '{param}', 'g') AS p FROM nodes WHERE label = 'Route'),
l AS (SELECT DISTINCT source_project AS s, target_project AS t FROM project_links UNION SELECT target_project, source_project FROM project_links) SELECT a.id AS source_id, b.id AS target_id FROM l JOIN r a ON a.project = l.s JOIN r b ON b.project = l.t AND b.m = a.m AND b.p = a.p""")
def ep27_cross_routes(nodes, links):
    prop = lambda k: F.get_json_object("properties", f"$.{k}")
    r = nodes.where("label = 'Route'").select("project", "id", F.upper(prop("http_method")).alias("m"), C.route_template(prop("path")).alias("p"))
    return derive.linked_pairs(r, ["m", "p"], links)


@R.sample("nodes", "project_links", sql="""
WITH r AS (SELECT project, id, coalesce(json_extract_string(properties, '$.event_name'), name) AS e FROM nodes WHERE label = 'Channel'), l AS (SELECT DISTINCT source_project AS s, target_project AS t FROM project_links UNION SELECT target_project, source_project FROM project_links)
SELECT a.id AS source_id, b.id AS target_id FROM l JOIN r a ON a.project = l.s JOIN r b ON b.project = l.t AND b.e = a.e""")
def ep28_cross_channels(nodes, links):
    r = nodes.where("label = 'Channel'").select("project", "id", F.coalesce(F.get_json_object("properties", "$.event_name"), "name").alias("e"))
    return derive.linked_pairs(r, ["e"], links)


@R.sample("nodes", "project_links", sql="""
WITH r AS (SELECT project, id, unnest([{'t': json_extract_string(properties, '$.kafka_topic'), 'k': 'kafka'}, {'t': json_extract_string(properties, '$.rabbitmq_queue'), 'k': 'rabbitmq'}, {'t': json_extract_string(properties, '$.redis_channel'), 'k': 'redis'}]) AS x FROM nodes WHERE label = 'Channel'),
l AS (SELECT DISTINCT source_project AS s, target_project AS t FROM project_links UNION SELECT target_project, source_project FROM project_links) SELECT a.id AS source_id, b.id AS target_id FROM l JOIN r a ON a.project = l.s JOIN r b ON b.project = l.t AND b.x = a.x WHERE a.x.t IS NOT NULL""")
def ep29_cross_topics(nodes, links):
    return derive.linked_pairs(K.async_topics(nodes), ["topic", "kind"], links)


_CI = [(".gitlab-ci.yml", "gitlab"), (".github/workflows/a.yaml", "github"), ("x/Jenkinsfile", "jenkins"), ("a.jenkinsfile", "jenkins"), (".circleci/config.yml", "circleci"), ("azure-pipelines.yml", "azure"), (".azure-pipelines/b.yml", "azure"), ("bitbucket-pipelines.yml", "bitbucket"), ("x/.gitlab-ci.yml", None), (".github/workflows/a.md", None)]


@R.expected("path string, system string", _CI, paths=("path string", [(p,) for p, _ in _CI]))
def ep33_ci_systems(paths):
    return paths.select("path", K.ci_system(F.col("path")).alias("system"))


@R.expected("job string, type string", [("a", "DEPLOYS"), ("a", "BUILDS_IMAGE"), ("b", "DEPLOYS"), ("d", "DEPLOYS")], jobs=("job string, script string", [("a", "docker build .\ndocker push x\nkubectl apply -f y\nterraform plan"), ("b", "helm upgrade x"), ("c", "make"), ("d", "terraform apply"), ("e", None)]))
def ep33_deployments(jobs):
    return K.deployments(jobs).drop("summary")


_IAC = [("cdk.json", "{}", "cdk"), ("lib/AppStack.ts", "x", "cdk"), ("Pulumi.dev.yaml", "x", "pulumi"), ("m.tf", "x", "terraform"), ("c/Chart.yaml", "x", "helm"), ("sam/template.yml", "x", "cloudformation"), ("x.yaml", "AWSTemplateFormatVersion: 1", "cloudformation"), ("y.yaml", "a: 1", None)]


@R.expected("path string, kind string", [(p, k) for p, _, k in _IAC], files=("path string, content string", [(p, c) for p, c, _ in _IAC]))
def ep34_infrastructure_files(files):
    return files.select("path", K.iac_kind(F.col("path"), F.col("content")).alias("kind"))


_M = [("#import <A.h>\n@interface X", "objectivec"), ("intrinsic f(x)", "magma"), ("function y = f(x)\nend\n", "matlab"), ("// a\n", "objectivec"), ("% a\n// b\n% c", "matlab"), ("", "matlab"), (None, "matlab"), ("#import <A.h>", "matlab")]


@R.expected("id int, language string", [(i, x) for i, (_, x) in enumerate(_M)], files=("id int, content string", [(i, c) for i, (c, _) in enumerate(_M)]))
def sc4_matlab_or_objective_c(files):
    return files.select("id", K.matlab_or_not(F.col("content")).alias("language"))


@R.whole("file_hashes", sql="SELECT DISTINCT rel_path, CASE lower(regexp_extract(rel_path, '\\.([^./\\\\]+)$', 1)) WHEN 'ts' THEN 'own-script' WHEN 'rs' THEN 'oxide' ELSE 'default' END AS language FROM file_hashes")
def sc5_configured_languages(hashes):
    """A user's mapping, of which the repository's own overrides the general one."""
    return hashes.select("rel_path", K.configured_language(F.col("rel_path"), F.lit("default"), {".ts": "script", "rs": "oxide"}, {"ts": "own-script"}).alias("language")).distinct()


@R.whole("documents", sql="SELECT project, path, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY ingested_at DESC, doc_id DESC) AS rn FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) WHERE rn = 1")
def sc12_snippets(documents):
    """The last text of each project and path: what an upsert of snippets leaves, and what reading them back gives."""
    last = documents.where("path is not null and text is not null").groupBy("project", "path").agg(F.max_by("text", F.struct("ingested_at", "doc_id")).alias("content"))
    return last.select("project", "path", "content")


@R.whole("nodes", "edges", sql="""
SELECT 'label' AS lookup, id::VARCHAR AS key FROM nodes WHERE label = 'Enum' UNION ALL SELECT 'file', id::VARCHAR FROM nodes WHERE project = 'meridian-core' AND file_path IS NOT NULL AND label NOT IN ('File', 'Folder', 'Project') UNION ALL SELECT 'type', id::VARCHAR FROM edges WHERE type = 'TESTS'
UNION ALL SELECT 'hop', e.id::VARCHAR FROM edges e JOIN nodes n ON n.id = e.source_id WHERE n.label = 'Interface' UNION ALL SELECT 'files', file_path FROM (SELECT DISTINCT file_path FROM nodes WHERE file_path IS NOT NULL)""")
def sc25_keyed_lookups(nodes, edges):
    hop = edges.join(nodes.where("label = 'Interface'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    parts = {
        "label": nodes.where("label = 'Enum'").select("id"), "file": nodes.where(F.col("file_path").isNotNull() & (F.col("project") == "meridian-core") & ~F.col("label").isin("File", "Folder", "Project")).select("id"), "type": edges.where("type = 'TESTS'").select("id"), "hop": hop.select("id"),
        "files": nodes.where("file_path is not null").select("file_path").distinct(),
    }
    rows = [df.select(F.lit(k).alias("lookup"), F.col(df.columns[0]).cast("string").alias("key")) for k, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


_STAGED = ("src_qn string, tgt_qn string, type string, pass_order int", [("p.a", "p.b", "CALLS", 1), ("p.a", "x.only", "CALLS", 2), ("p.a", "x.two", "CALLS", 2), ("p.a", "p.b", "CALLS", 3), ("p.none", "p.b", "CALLS", 1), ("p.b", "p.a", "USES", 1)])
_NAMED = ("id bigint, qualified_name string", [(1, "p.a"), (2, "p.b"), (3, "p.m.only"), (4, "p.m.two"), (5, "p.n.two")])


@R.expected("source_id bigint, target_id bigint, type string, pass_order int", [(1, 2, "CALLS", 1), (1, 3, "CALLS", 2), (2, 1, "USES", 1)], staged=_STAGED, nodes=_NAMED)
def sc29_staged_edges(staged, nodes):
    """Staged edges between qualified names, resolved; the first pass that names an edge counts, what finds no node is dropped."""
    ids = G.qualified_matches(staged.select(F.col("src_qn").alias("ref")).unionByName(staged.select(F.col("tgt_qn").alias("ref"))), nodes)
    a, b = ids.select(F.col("ref").alias("src_qn"), F.col("id").alias("source_id")), ids.select(F.col("ref").alias("tgt_qn"), F.col("id").alias("target_id"))
    return staged.join(a, "src_qn").join(b, "tgt_qn").groupBy("source_id", "target_id", "type").agg(F.min("pass_order").alias("pass_order"))


@R.sample(sql="SELECT id, title FROM decisions WHERE project = 'p' ORDER BY created_at, id", decisions=("id bigint, project string, title string, created_at string", [(1, "p", "b", "2024-02-01"), (2, "p", "a", "2024-01-01"), (3, "q", "c", "2024-01-01")]))
def sc31_decisions_in_order(decisions):
    return decisions.where("project = 'p'").orderBy("created_at", "id").select("id", "title")


_MANIFESTS = ("rel_path string, content string", [
    ("package.json", '{"name": "a", "dependencies": {"x": "1"}, "devDependencies": {"@s/y": "2"}}'), ("composer.json", '{"require": {"v/p": "1"}}'), ("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = "1"\n'), ("pyproject.toml", '[project]\ndependencies = ["numpy>=1", "ruff"]\n'), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
    ("pom.xml", "<dependency><artifactId>core</artifactId></dependency>"), ("build.gradle", "implementation 'g:n:1'\n"), ("build.gradle.kts", 'implementation("g:k:1")\n'), ("mix.exs", "{:phoenix, \"~> 1\"},"), ("x.gemspec", "s.add_dependency 'rack', '1'"), ("setup.py", "install_requires=['six>=1', 'attrs'],"), ("pubspec.yaml", "dependencies:\n  flutter: 1\n"), ("requirements.txt", "flask==1\n# no\n"), ("broken/package.json", "{"),
])


@R.expected("rel_path string, package string", [("package.json", "x"), ("package.json", "@s/y"), ("composer.json", "v/p"), ("Cargo.toml", "serde"), ("Cargo.toml", "rand"), ("pyproject.toml", "numpy"), ("pyproject.toml", "ruff"), ("go.mod", "github.com/a/b"), ("pom.xml", "core"), ("build.gradle", "g:n"), ("build.gradle.kts", "g:k"), ("mix.exs", "phoenix"), ("x.gemspec", "rack"), ("setup.py", "six"), ("setup.py", "attrs"), ("pubspec.yaml", "flutter"), ("requirements.txt", "flask")], files=_MANIFESTS)
def sc22_manifests(files):
    return configs.manifests(files)


@R.expected("file string, includes string, definitions string, standard string", [("a.c", "inc,/usr/x", "X=1", "c11"), ("b.cc", "", "", None)], files=("rel_path string, content string", [("compile_commands.json", '[{"file": "a.c", "command": "cc -Iinc -I /usr/x -DX=1 -std=c11 a.c"}, {"file": "b.cc", "arguments": ["c++", "b.cc"]}]'), ("other.json", "[]"), ("x/compile_commands.json", "oops")]))
def sc23_compile_commands(files):
    return configs.compile_database(files)


_PIPES = ("rel_path string, content string", [
    (".gitlab-ci.yml", "stages: [build, test]\ninclude:\n  - local: ci/extra.yml\n  - component: reg/lint@1\n    inputs: {stage: test}\ncompile:\n  stage: build\n  script: [make, docker build .]\nunit:\n  needs: [compile]\n.hidden:\n  script: [x]\n"),
    (".github/workflows/ci.yml", "on:\n  push:\n  pull_request:\njobs:\n  a:\n    steps: [{run: kubectl apply -f x}]\n  b:\n    needs: a\n"), (".circleci/config.yml", "jobs:\n  c1:\n    steps:\n      - run: helm install x\n      - run: {command: make}\n  c2: {}\nworkflows:\n  w:\n    jobs:\n      - c1\n      - c2: {requires: [c1]}\n"),
    ("azure-pipelines.yml", "trigger: [main]\nstages:\n  - stage: s1\n    jobs:\n      - job: j1\n  - stage: s2\n    dependsOn: s1\n    jobs:\n      - job: j2\n        dependsOn: j1\n"), ("bitbucket-pipelines.yml", "pipelines:\n  default:\n    - step: {name: one}\n    - step: {script: [x]}\n"), ("Jenkinsfile", "stage('A') { }\nstage(\"B\") { }\n"),
    ("k.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: web\nspec:\n  containers:\n  - image: nginx:1\n    envFrom:\n    - configMapRef:\n        name: cfg\n"), ("kustomization.yaml", "resources: [a.yaml]\npatches:\n  - path: p.yaml\n"), ("Dockerfile", "FROM a:1 AS base\nFROM base\nCOPY --from=base /x /y\nEXPOSE 80\n"),
    ("m.tf", 'resource "aws_vpc" "main" {\n}\nresource "aws_subnet" "s" {\n  vpc = aws_vpc.main.id\n}\n'), ("t.yaml", "AWSTemplateFormatVersion: 1\nResources:\n  F:\n    Type: AWS::Serverless::Function\n    Properties:\n      Events:\n        E:\n          Properties: {Path: /x, Method: get}\n"), ("serverless.yml", "service: s\nfunctions:\n  hello:\n    handler: h.main\n    events:\n      - http: GET users\n      - httpApi: {path: /y, method: post}\n"), ("Chart.yaml", "name: c\nversion: 1\ndependencies:\n  - name: d\n"), ("bad.yml", ":\n- ["),
])
_PIPE_EDGES = [
    ("gitlab", "NEXT_STAGE", "build", "test"), ("gitlab", "BELONGS_TO_STAGE", "compile", "build"), ("gitlab", "BELONGS_TO_STAGE", "unit", "test"), ("gitlab", "DEPENDS_ON", "unit", "compile"), ("gitlab", "BUILDS_IMAGE", "compile", "docker_target"), ("gitlab", "BELONGS_TO_STAGE", "lint", "test"), ("github", "DEPENDS_ON", "b", "a"), ("github", "DEPLOYS", "a", "deploy_target"),
    ("circleci", "DEPENDS_ON", "c2", "c1"), ("circleci", "DEPLOYS", "c1", "deploy_target"), ("azure", "NEXT_STAGE", "s1", "s2"), ("azure", "DEPENDS_ON", "s2", "s1"), ("azure", "BELONGS_TO_STAGE", "j1", "s1"), ("azure", "BELONGS_TO_STAGE", "j2", "s2"), ("azure", "DEPENDS_ON", "j2", "j1"), ("jenkins", "NEXT_STAGE", "A", "B"), ("kubernetes", "USES_IMAGE", "web", "nginx:1"), ("kubernetes", "MOUNTS_CONFIG", "web", "cfg"),
    ("kustomize", "IMPORTS", "kustomization", "a.yaml"), ("kustomize", "IMPORTS", "kustomization", "p.yaml"), ("dockerfile", "BUILDS_FROM", "base", "a:1"), ("dockerfile", "BUILDS_FROM", "stage-1", "base"), ("dockerfile", "COPIES_FROM", "stage-1", "base"), ("terraform", "DEPENDS_ON", "aws_subnet.s", "aws_vpc.main"), ("cloudformation", "HANDLES_ROUTE", "F", "GET /x"), ("helm_chart", "DEPENDS_ON", "c", "d"),
    ("serverless", "HANDLES_ROUTE", "hello", "GET /users"), ("serverless", "HANDLES_ROUTE", "hello", "POST /y"),
]
_KINDS = {"gitlab": "ep38_gitlab", "github": "ep39_github", "jenkins": "ep40_jenkins", "circleci": "ep41_circleci", "azure": "ep42_azure", "bitbucket": "ep43_bitbucket", "kubernetes": "ep30_kubernetes", "kustomize": "ep31_kustomize", "dockerfile": "ep32_dockerfile", "terraform": "ep44_terraform", "cloudformation": "ep11_cloudformation", "serverless": "ep11_serverless", "helm_chart": "ep45_helm"}
_PIPE_NODES = {
    "gitlab": [("Stage", "build", "0"), ("Stage", "test", "1"), ("Job", "compile", "build"), ("Job", "unit", "test"), ("Job", "extra", ""), ("Job", "lint", "test")], "github": [("Pipeline", "ci", "pull_request,push"), ("Job", "a", ""), ("Job", "b", "")], "jenkins": [("Stage", "A", "0"), ("Stage", "B", "1")], "circleci": [("Job", "c1", ""), ("Job", "c2", "")],
    "azure": [("Pipeline", "azure-pipelines", "main"), ("Stage", "s1", "0"), ("Stage", "s2", "1"), ("Job", "j1", "s1"), ("Job", "j2", "s2")], "bitbucket": [("Job", "one", ""), ("Job", "step-2", "")], "kubernetes": [("Resource", "web", "Pod")], "kustomize": [], "dockerfile": [("Docker_Image", "base", "a:1"), ("Docker_Image", "stage-1", "base")], "terraform": [("Infra", "aws_vpc.main", "resource"), ("Infra", "aws_subnet.s", "resource")],
    "cloudformation": [("Infra", "F", "AWS::Serverless::Function"), ("Route", "GET /x", "")], "serverless": [("Infra", "hello", "h.main"), ("Route", "GET /users", ""), ("Route", "POST /y", "")], "helm_chart": [("Infra", "c", "1")],
}


def _config(kind: str, name: str) -> None:
    from graphloom.queries.samples import frame, values

    def nodes(spark, d):
        return configs.config_graph(frame(spark, _PIPES))[0].where(F.col("kind") == kind).select("label", "name", "detail")

    def edges(spark, d):
        files = frame(spark, _PIPES)
        found, kinds = configs.config_graph(files)[1], configs.kinds(files)
        return found.join(kinds, "rel_path").where(F.col("kind") == kind).select("type", "source", "target")

    links = [r[1:] for r in _PIPE_EDGES if r[0] == kind]
    if _PIPE_NODES[kind]:
        QUERIES[f"{name}_nodes"], ORACLES[f"{name}_nodes"] = nodes, values(("label string, name string, detail string", _PIPE_NODES[kind]))
    if links:
        QUERIES[f"{name}_edges"], ORACLES[f"{name}_edges"] = edges, values(("type string, source string, target string", links))


for _kind, _name in _KINDS.items():
    _config(_kind, _name)


@R.whole("nodes", sql="SELECT id FROM nodes WHERE qualified_name LIKE 'meridian-core.%' AND name = 'index' UNION ALL SELECT id FROM nodes WHERE id IN (1, 2, 3)")
def fp9_point_lookups(nodes):
    named = nodes.where(F.col("qualified_name").startswith("meridian-core.") & (F.col("name") == "index")).select("id")
    return named.unionByName(nodes.where("id in (1, 2, 3)").select("id"))


@R.sample("nodes", sql="SELECT id FROM nodes WHERE (json_extract_string(properties, '$.is_exported') = 'true' AND TRY_CAST(json_extract_string(properties, '$.complexity') AS INT) >= 5 AND label = 'Function') OR json_extract_string(properties, '$.is_test') = 'true' OR json_extract_string(properties, '$.is_entry_point') = 'true'")
def fp11_metadata_filters(nodes):
    from graphloom.operators.search import with_metadata

    both = with_metadata(nodes, label="Function", exported=True, least_complexity=5).select("id")
    return both.unionByName(with_metadata(nodes, test=True).select("id")).unionByName(with_metadata(nodes, entry_point=True).select("id")).distinct()


@R.whole("file_hashes", sql="SELECT DISTINCT rel_path FROM file_hashes WHERE regexp_matches(lower(rel_path), '(^|/)(tests?|__tests__|spec)/|\\.test\\.|\\.spec\\.|(^|/)test_[^/]*$|_test\\.[^./]*$')")
def fp17_test_paths_of_passes(hashes):
    return hashes.where(C.is_test_file(F.col("rel_path"))).select("rel_path").distinct()


@R.whole("file_hashes", "nodes", sql="""
WITH RECURSIVE live AS (SELECT project, rel_path FROM (SELECT project, rel_path, arg_max(coalesce(is_deleted, false), observed_at) AS gone FROM file_hashes GROUP BY ALL) WHERE NOT gone), f AS (SELECT id, project, file_path FROM nodes WHERE label = 'Folder' AND file_path <> '')
SELECT f.id FROM f WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.project = f.project AND starts_with(l.rel_path, f.file_path || '/'))""")
def sc17_empty_folders(hashes, nodes):
    """Folders below which no live file is left: each live file keeps all folders of its path."""
    live = hashes.groupBy("project", "rel_path").agg(F.max_by(F.coalesce("is_deleted", F.lit(False)), "observed_at").alias("gone")).where("not gone")
    s = F.split("rel_path", "/")
    kept = live.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.when(F.size(s) > 1, F.array_join(F.slice(s, F.lit(1), i), "/")))).alias("file_path")).distinct()
    return nodes.where("label = 'Folder' and file_path <> ''").join(kept, ["project", "file_path"], "left_anti").select("id")


@R.whole("nodes", sql="""
WITH s AS (SELECT project, file_path, array_to_string(list(name ORDER BY start_line, name, id), ',') AS symbols FROM nodes WHERE label IN ('Class', 'Interface', 'Enum') AND file_path <> '' GROUP BY ALL) SELECT * FROM s""")
def sc18_symbols_by_file(nodes):
    """The directory form: the types of each file in their order."""
    kept = nodes.where(F.col("label").isin("Class", "Interface", "Enum") & (F.col("file_path") != ""))
    return kept.groupBy("project", "file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name", "id"))), lambda x: x["name"]), ",").alias("symbols"))


@R.sample("nodes", sql="""
WITH t AS (SELECT unnest([{'s': 'getUsers', 't': 'findAllUsers'}, {'s': 'main', 't': 'getUsers'}, {'s': 'main', 't': 'missing'}, {'s': 'main', 't': 'getUsers'}]) AS x), n AS (SELECT name, min(id) AS id FROM nodes WHERE project = 'web' GROUP BY 1) SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM t JOIN n a ON a.name = x.s JOIN n b ON b.name = x.t""")
def sc21_traces(nodes):
    """Call traces given as JSON, as edges between the symbols they name."""
    traces = '[{"source": "getUsers", "target": "findAllUsers"}, {"source": "main", "target": "getUsers"}, {"source": "main", "target": "missing"}, {"source": "main", "target": "getUsers"}, {"oops": 1}]'
    given = nodes.sparkSession.createDataFrame([("web", traces)], "project string, traces string")
    return derive.trace_edges(given, nodes)


_TYPED = ("symbol_id bigint, project string, name string, label string, parameters array<string>, return_type string", [(1, "p", "find", "Method", ["List<User>", "int"], "Optional<Order>"), (2, "p", "User", "Class", None, None), (3, "p", "Order", "Interface", None, None), (4, "q", "User", "Class", None, None), (5, "p", "make", "Function", [], "User")])


@R.expected("source_id bigint, target_id bigint", [(1, 2), (1, 3), (5, 2)], symbols=_TYPED)
def ep7_type_reference_cases(symbols):
    """TYPE_REF: the types of the project that parameters and return types name."""
    used = symbols.select("symbol_id", "project", F.explode(F.flatten(F.transform(F.concat(F.coalesce("parameters", F.array().cast("array<string>")), F.array(F.coalesce("return_type", F.lit("")))), lambda t: F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0))))).alias("name")).distinct()
    t = symbols.where(F.col("label").isin("Class", "Interface", "Enum")).select("project", "name", F.col("symbol_id").alias("target_id"))
    return used.join(t, ["project", "name"]).select(F.col("symbol_id").alias("source_id"), "target_id").distinct()


_CALLEES = [("requests.get", "HTTP_CALLS"), ("lib.Axios.post", "HTTP_CALLS"), ("bus.kafka.Producer.send", "ASYNC_CALLS"), ("app.celery.task", "ASYNC_CALLS"), ("dotenv.load", "CONFIGURES"), ("app.Config.read", "CONFIGURES"), ("math.sqrt", "CALLS")]


@R.expected("callee string, kind string", _CALLEES, calls=("callee string", [(c,) for c, _ in _CALLEES]))
def ep8_service_pattern_cases(calls):
    return calls.select("callee", C.service_kind(F.col("callee")).alias("kind"))


_LOG = ("log string", [
    ("c1\x1f100\n\n3\t1\ta.rs\n2\t0\tb.rs\n-\t-\tlogo.png\n",), ("c2\x1f200\n\n1\t1\ta.rs\n1\t0\tb.rs\n",), ("c3\x1f300\n\n5\t5\ta.rs\n1\t1\tb.rs\n1\t1\tc.rs\n",), ("c4\x1f400\n\n0\t9\tc.rs\n",), ("c5\x1f500\n",),
])


@R.expected("path string, commits bigint, churn bigint, last_at bigint, last_commit string", [("a.rs", 3, 16, 300, "c3"), ("b.rs", 3, 5, 300, "c3"), ("c.rs", 2, 11, 400, "c4"), ("logo.png", 1, 0, 100, "c1")], logs=_LOG)
def ep35_file_statistics(logs):
    return history.file_statistics(history.changes(logs))


@R.expected("a string, b string, together bigint", [("a.rs", "b.rs", 3)], logs=_LOG)
def ep35_files_changed_together(logs):
    return history.changed_together(history.changes(logs))


@R.expected("id bigint, commits bigint", [(1, 1), (3, 2)], logs=_LOG, symbols=("id bigint, file_path string", [(1, "a.rs"), (2, "logo.png"), (3, "c.rs")]))
def ep35_recently_modified(logs, symbols):
    return history.recently_modified(history.changes(logs), symbols, 300)


@R.whole("documents", sql=f"SELECT doc_id, array_to_string(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def ft1_folded_tokens(documents):
    return documents.where("text is not null").select("doc_id", F.array_join(search.tokens(F.col("text")), " ").alias("tokens"))


_STEMS = [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("sky", "sky")]


@R.expected("word string, stem string", _STEMS, words=("word string", [(w,) for w, _ in _STEMS]))
def ft1_stems(words):
    return search.stemmed(words.select("word", F.array("word").alias("stems")), "stems").select("word", F.col("stems")[0].alias("stem"))


def _bm25_sql(words: list[str], limit: str) -> str:
    count = lambda f, w: f"len(list_filter({f}, lambda x: x = '{w}'))"
    tf = ", ".join(f"{count('p', w)} * 1.0::DOUBLE + {count('t', w)} * 5.0::DOUBLE AS tf{i}" for i, w in enumerate(words))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / m))" for i in range(len(words)))
    split = lambda f: f"list_filter(string_split_regex(strip_accents(lower(coalesce({f}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"WITH k AS (SELECT doc_id, {split('path')} AS p, {split('text')} AS t FROM documents), c AS (SELECT doc_id, len(p) + len(t) AS dl, {tf} FROM k), s AS (SELECT count(*) AS n, avg(dl) AS m, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(words)))} FROM c) SELECT doc_id, round({part}, 6) AS score FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(words)))} ORDER BY 2 DESC, doc_id {limit}"


@R.whole("documents", sql=_bm25_sql(["harbor", "ledger"], ""))
def ft3_weighted_bm25(documents):
    """All documents for the keywords of a question, the text counting five times the path."""
    return search.weighted_bm25(documents, "doc_id", {"path": 1.0, "text": 5.0}, "Is the harbor in a ledger?", None).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@R.expected("id bigint, layer int", [(1, 0), (3, 1), (2, 1), (4, 2)], nodes=("id bigint, project string, name string, qualified_name string, properties string", [(1, "p", "getUser", "p.getUser", "{}"), (2, "p", "a", "p.a", "{}"), (3, "p", "b", "p.b", "{}"), (4, "p", "c", "p.c", '{"x": "user"}'), (5, "q", "d", "q.d", None)]), contents=("project string, qualified_name string, content string", [("p", "p.a", "user and much else that is said here at length"), ("p", "p.b", "user user"), ("q", "q.d", "none"), ("p", "p.getUser", "user")]))
def ft4_broad_search(nodes, contents):
    return search.broad_search(nodes, contents, "user", 10).select("id", "layer")


@R.sample("nodes", sql="SELECT c.project, c.qualified_name, n.id FROM contents c JOIN nodes n ON n.project = c.project AND n.qualified_name = c.qualified_name WHERE contains(c.content, 'run')", contents=("project string, qualified_name string, content string", [("web", "web.main", "run it"), ("web", "web.none", "run"), ("api", "web.main", "run"), ("web", "web.Store", None)]))
def j4_texts_with_nodes(nodes, contents):
    hit = contents.where(F.contains("content", F.lit("run"))).select("project", "qualified_name")
    return hit.join(nodes.select("project", "qualified_name", "id"), ["project", "qualified_name"])


@R.expected("source_id bigint, target_id bigint", [(1, 3), (2, 3)], symbols=("project string, symbol_id bigint, file_path string, name string, label string, body_text string", [("p", 1, "a", "f", "Function", "f() { LIMIT + g(x) }"), ("p", 2, "b", "m", "Method", "m() { return LIMIT; LIMIT }"), ("p", 3, "c", "LIMIT", "Class", None), ("p", 4, "d", "g", "Function", "g() {}"), ("p", 5, "c", "k", "Function", "k(LIMIT)"), ("q", 6, "e", "h", "Function", "LIMIT")]))
def ep22_usage_cases(symbols):
    return P.usages(symbols)


@R.expected("source_id bigint, target_id bigint", [(1, 3), (2, 5)], symbols=("project string, symbol_id bigint, name string, label string, decorators array<string>", [("p", 1, "f", "Function", ["@cached(1)", "@unknown"]), ("p", 2, "C", "Class", ["Injectable"]), ("p", 3, "cached", "Function", None), ("p", 4, "cached", "Method", None), ("p", 5, "Injectable", "Class", []), ("q", 6, "g", "Function", ["cached"])]))
def ep5_decorator_cases(symbols):
    return ep5_decorators(symbols)
