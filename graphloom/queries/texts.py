"""Queries over files, symbols and documents: change sets, extraction, derived edges, search, services."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import fixed
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators.incremental import changed_records
from graphloom.sources import extract
from graphloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of the named tables, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[table(spark, d, t) for t in tables])
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LATEST = "SELECT project, rel_path, arg_max(coalesce(lower(sha256), ''), observed_at) AS sha, arg_max(coalesce(is_deleted, false), observed_at) AS gone, arg_max(size, observed_at) AS size FROM file_hashes {} GROUP BY ALL"


def _latest(hashes):
    return hashes.groupBy("project", "rel_path").agg(F.max(F.struct("observed_at", F.coalesce(F.lower("sha256"), F.lit("")).alias("sha"), F.coalesce("is_deleted", F.lit(False)).alias("gone"), "size")).alias("s")).select("project", "rel_path", "s.sha", "s.gone", "s.size")


@query("file_hashes", sql=f"""
WITH a AS ({_LATEST.format('WHERE scan_id <= 4')}), b AS ({_LATEST.format('')}), x AS (SELECT * FROM a WHERE NOT gone), y AS (SELECT * FROM b WHERE NOT gone)
SELECT coalesce(x.project, y.project) AS project, coalesce(x.rel_path, y.rel_path) AS rel_path, CASE WHEN x.sha IS NULL THEN 'new' WHEN y.sha IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM x FULL JOIN y ON x.project = y.project AND x.rel_path = y.rel_path WHERE x.sha IS DISTINCT FROM y.sha""")
def sc6_change_set(hashes):
    return changed_records(_latest(hashes).where("not gone"), _latest(hashes.where("scan_id <= 4")).where("not gone"), ["project", "rel_path"], "sha")


@query("file_hashes", sql=_LATEST.format(""))
def sc10_upserted_hashes(hashes):
    return _latest(hashes)


@query("file_hashes", "nodes", sql=f"""
WITH live AS (SELECT project, rel_path FROM ({_LATEST.format('')}) WHERE NOT gone)
SELECT n.id, n.label FROM nodes n ANTI JOIN live l ON l.project = n.project AND l.rel_path = regexp_replace(replace(n.file_path, '\\', '/'), '^\\./', '') WHERE n.label NOT IN ('Folder', 'Project')""")
def sc17_nodes_of_deleted_files(hashes, nodes):
    live = _latest(hashes).where("not gone").select("project", F.col("rel_path").alias("at"))
    return nodes.where(~F.col("label").isin("Folder", "Project")).withColumn("at", C.forward(F.col("file_path"))).join(live, ["project", "at"], "left_anti").select("id", "label")


@query("file_hashes", "nodes", sql=f"""
WITH a AS ({_LATEST.format('WHERE scan_id <= 6')}), b AS ({_LATEST.format('')}), c AS (SELECT b.project, b.rel_path FROM b JOIN a USING (project, rel_path) WHERE a.sha <> b.sha)
SELECT n.id FROM nodes n SEMI JOIN c ON c.project = n.project AND c.rel_path = regexp_replace(replace(n.file_path, '\\', '/'), '^\\./', '') WHERE n.label NOT IN ('File', 'Folder', 'Project')""")
def sc16_stale_symbols(hashes, nodes):
    old = _latest(hashes.where("scan_id <= 6")).select("project", "rel_path", F.col("sha").alias("before"))
    changed = _latest(hashes).join(old, ["project", "rel_path"]).where("sha <> before").select("project", F.col("rel_path").alias("at"))
    return nodes.where(~F.col("label").isin("File", "Folder", "Project")).withColumn("at", C.forward(F.col("file_path"))).join(changed, ["project", "at"], "left_semi").select("id")


@query("documents", sql="SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def sc18_source_slice(documents):
    return documents.where("text is not null").select("doc_id", C.slice_lines(F.col("text"), 2, 4).alias("lines"))


@query("documents", sql="""
SELECT doc_id, line_no, trim(line, ' ') AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL) WHERE contains(line, 'registry')""")
def sc19_line_grep(documents):
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.contains("line", F.lit("registry"))).select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.trim("line").alias("content"))


_EXT_SQL = "CASE " + " ".join(f"WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]+)$', 1)) = '{e}' THEN '{lang}'" for e, lang in fixed.LANGUAGE_OF.items()) + " ELSE 'unknown' END"


@query("file_hashes", sql=f"SELECT project, {_EXT_SQL} AS language, count(*) AS files FROM (SELECT DISTINCT project, rel_path FROM file_hashes) GROUP BY ALL")
def sc3_languages(hashes):
    return hashes.select("project", "rel_path").distinct().groupBy("project", C.language(F.col("rel_path")).alias("language")).agg(F.count("*").alias("files"))


@query("projects", sql=f"SELECT a.name AS source_project, b.name AS target_project FROM projects a JOIN projects b ON a.name <> b.name AND regexp_extract(a.name, '[^-]*$') = regexp_extract(b.name, '[^-]*$')")
def sc27_project_links(projects):
    kind = F.regexp_extract("name", "[^-]*$", 0)
    a, b = projects.select(F.col("name").alias("source_project"), kind.alias("k")), projects.select(F.col("name").alias("target_project"), kind.alias("k"))
    return a.join(b, "k").where("source_project <> target_project").select("source_project", "target_project")


@query("file_hashes", sql="""
WITH p AS (SELECT DISTINCT project, string_split(regexp_replace(replace(rel_path, '\\', '/'), '^\\./', ''), '/') AS s FROM file_hashes)
SELECT DISTINCT project, array_to_string(s[1:i], '/') AS folder, project || '.' || array_to_string(s[1:i], '.') AS qualified_name FROM (SELECT project, s, unnest(generate_series(1, len(s) - 1)) AS i FROM p)""")
def ex20_folders(hashes):
    p = hashes.select("project", F.split(C.forward(F.col("rel_path")), "/").alias("s")).distinct().where("size(s) > 1")
    each = p.select("project", "s", F.explode(F.expr("sequence(1, size(s) - 1)")).alias("i"))
    return each.select("project", F.expr("array_join(slice(s, 1, i), '/')").alias("folder"), F.expr("concat(project, '.', array_join(slice(s, 1, i), '.'))").alias("qualified_name")).distinct()


@query("ts_symbols", sql=r"""
WITH b AS (SELECT symbol_id, regexp_replace(regexp_replace(body_text, '(?m)^[ \t]*/\*[\s\S]*?\*/[^\n]*', '', 'g'), '(?m)^[ \t]*(//|#)[^\n]*', '', 'g') AS t FROM ts_symbols WHERE body_text IS NOT NULL)
SELECT DISTINCT symbol_id, 1 + """ + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in (*fixed.BRANCH_WORDS, *fixed.BRANCH_OPERATORS)) + " AS complexity FROM b")
def ex18_complexity(symbols):
    return symbols.where("body_text is not null").select("symbol_id", C.complexity(F.col("body_text")).alias("complexity")).distinct()


def _declarations() -> list[tuple[str, str]]:
    """A pattern for each label: the keywords by which any language declares it, and a name (group 1)."""
    words: dict[str, set[str]] = {"Function": {k for g in extract.GRAMMARS.values() for k in g.functions}}
    for table_ in [*(g.containers for g in extract.GRAMMARS.values()), *extract.INDENTED.values()]:
        for keyword, label in table_.items():
            words.setdefault(label, set()).add(keyword)
    return [(label, r"(?:^|\s)(?:" + "|".join(sorted(keys, key=lambda k: (-len(k), k))) + r")\s+([A-Za-z_]\w+)") for label, keys in sorted(words.items()) if label not in ("Impl", "TypeAlias")]


_DECLARATIONS = _declarations()


@query("documents", sql="WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE lower(trim(source)) = 'code')" + " UNION ALL ".join(
    f" SELECT doc_id, line_no, '{label}' AS label, regexp_extract(line, '{pattern}', 1) AS name FROM l WHERE regexp_matches(line, '{pattern}')" for label, pattern in _DECLARATIONS))
def ex15_declarations(documents):
    """Declarations by the keywords of all languages, line by line: what is left where no grammar is known."""
    lines = documents.where(F.lower(F.trim("source")) == "code").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    found = [F.when(F.col("line").rlike(p), F.struct(F.lit(label).alias("label"), F.regexp_extract("line", p, 1).alias("name"))) for label, p in _DECLARATIONS]
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.explode(F.array_compact(F.array(*found))).alias("d")).select("doc_id", "line_no", "d.label", "d.name")


@query("ts_symbols", sql="""
SELECT DISTINCT symbol_id, is_test OR starts_with(lower(name), 'test') OR regexp_matches(lower(file_path), '\\.test\\.|\\.spec\\.|__tests__/|/tests/|/test/|test_') OR ends_with(lower(file_path), '_test.go') OR ends_with(lower(file_path), '_test.rs') AS test,
  coalesce(len(string_split(body_text, chr(10))), end_line - start_line + 1)::BIGINT AS line_count FROM ts_symbols""")
def ex17_symbol_metadata(symbols):
    test = F.col("is_test") | F.lower("name").startswith("test") | C.is_test_path(F.col("file_path"))
    return symbols.select("symbol_id", test.alias("test"), F.coalesce(F.when(F.col("body_text").isNotNull(), F.size(F.split("body_text", "\n"))), F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("line_count")).distinct()


_BASIC_TYPES = "int int32 int64 str string bool boolean float double void any none object list dict map vec option result self usize error".split()


@query("ts_symbols", sql=f"""
SELECT DISTINCT symbol_id, symbol, type FROM (
  SELECT symbol_id, name || '::' || p.name AS symbol, p.type AS type FROM (SELECT symbol_id, name, unnest(parameters) AS p FROM ts_symbols)
  UNION ALL SELECT symbol_id, name || '::return', return_type FROM ts_symbols) WHERE type IS NOT NULL AND lower(type) NOT IN ({_quoted(_BASIC_TYPES)})""")
def ex22_type_assignments(symbols):
    p = symbols.select("symbol_id", "name", F.explode("parameters").alias("p")).select("symbol_id", F.concat("name", F.lit("::"), "p.name").alias("symbol"), F.col("p.type").alias("type"))
    both = p.unionByName(symbols.select("symbol_id", F.concat("name", F.lit("::return")).alias("symbol"), F.col("return_type").alias("type")))
    return both.where(F.col("type").isNotNull() & ~F.lower("type").isin(_BASIC_TYPES)).distinct()


@query("ts_symbols", sql="SELECT project, name, count(DISTINCT symbol_id) AS symbols, count(DISTINCT file_path) AS files FROM ts_symbols GROUP BY ALL")
def ex24_symbol_registry(symbols):
    return symbols.groupBy("project", "name").agg(F.count_distinct("symbol_id").alias("symbols"), F.count_distinct("file_path").alias("files"))


@query("ts_symbols", sql=r"""
WITH s AS (SELECT DISTINCT symbol_id, project, file_path, name, label, body_text FROM ts_symbols),
t AS (SELECT DISTINCT symbol_id, project, file_path, name AS self, unnest(regexp_extract_all(body_text, '\w+')) AS w FROM s WHERE label IN ('Function', 'Method') AND body_text IS NOT NULL),
c AS (SELECT DISTINCT symbol_id, unnest(regexp_extract_all(body_text, '(\w+)\s*\(', 1)) AS w FROM s WHERE label IN ('Function', 'Method') AND body_text IS NOT NULL)
SELECT DISTINCT t.symbol_id AS source_id, r.symbol_id AS target_id, CASE WHEN c.w IS NOT NULL AND r.label IN ('Function', 'Method') THEN 'CALLS' ELSE 'USES' END AS type
FROM t JOIN s r ON r.project = t.project AND r.name = t.w AND r.file_path <> t.file_path LEFT JOIN c ON c.symbol_id = t.symbol_id AND c.w = t.w""")
def ep1_calls(symbols):
    """Word tokens of bodies joined with the symbol names of other files of the project."""
    body = symbols.where(F.col("label").isin("Function", "Method") & F.col("body_text").isNotNull())
    called = F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"(\w+)\s*\("), F.lit(1)))
    t = body.select("symbol_id", "project", "file_path", F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"\w+"), F.lit(0))).alias("ws"), called.alias("cs"))
    tokens = t.select("symbol_id", "project", "file_path", F.explode(F.transform("ws", lambda w: F.struct(w.alias("w"), F.array_contains("cs", w).alias("c")))).alias("x")).select("symbol_id", "project", "file_path", F.col("x.w").alias("name"), F.col("x.c").alias("called"))
    r = symbols.select("project", "name", F.col("symbol_id").alias("target_id"), F.col("label").alias("tl"), F.col("file_path").alias("tf")).distinct()
    kind = F.when(F.col("called") & F.col("tl").isin("Function", "Method"), "CALLS").otherwise("USES")
    return tokens.join(r, ["project", "name"]).where("file_path <> tf").select(F.col("symbol_id").alias("source_id"), "target_id", kind.alias("type")).distinct()


@query("ts_symbols", sql="""
WITH b AS (SELECT DISTINCT symbol_id, project, unnest(base_classes) AS base FROM ts_symbols), t AS (SELECT DISTINCT symbol_id, project, name, label FROM ts_symbols),
r AS (SELECT b.symbol_id AS source_id, t.symbol_id AS target_id, t.label, row_number() OVER (PARTITION BY b.symbol_id, b.base ORDER BY CASE WHEN t.label IN ('Class', 'Interface') THEN 0 ELSE 1 END, t.symbol_id) AS rn FROM b JOIN t ON t.project = b.project AND t.name = b.base)
SELECT DISTINCT source_id, target_id, CASE WHEN label = 'Interface' THEN 'IMPLEMENTS' ELSE 'INHERITS' END AS type FROM r WHERE rn = 1""")
def ep5_base_classes(symbols):
    b = symbols.select("symbol_id", "project", F.explode("base_classes").alias("name")).distinct()
    t = symbols.select("project", "name", F.col("symbol_id").alias("target_id"), "label").distinct()
    first = W.partitionBy("symbol_id", "name").orderBy(F.when(F.col("label").isin("Class", "Interface"), 0).otherwise(1), "target_id")
    best = b.join(t, ["project", "name"]).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return best.select(F.col("symbol_id").alias("source_id"), "target_id", F.when(F.col("label") == "Interface", "IMPLEMENTS").otherwise("INHERITS").alias("type")).distinct()


@query("ts_symbols", sql=r"""
WITH u AS (SELECT DISTINCT symbol_id, project, unnest(regexp_extract_all(type, '\w+')) AS w FROM (SELECT symbol_id, project, unnest(parameters).type AS type FROM ts_symbols UNION ALL SELECT symbol_id, project, return_type FROM ts_symbols) WHERE type IS NOT NULL)
SELECT DISTINCT u.symbol_id AS source_id, t.symbol_id AS target_id FROM u JOIN ts_symbols t ON t.project = u.project AND t.name = u.w AND t.label IN ('Class', 'Interface', 'Enum') WHERE t.symbol_id <> u.symbol_id""")
def ep7_type_references(symbols):
    types = symbols.select("symbol_id", "project", F.explode(F.concat(F.coalesce(F.transform("parameters", lambda p: p["type"]), F.array().cast("array<string>")), F.array("return_type"))).alias("type"))
    used = types.where("type is not null").select("symbol_id", "project", F.explode(F.regexp_extract_all("type", F.lit(r"\w+"), F.lit(0))).alias("name")).distinct()
    t = symbols.where(F.col("label").isin("Class", "Interface", "Enum")).select("project", "name", F.col("symbol_id").alias("target_id")).distinct()
    return used.join(t, ["project", "name"]).where("symbol_id <> target_id").select(F.col("symbol_id").alias("source_id"), "target_id").distinct()


@query("ts_symbols", sql="""
WITH m AS (SELECT DISTINCT project, file_path, parent_name, split_part(regexp_replace(name, '([A-Z_])', ' \\1'), ' ', 1) AS verb FROM ts_symbols WHERE label = 'Method' AND parent_name IS NOT NULL),
o AS (SELECT DISTINCT m.project || '|' || m.file_path || '|' || m.parent_name AS k, t.label, m.verb FROM m JOIN ts_symbols t ON t.project = m.project AND t.file_path = m.file_path AND t.name = m.parent_name AND t.label IN ('Class', 'Interface')),
n AS (SELECT k AS need, count(*) AS size FROM o WHERE label = 'Interface' GROUP BY k)
SELECT a.k AS owner, b.k AS need FROM o a JOIN o b ON a.verb = b.verb AND a.label = 'Class' AND b.label = 'Interface' JOIN n ON n.need = b.k GROUP BY a.k, b.k, n.size HAVING count(*) = n.size""")
def ep14_method_sets(symbols):
    """Classes whose methods, by leading verb, include all of an interface: relational division."""
    verb = F.split(F.regexp_replace("name", "([A-Z_])", " $1"), " ")[0]
    m = symbols.where("label = 'Method' and parent_name is not null").select("project", "file_path", "parent_name", verb.alias("member")).distinct()
    t = symbols.where(F.col("label").isin("Class", "Interface")).select("project", "file_path", F.col("name").alias("parent_name"), "label").distinct()
    o = m.join(t, ["project", "file_path", "parent_name"]).select(F.concat_ws("|", "project", "file_path", "parent_name").alias("k"), "label", "member").distinct()
    return G.supersets(o.where("label = 'Class'").select(F.col("k").alias("owner"), "member"), o.where("label = 'Interface'").select(F.col("k").alias("need"), "member"))


@query("documents", sql=r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:export |process\.env\.|getenv\(.|os\.environ\[.|env::var\(.|\$\{)([A-Z][A-Z0-9_]+)', 1)) AS variable FROM documents WHERE text IS NOT NULL")
def ep21_environment_variables(documents):
    pattern = r"(?:export |process\.env\.|getenv\(.|os\.environ\[.|env::var\(.|\$\{)([A-Z][A-Z0-9_]+)"
    return documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("variable")).distinct()


@query("documents", sql=r"SELECT doc_id, w AS channel, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\w+\.(?:emit|on|publish|subscribe|push|debug)\([\x22\x27]([a-z_]+)', 1)) AS w FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def ep18_channels(documents):
    found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\w+\.(?:emit|on|publish|subscribe|push|debug)\([\x22\x27]([a-z_]+)"), F.lit(1))).alias("channel"))
    return found.groupBy("doc_id", "channel").agg(F.count("*").alias("n"))


@query("file_hashes", sql="""
SELECT project, rel_path, count(DISTINCT lower(sha256)) AS versions, count(DISTINCT scan_id) AS scans, max(observed_at) AS last_seen, arg_max(lower(sha256), observed_at) AS last_sha, sum(DISTINCT size)::BIGINT AS churn FROM file_hashes GROUP BY ALL""")
def ep35_file_history(hashes):
    return hashes.groupBy("project", "rel_path").agg(F.count_distinct(F.lower("sha256")).alias("versions"), F.count_distinct("scan_id").alias("scans"), F.max("observed_at").alias("last_seen"), F.max_by(F.lower("sha256"), "observed_at").alias("last_sha"), F.sum_distinct("size").alias("churn"))


@query("lineitem", sql="""
WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS together FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 3""")
def ep35_changed_together(lineitem):
    p = lineitem.select("l_orderkey", F.col("l_partkey").alias("a")).distinct()
    return p.join(p.withColumnRenamed("a", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where("together >= 3")


_KEYS = ("DATABASE_URL", "cache.batchSize", "LEDGER", "renderQueue", "config.stream.cursor")


@query("nodes", sql="""
WITH k AS (SELECT unnest(['DATABASE_URL', 'cache.batchSize', 'LEDGER', 'renderQueue', 'config.stream.cursor']) AS key, unnest([['database', 'url'], ['cache', 'batch', 'size'], ['ledger'], ['render', 'queue'], ['stream', 'cursor']]) AS t)
SELECT key, id, round(s, 3) AS confidence FROM (SELECT k.key, n.id, len(list_filter(k.t, lambda x: contains(lower(n.name), x)))::DOUBLE / len(k.t) AS s FROM k, nodes n) WHERE s > 0.5""")
def ep20_config_links(nodes):
    """Keys, a fixed list, against all names: the fraction of a key's parts that a name contains."""
    hits = []
    for key in _KEYS:
        bare = key.removeprefix("config.").removeprefix("settings.")
        parts = bare.lower().split("_") if bare.isupper() else [x for x in "".join(f" {c}" if c.isupper() else " " if c in "_.-" else c for c in bare).lower().split()]
        score = sum((F.contains(F.lower("name"), F.lit(p)).cast("double") for p in parts[1:]), F.contains(F.lower("name"), F.lit(parts[0])).cast("double")) / len(parts)
        hits.append(F.when(score > 0.5, F.struct(F.lit(key).alias("key"), F.round(score, 3).alias("confidence"))))
    return nodes.select("id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.key", "id", "h.confidence")


@query("documents", sql=f"""
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: strlen(x) > 1 AND x NOT IN ({_quoted(fixed.STOP_WORDS)})), ' ') AS keywords
FROM documents WHERE text IS NOT NULL""")
def fp15_keywords(documents):
    """All keywords of a text, in its order."""
    return documents.where("text is not null").select("doc_id", F.array_join(C.keywords(F.col("text")), " ").alias("keywords"))


@query("documents", sql="SELECT doc_id FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x IN ('harbor', 'token', 'only'))) AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) = 3")
def ft2_boolean_and(documents):
    return S.boolean_and(documents, "doc_id", "text", "harbor token only").select(F.col("doc").alias("doc_id"))


@query("documents", sql="""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'harbor')) AS a, len(list_filter(t, lambda x: x = 'symbol')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0 ORDER BY 2 DESC, doc_id LIMIT 20""")
def ft3_bm25(documents):
    return S.bm25(documents, "doc_id", "text", "harbor symbol", 20).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("nodes", sql="""
WITH n AS (SELECT id, name, list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(name, '(\\p{Lu})', ' \\1', 'g'), '[-_./]', ' ', 'g')), ' '), lambda x: x <> '')) AS p FROM nodes WHERE name IS NOT NULL)
SELECT id, round(score, 6) AS score FROM (SELECT id, CASE WHEN contains(lower(name), 'cache-batch') THEN 1.0::DOUBLE WHEN contains(lower(regexp_replace(name, '[-_./{}]', '', 'g')), 'cachebatch') THEN 0.8::DOUBLE
  WHEN len(list_intersect(p, ['cache', 'batch']))::DOUBLE / (len(p) + 2 - len(list_intersect(p, ['cache', 'batch']))) > 0.3 THEN len(list_intersect(p, ['cache', 'batch']))::DOUBLE / (len(p) + 2 - len(list_intersect(p, ['cache', 'batch']))) * 0.6 END AS score FROM n) WHERE score IS NOT NULL""")
def ft7_scope_match(nodes):
    return nodes.where("name is not null").select("id", F.round(C.scope_score("cache-batch", F.col("name")), 6).alias("score")).where("score is not null")


@query("ts_symbols", sql="""
WITH n AS (SELECT DISTINCT project, file_path FROM ts_symbols), c AS (SELECT project, file_path, regexp_replace(file_path, '\\.([^./]*)$', '') AS base, regexp_extract(file_path, '\\.[^./]*$') AS ext FROM n)
SELECT DISTINCT c.project, c.file_path, t.file_path AS test_path FROM c JOIN n t ON t.project = c.project AND (t.file_path IN (c.base || '.test' || c.ext, c.base || '.spec' || c.ext)
  OR (regexp_extract(t.file_path, '^.*/') = regexp_extract(c.file_path, '^.*/') AND t.file_path <> c.file_path AND regexp_matches(lower(t.file_path), '\\.test\\.|\\.spec\\.|__tests__/|/tests/|/test/|test_')))""")
def sv4_tests_for_files(symbols):
    n = symbols.select("project", "file_path").distinct()
    folder = F.regexp_extract("file_path", "^.*/", 0)
    named = n.select("project", "file_path", F.explode(F.array(*[F.concat(C.strip_extension(F.col("file_path")), F.lit(k), F.regexp_extract("file_path", r"\.[^./]*$", 0)) for k in (".test", ".spec")])).alias("test_path"))
    by_name = named.join(n.select("project", F.col("file_path").alias("test_path")), ["project", "test_path"]).select("project", "file_path", "test_path")
    beside = n.withColumn("folder", folder).join(n.where(C.is_test_path(F.col("file_path"))).select("project", F.col("file_path").alias("test_path"), folder.alias("folder")), ["project", "folder"]).where("file_path <> test_path")
    return by_name.unionByName(beside.select("project", "file_path", "test_path")).distinct()


@query("projects", "nodes", sql=f"""
WITH p AS (SELECT name, list_filter(string_split_regex(lower(name), '[-_.]'), lambda x: len(x) > 2 AND x NOT IN ({_quoted(fixed.GENERIC_NAME_WORDS)})) AS k, regexp_replace(lower(name), '-engine|-api|-frontend|-backend|-service|-web|-app|-core', '', 'g') AS stem FROM projects),
t AS (SELECT DISTINCT project, name FROM nodes WHERE label IN ('Class', 'Interface')), s AS (SELECT a.project AS pa, b.project AS pb, count(*) AS n FROM t a JOIN t b ON a.name = b.name AND a.project < b.project GROUP BY ALL)
SELECT a, b, round(points / 100.0, 2) AS score FROM (SELECT x.name AS a, y.name AS b, CASE WHEN contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) OR x.stem = y.stem THEN 25 ELSE 0 END + least(30, 10 * coalesce(s.n, 0)) + least(15, 8 * len(list_filter(x.k, lambda w: list_contains(y.k, w)))) AS points
  FROM p x JOIN p y ON x.name < y.name LEFT JOIN s ON s.pa = x.name AND s.pb = y.name) WHERE points > 0""")
def sv5_link_suggestions(projects, nodes):
    return S.link_suggestions(projects, nodes).drop("reasons")


# usage log: the events table as tool calls
_CALLS = "(SELECT event_id AS id, event_type AS tool, CASE event_id % 3 WHEN 0 THEN 'ui' ELSE 'mcp' END AS source, CAST(floor(value * 10) AS BIGINT) AS ms, event_type <> 'error' AS ok, 'agent' || (user_id % 4) AS agent, length(props) AS bytes, ts FROM events)"


def _calls(events):
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 3 == 0, "ui").otherwise("mcp").alias("source"), F.floor(F.col("value") * 10).alias("ms"), (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent"), F.length("props").alias("bytes"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query("events", sql=f"SELECT tool, count(*) AS calls, round(avg(ms), 4) AS mean_ms, count(*) FILTER (WHERE source = 'mcp') AS mcp, count(*) FILTER (WHERE source = 'ui') AS ui, count(*) FILTER (WHERE ok) AS succeeded FROM {_CALLS} GROUP BY tool")
def a8_calls_per_tool(events):
    return _calls(events).groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.count_if(F.col("source") == "mcp").alias("mcp"), F.count_if(F.col("source") == "ui").alias("ui"), F.count_if("ok").alias("succeeded"))


@query("events", sql=f"SELECT agent, tool, count(*) AS calls, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM {_CALLS} WHERE source = 'mcp' GROUP BY ALL")
def a9_calls_per_agent(events):
    return _calls(events).where("source = 'mcp'").groupBy("agent", "tool").agg(F.count("*").alias("calls"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))


@query("events", sql=f"""
SELECT used, greatest(without, used) AS without, greatest(without, used) - used AS saved FROM (SELECT count(*) * 50 + coalesce(sum(bytes), 0)::BIGINT // 4 AS used, count(*) * {fixed.OTHER_TOOL_COST} AS without FROM {_CALLS} WHERE source = 'mcp')""")
def a11_token_savings(events):
    cost = F.lit(fixed.OTHER_TOOL_COST)
    for price, tools in fixed.TOOL_COSTS.items():
        cost = F.when(F.col("tool").isin(*tools), price).otherwise(cost)
    x = _calls(events).where("source = 'mcp'").agg((F.count("*") * 50 + F.expr("coalesce(sum(bytes), 0) div 4")).alias("used"), F.coalesce(F.sum(cost), F.lit(0)).alias("w"))
    return x.select("used", F.greatest("w", "used").alias("without"), (F.greatest("w", "used") - F.col("used")).alias("saved"))


@query("events", sql=f"SELECT id, tool, agent FROM {_CALLS} ORDER BY id DESC LIMIT 100")
def t3_recent_calls(events):
    return _calls(events).orderBy(F.desc("id")).limit(100).select("id", "tool", "agent")


@query("events", sql=f"SELECT tool, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS calls, sum(ms)::BIGINT AS ms FROM {_CALLS} GROUP BY ALL")
def st2_tumbling(events):
    return _calls(events).groupBy("tool", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("calls"), F.sum("ms").alias("ms")).select("tool", F.col("w.start").alias("start"), "calls", "ms")


@query("events", sql=f"SELECT tool, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, count(*) AS calls FROM {_CALLS}, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def st2_sliding(events):
    return _calls(events).groupBy("tool", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("calls")).select("tool", F.col("w.start").alias("start"), "calls")


@query("events", sql=f"""
WITH g AS (SELECT agent, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS first FROM {_CALLS} WINDOW w AS (PARTITION BY agent ORDER BY ts)),
s AS (SELECT agent, ts, sum(first) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT agent, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS stop, count(*) AS calls FROM s GROUP BY agent, k""")
def st2_sessions(events):
    return _calls(events).groupBy("agent", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("calls")).select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "calls")
