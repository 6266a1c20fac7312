"""Linking names to what they mean: types, call targets, imported packages, overridden methods, configuration keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Type names of the standard libraries, which are never resolved.
STANDARD_TYPES = (
    "string str String int int8 int16 int32 int64 i8 i16 i32 i64 u8 u16 u32 u64 uint uint8 uint16 uint32 uint64 isize usize f32 f64 float float32 float64 double long short byte char bool boolean number bigint symbol void any unknown never null undefined object Object Array Map Set List Dict dict list "
    "set tuple None Optional Union Any Self self error rune Vec HashMap HashSet Option Result Box Rc Arc Promise Record Partial Date Error Integer Long Boolean Double Float Character Collection ArrayList"
).split()
# How the languages annotate a name with a type; groups 1 and 2 are name and type.
ANNOTATIONS = {
    "typescript": r"\b(?:const|let|var|private|public|protected|readonly)\s+(\w+)\s*[?!]?:\s*([A-Za-z_]\w*)", "python": r"(?m)^\s*(?:self\.)?(\w+)\s*:\s*([A-Za-z_]\w*)\s*=", "rust": r"\blet\s+(?:mut\s+)?(\w+)\s*:\s*&?(?:mut\s+)?([A-Za-z_]\w*)",
    "go": r"\bvar\s+(\w+)\s+\*?(?:\w+\.)?([A-Za-z_]\w*)", "java": r"(?m)^\s*(?:private|public|protected|final|static|\s)*?\b([A-Z]\w*)(?:<[^>]*>)?\s+(\w+)\s*[=;]", "c": r"(?m)^\s*(?:const\s+)?(?:struct\s+)?([A-Za-z_]\w*)\s*[*&]?\s+\*?(\w+)\s*[=;]",
}
#: Languages that write the type first.
TYPE_FIRST = ("java", "c")
# Languages that annotate like another.
SAME_ANNOTATIONS = {"tsx": "typescript", "javascript": "typescript", "kotlin": "typescript", "cpp": "c", "csharp": "java"}
# Keys of configuration files by extension; group 1 is the key.
CONFIG_KEYS = {"json": r"^\s*\"([A-Za-z_]\w*)\"\s*:", "yaml": r"^([A-Za-z_]\w*)\s*:", "yml": r"^([A-Za-z_]\w*)\s*:", "toml": r"^([A-Za-z_]\w*)\s*=", "ini": r"^([A-Za-z_]\w*)\s*=", "env": r"^([A-Za-z_]\w*)\s*="}
# What is cut from the ends of a configuration key before it is split.
KEY_PREFIXES, KEY_SUFFIXES = r"^(?:\.env\.)*(?:config\.)*(?:settings\.)*", r"(?:\.json)*$"


def annotated_types(files: DataFrame) -> DataFrame:
    """(rel_path, name, type) of the annotated variables of ``files(rel_path, language, content)``, standard types left out."""
    family = F.col("language")
    for language, other in SAME_ANNOTATIONS.items():
        family = F.when(F.col("language") == language, other).otherwise(family)
    found = F.array().cast("array<struct<name: string, type: string>>")
    for language, pattern in ANNOTATIONS.items():
        first, second = (2, 1) if language in TYPE_FIRST else (1, 2)
        each = F.zip_with(F.regexp_extract_all("content", F.lit(pattern), F.lit(first)), F.regexp_extract_all("content", F.lit(pattern), F.lit(second)), lambda n, t: F.struct(n.alias("name"), t.alias("type")))
        found = F.when(F.col("family") == language, each).otherwise(found)
    rows = files.withColumn("family", family).select("rel_path", F.explode(found).alias("x")).select("rel_path", "x.name", "x.type")
    return rows.where(~F.col("type").isin(*STANDARD_TYPES, "return", "new", "else", "throw")).distinct()


def resolved_types(uses: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Each of ``uses(file, name)`` with the type of that name in its own file, else in a directly imported one, or null.

    ``types(file, name, type)``, ``imports(file, target)``; of several imported files the least path counts.
    """
    own = types.groupBy("file", "name").agg(F.min("type").alias("own"))
    far = imports.select("file", "target").distinct().join(types.select(F.col("file").alias("target"), "name", "type"), "target").groupBy("file", "name").agg(F.min(F.struct("target", "type")).alias("far"))
    return uses.select("file", "name").distinct().join(own, ["file", "name"], "left").join(far, ["file", "name"], "left").select("file", "name", F.coalesce("own", F.col("far.type")).alias("type"))


def call_targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """(file, name, target_id) of ``calls(file, name)``: the symbols a called name can mean.

    Of several symbols of the name the one in an imported file counts if it is the only such one, else the one whose
    qualified name holds the type that the name has in the file if it is the only such one; else all of them count. Names
    of standard types give none. ``symbols(id, name, file, qualified_name)``.
    """
    named = calls.select("file", "name").distinct().where(~F.col("name").isin(*STANDARD_TYPES))
    typed = resolved_types(named, types, imports).select("file", "name", "type")
    imported = imports.select("file", F.col("target").alias("symbol_file")).distinct().withColumn("imported", F.lit(True))
    candidates = named.join(symbols.select("name", F.col("id").alias("target_id"), F.col("file").alias("symbol_file"), "qualified_name"), "name").join(imported, ["file", "symbol_file"], "left").join(typed, ["file", "name"], "left")
    of_type = F.col("type").isNotNull() & F.contains("qualified_name", F.col("type"))
    site = W.partitionBy("file", "name")
    n_imported, n_typed = F.count_if(F.col("imported")).over(site), F.count_if(of_type).over(site)
    marked = candidates.select("file", "name", "target_id", F.coalesce("imported", F.lit(False)).alias("i"), F.coalesce(of_type, F.lit(False)).alias("t"), n_imported.alias("ni"), n_typed.alias("nt"))
    return marked.where("case when ni = 1 then i when nt = 1 then t else true end").select("file", "name", "target_id")


def package_targets(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(rel_path, target, qualified_name) of the imports that name a package of ``packages(specifier, qualified_name)``.

    A target names a package by its whole text or by its base: ``@scope/name`` or the part before the first slash.
    """
    base = F.when(F.col("target").startswith("@"), F.regexp_extract("target", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.split("target", "/")[0])
    p = packages.groupBy("specifier").agg(F.min("qualified_name").alias("qn"))
    keyed = imports.withColumn("base", base)
    exact, near = p.select(F.col("specifier").alias("target"), F.col("qn").alias("exact")), p.select(F.col("specifier").alias("base"), F.col("qn").alias("near"))
    both = keyed.join(exact, "target", "left").join(near, "base", "left")
    return both.select("rel_path", "target", F.coalesce("exact", "near").alias("qualified_name")).where("qualified_name is not null")


def relative_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, target, file) of the relative imports that name a file of ``files(rel_path)``, also without its extension
    or as the index of a folder."""
    joined = F.regexp_replace(F.concat(F.regexp_extract("rel_path", r"^(.*/)?", 0), "target"), r"(^|/)\./", "$1")
    for _ in range(6):  # one folder up at a time; deeper chains stay unresolved
        joined = F.regexp_replace(joined, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    wanted = imports.where(F.col("target").startswith(".")).withColumn("stem", joined)
    path = F.col("rel_path")
    keys = F.array_distinct(F.array(path, F.regexp_replace(path, r"\.[^./]+$", ""), F.regexp_replace(path, r"/index\.[^./]+$", "")))
    held = files.select(F.explode(keys).alias("stem"), path.alias("file")).groupBy("stem").agg(F.min("file").alias("file"))
    return wanted.join(held, "stem").select("rel_path", "target", "file")


def overriding(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, type): OVERRIDES and DELEGATES_TO links of methods.

    A method overrides the methods of its name elsewhere if ``@Override`` stands within three lines before it or above it
    in its body's range, or if it is declared with the word override; ``this.field.name(`` and ``self.field.name(``
    delegate from the enclosing function to the methods of that name in other files.
    ``files(rel_path, content)``, ``symbols(id, name, label, file_path, start_line, end_line)``.
    """
    lines = files.select("rel_path", F.posexplode(F.split("content", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)
    s = symbols.select("id", F.col("name").alias("own"), F.col("file_path").alias("rel_path"), "start_line", "end_line")
    methods = symbols.where("label = 'Method'").select(F.col("id").alias("target_id"), "name", F.col("file_path").alias("target_file"))
    marks = lines.where(F.col("text").rlike(r"@Override\b")).select("rel_path", "line").join(s, "rel_path").where("start_line between line and line + 3 or line between start_line and end_line")
    after = F.when(F.col("start_line") >= F.col("line"), 0).otherwise(1)
    near = marks.withColumn("rn", F.row_number().over(W.partitionBy("rel_path", "line").orderBy(after, F.when(after == 0, F.col("start_line")).otherwise(-F.col("start_line")), "id"))).where("rn = 1").select("id", F.col("own").alias("name"))
    word = lines.select("rel_path", "line", F.regexp_extract("text", r"\boverride\b.*?\b(\w+)\s*\(", 1).alias("name")).where("name <> ''")
    worded = word.join(s, "rel_path").where("own = name and start_line between line - 1 and line + 1").select("id", "name")
    over = near.unionByName(worded).distinct().join(methods, "name").where("id <> target_id").select(F.col("id").alias("source_id"), "target_id", F.lit("OVERRIDES").alias("type"))
    sent = lines.select("rel_path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:this|self)\.\w+\.(\w+)\s*\("), F.lit(1))).alias("name"))
    inside = sent.join(s, "rel_path").where("line between start_line and end_line").groupBy("rel_path", "line", "name").agg(F.max_by("id", "start_line").alias("source_id"))
    given = inside.join(methods, "name").where("target_file <> rel_path").select("source_id", "target_id", F.lit("DELEGATES_TO").alias("type"))
    return over.unionByName(given).distinct()


def declared_bases(files: DataFrame) -> DataFrame:
    """(rel_path, name, base, type) of the class lines of ``files(rel_path, language, content)``: INHERITS or IMPLEMENTS."""
    text = F.col("content")
    pairs = []
    brace = F.col("language").isin("typescript", "tsx", "javascript", "java")
    # How class lines name what a class is derived from; groups 1 and 2 are the class and the list.
    for kind, wanted, pattern in (
        ("INHERITS", brace, r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"), ("IMPLEMENTS", brace, r"\bclass\s+(\w+)[^{\n]*?\bimplements\s+([\w., <>]+)"), ("INHERITS", F.col("language") == "python", r"(?m)^\s*class\s+(\w+)\(([\w., ]+)\)"),
        ("INHERITS", F.col("language") == "ruby", r"(?m)^\s*class\s+(\w+)\s*<\s*([\w:]+)"), ("IMPLEMENTS", F.col("language") == "rust", r"\bimpl(?:<[^>]*>)?\s+(?=[\w:<>]+\s+for)([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)"),
    ):
        first, second = (2, 1) if "for\\s+" in pattern else (1, 2)
        each = _pairs(text, pattern, first, second, kind)
        pairs.append(F.when(wanted, each).otherwise(F.array().cast("array<struct<name: string, bases: string, type: string>>")))
    rows = files.select("rel_path", F.explode(F.concat(*pairs)).alias("x")).select("rel_path", "x.name", F.explode(F.split("x.bases", ",")).alias("base"), "x.type")
    return rows.select("rel_path", "name", F.regexp_extract("base", r"^\s*([\w.:]+)", 1).alias("base"), "type").where("base <> '' and base <> 'object'").distinct()


def _pairs(text: Column, pattern: str, first: int, second: int, kind: str) -> Column:
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(first)), F.regexp_extract_all(text, F.lit(pattern), F.lit(second)), lambda n, b: F.struct(n.alias("name"), b.alias("bases"), F.lit(kind).alias("type")))


def config_keys(files: DataFrame) -> DataFrame:
    """(rel_path, key): the keys of configuration files among ``files(rel_path, content)``, each once a file."""
    extension = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1))
    lines = files.select("rel_path", extension.alias("x"), F.explode(F.split("content", "\r?\n")).alias("line"))
    key = F.lit("")
    for name, pattern in CONFIG_KEYS.items():
        key = F.when(F.col("x") == name, F.regexp_extract("line", pattern, 1)).otherwise(key)
    return lines.select("rel_path", key.alias("key")).where("key <> ''").distinct()


def key_tokens(key: Column) -> Column:
    """The parts of a configuration key in lower case: at underscores if it is all capitals, else also at dots, dashes and
    capitals; common prefixes and file endings are cut off."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(key, KEY_PREFIXES, ""), KEY_SUFFIXES, ""), r"(?:\.yaml)*$", ""), r"(?:\.yml)*$", ""), r"(?:\.toml)*$", "")
    spaced = F.when(bare.rlike(r"^(?=.*\p{L})[\p{Lu}_0-9]+$"), F.regexp_replace(bare, "_", " ")).otherwise(F.regexp_replace(F.regexp_replace(bare, r"(\p{Lu})", " $1"), "[_.-]", " "))
    return F.filter(F.split(F.lower(spaced), " "), lambda t: t != "")


def config_links(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, id, confidence) of keys and names of which more than half of the key's tokens are part.

    A name that holds a token holds each three letters of it, so names and tokens meet by these instead of all with all:
    of a key's tokens one more than half must be held, so it is enough to look up all but that many of them, the longest
    first. Tokens of fewer than three letters meet with the names by the letters they have. ``names(id, name)``.
    """
    k = keys.select("key").distinct().withColumn("t", key_tokens(F.col("key"))).where(F.size("t") > 0)
    # at most n - (n div 2 + 1) tokens may be missing, so one of any n - n div 2 is held
    wanted = F.slice(F.reverse(F.array_sort(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))), 1, F.size("t") - F.floor(F.size("t") / 2).cast("int"))
    probes = k.select("key", "t", F.explode(wanted).alias("w")).select("key", "t", F.substring("w.t", 1, 3).alias("gram"))
    low = F.lower("name")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    held = names.where("name <> ''").select("id", "name", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    met = probes.join(held, "gram").select("key", "t", "id", "name").distinct()
    share = F.size(F.filter("t", lambda x: F.contains(F.lower("name"), x))) / F.size("t")
    return met.select("key", "id", share.alias("s")).where("s > 0.5").select("key", "id", F.round("s", 3).alias("confidence"))


def usages(symbols: DataFrame) -> DataFrame:
    """(source_id, target_id): symbols of other files of the project that a body names without calling them."""
    body = symbols.where(F.col("label").isin("Function", "Method") & F.col("body_text").isNotNull())
    called = F.regexp_extract_all("body_text", F.lit(r"\b(\w+)\s*\("), F.lit(1))
    named = body.select("project", F.col("file_path").alias("f"), F.col("symbol_id").alias("source_id"), F.explode(F.array_except(F.regexp_extract_all("body_text", F.lit(r"\w+"), F.lit(0)), called)).alias("name"))
    r = symbols.select("project", "name", F.col("symbol_id").alias("target_id"), "file_path").distinct()
    return named.join(r, ["project", "name"]).where("f <> file_path").select("source_id", "target_id").distinct()


def tests_of(symbols: DataFrame, is_test: Column) -> DataFrame:
    """(source_id, target_id): test functions and the symbols outside tests that their bodies name."""
    marked = symbols.withColumn("t", is_test)
    body = marked.where(F.col("t") & F.col("label").isin("Function", "Method") & F.col("body_text").isNotNull())
    named = body.select("project", F.col("symbol_id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    targets = marked.where(~F.col("t")).select("project", "name", F.col("symbol_id").alias("target_id")).distinct()
    return named.join(targets, ["project", "name"]).where("source_id <> target_id").select("source_id", "target_id").distinct()
