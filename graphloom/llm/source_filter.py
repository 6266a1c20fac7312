"""Generated, minified or vendored source files, told from hand-written source by layout, header and place.

Layout is judged by lexing: a file's tokens are emitted again in canonical formatting, and the original is compared with
that. Text that unfolds into many times its lines is minified; text of which literals make up nearly all is data saved
as code; text that equals its canonical form line by line, with lines of one shape, was printed by a tool. Where only
size and line count of a file are known, the canonical form is taken to have lines of CANONICAL_WIDTH characters, which
gives the same expansion ratio without the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean characters of a line in canonical formatting, and the expansion beyond which a layout isn't for readers.
CANONICAL_WIDTH, EXPANDED = 40, 6.0
#: Share of a file's characters in literals, and the least size, beyond which it is data.
LITERAL_SHARE, DATA_CHARS = 0.85, 2000

# Folders that hold code of others, as package managers and common practice name them.
VENDOR_FOLDERS = (
    "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "third_party", "third-party", "thirdparty",
    "3rdparty", "3rd_party", "3rd-party", "_vendor", "extern", "externals", "pods", "carthage", "godeps", ".venv", "venv", ".yarn",
)
# Folders that tools write.
OUTPUT_FOLDERS = ("generated", "__generated__", "autogen", "autogenerated", "auto_generated", "codegen-out", "generated-sources", "gen-src")
# Endings that tools give to the files they write.
OUTPUT_NAMES = (
    r"\.pb\.(go|cc|h|rb|swift)$", r"_pb2(_grpc)?\.pyi?$", r"\.pb2?\.(js|ts)$", r"_pb\.(js|d\.ts|ts)$", r"\.(g|gr|freezed|mocks)\.dart$",
    r"\.(g|g\.i|designer|generated)\.cs$", r"[._-]gen\.[a-z]+$", r"[._-]generated\.[a-z]+$", r"^zz_generated\.", r"\.tab\.(c|h|cc|cpp|hpp)$",
    r"^lex\d*\.yy\.(c|cc|cpp)$", r"_wrap\.(c|cc|cpp|cxx)$", r"^moc_.*\.(c|cc|cpp)$", r"^ui_.*\.h$", r"^qrc_.*\.cpp$",
)
# Names of files compressed or bundled for delivery.
DELIVERY_NAMES = (r"[.-]min\.(js|mjs|css)$", r"\.bundle\.(js|mjs|css)$")
# A name with the hash of its content (group 1), which must hold a digit.
HASHED_NAME = r"[.-]([0-9a-f]{8,})\.(js|mjs|css)$"
# A library saved under its name and release.
RELEASE_NAME = r"^[a-z][\w.-]*?[-_.]v?\d+\.\d+\.\d+([.-](min|slim|umd))?\.(js|mjs|css)$"
# What tools and importers write into the first line.
TOOL_HEADERS = (
    r"@generated\b", r"<auto-?generated", r"\bgenerated by\b.*\bdo not (edit|modify)\b", r"\bcode generated by\b", r"\bautogenerated\b",
    r"\b(file|code) (is|was|has been) (auto(matically)?[ -]?)?(generated|created|produced|written) by\b", r"\bautomatisch (erzeugt|generiert|erstellt)\b",
    r"\bautomatically (created|generated|produced|written)\b", r"\bmachine[- ](written|generated|made)\b", r"\bchanges (are|will be) (lost|overwritten)\b",
    r"^\W*output of \S+ v?\d[\w.]* on\b", r"\bgenerado autom[aá]ticamente\b", r"\bgénéré automatiquement\b",
)
COPY_HEADERS = (
    r"\b(bundled|vendored|verbatim) copy of\b", r"\btaken over unchanged\b", r"\bsend (changes|patches) upstream\b", r"\bvendored (from|copy)\b",
    r"\b(copied|imported) (verbatim|unchanged) from\b",
)

# The tokens of curly-brace and indented languages alike; comments and strings first.
_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<string>\"\"\".*?\"\"\"|'''.*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\b)|(?P<word>\w+)|(?P<break>[;{}])|(?P<other>[^\s\w])""",
    re.DOTALL,
)


def layout(text: str) -> tuple[int, int, float, float]:
    """(lines, lines in canonical formatting, share of literal characters, share of lines that have the commonest shape).

    Canonical formatting ends a line after a semicolon, a brace and a comment, where the original ends one, and where a
    line would pass twice CANONICAL_WIDTH.
    """
    rows = text.splitlines()
    lines = sum(1 for r in rows if r.strip())
    canonical, width, literal, ink, last = 0, 0, 0, 0, 0
    for m in _TOKEN.finditer(text):
        token, kind = m.group(), m.lastgroup
        ink += len(token)
        if kind in ("string", "number"):
            literal += len(token)
        elif kind == "other" and token == ",":
            literal += 1  # the commas between literals belong to the data
        if width and ("\n" in text[last : m.start()] or width + len(token) > 2 * CANONICAL_WIDTH):
            canonical, width = canonical + 1, 0
        width += len(token) + 1
        if kind in ("break", "comment"):
            canonical, width = canonical + 1, 0
        last = m.end()
    canonical += bool(width)
    shapes: dict[str, int] = {}
    for r in rows:
        if r.strip():
            shape = re.sub(r"\w+", "w", r)
            shapes[shape] = shapes.get(shape, 0) + 1
    return lines, canonical, literal / ink if ink else 0.0, max(shapes.values()) / lines if lines else 0.0


def layouts(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("project", "rel_path")) -> DataFrame:
    """The layout of each text: the ``keep`` columns, lines, canonical_lines, literal_share, one_shape.

    Null and empty texts have no lines.
    """
    spec = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [layout(t or "") for t in pdf["__text"]]
            yield pdf[list(keep)].assign(lines=[g[0] for g in got], canonical_lines=[g[1] for g in got], literal_share=[g[2] for g in got], one_shape=[g[3] for g in got])

    return files.select(*keep, F.col(content).alias("__text")).mapInPandas(run, f"{spec}, lines bigint, canonical_lines bigint, literal_share double, one_shape double")


def clean_path(path: Column) -> Column:
    """Path with forward slashes and without a leading ``./`` or slash."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(\./)*/?", "")


def judge(path: Column, header: Column, expansion: Column, literal_share: Column, size: Column, one_shape: Column | None = None) -> Column:
    """Why a file isn't hand-written: vendored, generated, minified or data; null for hand-written files.

    A header decides first, then the place, then the layout; any of the arguments may be null.
    """
    p = F.lower(clean_path(path))
    name = F.regexp_extract(p, r"[^/]*$", 0)
    h = F.lower(header)
    folder = lambda names: p.rlike(r"(^|/)(" + "|".join(re.escape(x) for x in names) + r")/")
    any_of = lambda c, patterns: c.rlike("|".join(f"(?:{x})" for x in patterns))
    # a folder "vendor" counts if a package folder follows or assets lie in it; below a Java root it is a package name
    hashed = F.regexp_extract(name, HASHED_NAME, 1).rlike(r"\d")
    vendor = (p.rlike(r"(^|/)vendor/[^/]+/") & ~p.rlike(r"(^|/)(java|kotlin|scala)/(.*/)?vendor/")) | p.rlike(r"(^|/)(assets|public|static|web|www|js|css)/vendor/")
    data_name = p.rlike(r"(^|/)(data|fixtures|testdata)/[^/]*_(map|table|dump|blob)\.[a-z]+$") & expansion.isNull()
    shaped = F.coalesce(one_shape, F.lit(0.0)) if one_shape is not None else F.lit(0.0)
    expanded = F.coalesce(expansion, F.lit(0.0)) >= EXPANDED
    data = (F.coalesce(literal_share, F.lit(0.0)) >= LITERAL_SHARE) & (F.coalesce(size, F.lit(0)) >= DATA_CHARS)
    return (
        F.when(any_of(h, COPY_HEADERS), "vendored").when(any_of(h, TOOL_HEADERS), "generated")
        .when(folder(VENDOR_FOLDERS) | vendor | name.rlike(RELEASE_NAME), "vendored")
        .when(folder(OUTPUT_FOLDERS) | any_of(name, OUTPUT_NAMES), "generated")
        .when(any_of(name, DELIVERY_NAMES) | hashed, "minified")
        .when(data | data_name | (expanded & p.rlike(r"(^|/)(data|fixtures|testdata)/")), "data").when(expanded, "minified").when(shaped >= 0.95, "generated")
    )


def file_layouts(texts: DataFrame) -> DataFrame:
    """(lp, lr, lines, expansion, literal_share, one_shape) of each file of ``texts(project, rel_path, content)``.

    A file may come whole or in several fragments, whose lines are added up; shares are weighted by lines, so that no
    task gathers a file's texts.
    """
    each = layouts(texts)
    weighted = lambda c: F.sum(F.col(c) * F.col("lines")) / F.sum("lines")
    by_file = each.where("lines > 0").groupBy(F.col("project").alias("lp"), F.col("rel_path").alias("lr"))
    return by_file.agg(F.sum("lines").alias("lines"), (F.sum("canonical_lines") / F.sum("lines")).alias("expansion"), weighted("literal_share").alias("literal_share"), weighted("one_shape").alias("one_shape"))


def not_hand_written(hashes: DataFrame, nodes: DataFrame, texts: DataFrame | None = None, fragments: bool = False) -> DataFrame:
    """(project, rel_path, reason) of the files of ``hashes`` that are generated, minified, vendored or data.

    Evidence is the lexed text of files with rows in ``texts(project, rel_path, content)``, the path, the header and line
    count of the File node (joined by project and cleaned path) and the largest size on record. With ``fragments`` the
    texts are parts of files, and the expansion by size and line count, which is of the whole, counts beside theirs.
    Defined cases: a file without a node is judged by its path; properties that are null or hold no line count fall back
    to the node's end_line; a null path gives no row; deleted files count like others; repeated rows count once; empty
    tables give no rows; further columns are ignored.
    """
    files = hashes.where("rel_path is not null").groupBy("project", "rel_path").agg(F.max("size").alias("size"))
    noted = (
        nodes.where("label = 'File' and file_path is not null").select(
            F.col("project").alias("np"), clean_path(F.col("file_path")).alias("at"), F.get_json_object("properties", "$.header").alias("header"),
            F.coalesce(F.expr("try_cast(get_json_object(properties, '$.line_count') as bigint)"), F.col("end_line").cast("bigint")).alias("line_count"),
        ).groupBy("np", "at").agg(F.max("header").alias("header"), F.max("line_count").alias("line_count"))
    )
    known = files.withColumn("at0", clean_path(F.col("rel_path"))).join(noted, F.col("project").eqNullSafe(F.col("np")) & (F.col("at0") == F.col("at")), "left")
    by_size = F.when(F.col("line_count") > 0, F.col("size") / F.lit(float(CANONICAL_WIDTH)) / F.col("line_count"))
    if texts is None:
        reason = judge(F.col("rel_path"), F.col("header"), by_size, F.lit(None).cast("double"), F.col("size"))
        return known.select("project", "rel_path", reason.alias("reason")).where("reason is not null")
    both = known.join(file_layouts(texts), F.col("project").eqNullSafe(F.col("lp")) & (F.col("rel_path") == F.col("lr")), "left")
    expansion = F.greatest("expansion", by_size) if fragments else F.coalesce(F.col("expansion"), by_size)
    reason = judge(F.col("rel_path"), F.col("header"), expansion, F.col("literal_share"), F.col("size"), F.when(F.col("lines") >= 20, F.col("one_shape")))
    return both.select("project", "rel_path", reason.alias("reason")).where("reason is not null").distinct()
