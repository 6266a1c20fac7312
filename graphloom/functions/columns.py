"""Column functions over names, paths and source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import fixed


def any_of(column: Column, words) -> Column:
    """Whether the column contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])


def forward(path: Column) -> Column:
    """Path with forward slashes and no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def service_kind(callee: Column) -> Column:
    """What a call is by the library in the callee's qualified name: HTTP_CALLS, ASYNC_CALLS, CONFIGURES or CALLS."""
    qn = F.lower(callee)
    return F.when(any_of(qn, fixed.HTTP_LIBRARIES), "HTTP_CALLS").when(any_of(qn, fixed.BROKER_LIBRARIES), "ASYNC_CALLS").when(any_of(qn, fixed.CONFIG_LIBRARIES), "CONFIGURES").otherwise("CALLS")


def strip_extension(path: Column) -> Column:
    """Path without the extension of its last segment."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def qualified_name(project: Column, path: Column, name: Column | None = None) -> Column:
    """``project.folder.file[.name]``; with a name, a last segment ``__init__`` or ``index`` is dropped."""
    parts = F.filter(F.split(strip_extension(F.regexp_replace(path, r"\\", "/")), "/"), lambda x: x != "")
    if name is not None:
        last = F.try_element_at(parts, F.lit(-1))
        parts = F.when(last.isin("__init__", "index"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.array_join(F.concat(F.array(project), parts, F.array(name)), ".")
    return F.array_join(F.concat(F.array(project), parts), ".")


def language(path: Column) -> Column:
    """Language by file name, else by extension in lower case, else ``unknown``."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    by_name = F.create_map(*[F.lit(x) for pair in fixed.FILE_NAMES.items() for x in pair])
    by_ext = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGE_OF.items() for x in pair])
    return F.coalesce(by_name[name], F.when(name.startswith("Dockerfile"), "dockerfile"), by_ext[ext], F.lit("unknown"))


def keywords(text: Column) -> Column:
    """Search terms of a text: split at blanks, lower case, only letters, digits and underscores, without stop words."""
    cleaned = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))
    return F.filter(cleaned, lambda x: (F.octet_length(x) > 1) & ~x.isin(fixed.STOP_WORDS))


def parts(name: Column) -> Column:
    """Parts of a name: split at ``-_./`` and blanks and before upper-case letters, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(\p{Lu})", " $1"), r"[-_./]", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda x: x != "")


def squeezed(name: Column) -> Column:
    """Lower case without separators."""
    return F.lower(F.regexp_replace(name, r"[-_./{}]", ""))


def scope_score(scope: str, field: Column) -> Column:
    """1.0 if the field contains the scope, 0.8 if it does without separators, else 0.6 times the parts' Jaccard if over 0.3."""
    bare = "".join(c for c in scope.lower() if c not in "-_./{}")
    mine = F.array_distinct(parts(F.lit(scope)))
    theirs = F.array_distinct(parts(field))
    union = F.size(F.array_union(mine, theirs))
    near = F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.size(F.array_intersect(mine, theirs)) / union)
    return F.when(F.contains(F.lower(field), F.lit(scope.lower())), 1.0).when(F.contains(squeezed(field), F.lit(bare)), 0.8).when(near > 0.3, near * 0.6)


def is_test_path(path: Column) -> Column:
    """Whether a path is one of test code."""
    p = F.lower(path)
    return any_of(p, (".test.", ".spec.", "__tests__/", "/tests/", "/test/", "test_")) | p.endswith("_test.go") | p.endswith("_test.rs")


def is_test_file(path: Column) -> Column:
    """Whether a path is one of test code, by whole folders and the ends of the file's name."""
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec)/|\.test\.|\.spec\.|(^|/)test_[^/]*$|_test\.[^./]*$")


def path_penalty(path: Column) -> Column:
    """What a path takes from a search score: 0.4 for tests, 0.3 for mocks and fixtures."""
    p = F.lower(path)
    return F.when(any_of(p, ("/test/", "/tests/", ".test.", ".spec.", "_test.")), 0.4).otherwise(0.0), F.when(any_of(p, ("mock", "fixture", "fake", "stub")), 0.3).otherwise(0.0)


def layer(path: Column) -> Column:
    """Layer of a file by the words of its path, null if none fits."""
    p, out = F.lower(path), F.lit(None).cast("string")
    for name, words in reversed(fixed.LAYERS):
        out = F.when(any_of(p, words), name).otherwise(out)
    return out


def flow_rank(path: Column) -> Column:
    """Rank of a file on a request's way through the layers, null if unknown."""
    p, out = F.lower(path), F.lit(None).cast("int")
    for word, rank in reversed(fixed.FLOW_RANKS):
        out = F.when(F.contains(p, F.lit(word)), rank).otherwise(out)
    return out


def _first_that(rules, holds) -> Column:
    """The name of the first rule of which one word holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [holds(w) for w in words]), name).otherwise(out)
    return out


def spring_layer(name: Column, annotations: Column, path: Column) -> Column:
    """Layer of a Spring symbol: by its first annotation that tells one, else by the end of its name, else by its path."""
    each = F.filter(F.transform(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: _first_that(fixed.SPRING_ANNOTATIONS, lambda w: F.regexp_extract(a, r"^@?(\w*)", 1) == w)), lambda x: x.isNotNull())
    n, p = F.lower(name), F.lower(path)
    return F.coalesce(F.try_element_at(each, F.lit(1)), _first_that(fixed.SPRING_SUFFIXES, n.endswith), _first_that(fixed.SPRING_FOLDERS, lambda w: F.contains(p, F.lit(w))))


def go_layer(name: Column, path: Column) -> Column:
    """Layer of a Go symbol: by its path, else by the end of its name."""
    n, p = F.lower(name), F.concat(F.lit("/"), F.lower(path))
    return F.coalesce(_first_that(fixed.GO_FOLDERS, lambda w: F.contains(p, F.lit(w))), _first_that(fixed.GO_SUFFIXES, n.endswith))


def go_test_kind(name: Column) -> Column:
    """test, benchmark or example by the beginning of a Go function's name, else null."""
    return F.when(name.startswith("Test") & (F.length(name) > 4), "test").when(name.startswith("Benchmark") & (F.length(name) > 9), "benchmark").when(name.startswith("Example"), "example")


def go_verb(call: Column) -> Column:
    """The HTTP method that a router's method of that name registers, in capitals or title case, else null."""
    known = F.upper(call).isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") & ((call == F.upper(call)) | (call == F.initcap(call)))
    return F.when(known, F.upper(call)).when(call == "Any", "ANY")


def go_framework(path: Column) -> Column:
    """The web or test framework that a Go import path names, else null."""
    return F.when(path == "net/http", "net/http").otherwise(_first_that(fixed.GO_FRAMEWORKS, lambda w: F.contains(path, F.lit(w))))


def go_standard(path: Column) -> Column:
    """Whether a Go import path is of the standard library."""
    return ~path.rlike("[./]") | F.split(path, "/")[0].isin(*fixed.GO_STANDARD)


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def complexity(source: Column) -> Column:
    """Cyclomatic complexity: 1 plus the branch words and operators of the lines that are no comments."""
    code = F.regexp_replace(source, r"(?m)^[ \t]*/\*[\s\S]*?\*/[^\n]*", "")
    code = F.regexp_replace(code, r"(?m)^[ \t]*(//|#)[^\n]*", "")
    return reduce(lambda a, b: a + b, [occurrences(code, w) for w in (*fixed.BRANCH_WORDS, *fixed.BRANCH_OPERATORS)], F.lit(1).cast("bigint"))


def route_template(path: Column) -> Column:
    """Route path with ``:id`` and ``{id}`` written as ``{param}``, in lower case and without a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(path), r":[a-z0-9_]+", "{param}"), r"\{[^}]*\}", "{param}"), r"(.)/$", "$1")


def slice_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, joined by line feeds."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")
