"""Functions paired with their documentation.

The comments of a source text, and documentation recorded apart from it, are candidates for the functions declared in it.
A comment can belong to the declaration that follows it, to the one whose body it opens, and to any later one it names. A
link is scored by the distance between comment and declaration, by parameter tags that name the function's parameters, by
mentions of its name and of other functions' names; links that reach no least score are implausible. The best one-to-one
assignment decides, and descriptions that tell nothing are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.extract import end_lines

#: Scores: a recorded documentation, a comment that touches its declaration, a mention of the name, of another function's
#: name instead, and parameter tags that all fit; the least score of a plausible link.
RECORDED, TOUCHING, NAMED, OTHER_NAMED, TAGGED, PLAUSIBLE = 6.0, 2.0, 0.75, -0.5, 1.0, 1.0

# Comment marks at the ends of a line.
_OPENING = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\w)|/{2,}!?|#+(?![\[!])|--+(?=\s|$)|;;+|[rRuUbB]{0,2}\"\"\"|[rRuUbB]{0,2}'''|<!--|%+(?=\s|$))?[ \t]*")
_CLOSING = re.compile(r"[ \t]*(?:\*+/|\"\"\"|'''|-->)?[ \t]*$")
_WORD = re.compile(r"[^\W_]")
_LINE_COMMENT = re.compile(r"^\s*(?://|#(?!\[|!|\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma|undef|error|region|endregion)\b)|--(?:\s|$))")
_ATTRIBUTE = re.compile(r"^\s*(?:@[\w.]+(?:\(.*\))?|#\[.*\]|\[[\w.]+(?:\(.*\))?\])\s*$")
# How the languages declare a function; group 1 is its name.
_DECLARATION = re.compile(
    r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|unsafe|pub(?:\([\w:]+\))?|extern|inline|synchronized|sealed|partial|const|suspend|open|external|def|func|fn|function\*?|fun|sub)\s+)*"
    r"(?:(?:def|func|fn|function\*?|fun|sub)\s+(?:\([^)]*\)\s*)?|(?:[\w.<>\[\],?*&:]+\s+)+)?(?:self\.)?([A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?\("
)
_CONTROL = frozenset("if for while switch catch return match else do try with foreach using lock assert throw new await yield elif print".split())
_PARAMETER_TAG = re.compile(r"(?:@param|@arg|:param|\\param)\s+(?:\{[^}]*\}\s*)?(?:[\w.<>\[\]]+\s+)??`?(\w+)`?|^\s*-\s+`(\w+)`\s*:", re.M)


class Comment(NamedTuple):
    first: int
    last: int
    text: str
    opens_body: bool


class Function(NamedTuple):
    line: int
    name: str
    parameters: frozenset


def plain(comment: str) -> str:
    """A comment's text without comment marks; blank if it holds no letter or digit."""
    if not _WORD.search(comment):
        return ""
    lines = [_CLOSING.sub("", _OPENING.sub("", line, count=1)) for line in comment.replace("\r\n", "\n").split("\n")]
    return "\n".join(lines).strip()


def functions(lines: list[str]) -> list[Function]:
    """The functions declared in the lines."""
    out = []
    for i, line in enumerate(lines):
        if "(" not in line or line.lstrip().startswith(("//", "#", "*", "/*")) or line.rstrip().endswith(";"):
            continue
        m = _DECLARATION.match(line)
        if m and m.group(1) not in _CONTROL and not re.match(r"\s*(?:return|throw|raise|await|new|else|assert|yield|go|defer|del|if|for|while)\b", line):
            inside = line[m.end() :]
            if m.start(1) == len(line) - len(line.lstrip()) and not re.search(r"[{:]\s*$", line):
                continue  # a call, not a declaration
            out.append(Function(i, m.group(1), frozenset(re.findall(r"\w+", inside))))
    return out


def comments(lines: list[str], declared: list[Function]) -> list[Comment]:
    """All comment blocks of the lines, and the string literals that open the bodies of declared functions."""
    out, i = [], 0
    while i < len(lines):
        start, bare = i, lines[i].lstrip()
        if bare.startswith("/*"):
            while i < len(lines) - 1 and "*/" not in lines[i][2 if i == start else 0 :]:
                i += 1
        elif _LINE_COMMENT.match(lines[i]):
            while i < len(lines) - 1 and _LINE_COMMENT.match(lines[i + 1]):
                i += 1
        else:
            i += 1
            continue
        out.append(Comment(start, i, "\n".join(lines[start : i + 1]), False))
        i += 1
    for f in declared:
        at, depth = f.line, 0
        while at < len(lines):  # to the end of the signature
            depth += lines[at].count("(") - lines[at].count(")")
            at += 1
            if depth <= 0:
                break
        while at < len(lines) and lines[at].strip() in ("", "{"):
            at += 1
        m = re.match(r"\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')", lines[at]) if at < len(lines) else None
        if not m:
            continue
        quote, last = m.group(1), at
        if quote not in lines[at][m.end() :]:
            if len(quote) == 1:
                continue
            last += 1
            while last < len(lines) and quote not in lines[last]:
                last += 1
        text = "\n".join(lines[at : last + 1])
        inner = text[m.end() :].rsplit(quote, 1)[0]
        if inner.strip() not in ("use strict", "use client", "use server") and (len(quote) == 3 or re.fullmatch(r"[\s;]*", text[m.end() :].rsplit(quote, 1)[-1])):
            out.append(Comment(at, min(last, len(lines) - 1), inner, True))
    return out


def link_score(c: Comment, f: Function, lines: list[str], others: frozenset[str] = frozenset()) -> float:
    """How plausible it is that the comment documents the function; 0 for implausible links.

    ``others`` are the names of the text's other functions. A comment that neither touches the declaration nor opens its
    body needs evidence by name or tags.
    """
    if c.opens_body:
        if c.first <= f.line or any(_WORD.search(x) for x in lines[f.line + 1 : c.first] if not re.search(r"[(),]|->|:\s*$", x)):
            return 0.0
        distance, score = c.first - f.line, TOUCHING
    else:
        if c.last >= f.line:
            return 0.0
        apart = any(x.strip() and not _ATTRIBUTE.match(x) and not _LINE_COMMENT.match(x) for x in lines[c.last + 1 : f.line])
        distance, score = f.line - c.last, 0.0 if apart else TOUCHING
    said = frozenset(re.findall(r"\w+", c.text))
    score += (1.0 if score else 0.5) / distance
    tags = {a or b for a, b in _PARAMETER_TAG.findall(c.text)}
    if tags:
        score += TAGGED * len(tags & f.parameters) / len(tags)
    if f.name in said:
        score += NAMED
    elif said & others:
        score += OTHER_NAMED
    return score if score >= PLAUSIBLE else 0.0


def plausible_links(declared: list[Function], found: list[Comment], lines: list[str]) -> list[dict[int, float]]:
    """For each function the comments that may document it, with their scores.

    Compared are a comment and the declarations it opens, precedes next or names, not all pairs.
    """
    at = [f.line for f in declared]
    named: dict[str, list[int]] = {}
    for i, f in enumerate(declared):
        named.setdefault(f.name, []).append(i)
    names = frozenset(named)
    out: list[dict[int, float]] = [{} for _ in declared]
    for j, c in enumerate(found):
        near = bisect_right(at, c.first if c.opens_body else c.last) - (1 if c.opens_body else 0)
        wanted = {near} if 0 <= near < len(declared) else set()
        wanted.update(i for w in frozenset(re.findall(r"\w+", c.text)) & names for i in named[w])
        for i in wanted:
            score = link_score(c, declared[i], lines, names - {declared[i].name})
            if score:
                out[i][j] = score
    return out


def assign(score: Sequence[Sequence[float] | Mapping[int, float]]) -> dict[int, int]:
    """The one-to-one assignment of columns to rows with the greatest total score; a row is a mapping or a full list.

    Rows are added one by one, each along the alternating path of greatest gain, which may end at a free column or leave
    another row without one. Only links of positive score are walked, so unconnected parts of a text cost nothing.
    """
    links = [{j: w for j, w in (r.items() if isinstance(r, Mapping) else enumerate(r)) if w > 0} for r in score]
    holder: dict[int, int] = {}
    held: dict[int, int] = {}
    for start in range(len(links)):
        gain, via, queue = {start: 0.0}, {}, deque([start])
        best, last, free = 1e-9, None, None
        while queue:
            r = queue.popleft()
            for c, w in links[r].items():
                if held.get(r) == c:
                    continue
                g, owner = gain[r] + w, holder.get(c)
                if owner is None:
                    if g > best:
                        best, last, free = g, r, c
                elif g - links[owner][c] > gain.get(owner, -1e300) + 1e-9:
                    gain[owner], via[owner] = g - links[owner][c], (r, c)
                    queue.append(owner)
        for r, g in gain.items():
            if r != start and g > best:
                best, last, free = g, r, None
        if last is None:
            continue
        r = last
        if free is None:
            del held[r]
        else:
            held[r], holder[free] = free, r
        while r != start:
            r, c = via[r]
            held[r], holder[c] = c, r
    return held


def source_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def documented(text: str) -> list[tuple[Function, str]]:
    """Each function declared in a source text with the comment assigned to it ("" if there is none)."""
    lines = source_lines(text)
    declared = functions(lines)
    found = comments(lines, declared)
    linked = assign(plausible_links(declared, found, lines))
    return [(f, found[linked[i]].text if i in linked else "") for i, f in enumerate(declared)]


# Notes of work to do, also as whole comments in other languages.
_TO_DO = re.compile(
    r"^\W*(?:todo|fixme|xxx+|tbd|tbc|hack|wip|n/?a|none|pendiente|por documentar|falta documentar|doku(?:mentation)? folgt|beschreibung folgt|noch zu dokumentieren|stub|placeholder|not documented|undocumented|no description|description goes here|document(?:ation)? (?:this|me|goes here|follows|pending))\b"
    r"(?=\W*$|[\s:,(.-])", re.I,
)
_WHOLE_STOCK = re.compile(r"^\W*(?:\{?@inheritdoc\}?|see (?:above|below|code|source|docs?)|\(?see (?:above|below)\)?|same as above|ditto|as above|self[- ]explanatory|siehe oben|véase arriba|ver arriba)\W*$", re.I)
# Orders to tools.
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier|stylelint|noqa|nosec|pylint|flake8|mypy|type:\s*ignore|pyright|fmt:|yapf|isort|pragma|nolint|golint|go:\w+|\+build|clang-format|clang-tidy|NOLINT|cppcheck|istanbul|c8 ignore|@ts-\w+|ts-ignore|ts-expect-error|sonar|noinspection|checkstyle|spotless|rustfmt|clippy|coverage|cspell|spell-?checker|webpackChunkName|@?suppresswarnings|resharper|region|endregion)\b",
    re.I,
)
# Notices of licence and authorship.
_NOTICE = re.compile(
    r"\bcopyright\b|\(c\)\s*\d{4}|©|\ball rights reserved\b|\bspdx-|\blicen[sc]e[ds]?\b|\bthis file is part of\b|^\W*@?(?:author|authors|since|version|created|last[- ](?:change|changed|modified|update|updated)|modified|maintainer|date|owner)\b\s*(?::|$|\S+\s*$|.*\d{4})|^\W*@(?:author|since|version)\b|\bcreated by\b|\bgenerated by\b|\bwritten by\b",
    re.I,
)
_TAG = re.compile(r"^\W*(?:[@\\:](?:param|arg|argument|return|returns|throws|exception|raises|rtype|type|see|deprecated|template|typeparam|yields?)\b|(?:args|arguments|parameters|params|returns?|raises|throws|yields|example|examples|notes?)\s*:\s*$|-\s+`\w+`\s*:|</?(?:summary|param|returns?|remarks)\b)", re.I)
_RETURN_TEXT = re.compile(r"^\W*[@\\:]returns?\b:?\s*(?:\{[^}]*\}\s*)?(.*)$", re.I)
# Lines that are program code.
_CODE = re.compile(
    r"^\s*(?:[\w.\[\]\"'$]+\s*(?:[-+*/|&]?=|:=)\s*\S.*|(?:return|break|continue|import|from|var|let|const|int|string|val)\b.*[;=({].*|[\w.$]+\([^)]*\)\s*;?|(?:if|for|while|switch)\s*\(.*|(?:if|for|while|def|fn|func|class)\s+.*[:{]|[{}()\[\];]+|.*;\s*)\s*$"
)
# Words that say nothing about any one function.
_EMPTY_WORDS = frozenset(
    "the a an this that it its is are be of to for in on and or with by as at from method methods function functions procedure routine member helper helpers utility util utils code implementation impl does do stuff thing things work something internal internally "
    "main default here goes later fill documentation docs doc comment comments describe description describes called used use simple simply just some any handle handles logic operation performs perform executes execute see above below class constructor getter setter".split()
)


def _stems(word: str) -> set[str]:
    out = {word}
    for end, repl in (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ied", "y"), ("ed", ""), ("ed", "e"), ("er", ""), ("d", "")):
        if word.endswith(end) and len(word) > len(end) + 1:
            out.add(word[: -len(end)] + repl)
    return out


def description(comment: str, name: str | None) -> str:
    """What a comment tells about the function of that name; blank if it tells nothing.

    Left out are separators, notes of work to do, tags, tool directives, notices of licence and authorship and disabled
    code; what remains must say more than the name and words that fit any function.
    """
    kept = []
    for line in plain(comment).split("\n"):
        bare = line.strip()
        if not _WORD.search(bare) or _TO_DO.search(bare) or _WHOLE_STOCK.match(bare) or _DIRECTIVE.match(bare) or _NOTICE.search(bare):
            continue
        returned = _RETURN_TEXT.match(bare)
        if returned:
            if len(returned.group(1).split()) > 2:
                kept.append(bare)
        elif not _TAG.match(bare) and not _CODE.match(bare):
            kept.append(bare)
    text = " ".join(kept)
    # the name and its parts, as words of their own
    parts = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name or "")}
    stems = set().union(*(_stems(p) for p in parts)) if parts else set()
    spaced = text.replace(name, " ") if name else text
    told = [w for w in re.findall(r"[^\W\d_]+", spaced.lower()) if w not in _EMPTY_WORDS and not (_stems(w) & stems)]
    return text if told else ""


def describe(name: str | None, docstring: str | None, body: str | None) -> str:
    """The description of a function whose text is ``body``: of what assignment links to it, recorded or in the text."""
    lines = source_lines(body or "")
    declared = functions(lines)
    own = next((i for i, f in enumerate(declared) if name is None or f.name == name), None)
    recorded = docstring if docstring and plain(docstring) else None
    if own is None:
        if recorded is None:
            return ""
        own = len(declared)  # a declaration in a form unknown here, taken to come last
        declared = [*declared, Function(len(lines), name or "", frozenset())]
    found = comments(lines, declared[: own + 1] if declared[own].line < len(lines) else declared[:own])
    links = plausible_links(declared, found, lines)
    if recorded is not None:
        links[own][len(found)] = RECORDED
        found.append(Comment(declared[own].line, declared[own].line, recorded, True))
    linked = assign(links)
    return description(found[linked[own]].text, name) if own in linked else ""


def code_description_pairs(symbols: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """(symbol_id, signature, body_text, description) of the functions and methods whose documentation tells what they do.

    The documentation is the docstring or, if that holds nothing but blanks and comment marks, the comment that
    assignment links to the function within its own text. Defined cases: a null or empty body gives no row; a null name
    takes the first function of the text; null signatures are kept as null; symbols given twice give repeated rows;
    empty tables give no rows; further columns are ignored.
    """
    kind = symbols.schema[id_col].dataType.simpleString()
    wanted = symbols.where(F.col("label").isin("Function", "Method") & (F.length("body_text") > 0)).select(F.col(id_col).alias("symbol_id"), "name", "signature", "docstring", "body_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["description"] = [describe(n, d, b) for n, d, b in zip(pdf["name"], pdf["docstring"], pdf["body_text"])]
            yield pdf.loc[pdf["description"] != "", ["symbol_id", "signature", "body_text", "description"]]

    return wanted.mapInPandas(run, f"symbol_id {kind}, signature string, body_text string, description string")


def described_symbols(symbols: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """Distinct (symbol_id) of ``code_description_pairs``, without moving the texts back from Python."""
    kind = symbols.schema[id_col].dataType.simpleString()
    wanted = symbols.where(F.col("label").isin("Function", "Method") & (F.length("body_text") > 0)).select(F.col(id_col).alias("symbol_id"), "name", "docstring", "body_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [describe(n, d, b) != "" for n, d, b in zip(pdf["name"], pdf["docstring"], pdf["body_text"])]
            yield pdf.loc[held, ["symbol_id"]]

    return wanted.mapInPandas(run, f"symbol_id {kind}").distinct()


def file_pairs(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """(keep..., name, line, code, description) of every function in whole source files whose documentation tells something.

    Defined cases: null and empty contents have no functions; line counts from 1; code runs from the declaration to its
    last line; repeated files give repeated rows; empty tables give no rows; further columns are ignored.
    """
    spec = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[list(keep)].itertuples(index=False, name=None), pdf["__text"]):
                if not text:
                    continue
                lines, found = source_lines(text), documented(text)
                ends = end_lines("\n".join(lines), [f.line for f, _ in found])
                for (f, comment), end in zip(found, ends):
                    told = description(comment, f.name) if comment else ""
                    if told:
                        rows.append((*key, f.name, f.line + 1, "\n".join(lines[f.line : end]), told))
            yield pd.DataFrame(rows, columns=[*keep, "name", "line", "code", "description"])

    return files.select(*keep, F.col(content).alias("__text")).mapInPandas(run, f"{spec}, name string, line int, code string, description string")
