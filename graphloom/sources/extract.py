"""Symbols of source files.

Python is read by its own parser. Source of other languages is cut into tokens, so that braces in strings and comments
don't count, and a scope machine walks the tokens: what a language's keywords declare, and functions declared by shape
alone, are named, and the bracket that closes a body ends its symbol. Languages without braces end blocks by indentation.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

PARAMETERS = "array<struct<name: string, type: string>>"
SCHEMA = (
    "rel_path string, language string, name string, label string, start_line int, end_line int, parent_name string, signature string, docstring string, is_test boolean, "
    f"return_type string, parameters {PARAMETERS}, decorators array<string>, base_classes array<string>, is_exported boolean, is_abstract boolean, is_async boolean, is_entry_point boolean, body_text string"
)
COLUMNS = (
    "rel_path language name label start_line end_line parent_name signature docstring is_test return_type parameters decorators base_classes is_exported is_abstract is_async is_entry_point body_text"
).split()


class Symbol(NamedTuple):
    """A declared symbol; lines count from 1."""

    name: str
    label: str
    start: int
    end: int
    parent: str | None = None
    signature: str | None = None
    docstring: str | None = None
    returns: str | None = None
    parameters: tuple[tuple[str, str | None], ...] = ()
    decorators: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()
    modifiers: frozenset[str] = frozenset()


class Grammar(NamedTuple):
    """How a language declares symbols: keywords with their labels, and whether functions may come without a keyword."""

    containers: dict[str, str]
    functions: frozenset[str] = frozenset()
    shaped: bool = False
    hash_comments: bool = False
    type_first: bool = False
    arrows: bool = False


_MODIFIERS = frozenset("export default public private protected internal static final abstract async override virtual sealed partial unsafe inline pub extern open data suspend synchronized const readonly native companion fileprivate lateinit lazy implicit case".split())
# Keywords that declare, by language.
GRAMMARS = {
    "javascript": Grammar({"class": "Class"}, frozenset(["function"]), shaped=True, arrows=True),
    "typescript": Grammar({"class": "Class", "interface": "Interface", "enum": "Enum", "type": "TypeAlias", "namespace": "Module"}, frozenset(["function"]), shaped=True, arrows=True),
    "rust": Grammar({"struct": "Class", "enum": "Enum", "trait": "Interface", "impl": "Impl", "mod": "Module"}, frozenset(["fn"])),
    "go": Grammar({"type": "Class"}, frozenset(["func"])),
    "java": Grammar({"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class"}, shaped=True, type_first=True),
    "kotlin": Grammar({"class": "Class", "interface": "Interface", "object": "Class"}, frozenset(["fun"])),
    "csharp": Grammar({"class": "Class", "struct": "Class", "interface": "Interface", "enum": "Enum", "record": "Class", "namespace": "Module"}, shaped=True, type_first=True),
    "c": Grammar({"struct": "Class", "enum": "Enum"}, shaped=True, type_first=True),
    "cpp": Grammar({"class": "Class", "struct": "Class", "enum": "Enum", "namespace": "Module"}, shaped=True, type_first=True),
    "php": Grammar({"class": "Class", "interface": "Interface", "trait": "Interface", "enum": "Enum", "namespace": "Module"}, frozenset(["function", "fn"]), hash_comments=True, type_first=True),
    "swift": Grammar({"class": "Class", "struct": "Class", "actor": "Class", "protocol": "Interface", "enum": "Enum", "extension": "Impl"}, frozenset(["func"])),
    "scala": Grammar({"class": "Class", "object": "Class", "trait": "Interface", "enum": "Enum", "package": "Module"}, frozenset(["def"])),
    "bash": Grammar({}, frozenset(["function"]), hash_comments=True),
    "dart": Grammar({"class": "Class", "enum": "Enum", "mixin": "Class", "extension": "Impl"}, shaped=True, type_first=True),
    "other": Grammar({"class": "Class", "struct": "Class", "interface": "Interface", "trait": "Interface", "enum": "Enum"}, frozenset(["function", "def", "fn", "func", "fun"])),
}
# Languages that take another's grammar.
SAME_GRAMMAR = {"tsx": "typescript", "vue": "typescript", "svelte": "typescript", "groovy": "java", "cuda": "cpp", "objectivec": "cpp"}
# Languages that end a block with a word or by indentation; keywords and labels.
INDENTED = {
    "ruby": {"def": "Function", "class": "Class", "module": "Module"},
    "elixir": {"defmodule": "Module", "defprotocol": "Interface", "def": "Function", "defp": "Function", "defmacro": "Function"},
    "python": {"def": "Function", "class": "Class"},
}
CONTAINERS = frozenset(("Class", "Interface", "Enum", "Impl", "Module"))
# Words before a parenthesis that declare nothing.
_CONTROL = frozenset("if for while switch catch return else do try with foreach using lock assert throw new await sizeof typeof super this synchronized case when in is as function".split())
_BASES = frozenset("extends implements with".split())
_TEST_PATH = re.compile(r"(^|/)tests?/|\.test\.|\.spec\.|_test\.|(^|/)test_")
_ENTRY = frozenset("main Main".split())

_STRINGS = r'"""[\s\S]*?(?:"""|\Z)|[rR]#+"[\s\S]*?"#+|"(?:[^"\\\n]|\\.)*+"?|`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|\$)*+`?'
_CHAR = r"|'(?:[^'\\\n]|\\.)*+'"
_REST = r"|(?P<word>[A-Za-z_$@][\w$]*|\w+)|(?P<mark>::|->|=>|:=|[^\s\w])"
_LEXERS = {
    hashed: re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)" + (r"|(?<![$\w])\#(?!\[)[^\n]*" if hashed else "") + r")|(?P<string>" + _STRINGS + _CHAR + ")" + _REST)
    for hashed in (False, True)
}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokens(text: str, hash_comments: bool = False) -> list[Token]:
    """Comments, strings, words and marks of a text with their line (from 0); an unclosed comment or string ends with it."""
    out, line, at = [], 0, 0
    for m in _LEXERS[hash_comments].finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        out.append(Token(m.lastgroup, m.group(), line, m.start(), m.end()))
    return out


def indents(lines: list[str]) -> list[int | None]:
    """The indentation of each line, None for blank ones."""
    return [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]


def indented_end(lines: list[str], start: int, indent: list[int | None]) -> int:
    """Last line (from 1) of the block that starts at an index: what is indented deeper, and a closing ``end`` beside it."""
    base = indent[start] or 0
    inside, i = start, start + 1
    while i < len(lines) and (indent[i] is None or indent[i] > base):
        inside = inside if indent[i] is None else i
        i += 1
    return i + 1 if i < len(lines) and indent[i] == base and lines[i].strip() in ("end", "end;") else inside + 1


def end_lines(text: str, starts: list[int], language: str = "") -> list[int]:
    """Last line (from 1) of the declarations that begin at the given lines (from 0).

    In a language with braces that is the line of the brace that closes the first one opened, those in strings and
    comments left out; a declaration that opens none and languages without braces end by indentation. The text is read
    once, and each declaration walks its own body only.
    """
    lines = text.split("\n")
    indent = indents(lines)
    marks = [] if language in INDENTED else [t for t in tokens(text, GRAMMARS.get(language, GRAMMARS["other"]).hash_comments) if t.text in ("{", "}", ";", "(", ")")]
    at = [t.line for t in marks]
    out = []
    for start in starts:
        braces, rounds, end = 0, 0, None
        for t in (marks[k] for k in range(bisect_left(at, start), len(marks))) if language not in INDENTED else ():
            rounds = max(0, rounds + (t.text == "(") - (t.text == ")"))
            if t.text == "}" and not braces:
                break
            braces += (t.text == "{") - (t.text == "}")
            if (t.text == "}" and not braces) or (t.text == ";" and not braces and not rounds):
                end = t.line + 1
                break
        first_of_next = end is not None and language == "" and end > (own := indented_end(lines, start, indent)) and "{" not in "".join(lines[start:own])
        out.append(end if end is not None and not first_of_next else indented_end(lines, start, indent))
    return out


def _closing(ts: list[Token], i: int) -> int:
    """Index of the mark that closes the bracket at ``i``, or the last index."""
    pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, 0
    opening, closing = ts[i].text, pairs[ts[i].text]
    for j in range(i, len(ts)):
        depth += (ts[j].text == opening) - (ts[j].text == closing)
        if not depth:
            return j
        if opening == "<" and ts[j].text in ("{", ";", ")"):
            return i  # a comparison, no type list
    return len(ts) - 1


def _parameters(text: str, ts: list[Token], first: int, last: int, grammar: Grammar, language: str) -> tuple[tuple[str, str | None], ...]:
    """Names and types between two brackets."""
    parts, depth, own = [], 0, []
    for t in ts[first + 1 : last]:
        depth += (t.text in "([{<") - (t.text in ")]}>") if t.kind == "mark" and len(t.text) == 1 else 0
        if t.text == "," and not depth:
            parts.append(own)
            own = []
        else:
            own.append(t)
    out = []
    for own in [*parts, own]:
        default = next((k for k, t in enumerate(own) if t.text == "="), len(own))
        own = [t for t in own[:default] if t.kind != "comment" and not t.text.startswith("@")]
        words = [t for t in own if t.kind == "word" and t.text not in _MODIFIERS and t.text not in ("mut", "ref", "val", "var", "inout", "final", "this", "out", "in", "params")]
        colon = next((k for k, t in enumerate(own) if t.text == ":"), None)
        if not words or (words[0].text == "self" and colon is None):
            continue
        if colon is not None:
            names = [t.text for t in own[:colon] if t.kind == "word" and t.text not in _MODIFIERS and t.text not in ("mut", "val", "var")]
            kind = text[own[colon].end : own[-1].end].strip()
            if names:
                out.append((names[-1], kind or None))
        elif language == "go":
            out.append((words[0].text, text[words[1].start : own[-1].end] if len(words) > 1 else None))
        elif grammar.type_first and len(words) > 1:
            out.append((words[-1].text.lstrip("$"), text[words[0].start : words[-1].start].strip() or None))
        else:
            out.append((words[-1].text.lstrip("$"), None))
    return tuple(out)


def _comment_above(comments: dict[int, Token], line: int) -> str | None:
    """The comment block that ends on the line before, without its marks."""
    held, at = [], line - 1
    while at in comments:
        held.append(comments[at].text)
        at = comments[at].line - 1
    if not held:
        return None
    lines = [re.sub(r"^\s*(?:/\*+|\*+/|\*|/{2,}!?|#+)\s?|\s*\*+/\s*$", "", x).strip() for block in reversed(held) for x in block.split("\n")]
    return "\n".join(x for x in lines if x) or None


def by_tokens(text: str, language: str) -> list[Symbol]:
    """Symbols of a language with braces."""
    name = SAME_GRAMMAR.get(language, language)
    language = name if name in GRAMMARS else "other"
    grammar = GRAMMARS[language]
    every = tokens(text, grammar.hash_comments)
    comments = {t.line + t.text.count("\n"): t for t in every if t.kind == "comment" and not t.text.startswith("#!")}
    ts = [t for t in every if t.kind != "comment"]
    out: list[Symbol | None] = []
    scopes: list[tuple[int, str, int]] = []  # (index in out, label, depth of its brace)
    depth, i, waiting = 0, 0, None
    lead: list[Token] = []  # modifiers and annotations before a declaration

    def at(k: int) -> str:
        return ts[k].text if 0 <= k < len(ts) else ""

    def finish(k: int, line: int) -> None:
        out[k] = out[k]._replace(end=max(out[k].start, line + 1))

    while i < len(ts):
        t = ts[i]
        if t.text == "{":
            depth += 1
            if waiting is not None:
                scopes.append((waiting, out[waiting].label, depth))
                waiting = None
            lead = []
        elif t.text == "}":
            while scopes and scopes[-1][2] >= depth:
                finish(scopes.pop()[0], t.line)
            depth = max(0, depth - 1)
            lead = []
        elif t.text == ";":
            if waiting is not None:
                finish(waiting, t.line)
                waiting = None
            lead = []
        elif t.text.startswith("@") and t.kind == "word" or t.text == "@":
            lead.append(t)
            if at(i + 1) == ".":
                i += 2
            if at(i + 1) == "(":
                i = _closing(ts, i + 1)
                lead.append(ts[i])
        elif t.text == "#" and at(i + 1) == "[" or (t.text == "[" and language == "csharp" and (not lead or lead[-1].text == "]")):
            lead.append(t)
            i = _closing(ts, i + (t.text == "#"))
            lead.append(ts[i])
        elif t.kind == "word" and t.text in _MODIFIERS and at(i + 1) not in ("(", "=", ":"):
            lead.append(t)
            if at(i + 1) == "(":
                i = _closing(ts, i + 1)
        else:
            found = _declared(text, ts, i, grammar, language, scopes, out)
            if found is None:
                if t.kind == "mark" or t.text in _CONTROL:
                    lead = []
            else:
                symbol, stop, begin = found
                first = lead[0] if lead else ts[begin]
                start = first.line
                notes = tuple(text[a.start : b.end] for a, b in _annotations(lead))
                plain = next((x for x in lead if x.text in _MODIFIERS), ts[begin])
                signature = " ".join(text[plain.start : ts[stop - 1].end if stop <= len(ts) else len(text)].split())
                out.append(symbol._replace(start=(plain.line if notes else start) + 1, end=ts[min(stop, len(ts)) - 1].line + 1, signature=signature, docstring=_comment_above(comments, start), decorators=notes, modifiers=frozenset(x.text for x in lead if x.text in _MODIFIERS)))
                waiting = len(out) - 1 if at(stop) in ("{", ";") else None
                if at(stop) in ("=", "=>"):  # an expression as body: to the end of its statement
                    stop = _statement_end(ts, stop)
                    if at(stop) == "{":
                        waiting = len(out) - 1
                    else:
                        finish(len(out) - 1, ts[min(stop, len(ts) - 1)].line)
                lead = []
                i = stop
                continue
        i += 1
    last = text.count("\n")
    for k, _, _ in scopes:
        finish(k, last)
    return [s for s in out if s]


def _annotations(lead: list[Token]) -> list[tuple[Token, Token]]:
    out: list[tuple[Token, Token]] = []
    for t in lead:
        if t.text.startswith("@") or t.text in ("#", "["):
            out.append((t, t))
        elif t.text in (")", "]") and out:
            out[-1] = (out[-1][0], t)
    return out


def _statement_end(ts: list[Token], i: int) -> int:
    """Index at which the statement that goes on at ``i`` ends: its body's brace, its semicolon or its line's last token."""
    j, depth = i + 1, 0
    while j < len(ts):
        if ts[j].text == "{" and not depth:
            return j
        depth += (ts[j].text in "([{") - (ts[j].text in ")]}") if len(ts[j].text) == 1 else 0
        if depth < 0 or (not depth and (ts[j].text == ";" or (j + 1 < len(ts) and ts[j + 1].line > ts[j].line and ts[j + 1].text not in (".", "?", "{")))):
            return j
        j += 1
    return len(ts)


def _declared(text: str, ts: list[Token], i: int, grammar: Grammar, language: str, scopes: list, out: list) -> tuple[Symbol, int, int] | None:
    """The symbol that the token at ``i`` declares, the index of what follows its head and that of its first token, or None."""
    t, at = ts[i], lambda k: ts[k].text if 0 <= k < len(ts) else ""
    if t.kind != "word":
        return None
    owner = next((out[k] for k, label, _ in reversed(scopes) if label in CONTAINERS), None)
    within = scopes[-1][1] if scopes else None
    parent = owner.name if owner and owner.label != "Module" else None
    before = at(i - 1)
    if t.text in grammar.containers and before not in (".", "::", "(", ",", "<", "=", "->", ":"):
        found = _container(text, ts, i, grammar, language)
        return found and (*found, i)
    if t.text in grammar.functions and before not in (".", "::"):
        j = i + 1
        if at(j) == "*":
            j += 1
        if language == "go" and at(j) == "(":  # the receiver's type owns the method
            close = _closing(ts, j)
            inside = [x.text for x in ts[j + 1 : close] if x.kind == "word"]
            parent, j = inside[-1] if inside else None, close + 1
        if at(j) == "<":
            j = _closing(ts, j) + 1
        while j + 2 < len(ts) and at(j + 1) in (".", "::") and ts[j + 2].kind == "word":  # a receiver before the name
            j += 2
        if j >= len(ts) or ts[j].kind != "word" or (at(j + 1) not in ("(", "<", "[") and language not in ("scala", "bash")):
            return None
        found = _function(text, ts, j, grammar, language, parent)
        return found and (*found, i)
    if language == "bash" and at(i + 1) == "(" and at(i + 2) == ")":
        return Symbol(t.text, "Function", 0, 0), i + 3, i
    if grammar.arrows and t.text in ("const", "let", "var") and i + 2 < len(ts) and ts[i + 1].kind == "word":
        found = _arrow(text, ts, i + 1, grammar, language, parent)
        return found and (*found, i)
    if grammar.arrows and at(i + 1) == "=" and before in ("const", "let", "var"):
        found = _arrow(text, ts, i, grammar, language, parent)
        return found and (*found, i)
    if not grammar.shaped or t.text in _CONTROL or at(i + 1) not in ("(", "<") or before in (".", "new", "return", "->", "::", "=", "(", ",") and not (before == "::" and language == "cpp"):
        return None
    if at(i + 1) == "<" and at(_closing(ts, i + 1) + 1) != "(":
        return None  # a type with arguments
    inside_container = within in CONTAINERS and within != "Module"
    if language in ("c", "cpp") and not inside_container:
        if within not in (None, "Module") or not (before in ("*", "&", ">", "::") or (i and ts[i - 1].kind == "word" and before not in _CONTROL)):
            return None
        if before == "::":
            parent = at(i - 2)
    elif not inside_container or (grammar.type_first and t.text != owner.name and not (i and (ts[i - 1].kind == "word" or before in (">", "]", "?", "*", "&", "~")))):
        return None
    found = _function(text, ts, i, grammar, language, parent)
    if found is None or at(found[1]) not in ("{", "=>", ";") or (at(found[1]) == ";" and (not inside_container or language in ("javascript",) or before == "=")):
        return None
    symbol, stop = found
    begin = i
    if grammar.type_first and t.text != (owner.name if owner else None):
        last = i - 1
        while last > 0 and at(last) == "::":
            last -= 2
        j = last
        while j >= 0 and (ts[j].kind == "word" and ts[j].text not in _MODIFIERS or ts[j].text in ("<", ">", "[", "]", ",", "?", "*", "&", ".", "::")) and not ts[j].text.startswith("@"):
            j -= 1
        if j < last:
            begin = j + 1
            symbol = symbol._replace(returns=text[ts[begin].start : ts[last].end])
    return symbol, stop, begin


def _container(text: str, ts: list[Token], i: int, grammar: Grammar, language: str) -> tuple[Symbol, int] | None:
    at = lambda k: ts[k].text if 0 <= k < len(ts) else ""
    label, j, bases = grammar.containers[ts[i].text], i + 1, []
    if label == "Enum" and at(j) in ("class", "struct"):
        j += 1
    if at(j) == "<":
        j = _closing(ts, j) + 1
    if j >= len(ts) or ts[j].kind != "word" or ts[j].text in ("extends", "implements"):
        return None
    name = ts[j].text
    while label == "Module" and at(j + 1) in (".", "::", "\\") and j + 2 < len(ts) and ts[j + 2].kind == "word":
        name, j = name + at(j + 1) + at(j + 2), j + 2
    j += 1
    if language == "go":
        if at(j) not in ("struct", "interface"):
            return None
        return Symbol(name, "Class" if at(j) == "struct" else "Interface", 0, 0), j + 1
    heads: list[str] = []
    taking = False
    while j < len(ts) and at(j) not in ("{", ";", "}") and not (label == "TypeAlias" and at(j) == "="):
        if at(j) in _BASES or (at(j) == ":" and language not in ("rust", "javascript")) or (language == "rust" and at(j) in (":", "for")):
            if language == "rust" and at(j) == "for":
                bases, name = [name], at(j + 1)
            taking = language != "rust" or at(j) == ":"
        elif at(j) in ("(", "<", "["):
            j = _closing(ts, j) if at(j) != "<" or _closing(ts, j) != j else j
        elif at(j) in ("where", "permits"):
            taking = False
        elif taking and ts[j].kind == "word" and at(j) not in _MODIFIERS and at(j - 1) not in (".", "::"):
            heads.append(at(j))
        elif ts[j].line > ts[j - 1].line and language in ("kotlin", "scala", "swift") and not taking:
            break
        j += 1
    if at(j) == "}" or (language in ("c", "cpp") and at(j) == ";" and label != "Module"):
        return None
    return Symbol(name, label, 0, 0, bases=tuple(dict.fromkeys([*bases, *heads]))), j


def _function(text: str, ts: list[Token], j: int, grammar: Grammar, language: str, parent: str | None) -> tuple[Symbol, int] | None:
    """A function whose name is the token at ``j``."""
    at = lambda k: ts[k].text if 0 <= k < len(ts) else ""
    name, label, parameters, returns = ts[j].text, "Method" if parent else "Function", (), None
    j += 1
    if at(j) in ("<", "["):
        j = _closing(ts, j) + 1
    while at(j) == "(":
        close = _closing(ts, j)
        parameters += _parameters(text, ts, j, close, grammar, language)
        j = close + 1
        if language != "scala":  # there curried parameters give several lists
            break
    begin = j
    if (at(j) == ":" and language not in ("java", "csharp", "c", "cpp", "dart")) or at(j) == "->" or language == "go":
        first = j + (at(j) in (":", "->"))
        while j < len(ts) and at(j) not in ("{", "}", ";", "=", "=>") or (at(j) == "{" and j == first and language in ("typescript",)):
            if j > first and ts[j].line > ts[j - 1].line and language in ("kotlin", "scala", "swift", "go"):
                break
            j = _closing(ts, j) + 1 if at(j) in ("(", "[", "{") else j + 1
        returns = text[ts[first].start : ts[j - 1].end].split(" where ")[0].strip() or None if first < j else None
    else:
        while j < len(ts) and at(j) not in ("{", ";", "=", "=>", "}") and (ts[j].kind == "word" or at(j) in (",", "::", ":", "(", ")", "&", ".", "->", "<", ">")):
            if language in ("kotlin", "scala", "swift", "other", "bash") and ts[j].line > ts[j - 1].line:
                break
            j += 1
    if begin > len(ts):
        return None
    return Symbol(name, label, 0, 0, parent, returns=returns, parameters=parameters), j


def _arrow(text: str, ts: list[Token], i: int, grammar: Grammar, language: str, parent: str | None) -> tuple[Symbol, int] | None:
    """``name = (a) => ...`` and ``name = function (a) {...}``, the name being the token at ``i``."""
    at = lambda k: ts[k].text if 0 <= k < len(ts) else ""
    j = i + 1
    if at(j) == ":":
        while j < len(ts) and at(j) not in ("=", ";", "{"):
            j += 1
    if at(j) != "=":
        return None
    j += 1
    if at(j) == "async":
        j += 1
    if at(j) == "function":
        while j < len(ts) and at(j) != "(":
            j += 1
        close = _closing(ts, j) if j < len(ts) else j
        return Symbol(ts[i].text, "Function", 0, 0, parameters=_parameters(text, ts, j, close, grammar, language)), close + 1
    if at(j) == "(":
        close = _closing(ts, j)
        returns, k = None, close + 1
        if at(k) == ":":
            while k < len(ts) and at(k) not in ("=>", ";"):
                k += 1
            returns = text[ts[close + 2].start : ts[k - 1].end] if close + 2 < k else None
        if at(k) == "=>":
            return Symbol(ts[i].text, "Function", 0, 0, returns=returns, parameters=_parameters(text, ts, j, close, grammar, language)), k
    elif j < len(ts) and ts[j].kind == "word" and at(j + 1) == "=>":
        return Symbol(ts[i].text, "Function", 0, 0, parameters=((ts[j].text, None),)), j + 1
    return None


def by_indentation(text: str, language: str) -> list[Symbol]:
    """Symbols of a language whose blocks go by indentation or closing words."""
    lines, out, keywords = text.split("\n"), [], INDENTED[language]
    indent = indents(lines)
    head = re.compile(r"(\s*)(" + "|".join(sorted(keywords, key=len, reverse=True)) + r")\s+(?:self\.)?([A-Za-z_][\w.:]*[?!]?)\s*(?:\(([^)]*)\)|(?:<\s*([\w:.]+)))?")
    note = re.compile(r"\s*(#|@doc|@moduledoc|@spec)")
    for i, line in enumerate(lines):
        m = head.match(line)
        if not m:
            continue
        name, label = m.group(3).rstrip(":."), keywords[m.group(2)]
        holder = next((s for s in reversed(out) if s.label in CONTAINERS and s.start <= i + 1 <= s.end), None)
        if label == "Function" and holder and not (language == "ruby" and holder.label == "Module"):
            label = "Method"
        above = i
        while above and note.match(lines[above - 1]):
            above -= 1
        told = [re.sub(r"^\s*#+\s?|^\s*@(?:doc|moduledoc)\s+\"*|\"+\s*$", "", x).strip() for x in lines[above:i] if not re.match(r"\s*@spec", x)]
        named = tuple((re.split(r"[\s:=\\]", p.strip().lstrip("*&"))[0], None) for p in (m.group(4) or "").split(",") if p.strip() and p.strip() != "self")
        hidden = m.group(2) == "defp"
        out.append(Symbol(name, label, i + 1, indented_end(lines, i, indent), holder.name if holder else None, line.strip().removesuffix(" do"), "\n".join(x for x in told if x) or None, parameters=named, bases=(m.group(5),) if m.group(5) else (), modifiers=frozenset(["private"] if hidden else [])))
    return out


def by_ast(text: str) -> list[Symbol]:
    """Symbols of Python source; files that don't parse go by indentation."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return by_indentation(text, "python")
    lines, out = text.split("\n"), []
    # one stack entry for each statement list; nothing recurses, so deep files pass
    stack: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while stack:
        node, parent, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            kind = isinstance(child, ast.ClassDef)
            if kind or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returns, parameters, bases = None, (), ()
                if kind:
                    bases = tuple(ast.unparse(b) for b in child.bases)
                else:
                    a = child.args
                    every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                    parameters = tuple((x.arg, ast.unparse(x.annotation) if x.annotation else None) for x in every if x.arg not in ("self", "cls"))
                    returns = ast.unparse(child.returns) if child.returns else None
                notes = tuple("@" + ast.unparse(d) for d in child.decorator_list)
                marks = frozenset((["async"] if isinstance(child, ast.AsyncFunctionDef) else []) + (["abstract"] if any("abstractmethod" in n for n in notes) else []))
                out.append(Symbol(child.name, "Class" if kind else "Method" if in_class else "Function", child.lineno, child.end_lineno or child.lineno, parent, lines[child.lineno - 1].strip().rstrip(":"), ast.get_docstring(child), returns, parameters, notes, bases, marks))
                stack.append((child, child.name, kind))
            elif isinstance(child, ast.Assign) and isinstance(child.value, ast.Lambda) and isinstance(child.targets[0], ast.Name):
                names = tuple((x.arg, None) for x in child.value.args.args)
                out.append(Symbol(child.targets[0].id, "Function", child.lineno, child.end_lineno or child.lineno, parent, lines[child.lineno - 1].strip(), parameters=names))
            else:
                stack.append((child, parent, in_class))
    return sorted(out, key=lambda s: (s.start, -s.end))


_REGISTERED: dict[str, Callable[[str], list]] = {}


def register_extractor(language: str, extractor: Callable[[str], list]) -> None:
    """Use a function of the source text for a language; it gives Symbols or their first seven fields as tuples."""
    _REGISTERED[language] = extractor


def source_symbols(text: str, language: str) -> list[Symbol]:
    """The symbols of one source text."""
    if language in _REGISTERED:
        return [s if isinstance(s, Symbol) else Symbol(*s) for s in _REGISTERED[language](text)]
    if language == "python":
        return by_ast(text)
    return by_indentation(text, language) if language in INDENTED else by_tokens(text, language)


def _row(path: str, language: str, s: Symbol, lines: list[str]) -> tuple:
    test = bool(_TEST_PATH.search(path.lower())) or s.name.lower().startswith("test") or any("test" in d.lower() for d in s.decorators)
    exported = bool(s.modifiers & {"export", "public", "pub", "open"}) or (language == "go" and s.name[:1].isupper()) or (language in ("python", "ruby", "elixir") and not s.name.startswith("_") and "private" not in s.modifiers)
    body = "\n".join(lines[s.start - 1 : s.end]) if s.label in ("Function", "Method") else None
    parameters = [{"name": n, "type": k} for n, k in s.parameters]
    return (path, language, s.name, s.label, s.start, s.end, s.parent, s.signature, s.docstring, test, s.returns, parameters, list(s.decorators), list(s.bases), exported, "abstract" in s.modifiers, bool(s.modifiers & {"async", "suspend"}), s.name in _ENTRY, body)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of ``files(rel_path, language, content)``, one map over the files; null contents have none."""
    registered = dict(_REGISTERED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _REGISTERED.update(registered)
        for pdf in batches:
            rows = []
            for path, lang, text in zip(pdf["rel_path"], pdf["language"], pdf["content"]):
                if text:
                    lines = text.split("\n")
                    rows += [_row(path, lang, s, lines) for s in source_symbols(text, lang)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("rel_path", "language", "content").mapInPandas(run, SCHEMA)
