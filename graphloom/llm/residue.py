"""Template residue, filler and error-page text.

Each delimiter style of unfilled placeholders has its own grammar. Code is set aside first (fenced blocks, inline code,
lines that read as statements), so that templates shown as examples or used as code don't count; filler is judged by the
density of its vocabulary in a paragraph; error and script notices are matched as a page would word them to its reader,
not as prose that mentions them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z][A-Za-z0-9_. -]{0,40}"
# One grammar for each delimiter style of placeholders.
PLACEHOLDERS = tuple(
    re.compile(p)
    for p in (
        r"\{\{\{?\s*" + _NAME + r"(\|[^{}\n]{0,40})?\s*\}?\}\}",
        r"\{%-?\s*" + _NAME + r"\s*-?%\}",
        r"<%[=-]?\s*" + _NAME + r"\s*-?%>",
        r"[$#]\{\s*" + _NAME + r"\s*\}",
        r"\[\[\s*" + _NAME + r"\s*\]\]",
        r"(?<!@)@@" + r"[A-Za-z]\w{0,40}" + r"@@",
        r"%%[A-Za-z]\w{0,40}%%",
        r"<<\s*[A-Za-z][\w ]{0,40}>>",
        r"(?<![\w`])__(?!init__|main__|name__|file__|all__|doc__|dict__|class__|call__|str__|repr__|len__|iter__|next__|enter__|exit__|new__|del__|eq__|hash__|version__|future__|slots__)[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)*__(?![\w(])",
        r"(?i:[\[<(]\s*(?:todo|tbd|fixme)\s*:\s*(?:fill|add|insert|enter|write|describe)[^\]>)\n]{0,60}[\]>)])",
        r"(?i:[\[<]\s*(?:insert|enter|add|put|fill in)\s+[\w ]{1,40}[\]>])",
        r"(?i:\(\s*(?:enter|insert)\s+[\w ]{1,40}\))",
        r"(?i:[\[<]\s*your\s+[\w ]{1,40}(?:\s+here)?\s*[\]>])",
        r"(?i:[\[<(]\s*[\w ]{1,40}\s+(?:goes|comes)\s+here\s*[\])>])",
        r"(?i:[\[<]\s*(?:first|last|full|company|user|customer|client|contact|recipient)[ _]name\s*[\]>](?!\())",
        r"(?i:^\W*(?:hello|hi|dear|welcome|hallo|hola|estimad[oa]|lieber?)\s+[\[<(]\s*\w+(?:[ _]\w+)?\s*[\])>](?!\())",
        r"(?<!\w)TBD\s+-\s+[A-Za-z]\w*",
        r"(?:^|:\s*)(?:TBD|TBC)\s*[.]?\s*$",
    )
)
#: Styles that program text uses too; in statements they are code.
CODE_STYLES = (0, 1, 2, 3, 4, 7, 8)

_FENCE = re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_INLINE = re.compile(r"(`+)[^`\n]+\1")
# Lines that read as statements of a program.
_STATEMENT = re.compile(
    r"[;{}]\s*$|^\s*(?:def|class|func|fn|function|return|if|for|while|const|let|var|import|from|export|public|private|protected|static|package|use|include|throw|raise|assert|async|await|match|switch|case|self|this)\b.*[\[({=:;.\"'`]"
    r"|\w\s*(?:=|:=|\+=|=>|->)\s*[\w\"'`\[({]|^\s*[\w.]+\([^)]*\)\s*$|\w\(\s*[\"'f`]"
)
# Values that stand where one failed to fill in.
_HOLLOW = r"(?:undefined|null|NaN|None|nil|\[object Object\]|Invalid Date)"
_FAILED = tuple(
    re.compile(p)
    for p in (
        r"\[object Object\]",
        r"\bInvalid Date\b",
        r"\b(null null|undefined undefined|None None)\b",
        r"^(?:[*_>#\s-]*)(?:Hello|Hi|Dear|Welcome|Hallo|Hola|Estimad[oa]|Lieber?|Guten Tag)\W+" + _HOLLOW + r"\b",
        r"^[*_>#\s-]*(?:Name|Owner|Author|Version|Date|Title|Contact|E-?mail|Total|Price|Team|Phone|Address|Maintainer)\b[^:\n]{0,20}:\s*" + _HOLLOW + r"\s*[.,]?\s*$",
    )
)
_HOLLOW_WORD = re.compile(r"(?<![\w`.\"'])" + _HOLLOW + r"(?![\w(`\"'])")
_ABOUT_VALUES = re.compile(r"\b(returns?|returned|if|when|unless|yields?|gives?|checks?|tests?|equals?|throws?|type|value|values|variable|literal|compare[sd]?|is|was|are)\b", re.I)

# Stems of the pseudo-Latin and of the keyboard words that filler is made of.
_LATIN = re.compile(r"^(lorem|ipsum|dol[ou]|sit(?:ar?)?$|ame[nt]|consec|adipi|elit|sed(?:ona)?$|eius|tempo|incidi|labor|magn|aliqu|veni|quis|nostr|exerc|ullam|nisi|commod|conseq|duis|aute|irure|reprehen|volup|velit|esse|cill|fugi|pariat|excep|occaec|cupid|proid|culpa|officia|deser|molli|anim|est$|ut$|et$|in$|ad$|ex$|non$|sunt$)")
_MASH = frozenset("asdf qwer qwerty jkl asdfjkl foo bar baz qux bla blah blub xxx xx zzz test testing abc hjkl sdf lkj".split())
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_HEADS = ("lorem", "ipsum", "dolor")
#: A paragraph of at least so many words of which one makes up this share is that word over and over.
REPEATED_WORDS, REPEATED_SHARE = 8, 0.8

# Phrases of filler copy, in the languages of the texts.
FILLER = re.compile(
    r"\bbody copy body copy\b|^\W*section heading here\W*$|\byour (sub)?title goes (in this box|here)|\b(text|content|copy|description) goes here\b"
    r"|\bthis is (?:a )?(?:sample|dummy|placeholder|filler|example) (?:copy|text|content|paragraph)\b|\breplace (?:it|this|this text|me) with your own\b"
    r"|\bdummy (?:content|text|copy) (?:used|for|to|goes)\b|^\W*placeholder (?:paragraph|text|copy)\b\s*[.:]|\bnothing here is meant to be read\b|\bthe real (?:section|text|content) will be written\b"
    r"|\btexto de relleno\b|\bsustituya este (?:párrafo|texto)\b|\bhier steht später\b|\bblindtext (?:zum|zur|für|für)\b|^\W*blindtext\b|\bhier kommt (?:noch )?(?:der|ein) text\b|\btexte de remplissage\b",
    re.I,
)
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(?:item|list item|bullet|point)\s+(?:one|two|three|four|text|label|name|\d)\W*$", re.I)
# Status lines of HTTP servers.
_STATUS = r"(?:400 Bad Request|401 Unauthorized|402 Payment Required|403 Forbidden|404 Not Found|405 Method Not Allowed|408 Request Time-?out|410 Gone|429 Too Many Requests|500 Internal Server Error|502 Bad Gateway|503 Service (?:Temporarily )?Unavailable|504 Gateway Time-?out)"
# Their reasons without the number, where they make up a line.
_REASON = r"(?:Bad Request|Unauthorized|Forbidden|Method Not Allowed|Too Many Requests|Internal Server Error|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out)"
# Error, access and maintenance messages as a page words them to its reader.
ERRORS = re.compile(
    r"^\W*(?:HTTP(?:/[\d.]+)? |Error:? |HTTP Status )?" + _STATUS + r"\W*$|<title>\s*" + _STATUS + r"|<h1>\s*" + _STATUS + r"|^\W*(?:Error\W+)?" + _REASON + r"\W*$"
    + r"|^\s*\{(?=.*\"status(?:_?code)?\"\s*:\s*\"?[45]\d\d\b).*\"(?:error|message|title)\"\s*:.*\}\s*$|\bpage (?:cannot|can't|could not) be (?:displayed|shown|loaded|opened)\b"
    + r"|^\W*(?:oops|whoops|uh-oh|sorry)\W+(?:we|this|that|the|something|you)\b.*\b(?:page|wrong|find|found|exist|error)\b|\bwe could(?: not|n't) find the page\b|\bthe page (?:you (?:were|are) looking for|you requested) (?:could not|cannot|can't|was not|does not|doesn't)\b"
    r"|^\W*(?:page|file) not found\W*$|^\W*access (?:is )?denied\W*$|^\W*access (?:is )?denied\.\s+(?:you|your)\b|\byour account (?:may|can|does|is) not\b.{0,30}\b(?:view|access|allowed|permission)|\byou (?:do not|don't) have (?:permission|access) to (?:view|access|see|this)\b"
    r"|\byou are sending (?:too many )?requests(?: too quickly)?\b|\byou have (?:sent|made) too many requests\b|\bsomething went wrong on our (?:side|end)\b|^\W*something went wrong\W|^\W*an (?:unexpected |internal |unknown )?error (?:has )?occurred\b"
    r"|\bupstream connect error or disconnect\b|\bdisconnect/reset before headers\b|\bno healthy upstream\b|\bthe (?:document|page|content) you (?:asked for|requested) needs? an account\b|^\W*(?:sign|log) in to (?:continue|view)\b|\byou (?:must|need to) (?:sign|log) in to\b"
    r"|\bthe link you (?:followed|clicked) (?:has expired|is no longer valid|is broken)\b|\bthis (?:content|page|document|link) (?:is|has) (?:no longer available|been removed|expired|not available)\b"
    r"|\b(?:is|are) (?:currently |temporarily )?(?:down|offline|unavailable) for (?:planned |scheduled )?maintenance\b|\bwe expect to be back\b|\bwe(?:'ll| will) be back (?:soon|shortly)\b"
    r"|\bchecking (?:that you are not a robot|if you are human|your browser)\b|\b(?:verify|confirm|prove) (?:that )?you are (?:not a robot|human)\b|\bplease complete the captcha\b"
    r"|^\W*fatal(?: error)?: (?:could not|cannot|failed|uncaught|call to|undefined|maximum)\b|^\W*Traceback \(most recent call last\)|\bundefined method `[^'`]+' for nil\b|^\W*(?:Warning|Notice|Parse error): .+ in \S+ on line \d+"
    r"|\bangeforderte seite (?:wurde nicht gefunden|konnte nicht|existiert nicht)|\bseite nicht gefunden\b|\bzugriff verweigert\b\W*$|\bno se ha podido (?:mostrar|encontrar|cargar) la página\b|^\W*error \d{3} del servidor\b|\bpágina no encontrada\b\W*$|\bacceso denegado\b\W*$",
    re.I,
)
# Notices that scripts are needed.
SCRIPTS = re.compile(
    r"\b(?:please |you (?:have|need) to |you must )(?:turn on|enable|activate|allow|switch on) (?:javascript|scripts?)\b|^\W*javascript (?:is|seems to be|appears to be) (?:disabled|turned off|off|not enabled|required)\b|\benable javascript (?:in your browser|to (?:continue|view|use|run|see))\b"
    r"|\b(?:scripts|javascript) (?:are|is) (?:off|disabled|blocked|turned off) in (?:this|your) browser\b|\byour browser has (?:javascript|script execution|scripts?) (?:switched off|disabled|turned off)|\b(?:page|view|site|app|application|viewer|wiki|documentation) (?:needs|requires) (?:javascript|scripts?)\b"
    r"|\bneeds scripts to run\b|\b(?:does not|doesn't|cannot|can't|won't) (?:work|run|load|start|be shown|be displayed) without (?:js|javascript|scripts?)\b|<noscript>\s*\S.*(?:script|javascript|enable|allow)|\bcheck that (?:scripts|javascript)\b.{0,20}\b(?:allowed|enabled)\b"
    r"|\b(?:bitte )?aktivieren sie (?:bitte )?javascript\b|\bjavascript (?:muss aktiviert|ist deaktiviert)|\b(?:active|habilite|debe activar|necesita) javascript\b|\bjavascript (?:está desactivado|deshabilitado)|\bveuillez activer javascript\b",
    re.I,
)
# Wording by which a sentence is about a message instead of being one.
_ABOUT = re.compile(
    r"\b(?:if|when|whenever|because|although) (?:users?|the user|a user|you see|someone|clients?|the client|a client|the)\b|\b(?:is|are|was|were) (?:answered|counted|logged|shown|returned|raised|documented|retried|rendered on)\b"
    r"|\bworks? with javascript (?:disabled|off)|\bthe (?:linter|client|server|renderer|test|tests|checker|handler) (?:warns?|returns?|answers?|retries|waits?|replaces?|checks?|treats?)\b|\bwith the (?:message|status|code)\b",
    re.I,
)


def _prose(text: str) -> str:
    """A text without its fenced code, with plain line ends."""
    text = text.replace("\ufeff", "").replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    return text


def _lower(text: str) -> str:
    """Lower case, with the letters that a grammar without regard to case takes for i and s as these."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")


def needed(pattern: str) -> frozenset[str] | None:
    """Strings in lower case of which every match of the pattern holds one; None if there are none of use."""
    return max(clauses(pattern), key=_worth, default=None)


def clauses(pattern: str) -> list[frozenset[str]]:
    """Sets of strings in lower case; every match of the pattern holds one string of each set.

    Read off the parsed pattern: a sequence needs all that its parts need, a choice what one or other of its branches
    needs, a repetition that occurs at least once what it repeats. So a prefilter can't be narrower than its grammar.
    """
    return _clauses(_parser.parse(pattern))


def _worth(clause: frozenset[str]) -> int:
    """The length of the clause's shortest string: long ones sort out most texts."""
    return min(map(len, clause))


def _clauses(parsed) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    run = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and not chr(arg).isspace():
            run += chr(arg).lower()
            continue
        if run:
            out.append(frozenset((run,)))
            run = ""
        if name == "SUBPATTERN":
            out += _clauses(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += _clauses(arg[2])
        elif name == "BRANCH":
            each = [_clauses(branch) for branch in arg[1]]
            if all(each):
                out.append(frozenset().union(*(max(c, key=_worth) for c in each)))
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and not any(chr(c).isalnum() or chr(c).isspace() for _, c in arg):
            out.append(frozenset(chr(c) for _, c in arg))
    if run:
        out.append(frozenset((run,)))
    return out


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern's outermost choice."""
    out, start, depth, i, bracket = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif bracket:
            bracket = c != "]" or i == opened + 1
        elif c == "[":
            bracket, opened = True, i + (pattern[i + 1] == "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


class Rule(NamedTuple):
    """One grammar or alternative of a kind, with the literals (as bit masks) that a text must hold for it."""

    kind: str
    number: int
    pattern: re.Pattern
    masks: tuple[int, ...]


def _rules() -> tuple[list[Rule], ahocorasick.Automaton]:
    literals: dict[str, int] = {}
    rules = []
    for kind, patterns in (
        ("placeholder", [(p.pattern, p.flags) for p in PLACEHOLDERS]), ("value", [(_HOLLOW_WORD.pattern, 0)]), ("item", [(_ITEM.pattern, re.I)]),
        *((k, [(x, re.I) for x in alternatives(p.pattern)]) for k, p in (("filler", FILLER), ("error", ERRORS), ("script", SCRIPTS))),
    ):
        for number, (source, flags) in enumerate(patterns):
            wanted = [c for c in clauses(source) if _worth(c) > 1 or not any(t.isalnum() for t in c)]
            masks = tuple(sum(1 << literals.setdefault(t, len(literals)) for t in c) for c in sorted(wanted, key=lambda c: (-_worth(c), sorted(c))))
            rules.append(Rule(kind, number, re.compile(source, flags), masks))
    found = ahocorasick.Automaton()
    for t, bit in literals.items():
        found.add_word(t, 1 << bit)
    found.make_automaton()
    return rules, found


RULES, _LITERALS = _rules()
_VALUES = tuple(sorted(needed(_HOLLOW_WORD.pattern)))


def active_rules(text: str) -> list[Rule]:
    """The rules whose literals the text holds, found in one pass over it."""
    held = 0
    for _, bit in _LITERALS.iter(_lower(text)):
        held |= bit
    return [r for r in RULES if all(held & m for m in r.masks)]


def residue(text: str | None) -> list[str]:
    """The kinds of residue in a text: placeholder, value, filler, error, script. Null and blank texts have none."""
    if not text or not text.strip():
        return []
    text = _prose(text)
    rules: dict[str, list[Rule]] = {}
    for r in active_rules(text):
        rules.setdefault(r.kind, []).append(r)
    kinds: set[str] = set()
    items, paragraph = 0, []
    for raw in [*text.split("\n"), ""]:
        if not raw.strip():
            if paragraph and "filler" not in kinds and _is_filler(paragraph):
                kinds.add("filler")
            paragraph = []
            continue
        line = _INLINE.sub(" ", raw) if "`" in raw else raw
        if line.strip():
            paragraph.append(line)
        for kind, own in rules.items():
            if kind in kinds:
                continue
            if kind == "item":
                items += bool(_ITEM.match(line))
            elif _holds(kind, own, raw if kind in ("error", "script") else line):
                kinds.add(kind)
    if items > 2:
        kinds.add("filler")
    return sorted(kinds)


def _holds(kind: str, rules: list[Rule], line: str) -> bool:
    """Whether a line holds residue of the kind, judged by the rules that its text can match."""
    if kind == "placeholder":
        return _unfilled(line, rules)
    if kind == "value":
        return any(v in line.lower() for v in _VALUES) and _hollow(line)
    if kind == "filler":
        return any(r.pattern.search(line) for r in rules)
    return any(_says(r.pattern, line) for r in rules)


def _unfilled(line: str, rules: list[Rule]) -> bool:
    """Whether a placeholder of the line stands for content; the line is judged as code without any of its placeholders."""
    found = [(m.start(), m.end(), r.number) for r in rules for m in r.pattern.finditer(line)]
    if not found:
        return False
    rest, at = [], 0
    for start, end, _ in sorted(found):
        rest.append(line[at:start])
        at = max(at, end)
    statement = bool(_STATEMENT.search("".join(rest) + line[at:]))
    return any(number not in CODE_STYLES or not (statement or _quoted(line, start, end)) for start, end, number in found)


def _hollow(line: str) -> bool:
    found = _HOLLOW_WORD.findall(line)
    return bool(found) and not _STATEMENT.search(line) and (any(p.search(line) for p in _FAILED) or (len(found) > 1 and not _ABOUT_VALUES.search(line)))


def _quoted(line: str, start: int, end: int) -> bool:
    return start > 0 and end < len(line) and line[start - 1] in "\"'“‘`" and line[end] in "\"'”’`"


def _says(pattern: re.Pattern, line: str) -> bool:
    """Whether the line words the message itself, rather than being about it or code."""
    m = pattern.search(line)
    if not m:
        return False
    head = line[max(line.rfind(". ", 0, m.start()) + 1, 0) :]
    return not _ABOUT.search(head) and not _STATEMENT.search(line[: m.start()])


def _is_filler(paragraph: list[str]) -> bool:
    """Whether a paragraph is pseudo-Latin, keyboard words or one word over and over, by their density."""
    words = _WORD.findall(" ".join(paragraph).lower())
    if len(words) < 6:
        return False
    different = set(words)
    few = len(words) >= REPEATED_WORDS and len(different) <= (1 - REPEATED_SHARE) * len(words) + 1
    if few and max(map(words.count, different)) >= REPEATED_SHARE * len(words) and not _STATEMENT.search(paragraph[0]):
        return True
    if any(w.startswith(_LATIN_HEADS) for w in different) and sum(1 for w in words if _LATIN.match(w)) >= 0.6 * len(words):
        return True
    return bool(different & _MASH) and sum(1 for w in words if w in _MASH) >= 0.7 * len(words)


def residues(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds) of the documents in which residue stands where content should be.

    The whole text counts. Defined cases: null and blank texts are no case; repeated rows give repeated rows; a null id
    is kept; empty tables give no rows; further columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residue(t) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([f for f in found if f], pa.list_(pa.string()))], names=["doc_id", "kinds"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, kinds array<string>")
