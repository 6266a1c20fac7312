"""A small path-pattern language compiled to DataFrame plans.

    MATCH (a:Label)-[r:TYPE]->(b:Label), ... WHERE a.name = 'x' AND NOT b.name CONTAINS 'y'
    RETURN [DISTINCT] a.name AS n, type(r), COUNT(*) ORDER BY n DESC LIMIT 10

Patterns have any number of hops and may share variables; directions count (``-[]-`` matches both). Conditions are
combined with AND, OR, NOT and parentheses. Items next to COUNT are its groups. Values are literals of the plan, never
spliced into text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties that are columns, with the spellings they go by; others are read from the JSON properties.
COLUMNS = {
    "id": "id", "label": "label", "name": "name", "project": "project", "qualified_name": "qualified_name", "qualifiedname": "qualified_name", "file_path": "file_path", "filepath": "file_path",
    "start_line": "start_line", "startline": "start_line", "end_line": "end_line", "endline": "end_line",
}
NODE_COLUMNS = ("id", "label", "name", "qualified_name", "file_path", "start_line", "end_line")
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<int>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|<=|>=|<-|->|[-()\[\]:,.=<>*]))")


class CypherError(ValueError):
    """The query doesn't follow the grammar."""


@dataclass
class Hop:
    """One relationship between two node variables; direction is out, in or any."""

    source: str
    target: str
    variable: str
    kind: str | None
    direction: str


@dataclass
class Query:
    """A parsed query."""

    labels: dict[str, str | None] = field(default_factory=dict)
    hops: list[Hop] = field(default_factory=list)
    where: tuple | None = None
    items: list[tuple[str, str, str, str]] = field(default_factory=list)  # kind, variable, property, output name
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected text at {text[at:at + 12]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.unnamed = 0, 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1].upper() in wanted

    def take(self, *wanted: str) -> bool:
        if self.peek(*wanted):
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise CypherError(f"expected {wanted} before {self.tokens[self.at:self.at + 1]}")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise CypherError(f"expected a name before {self.tokens[self.at:self.at + 1]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def fresh(self) -> str:
        self.unnamed += 1
        return f"_{self.unnamed}"

    def node(self, q: Query) -> str:
        self.need("(")
        name = self.word() if not self.peek(":", ")") else self.fresh()
        label = self.word() if self.take(":") else None
        self.need(")")
        q.labels[name] = label or q.labels.get(name)
        return name

    def pattern(self, q: Query) -> None:
        left = self.node(q)
        while self.peek("-", "<-"):
            inward = self.take("<-")
            if not inward:
                self.need("-")
            variable, kind = self.fresh(), None
            if self.take("["):
                if not self.peek(":", "]"):
                    variable = self.word()
                kind = self.word() if self.take(":") else None
                self.need("]")
            outward = self.take("->")
            if not outward:
                self.need("-")
            right = self.node(q)
            q.hops.append(Hop(left, right, variable, kind, "in" if inward else "out" if outward else "any"))
            left = right

    def value(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "str":
            return text[1:-1]
        if kind == "int":
            return float(text) if "." in text else int(text)
        if text.upper() in ("TRUE", "FALSE"):
            return text.upper() == "TRUE"
        raise CypherError(f"expected a value, found {text!r}")

    def either(self) -> tuple:
        out = self.both()
        while self.take("OR"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.single()
        while self.take("AND"):
            out = ("and", out, self.single())
        return out

    def single(self) -> tuple:
        if self.take("NOT"):
            return ("not", self.single())
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        variable = self.word()
        self.need(".")
        prop = self.word()
        if self.take("CONTAINS"):
            return ("contains", variable, prop, self.value())
        if self.take("STARTS"):
            self.need("WITH")
            return ("starts", variable, prop, self.value())
        if self.take("ENDS"):
            self.need("WITH")
            return ("ends", variable, prop, self.value())
        if self.take("IN"):
            self.need("[")
            values = [self.value()]
            while self.take(","):
                values.append(self.value())
            self.need("]")
            return ("in", variable, prop, values)
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return (op, variable, prop, self.value())
        raise CypherError("expected a comparison")

    def item(self) -> tuple[str, str, str, str]:
        if self.peek("COUNT") and self.tokens[self.at + 1 : self.at + 2] == [("op", "(")]:
            self.at += 2
            variable = "*" if self.take("*") else self.word()
            self.need(")")
            out = ("count", variable, "", "count")
        elif self.peek("TYPE") and self.tokens[self.at + 1 : self.at + 2] == [("op", "(")]:
            self.at += 2
            variable = self.word()
            self.need(")")
            out = ("type", variable, "", f"type({variable})")
        else:
            variable = self.word()
            prop = self.word() if self.take(".") else ""
            out = ("prop", variable, prop, f"{variable}.{prop}") if prop else ("node", variable, "", variable)
        return (*out[:3], self.word()) if self.take("AS") else out

    def query(self) -> Query:
        q = Query()
        self.need("MATCH")
        self.pattern(q)
        while self.take(","):
            self.pattern(q)
        if self.take("WHERE"):
            q.where = self.either()
        self.need("RETURN")
        q.distinct = self.take("DISTINCT")
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                key = self.item()[3]
                q.order.append((key, not self.take("DESC")))
                self.take("ASC")
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            q.limit = self.value()
        if self.at < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at][1]!r}")
        return q


def parse(text: str) -> Query:
    """The query of a text; raises CypherError."""
    return _Parser(text).query()


#: Rows that one side of an unconnected pattern may have.
UNCONNECTED_ROWS = 1000
#: Columns that hold numbers.
NUMBERS = frozenset(("id", "start_line", "end_line"))
#: Rows of a query without LIMIT, and the columns of relationship queries, in compatible mode.
COMPATIBLE_LIMIT, COMPATIBLE_COLUMNS = 100, ("name", "label", "qualified_name")


def _column(variable: str, prop: str, compatible: bool = False) -> Column:
    known = COLUMNS.get(prop.lower(), "name" if compatible else None)
    return F.col(f"`{variable}.{known}`") if known else F.get_json_object(F.col(f"`{variable}.properties`"), f"$.{prop}")


def _comparable(col: Column, prop: str, value) -> tuple[Column, object]:
    """Column and value as numbers or as texts, so that what is no number compares as null instead of ending the job."""
    if COLUMNS.get(prop.lower()) in NUMBERS:
        return (col, value) if isinstance(value, (int, float)) else (col.cast("string"), str(value))
    if prop.lower() in COLUMNS or isinstance(value, bool) or not isinstance(value, (int, float)):
        return col, str(value).lower() if isinstance(value, bool) else str(value)
    return col.try_cast("double"), float(value)


def _condition(c: tuple, compatible: bool = False) -> Column:
    if c[0] == "and":
        return _condition(c[1], compatible) & _condition(c[2], compatible)
    if c[0] == "or":
        return _condition(c[1], compatible) | _condition(c[2], compatible)
    if c[0] == "not":
        return ~_condition(c[1], compatible)
    op, variable, prop, value = c
    col = _column(variable, prop, compatible)
    if op == "in":
        pairs = [_comparable(col, prop, v) for v in value]
        return reduce(lambda a, b: a | b, [x == v for x, v in pairs], F.lit(False))
    if op in ("contains", "starts", "ends"):
        low, word = F.lower(col), str(value).lower()
        return {"contains": lambda: F.contains(low, F.lit(word)), "starts": lambda: low.startswith(word), "ends": lambda: low.endswith(word)}[op]()
    x, v = _comparable(col, prop, value)
    return {"=": x == v, "<>": x != v, "<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[op]


def _together(plan: DataFrame, more: DataFrame) -> DataFrame:
    """All pairs of the rows of two unconnected patterns, of which one must be small."""
    small = [df for df in (plan, more) if df.limit(UNCONNECTED_ROWS + 1).count() <= UNCONNECTED_ROWS]
    if not small:
        raise CypherError(f"the pattern falls into parts that aren't connected and have more than {UNCONNECTED_ROWS} rows each")
    return plan.crossJoin(F.broadcast(more) if small[-1] is more else more)


def run(text: str, nodes: DataFrame, edges: DataFrame, compatible: bool = False) -> DataFrame:
    """The plan of a query over nodes and edges.

    ``compatible`` answers as servers of this language do that know a few columns only: without LIMIT 100 rows, an unknown
    property stands for the name, and a relationship query gives name, label and qualified name of both ends and the type,
    whatever it returns.

    Labels and types are filtered at the scans. Relationships are unique by source, target and type; the variables of a
    pattern are joined by equality, so Catalyst orders and prunes. Unbound variables raise CypherError.
    """
    q = parse(text)
    columns = [*NODE_COLUMNS, "project", "properties"]

    def scan(v: str) -> DataFrame:
        base = nodes if q.labels[v] is None else nodes.where(F.col("label") == q.labels[v])
        return base.select(*[F.col(c).alias(f"{v}.{c}") for c in columns])

    bound: dict[str, DataFrame] = {}
    plan = None
    for h in q.hops:
        kind = edges if h.kind is None else edges.where(F.col("type") == h.kind)
        e = kind.select(F.col("source_id").alias(f"{h.variable}.s"), F.col("target_id").alias(f"{h.variable}.t"), F.col("type").alias(f"{h.variable}.type")).distinct()
        if h.direction == "any":
            e = e.unionByName(e.select(F.col(f"`{h.variable}.t`").alias(f"{h.variable}.s"), F.col(f"`{h.variable}.s`").alias(f"{h.variable}.t"), F.col(f"`{h.variable}.type`"))).distinct()
        a, b = (h.target, h.source) if h.direction == "in" else (h.source, h.target)
        if plan is None:
            plan, bound[a] = scan(a), None
        elif a not in bound and b not in bound:
            plan, bound[a] = _together(plan, scan(a)), None
        if a in bound:
            on = F.col(f"`{a}.id`") == F.col(f"`{h.variable}.s`")
            if b in bound:
                on = on & (F.col(f"`{b}.id`") == F.col(f"`{h.variable}.t`"))
            plan = plan.join(e, on)
            if b not in bound:
                plan, bound[b] = plan.join(scan(b), F.col(f"`{b}.id`") == F.col(f"`{h.variable}.t`")), None
        else:
            plan = plan.join(e, F.col(f"`{b}.id`") == F.col(f"`{h.variable}.t`"))
            plan, bound[a] = plan.join(scan(a), F.col(f"`{a}.id`") == F.col(f"`{h.variable}.s`")), None
    for v in q.labels:
        if v not in bound:
            plan, bound[v] = (scan(v) if plan is None else _together(plan, scan(v))), None
    kinds = {h.variable for h in q.hops}
    for kind, variable, _, _ in q.items:
        if variable != "*" and variable not in bound and not (variable in kinds and kind in ("type", "count")):
            raise CypherError(f"unbound variable {variable}")
    if q.where is not None:
        plan = plan.where(_condition(q.where, compatible))
    outputs, counts, items = [], [], q.items
    if compatible and q.hops and not any(i[0] == "count" for i in items):
        h = q.hops[0]
        outputs = [F.col(f"`{v}.{c}`").alias(f"{v}.{c}") for v in (h.source, h.target) for c in COMPATIBLE_COLUMNS] + [F.col(f"`{h.variable}.type`").alias("type")]
        items = []
    for kind, variable, prop, name in items:
        if kind == "prop":
            outputs.append(_column(variable, prop, compatible).alias(name))
        elif kind == "type":
            outputs.append(F.col(f"`{variable}.type`").alias(name))
        elif kind == "node":
            outputs += [F.col(f"`{variable}.{c}`").alias(f"{name}.{c}") for c in NODE_COLUMNS]
        else:
            counts.append(F.count("*").alias(name))
    if counts:
        plan = plan.groupBy(*outputs).agg(*counts) if outputs else plan.agg(*counts)
    else:
        plan = plan.select(*outputs)
    if q.distinct:
        plan = plan.distinct()
    if q.order:
        plan = plan.orderBy(*[F.col(f"`{k}`").asc() if up else F.col(f"`{k}`").desc() for k, up in q.order])
    limit = COMPATIBLE_LIMIT if compatible and q.limit is None else q.limit
    return plan if limit is None else plan.limit(limit)
