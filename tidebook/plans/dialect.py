"""The query dialect: lexer, parser and formatter.

    SELECT list FROM 'symbol'.'exchange' [WHERE condition {AND condition}] [LIMIT n]
    SUBSCRIBE list FROM 'symbol'.'exchange' [WHERE condition {AND condition}]

A list is * or columns and metric calls. Conditions are on timestamp or price (BETWEEN a AND b, or
a comparison) or AT time. Keywords and columns are in any case; strings have no escapes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidebook.functions.metrics import INTEGERS, NAMES, Metric
from tidebook.schema import TidebookError

COLUMNS = ("price", "quantity", "order_count", "timestamp", "sequence_number", "side", "level")
WORDS = ("SELECT", "SUBSCRIBE", "FROM", "WHERE", "AND", "BETWEEN", "LIMIT", "AT")
SYNONYMS = {"timestamp_ns": "timestamp"}
TOKEN = re.compile(r"(?P<space>\s+)|(?P<string>'[^']*')|(?P<integer>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|[<>=*,.()])")


class ParseError(TidebookError):
    def __init__(self, line: int, col: int, message: str):
        super().__init__("PARSE", f"Parse error at line {line}, col {col}: {message}")
        self.line, self.col = line, col


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, column, metric, name, string, integer, op or end
    text: str
    line: int
    col: int


def lex(sql: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(sql):
        found = TOKEN.match(sql, at)
        if not found:
            raise ParseError(line, at - start + 1, "unterminated string" if sql[at] == "'" else f"unexpected character '{sql[at]}'")
        kind, text = found.lastgroup, found.group()
        if kind == "name":
            lower = SYNONYMS.get(text.lower(), text.lower())
            if text.upper() in WORDS:
                kind, text = "keyword", text.upper()
            elif text.upper() in NAMES:
                kind, text = "metric", text.upper()
            elif lower in COLUMNS:
                kind, text = "column", lower
        if kind != "space":
            out.append(Token(kind, text[1:-1] if kind == "string" else text, line, at - start + 1))
        for k, c in enumerate(found.group()):
            if c == "\n":
                line, start = line + 1, at + k + 1
        at = found.end()
    return [*out, Token("end", "", line, at - start + 1)]


@dataclass(frozen=True)
class Condition:
    """A comparison (op one of = < <= > >=) or BETWEEN (two values) on timestamp or price."""

    column: str
    op: str
    values: tuple[int, ...]


@dataclass
class Query:
    kind: str = "SELECT"
    items: list[str] = field(default_factory=list)  # empty: *
    metrics: list[Metric] = field(default_factory=list)
    symbol: str = ""
    exchange: str = ""
    conditions: list[Condition] = field(default_factory=list)
    at_ns: int | None = None
    limit: int | None = None

    @property
    def columns(self) -> list[str]:
        return [x for x in self.items if "(" not in x]

    def bounds(self, column: str, strict: bool = True) -> tuple[int | None, int | None]:
        """Inclusive lower and upper bound of a column.

        Strictly, comparisons mean what they say and bounds intersect. Otherwise > is >=, < is <=,
        = is a lower bound only, and of repeated bounds the last counts.
        """
        low = high = None
        for c in self.conditions:
            if c.column != column:
                continue
            if c.op == "BETWEEN":
                a, b = c.values
            elif strict:
                v = c.values[0]
                a, b = {"=": (v, v), ">": (v + 1, None), ">=": (v, None), "<": (None, v - 1), "<=": (None, v)}[c.op]
            else:
                a, b = (None, c.values[0]) if c.op in ("<", "<=") else (c.values[0], None)
            if a is not None:
                low = max(low, a) if strict and low is not None else a
            if b is not None:
                high = min(high, b) if strict and high is not None else b
        return low, high


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str) -> None:
        raise ParseError(self.now.line, self.now.col, message)

    def take(self, kind: str, text: str | None = None, what: str = "") -> Token:
        token = self.now
        if token.kind != kind or text is not None and token.text != text:
            self.fail(f"expected {what or text or kind}" + (f", found '{token.text}'" if token.text else ""))
        self.at += 1
        return token

    def skip(self, kind: str, text: str) -> bool:
        if self.now.kind == kind and self.now.text == text:
            self.at += 1
            return True
        return False

    def whole(self) -> int:
        return int(self.take("integer", what="an integer").text)

    def query(self) -> Query:
        out = Query()
        if self.skip("keyword", "SUBSCRIBE"):
            out.kind = "SUBSCRIBE"
        else:
            self.take("keyword", "SELECT", "SELECT or SUBSCRIBE")
        if not self.skip("op", "*"):
            self.item(out)
            while self.skip("op", ","):
                self.item(out)
        self.take("keyword", "FROM")
        out.symbol = self.take("string", what="a quoted symbol").text
        self.take("op", ".", "'.'")
        out.exchange = self.take("string", what="a quoted exchange").text
        if self.skip("keyword", "WHERE"):
            self.condition(out)
            while self.skip("keyword", "AND"):
                self.condition(out)
        if out.kind == "SELECT" and self.skip("keyword", "LIMIT"):
            out.limit = self.whole()
            if out.limit < 0:
                self.fail("LIMIT must not be negative")
        self.take("end", what="the end of the query")
        return out

    def item(self, out: Query) -> None:
        if self.now.kind == "column":
            out.items.append(self.take("column").text)
            return
        name = self.take("metric", what="a column or a metric").text
        self.take("op", "(", f"'(' after {name}")
        n = INTEGERS.get(name, 0)
        if n:
            numbers = [self.whole()]
            while len(numbers) < n:
                self.take("op", ",", "','")
                numbers.append(self.whole())
            text = ", ".join(map(str, numbers))
        else:
            numbers, text = [], "*"
            if self.now.kind == "column":
                text = self.take("column").text
            else:
                self.skip("op", "*")  # empty parentheses mean *
        self.take("op", ")", f"')' after the arguments of {name}")
        out.items.append(f"{name}({text})")
        out.metrics.append(Metric(name, tuple(numbers)))

    def condition(self, out: Query) -> None:
        if self.now.kind == "keyword" and self.now.text == "AT":
            if out.kind == "SUBSCRIBE":
                self.fail("AT is no condition of a subscription")
            self.at += 1
            out.at_ns = self.whole()
            return
        if self.now.kind != "column" or self.now.text not in ("timestamp", "price"):
            self.fail("expected timestamp, price or AT")
        column = self.take("column").text
        if self.skip("keyword", "BETWEEN"):
            low = self.whole()
            self.take("keyword", "AND")
            out.conditions.append(Condition(column, "BETWEEN", (low, self.whole())))
        elif self.now.kind == "op" and self.now.text in ("=", "<", "<=", ">", ">="):
            op = self.take("op").text
            out.conditions.append(Condition(column, op, (self.whole(),)))
        else:
            self.fail("expected BETWEEN or a comparison")


def parse(sql: str) -> Query:
    return _Parser(lex(sql)).query()


def format_query(q: Query) -> str:
    """Canonical text, which parses to an equal query."""
    where = [f"{c.column} BETWEEN {c.values[0]} AND {c.values[1]}" if c.op == "BETWEEN" else f"{c.column} {c.op} {c.values[0]}" for c in q.conditions]
    where += [f"AT {q.at_ns}"] * (q.at_ns is not None)
    return (f"{q.kind} {', '.join(q.items) or '*'} FROM '{q.symbol}'.'{q.exchange}'" + (" WHERE " + " AND ".join(where) if where else "")
            + (f" LIMIT {q.limit}" if q.limit is not None else ""))
