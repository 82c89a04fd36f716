"""Front-end of the SQL dialect: statements are cut into tokens, rewritten and dispatched.

What the dialect shares with Spark SQL passes through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from millrace.functions.scalar import like_regex
from millrace.operators.layout import Key


class DialectError(ValueError):
    """A statement that the dialect doesn't have."""


@dataclass(frozen=True)
class Token:
    kind: str  # space, comment, string, number, name, quoted, op, meta
    text: str

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<comment>//[^\n]*|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
      | (?P<quoted>`[^`]*`)
      | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)
      | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
      | (?P<meta>\\[A-Za-z]+)
      | (?P<op>:=|~=|\^=|<>|!=|<=|>=|\|\||[-+*/%=<>().,;:\[\]])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    """Tokens without space and comments; space is put back where two words meet."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise DialectError(f"can't read {text[at : at + 20]!r}")
        if m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m.group()))
        at = m.end()
    return out


def text_of(ts: list[Token]) -> str:
    return " ".join(t.text for t in ts)


def statements(text: str) -> list[list[Token]]:
    """The tokens of each statement of a script."""
    out: list[list[Token]] = [[]]
    for t in tokens(text):
        if t.text == ";" and t.kind == "op":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


@dataclass
class Statement:
    kind: str
    name: str = ""
    query: list[Token] = field(default_factory=list)
    columns: list[tuple[str, str]] = field(default_factory=list)
    fmt: str = ""
    location: str = ""
    options: dict[str, str] = field(default_factory=dict)
    keys: list[Key] = field(default_factory=list)
    method: str = "bst"
    unique: bool = False
    table: str = ""


class _Reader:
    def __init__(self, ts: list[Token]):
        self.ts, self.at = ts, 0

    def peek(self, k: int = 0) -> Token:
        return self.ts[self.at + k] if self.at + k < len(self.ts) else Token("end", "")

    def take(self) -> Token:
        self.at += 1
        return self.ts[self.at - 1] if self.at <= len(self.ts) else Token("end", "")

    def accept(self, *words: str) -> bool:
        if all(self.peek(k).text.lower() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise DialectError(f"expected {' '.join(words)!r} at {self.peek().text!r}")

    def name(self) -> str:
        t = self.take()
        if t.kind not in ("name", "quoted"):
            raise DialectError(f"expected a name at {t.text!r}")
        return t.text.strip("`").lower()

    def string(self) -> str:
        t = self.take()
        if t.kind != "string":
            raise DialectError(f"expected a string at {t.text!r}")
        return literal(t.text)

    def rest(self) -> list[Token]:
        out, self.at = self.ts[self.at :], len(self.ts)
        return out

    def end(self) -> None:
        if self.at < len(self.ts):
            raise DialectError(f"unexpected {self.peek().text!r}")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def literal(text: str) -> str:
    """The value of a quoted string with C-style and unicode escapes."""
    body = text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1]
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), body, flags=re.S)


def quote(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse(ts: list[Token]) -> Statement:
    r = _Reader(ts)
    if r.peek().kind == "meta":
        return _meta(r)
    first = r.peek().word
    if r.peek(1).text == ":=":
        name = r.name()
        r.expect(":=")
        return Statement("create_as", name, r.rest(), fmt="parquet")
    if first == "create":
        return _create(r)
    if first == "drop":
        r.take()
        if r.accept("index"):
            return _last(r, Statement("drop_index", r.name()))
        r.expect("table")
        return _last(r, Statement("drop", r.name()))
    if first == "insert":
        r.take()
        r.expect("into")
        r.accept("table")
        return Statement("insert", r.name(), r.rest())
    if first == "attach":
        r.take()
        name = r.name()
        path = literal(r.take().text) if r.peek().kind == "string" else text_of(r.rest()).replace(" ", "")
        return Statement("attach", name, location=path)
    if first in ("detach", "desc", "describe"):
        r.take()
        return _last(r, Statement({"detach": "detach"}.get(first, "describe"), r.name()))
    if first == "show":
        r.take()
        if r.accept("tables"):
            return _last(r, Statement("show_tables"))
        if r.accept("table"):
            return _last(r, Statement("describe", r.name()))
        if r.accept("functions") or r.accept("function"):
            return _last(r, Statement("show_functions"))
        raise DialectError(f"can't show {r.peek().text!r}")
    if first == "session" or first == "set":
        raise DialectError(f"{text_of(ts[:2])!r} is a client's session verb; it has no meaning here")
    if first in ("select", "with", "values") or r.peek().text == "(":
        return Statement("select", query=ts)
    raise DialectError(f"unknown statement {r.peek().text!r}")


def _last(r: _Reader, s: Statement) -> Statement:
    r.end()
    return s


def _meta(r: _Reader) -> Statement:
    verb = r.take().text
    if verb == "\\t":
        return _last(r, Statement("show_tables") if r.peek().kind == "end" else Statement("describe", r.name()))
    if verb == "\\d":
        return _last(r, Statement("describe", r.name()) if r.peek().kind != "end" else Statement("show_tables"))
    if verb == "\\f":
        return _last(r, Statement("show_functions"))
    if verb == "\\c":
        return _last(r, Statement("cluster"))
    raise DialectError(f"unknown command {verb!r}")


def _create(r: _Reader) -> Statement:
    r.expect("create")
    unique = r.accept("unique")
    if r.accept("index"):
        s = Statement("create_index", r.name(), unique=unique)
        r.expect("on")
        s.table = r.name()
        if r.accept("using"):
            s.method = r.name()
        r.expect("(")
        while True:
            name, descending = r.name(), not r.accept("asc") and r.accept("desc")
            first = r.accept("null", "first")
            if not first:
                r.accept("null", "last")
            s.keys.append(Key(name, descending, first))
            if not r.accept(","):
                break
        r.expect(")")
        if r.accept("with"):
            s.options = _options(r)
        return _last(r, s)
    r.accept("external")
    r.expect("table")
    s = Statement("create", r.name())
    if r.peek().word in ("as", "using"):
        return _create_as(r, s)
    r.expect("(")
    while True:
        s.columns.append((r.name(), r.name()))
        if r.accept("("):
            while not r.accept(")"):
                r.take()
        if not r.accept(","):
            break
    r.expect(")")
    r.expect("using")
    s.fmt = r.name()
    if s.fmt != "mem":
        r.expect("location")
        s.location = r.string()
    if r.accept("with"):
        s.options = _options(r)
    return _last(r, s)


def _create_as(r: _Reader, s: Statement) -> Statement:
    """``create table t [using f [location 'l'] [with (..)]] as select ..``"""
    s.kind, s.fmt = "create_as", "parquet"
    if r.accept("using"):
        s.fmt = r.name()
        if r.accept("location"):
            s.location = r.string()
        if r.accept("with"):
            s.options = _options(r)
    r.expect("as")
    s.query = r.rest()
    return s


def _options(r: _Reader) -> dict[str, str]:
    out = {}
    r.expect("(")
    while True:
        key = r.string() if r.peek().kind == "string" else r.name()
        r.expect("=")
        out[key] = r.string() if r.peek().kind == "string" else r.take().text
        if not r.accept(","):
            break
    r.expect(")")
    return out


#: Words that end an ORDER BY list at its own depth.
_AFTER_ORDER = {"limit", "union", "intersect", "except", "offset", "rows", "range"}


#: Types of expressions of a query: SQL of a SELECT to the type names of its columns, None where it has no meaning.
Typer = Callable[[str], list[str] | None]
#: A function's name and the types of its arguments to its SQL text, cut where arguments go; None for one that is Spark's.
Caller = Callable[[str, list[str]], list[str]]


def rewrite(ts: list[Token], types: Typer | None = None, strict_like: bool = False, functions: tuple[Callable[[str], bool], Caller] | None = None) -> str:
    """Spark SQL of a query. ``types`` gives the types of operands in their query, for division and
    for functions; ``strict_like`` gives LIKE the dialect's wildcards; ``functions`` are (whether a name is a
    user's function, what a call of it stands for)."""
    ts = _group_empty(_union_join(ts))
    if strict_like:
        ts = _like(ts)
    ts = _random(ts)
    ts = [Token("op", "<>") if t.text in ("~=", "^=") else t for t in ts]
    ts = [Token("string", quote(literal(t.text))) if t.kind == "string" else t for t in ts]
    ts = _order(ts)
    if functions:
        ts = _calls(ts, types or (lambda text: None), *functions)
    return text_of(_division(ts, types or (lambda text: None)))


_ENDS = {"union", "intersect", "except", "minus"}
_AFTER_FROM = {"where", "group", "having", "order", "limit", "window", "qualify", "offset", *_ENDS}


def _sources(ts: list[Token], at: int) -> list[tuple[str, str]]:
    """(WITH clause, FROM clause) that the expression at ``at`` may name columns of: its own query's,
    then with those of the queries around it, then none."""
    head, depth = "", 0
    for k, t in enumerate(ts[: at + 1] if ts[0].word == "with" else []):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.word == "select":
            head = text_of(ts[:k]) + " "
            break
    out: list[tuple[str, str]] = []
    depth, begin = 0, 1
    for i in range(at - 1, -1, -1):  # out of the brackets, one query after the other
        t = ts[i]
        depth += (t.text == ")") - (t.text == "(")
        if t.word == "select" and depth <= 0 and depth < begin:
            begin = depth
            clause = _from(ts, i)
            if clause:
                out.append((head, (out[-1][1] + ", " if out else " from ") + clause))
    return [*out, (head, "")]


def _from(ts: list[Token], select: int) -> str:
    """The FROM clause of the query whose SELECT is at ``select``."""
    depth, begin = 0, None
    for k in range(select + 1, len(ts)):
        t = ts[k]
        if t.text == ")" and not depth or not depth and (t.word in _ENDS and ts[k + 1 : k + 2] and ts[k + 1].word != "join" or begin is not None and t.word in _AFTER_FROM):
            return text_of(ts[begin:k]) if begin is not None else ""
        depth += (t.text == "(") - (t.text == ")")
        if t.word == "from" and not depth and begin is None:
            begin = k + 1
    return text_of(ts[begin:]) if begin is not None else ""


def _types(ts: list[Token], at: int, operands: list[str], types: Typer) -> list[str] | None:
    for head, clause in _sources(ts, at):
        found = types(f"{head}select {', '.join(f'{x} as x{i}' for i, x in enumerate(operands))}{clause}")
        if found is not None:
            return found
    if len(operands) > 1:  # one may be grouped and the other not
        each = [_types(ts, at, [x], types) for x in operands]
        return [x[0] for x in each] if all(each) else None
    return None


def _calls(ts: list[Token], types: Typer, known: Callable[[str], bool], call: Caller) -> list[Token]:
    """Calls of users' functions, the innermost first, as what they stand for."""
    while True:
        at = next((i for i in range(len(ts) - 2, -1, -1) if ts[i].kind == "name" and ts[i + 1].text == "(" and known(ts[i].word) and (not i or ts[i - 1].text != ".")), None)
        if at is None:
            return ts
        close = _close(ts, at + 1)
        arguments, depth = [[]], 0
        for t in ts[at + 2 : close]:
            depth += (t.text == "(") - (t.text == ")")
            if t.text == "," and not depth:
                arguments.append([])
            else:
                arguments[-1].append(t)
        texts = [text_of(a) for a in arguments if a]
        kinds = _types(ts, at, texts, types) if texts else []
        if kinds is None:
            raise DialectError(f"can't tell the types of {ts[at].text}({', '.join(texts)})")
        parts = call(ts[at].word, kinds)
        text = "".join(p if k % 2 == 0 else f"({texts[int(p)]})" for k, p in enumerate(parts))
        ts = ts[:at] + [Token("raw", f"({text})")] + ts[close + 1 :]


def _op(*texts: str) -> list[Token]:
    return [Token("op" if not re.match(r"\w", t) else "name", t) for t in texts]


def _random(ts: list[Token]) -> list[Token]:
    out, i = [], 0
    while i < len(ts):
        if ts[i].word == "random" and i + 1 < len(ts) and ts[i + 1].text == "(":
            close = _close(ts, i + 1)
            if close > i + 2:
                out += _op("cast", "(", "floor", "(", "rand", "(", ")", "*", "(") + _random(ts[i + 2 : close]) + _op(")", ")", "as", "int", ")")
                i = close + 1
                continue
        out.append(ts[i])
        i += 1
    return out


def _close(ts: list[Token], at: int) -> int:
    """Where the bracket at ``at`` is closed."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i].text == "(") - (ts[i].text == ")")
        if not depth:
            return i
    raise DialectError("a bracket isn't closed")


def _open(ts: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        depth += (ts[i].text == ")") - (ts[i].text == "(")
        if not depth:
            return i
    raise DialectError("a bracket isn't opened")


def _union_join(ts: list[Token]) -> list[Token]:
    """``a union join b`` -> ``a full outer join b on false``."""
    out, i = [], 0
    while i < len(ts):
        if ts[i].word == "union" and i + 1 < len(ts) and ts[i + 1].word == "join":
            out += _op("full", "outer", "join")
            end = _relation(ts, i + 2)
            out += _union_join(ts[i + 2 : end]) + _op("on", "false")
            i = end
            continue
        out.append(ts[i])
        i += 1
    return out


#: Words that can't be the alias of a relation.
_NO_ALIAS = {"where", "group", "order", "having", "limit", "union", "intersect", "except", "join", "inner", "left", "right", "full", "cross", "natural", "on", "using"}


def _relation(ts: list[Token], at: int) -> int:
    """Where the relation at ``at`` ends: a name or a query in brackets, with its alias."""
    if at >= len(ts):
        raise DialectError("a join has no right side")
    if ts[at].text == "(":
        at = _close(ts, at) + 1
    else:
        at += 1
        while at + 1 < len(ts) and ts[at].text == ".":
            at += 2
    if at < len(ts) and ts[at].word == "as":
        at += 1
    if at < len(ts) and ts[at].kind in ("name", "quoted") and ts[at].word not in _NO_ALIAS:
        at += 1
        if at < len(ts) and ts[at].text == "(":
            at = _close(ts, at) + 1
    return at


def _group_empty(ts: list[Token]) -> list[Token]:
    """``group by ()`` -> ``group by grouping sets (())``."""
    out = list(ts)
    for i in range(len(ts) - 3):
        if ts[i].word == "group" and ts[i + 1].word == "by" and ts[i + 2].text == "(" and ts[i + 3].text == ")":
            return _group_empty(out[: i + 2] + _op("grouping", "sets", "(", "(", ")", ")") + out[i + 4 :])
    return out


def _like(ts: list[Token]) -> list[Token]:
    out = []
    for i, t in enumerate(ts):
        if t.word == "like":
            if i + 1 == len(ts) or ts[i + 1].kind != "string" or i + 2 < len(ts) and ts[i + 2].text in ("||", "+"):
                raise DialectError("LIKE takes a string constant here")
            out.append(Token("name", "rlike"))
        elif t.kind == "string" and i and ts[i - 1].word == "like":
            out.append(Token("string", quote(like_regex(literal(t.text)))))
        else:
            out.append(t)
    return out


def _division(ts: list[Token], types: Typer) -> list[Token]:
    """``a / b`` of two integers -> ``a div b``; a is all of the product that stands before."""
    out, depth, places = list(ts), 0, []
    for i, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "/" and t.kind == "op":
            places.append((-depth, i))
    for _, i in sorted(places):  # the innermost query first: what it gives has then its type
        sides = [_before(out, i), _after(out, i)]
        if all(x.kind == "number" for s in sides for x in s if x.kind != "op" and x.text != "div"):
            whole = all(x.text.isdigit() for s in sides for x in s if x.kind == "number") and not any(x.text == "/" for s in sides for x in s)
        else:
            kinds = _types(out, i, [text_of(s) for s in sides], types)
            whole = kinds is not None and all(k in ("tinyint", "smallint", "int", "bigint") for k in kinds)
        if whole:
            out[i] = Token("name", "div")
    return out


def _before(ts: list[Token], i: int) -> list[Token]:
    """The product that ends before ``i``."""
    j = i
    while True:
        j -= 1
        if j >= 0 and ts[j].text == ")":
            j = _open(ts, j)
            if j and ts[j - 1].kind == "name" and ts[j - 1].word not in _NO_CALL:
                j -= 1
        elif j >= 0 and ts[j].word == "end":
            depth = 1
            while j > 0 and depth:
                j -= 1
                depth += (ts[j].word == "end") - (ts[j].word == "case")
        while j >= 2 and ts[j - 1].text == ".":
            j -= 2
        if j < 1 or ts[j - 1].text not in ("*", "/", "%", "div") or ts[j - 1].kind == "string":
            return ts[max(j, 0) : i]
        j -= 1


#: Words before a bracket that isn't a call's.
_NO_CALL = {"select", "where", "and", "or", "not", "in", "on", "by", "having", "when", "then", "else", "case", "between", "distinct", "from", "like", "is", "div"}


def _after(ts: list[Token], i: int) -> list[Token]:
    j = i + 1
    while j < len(ts) and ts[j].text in ("+", "-"):
        j += 1
    while j + 2 < len(ts) and ts[j + 1].text == ".":
        j += 2
    if j + 1 < len(ts) and ts[j].kind == "name" and ts[j + 1].text == "(":
        j = _close(ts, j + 1)
    elif j < len(ts) and ts[j].text == "(":
        j = _close(ts, j)
    elif j < len(ts) and ts[j].word == "case":
        depth = 1
        while j + 1 < len(ts) and depth:
            j += 1
            depth += (ts[j].word == "case") - (ts[j].word == "end")
    return ts[i + 1 : j + 1]


def equalities(ts: list[Token]) -> tuple[int, dict[str, str]] | None:
    """Of a query of one table, the table's place among the tokens and the columns that its WHERE
    compares with a constant in each row that it keeps, with the constant's text; None for other queries."""
    if not ts or ts[0].word != "select":
        return None
    depth, at, where, end = 0, None, None, len(ts)
    for k, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if depth or t.kind != "name":
            continue
        if t.word == "from" and at is None:
            at = k + 1
        elif t.word == "where" and where is None:
            where = k
        elif t.word in _ENDS or t.word == "join":
            return None
        elif t.word in _AFTER_FROM and where is not None and end == len(ts):
            end = k
    if at is None or where is None or ts[at].kind not in ("name", "quoted") or _relation(ts, at) != where:
        return None
    out, items, depth = {}, [[]], 0
    for t in ts[where + 1 : end]:
        depth += (t.text == "(") - (t.text == ")")
        if t.word in ("or", "between", "not", "case") and not depth:
            return None
        if t.word == "and" and not depth:
            items.append([])
        else:
            items[-1].append(t)
    for item in items:
        if len(item) == 3 or len(item) == 5 and item[1].text == ".":
            name, op, value = item[-3:]
            if op.text == "=" and name.kind in ("name", "quoted") and value.kind in ("string", "number"):
                out[name.text.strip("`").lower()] = value.text
    return at, out


def _order(ts: list[Token]) -> list[Token]:
    """Nulls are put last where an ORDER BY key doesn't say; ``null first`` becomes ``nulls first``."""
    out: list[Token] = []
    i = 0
    while i < len(ts):
        if ts[i].word == "order" and i + 1 < len(ts) and ts[i + 1].word == "by":
            out += ts[i : i + 2]
            i += 2
            depth, item = 0, []
            while i < len(ts) and (depth or ts[i].text != ")" and ts[i].word not in _AFTER_ORDER):
                depth += (ts[i].text == "(") - (ts[i].text == ")")
                if not depth and ts[i].text == ",":
                    out += _key(item) + _op(",")
                    item = []
                else:
                    item.append(ts[i])
                i += 1
            out += _key(item)
            continue
        out.append(ts[i])
        i += 1
    return out


def _key(item: list[Token]) -> list[Token]:
    words = [t.word for t in item]
    if words[-2:-1] in (["null"], ["nulls"]) and words[-1] in ("first", "last"):
        return [*item[:-2], Token("name", "nulls"), item[-1]]
    return [*item, *_op("nulls", "last")]
