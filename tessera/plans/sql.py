"""The SQL subset and the FIND dialect."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from tessera.plans import nodes as N
from tessera.plans.lexer import ParseError, Parser, strip_comments

_CLAUSES = ("WHERE", "JOIN", "INNER", "LEFT", "ORDER", "LIMIT", "SKIP", "OFFSET", "VECTOR", "TRAVERSE", "USING")


def parse_sql(text: str, args: Sequence[Any] = ()) -> Any:
    p = Parser(strip_comments(text), args)
    out = _statement(p)
    p.end()
    return out


def _statement(p: Parser) -> Any:
    if p.take("EXPLAIN"):
        analyze = p.take("ANALYZE")
        verbose = p.take("VERBOSE")
        return N.Explain(_statement(p), analyze, verbose)
    if p.take("ANALYZE"):
        p.take("TABLE")
        return N.Analyze(p.name())
    if p.take("SELECT"):
        return _select(p)
    if p.take("FIND"):
        return _clauses(p, N.Find(p.name()))
    if p.take("COUNT"):
        p.expect("FROM")
        return _clauses(p, N.Find(p.name(), count=True))
    if p.take("INSERT"):
        return _insert(p)
    if p.take("UPDATE"):
        return _update(p)
    if p.word("DELETE", "EDGE") or p.word("CREATE", "EDGE"):
        return _edge(p)
    if p.take("DELETE"):
        p.expect("FROM")
        name = p.name()
        return N.Delete(name, p.predicate() if p.take("WHERE") else None)
    if p.take("CREATE"):
        return _create(p)
    if p.take("DROP"):
        if p.take("INDEX"):
            name = p.name()
            return N.Index(p.name() if p.take("ON") else "", name, [], drop=True)
        if not (p.take("TABLE") or p.take("COLLECTION")):
            raise ParseError("DROP what?")
        p.take("IF", "EXISTS")
        return N.Drop(p.name())
    if p.take("ALTER"):
        return _alter(p)
    if p.take("SHOW"):
        what = p.name().lower()
        if what not in ("tables", "collections", "indexes", "databases", "columns"):
            raise ParseError(f"SHOW what? {what!r}")
        return N.Show(what, p.name() if p.take("FROM") or p.take("IN") else None)
    if p.take("DESCRIBE") or p.take("DESC"):
        p.take("TABLE")
        return N.Show("columns", p.name())
    for word in ("SET", "BEGIN", "COMMIT", "ROLLBACK", "START"):
        if p.take(word):
            rest = p.text[p.peek().at :] if p.peek().kind != "end" else ""
            p.at = len(p.tokens)
            return N.Acknowledge(f"{word} {rest}".strip())
    raise ParseError(f"no statement: {p.text[:40]!r}")


def _select(p: Parser) -> Any:
    columns: list[Any] | None = None
    distinct, count = None, False
    if p.take("DISTINCT"):
        distinct = p.name()
    elif p.word("COUNT") and p.peek(1).text == "(":
        p.next()
        p.expect("(")
        if not p.op("*"):
            p.name()
        p.expect(")")
        if p.take("AS"):
            p.name()
        count = True
    elif not p.op("*"):
        columns = [_column(p)]
        while p.op(","):
            columns.append(_column(p))
        if p.peek().kind == "end" and all(isinstance(c, N.Session) for c in columns):
            return columns
    p.expect("FROM")
    return _clauses(p, N.Find(p.name(), columns=columns, distinct=distinct, count=count))


def _column(p: Parser) -> Any:
    """A field, or (field, name) where it is renamed, or a function of the session."""
    name = p.name()
    if p.op("("):
        p.expect(")")
        out: Any = N.Session(name.lower().rsplit(".", 1)[-1])
        return N.Session(out.name, p.name()) if p.take("AS") else out
    if p.op("."):
        p.expect("*")
        return f"{name}.*"
    return (name, p.name()) if p.take("AS") else name


def _clauses(p: Parser, f: N.Find) -> N.Find:
    if p.take("AS") or (p.peek().kind == "name" and p.peek().text.upper() not in _CLAUSES):
        f.alias = p.name()
    while True:
        if p.take("WHERE"):
            f.where = p.predicate()
        elif p.word("JOIN") or p.word("INNER", "JOIN") or p.word("LEFT"):
            left = p.take("LEFT")
            p.take("OUTER" if left else "INNER")
            p.expect("JOIN")
            table = p.name()
            alias = p.name() if p.take("AS") or not p.word("ON") else table
            p.expect("ON")
            a = p.name()
            p.expect("=")
            b = p.name()
            own = lambda x: "." in x and x.split(".")[0] in ((alias,) if alias != table else (table,))
            if own(a) and not own(b):
                a, b = b, a
            if "." in b and not own(b):
                raise ParseError(f"ON must compare with a field of {alias}, not {b}")
            f.joins.append(N.Join(table, a, b.split(".", 1)[1] if own(b) else b, "left" if left else "inner", alias))
        elif p.take("ORDER", "BY"):
            while True:
                name = p.name()
                down = p.take("DESC")
                if not down:
                    p.take("ASC")
                f.order.append((name, not down))
                if not p.op(","):
                    break
        elif p.take("LIMIT"):
            f.limit = p.integer()
        elif p.take("SKIP") or p.take("OFFSET"):
            f.skip = p.integer()
        elif p.take("VECTOR"):
            f.near = vector(p)
        elif p.take("TRAVERSE"):
            f.traverse = _traverse(p)
        else:
            return f


def vector(p: Parser) -> N.Near:
    """NEAR [..] TOP k USING INDEX name."""
    p.take("NEAR")
    v = tuple(float(x) for x in p.literal())
    k, index = 10, None
    if p.take("TOP") or p.take("K"):
        k = p.integer()
    if p.take("USING"):
        p.take("INDEX")
        index = p.name()
    return N.Near(v, k, index)


def _traverse(p: Parser) -> N.Traverse:
    """FROM 'id' [DEPTH n] [VIA relation]."""
    start, depth, relation = None, 1, None
    while True:
        if p.take("FROM"):
            start = str(p.literal())
        elif p.take("DEPTH"):
            depth = p.integer()
        elif p.take("VIA"):
            relation = p.name()
        else:
            break
    if start is None:
        raise ParseError("TRAVERSE needs a start")
    return N.Traverse(start, depth, relation)


def _insert(p: Parser) -> N.Insert:
    p.expect("INTO")
    name = p.name()
    if p.peek().text == "{":
        at = p.peek().at
        body, used = json.JSONDecoder().raw_decode(p.text[at:])
        while p.peek().kind != "end" and p.peek().at < at + used:
            p.next()
        return N.Insert(name, [body])
    columns = []
    p.expect("(")
    while not p.op(")"):
        columns.append(p.name())
        p.op(",")
    p.expect("VALUES")
    rows = []
    while True:
        p.expect("(")
        values = []
        while not p.op(")"):
            values.append(p.literal())
            p.op(",")
        if len(values) != len(columns):
            raise ParseError(f"{len(columns)} columns but {len(values)} values")
        rows.append(dict(zip(columns, values, strict=True)))
        if not p.op(","):
            return N.Insert(name, rows)


def _update(p: Parser) -> N.Update:
    name = p.name()
    p.expect("SET")
    sets: dict[str, Any] = {}
    while True:
        field = p.name()
        p.expect("=")
        if p.peek().kind == "name" and not p.is_literal():
            source = p.name()
            sign = 1 if p.op("+") else -1 if p.op("-") else 0
            if not sign:
                raise ParseError("expected + or -")
            sets[field] = N.Arithmetic(source, sign * p.literal())
        else:
            sets[field] = p.literal()
        if not p.op(","):
            return N.Update(name, sets, p.predicate() if p.take("WHERE") else None)


def _edge(p: Parser) -> N.EdgeChange:
    """CREATE EDGE FROM 'a' TO 'b' [TYPE|VIA relation] [WEIGHT w], DELETE EDGE likewise."""
    delete = p.next().text.upper() == "DELETE"
    p.expect("EDGE")
    source = target = relation = None
    weight = 1.0
    while p.peek().kind == "name":
        if p.take("FROM"):
            source = str(p.literal())
        elif p.take("TO"):
            target = str(p.literal())
        elif p.take("TYPE") or p.take("VIA") or p.take("RELATION"):
            relation = p.name()
        elif p.take("WEIGHT"):
            weight = float(p.literal())
        else:
            raise ParseError(f"unexpected {p.peek().text!r}")
    if source is None or target is None:
        raise ParseError("an edge needs FROM and TO")
    return N.EdgeChange(source, target, relation, weight, delete)


def _create(p: Parser) -> Any:
    if p.take("UNIQUE"):
        p.expect("INDEX")
        return _index(p, True)
    if p.take("INDEX"):
        return _index(p, False)
    if not (p.take("TABLE") or p.take("COLLECTION")):
        raise ParseError("CREATE what?")
    p.take("IF", "NOT", "EXISTS")
    name = p.name()
    if p.op("("):  # column definitions are accepted; rows bring their own
        depth = 1
        while depth and p.peek().kind != "end":
            t = p.next().text
            depth += (t == "(") - (t == ")")
    return N.Create(name)


def _index(p: Parser, unique: bool) -> N.Index:
    name = p.name() if not p.word("ON") else ""
    p.expect("ON")
    table = p.name()
    p.expect("(")
    fields = []
    while not p.op(")"):
        fields.append(p.name())
        p.op(",")
    return N.Index(table, name or f"{table}_{'_'.join(fields)}", fields, unique)


def _alter(p: Parser) -> N.Alter:
    p.expect("TABLE")
    table = p.name()
    if p.take("ADD"):
        p.take("COLUMN")
        name = p.name()
        default = None
        while p.peek().kind == "name":
            if p.take("DEFAULT"):
                default = p.literal()
            else:
                p.next()  # the type
        return N.Alter(table, "add", name, default)
    if p.take("DROP"):
        p.take("COLUMN")
        return N.Alter(table, "drop", p.name())
    p.expect("RENAME")
    p.expect("TO")
    return N.Alter(table, "rename", p.name())
