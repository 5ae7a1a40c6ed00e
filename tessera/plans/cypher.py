"""The openCypher subset: MATCH of one node or one relationship, and CREATE."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from tessera.plans import nodes as N
from tessera.plans.lexer import ParseError, Parser
from tessera.plans.sql import vector


def _node(p: Parser) -> tuple[str, str | None, dict]:
    p.expect("(")
    var = p.name() if p.peek().kind == "name" else ""
    label = p.name() if p.op(":") else None
    props = p.literal() if p.peek().text == "{" else {}
    p.expect(")")
    return var, label, props


def _relation(p: Parser) -> tuple[str | None, int, float, bool]:
    """(relation, depth, weight, incoming) of -[:R*1..3 {weight: w}]-> and its mirror."""
    incoming = p.op("<")
    p.expect("-")
    relation, depth, weight = None, 1, 1.0
    if p.op("["):
        if p.peek().kind == "name":
            p.name()
        if p.op(":"):
            relation = p.name()
        if p.op("*"):
            t = p.peek()
            low = p.integer() if t.kind == "number" and t.text.isdigit() else 1
            depth = low
            if p.op("."):
                p.expect(".")
                depth = p.integer()
        if p.peek().text == "{":
            weight = float(p.literal().get("weight", 1.0))
        p.expect("]")
    p.expect("-")
    p.op(">")
    return relation, depth, weight, incoming


def parse_cypher(text: str, args: Sequence[Any] = ()) -> Any:
    import re

    # Hop ranges: the dots would read as part of a number.
    text = re.sub(r"\*\s*(\d+)\s*\.\.\s*(\d+)", r"*\1 . . \2", text)
    p = Parser(text, args)
    out = _create(p) if p.take("CREATE") else _match(p)
    p.end()
    return out


def _create(p: Parser) -> Any:
    var, label, props = _node(p)
    if p.peek().text in ("-", "<"):
        relation, _, weight, incoming = _relation(p)
        other = _node(p)
        ids = [str(x[2].get("id", x[2].get("_id", x[0]))) for x in ((var, label, props), other)]
        a, b = ids[::-1] if incoming else ids
        return N.EdgeChange(a, b, relation or "RELATED", weight)
    if not label:
        raise ParseError("a node needs a label")
    return N.Insert(label, [props])


def _unqualify(where: Any, var: str) -> Any:
    if isinstance(where, (N.All, N.AnyOf)):
        return type(where)(tuple(_unqualify(x, var) for x in where.parts))
    if isinstance(where, N.Not):
        return N.Not(_unqualify(where.part, var))
    if isinstance(where, N.Leaf) and var and where.name.startswith(f"{var}."):
        return N.Leaf(where.op, where.name[len(var) + 1 :], where.value)
    return where


def _match(p: Parser) -> Any:
    p.expect("MATCH")
    first = _node(p)
    edge, second = None, None
    if p.peek().text in ("-", "<"):
        edge = _relation(p)
        second = _node(p)
    where = near = None
    order: list[tuple[str, bool]] = []
    limit, skip, returned, deleted, count = None, 0, [], [], False
    while p.peek().kind != "end" and p.peek().text != ";":
        if p.take("WHERE"):
            where = p.predicate()
        elif p.take("VECTOR"):
            near = vector(p)
        elif p.take("ORDER", "BY"):
            while True:
                name = p.name()
                down = p.take("DESC")
                if not down:
                    p.take("ASC")
                order.append((name, not down))
                if not p.op(","):
                    break
        elif p.take("SKIP"):
            skip = p.integer()
        elif p.take("LIMIT"):
            limit = p.integer()
        elif p.take("RETURN"):
            while True:
                if p.word("COUNT") and p.peek(1).text == "(":
                    count = True
                    while not p.op(")"):
                        p.next()
                else:
                    returned.append(p.name())
                if not p.op(","):
                    break
        elif p.take("DETACH", "DELETE") or p.take("DELETE"):
            deleted.append(p.name())
        else:
            raise ParseError(f"unexpected {p.peek().text!r} at {p.peek().at}")
    start = None
    source, target = first, second or first
    if second is not None:
        wanted = [x.split(".")[0] for x in returned + deleted]
        if first[0] and first[0] in wanted and second[0] not in wanted:
            source, target = second, first
        for leaf in where.parts if isinstance(where, N.All) else (where,):
            if isinstance(leaf, N.Leaf) and leaf.op == "eq" and leaf.name in (f"{source[0]}.id", f"{source[0]}._id"):
                start = str(leaf.value)
                rest = tuple(x for x in (where.parts if isinstance(where, N.All) else (where,)) if x is not leaf)
                where = N.All(rest) if rest else None
                break
        start = start or (str(i) if (i := source[2].get("id", source[2].get("_id"))) is not None else None)
    collection = target[1] or source[1]
    if not collection:
        raise ParseError("a label must name the collection")
    filters = [N.Leaf("eq", k, v) for k, v in target[2].items()]
    if where is not None:
        filters.append(_unqualify(where, target[0]))
    condition = N.All(tuple(filters)) if filters else None
    if deleted:
        return N.Delete(collection, condition)
    f = N.Find(collection, condition, near=near, limit=limit, skip=skip, count=count)
    f.order = [(x.split(".", 1)[1] if x.startswith(f"{target[0]}.") else x, up) for x, up in order]
    fields = [x.split(".", 1)[1] for x in returned if x.startswith(f"{target[0]}.")]
    f.columns = fields or None
    if edge is not None:
        if start is None:
            raise ParseError("a traversal needs a start id")
        # Arrows run from the first node to the second unless turned; the start may stand at either end.
        forward = (source is first) != edge[3]
        f.traverse = N.Traverse(start, edge[1], edge[0], "out" if forward else "in")
    return f
