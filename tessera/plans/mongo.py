"""The Mongo shell subset."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from tessera.plans import nodes as N
from tessera.plans.lexer import ParseError
from tessera.plans.predicates import json_filter


def _calls(text: str) -> tuple[str, list[tuple[str, list]]]:
    m = re.match(r"\s*db\.([A-Za-z_][\w-]*)", text)
    if not m:
        raise ParseError("expected db.<collection>")
    at, calls = m.end(), []
    decoder = json.JSONDecoder()
    while at < len(text) and text[at:].strip(" \n\t;"):
        c = re.compile(r"\s*\.(\w+)\(\s*").match(text, at)
        if not c:
            raise ParseError(f"unexpected {text[at : at + 20]!r}")
        at, args = c.end(), []
        while not text[at : at + 1] == ")":
            try:
                value, at = decoder.raw_decode(text, at)
            except ValueError as e:
                raise ParseError(str(e)) from e
            args.append(value)
            at = re.compile(r"\s*,?\s*").match(text, at).end()
        at += 1
        calls.append((c[1], args))
    return m[1], calls


def field_changes(update: dict) -> dict[str, Any]:
    sets: dict[str, Any] = {}
    for op, values in update.items():
        if op == "$set":
            sets |= values
        elif op == "$inc":
            sets |= {k: N.Arithmetic(k, v) for k, v in values.items()}
        elif op == "$unset":
            sets |= dict.fromkeys(values)
        elif op.startswith("$"):
            raise ParseError(f"unknown update operator {op}")
        else:
            sets[op] = values
    return sets


def _bound(text: str, args: Sequence[Any]) -> str:
    """The text with $1, $2 ... outside of strings as the JSON of their arguments."""

    def value(m: re.Match) -> str:
        if m[1]:
            return m[1]
        if not 1 <= int(m[2]) <= len(args):
            raise ParseError(f"no argument for ${m[2]}")
        return json.dumps(args[int(m[2]) - 1])

    return re.sub(r'("(?:[^"\\]|\\.)*")|\$(\d+)', value, text, flags=re.S)


def parse_mongo(text: str, args: Sequence[Any] = ()) -> Any:
    text = _bound(text, args)
    name, calls = _calls(text)
    if not calls:
        raise ParseError("no method")
    (method, args), rest = calls[0], calls[1:]
    first = args[0] if args else {}
    if method in ("find", "findOne", "count", "countDocuments"):
        spec = dict(first)
        traverse = spec.pop("$traverse", None)
        f = N.Find(name, json_filter(spec), count=method.startswith("count"))
        if traverse:
            f.traverse = N.Traverse(str(traverse["from"]), int(traverse.get("depth", 1)), traverse.get("via"))
        if len(args) > 1 and args[1]:
            f.columns = [k for k, v in args[1].items() if v]
        if method == "findOne":
            f.limit = 1
        for m, a in rest:
            if m == "sort":
                f.order = [(k, v >= 0) for k, v in a[0].items()]
            elif m in ("limit", "skip"):
                setattr(f, m, int(a[0]))
            elif m == "count":
                f.count = True
            else:
                raise ParseError(f"unknown method {m}")
        return f
    if rest:
        raise ParseError(f"nothing follows {method}")
    if method == "distinct":
        return N.Find(name, json_filter(args[1]) if len(args) > 1 else None, distinct=first)
    if method in ("insert", "insertOne", "insertMany"):
        return N.Insert(name, first if isinstance(first, list) else [first])
    if method in ("update", "updateOne", "updateMany"):
        return N.Update(name, field_changes(args[1]), json_filter(first))
    if method in ("delete", "deleteOne", "deleteMany", "remove"):
        return N.Delete(name, json_filter(first))
    if method == "createIndex":
        return N.Index(name, f"{name}_{'_'.join(first)}", list(first), bool(args[1].get("unique")) if len(args) > 1 else False)
    if method == "dropIndex":
        return N.Index(name, first, [], drop=True)
    if method == "drop":
        return N.Drop(name)
    raise ParseError(f"unknown method {method}")
