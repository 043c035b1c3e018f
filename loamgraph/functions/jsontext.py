"""Strict JSON reading that keeps numbers as they are written and has no depth limit."""

from __future__ import annotations

import json
import re
from typing import Any


class Number(str):
    """A JSON number, as its text."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.eE+-]))|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}
_END = object()


def _deep(text: str) -> Any:
    """The same with an own stack, for texts nested too deeply for the library."""
    at, end = 0, len(text.rstrip(" \t\n\r"))

    def token() -> tuple[str, Any]:
        nonlocal at
        m = _TOKEN.match(text, at)
        if not m or at >= end:
            raise ValueError("incomplete JSON")
        at = m.end()
        if m[1]:
            return m[1], None
        return "v", json.loads(m[2]) if m[2] else Number(m[3]) if m[3] else _WORDS[m[4]]

    stack: list[tuple[Any, Any]] = []  # the open containers, each with the name it waits to fill
    value: Any = _END
    while True:
        kind, v = token()
        if kind in "{[":
            new: Any = {} if kind == "{" else []
            peek = _TOKEN.match(text, at)
            if peek and peek[1] == ("}" if kind == "{" else "]"):
                at, value = peek.end(), new
            else:
                stack.append((new, _name(token) if kind == "{" else None))
                continue
        elif kind == "v":
            value = v
        else:
            raise ValueError("unexpected " + kind)
        while stack:  # the value is complete: put it into what is open
            box, name = stack.pop()
            if isinstance(box, dict):
                box[name] = value
            else:
                box.append(value)
            kind, _ = token()
            if kind == ",":
                stack.append((box, _name(token) if isinstance(box, dict) else None))
                value = _END
                break
            if kind != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("unexpected " + kind)
            value = box
        if not stack:
            if at != end:
                raise ValueError("text after the JSON")
            return value


def _name(token: Any) -> str:
    kind, name = token()
    if kind != "v" or not isinstance(name, str) or isinstance(name, Number) or token()[0] != ":":
        raise ValueError("a name was expected")
    return name


def parse(text: str | None) -> tuple[bool, Any]:
    """(whether it is one complete JSON text, its value).  Of repeated names the last counts."""
    if text is None:
        return False, None
    try:
        return True, _DECODER.decode(text)
    except RecursionError:
        try:
            return True, _deep(text)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def dump(value: Any) -> str | None:
    """Text of a value: a string as it is, a number as written, null as None, the rest as JSON without blanks.  Half surrogates become question marks."""
    if value is None:
        return None
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    out: list[str] = []
    todo: list[Any] = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw) or isinstance(v, Number):
            out.append(v)
        elif isinstance(v, str):
            out.append(json.dumps(v, ensure_ascii=False))
        elif isinstance(v, dict):
            parts: list[Any] = [_Raw("{")]
            for i, (k, x) in enumerate(v.items()):
                parts += [_Raw(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), x]
            todo.extend(reversed([*parts, _Raw("}")]))
        elif isinstance(v, list):
            parts = [_Raw("[")]
            for i, x in enumerate(v):
                parts += ([_Raw(",")] if i else []) + [x]
            todo.extend(reversed([*parts, _Raw("]")]))
        else:
            out.append("null" if v is None else "true" if v else "false")
    return clean("".join(out))


def clean(text: str) -> str:
    """Text that UTF-8 can hold."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").replace("\ufffd", "?") if any("\ud800" <= c <= "\udfff" for c in text) else text


class _Raw(str):
    """Text that is put out unchanged."""
