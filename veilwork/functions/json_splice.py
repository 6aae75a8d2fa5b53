"""Where the block texts of a JSON message stand, and other texts put in their place.

For messages that are too large for Spark's JSON values.  The bytes are read token by token, with
a stack as deep as the nesting and nothing kept but places and the texts themselves; what is
not replaced stays byte for byte.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    rb"""[ \t\r\n]*+(?:
        (?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")
        |(?P<sign>[{}\[\]:,])
        |(?P<plain>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)
    )""",
    re.VERBOSE,
)
_BLANK = re.compile(rb"[ \t\r\n]*+")

# The parts of a message that hold texts: (part, key or None for an element, bracket) -> part.
_PARTS = {
    (None, None, b"{"): "message",
    ("message", "result", b"{"): "result",
    ("result", "_meta", b"{"): "meta",
    ("result", "content", b"["): "content",
    ("content", None, b"{"): "block",
    ("block", "resource", b"{"): "resource",
}


@dataclass
class _Open:
    """An object or a list whose end has not been read."""

    part: str | None
    is_object: bool
    start: int
    key: str | None = None
    members: dict = field(default_factory=dict)  # of an object of interest: key -> (start, end, value)
    elements: list = field(default_factory=list)


@dataclass
class Blocks:
    """The content of a message by position: kinds, texts, and the bytes where a text stands.

    ``dead`` are places of values whose key comes again in the same object: they do not count.
    """

    tool: str | None
    kinds: list[str | None]
    texts: list[str | None]
    starts: list[int]
    ends: list[int]
    dead: list[tuple[int, int]]


def _string(token: bytes) -> str:
    return json.loads(token) if b"\\" in token else token[1:-1].decode("utf-8", "replace")


def _read(line: bytes) -> tuple[object, list[tuple[int, int]]] | None:
    """(value of the whole line, dead places); None when it is no JSON."""
    at, open_, dead = 0, [], []
    value, want = None, "value"
    match = _TOKEN.match
    while True:
        token = match(line, at)
        if token is None:
            return None
        kind = token.lastgroup
        start, at = token.span(kind)
        top = open_[-1] if open_ else None
        if want in ("key", "key or end"):
            if kind == "string":
                # names matter only in the parts that hold texts
                top.key = _string(line[start:at]) if top.part else None
                want = "colon"
                continue
            if not (want == "key or end" and line[start:at] == b"}"):
                return None
        elif want == "colon":
            if line[start:at] != b":":
                return None
            want = "value"
            continue
        elif want == "comma or end" and line[start:at] == b",":
            want = "key" if top.is_object else "value"
            continue
        sign = line[start:at] if kind == "sign" else None
        if sign in (b"{", b"["):
            if want not in ("value", "value or end"):
                return None
            part = _PARTS.get((top.part if top else None, top.key if top and top.is_object else None, sign))
            if top is not None and top.part is None:
                part = None
            open_.append(_Open(part, sign == b"{", start))
            want = "key or end" if sign == b"{" else "value or end"
            continue
        if sign in (b"}", b"]"):
            if top is None or top.is_object != (sign == b"}") or want in ("value", "key"):
                return None
            open_.pop()
            start, value = top.start, top
        elif sign is not None or want not in ("value", "value or end"):
            return None
        else:
            value = (kind, start, at)
        # a value has ended
        if not open_:
            return (value, dead) if _BLANK.match(line, at).end() == len(line) else None
        top = open_[-1]
        if top.part and top.is_object:
            if top.key in top.members:
                dead.append(top.members[top.key][:2])
            top.members[top.key] = (start, at, value)
        elif top.part:
            top.elements.append(value)
        want = "comma or end"


def _member(part: object, key: str, kind: str) -> object | None:
    """The member of an object, if it is of a part or, with kind ``plain``, anything."""
    if not isinstance(part, _Open) or key not in part.members:
        return None
    value = part.members[key][2]
    return value if kind == "any" or (isinstance(value, _Open) and value.part == kind) else None


def find_blocks(line: bytes) -> Blocks | None:
    """None where ``result.content`` is no list, or the line no JSON."""
    read = _read(line)
    if read is None:
        return None
    message, dead = read
    result = _member(message, "result", "result")
    content = _member(result, "content", "content")
    if content is None:
        return None

    def scalar(value: object) -> str | None:
        """As text; null for null."""
        if value is None:
            return None
        if isinstance(value, _Open):
            return "{}" if value.is_object else "[]"
        kind, start, end = value
        token = line[start:end]
        return _string(token) if kind == "string" else None if token == b"null" else token.decode()

    found = Blocks(scalar(_member(_member(result, "_meta", "meta"), "tool_name", "any")), [], [], [], [], dead)
    for block in content.elements:
        kind = scalar(_member(block, "type", "any"))
        holder = block if kind == "text" else _member(block, "resource", "resource") if kind == "resource" else None
        text = _member(holder, "text", "any")
        is_text = isinstance(text, tuple) and text[0] == "string" and text[2] - text[1] > 2
        found.kinds.append(kind)
        found.texts.append(_string(line[text[1] : text[2]]) if is_text else None)
        found.starts.append(text[1] if is_text else 0)
        found.ends.append(text[2] if is_text else 0)
    return found


def with_texts(line: bytes, starts: list[int], ends: list[int], texts: list[str | None], dead: list[tuple[int, int]]) -> bytes:
    """The line with these texts (null: stays) at those places, and dead values as null."""
    new = [(s, e, json.dumps(t, ensure_ascii=False).encode("utf-8", "replace")) for s, e, t in zip(starts, ends, texts) if t is not None]
    out, at = [], 0
    for start, end, value in sorted([*new, *((s, e, b"null") for s, e in dead)]):
        if start >= at:
            out += [line[at:start], value]
            at = end
    return b"".join([*out, line[at:]])
