"""JSON, read strictly: what a lenient reader lets pass silently is an error here, with its place.

Errors: a key twice in one object (canonically equal ones too), numbers outside the grammar, lone
surrogates, control characters in strings, invalid UTF-8, nesting over DEPTH, anything after the end.
Numbers keep their spelling (class Number).
"""

from __future__ import annotations

import json
import re
import unicodedata

DEPTH = 256
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.A)
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class Number(str):
    """A number as it was written."""


class StrictError(ValueError):
    def __init__(self, message: str, text: str, at: int):
        self.line, self.column = text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)
        super().__init__(f"{message} at line {self.line}, column {self.column}")


def loads(data: bytes | str):
    if isinstance(data, bytes):
        try:
            data = data.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise ValueError(f"invalid UTF-8 at byte {e.start}") from None
    value, at = _value(data, _skip(data, 0), 0)
    if _skip(data, at) != len(data):
        raise StrictError("text after the end", data, at)
    return value


def _skip(s: str, at: int) -> int:
    return _BLANK.match(s, at).end()


def _value(s: str, at: int, depth: int):
    if depth > DEPTH:
        raise StrictError("nested too deep", s, at)
    c = s[at : at + 1]
    if c == '"':
        return _string(s, at + 1)
    if c == "{":
        return _object(s, at + 1, depth)
    if c == "[":
        out, at = [], _skip(s, at + 1)
        if s[at : at + 1] == "]":
            return out, at + 1
        while True:
            item, at = _value(s, _skip(s, at), depth + 1)
            out.append(item)
            at = _skip(s, at)
            if s[at : at + 1] == "]":
                return out, at + 1
            at = _expect(s, at, ",")
    for word, value in (("true", True), ("false", False), ("null", None)):
        if s.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(s, at)
    if not m or (m.end() < len(s) and s[m.end()] not in " \t\r\n,]}"):
        raise StrictError("no value", s, at)
    return Number(m[0]), m.end()


def _expect(s: str, at: int, c: str) -> int:
    if s[at : at + 1] != c:
        raise StrictError(f"expected {c!r}", s, at)
    return at + 1


def _object(s: str, at: int, depth: int):
    out, seen = {}, set()
    at = _skip(s, at)
    if s[at : at + 1] == "}":
        return out, at + 1
    while True:
        at = _skip(s, at)
        begin = at
        key, at = _string(s, _expect(s, at, '"'))
        canonical = unicodedata.normalize("NFC", key)
        if canonical in seen:
            raise StrictError(f"the key {key!r} twice", s, begin)
        seen.add(canonical)
        at = _expect(s, _skip(s, at), ":")
        out[key], at = _value(s, _skip(s, at), depth + 1)
        at = _skip(s, at)
        if s[at : at + 1] == "}":
            return out, at + 1
        at = _expect(s, at, ",")


def _string(s: str, at: int):
    parts = []
    while True:
        m = _PLAIN.match(s, at)
        parts.append(m[0])
        at = m.end()
        c = s[at : at + 1]
        if c == '"':
            text = "".join(parts)
            if any("\ud800" <= x <= "\udfff" for x in text):
                text = _pair(text, s, at)
            return text, at + 1
        if c != "\\":
            raise StrictError("a control character in a string" if c else "a string without an end", s, at)
        e = s[at + 1 : at + 2]
        if e == "u":
            code = s[at + 2 : at + 6]
            if not re.fullmatch(r"[0-9a-fA-F]{4}", code):
                raise StrictError("a bad escape", s, at)
            parts.append(chr(int(code, 16)))
            at += 6
        elif e in _ESCAPES and e:
            parts.append(_ESCAPES[e])
            at += 2
        else:
            raise StrictError("a bad escape", s, at)


def _pair(text: str, s: str, at: int) -> str:
    try:
        return text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        raise StrictError("a lone surrogate", s, at) from None


def dumps(value, style: str = "editor", depth: int = 0) -> str:
    """editor: two blanks, ' : ', escaped slashes, keys in code-point order, an empty object over two lines; plain: two blanks; compact."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        text = json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
        return text.replace("/", "\\/") if style == "editor" else text
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return json.dumps(value)
    opened, closed = ("{", "}") if isinstance(value, dict) else ("[", "]")
    colon = {"editor": " : ", "plain": ": ", "compact": ":"}[style]
    if isinstance(value, dict):
        items = [f"{dumps(k, style)}{colon}{dumps(v, style, depth + 1)}" for k, v in (sorted(value.items()) if style != "raw" else value.items())]
    else:
        items = [dumps(v, style, depth + 1) for v in value]
    if style == "compact":
        return opened + ",".join(items) + closed
    if not items:
        return f"{opened}\n\n{'  ' * depth}{closed}" if style == "editor" else opened + closed
    inner = ",\n".join("  " * (depth + 1) + x for x in items)
    return f"{opened}\n{inner}\n{'  ' * depth}{closed}"
