"""Extensible data notation: reader and writer for query, rule and trace files.

Such files are small and read on the driver. Lists become ``List`` (a tuple), vectors Python
lists, maps dicts, sets frozensets, ``#inst`` datetimes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone


@dataclass(frozen=True, order=True)
class Keyword:
    name: str

    def __str__(self) -> str:
        return ":" + self.name


@dataclass(frozen=True, order=True)
class Symbol:
    name: str

    def __str__(self) -> str:
        return self.name


class List(tuple):
    """A parenthesised form, told apart from a vector."""


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: object


class EdnError(ValueError):
    """Text that is no EDN, with the place where reading stopped."""


_TOKEN = re.compile(
    r"""[\s,]*(?:(?P<comment>;[^\n]*)|(?P<open>\#\{|[(\[{])|(?P<close>[)\]}])|(?P<string>"(?:\\.|[^"\\])*")|(?P<discard>\#_)
    |(?P<tag>\#[A-Za-z][^\s,()\[\]{}"]*)|(?P<char>\\(?:newline|space|tab|return|u[0-9a-fA-F]{4}|.))|(?P<atom>[^\s,()\[\]{}";]+))""",
    re.VERBOSE | re.DOTALL,
)
_CLOSES = {"(": ")", "[": "]", "{": "}", "#{": "}"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_INT, _FLOAT, _RATIO = re.compile(r"[-+]?\d+N?$"), re.compile(r"[-+]?\d+(\.\d*)?([eE][-+]?\d+)?M?$"), re.compile(r"([-+]?\d+)/(\d+)$")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_DROP = object()


def _freeze(x: object) -> object:
    if isinstance(x, list):
        return List(_freeze(i) for i in x)
    if isinstance(x, dict):
        return frozenset((_freeze(k), _freeze(v)) for k, v in x.items())
    return x


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str) -> EdnError:
        return EdnError(f"{what} at line {self.text.count(chr(10), 0, self.at) + 1}")

    def token(self) -> re.Match | None:
        while True:
            m = _TOKEN.match(self.text, self.at)
            if not m:
                if self.text[self.at:].strip(" \t\r\n,\f"):
                    raise self.fail("unreadable text")
                return None
            self.at = m.end()
            if not m["comment"]:
                return m

    def value(self, m: re.Match | None = None) -> object:
        m = m or self.token()
        if m is None:
            raise self.fail("unexpected end")
        if m["close"]:
            raise self.fail(f"unexpected {m['close']}")
        if m["open"]:
            return self.collection(m["open"])
        if m["string"]:
            return _ESCAPE.sub(lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else _NAMED.get(e[1], e[1]), m["string"][1:-1])
        if m["discard"]:
            self.value()
            return _DROP
        if m["char"]:
            c = m["char"][1:]
            return _CHARS.get(c) or (chr(int(c[1:], 16)) if len(c) == 5 else c)
        if m["tag"]:
            inner = self.value()
            if m["tag"] == "#inst":
                when = datetime.fromisoformat(str(inner).replace("Z", "+00:00"))
                return when if when.tzinfo else when.replace(tzinfo=timezone.utc)
            return Tagged(m["tag"][1:], inner)
        return self.atom(m["atom"])

    def atom(self, t: str) -> object:
        if t in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[t]
        if t[0] == ":":
            if len(t) == 1:
                raise self.fail("empty keyword")
            return Keyword(t[1:])
        if _INT.match(t):
            return int(t.rstrip("N"))
        if _FLOAT.match(t):
            return float(t.rstrip("M"))
        if m := _RATIO.match(t):
            return int(m[1]) / int(m[2])
        return Symbol(t)

    def collection(self, mark: str) -> object:
        out = []
        while True:
            m = self.token()
            if m is None:
                raise self.fail(f"{mark} is not closed")
            if m["close"]:
                if m["close"] != _CLOSES[mark]:
                    raise self.fail(f"{mark} closed by {m['close']}")
                break
            x = self.value(m)
            if x is not _DROP:
                out.append(x)
        if mark == "(":
            return List(out)
        if mark == "[":
            return out
        if mark == "#{":
            return frozenset(_freeze(x) for x in out)
        if len(out) % 2:
            raise self.fail("a map needs pairs")
        return {_freeze(k): v for k, v in zip(out[::2], out[1::2], strict=True)}


def read_edn(text: str) -> object:
    """The first value of a text."""
    r = _Reader(text)
    while (x := r.value()) is _DROP:
        pass
    return x


def read_all(text: str) -> list[object]:
    """All values of a text."""
    r, out = _Reader(text), []
    while (m := r.token()) is not None:
        x = r.value(m)
        if x is not _DROP:
            out.append(x)
    return out


def write_edn(x: object) -> str:
    """Canonical text of a value: maps and sets in the order of their written members."""
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (Keyword, Symbol, int)):
        return str(x)
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(x, datetime):
        return f'#inst "{x.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")}"'
    if isinstance(x, List):
        return "(" + " ".join(map(write_edn, x)) + ")"
    if isinstance(x, (list, tuple)):
        return "[" + " ".join(map(write_edn, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(sorted(f"{write_edn(k)} {write_edn(v)}" for k, v in x.items())) + "}"
    if isinstance(x, (set, frozenset)):
        return "#{" + " ".join(sorted(map(write_edn, x))) + "}"
    if isinstance(x, Tagged):
        return f"#{x.tag} {write_edn(x.value)}"
    raise TypeError(f"no EDN for {type(x).__name__}")
