"""Well-known text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

from terrafold.functions.wkb import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, NAMES, POINT, POLYGON, SUFFIX, WIDTH, Geometry

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TOKEN = re.compile(rf"\s*([A-Za-z]+|{NUMBER}|[(),])")
_NUMBER = re.compile(NUMBER)
_KINDS = {name.upper(): kind for kind, name in NAMES.items()}


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"WKT is not valid at {at}: {text[at : at + 20]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0
        self.dims: int | None = None

    def peek(self) -> str:
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else ""

    def next(self) -> str:
        t = self.peek()
        if not t:
            raise ValueError("WKT ends early")
        self.at += 1
        return t

    def need(self, t: str) -> None:
        got = self.next()
        if got != t:
            raise ValueError(f"WKT has {got!r} where {t!r} is needed")

    def coord(self) -> list[float]:
        out = []
        while self.peek() not in (",", ")", ""):
            t = self.next()
            try:
                out.append(float(t) if t != "NAN" else math.nan)
            except ValueError:
                raise ValueError(f"WKT has {t!r} where a number is needed") from None
        if not 2 <= len(out) <= 4:
            raise ValueError(f"WKT has a coordinate of {len(out)} numbers")
        if self.dims is None:
            self.dims = {2: 0, 3: 1, 4: 3}[len(out)]
        if len(out) != WIDTH[self.dims]:
            raise ValueError("WKT mixes dimensions")
        return out

    def many(self, item) -> list:
        if self.peek() == "EMPTY":
            self.next()
            return []
        self.need("(")
        out = [item()]
        while self.peek() == ",":
            self.next()
            out.append(item())
        self.need(")")
        return out

    def multi_point(self) -> list:
        if self.peek() == "EMPTY":
            self.next()
            return []
        if self.peek() == "(":
            return self.many(self.coord)
        return [self.coord()]

    def geometry(self) -> Geometry:
        word = self.next()
        kind, dims = None, None
        for suffix, code in (("ZM", 3), ("Z", 1), ("M", 2), ("", None)):
            if word.endswith(suffix) and word[: len(word) - len(suffix)] in _KINDS:
                kind, dims = _KINDS[word[: len(word) - len(suffix)]], code
                break
        if kind is None:
            raise ValueError(f"WKT type {word!r} is not supported")
        if dims is None and self.peek() in ("Z", "M", "ZM"):
            dims = {"Z": 1, "M": 2, "ZM": 3}[self.next()]
        outer = self.dims
        self.dims = dims
        if kind == COLLECTION:
            parts = self.many(self.geometry)
            dims = dims if dims is not None else parts[0][1] if parts else 0
            self.dims = outer
            return (kind, dims, parts)
        line = lambda: self.many(self.coord)
        body = {POINT: line, LINE: line, POLYGON: lambda: self.many(line), MULTIPOINT: lambda: self.many(self.multi_point), MULTILINE: lambda: self.many(line), MULTIPOLYGON: lambda: self.many(lambda: self.many(line))}[kind]()
        dims = self.dims or 0
        self.dims = outer
        arr = lambda c: np.array(c, dtype=np.float64).reshape(-1, WIDTH[dims])
        if kind == POINT and len(body) > 1:
            raise ValueError("a WKT point has one coordinate")
        if kind in (POINT, LINE):
            return (kind, dims, arr(body))
        if kind == POLYGON:
            return (kind, dims, [arr(r) for r in body])
        if kind == MULTIPOLYGON:
            return (kind, dims, [(POLYGON, dims, [arr(r) for r in p]) for p in body])
        return (kind, dims, [(POINT if kind == MULTIPOINT else LINE, dims, arr(p)) for p in body])


def parse(text: str) -> Geometry:
    """The geometry of a text; raises ValueError if it isn't valid."""
    r = _Reader(text)
    g = r.geometry()
    if r.at != len(r.tokens):
        raise ValueError("text after the WKT's end")
    return g


def number(x: float) -> str:
    """Shortest decimal that reads back as x, without exponent or a trailing .0."""
    if x != x or x in (math.inf, -math.inf):
        return "NaN" if x != x else "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    text = repr(float(x))
    return np.format_float_positional(x, trim="-") if "e" in text else text


def numbers(values: np.ndarray) -> np.ndarray:
    """number() of an array's values, once for each distinct one."""
    found, at = np.unique(np.ascontiguousarray(values, dtype=np.float64).view(np.int64), return_inverse=True)
    return np.array([number(x) for x in found.view(np.float64).tolist()], dtype=object)[at].reshape(values.shape)


def floats(texts: list[str]) -> np.ndarray:
    """All numbers of some texts, in order."""
    return np.array(list(map(float, _NUMBER.findall("\n".join(texts)))), dtype=np.float64)


def format(g: Geometry, number: Callable[[float], str] = number) -> str:  # noqa: A001
    kind, dims, data = g
    name = NAMES[kind].upper() + (f" {SUFFIX[dims]}" if dims else "")
    return name + _body(kind, data, number, top=True)


def _body(kind: int, data, number: Callable[[float], str], top: bool = False) -> str:
    gap = " " if top else ""
    run = lambda c: "(" + ",".join(" ".join(map(number, p)) for p in c.tolist()) + ")"
    if not len(data):
        return gap + "EMPTY"
    if kind in (POINT, LINE):
        return run(data)
    if kind == POLYGON:
        return "(" + ",".join(run(r) if len(r) else "EMPTY" for r in data) + ")"
    if kind == MULTIPOINT:
        return "(" + ",".join(run(p[2])[1:-1] if len(p[2]) else "EMPTY" for p in data) + ")"
    if kind == COLLECTION:
        return "(" + ",".join(format(p, number) for p in data) + ")"
    return "(" + ",".join(_body(p[0], p[2], number) for p in data) + ")"
