"""Parser functions, modules and arithmetic of templates; plain Python, run inside Arrow UDFs."""

from __future__ import annotations

import math
import re
import urllib.parse
from collections.abc import Callable

ERROR = '<span class="error">'
Branch = Callable[[], str]


class ExprError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(<>|!=|>=|<=|\*\*|[-+*/^()<>=])|([A-Za-z]+))")
_UNARY = {
    "not": lambda x: float(not x), "abs": abs, "trunc": math.trunc, "floor": math.floor, "ceil": math.ceil,
    "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "exp": math.exp,
}


def _tokens(text: str) -> list:
    out, i = [], 0
    text = text.strip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m or m.end() == i:
            raise ExprError(text[i:])
        num, op, word = m.groups()
        out.append(float(num) if num else (op or word.lower()))
        i = m.end()
    return out


class _Parser:
    """Precedence climbing; binary operators from loosest to tightest."""

    LEVELS = (("or",), ("and",), ("=", "<>", "!=", "<", ">", "<=", ">="), ("round",), ("+", "-"), ("*", "/", "div", "mod"), ("^", "**"))

    def __init__(self, tokens: list):
        self.t, self.i = tokens, 0

    def peek(self):
        return self.t[self.i] if self.i < len(self.t) else None

    def take(self):
        x = self.peek()
        self.i += 1
        return x

    def level(self, k: int) -> float:
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while isinstance(self.peek(), str) and self.peek() in self.LEVELS[k]:
            left = self.apply(self.take(), left, self.level(k + 1))
        return left

    def unary(self) -> float:
        x = self.take()
        if isinstance(x, float):
            return x
        if x == "-":
            return -self.unary()
        if x == "+":
            return self.unary()
        if x == "(":
            v = self.level(0)
            if self.take() != ")":
                raise ExprError(")")
            return v
        if x == "pi":
            return math.pi
        if x == "e":
            return math.e
        if x in _UNARY:
            return float(_UNARY[x](self.unary()))
        raise ExprError(str(x))

    @staticmethod
    def apply(op: str, a: float, b: float) -> float:
        if op in ("/", "div", "mod") and b == 0:
            raise ExprError("division by zero")
        if op in ("^", "**") and (abs(a) > 1e6 or abs(b) > 1e3):
            raise ExprError("too large")
        table = {
            "or": lambda: float(bool(a) or bool(b)), "and": lambda: float(bool(a) and bool(b)), "=": lambda: float(a == b),
            "<>": lambda: float(a != b), "!=": lambda: float(a != b), "<": lambda: float(a < b), ">": lambda: float(a > b),
            "<=": lambda: float(a <= b), ">=": lambda: float(a >= b), "round": lambda: round(a, int(b)), "+": lambda: a + b,
            "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "div": lambda: a / b, "mod": lambda: math.fmod(int(a), int(b)),
            "^": lambda: a**b, "**": lambda: a**b,
        }
        return table[op]()


def expr(text: str) -> str:
    """Value of an arithmetic expression; an error span if it cannot be read.  Nothing is ever evaluated as code."""
    try:
        toks = _tokens(text)
        if not toks:
            return ""
        p = _Parser(toks)
        v = p.level(0)
        if p.peek() is not None or isinstance(v, complex):
            raise ExprError(str(p.peek()))
        if math.isinf(v) or math.isnan(v):
            raise ExprError("no number")
    except (ExprError, ValueError, OverflowError, TypeError, RecursionError):
        return f"{ERROR}Expression error: {text.strip()}</span>"
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 12))


def _split_case(part: str) -> tuple[str, str | None]:
    """Key and value of a switch branch; the value is None for a bare key."""
    depth = 0
    for i, ch in enumerate(part):
        if ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == "=" and depth <= 0:
            return part[:i].strip(), part[i + 1 :].strip()
    return part.strip(), None


def switch(value: str, branches: list[Branch]) -> str:
    """First matching branch; bare keys fall through to the next value.

    ``#default`` or a last bare value is taken when nothing matches.
    """
    value, hit, default, last = value.strip(), False, None, None
    default_open = False
    for b in branches:
        key, val = _split_case(b())
        if val is None:
            last = key
            hit = hit or key == value
            default_open = default_open or key == "#default"
            continue
        last = None
        if hit or key == value:
            return val
        if key == "#default" or default_open:
            default, default_open = val, False
    return (last if last is not None else default) or ""


def call(name: str, first: str, branches: list[Branch]) -> str | None:
    """Result of parser function ``name``, None if there is no such function.  Branches are expanded only if taken.

    Any failure gives ''.
    """
    f = FUNCTIONS.get(name)
    if f is None:
        return None
    try:
        return f(first, branches)
    except Exception:  # noqa: BLE001 - dump content must not stop a page
        return ""


def _at(branches: list[Branch], i: int) -> str:
    return branches[i]().strip() if i < len(branches) else ""


def _ifeq(first: str, b: list[Branch]) -> str:
    return _at(b, 1) if first.strip() == _at(b, 0) else _at(b, 2)


def _iferror(first: str, b: list[Branch]) -> str:
    if re.search(r"""class=["']?error\b""", first):
        return _at(b, 0)
    return _at(b, 1) if len(b) > 1 else first.strip()


#: Functions that always give ''.
EMPTY = ("#ifexpr", "#rel2abs", "#language", "#time", "#timel", "#titleparts")

FUNCTIONS: dict[str, Callable[[str, list[Branch]], str]] = {
    "#expr": lambda a, b: expr(a),
    "#if": lambda a, b: _at(b, 0) if a.strip() else _at(b, 1),
    "#ifeq": _ifeq,
    "#iferror": _iferror,
    "#ifexist": lambda a, b: _at(b, 1),
    "#switch": switch,
    **{n: (lambda a, b: "") for n in EMPTY},
    "urlencode": lambda a, b: urllib.parse.quote(a.strip()),
    "lc": lambda a, b: a.strip().lower(),
    "uc": lambda a, b: a.strip().upper(),
    "lcfirst": lambda a, b: a.strip()[:1].lower() + a.strip()[1:],
    "ucfirst": lambda a, b: a.strip()[:1].upper() + a.strip()[1:],
    "int": lambda a, b: str(int(a.strip())),
}


def roman(n: int) -> str:
    """Roman numeral of 0..4999 by the subtractive rule; 0 gives ''."""
    out = []
    for place, (one, five, ten) in zip((1000, 100, 10, 1), (("M", "M", "M"), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))):
        d, n = divmod(n, place)
        if place == 1000:
            out.append(one * d)
        elif d == 9:
            out.append(one + ten)
        elif d == 4:
            out.append(one + five)
        else:
            out.append(five * (d >= 5) + one * (d % 5))
    return "".join(out)


def _roman(p: dict) -> str:
    n = int(float(p.get("1", "")))
    return roman(n) if 0 <= n < 5000 else p.get("2", "N/A")


def _text(p: dict) -> str:
    return p.get("s", p.get("source", p.get("1", "")))


def _sub(p: dict) -> str:
    """Characters i to j of s, counted from one; negative places count from the end."""
    s, n = _text(p), len(_text(p))
    i, j = int(p.get("i", p.get("2", 1)) or 1), int(p.get("j", p.get("3", -1)) or -1)
    i, j = (i if i > 0 else n + i + 1), (j if j > 0 else n + j + 1)
    return s[max(i, 1) - 1 : j] if i <= j else ""


def _find(p: dict) -> str:
    s = p.get("source", p.get("1", ""))
    t = p.get("target", p.get("2", ""))
    start = max(int(p.get("start", p.get("3", 1)) or 1), 1) - 1
    if str(p.get("plain", p.get("4", "true"))).lower() in ("false", "no", "0"):
        m = re.compile(t).search(s, start)
        return str(m.start() + 1 if m else 0)
    return str(s.find(t, start) + 1)


def _pos(p: dict) -> str:
    s = p.get("target", p.get("1", ""))
    i = int(p.get("pos", p.get("2", 1)))
    return s[i - 1 if i > 0 else i] if s and 0 < abs(i) <= len(s) else ""


def _replace(p: dict) -> str:
    s, a, b = p.get("source", p.get("1", "")), p.get("pattern", p.get("2", "")), p.get("replace", p.get("3", ""))
    n = int(p.get("count", p.get("4", -1)) or -1)
    if str(p.get("plain", p.get("5", "true"))).lower() in ("false", "no", "0"):
        return re.sub(a, b, s, count=max(n, 0))
    return s.replace(a, b, n)


MODULES: dict[str, dict[str, Callable[[dict], str]]] = {
    "convert": {"convert": lambda p: f"{p.get('1', '')} {p.get('2', '')}"},
    "If empty": {"main": lambda p: next((p[k] for k in sorted(p, key=lambda k: (len(k), k)) if k.isdigit() and p[k]), "")},
    "String": {
        "len": lambda p: str(len(_text(p))),
        "sub": _sub,
        "sublength": lambda p: _text(p)[int(p.get("i", 0) or 0) : int(p.get("i", 0) or 0) + int(p.get("len", len(_text(p))))],
        "pos": _pos,
        "find": _find,
        "replace": _replace,
        "rep": lambda p: p.get("source", p.get("s", p.get("1", ""))) * int(p.get("count", p.get("2", 1))),
    },
    "Roman": {"main": _roman},
    "Numero romano": {"main": _roman},
}


def invoke(module: str, function: str, params: dict[str, str]) -> str:
    """Result of a module function; '' if it is unknown or fails.  The first letter of a module's name may be of either case."""
    name = module.strip()
    known = MODULES.get(name) or MODULES.get(name[:1].upper() + name[1:]) or MODULES.get(name[:1].lower() + name[1:])
    try:
        return known[function.strip()](params)
    except Exception:  # noqa: BLE001
        return ""
