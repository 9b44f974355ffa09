"""What page markup can call inside {{...}}: arithmetic, text modules, and words that stand for the page or the time."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime

import regex

#: Seconds that a pattern written in a page may search for, and the longest text that `rep` makes.
PATIENCE, LONGEST = 2.0, 1_000_000

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([a-z]+)|(<=|>=|<>|!=|[-+*/^()=<>]))")


def _whole(x: float) -> float | int:
    return int(x) if math.isfinite(x) and x == int(x) and abs(x) < 2**53 else x


def _rounded(x: float, digits: float) -> float | int:
    """Halves go away from zero."""
    scale = 10.0 ** int(digits)
    return _whole(math.copysign(math.floor(abs(x) * scale + 0.5) / scale, x))


#: Operators of two sides: how tightly they bind, and what they give. All bind to the left.
_BINARY: dict[str, tuple[int, Callable]] = {
    "^": (8, lambda a, b: _whole(math.pow(a, b))),
    "*": (7, lambda a, b: a * b),
    "/": (7, lambda a, b: _whole(a / b)),
    "div": (7, lambda a, b: _whole(a / b)),
    "mod": (7, lambda a, b: int(math.fmod(int(a), int(b)))),
    "+": (6, lambda a, b: a + b),
    "-": (6, lambda a, b: a - b),
    "round": (5, _rounded),
    "=": (4, lambda a, b: int(a == b)),
    "<>": (4, lambda a, b: int(a != b)),
    "!=": (4, lambda a, b: int(a != b)),
    "<": (4, lambda a, b: int(a < b)),
    ">": (4, lambda a, b: int(a > b)),
    "<=": (4, lambda a, b: int(a <= b)),
    ">=": (4, lambda a, b: int(a >= b)),
    "and": (3, lambda a, b: int(bool(a) and bool(b))),
    "or": (2, lambda a, b: int(bool(a) or bool(b))),
}
_UNARY: dict[str, Callable] = {
    "-": lambda x: -x,
    "+": lambda x: x,
    "not": lambda x: int(not x),
    "abs": abs,
    "floor": math.floor,
    "ceil": math.ceil,
    "trunc": math.trunc,
    "sqrt": lambda x: _whole(math.sqrt(x)),
    "exp": math.exp,
    "ln": math.log,
    "sin": math.sin,
    "cos": math.cos,
    "tan": math.tan,
}
_NAMES = {"pi": math.pi, "e": math.e}


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.lower().rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(text)
        out.append(found[1] or found[2] or found[3])
        at = found.end()
    return out


def _value(tokens: list[str], at: int, tightness: int) -> tuple[float, int]:
    """The value of what begins at a token, as far as operators bind tighter than `tightness`, and where it ends."""
    token = tokens[at]
    if token == "(":
        left, at = _value(tokens, at + 1, 0)
        if tokens[at] != ")":
            raise ValueError(token)
        at += 1
    elif token in _UNARY:
        left, at = _value(tokens, at + 1, 8 if token in "+-" else 9)
        left = _UNARY[token](left)
    elif token in _NAMES:
        left, at = _NAMES[token], at + 1
    else:
        left, at = float(token) if "." in token else int(token), at + 1
    while at < len(tokens) and tokens[at] in _BINARY and _BINARY[tokens[at]][0] > tightness:
        binds, f = _BINARY[tokens[at]]
        right, at = _value(tokens, at + 1, binds)
        left = f(left, right)
    return left, at


def expression(text: str) -> str:
    """The value of arithmetic, as pages define it: truth is 1 or 0, whole numbers have no point, others 14 digits. Nothing
    but these operators is known: no code runs. Blank text stays blank; what has no value comes back marked as an error."""
    if not text.strip():
        return ""
    try:
        tokens = _tokens(text)
        value, at = _value(tokens, 0, 0)
        if at < len(tokens) or not math.isfinite(value):
            raise ValueError(text)
        value = _whole(float(f"{value:.14g}")) if isinstance(value, float) else value
        return str(value) if isinstance(value, int) else f"{value:.14g}"
    except (ValueError, IndexError, ArithmeticError, RecursionError):
        return f'<span class="error">{text.strip()}</span>'


def _named(given: dict[str, str], *names: str) -> list[str]:
    """Values by name; what has no name fills the other names in order."""
    unnamed = iter([given[str(i)] for i in range(1, len(given) + 1) if str(i) in given])
    return [given[n] if n in given else next(unnamed, "") for n in names]


def _number(text: str, default: int) -> int:
    return int(text) if text.strip() else default


def _plain(text: str) -> bool:
    return text.strip().lower() not in ("0", "false", "no")


def _sub(given: dict[str, str]) -> str:
    s, i, j = _named(given, "s", "i", "j")
    a, b = _number(i, 1), _number(j, -1)
    return s[max(0, a - 1 if a > 0 else len(s) + a) : max(0, b if b >= 0 else len(s) + b + 1)]


def _sublength(given: dict[str, str]) -> str:
    s, i, n = _named(given, "s", "i", "len")
    a = _number(i, 1) - 1
    return s[a : a + _number(n, 1)]


def _pos(given: dict[str, str]) -> str:
    s, p = _named(given, "target", "pos")
    at = _number(p, 1)
    return s[at - 1 if at > 0 else at]


def _find(given: dict[str, str]) -> str:
    s, wanted, start, plain = _named(given, "source", "target", "start", "plain")
    if not s or not wanted:
        return "0"
    at = max(0, _number(start, 1) - 1)
    if _plain(plain):
        return str(s.find(wanted, at) + 1)
    found = regex.search(wanted, s, pos=at, timeout=PATIENCE)
    return str(found.start() + 1 if found else 0)


def _replace(given: dict[str, str]) -> str:
    s, wanted, other, count, plain = _named(given, "source", "pattern", "replace", "count", "plain")
    n = _number(count, 0)
    if _plain(plain):
        return s.replace(wanted, other, n or -1)
    return regex.sub(wanted, other, s, count=n, timeout=PATIENCE)


def _rep(given: dict[str, str]) -> str:
    s, n = _named(given, "source", "count")
    count = _number(n, 1)
    return s * count if len(s) * count <= LONGEST else ""


def _roman(given: dict[str, str]) -> str:
    n = int(float(given["1"]))
    return given.get("2", "N/A") if not 0 <= n < 5000 else roman(n) if n else ""


def roman(n: int) -> str:
    """Roman numerals of 1 to 4999; other numbers stay."""
    if not 0 < n < 5000:
        return str(n)
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


#: Text modules by module and function; each takes its arguments by name or number. Places count from 1.
MODULES: dict[tuple[str, str], Callable[[dict[str, str]], str]] = {
    ("String", "len"): lambda g: str(len(_named(g, "s")[0])),
    ("String", "sub"): _sub,
    ("String", "sublength"): _sublength,
    ("String", "pos"): _pos,
    ("String", "find"): _find,
    ("String", "replace"): _replace,
    ("String", "rep"): _rep,
    ("If empty", "main"): lambda g: next((g[str(i)] for i in range(1, len(g) + 1) if g.get(str(i))), ""),
    ("convert", "convert"): lambda g: f"{g['1']} {g['2']}",
    ("Roman", "main"): _roman,
    ("Numero romano", "main"): _roman,
}


def invoke(module: str, function: str, given: dict[str, str]) -> str:
    """What a text module gives; an unknown one, wrong arguments and patterns that take too long give an empty text."""
    f = MODULES.get((module.strip(), function.strip()))
    try:
        return f(given) if f else ""
    except (ValueError, KeyError, IndexError, OverflowError, TimeoutError, regex.error):
        return ""


def page_words(title: str, namespaces: dict[str, str], now: datetime) -> dict[str, str]:
    """The words that stand for a page's title and the time. namespaces: their numbers by name."""
    space, colon, name = title.partition(":")
    if not (colon and space in namespaces):
        space, name = "", title
    base, slash, sub = name.rpartition("/")
    return {
        "!": "|",
        "NAMESPACE": space,
        "NAMESPACENUMBER": namespaces.get(space, "0"),
        "PAGENAME": name,
        "FULLPAGENAME": title,
        "BASEPAGENAME": base if slash else name,
        "SUBPAGENAME": sub if slash else "",
        "ROOTPAGENAME": name.partition("/")[0],
        "CURRENTYEAR": f"{now:%Y}",
        "CURRENTMONTH": f"{now:%m}",
        "CURRENTDAY": f"{now:%d}",
        "CURRENTHOUR": f"{now:%H}",
        "CURRENTTIME": f"{now:%H:%M:%S}",
    }
