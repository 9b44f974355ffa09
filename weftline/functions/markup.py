"""Page markup: flat patterns as columns; nested ones in Arrow batches."""

from __future__ import annotations

import copy
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .calls import expression, invoke, roman

#: Elements whose content goes with them, and elements of which the content stays.
DISCARDED = ("gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup", "indicator")
IGNORED = ("abbr", "b", "big", "blockquote", "center", "cite", "em", "font", "h1", "h2", "h3", "h4", "hiero", "i", "kbd", "nowiki", "p", "plaintext", "s", "span", "strike", "strong", "tt", "u", "var")
#: Deepest nesting that is followed.
DEEPEST = 30
_PARAMETER = re.compile(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}")
_REDIRECT = re.compile(r"(?i)\s*#redirect\w*\s*:?\s*\[\[(?:[^\[\]|:]*:)?([^\[\]|#]+)")
_NESTED = (("[[", "]]"), ("{{", "}}"))
_BAR, _EQUALS = re.compile(r"\|"), re.compile("=")
_BLANKS = re.compile(r"[ _]+")


@lru_cache(maxsize=64)
def _delimiters(pairs: tuple[tuple[str, str], ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(d) for p in pairs for d in p))


def balanced(text: str, pairs: tuple[tuple[str, str], ...] = (("[[", "]]"),)) -> list[tuple[int, int]]:
    """The outermost spans between paired delimiters; nested ones are inside them, what is never closed isn't one."""
    close = dict(pairs)
    if not any(opened in text for opened in close):
        return []
    stack: list[tuple[str, int]] = []
    out = []
    for m in _delimiters(pairs).finditer(text):
        if m[0] in close and not (stack and stack[-1][0] == m[0]):
            stack.append((close[m[0]], m.start()))
        elif stack and stack[-1][0] == m[0]:
            _, start = stack.pop()
            if not stack:
                out.append((start, m.end()))
    return out


def drop_nested(text: str, opened: str = "{{", closed: str = "}}") -> str:
    """Text without what balanced delimiters enclose; an opening one that is never closed stays."""
    out, at = [], 0
    for a, b in balanced(text, ((opened, closed),)):
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def flat(c: Column) -> Column:
    """Comments, magic words, bold and italic quotes, external links and discarded elements that aren't nested go; JVM only."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, "__[A-Z]+__", "")
    c = F.regexp_replace(c, "'{2,5}", "")
    return external_links(c)


def external_links(c: Column) -> Column:
    """[url text] becomes text; [url] goes."""
    return F.regexp_replace(F.regexp_replace(c, "\\[(?:https?|ftp)://[^\\s\\]]+\\s+([^\\]]*)\\]", "$1"), "\\[(?:https?|ftp)://[^\\s\\]]+\\]", "")


def without_elements(c: Column, *names: str) -> Column:
    """Elements that aren't nested go with their content."""
    for n in names:
        c = F.regexp_replace(c, f"(?is)<{n}\\b[^>]*>.*?</{n}\\s*>", "")
    return c


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def page_text(c: Column) -> Column:
    """Plain text of an HTML page: scripts, styles, navigation and comments go with their content, tags become blanks, blanks collapse."""
    c = F.regexp_replace(without_elements(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "script", "style", "nav"), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))


def internal_links(text: str, namespaces: tuple[str, ...] = ("w", "wiktionary", "wikt")) -> str:
    """[[target|...|label]]trail becomes label and trail; links into other namespaces go."""
    out, at = [], 0
    for a, b in balanced(text):
        parts = text[a + 2 : b - 2].split("|")
        target, label = parts[0].strip(), parts[-1].strip()
        colon = target.find(":")
        out.append(text[at:a])
        if not (colon > 0 and target[:colon].lower() not in namespaces):
            out.append(internal_links(label.lstrip(":")))
        at = b
    return "".join(out) + text[at:]


def clean(text: str) -> str:
    """Wiki text -> plain text: nested templates and tables, links, elements, entities, blanks."""
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    text = drop_nested(drop_nested(text, "{{", "}}"), "{|", "|}")
    text = internal_links(text)
    text = re.sub(r"\[(?:https?|ftp)://\S+?(?:\s+([^\]]*))?\]", lambda m: m[1] or "", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"__[A-Z]+__", "", text)
    text = re.sub(r"<(\w+)[^>]*/>", "", text)
    for name in DISCARDED:
        before = None
        while before != text:  # innermost first
            before, text = text, re.sub(rf"(?is)<{name}\b[^>]*>(?:(?!<{name}\b).)*?</{name}\s*>", "", text)
    text = re.sub(rf"(?i)</?(?:{'|'.join(IGNORED)})\b[^>]*>", "", text)
    text = html.unescape(html.unescape(text)).replace("\t", " ")
    text = re.sub(r" {2,}", " ", text)
    text = re.sub(r" (,|:|\.|\)|\]|»)", r"\1", text)
    return re.sub(r"(\(|\[|«) ", r"\1", text)


def compact(text: str, headings: bool = False, lists: bool = False) -> list[str]:
    """Paragraphs without empty sections; headings and list items only on demand."""
    out: list[str] = []
    pending: list[tuple[int, str]] = []
    for line in text.split("\n"):
        line = line.strip()
        if m := re.fullmatch(r"(={2,6})\s*(.*?)\s*\1", line):
            level = len(m[1])
            pending = [p for p in pending if p[0] < level] + [(level, m[2])]
        elif not line or line[0] in "{|}" or re.fullmatch(r"[\W_]+", line):
            continue
        elif line[0] in "*#;:":
            if lists and (item := line.lstrip("*#;: ")):
                out.append(f"- {item}")
        else:
            if headings:
                out += [title + "." for _, title in pending]
            pending = []
            out.append(line)
    return out


class Templates:
    """Expansion of {{name|...}} with parameters {{{x|default}}}, to a bounded depth; no code runs. A body may be a
    redirection to another template."""

    def __init__(self, bodies: dict[str, str]):
        self.bodies = {self.key(k): self.included(v) for k, v in bodies.items()}
        self.words: dict[str, str] = {}

    def page(self, text: str, words: dict[str, str]) -> str:
        """expand(), with the words that stand for the page or the time."""
        own = copy.copy(self)
        own.words = words
        return own.expand(text)

    def body(self, name: str) -> str | None:
        """The body under a name, over redirections."""
        for _ in range(DEEPEST):
            found = self.bodies.get(self.key(name))
            to = _REDIRECT.match(found or "")
            if not to:
                return found
            name = to[1]
        return None

    @staticmethod
    def key(name: str) -> str:
        name = _BLANKS.sub(" ", name).strip()
        return name[:1].upper() + name[1:]

    @staticmethod
    def included(body: str) -> str:
        """What a page that names the template gets of it."""
        only = re.findall(r"(?s)<onlyinclude>(.*?)</onlyinclude>", body)
        body = "".join(only) if only else re.sub(r"(?s)<noinclude>.*?(?:</noinclude>|\Z)", "", body)
        return re.sub(r"</?includeonly>", "", body)

    def expand(self, text: str, values: dict[str, str] | None = None, depth: int = 0, within: tuple = ()) -> str:
        """within: names and values of the templates around, the innermost last."""
        if depth > DEEPEST:
            return ""
        if "{{" not in text:
            return text
        text = self._parameters(text, values or {}, depth)
        out, at = [], 0
        for a, b in balanced(text, (("{{", "}}"),)):
            out += [text[at:a], self._call(text[a + 2 : b - 2], depth, within)]
            at = b
        return "".join(out) + text[at:]

    def _parameters(self, text: str, values: dict[str, str], depth: int) -> str:
        """A turn replaces all innermost parameters, so that turns are levels; what is nested deeper goes."""
        turn = 0
        while "{{{" in text and _PARAMETER.search(text):
            turn += 1
            text = _PARAMETER.sub(lambda m: values.get(m[1].strip(), m[2] or "") if turn <= DEEPEST else "", text)
        return text

    @staticmethod
    def parts(text: str) -> list[str]:
        """Split at | outside of links and templates."""
        if "|" not in text:
            return [text]
        inside = balanced(text, _NESTED)
        if not inside:
            return text.split("|")
        cuts = [m.start() for m in _BAR.finditer(text) if not any(a <= m.start() < b for a, b in inside)]
        return [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]

    def _call(self, inner: str, depth: int, within: tuple = ()) -> str:
        def e(t: str) -> str:
            return self.expand(t, None, depth + 1, within)

        name, *given = self.parts(inner)
        name = e(name).strip()
        if name in self.words:
            return self.words[name]
        if name[:6].lower() == "subst:":
            name = name[6:]
        head, colon, first = name.partition(":")
        if colon and head.strip().lower() == "#invoke":
            return self._invoke(first, given, e, within)
        if colon and (f := FUNCTIONS.get(head.strip().lower())):
            return f([first, *given], lambda t: e(t).strip())
        body = self.body(name)
        if body is None:
            return ""
        values = self.values(given, e)
        return self.expand(body, values, depth + 1, (*within, (self.key(name), values)))

    @staticmethod
    def values(given: list[str], e: Callable[[str], str]) -> dict[str, str]:
        """Arguments by name, or by their number among those without one."""
        values: dict[str, str] = {}
        n = 0
        for g in given:
            at = g.find("=")
            if at >= 0 and (inside := balanced(g, _NESTED)):
                at = next((m.start() for m in _EQUALS.finditer(g) if not any(a <= m.start() < b for a, b in inside)), -1)
            n += at < 0
            values[str(n) if at < 0 else g[:at].strip()] = e(g if at < 0 else g[at + 1 :].strip())
        return values

    def _invoke(self, module: str, given: list[str], e: Callable[[str], str], within: tuple) -> str:
        """A text module; without arguments of its own it has those of the template around that bears its name."""
        if not given:
            return ""
        own = self.values(given[1:], e) if given[1:] else next((v for k, v in reversed(within) if k == self.key(module)), {})
        return invoke(module, e(given[0]), own)


def _switch(a: list[str], e: Callable[[str], str]) -> str:
    value, through, default = e(a[0]), False, ""
    for case in a[1:]:
        k, equals, v = case.partition("=")
        if not equals:
            through = through or e(k) == value
            default = e(k)
        elif through or e(k) == value:
            return e(v)
        elif e(k) == "#default":
            default = e(v)
    return default


def _get(a: list[str], i: int) -> str:
    return a[i] if i < len(a) else ""


#: Parser functions, #invoke apart. #time and the like are left out: they give an empty text.
FUNCTIONS: dict[str, Callable[[list[str], Callable[[str], str]], str]] = {
    "#expr": lambda a, e: expression(e(a[0])),
    "#if": lambda a, e: e(_get(a, 1 if e(a[0]) else 2)),
    "#ifeq": lambda a, e: e(_get(a, 2 if e(a[0]) == e(_get(a, 1)) else 3)),
    "#iferror": lambda a, e: e(_get(a, 1)) if 'class="error"' in e(a[0]) else e(_get(a, 2) if len(a) > 2 else a[0]),
    "#ifexist": lambda a, e: e(_get(a, 2)),
    "#switch": _switch,
    "lc": lambda a, e: e(a[0]).lower(),
    "uc": lambda a, e: e(a[0]).upper(),
    "lcfirst": lambda a, e: e(a[0])[:1].lower() + e(a[0])[1:],
    "ucfirst": lambda a, e: e(a[0])[:1].upper() + e(a[0])[1:],
    "urlencode": lambda a, e: re.sub(r"%20", "+", __import__("urllib.parse").parse.quote(e(a[0]), safe="")),
    "int": lambda a, e: e(a[0]),
}


def mapped(df, column: str, f: Callable[[str], str], name: str):
    """df with `name`: f of a string column, in Arrow batches; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{name: [None if x is None else f(x) for x in rows[column]]})

    return df.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in df.dtypes) + f", {name} string")


def resolved_anchors(text: str, ids: dict[str, str], redirects: dict[str, str]) -> str:
    """[[title|label]] becomes [[id|label]], over redirects, or the label alone where the title isn't known."""
    out, at = [], 0
    for a, b in balanced(text):
        title, bar, label = text[a + 2 : b - 2].partition("|")
        label = label if bar else title
        found = ids.get(redirects.get(title, title))
        out += [text[at:a], f"[[{found}|{label}]]" if found else label]
        at = b
    return "".join(out) + text[at:]


def tag_offsets(text: str) -> tuple[str, list[int]]:
    """Text without tags, and for each character that stays its offset before."""
    kept = [i for a, b in zip([0, *(m.end() for m in re.finditer(r"<[^>]*>", text))], [*(m.start() for m in re.finditer(r"<[^>]*>", text)), len(text)]) for i in range(a, b)]
    return "".join(text[i] for i in kept), kept
