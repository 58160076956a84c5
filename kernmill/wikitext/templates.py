"""Template parsing and expansion.

Text is parsed once into a tree by a stack of opening brace runs: a closing run
pairs with the innermost opening one, three braces making an argument and two a
template; what stays unpaired is text.  Expansion walks the tree with the
caller's parameters, looks templates up in a store and stops at a depth limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass

from kernmill.wikitext import functions as fn

MAX_DEPTH, MAX_ARG_DEPTH = 30, 10


@dataclass(frozen=True)
class Template:
    parts: tuple  # of nodes: tuples of str, Template and Argument


@dataclass(frozen=True)
class Argument:
    parts: tuple


_MARK = re.compile(r"\{\{+|\}\}+|\[\[|\]\]|\|")


class _Open:
    __slots__ = ("count", "parts", "link")

    def __init__(self, count: int, link: bool = False):
        self.count, self.parts, self.link = count, [[]], link


def _flat(frame: _Open) -> list:
    """Content of a frame that never closed, as plain nodes."""
    out = ["[[" if frame.link else "{" * frame.count]
    for i, p in enumerate(frame.parts):
        out += ["|", *p] if i else p
    return out


def parse(text: str) -> tuple:
    """Nodes of a text: strings, templates and arguments."""
    stack = [_Open(0)]
    at = 0
    for m in _MARK.finditer(text):
        top = stack[-1]
        if m.start() > at:
            top.parts[-1].append(text[at : m.start()])
        at, mark = m.end(), m.group()
        if mark[0] == "{":
            stack.append(_Open(len(mark)))
        elif mark == "[[":
            stack.append(_Open(2, True))
        elif mark == "|":
            if len(stack) > 1 and not top.link:
                top.parts.append([])
            else:
                top.parts[-1].append("|")
        elif mark == "]]":
            if top.link:
                stack.pop()
                stack[-1].parts[-1] += [*_flat(top), "]]"]
            else:
                top.parts[-1].append("]]")
        else:
            left = len(mark)
            while left >= 2:
                while stack[-1].link:  # an open link inside the braces was text
                    dead = stack.pop()
                    stack[-1].parts[-1] += _flat(dead)
                top = stack[-1]
                if len(stack) == 1:
                    break
                n = 3 if top.count >= 3 and left >= 3 else 2
                made = (Argument if n == 3 else Template)(tuple(tuple(p) for p in top.parts))
                top.count -= n
                left -= n
                if top.count >= 2:
                    top.parts = [[made]]
                else:
                    stack.pop()
                    if top.count == 1:
                        stack[-1].parts[-1].append("{")
                    stack[-1].parts[-1].append(made)
            if left:
                stack[-1].parts[-1].append("}" * left)
    if at < len(text):
        stack[-1].parts[-1].append(text[at:])
    while len(stack) > 1:
        dead = stack.pop()
        stack[-1].parts[-1] += _flat(dead)
    return tuple(stack[0].parts[0])


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_NOINCLUDE = re.compile(r"<noinclude>.*?(?:</noinclude>|\Z)", re.S | re.I)
_INCLUDEONLY = re.compile(r"</?includeonly>", re.I)
_ONLYINCLUDE = re.compile(r"<onlyinclude>(.*?)</onlyinclude>", re.S | re.I)


def transcluded(source: str) -> str:
    """What a page gives when it is included: no comments, no noinclude parts; only the onlyinclude parts if it has any."""
    text = _NOINCLUDE.sub("", _COMMENT.sub("", source))
    only = _ONLYINCLUDE.findall(text)
    return "".join(only) if only else _INCLUDEONLY.sub("", text)


_REDIRECT = re.compile(r"#redirect[^\[]*\[\[([^\]|#]+)", re.I)


def redirect_target(source: str) -> str | None:
    m = _REDIRECT.match(source.lstrip())
    return m.group(1).strip() if m else None


def title_case(title: str) -> str:
    t = re.sub(r"[\s_]+", " ", title).strip()
    return t[:1].upper() + t[1:]


#: Names every wiki knows for its namespaces.
CANONICAL = {
    "Media": -2, "Special": -1, "Talk": 1, "User": 2, "User talk": 3, "Project": 4, "Project talk": 5, "File": 6, "File talk": 7, "Image": 6,
    "MediaWiki": 8, "MediaWiki talk": 9, "Template": 10, "Template talk": 11, "Help": 12, "Help talk": 13, "Category": 14, "Category talk": 15,
    "Module": 828, "Module talk": 829,
}


class Namespaces:
    """Names of a wiki's namespaces: its own (name to key, from siteinfo) and those every wiki knows."""

    def __init__(self, own: dict[str, int] | None = None):
        own = {title_case(n): k for n, k in (own or {}).items() if n}
        self.keys = {**CANONICAL, **own}
        self.local = {**{k: n for n, k in reversed(CANONICAL.items())}, **{k: n for n, k in own.items()}}

    def split(self, title: str) -> tuple[int, str]:
        """Key and rest of a title; 0 and the whole where no known name stands before a colon."""
        space, colon, rest = title.partition(":")
        key = self.keys.get(title_case(space)) if colon else None
        return (0, title) if key is None else (key, rest)

    def full(self, head: str, default: int = 10) -> str:
        """Full title of what a template call names: a colon before it means the main namespace."""
        if head.startswith(":"):
            return title_case(head[1:])
        key, rest = self.split(head)
        return f"{self.local[key or default]}:{title_case(rest)}"


class Expander:
    """Expands one page's text.

    ``lookup`` gives the source of a template by full title or None; ``magic`` holds
    the values of magic words; ``spaces`` the names of the namespaces.
    """

    def __init__(self, lookup: Callable[[str], str | None], magic: dict[str, str] | None = None, spaces: Namespaces | None = None):
        self.lookup, self.magic, self.spaces = lookup, magic or {}, spaces or Namespaces()
        self.parsed: dict[str, tuple | None] = {}

    def expand(self, text: str) -> str:
        return self._nodes(parse(text), {}, 0)

    def _nodes(self, nodes: tuple, params: dict[str, str], depth: int) -> str:
        return "".join(n if isinstance(n, str) else self._one(n, params, depth) for n in nodes)

    def _one(self, node, params: dict[str, str], depth: int) -> str:
        if isinstance(node, Argument):
            return self._argument(node, params, depth)
        if depth >= MAX_DEPTH:
            return ""
        return self._template(node, params, depth + 1)

    def _argument(self, node: Argument, params: dict[str, str], depth: int) -> str:
        name = self._nodes(node.parts[0], params, depth + 1).strip() if depth < MAX_DEPTH + MAX_ARG_DEPTH else ""
        if name in params:
            return params[name]
        if len(node.parts) > 1:
            return self._nodes(node.parts[1], params, depth + 1) if depth < MAX_DEPTH + MAX_ARG_DEPTH else ""
        return "{{{" + name + "}}}" if not params else ""

    def _params(self, parts: tuple, params: dict[str, str], depth: int) -> dict[str, str]:
        """Parameters by name; unnamed ones are numbered, later ones win.  Names and named values are trimmed."""
        out, n = {}, 0
        for part in parts:
            value = self._nodes(part, params, depth)
            m = re.match(r"\s*([^=\[\]{}<>]*?)\s*=(.*)\Z", value, re.S)
            if m:
                body = m.group(2)
                out[m.group(1)] = body if "]]" in body else body.strip()
            else:
                n += 1
                out[str(n)] = value if "]]" in value else value.strip()
        return out

    def _template(self, node: Template, params: dict[str, str], depth: int) -> str:
        head = self._nodes(node.parts[0], params, depth).strip()
        head = re.sub(r"^(?:safesubst|subst):\s*", "", head, flags=re.I)
        rest = node.parts[1:]
        if not rest and head in self.magic:
            return self.magic[head]
        if head == "!":
            return "|"
        name, colon, first = head.partition(":")
        key = name.strip().lower()
        if colon and len(name) > 1:
            if key == "#invoke":
                if not rest:
                    return ""
                own = self._params(rest[1:], params, depth)
                return fn.invoke(first, self._nodes(rest[0], params, depth), own or params)
            made = fn.call(key, first, [lambda p=p: self._nodes(p, params, depth) for p in rest])
            if made is not None:
                return made
        body = self._body(self.spaces.full(head))
        if body is None:
            return ""
        return self._nodes(body, {"": "", **self._params(rest, params, depth)}, depth)

    def _body(self, title: str) -> tuple | None:
        """Parsed source; redirects are followed however many there are, a circle of them leads nowhere."""
        if title not in self.parsed:
            source, seen = self.lookup(title), {title}
            while source is not None and (to := redirect_target(source)):
                nxt = title_case(to)
                key, rest = self.spaces.split(nxt)
                nxt = self.spaces.full(nxt) if key else nxt
                source = None if nxt in seen else self.lookup(nxt)
                seen.add(nxt)
            self.parsed[title] = None if source is None else parse(transcluded(source))
        return self.parsed[title]


def unescape(text: str) -> str:
    """Character references to characters; unknown ones stay."""
    return html.unescape(text)
