"""Sentence boundaries in any language and script (problem 9).

Every line break is a boundary.  Within a line, terminators of all scripts give
candidates, judged by a maximum-entropy classifier over both neighbours: of the token
before and the token after the identity, case, length, digits and script, how often
tokens like the one before end a line and tokens like the one after begin one, the
terminator and the gap.  It is trained on reliable cases taken from the texts
themselves: stops at line ends are boundaries; stops before a small letter are none,
nor are those after tokens that stand before stops often but hardly ever at a line
end, nor those between a short number and a word that often follows one but begins no
line.  Habits and weights are taken from all texts.  No list of abbreviations is used.  Quotations, bracketed runs and dash
dialogues are not cut; where they close after a terminator, the statement of the
problem decides.
"""

from __future__ import annotations

import pickle
import re as std_re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.session import stage, unstage

#: Places for the weights of features, so many that those of tokens from all documents seldom share one.
BUCKETS = 1 << 18
#: Documents are read in chunks of so many characters; equal cases of a chunk are counted together.
CHUNK_CHARS = 1 << 23
#: Up to so many different cases the steps of the fit are done by the driver, beyond by the executors; the weights are the same.
DRIVER_CASES = 8_000_000
#: Blocks of the fit are joined until they have so many cases.
BLOCK_CASES = 1 << 20
#: Then the driver gets so many parts of the gradient in a step at most, of two megabytes each.
GRADIENTS = 32
#: Errors are rounded to multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-48
STEPS, RATE, RIDGE = 120, 0.5, 1e-5
#: Weights before anything is learned: terminators that abbreviations and numbers do not share end sentences, and so do stops after
#: tokens of which nothing is known.
PRIOR = {"m=full": 4.0, "m=!": 2.0, "m=?": 2.0, "m=many": 1.0, "bhabit=rare": 5.0, "acase=lower": -8.0}
#: A token is held for an abbreviation in training if so many line ends were due to it and it has less than this part of them.
DUE_ENDS, FEW_ENDS = 4.0, 0.1
#: A word makes the short number before it an ordinal if it follows one so often and begins a line at most so much as often.
ORDINAL_CASES, ORDINAL_STARTS = 5, 0.05

LINE_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
STOP = "."
TERMINATORS = re.compile(r"[.!?…。！？．｡।॥۔؟‼⁇⁈⁉]+|(?<=[Ͱ-Ͽἀ-῿][»”\")]?)[;;]")
FULL_WIDTH = frozenset("。！？．｡।॥۔؟")
CLOSERS = "”\"’'»)]}」』›）】〉》"
PAIRS = {"“": "”\"", "«": "»", "„": "“”\"", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "‹": "›", '"': '"”', "《": "》"}
BRACKETS = frozenset("([（")
OPENERS = "“«„‘\"'「『(（[¿¡—–-•‹《 \xa0"
DASH_SPEECH = re.compile(r"(?:^|(?<=\s))—(?=\S)[^—]*?\s—(?=\p{Ll})")
THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
THAI = std_re.compile("[ก-๎]")
TOKEN_BEFORE = re.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’,-]*$|\S+$")
LAST_BLANK = re.compile(r"(?r)\s")
TOKEN_AFTER = re.compile(r"[\p{L}\p{M}\p{N}]+")
GLUED = re.compile(r"(?:\p{Lu}\p{Ll}|\p{Lu}\s|[؀-ۿऀ-ॿ¿¡])")

def _kind(ch: str) -> str:
    if not ch:
        return "none"
    if ch.isdigit():
        return "digit"
    if ch.islower():
        return "lower"
    if ch.isupper() or ch.istitle():
        return "upper"
    return "letter" if ch.isalpha() else "sign"


def _script(ch: str) -> str:
    o = ord(ch) if ch else 0
    for name, lo, hi in (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF),
                         ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("cjk", 0x3040, 0x9FFF)):
        if lo <= o <= hi:
            return name
    return "other"


def _shape(token: str) -> str:
    """The token's identity for the model: initials and digits by their kind, others in small letters."""
    if token.isdigit():
        return f"<{min(len(token), 5)}d>"
    if len(token) == 1:
        return "<I>" if token.isupper() else token
    return token.lower()


def _next(token: str) -> str:
    """Identity of the token after: as ``_shape``, but small and capital letters tell words apart."""
    return _shape(token) if len(token) < 2 or token.isdigit() else token


def _case(token: str) -> str:
    """Kind of the first sign; a small letter before a capital is a kind of its own."""
    kind = _kind(token[:1])
    return "camel" if kind == "lower" and not token.islower() and any(ch.isupper() for ch in token) else kind


@dataclass(slots=True)
class Stop:
    """A terminator that may end a sentence at ``at`` (offset in the line, after closers)."""

    at: int
    before: str
    after: str
    first: str
    gap: bool
    alone: bool
    mark: str = STOP


OPENING = re.compile("[" + re.escape("".join(PAIRS)) + "]")


def _protected(line: str) -> list[tuple[int, int, str]]:
    """Outermost quoted or bracketed runs (first and last offset, opening sign) that close in the line."""
    out = [(m.start(), m.end() - 1, "—") for m in DASH_SPEECH.finditer(line)] if "—" in line else []
    n, at = len(line), 0
    while (m := OPENING.search(line, at)) is not None:
        i, ch = m.start(), m.group()
        at = i + 1
        ends = PAIRS[ch]
        depth, j = 1, i + 1
        while j < n and depth:
            if line[j] in ends and not (ch == "„" and line[j] == "“" and j == i + 1):
                depth -= 1
            elif line[j] == ch and ch not in '"“«':
                depth += 1
            j += 1
        if not depth:
            out.append((i, j - 1, ch))
            at = j
    return out


@dataclass(slots=True)
class Candidate:
    at: int
    body: int  # where what follows begins
    kind: str  # quoted or open
    span: tuple | None = None
    stop: Stop | None = None


def candidates(line: str) -> list[Candidate]:
    """Places in a line where a sentence may end, in order; the line's own end is none."""
    spans = _protected(line)
    out, glued = [], 0
    for m in TERMINATORS.finditer(line):
        span = next((s for s in spans if s[0] < m.start() <= s[1]), None)
        end = m.end()
        if span:
            if span[2] == "—" or line[end : span[1]].strip(CLOSERS + "  "):
                continue
            end = span[1] + 1
        while end < len(line) and (line[end] in CLOSERS and not (line[end] in "\"'’" and end + 1 < len(line) and line[end + 1].isalnum())):
            end += 1
        body = end
        while body < len(line) and line[body].isspace():
            body += 1
        if body == len(line):
            continue
        gap = body > end
        signs = body
        while signs < len(line) and line[signs] in OPENERS:
            signs += 1
        first = line[signs : signs + 1]
        if span:
            out.append(Candidate(end, body, "quoted", span, Stop(end, "", line[body], first, gap, False)))
            continue
        mark = m.group()
        nxt = TOKEN_AFTER.match(line, signs)
        after = nxt.group() if nxt else line[body]
        if mark[-1] in FULL_WIDTH:
            out.append(Candidate(end, body, "open", None, Stop(end, line[m.start() - 1 : m.start()], after, first, gap, False, mark)))
            continue
        stop_at = m.start()
        alone = stop_at > 0 and line[stop_at - 1].isspace()
        if alone:
            stop_at = len(line[:stop_at].rstrip())
        blank = LAST_BLANK.search(line, 0, stop_at)
        # after a stop without a blank a new token begins
        word = line[max(blank.end() if blank else 0, min(glued, stop_at)) : stop_at]
        # a plain word needs no pattern
        t = None if word.isalnum() else TOKEN_BEFORE.search(word)
        before = t.group().strip("\"'“”«»„()[]") if t else word
        if not gap:
            inner = mark == STOP and not (GLUED.match(line, body) and len(before) > 2 and "." not in before and _kind(first) != "digit")
            if inner or (mark != STOP and not (first.isalpha() or line[body] in "¿¡“«„「")):
                continue
            if mark == STOP and _script(before[-1:]) != _script(first) and not before.isdigit():
                continue
            glued = end
        out.append(Candidate(end, body, "open", None, Stop(end, before, after, first, gap, alone, mark)))
    return out


def _marks(mark: str) -> str:
    return "stop" if mark == STOP else "full" if mark[-1] in FULL_WIDTH else mark[-1] if len(mark) == 1 else "many"


def _before_names(token: str, n: int, ends: int, base: float) -> list[str]:
    """Features of the token before; ``n`` and ``ends``: how often it stood before a stop, and at a line end."""
    tok = _shape(token)
    due = n * base
    habit = "rare" if due < 0.5 else "never" if ends == 0 and due >= 2 else "seldom" if ends < FEW_ENDS * due else "some" if ends < 0.5 * due else "ends"
    return [
        f"b={tok}",
        f"bhabit={habit}",
        f"blen={min(len(token), 6)}/{habit == 'rare'}",
        f"bkind={_case(token)}/{min(len(token), 4)}",
        f"bscript={_script(token[-1:])}",
        f"bdot={'.' in token}/{token[-1:].isdigit()}",
    ]


def _after_names(first: str, token: str, n: int, starts: int) -> list[str]:
    """Features of the token after; ``n`` and ``starts``: how often it followed a stop within a line, and began a line."""
    share = starts / (n + starts) if n + starts >= 3 else -1
    habit = "rare" if share < 0 else "never" if starts == 0 else "seldom" if share < 0.1 else "starts"
    return [
        f"a={_next(token)}",
        f"ahabit={habit}",
        f"acase={_case(token) if token[:1] == first else _kind(first)}",
        f"alen={min(len(token), 5)}",
        f"ascript={_script(first)}",
        f"adigit={token[:1].isdigit()}",
    ]


def _before_side(token: str) -> tuple:
    """What the features of both neighbours take of the token before: case, length, script, whether a short number."""
    return _case(token), min(len(token), 3), _script(token[-1:]), len(token) < 3 and token.isdigit()


def _after_side(first: str, token: str) -> tuple:
    """What the features of both neighbours take of the token after: case and script."""
    return _case(token) if token[:1] == first else _kind(first), _script(first)


def _cross_names(mark: str, gap: bool, alone: bool, before: tuple, after: tuple, numbered: str) -> list[str]:
    """Features of both neighbours (their sides), the terminator and the gap together; ``numbered``: the token after a short number."""
    b, length, b_script, short = before
    a, a_script = after
    return [
        f"m={mark}",
        f"m/gap={mark}/{gap}/{alone}",
        f"m/case={mark}/{a}/{alone}",
        f"case={b}/{a}/{length}",
        f"script={b_script}/{a_script}/{gap}",
        f"number={short}/{numbered}",
    ]


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in names]


def _key(token: str) -> int:
    """64 bits that stand for a token kind in the counts."""
    return int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


@dataclass
class Habits:
    """Counts by token kind: sorted keys and a row of counts for each; zeros for others."""

    keys: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(keys, *counts) -> Habits:
        keys, counts = np.asarray(keys, dtype=np.int64), np.array(counts, dtype=np.int64).T
        order = np.argsort(keys)
        return Habits(keys[order], counts[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of counts."""
        if not len(self.keys):
            return np.zeros((len(keys), self.counts.shape[1]), dtype=np.int64)
        i = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        return np.where((self.keys[i] == keys)[:, None], self.counts[i], 0)

    def get(self, key: int) -> list[int]:
        return self.find(np.array([key]))[0].tolist()


@dataclass
class Model:
    """``seen``: (times before a stop, times at a line end); ``starts``: (times after a terminator within a line, times at a
    line start, times after a short number); ``base``: line ends per stop; ``weights`` by hashed feature."""

    seen: Habits
    starts: Habits
    base: float
    weights: np.ndarray
    known: tuple[dict, dict, dict] = field(default_factory=lambda: ({}, {}, {}))

    def _weigh(self, part: int, key, names: list[str], *more) -> tuple:
        known = self.known[part]
        if len(known) > 100_000:
            known.clear()
        said = known[key] = (float(self.weights[_hashed(names)].sum()), *more)
        return said

    def boundary(self, s: Stop) -> bool:
        """The sum of what the token before, the token after and both together weigh; each part is looked up once."""
        befores, afters, crosses = self.known
        b = befores.get(s.before)
        if b is None:
            names = _before_names(s.before, *self.seen.get(_key(_shape(s.before))), self.base)
            b = self._weigh(0, s.before, names, _before_side(s.before))
        key = (s.after, s.first)
        a = afters.get(key)
        if a is None:
            names = _after_names(s.first, s.after, *self.starts.get(_key(_next(s.after)))[:2])
            a = self._weigh(1, key, names, _after_side(s.first, s.after))
        numbered = _next(s.after) if b[1][3] else ""
        key = (s.mark, s.gap, s.alone, b[1], a[1], numbered)
        c = crosses.get(key)
        if c is None:
            c = self._weigh(2, key, _cross_names(_marks(s.mark), *key[1:]))
        return b[0] + a[0] + c[0] > 0


@dataclass
class Cases:
    """Distinct cases: rows of ``befores`` (tokens), ``afters`` (token and first sign) and ``marks`` (terminators) with their
    flags, how many are alike, and the keys of the tokens' kinds."""

    befores: list[str]
    afters: list[tuple[str, str]]
    marks: list[str]
    b: np.ndarray
    a: np.ndarray
    m: np.ndarray
    gap: np.ndarray
    alone: np.ndarray
    at_end: np.ndarray
    n: np.ndarray
    b_keys: np.ndarray
    a_keys: np.ndarray

    @staticmethod
    def of(counted: dict[tuple, int], n: list[int]) -> Cases:
        befores, afters, marks = {}, {}, {}
        rows = [
            (befores.setdefault(b, len(befores)), afters.setdefault((a, first), len(afters)), marks.setdefault(m, len(marks)), gap, alone, at_end)
            for b, a, first, m, gap, alone, at_end in counted
        ]
        cols = np.array(rows, dtype=np.int32).reshape(-1, 6).T
        keys = (np.array([_key(x) for x in kinds], dtype=np.int64) for kinds in (map(_shape, befores), (_next(a) for a, _ in afters)))
        return Cases(list(befores), list(afters), list(marks), *cols[:3], *(cols[3:] > 0), np.array(n, dtype=np.int64), *keys)

    def short(self) -> np.ndarray:
        """Whether each token before is a short number."""
        return np.array([len(t) < 3 and t.isdigit() for t in self.befores], dtype=bool)

    def stops(self) -> np.ndarray:
        return np.array([m == STOP for m in self.marks], dtype=bool)[self.m]

    def counts(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each token before: times before a stop, at a line end; for each token after: times within a line, after a short number."""
        stop, inner = self.stops(), ~self.at_end
        count = lambda at, which, size: np.bincount(at[which], self.n[which], size).astype(np.int64)
        befores = [count(self.b, stop & x, len(self.befores)) for x in (np.ones_like(stop), self.at_end)]
        return befores, [count(self.a, inner & x, len(self.afters)) for x in (np.ones_like(stop), stop & self.short()[self.b])]

    def crosses(self, rows: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
        """Names of the features of both neighbours of these rows: distinct ones, and which each row has."""
        ids: list[dict] = [{}, {}, {}, {"": 0}]
        number = lambda k, x: ids[k].setdefault(x, len(ids[k]))
        mark = np.array([number(0, _marks(m)) for m in self.marks], dtype=np.int64)
        before = np.array([number(1, _before_side(t)) for t in self.befores], dtype=np.int64)
        after = np.array([number(2, _after_side(first, t)) for t, first in self.afters], dtype=np.int64)
        numbered = np.array([number(3, _next(t)) for t, _ in self.afters], dtype=np.int64)
        b, a = self.b[rows], self.a[rows]
        code = mark[self.m[rows]] * 4 + self.gap[rows] * 2 + self.alone[rows]
        code = (code * len(ids[1]) + before[b]) * len(ids[2]) + after[a]
        code = code * len(ids[3]) + np.where(self.short()[b], numbered[a], 0)
        _, some, which = np.unique(code, return_index=True, return_inverse=True)
        names = []
        for r in rows[some].tolist():
            token, (nxt, first) = self.befores[self.b[r]], self.afters[self.a[r]]
            side = _before_side(token)
            key = (_marks(self.marks[self.m[r]]), bool(self.gap[r]), bool(self.alone[r]), side, _after_side(first, nxt), _next(nxt) if side[3] else "")
            names.append(_cross_names(*key))
        return names, which


def _table(names: Iterable[list[str]]) -> np.ndarray:
    return np.array([_hashed(x) for x in names], dtype=np.uint32).reshape(-1, 6)


def _reliable(c: Cases, before: np.ndarray, after: np.ndarray, base: float) -> np.ndarray:
    """1 for sure boundaries, 0 for sure non-boundaries, -1 where neither is sure; ``before``, ``after``: habits of the tokens."""
    stop, short = c.stops(), c.short()[c.b]
    small = np.array([t[:1] == first and _case(t) == "lower" for t, first in c.afters], dtype=bool)[c.a]
    (total, ends), (follows, starts, ordinals) = before[c.b].T, after[c.a].T
    due = total * base
    rules = [
        (c.at_end | (c.alone & stop), 1),
        (small, 0),
        (~stop, -1),
        ((due >= DUE_ENDS) & (ends < FEW_ENDS * due), 0),
        (short & (ordinals >= ORDINAL_CASES) & (starts <= ORDINAL_STARTS * ordinals), 0),
        ((due >= 1) & (ends >= 0.5 * due) & (starts >= 3) & (starts >= 0.2 * follows), 1),
    ]
    return np.select([x for x, _ in rules], [y for _, y in rules], -1)


def _lines(text: str | None) -> list[tuple[int, str]]:
    """Lines that are not blank, without white space at their ends, and where they begin."""
    out, begin = [], 0
    for m in chain(LINE_BREAK.finditer(text or ""), (None,)):
        line = (text or "")[begin : m.start() if m else None].rstrip()
        if line:
            out.append((begin, line))
        begin = m.end() if m else begin
    return out


class Chunk:
    """Documents read once: their cases for the fit, and the places where sentences may end, to be judged by the fitted model.

    A place is judged by its case, or always one (``SURE``: line starts among them), or depends on where the sentence begins
    (``OPEN``, see ``_closing``).  ``starts``: where the piece after a place begins; ``ends``: where the one before ends.
    After a line end stands the next line's first token, after the last line's the first line's, so that no case depends on
    other texts.
    """

    SURE, OPEN = -1, -2

    def __init__(self):
        self.counted, self.n, self.heads, self.chars = {}, [], Counter(), 0
        self.ids, self.sizes, self.kinds, self.starts, self.ends, self.depends, self.last = [], [], [], [], [], {}, 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        lines, before = _lines(text), len(self.kinds)
        heads = [(m.group() if (m := TOKEN_AFTER.match(signs)) else signs[:1]) for signs in (x.lstrip(OPENERS) for _, x in lines)]
        self.heads.update(heads)
        for (offset, line), head in zip(lines, [*heads[1:], *heads[:1]]):
            self._line(offset, line, head)
        self.chars += len(text or "")
        self.ids.append(doc_id)
        self.sizes.append(len(self.kinds) - before)

    def _line(self, offset: int, line: str, head: str) -> None:
        counted, n, size = self.counted, self.n, len(line)
        self._place(self.SURE, offset + size - len(line.lstrip()), self.last)
        self.last = offset + size
        found = candidates(f"{line} {head}" if head else line)
        if head and not (head[0].isalnum() and line[-1] not in OPENERS):
            # the sign would close what is open, or the token follow what is opened
            found = candidates(line) + [c for c in found if c.at >= size]
        if THAI.search(line):
            found = sorted([*found, *(Candidate(m.start(), m.end(), "gap") for m in THAI_GAP.finditer(line))], key=attrgetter("at"))
        for c in found:
            at_end = c.at >= size
            if c.kind == "open":
                s = c.stop
                key = (s.before, s.after, s.first, s.mark, s.gap, s.alone, at_end)
                i = counted.get(key)
                if i is None:
                    i = counted[key] = len(n)
                    n.append(0)
                n[i] += 1
                if not at_end:
                    self._place(i, offset + c.body, offset + c.at)
            elif not at_end:
                turn = True if c.kind == "gap" else _closing(c, line)
                if turn is True:
                    self._place(self.SURE, offset + c.body, offset + c.at)
                elif turn:
                    self.depends[len(self.kinds)] = (turn[0], offset + turn[1])
                    self._place(self.OPEN, offset + c.body, offset + c.at)

    def _place(self, kind: int, start: int, end: int) -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.ends.append(end)

    def counts(self, cases: Cases) -> pa.RecordBatch:
        """Counts by side (0: before, 1: after) and key of the token's kind, as ``Habits`` has them."""
        (total, ends), (follows, ordinals) = cases.counts()
        heads = np.array([_key(_next(t)) for t in self.heads], dtype=np.int64)
        zeros, begun = np.zeros(len(heads), dtype=np.int64), np.array(list(self.heads.values()), dtype=np.int64)
        side = np.repeat([0, 1], [len(total), len(follows) + len(heads)])
        keys = np.concatenate([cases.b_keys, cases.a_keys, heads])
        none_b, none_a = np.zeros_like(total), np.zeros_like(follows)
        counts = [[total, follows, zeros], [ends, none_a, begun], [none_b, ordinals, zeros]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (side, keys, *map(np.concatenate, counts))], names=["side", "key", "c0", "c1", "c2"])

    def places(self) -> tuple:
        flat = (np.array(x, dtype=np.int32) for x in (self.sizes, self.kinds, self.starts, [*self.ends, self.last]))
        return self.ids, *flat, self.depends


def _places_sentences(places: tuple, ends_sentence: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, and for each sentence its document, start and end; ``ends_sentence``: the verdict on each case."""
    ids, sizes, kinds, starts, ends, depends = places
    ok = np.where(kinds >= 0, ends_sentence[kinds], True) if len(ends_sentence) else kinds < 0
    if depends:
        begin, at = 0, np.flatnonzero((kinds == Chunk.OPEN) | ok)
        for i in at.tolist():
            if i in depends:
                bracket, bound = depends[i]
                ok[i] = (bound <= begin) == bracket
            if ok[i]:
                begin = starts[i]
    first = np.flatnonzero(ok)
    begin, end = starts[first], ends[np.append(first[1:], len(kinds))]
    doc = np.repeat(np.arange(len(ids)), sizes)[first]
    full = begin < end
    return ids, doc[full], begin[full], end[full]


PARSED = "side tinyint, key bigint, c0 bigint, c1 bigint, c2 bigint, cases binary, places binary"


def _parsed(documents: Iterable[tuple[int | None, str | None]]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: a row with the cases and the places of each, and rows with counts by token kind (``PARSED``)."""

    def batch(chunk: Chunk) -> pa.RecordBatch:
        cases = Cases.of(chunk.counted, chunk.n)
        counts = chunk.counts(cases)
        cols = [pa.concat_arrays([x.cast(k), pa.nulls(1, k)]) for x, k in zip(counts.columns, (pa.int8(), *[pa.int64()] * 4))]
        none = pa.nulls(counts.num_rows, pa.binary())
        cols += [pa.concat_arrays([none, pa.array([pickle.dumps(x)], pa.binary())]) for x in (cases, chunk.places())]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PARSED.split(", ")])

    chunk = Chunk()
    for doc_id, text in documents:
        chunk.add(doc_id, text)
        if chunk.chars > CHUNK_CHARS:
            yield batch(chunk)
            chunk = Chunk()
    yield batch(chunk)


@dataclass
class Block:
    """Labelled cases of the fit: hashed features of the tokens before, the tokens after and both together; for each case the
    rows of these, its label and how many are alike."""

    names: list[np.ndarray]
    at: list[np.ndarray]
    label: np.ndarray
    n: np.ndarray

    def labels(self) -> np.ndarray:
        """How many cases are no boundaries, and how many are."""
        return np.array([self.n[~self.label].sum(), self.n[self.label].sum()])

    def gradient(self, weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Of the likelihood where both classes weigh the same; ``labels``: size of the classes in all blocks."""
        z = sum(weights[x].sum(axis=1)[at] for x, at in zip(self.names, self.at))
        share = np.where(self.label, 0.5 / max(labels[1], 1), 0.5 / max(labels[0], 1))
        err = np.rint((self.label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * share / GRAIN) * GRAIN * self.n
        g = np.zeros(BUCKETS)
        for x, at in zip(self.names, self.at):
            g += np.bincount(x.ravel(), np.repeat(np.bincount(at, err, len(x)), x.shape[1]), BUCKETS)
        return g


def _block(c: Cases, seen: Habits, starts: Habits, base: float) -> Block:
    """The reliable ones among counted cases; each is left out of the habits it is judged by."""
    before, after = seen.find(c.b_keys), starts.find(c.a_keys)
    label = _reliable(c, before, after, base)
    rows = np.flatnonzero(label >= 0)
    own, end = c.stops()[rows], c.at_end[rows]
    bs, b_at = np.unique(c.b[rows].astype(np.int64) * 4 + own * 2 + (own & end), return_inverse=True)
    as_, a_at = np.unique(c.a[rows].astype(np.int64) * 2 + end, return_inverse=True)
    before, after = before.tolist(), after.tolist()
    b_names = (_before_names(c.befores[x >> 2], before[x >> 2][0] - (x >> 1 & 1), before[x >> 2][1] - (x & 1), base) for x in bs.tolist())
    a_names = (_after_names(*c.afters[x >> 1][::-1], after[x >> 1][0] - (not x & 1), after[x >> 1][1] - (x & 1)) for x in as_.tolist())
    cross, c_at = c.crosses(rows)
    return _distinct([_table(x) for x in (b_names, a_names, cross)], [b_at, a_at, c_at], label[rows] > 0, c.n[rows])


def _distinct(names: list[np.ndarray], at: list[np.ndarray], label: np.ndarray, n: np.ndarray) -> Block:
    """A block where cases with the same features and label are one."""
    code = label.astype(np.int64)
    for x, i in zip(names, at):
        code = code * max(len(x), 1) + i
    _, some, which = np.unique(code, return_index=True, return_inverse=True)
    return Block(names, [i[some].astype(np.int32) for i in at], label[some], np.bincount(which, n, len(some)).astype(np.int64))


def _joined(blocks: Iterable[Block]) -> Iterator[Block]:
    """The blocks as fewer ones, of ``BLOCK_CASES`` or somewhat more."""

    def one() -> Block:
        names, at = [], []
        for k in range(3):
            ids: dict[bytes, int] = {}
            rows = np.concatenate([b.names[k] for b in held])
            which = np.fromiter((ids.setdefault(x, len(ids)) for x in rows.view("V24").ravel().tolist()), np.int64, len(rows))
            begins = np.cumsum([0, *(len(b.names[k]) for b in held)])
            names.append(np.frombuffer(b"".join(ids), dtype=np.uint32).reshape(-1, 6))
            at.append(np.concatenate([which[begin + b.at[k]] for begin, b in zip(begins, held)]))
        return _distinct(names, at, *(np.concatenate([getattr(b, x) for b in held]) for x in ("label", "n")))

    held: list[Block] = []
    for b in blocks:
        if len(b.n):
            held.append(b)
        if sum(len(x.n) for x in held) >= BLOCK_CASES:
            yield one()
            held = []
    if held:
        yield one()


def _verdicts(c: Cases, model: Model) -> np.ndarray:
    """As ``Model.boundary`` of each case."""
    b_names = (_before_names(t, *x, model.base) for t, x in zip(c.befores, model.seen.find(c.b_keys).tolist()))
    a_names = (_after_names(first, t, *x[:2]) for (t, first), x in zip(c.afters, model.starts.find(c.a_keys).tolist()))
    cross, c_at = c.crosses(np.arange(len(c.n)))
    b, a, both = (model.weights[_table(x)].sum(axis=1) for x in (b_names, a_names, cross))
    return b[c.b] + a[c.a] + both[c_at] > 0


def _descend(gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights from the prior on, with a step size for each."""
    prior = np.zeros(BUCKETS)
    for name, w in PRIOR.items():
        prior[_hashed([name])] = w
    weights, square = prior.copy(), np.full(BUCKETS, 1e-6)
    for _ in range(STEPS):
        g = gradient(weights) - RIDGE * (weights - prior)
        square += g * g
        weights += RATE * g / np.sqrt(square)
    return weights


def _descend_here(blocks: Iterable[Block]) -> np.ndarray:
    blocks = list(_joined(blocks))
    labels = sum((b.labels() for b in blocks), np.zeros(2, dtype=np.int64))
    return _descend(lambda w: sum((b.gradient(w, labels) for b in blocks), np.zeros(BUCKETS)))


def _descend_spread(blocks: DataFrame, labels: np.ndarray) -> np.ndarray:
    """As ``_descend_here`` for blocks that stay on the executors: one pass a step, of which the driver gets the gradients."""
    sc = blocks.sparkSession.sparkContext
    spread = blocks.coalesce(min(sc.defaultParallelism, GRADIENTS))

    def gradient(weights: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(weights)

        def run(batches):
            g = np.zeros(BUCKETS)
            for b in batches:
                for x in b.column(0):
                    g += pickle.loads(x.as_py()).gradient(sent.value, labels)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

        g = sum((np.frombuffer(r[0]) for r in spread.mapInArrow(run, "g binary").collect()), np.zeros(BUCKETS))
        sent.destroy()
        return g

    return _descend(gradient)


def _sums(n: int) -> list:
    return [F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]


def _model(parsed: DataFrame) -> Model:
    """Habits and weights from parsed documents; habits too rare for any feature or label are left out without effect."""
    sc = parsed.sparkSession.sparkContext
    total, ends = (x or 0 for x in parsed.where("side = 0").agg(*_sums(2)).first())
    base = ends / max(1, total)
    recurs = F.when(F.col("side") == 0, F.col("c0") * F.lit(base) >= 0.5).otherwise(F.col("c0") + F.col("c1") >= 3)
    habits = parsed.where("side is not null").groupBy("side", "key").agg(*_sums(3)).where(recurs).toArrow()
    side, *cols = (c.to_numpy() for c in habits.columns)
    seen, starts = Habits.of(*(c[side == 0] for c in cols[:3])), Habits.of(*(c[side == 1] for c in cols))
    known = sc.broadcast((seen, starts, base))

    def run(batches):
        for made in _joined(_block(pickle.loads(x.as_py()), *known.value) for b in batches for x in b.column(0)):
            sizes = (pa.array([int(y)], pa.int64()) for y in (len(made.n), *made.labels()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary()), *sizes], names=["block", "cases", "no", "yes"])

    chunks = parsed.where("cases is not null").select("cases")
    staged = stage(chunks.mapInArrow(run, "block binary, cases bigint, no bigint, yes bigint"), "blocks")
    n_cases, *labels = (x or 0 for x in staged.agg(F.sum("cases"), F.sum("no"), F.sum("yes")).first())
    blocks = staged.select("block")
    if n_cases > DRIVER_CASES:
        weights = _descend_spread(blocks, np.array(labels))
    else:
        weights = _descend_here(pickle.loads(x[0]) for x in blocks.toLocalIterator())
    known.destroy()
    unstage(staged)
    return Model(seen, starts, base, weights)


def fit(texts: list[str]) -> Model:
    """Fit habits and weights on texts, as ``train`` does on a table of them."""
    chunk = Chunk()
    for t in texts:
        chunk.add(None, t)
    cases = Cases.of(chunk.counted, chunk.n)
    side, keys, *counts = (np.array(x) for x in chunk.counts(cases).columns)
    total, ends = (int(c[side == 0].sum()) for c in counts[:2])
    base, habits = ends / max(1, total), []
    for k, width in ((0, 2), (1, 3)):
        own, at = np.unique(keys[side == k], return_inverse=True)
        cols = [np.bincount(at, c[side == k], len(own)).astype(np.int64) for c in counts[:width]]
        recurs = cols[0] * base >= 0.5 if k == 0 else cols[0] + cols[1] >= 3
        habits.append(Habits.of(own[recurs], *(c[recurs] for c in cols)))
    return Model(*habits, base, _descend_here([_block(cases, *habits, base)]))


def _closing(c: Candidate, line: str) -> bool | tuple[bool, int]:
    """Whether a sentence ends where a quotation or bracket closes after a terminator; a pair where that depends on its begin:
    (True, x) if it must begin at x or later, (False, x) if before."""
    # it stays with what introduces or follows it
    s, kind, at = c.stop, _kind(c.stop.first), c.span[0]
    if kind == "lower" or s.after[:1] in ",;:—–-、，؛،と":
        return False
    bracket = c.span[2] in BRACKETS
    if kind == "upper" or kind == ("letter" if bracket else "digit"):
        return True
    while at > 0 and (line[at - 1].isspace() if bracket else not line[at - 1].isalnum()):
        at -= 1
    return bracket, at


def _ends_here(c: Candidate, begin: int, line: str, model: Model) -> bool:
    if c.kind == "open":
        return model.boundary(c.stop)
    turn = _closing(c, line)
    return turn if isinstance(turn, bool) else (turn[1] <= begin) == turn[0]


def split_line(line: str, model: Model) -> list[tuple[int, int]]:
    """Sentences of one line as (start, end) without surrounding white space."""
    cuts = {m.start() for m in THAI_GAP.finditer(line)} if THAI.search(line) else ()
    begin, places = 0, []
    for at, c in sorted([(c.at, c) for c in candidates(line)] + [(x, None) for x in cuts], key=lambda x: x[0]):
        if c is None or _ends_here(c, begin, line, model):
            places.append(at)
            begin = at
    out, begin = [], 0
    for at in [*places, len(line)]:
        piece = line[begin:at]
        left = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((begin + left, begin + left + len(body)))
        begin = at
    return out


def split_text(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentences of a text as code-point offsets; none for null, empty and blank texts."""
    if not text:
        return []
    out, begin = [], 0
    for m in [*LINE_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        out += [(begin + a, begin + b) for a, b in split_line(text[begin:end], model)]
        begin = m.end() if m else end
    return out


def _parse(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        yield from _parsed(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return stage(documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PARSED), "parsed")


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on all documents: their cases are counted in one pass, staged, and habits and weights taken from the counts.

    The driver gets the counts of token kinds that recur and, up to ``DRIVER_CASES``, the counted cases as numbers.
    """
    parsed = _parse(documents, id_col, text_col)
    model = _model(parsed)
    unstage(parsed)
    return model


def find_sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``split_documents`` by the model of ``train``, without reading the texts again: what both need is staged in one pass."""
    parsed = _parse(documents, id_col, text_col)
    known = documents.sparkSession.sparkContext.broadcast(_model(parsed))

    def run(batches):
        for b in batches:
            for cases, places in zip(*b.columns):
                ids, doc, *spans = _places_sentences(pickle.loads(places.as_py()), _verdicts(pickle.loads(cases.as_py()), known.value))
                cols = [pa.array(ids, pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in spans)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "char_start", "char_end"])

    chunks = parsed.where("cases is not null").select("cases", "places")
    return chunks.mapInArrow(run, "doc_id bigint, char_start bigint, char_end bigint")


def split_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, char_start, char_end[, sentence]``: one row per sentence, in one narrow pass.

    Repeated ids give the rows of each text; only the two columns named are read.
    Null, empty and blank texts and empty tables give no rows.
    """
    known = documents.sparkSession.sparkContext.broadcast((model.seen, model.starts, model.base, model.weights))
    names = ["doc_id", "char_start", "char_end", *(["sentence"] if with_text else [])]

    def run(batches):
        m = Model(*known.value)
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in split_text(t, m):
                    for col, v in zip(rows, (i, s, e, t[s:e] if with_text else None)):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    schema = "doc_id bigint, char_start bigint, char_end bigint" + (", sentence string" if with_text else "")
    return documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
