"""Deterministic tokenizer, anchored links in paragraphs, head nouns.

Stands in for external language services: rules only, same result everywhere.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernmill.functions.text import BRACKET_TOKENS, short_description, squeeze

LINK_MARK = "@LINK"
_TO_BRACKET = {v: k for k, v in BRACKET_TOKENS.items()}
_TOKEN = regex.compile(
    r"@LINK|(?:\p{L}\.){2,}|\d+(?:[.,:]\d+)*|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|\.{3}|…|[^\s\p{L}\p{N}]"
)
_CLITIC = regex.compile(r"(?i)^(.+?)(n't|['’](?:s|re|ve|ll|d|m))$")
_ABBREVIATION = regex.compile(r"^(?:\p{L}|(?:\p{L}\.)+\p{L}|Mr|Mrs|Ms|Dr|Prof|St|Gen|Capt|Jr|Sr|No|vs|cf|vol|ca|approx|etc|Fig)$")
_END = frozenset(".!?。！？")
_CLOSE = frozenset("\"”’')]}»")


def tokenize(text: str | None) -> list[list[str]]:
    """Sentences as token lists; brackets become their token names, a per cent sign stands alone.

    Null and blank texts have no sentences.
    """
    words: list[str] = []
    for t in _TOKEN.findall((text or "").replace("%", "% ")):
        m = _CLITIC.match(t)
        if m:
            words += [m.group(1), m.group(2)]
        else:
            words.append(_TO_BRACKET.get(t, t))
    out, cur, quotes = [], [], 0

    def closes(word: str) -> bool:
        """Whether a word belongs to the sentence that has just ended; a straight quote does if one is open."""
        return word in ("-RRB-", "-RSB-") or (quotes % 2 == 1 if word == '"' else word in _CLOSE)

    for i, w in enumerate(words):
        cur.append(w)
        nxt = words[i + 1] if i + 1 < len(words) else ""
        done = False
        if w in _END and not (nxt in _END or closes(nxt)):
            done = not (w == "." and len(cur) > 1 and _ABBREVIATION.match(cur[-2]) and nxt)
        elif len(cur) > 1 and cur[-2] in _END and closes(w):
            done = not nxt or nxt[:1].isupper()
        quotes += w == '"'
        if done:
            out.append(cur)
            cur, quotes = [], 0
    if cur:
        out.append(cur)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenized_sentences(text: pd.Series) -> pd.Series:
    """Each sentence as one string of tokens joined by blanks."""
    return text.map(lambda t: [" ".join(s) for s in tokenize(t)])


@F.pandas_udf(T.StringType())
def _first_sentence(text: pd.Series) -> pd.Series:
    return text.map(lambda t: next((" ".join(s) for s in tokenize(t)), ""))


def tokenized_description(desc: Column) -> Column:
    """First tokenised sentence of the shortened description, '' where there is none."""
    return _first_sentence(squeeze(short_description(F.coalesce(desc, F.lit("")))))


_PAREN = regex.compile(r"\((?:[^()]|(?R))*\)(?!\|)")
_LINK = regex.compile(r"\[\[([^\[\]|]+)\|([^\[\]|]+)\]\]")


def repair_links(text: str) -> str:
    """Bracket repair, in this order: a link in a label with too many brackets, links without label, a link inside a
    label, letters glued to the right drawn into the label, letters glued to the left set apart.  Words of a label and of
    a link inside it stay words of their own."""
    text = regex.sub(r"\|([^\[\]]*)\[\[([^\[\]]+)\]\]\]\]", r"|\1 \2]]", text)
    text = regex.sub(r"\[\[[^\[\]|]+\|\]\]", "", text)
    text = regex.sub(r"\|([^\[\]]*)\[\[[^\[\]|]+\|([^\[\]]+)\]\]([^\[\]]*)\]\]", r"|\1 \2 \3]]", text)
    text = regex.sub(r"(\|[^\[\]]+?)\s*\]\]([^\s.,\-(){}\[\]]+)", r"\1\2]]", text)
    return regex.sub(r"(\S)(\[\[)", r"\1 \2", text)


def strip_parentheses(text: str) -> str:
    """Balanced parentheses out, by span; those directly before a bar belong to a link title and stay."""
    return _PAREN.sub("", text)


def title_key(title: str) -> str:
    t = title.strip().replace(" ", "_")
    return t[:1].upper() + t[1:]


def link_paragraph(paragraph: str | None, first_n: int = 0) -> list[dict]:
    """Sentences of a paragraph with their links.

    Links become marks, the text is tokenised, and the k-th mark gets the k-th label
    back; spans are inclusive token places.  Sentences: dicts ``sentence, links`` with
    links ``target, begin, end`` (target as title key).
    """
    text = strip_parentheses(repair_links(paragraph or ""))
    found = [(title_key(m.group(1)), [w for s in tokenize(m.group(2)) for w in s]) for m in _LINK.finditer(text)]
    marked = _LINK.sub(f" {LINK_MARK} ", text)
    out, k = [], 0
    sentences = tokenize(marked)
    for n, sent in enumerate(sentences):
        words, links = [], []
        for w in sent:
            if w == LINK_MARK and k < len(found):
                target, label = found[k]
                k += 1
                if label:
                    links.append({"target": target, "begin": len(words), "end": len(words) + len(label) - 1})
                    words += label
            else:
                words.append(w)
        if not first_n or n < first_n:
            out.append({"sentence": " ".join(BRACKET_TOKENS.get(w, w) for w in words), "links": links})
    return out


LINKED = "array<struct<sentence:string,links:array<struct<target:string,begin:int,end:int>>>>"


def linked_sentences(paragraph: Column, first_n: int = 0) -> Column:
    """``link_paragraph`` as a column."""

    @F.pandas_udf(LINKED)
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: link_paragraph(x, first_n))

    return run(paragraph)


#: Words too general to be a category when "of" follows.
ABSTRACT = frozenset(
    "kind sort one type name set series specie subspecie superfamily family genus component subclass class core title form "
    "suborder infraorder order head sequence".split()
)
#: Words that end the first noun phrase of a description.
STOPPERS = frozenset(
    "in of from for by at on to with near between and or who which that is are was were described known set built born "
    "about located based used made written published".split()
)
_WORD = re.compile(r"[A-Za-z][A-Za-z-]*|[^\sA-Za-z]+")


#: Singulars no ending rule gives.
IRREGULAR = {"species": "specie", "subspecies": "subspecie", "series": "series", "men": "man", "women": "woman", "people": "people"}


def singular(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    for end, to, least in (("ies", "y", 5), ("sses", "ss", 5), ("ches", "ch", 5), ("shes", "sh", 5), ("xes", "x", 4)):
        if w.endswith(end) and len(w) >= least:
            return w[: -len(end)] + to
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3 else w


def head_noun(desc: str | None) -> str:
    """Category of a description: the last word of its first noun phrase, '-' where there is none.

    A phrase before 's is passed over, and so is an abstract word before "of".
    Rule-based; a parser would differ on some inputs.
    """
    words = _WORD.findall(desc or "")
    if len(words) == 1:
        return words[0].lower()
    phrase: list[str] = []
    for i, w in enumerate(words + ["."]):
        nxt = words[i + 1] if i + 1 < len(words) else ""
        if w in ("'", "’") and nxt == "s" or w in ("'s", "’s"):
            phrase = []
            continue
        if w == "s" and phrase == [] and i and words[i - 1] in ("'", "’"):
            continue
        if w.lower() in STOPPERS or not w[:1].isalpha():
            nouns = [p for p in phrase if p.lower() not in ("the", "a", "an")]
            if nouns:
                head = singular(nouns[-1])
                if not (head in ABSTRACT and w.lower() == "of"):
                    return head
            phrase = []
            continue
        phrase.append(w)
    return "-"


@F.pandas_udf(T.StringType())
def head_nouns(desc: pd.Series) -> pd.Series:
    return desc.map(head_noun)
