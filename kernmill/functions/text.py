"""Column expressions over ids, literals, titles, descriptions and spans; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations that carry literals.
NAME_REL = "<http://schema.org/name>"
DESC_REL = "<http://schema.org/description>"
AKA_REL = "<http://www.w3.org/2004/02/skos/core#altLabel>"

#: Bracket tokens of the tokenised text and what they stand for.
BRACKET_TOKENS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def entity_id(iri: Column, require_iri: bool = False) -> Column:
    """Id at the head of the last path segment of an IRI token (its final sign dropped), or ''.

    With ``require_iri`` literals that merely end like an IRI give ''.
    """
    tail = F.element_at(F.split(iri, "/"), -1)
    found = F.regexp_extract(F.substring(tail, F.lit(1), F.length(tail) - 1), "^([PQ][0-9]+)", 1)
    return F.when(iri.startswith("<"), found).otherwise("") if require_iri else found


def language_value(obj: Column, lang: str = "en", strict: bool = False) -> Column:
    """Text of a literal tagged with ``lang``, or ''.

    Tags that only begin with ``lang`` (en-gb) count as well unless ``strict``.
    """
    return F.regexp_extract(obj, rf'^"(.+)"\s*@{lang}' + ("(?![A-Za-z0-9-])" if strict else ""), 1)


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_description(desc: Column) -> Column:
    """Description without bracketed parts (greedy) and without what follows the first colon or semicolon."""
    out = desc
    for p in (r"\(.*\)", r"\[.*\]", r"\{.*\}"):
        out = F.regexp_replace(out, p, "")
    return F.regexp_replace(out, r"[:;].+$", "")


def usable_description(desc: Column) -> Column:
    """Non-empty and not about the source itself."""
    low = F.lower(desc)
    return F.coalesce((F.length(desc) > 0) & ~low.contains("wikipedia") & ~low.contains("wikimedia"), F.lit(False))


def title_key(title: Column) -> Column:
    """Blanks to underscores, first character upper case, the rest as it is."""
    t = F.replace(title, F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def page_url(base: str, page_id: Column) -> Column:
    return F.concat(F.lit(base + "?curid="), page_id.cast("string"))


def tokens(sentence: Column) -> Column:
    return F.split(sentence, " ")


def span_surface(sentence: Column, begin: Column, end: Column) -> Column:
    """Lower-cased words of an inclusive span; '' where it lies outside or is turned round."""
    n = F.greatest(end - begin + 1, F.lit(0))
    return F.lower(F.array_join(F.slice(tokens(sentence), F.greatest(begin, F.lit(0)) + 1, n), " "))


def highlight(sentence: Column, begin: Column, end: Column, mark: tuple[str, str] = ("\x1b[31m", "\x1b[0m")) -> Column:
    """The sentence with each word of the span between two marks."""
    on, off = mark
    return F.array_join(
        F.transform(tokens(sentence), lambda t, i: F.when((i >= begin) & (i <= end), F.concat(F.lit(on), t, F.lit(off))).otherwise(t)), " "
    )


def sentence_at(text: Column, para: Column, sent: Column) -> Column:
    """Sentence at zero-based places, null where there is none."""
    ok = (para >= 0) & (sent >= 0)
    return F.when(ok, F.get(F.get(text, para), sent))


def decode_escapes(text: Column) -> Column:
    """Decode ``\\\\uXXXX`` and ``\\\\UXXXXXXXX`` escapes and ``\\\\" \\\\n \\\\t \\\\\\\\``; other characters stay.

    Wide escapes become surrogate pairs, which the JSON reader joins.
    """
    wide = F.regexp_replace(text, r"\\U([0-9A-Fa-f]{8})", "\u0001$1\u0001")
    pieces = F.split(wide, "\u0001")

    def pair(p: Column, i: Column) -> Column:
        code = F.conv(p, 16, 10).cast("long") - 0x10000
        high, low = F.floor(code / 1024) + 0xD800, F.pmod(code, F.lit(1024)) + 0xDC00
        bmp = F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code + 0x10000), 4, "0")))
        both = F.concat(F.lit("\\u"), F.lower(F.hex(high)), F.lit("\\u"), F.lower(F.hex(low)))
        return F.when(i % 2 == 1, F.when(code < 0, bmp).otherwise(both)).otherwise(p)

    # most literals hold no escape and are passed on untouched
    raw = F.array_join(F.transform(pieces, pair), "")
    doc = F.concat(F.lit('{"v":"'), F.regexp_replace(F.regexp_replace(raw, r'(?<!\\)"', r'\\"'), r"[\x00-\x1f]", " "), F.lit('"}'))
    return F.when(text.contains("\\"), F.coalesce(F.from_json(doc, "v string")["v"], text)).otherwise(text)


def spread(seed: str, *cols: Column) -> Column:
    """Reproducible random order key, the same in every SQL engine."""
    return F.md5(F.concat(F.lit(seed), *[c.cast("string") for c in cols]))


def uniform(order_key: Column) -> Column:
    """A number in (0, 1) from an md5 order key."""
    return (F.conv(F.substring(order_key, 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
