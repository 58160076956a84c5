"""Text decoded with the wrong character encoding (problem 4).

A chain is what happened to a text: encoded by one codec and decoded by another,
perhaps twice.  A multinomial classifier over hashed byte bigrams learns each chain
from records garbled on purpose, damage that has lost characters from such records
with some taken away, and the clean class from the records themselves.  At inference
the chains that the classifier holds for more likely than clean are inverted, the
likeliest first that inverts strictly, changes the text and reads better: for the
whole value, else for its words, else for single damaged sequences.  What no chain
inverts is still named if the classifier takes it for damage with losses or if it
holds replacement characters or stray control codes.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.session import hashed_sample

BUCKETS = 8192
#: Rows the classifier is fitted on, those with the smallest hashed row number.
TRAIN_ROWS = 3_000
MIN_ODDS_LEGACY = 4.0
#: Where few characters tell, and for Latin letters that become Latin letters, the odds must be better.
FEW_SIGNS, MIN_ODDS_SHORT, MIN_ODDS_LATIN = 6, 20.0, 30.0
#: and the restored text must be so much likelier as a clean one.
MIN_GAIN_FEW = 30.0
#: By how much the mean log probability must rise where a chain only swaps letters of one alphabet.
MIN_GAIN_SWAP = 1.5
MIN_ODDS_LOSSY = 12.0
PRIOR_STRICT_UTF8 = 7.0
#: Weight of the mean log probability of a restored text against the odds of its chain.
WEIGHT_EASE = 10.0

#: Fixed values: (codec of the text, codec it was decoded with), applied once or twice.
CHAINS = {
    "utf8-as-cp1252": (("utf-8", "cp1252"),),
    "utf8-as-latin1": (("utf-8", "latin-1"),),
    "utf8-as-macroman": (("utf-8", "mac_roman"),),
    "utf8-as-cp437": (("utf-8", "cp437"),),
    "utf8-as-cp850": (("utf-8", "cp850"),),
    "utf8-as-cp852": (("utf-8", "cp852"),),
    "utf8-as-cp866": (("utf-8", "cp866"),),
    "utf8-as-cp1250": (("utf-8", "cp1250"),),
    "utf8-as-cp1251": (("utf-8", "cp1251"),),
    "utf8-as-cp1253": (("utf-8", "cp1253"),),
    "utf8-as-cp1254": (("utf-8", "cp1254"),),
    "utf8-as-iso8859-15": (("utf-8", "iso8859-15"),),
    "utf8-as-koi8r": (("utf-8", "koi8-r"),),
    "utf8-as-gbk": (("utf-8", "gbk"),),
    "utf8-as-sjis": (("utf-8", "cp932"),),
    "utf8-as-big5": (("utf-8", "big5"),),
    "utf8-as-cp1252-twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8-as-latin1-twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8-as-macroman-twice": (("utf-8", "mac_roman"), ("utf-8", "mac_roman")),
    "cp1251-as-latin1": (("cp1251", "latin-1"),),
    "cp1251-as-cp1252": (("cp1251", "cp1252"),),
    "koi8r-as-latin1": (("koi8-r", "latin-1"),),
    "koi8r-as-cp1251": (("koi8-r", "cp1251"),),
    "cp1251-as-koi8r": (("cp1251", "koi8-r"),),
    "cp1253-as-latin1": (("cp1253", "latin-1"),),
    "sjis-as-cp1252": (("cp932", "cp1252"),),
    "sjis-as-latin1": (("cp932", "latin-1"),),
    "sjis-as-gbk": (("cp932", "gbk"),),
    "eucjp-as-latin1": (("euc-jp", "latin-1"),),
    "eucjp-as-cp1252": (("euc-jp", "cp1252"),),
    "gbk-as-latin1": (("gbk", "latin-1"),),
    "gbk-as-cp1252": (("gbk", "cp1252"),),
    "big5-as-latin1": (("big5", "latin-1"),),
    "euckr-as-latin1": (("euc-kr", "latin-1"),),
    "cp866-as-cp1251": (("cp866", "cp1251"),),
    "cp1250-as-latin1": (("cp1250", "latin-1"),),
    "cp1252-as-latin1": (("cp1252", "latin-1"),),
    "cp1252-as-macroman": (("cp1252", "mac_roman"),),
    "latin1-as-cp437": (("latin-1", "cp437"),),
}
CLEAN, LOSSY = "clean", "lossy"
CLASSES = (CLEAN, *CHAINS, LOSSY)
#: Codecs whose strict decoding says something; of a single-byte codec all but any bytes decode.
MULTI_BYTE = frozenset({"cp932", "euc-jp", "gbk", "big5", "euc-kr"})
#: Chains between two Western or Central European codecs.
LATIN_CHAINS = frozenset({"cp1250-as-latin1", "cp1252-as-macroman", "latin1-as-cp437"})
UTF8_CHAINS = frozenset(c for c in CHAINS if c.startswith("utf8"))
#: Chains through western codecs, where chance sequences are rare.
WESTERN = frozenset(
    "utf8-as-cp1252 utf8-as-latin1 utf8-as-macroman utf8-as-cp437 utf8-as-cp850 utf8-as-cp1254 utf8-as-iso8859-15 "
    "utf8-as-cp1252-twice utf8-as-latin1-twice utf8-as-macroman-twice".split()
)
#: Between these codecs letters stay letters of the same alphabet.
SWAPPING = frozenset({"koi8r-as-cp1251", "cp1251-as-koi8r", "cp866-as-cp1251"})
#: Codecs that leave bytes undefined; decoders in use pass those on as control codes.
LOOSE_CODECS = frozenset({"cp1250", "cp1251", "cp1252", "cp1253", "cp1254"})

_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")
_CUT_OFF = re.compile(rb"[\xc2-\xf4][\x80-\xbf]|^[\xc2-\xc5]$")
_DROPPED = re.compile("[\x80-\x9f\xad]")
_C1 = re.compile("[\x80-\x9f]")


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in LOOSE_CODECS or not _C1.search(text):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decode(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        if codec not in LOOSE_CODECS:
            return None
    return "".join(data[i : i + 1].decode(codec, "ignore") or chr(data[i]) for i in range(len(data)))


def garble(text: str, chain: str) -> str | None:
    """What ``chain`` makes of a text; None where it cannot apply or changes nothing."""
    out = text
    for own, wrong in CHAINS[chain]:
        try:
            data = out.encode(own)
        except UnicodeEncodeError:
            return None
        made = _decode(data, wrong)
        if made is None:
            return None
        out = made
    return out if out != text else None


def _plausible(text: str) -> bool:
    for ch in text:
        o = ord(ch)
        if o < 0x20 or 0x7F <= o < 0xA0 or o == 0xFFFD or 0xFF61 <= o <= 0xFFDC or 0x2500 <= o <= 0x25FF:
            return False
        if o > 0x2FF and unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs"):
            return False
    return True


def truncate(text: str) -> str | None:
    """A garbled text after losing what many programs drop: control codes and soft hyphens, hard blanks becoming blanks.

    One that has none loses its last non-ASCII character.  None where nothing is left of the damage.
    """
    out = _DROPPED.sub("", text).replace("\xa0", " ")
    if out == text:
        last = next((i for i in range(len(text) - 1, -1, -1) if text[i] > "\x7f"), 0)
        out = text[:last] + text[last + 1 :]
    return None if out.isascii() else out


def restore(text: str, chain: str, encoded: dict | None = None) -> str | None:
    """The text before ``chain``, if every step inverts strictly and the result is plausible.

    ``encoded`` keeps the text's bytes by codec over several calls.
    """
    out = text
    for own, wrong in reversed(CHAINS[chain]):
        if out is text and encoded is not None:
            data = encoded[wrong] if wrong in encoded else encoded.setdefault(wrong, _encode(text, wrong))
        else:
            data = _encode(out, wrong)
        if data is None:
            return None
        try:
            out = data.decode(own)
        except UnicodeDecodeError:
            return None
    return out if out != text and _plausible(out) else None


def _buckets() -> np.ndarray:
    """Bucket of every byte bigram; those of two ASCII bytes tell nothing and share one beyond the others."""
    pair = np.arange(1 << 16, dtype=np.uint32)
    hashed = ((pair * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(BUCKETS)
    return np.where(pair & 0x8080 == 0, BUCKETS, hashed).astype(np.uint16)


_BUCKET = _buckets()


def _strange(text: str) -> int:
    """Number of non-ASCII characters."""
    return len(text) - len(text.encode("ascii", "ignore"))


def _framed(text: str) -> bytes:
    return b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03"


def _hashed(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    return _BUCKET[(b[:-1].astype(np.uint16) << 8) | b[1:]]


def _features(text: str) -> np.ndarray:
    f = _hashed(_framed(text))
    return f[f != BUCKETS]


@dataclass
class Model:
    """Log probabilities: (bucket, class); verdicts on words are kept up to a bound."""

    weights: np.ndarray
    known: dict = field(default_factory=dict)
    #: The most that one bigram can speak for a chain.
    widest: float = 0.0

    def __post_init__(self):
        self.widest = float((self.weights[:, 1:-1] - self.weights[:, :1]).max())

    def scores(self, text: str) -> np.ndarray:
        """Log probability of a text under each class, from the byte bigrams alone."""
        return self.weights[_features(text)].sum(axis=0)

    def clean(self, text: str) -> float:
        """Log probability of a text under the clean class."""
        return float(self.weights[_features(text), 0].sum())

    def ease(self, text: str) -> float:
        """Mean log probability of a bigram under the clean class; 0 for plain ASCII."""
        f = _features(text)
        return float(self.weights[f, 0].sum()) / len(f) if len(f) else 0.0


def _counted(texts: list[tuple[int, str]], kept: np.ndarray) -> np.ndarray:
    """Bigram counts of (place, text) whose place is kept."""
    own = [_framed(t) for i, t in texts if kept[i]]
    return np.bincount(_hashed(b"".join(own)), minlength=BUCKETS + 1)[:BUCKETS] if own else np.zeros(BUCKETS)


def fit(values: list[str]) -> Model:
    """Fit on values most of which are clean; two rounds, the second without what the first finds garbled."""
    values = sorted({v for v in values if v and not v.isascii()})
    pool = [v for v in values if not _LOST.search(v) and not any(restore(v, c) for c in UTF8_CHAINS)]
    seen = [list(enumerate(pool)), *([(i, g) for i, v in enumerate(pool) if (g := garble(v, c)) is not None] for c in CHAINS)]
    single = [k for k, (c, steps) in enumerate(CHAINS.items(), 1) if c in WESTERN and len(steps) == 1]
    seen.append([(i, t) for k in single for i, g in seen[k] if (t := truncate(g))])
    kept = np.ones(len(pool), dtype=bool)
    for _ in range(2):
        counts = np.stack([0.05 + _counted(x, kept) for x in seen], axis=1)
        model = Model(np.log(counts / counts.sum(axis=0)).astype(np.float32))
        kept &= np.array([judge(v, model)[0] == CLEAN for v in pool], dtype=bool)
    return model


def _sequence_pattern(codec: str, leads_to: int = 0xF5) -> str:
    """Characters that a lead byte and a continuation byte of UTF-8 turn into under a single-byte codec."""
    as_set = lambda bs: "[" + re.escape("".join(_decode(bytes((b,)), codec) or "" for b in bs)) + "]"
    return as_set(range(0xC2, leads_to)) + as_set(range(0x80, 0xC0))


_ALPHABETS = (re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]"), re.compile("[\u0370-\u03ff]"), re.compile("[\u0400-\u052f]"),
              re.compile("[\u3041-\u30ff\u3400-\u9fff]"), re.compile("[\u1100-\u11ff\uac00-\ud7a3]"))


def _mixed(text: str) -> bool:
    """Whether a word mixes alphabets."""
    return any(sum(bool(a.search(w)) for a in _ALPHABETS) > 1 for w in re.split(r"[\s\W\d]+", text))


_RARE = re.compile("[\u0250-\u036f]")
_CASE_BREAK = re.compile("[\u0430-\u044f\u0451\u03ac-\u03ce][\u0410-\u042f\u0401\u0386-\u03ab]")
_WORD_SIGNS = frozenset(" -.,'\u2019\u30fb\u30fc()")


def _single_script(text: str) -> bool:
    """Words of one non-Latin script only: its letters, digits and the usual signs, no capital after a small letter."""
    hit = [bool(a.search(text)) for a in _ALPHABETS]
    if hit[0] or sum(hit) != 1 or _CASE_BREAK.search(text):
        return False
    return all(ch in _WORD_SIGNS or ch.isdigit() or any(a.match(ch) for a in _ALPHABETS) for ch in text)


#: Chain, a lead and its follower as they look after it, all lead signs of two-byte sequences (first that of Latin-1's signs, then letters).
_WESTERN_RUNS = [
    (c, re.compile(_sequence_pattern(w, 0xE0)), "".join(_decode(bytes((b,)), w) or "" for b in range(0xC2, 0xE0)))
    for c, ((_, w), *more) in CHAINS.items()
    if c in WESTERN and not more
]
_ANY_RUN = re.compile("|".join(p.pattern for _, p, _ in _WESTERN_RUNS))
#: Closing signs that may follow a genuine letter where the opening one stands in the text.
PAIRED = {"«": "»", "“": "”", "„": "“”", "‘": "’", "‹": "›"}

def _reads(text: str, fixed: str, chain: str, gain: float, lost: int) -> bool:
    """Whether a restored text may stand for the damaged one: it reads better (``gain``: of the mean for UTF-8 and swapping
    chains, else of the whole log probability), or several intact western sequences speak for it."""
    if _mixed(fixed):
        return False
    if chain == "cp1252-as-latin1":
        # control codes are never genuine
        return bool(_C1.search(text)) and not _C1.search(fixed)
    if chain in SWAPPING and gain > 0 and _CASE_BREAK.search(text) and not _CASE_BREAK.search(fixed):
        return True
    if chain in LATIN_CHAINS or chain in SWAPPING:
        return gain >= MIN_GAIN_SWAP and not _CASE_BREAK.search(fixed)
    if chain not in UTF8_CHAINS and not all(_single_script(w) for w in fixed.split(" ") if not w.isascii()):
        return False
    return gain > 0 or (chain in WESTERN and lost >= 2 and not _RARE.search(fixed))


def _whole(text: str, model: Model, few: bool = False, scores: np.ndarray | None = None) -> tuple[str, str | None]:
    """Most likely chain that inverts all of a text, and the text restored.

    Only chains that the classifier prefers to clean are inverted; with ``few``, where
    few characters tell, legacy chains must be multi-byte and their odds better.
    """
    scores = model.scores(text) if scores is None else scores
    odds = scores - scores[0]
    prior = _PRIOR_FEW if few else _PRIOR
    likely = np.flatnonzero(odds[1:-1] + prior > 0)
    if not len(likely):
        return CLEAN, None
    plain, encoded = model.ease(text), {}
    best = (-np.inf, CLEAN, None)
    for k in likely:
        c = _NAMES[k]
        fixed = restore(text, c, encoded)
        if fixed is None:
            continue
        gained, ease = model.ease(fixed), plain
        if c in SWAPPING:
            # a word in capitals reads no worse than in small letters
            gained, ease = model.ease(fixed.lower()), model.ease(text.lower())
        gain = gained - ease
        if c not in UTF8_CHAINS and c not in LATIN_CHAINS and c not in SWAPPING:
            gain = model.clean(fixed) - model.clean(text)
            if few and c != "cp1252-as-latin1" and (gain < MIN_GAIN_FEW or CHAINS[c][0][0] not in MULTI_BYTE):
                continue
        if not _reads(text, fixed, c, gain, _strange(fixed)):
            continue
        score = odds[k + 1] + (PRIOR_STRICT_UTF8 if c in UTF8_CHAINS else 0) + WEIGHT_EASE * gained
        if score > best[0]:
            best = (score, c, fixed)
    return best[1], best[2]


_NAMES = list(CHAINS)


def _priors(legacy: float) -> np.ndarray:
    return np.array([PRIOR_STRICT_UTF8 if c in UTF8_CHAINS or c == "cp1252-as-latin1" else -(max(legacy, MIN_ODDS_LATIN) if c in LATIN_CHAINS else legacy) for c in CHAINS])


_PRIOR, _PRIOR_FEW = _priors(MIN_ODDS_LEGACY), _priors(MIN_ODDS_SHORT)


_UTF8_RUN = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _intact(text: str) -> bool:
    """Whether some sequence of a western chain has stayed whole and decodes strictly."""
    for wrong in {CHAINS[c][-1][1] for c in WESTERN}:
        for run in _UTF8_RUN.findall(b"".join(ch.encode(wrong, "ignore") or b"?" for ch in text)):
            try:
                if not _RARE.search(made := run.decode()) and _plausible(made):
                    return True
            except UnicodeDecodeError:
                continue
    return False


def _still_damaged(words: list[str], chain: str) -> bool:
    """Whether words left as they are hold a lead of a western chain cut off from what follows it."""
    if chain not in WESTERN:
        return False
    wrong = CHAINS[chain][-1][1]
    rest = [b"".join(ch.encode(wrong, "ignore") for ch in w) for w in words if not w.isascii()]
    return any(_CUT_OFF.search(x) for x in rest)


def _cached_whole(word: str, model: Model) -> tuple[str, str | None]:
    """``_whole`` of a single word; words repeat far more than values."""
    said = model.known.get(word)
    if said is None:
        if len(model.known) > 50_000:
            model.known.clear()
        said = model.known[word] = _whole(word, model, True)
    return said


def _words(text: str, model: Model, odds: np.ndarray) -> tuple[str, str | None]:
    """Damage of some words only: first all non-ASCII words together, then each by itself.

    ``odds`` are those of the whole text.  All non-ASCII words together have its bigrams
    but for the four at their ends, so where no chain is near enough they need no look.
    """
    words = text.split(" ")
    strange = [i for i, w in enumerate(words) if not w.isascii()]
    if len(words) == 1:
        return CLEAN, None
    if len(strange) < len(words) and (odds[1:-1] + _PRIOR).max() > -4 * model.widest:
        joined = " ".join(words[i] for i in strange)
        # a short Latin word may consist of accented letters only
        chain, fixed = _whole(joined, model, _strange(joined) < FEW_SIGNS)
        parts = fixed.split(" ") if fixed else []
        if len(parts) == len(strange):
            for i, w in zip(strange, parts):
                words[i] = w
            return chain, " ".join(words)
    first, left = CLEAN, []
    for i in strange if len(strange) > 1 else ():
        chain, fixed = _cached_whole(words[i], model)
        if chain != CLEAN:
            words[i] = fixed
            first = chain if first == CLEAN else first
        else:
            left.append(words[i])
    if first == CLEAN:
        return CLEAN, None
    return (LOSSY, None) if _still_damaged(left, first) else (first, " ".join(words))


def _runs(text: str, model: Model) -> tuple[str, str | None]:
    """Intact two-byte sequences of a western chain between genuine or lossy signs."""
    if not _ANY_RUN.search(text):
        return CLEAN, None
    ease = model.ease(text)
    for chain, pattern, leads in _WESTERN_RUNS:
        hits = 0

        def undo(m, chain=chain):
            nonlocal hits
            run, end = m.group(), m.end()
            ends_word = end == len(text) or not text[end].isalnum()
            if ends_word and any(run[1] in PAIRED[o] for o in PAIRED if o in text):
                return run
            fixed = restore(run, chain)
            if fixed is None or "\u0180" <= fixed <= "\u036f" or run.isalpha() or not (fixed.isalpha() or run[0] == leads[0]):
                return run
            if run[0] not in leads[:2] and model.ease(text[: m.start()] + fixed + text[end:]) <= ease:
                return run
            hits += 1
            return fixed

        fixed = pattern.sub(undo, text)
        if hits and not _mixed(fixed):
            # a lead sign without its follower in a word with an intact sequence has lost it
            lone = any(ch in leads[:4] for w in text.split(" ") if pattern.search(w) for ch in pattern.sub("", w))
            return (LOSSY, None) if lone else (chain, fixed)
    return CLEAN, None


def judge(text: str | None, model: Model) -> tuple[str, str | None]:
    """(chain or 'clean' or 'lossy', restored text or None) of one value.

    Null, empty and ASCII values are clean.  'lossy' is damage that cannot be undone.
    """
    if not text or text.isascii():
        return CLEAN, None
    beside = any(w.isascii() and w.isalpha() for w in text.split(" "))
    few = beside and _strange(text) < FEW_SIGNS
    scores = model.scores(text)
    chain, fixed = _whole(text, model, few, scores)
    if chain == CLEAN:
        chain, fixed = _words(text, model, scores - scores[0])
    if chain != CLEAN:
        return (LOSSY, None) if fixed and _LOST.search(fixed) else (chain, fixed)
    if _LOST.search(text):
        return LOSSY, None
    chain, fixed = _runs(text, model)
    # losses must also be likelier than the text in small letters, as names in capitals are rare
    if chain == CLEAN and scores[-1] - scores[0] >= MIN_ODDS_LOSSY and scores[-1] - model.clean(text.lower()) >= MIN_ODDS_LOSSY and _intact(text):
        return LOSSY, None
    return chain, fixed


def train(items: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the name, desc and aka values of ``train_rows`` rows."""
    values = F.concat(F.array("name", "desc"), F.coalesce("aka", F.array().cast("array<string>")))
    rows = hashed_sample(items.select("row_id", *FIELDS), "row_id", train_rows).select(values.alias("v")).collect()
    return fit([x for r in rows for x in r["v"] if x])


FIELDS = ("name", "desc", "aka")
SCHEMA = "row_id bigint, field string, chain string, restored array<string>"


def find_garbled(items: DataFrame, model: Model) -> DataFrame:
    """``row_id, field, chain, restored``: one row per field with a garbled value.

    For aka any element counts; ``restored`` holds the field's values in order with
    what could be restored in place and null for what is lost; ``chain`` is that of
    the first garbled value.  Null rows, fields and elements are no case.
    """
    known = items.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        m = Model(known.value)
        memo: dict[str, tuple] = {}
        for b in batches:
            out: list[list] = [[], [], [], []]
            cols = [b.column(i).to_pylist() for i in range(4)]
            for rid, name, desc, aka in zip(*cols):
                for f, vals in zip(FIELDS, ((name,), (desc,), aka or ())):
                    if all(v is None or v.isascii() for v in vals):
                        continue
                    said = []
                    for v in vals:
                        if v not in memo:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[v] = judge(v, m)
                        said.append(memo[v])
                    hit = [c for c, _ in said if c != CLEAN]
                    if hit:
                        out[0].append(rid)
                        out[1].append(f)
                        out[2].append(hit[0])
                        out[3].append([v if c == CLEAN else r for v, (c, r) in zip(vals, said)])
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["row_id", "field", "chain", "restored"])

    narrow = items.select(F.col("row_id").cast("long"), *[F.col(c) for c in FIELDS])
    return narrow.mapInArrow(run, SCHEMA)
