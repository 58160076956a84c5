"""Byte-pair encoding by a lazily determinised transducer (problem 7).

Every prefix of a word has one encoding, and the encoding of a longer prefix ends
with the one token that is a suffix of it and may follow the encoding of what
stands before it.  A state of the transducer holds, since the last emitted token,
the candidate encodings of those prefixes at which a future token may still start;
reading a byte extends the one candidate that fits.  Tokens on which all
candidates agree are emitted, so the lookahead is bounded by the longest token.
States and transitions are built when first met and kept per Python worker.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Kept states and kept words of a worker; beyond them the caches start anew, results stay the same.
MAX_STATES, MAX_WORDS, MAX_WORD_CHARS = 120_000, 150_000, 24


def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule: printable bytes stand for themselves, others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[list[bytes], dict[tuple[int, int], int]]:
    """Token bytes by id and merges (left id, right id) -> id; ids of merges rise with their rank.

    Reads the JSON form (with merges) and the rank-file form (merges follow from the ranks).
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t)
        merges = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            merges[vocab[a], vocab[b]] = vocab[a + b]
        return tokens, merges
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {base64.b64decode(t): int(r) for t, r in pairs}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    merges = {}
    for t, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(t) > 1:
            parts = _merge_below(t, ranks, r)
            if len(parts) == 2:
                merges[ranks[parts[0]], ranks[parts[1]]] = r
    return tokens, merges


def _merge_below(word: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Words to ids.  A state is a dict: byte -> (state, emitted ids), END -> ids at the word's end."""

    END, KEY = 256, 257

    def __init__(self, tokens: list[bytes], merges: dict[tuple[int, int], int]):
        self.tokens, self.merges = tokens, merges
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t))}
        parts = {m: pair for pair, m in merges.items()}
        self._left, self._right = {}, {}
        self._parts = parts
        self._ok: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        self.states: dict[tuple, dict] = {}
        self.root = self._state(b"", -1, ((0, ()),))

    def _state(self, window: bytes, last: int, live: tuple) -> dict:
        key = (window, last, live)
        found = self.states.get(key)
        if found is None:
            found = {self.KEY: key, self.END: live[-1][1]}
            self.states[key] = found
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token and what it is made of along its outer edge: (part, rank at which the part is used up)."""
        memo = self._right if side else self._left
        found = memo.get(token)
        if found is None:
            found, used = [(token, float("inf"))], token
            while used in self._parts:
                part = self._parts[used][side]
                found.append((part, used))
                used = part
            memo[token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging would leave the border between tokens ``a`` and ``b`` alone.

        Walks the right edge of ``a`` and the left edge of ``b`` through merge time: two
        parts that face each other and form a merge due before either is used up would
        cross the border.  A tie goes to the merge further left.
        """
        known = self._ok.get((a, b))
        if known is not None:
            return known
        left, right = self._spine(a, 1), self._spine(b, 0)
        i, j, ok = len(left) - 1, len(right) - 1, True
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            m = self.merges.get((x, y))
            if m is not None and m < x_used and m <= y_used:
                ok = False
                break
            if x_used == y_used == float("inf"):
                break
            if x_used <= y_used:
                i -= 1
            else:
                j -= 1
        if len(self._ok) > 400_000:
            self._ok.clear()
        self._ok[a, b] = ok
        return ok

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        window, last, live = state[self.KEY]
        window += bytes((byte,))
        chain = None
        for start, before in live:
            t = self.ids.get(window[start:])
            if t is not None and (not (prev := before[-1] if before else last) >= 0 or self.may_follow(prev, t)):
                chain = (*before, t)
                break
        if chain is None:
            raise ValueError("vocabulary lacks a single byte")
        kept = [(s, c) for s, c in live if window[s:] in self.starts] + [(len(window), chain)]
        n = min(len(c) for _, c in kept)
        first = kept[0][1]
        agreed = 0
        while agreed < n and all(c[agreed] == first[agreed] for _, c in kept):
            agreed += 1
        out = first[:agreed]
        if out:
            cut = sum(len(self.tokens[t]) for t in out)
            window, last = window[cut:], out[-1]
            kept = [(s - cut, c[agreed:]) for s, c in kept]
        made = (self._state(window, last, tuple(kept)), out)
        state[byte] = made
        return made

    def encode_word(self, word: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self.reset()
        state, ids = self.root, []
        for b in word:
            state, out = state.get(b) or self._step(state, b)
            if out:
                ids.extend(out)
        ids.extend(state[self.END])
        return ids


class Encoder:
    """Texts to ids and back, with one transducer."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
        self.fst = Transducer(*load_vocabulary(path))
        self._words = regex.compile(pattern).findall
        self._memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for null and empty.  Control-token strings are ordinary text."""
        if not text:
            return []
        ids, memo = [], self._memo
        for w in self._words(text):
            known = memo.get(w)
            if known is None:
                known = self.fst.encode_word(w.encode())
                if len(w) <= MAX_WORD_CHARS:
                    if len(memo) > MAX_WORDS:
                        memo.clear()
                    memo[w] = known
            ids.extend(known)
        return ids

    def decode(self, ids) -> str:
        """Text of ``ids`` through the incremental decoder; broken sequences become U+FFFD."""
        d = Utf8Decoder()
        return "".join(d.feed(self.fst.tokens[i]) for i in ids) + d.end()


class Utf8Decoder:
    """Incremental UTF-8: feed bytes in any cuts, get the characters completed so far.

    State: bytes still missing, the value so far and the range allowed for the next
    byte, which rules out overlong forms, surrogates and values beyond U+10FFFF.
    """

    def __init__(self):
        self.missing, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.missing -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.missing = 0
            self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.missing, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.missing, self.value = 2, b & 0x0F
                self.low = 0xA0 if b == 0xE0 else 0x80
                self.high = 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.missing, self.value = 3, b & 0x07
                self.low = 0x90 if b == 0xF0 else 0x80
                self.high = 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken, self.missing = bool(self.missing), 0
        return "�" if broken else ""


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, ids``: the ids of each text; an empty list for null and empty texts.

    One narrow pass over the two columns named; every row gives one row, repeated
    ids included.  ``path`` must be readable on the executors.
    """

    def run(batches):
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` bigint, ids array<int>"
    )


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, n_tokens`` of each text, 0 for null and empty ones."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            n = [len(e.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` bigint, n_tokens bigint"
    )


def decode_ids(df: DataFrame, id_col: str = "doc_id", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, text``: texts of id lists; a null list gives the empty text."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = [e.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` bigint, text string")
