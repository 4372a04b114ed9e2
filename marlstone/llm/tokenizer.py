"""Byte-pair encoding as a lazily determinised finite-state transducer.

A merge list fixes, for every prefix of a pre-token, exactly one last token of that prefix's encoding: a token t that ends
the prefix is it if and only if t and the last token of what stands before t form a valid pair, that is, encoding
their joined bytes gives exactly these two. So encoding is a left-to-right transduction. Its states are

    (the longest suffix of the input that begins some token, for each place inside that suffix from which a token could
    still start: the tokens that lead to that place and haven't been emitted)

States and arcs are made when first reached and kept, so that a running encoder only looks up (state, byte). What all
open paths have in common is emitted at once: the lookahead is bounded by the longest token. Decoding is streaming, with a
UTF-8 state machine that takes bytes token by token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split of text into pre-tokens that belongs to this vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
MAX_ARCS = 3_000_000


class Transducer:
    """Encoder of one vocabulary: {token bytes: id}, ids of multi-byte tokens rising in merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.single:
            raise ValueError("the vocabulary lacks a single byte")
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b))}
        self._pair_ok: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: (open suffix, ((length of the suffix from a start, tokens to that start not yet emitted), ...)).
        self._states: list[tuple] = [(b"", ((0, ()),))]
        self._ids = {self._states[0]: 0}
        self._arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _merge(self, word: bytes) -> list[int]:
        """Plain merging by rank; used for pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _valid(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self._pair_ok.get(key)
        if ok is None:
            ok = self._pair_ok[key] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the arc of a state and a byte: (next state, tokens emitted)."""
        suffix, opened = self._states[state]
        text = suffix + bytes([byte])
        grown = [(n + 1, toks) for n, toks in opened]
        here = None
        for n, toks in grown:  # longest first; exactly one token fits
            t = self.ranks.get(text[len(text) - n :])
            if t is not None and (not toks or self._valid(toks[-1], t)):
                here = toks + (t,)
                break
        if here is None:
            raise ValueError("no encoding reaches this place")
        live = [(n, toks) for n, toks in grown if text[len(text) - n :] in self.prefixes] + [(0, here)]
        # Emit what all open paths begin with, but keep each path's last token, which the next pair needs.
        common = 0
        shortest = min(len(toks) for _, toks in live)
        while common < shortest - 1 and len({toks[common] for _, toks in live}) == 1:
            common += 1
        emitted = live[0][1][:common]
        longest = live[0][0]
        key = (text[len(text) - longest :] if longest else b"", tuple((n, toks[common:]) for n, toks in live))
        nxt = self._ids.get(key)
        if nxt is None:
            nxt = self._ids[key] = len(self._states)
            self._states.append(key)
        arc = self._arcs[state << 8 | byte] = (nxt, emitted)
        return arc

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if not word:
            return ()
        if len(self._arcs) > MAX_ARCS:
            self._reset()
        state, out, arcs = 0, [], self._arcs
        for b in word:
            arc = arcs.get(state << 8 | b)
            if arc is None:
                arc = self._step(state, b)
            state, emitted = arc
            if emitted:
                out.extend(emitted)
        out.extend(self._states[state][1][-1][1])
        return tuple(out)


class Encoder:
    """Texts to ids. Distinct pre-tokens are remembered, up to a bound that only affects speed."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import regex

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fst = Transducer(ranks)
        self._split = regex.compile(PRETOKEN).findall
        self._words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and '' give []. Strings of special tokens are ordinary text; lone surrogates become U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        words, add = self._words, out.extend
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                try:
                    raw = w.encode()
                except UnicodeEncodeError:
                    raw = w.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                ids = self.fst.encode_word(raw)
                if len(w) <= 64:
                    words[w] = ids
            add(ids)
        return out


class Utf8Machine:
    """Incremental UTF-8 decoder: feed bytes, get the characters that are complete; ill-formed input gives U+FFFD."""

    def __init__(self) -> None:
        self.need = self.code = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        i = 0
        while i < len(data):
            b = data[i]
            if self.need == 0:
                i += 1
                self.low, self.high = 0x80, 0xBF
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    self.need, self.code = 1, b & 0x1F
                elif 0xE0 <= b <= 0xEF:
                    self.need, self.code = 2, b & 0x0F
                    self.low = 0xA0 if b == 0xE0 else 0x80
                    self.high = 0x9F if b == 0xED else 0xBF
                elif 0xF0 <= b <= 0xF4:
                    self.need, self.code = 3, b & 0x07
                    self.low = 0x90 if b == 0xF0 else 0x80
                    self.high = 0x8F if b == 0xF4 else 0xBF
                else:
                    out.append("�")
            elif self.low <= b <= self.high:
                i += 1
                self.code = self.code << 6 | b & 0x3F
                self.low, self.high = 0x80, 0xBF
                self.need -= 1
                if self.need == 0:
                    out.append(chr(self.code))
            else:  # the byte begins something new
                out.append("�")
                self.need = 0
        return "".join(out)

    def end(self) -> str:
        rest, self.need = ("�" if self.need else ""), 0
        return rest


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ids, piece by piece; each piece holds only complete characters."""
    m = Utf8Machine()
    for i in ids:
        if piece := m.feed(bytes_of[int(i)]):
            yield piece
    if piece := m.end():
        yield piece


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encoded(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """array<int> of ids; [] for null and empty texts."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return texts.map(e.encode)

    return ids(F.coalesce(text, F.lit("")))


def decoded(ids: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a column of ids; null ids give ''."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        b = encoder(vocabulary).fst.bytes_of
        return rows.map(lambda r: "" if r is None else "".join(decode_stream(r, b)))

    return text(ids)


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each document: one map over the scan, no shuffle."""
    return docs.select("doc_id", encoded(docs["text"], vocabulary).alias("ids"))
