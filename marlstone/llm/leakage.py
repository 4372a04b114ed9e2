"""Evaluation texts that leak into training text.

Candidates come from an embedding of edit distance into Hamming distance: a random walk reads a window of words and
writes, at each step, the word under its pointer, which a random bit of (step, word) moves on or not. Windows at a small edit
distance write nearly the same, so bit-sampling (a few steps of the walk make a hash key) finds them, and repetitions with
other walks raise the recall. Windows are sized by the item; how many walks there are follows from a target recall, which is
simulated on damaged copies of the items themselves. Windows of up to three words are keys as they are, so that short
passages are met exactly.

Every candidate is verified by an exact edit alignment of the whole passage with the whole document: pieces of the passage are
chained in its order, changed, missing and foreign words cost, a piece costs, foreign text between pieces is free. The words that
the best chain matches must be half of the passage.

Documents are read once. The items' keys are a table that is joined; a bitmap of fixed size, made of them, keeps windows that can't
meet an item out of the shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_COVER = 0.5
OPENING_ITEMS = 2  # an opening line is one that so many items have
SHORT = 12  # words below which a passage is compared as a whole line, not as several sentences
TARGET_RECALL = 0.99  # of candidates, on damaged copies
DAMAGE, DAMAGED_SHARE, PIECES = 0.3, 0.75, 3  # of a damaged copy: changed words, share of the passage, pieces
MAX_WALKS = 8
SIMULATED = 256  # passages that are damaged, by hash order
SIEVE_BITS = 23  # of each of the bitmap's two halves
CHUNK = 1 << 20  # windows that are embedded at once
ENOUGH, ENOUGH_SHARE = 1.0, 0.01  # weight of a passage's keys that a document must meet: that of one key of its own, or this share of all
LONG = 4096  # words of a text above which it is aligned by itself
GAP, OPEN = 1, 4  # cost of a changed, missing or foreign word inside a piece and of a piece, a matched word being worth 2

_TAGS = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_JOINED = re.compile(r"[­​‌‍⁠﻿]|(?<=\w)['’ʼ](?=\w)")
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_PRIME = np.uint64(1099511628211)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words of a text, whatever its case, signs, white space and markup."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", html.unescape(_TAGS.sub(" ", text)))
    return _WORDS.findall(_JOINED.sub("", t).casefold())


_CODES: dict[str, int] = {}


def codes(tokens: list[str]) -> np.ndarray:
    """64-bit codes of words, never 0 or 1; a cache of bounded size spares the hashing of frequent words."""
    if len(_CODES) > 500_000:
        _CODES.clear()
    get, out = _CODES.get, np.empty(len(tokens), dtype=np.uint64)
    for n, w in enumerate(tokens):
        c = get(w)
        if c is None:
            c = _CODES[w] = max(2, xxhash.xxh64_intdigest(w))
        out[n] = c
    return out


def split_item(text: str | None) -> tuple[str, str]:
    """(first sentence, the rest without a closing question) of an item."""
    parts = _SENTENCE.split((text or "").strip())
    if len(parts) > 1 and parts[-1].rstrip().endswith("?"):
        parts = parts[:-1]
    return parts[0], " ".join(parts[1:])


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words): each item's passage without an opening line (a first sentence that several items share) and closing question.

    Items without words, null texts among them, have no row; neither have those of fewer than SHORT words that are nothing but an
    opening line of others or a question. Of rows with one item_id any counts; rows without an item_id have none.
    """

    @F.pandas_udf("struct<head:array<string>,rest:array<string>,question:boolean>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        two = [split_item(t) for t in texts]
        return pd.DataFrame({"head": [words(a) for a, _ in two], "rest": [words(b) for _, b in two], "question": [not b and a.rstrip().endswith("?") for a, b in two]})

    t = items.filter("item_id is not null").dropDuplicates(["item_id"]).select("item_id", parts(F.coalesce("text", F.lit(""))).alias("p"))
    t = t.select("item_id", "p.head", "p.rest", "p.question", F.array_join("p.head", " ").alias("line"))
    shared = t.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("rest") > 0).alias("opens")).filter(F.col("n") >= OPENING_ITEMS).select("line", F.lit(True).alias("opening"), "opens")
    t = t.join(shared, "line", "left")
    t = t.select("item_id", F.when(F.col("opening") & (F.size("rest") > 0), F.col("rest")).otherwise(F.concat("head", "rest")).alias("words"), (F.col("question") | (F.coalesce("opens", F.lit(False)) & (F.size("rest") == 0))).alias("bare"))
    return t.filter((F.size("words") >= SHORT) | ((F.size("words") > 0) & ~F.col("bare"))).select("item_id", "words")


def window_size(n: int) -> int:
    """Words of a window of a passage of ``n`` words: up to three words are one window, longer ones have windows of a fourth, ten words at most."""
    return n if n <= 3 else 2 if n < SHORT else 4 if n < 24 else 6 if n < 40 else 10


class Walk(NamedTuple):
    """One random walk over windows of ``size`` words: its number and the steps that make a key; none for windows taken as they are."""

    size: int
    seed: int
    steps: tuple[int, ...]


def walk(size: int, seed: int) -> Walk:
    if size <= 3:
        return Walk(size, seed, ())
    rng = np.random.default_rng([7, size, seed])
    return Walk(size, seed, tuple(int(s) for s in np.sort(rng.choice(2 * size, min(size, 3 + size // 3), replace=False))))


def _mixed(flat: np.ndarray, w: Walk) -> np.ndarray:
    """A number for each word that is this walk's own; its bits are those of (step, word)."""
    m = (flat ^ np.uint64((w.seed * 64 + w.size + 1) * int(_ODD) % (1 << 64))) * _PRIME
    m ^= m >> np.uint64(29)
    m *= _ODD
    return m ^ (m >> np.uint64(32))


def window_keys(flat: np.ndarray, starts: np.ndarray, w: Walk) -> np.ndarray:
    """The key of the window at each start: the sampled steps of the walk over it."""
    out = np.empty(len(starts), dtype=np.uint64)
    m = _mixed(flat, w)
    for lo in range(0, len(starts), CHUNK):
        p = starts[lo : lo + CHUNK]
        key = np.full(len(p), 1469598103934665603 + w.seed * 64 + w.size, dtype=np.uint64)
        if not w.steps:
            for k in range(w.size):
                key = (key ^ m[p + k]) * _PRIME
                key ^= key >> np.uint64(31)
        else:
            at = p.copy()
            end = p + w.size
            taken = set(w.steps)
            for step in range(w.steps[-1] + 1):
                v = m[np.minimum(at, end - 1)]
                v = np.where(at < end, v, np.uint64(0))
                if step in taken:
                    key = (key ^ v) * _PRIME
                    key ^= key >> np.uint64(31)
                at += ((v >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        out[lo : lo + CHUNK] = key
    return out


def _damaged(passage: list[str], r: np.random.Generator) -> list[str]:
    """A copy in pieces, in order, with words changed or left out and foreign words between."""
    n = len(passage)
    keep = max(1, round(n * DAMAGED_SHARE))
    pieces = min(PIECES, keep)
    cuts = np.sort(r.choice(np.arange(1, keep), pieces - 1, replace=False)) if pieces > 1 else []
    gaps = np.diff(np.concatenate([[0], np.sort(r.integers(0, n - keep + 1, pieces))]))
    out, at = [], 0
    for size, gap in zip(np.diff(np.concatenate([[0], cuts, [keep]])).astype(int), gaps):
        at += int(gap)
        out += ["", "", "", *[(w if r.random() >= DAMAGE else None if r.random() < 0.3 else "") for w in passage[at : at + size]]]
        at += size
    return [w for w in out if w is not None]


def choose_walks(sample: list[list[str]], sizes: list[int]) -> list[Walk]:
    """For each window size as few walks as find TARGET_RECALL of the damaged copies of the sample's passages, MAX_WALKS at most.

    Sizes of which the sample has no passage get MAX_WALKS; windows of up to three words are keys as they are.
    """
    out = []
    r = np.random.default_rng(11)
    for size in sizes:
        if size <= 3:
            out.append(walk(size, 0))
            continue
        mine = [codes(p) for p in sample if window_size(len(p)) == size]
        copies = [codes(_damaged(p, r)) for p in sample if window_size(len(p)) == size]
        met, total = np.zeros(len(mine)), np.zeros(len(mine))
        for seed in range(MAX_WALKS):
            w = walk(size, seed)
            out.append(w)
            keys = [window_keys(a, np.arange(len(a) - size + 1), w) for a in mine]
            held = Counter(k for ks in keys for k in set(ks.tolist()))
            for n, (ks, b) in enumerate(zip(keys, copies)):
                weight = np.array([1 / held[k] for k in ks.tolist()])
                total[n] += weight.sum()
                if len(b) >= size:
                    met[n] += weight[np.isin(ks, window_keys(b, np.arange(len(b) - size + 1), w))].sum()
            if len(mine) and np.mean(met >= np.minimum(ENOUGH, ENOUGH_SHARE * total)) >= TARGET_RECALL:
                break
    return out


def item_keys(passage: DataFrame, walks: list[Walk]) -> DataFrame:
    """(item_id, key, weight) of every window of every passage under every walk of its size; a key weighs one n-th if n items hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, keys = [], []
            for i, tokens in zip(b["item_id"], b["words"]):
                c, size = codes(list(tokens)), window_size(len(tokens))
                for w in walks:
                    if w.size == size:
                        keys.append(window_keys(c, np.arange(len(c) - size + 1), w))
                        ids += [i] * len(keys[-1])
            if keys:
                yield pd.DataFrame({"item_id": ids, "key": np.concatenate(keys).view(np.int64)})

    k = passage.mapInPandas(run, "item_id bigint, key bigint").groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("n"))
    held = k.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    return k.join(held, "key").select("item_id", "key", (F.col("n") / F.col("held")).alias("weight"))


def sieve(keys: DataFrame) -> np.ndarray:
    """Two packed bitmaps of 2**SIEVE_BITS places each, 2 MB whatever the number of items; windows both of whose places are empty meet no item.

    With very many items it fills up and lets more windows through to the join, which decides.
    """
    mask = (1 << SIEVE_BITS) - 1
    k = F.col("key")
    places = keys.select(F.explode(F.array(k.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(k, SIEVE_BITS).bitwiseAND(F.lit(mask)) + F.lit(mask + 1))).alias("p")).distinct()
    bits = np.zeros(2 << SIEVE_BITS, dtype=np.uint8)
    bits[places.toPandas()["p"].to_numpy()] = 1  # at most 2**(SIEVE_BITS + 1) places
    return np.packbits(bits, bitorder="little")


def _passing(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << SIEVE_BITS) - 1)
    a = key & mask
    b = ((key >> np.uint64(SIEVE_BITS)) & mask) + np.uint64(1 << SIEVE_BITS)
    on = (bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
    return np.flatnonzero(on)


def met_keys(docs: list[list[str]], walks: list[Walk], bits: np.ndarray) -> list[np.ndarray]:
    """For each document the distinct keys of its windows that the sieve lets through."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *[codes(d) for d in docs]])
    owner = np.repeat(np.arange(len(docs)), lengths)
    doc_at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sorted({w.size for w in walks}):
        if len(flat) < size:
            continue
        starts = np.flatnonzero(owner[: len(flat) - size + 1] == owner[size - 1 :])
        for w in (w for w in walks if w.size == size):
            k = window_keys(flat, starts, w)
            on = _passing(k, bits)
            doc_at.append(owner[starts[on]])
            keys.append(k[on])
    at, key = np.concatenate(doc_at), np.concatenate(keys)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(docs) + 1))
    return [np.unique(key[order[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _group(pairs: list[tuple[np.ndarray, np.ndarray]], dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passages, documents, costs of a piece, unit) of pairs, padded by codes that no word has, a pair in each column.

    A score counts units; its rest is the number of matched words, so that of equal chains the one with more words wins.
    """
    height, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item, doc = np.ones((height, len(pairs)), dtype=np.uint64), np.zeros((width, len(pairs)), dtype=np.uint64)
    for k, (a, b) in enumerate(pairs):
        item[: len(a), k], doc[: len(b), k] = a, b
    unit = 1 << int(height).bit_length()
    return item, doc, np.array([min(OPEN, 2 * len(a)) * unit for a, _ in pairs], dtype=dtype), unit


def _chains(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words matched by the best chain of each pair, by anti-diagonals of the table, all pairs side by side."""
    item, doc, opening, unit = _group(pairs, np.int32)
    n, width = item.shape[0], doc.shape[0]
    low = np.int32(-(1 << 30))
    # The document stands reversed between sentinels, so that the words which meet on a diagonal are slices.
    back = np.zeros((width + 2 * n, len(pairs)), dtype=np.uint64)
    back[n : n + width] = doc[::-1]
    shape = (n + 1, len(pairs))
    inside, inside2 = np.full(shape, low), np.full(shape, low)  # best chain whose last piece is open and ends here
    closed, closed2 = np.zeros(shape, np.int32), np.zeros(shape, np.int32)  # best chain of closed pieces up to here
    for d in range(2, n + width + 1):
        at = n + width + 1 - d  # row i of the passage meets word d - i of the document
        hit = back[at : at + n] == item
        new = np.full(shape, low)
        start = np.maximum(inside2[:-1], closed2[:-1] - opening) + np.int32(2 * unit + 1)
        step = np.maximum(np.maximum(inside[:-1], inside[1:]), inside2[:-1]) - np.int32(GAP * unit)
        np.maximum(np.where(hit, start, low), step, out=new[1:])
        np.maximum(new, low, out=new)
        done = closed.copy()
        np.maximum(done[1:], closed[:-1], out=done[1:])
        np.maximum(done, new, out=done)
        inside2, inside, closed2, closed = inside, new, closed, done
    return closed[-1] & (unit - 1)


def _chain_of_long(a: np.ndarray, b: np.ndarray) -> int:
    """The same for one long document, row by row of the passage."""
    item, doc, opening, unit = _group([(a, b)], np.int64)
    doc, low = doc[:, 0], np.int64(-(1 << 60))
    ramp = np.arange(len(doc), dtype=np.int64) * (GAP * unit)
    inside, closed = np.full(len(doc) + 1, low), np.zeros(len(doc) + 1, dtype=np.int64)
    for word in item[:, 0]:
        new = np.maximum(inside[:-1], inside[1:]) - GAP * unit
        np.maximum(new, np.where(doc == word, np.maximum(inside[:-1], closed[:-1] - opening[0]) + (2 * unit + 1), low), out=new)
        inside[1:] = np.maximum.accumulate(new + ramp) - ramp
        np.maximum(closed[1:], np.maximum.accumulate(inside[1:]), out=closed[1:])
    return int(closed[-1] & (unit - 1))


def covers(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each (passage, document) of word codes the share of the passage's words that the best chain of pieces matches.

    Exact dynamic programming over the whole passage and the whole document; pairs of like length share a run. A pair that has
    fewer than MIN_COVER of the passage's words in common at all has a cover of 0.
    """
    out = np.zeros(len(pairs))
    sets: dict[int, set] = {}
    rest = []
    for n, (a, b) in enumerate(pairs):
        have = sets.get(id(b))
        if have is None:
            have = sets[id(b)] = set(b.tolist())
        if len(a) and sum(map(have.__contains__, a.tolist())) >= MIN_COVER * len(a):
            if len(b) > LONG or len(a) > LONG:
                out[n] = _chain_of_long(a, b) / len(a)
            else:
                rest.append(n)
    rest.sort(key=lambda n: (len(pairs[n][0]) + len(pairs[n][1]), len(pairs[n][0])))
    for at in range(0, len(rest), 128):
        group = rest[at : at + 128]
        out[group] = _chains([pairs[n] for n in group]) / np.array([len(pairs[n][0]) for n in group])
    return out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cover): documents that carry at least half of an item's passage, in its order.

    Null and empty texts carry nothing; neither do rows without a doc_id. Each pair comes once; of rows with equal doc_id the best
    cover counts. Passages of up to three words must stand whole; of longer ones half of the words is enough.
    """
    spark = docs.sparkSession
    p = cut_lineage(passages(items))  # read four times below
    sizes = F.when(F.size("words") <= 3, F.size("words")).when(F.size("words") < SHORT, 2).when(F.size("words") < 24, 4).when(F.size("words") < 40, 6).otherwise(10)
    used = sorted(r.s for r in p.select(sizes.alias("s")).distinct().collect())  # five at most
    sample = p.orderBy(F.xxhash64("item_id"), "item_id").limit(SIMULATED).collect()
    walks = choose_walks([list(r.words) for r in sample], used)
    keys = cut_lineage(item_keys(p, walks))  # read three times below
    shared = spark.sparkContext.broadcast((walks, sieve(keys)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, bits = shared.value
        for b in batches:
            texts, at = b["text"].tolist(), 0
            while at < len(texts):  # slices of bounded length, of one document at least
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 4_000_000):
                    size += len(texts[end])
                    end += 1
                met = met_keys([words(t) for t in texts[at:end]], some, bits)
                on = [n for n, k in enumerate(met) if len(k)]
                if on:
                    yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[[at + n for n in on]], "text": [texts[at + n] for n in on], "keys": [met[n].view(np.int64) for n in on]})
                at = end

    if not walks:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, cover double")
    met = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    met = cut_lineage(met.mapInPandas(scan, "doc_id bigint, text string, keys array<bigint>"))  # documents that meet a key, read twice below
    near = met.select("doc_id", F.explode("keys").alias("key")).join(keys, "key").groupBy("doc_id", "item_id").agg(F.sum("weight").alias("met"))
    least = keys.groupBy("item_id").agg(F.least(F.lit(ENOUGH), ENOUGH_SHARE * F.sum("weight")).alias("least"))
    near = near.join(least, "item_id").filter(F.col("met") >= F.col("least") - 1e-9)
    pair = near.select("doc_id", "item_id").join(met.select("doc_id", "text"), "doc_id").join(p, "item_id").select("doc_id", "item_id", "text", F.col("words").alias("passage"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                read = {t: codes(words(t)) for t in set(part["text"])}
                c = covers([(codes(list(w)), read[t]) for w, t in zip(part["passage"], part["text"])])
                on = c >= MIN_COVER
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[on], "item_id": part["item_id"].to_numpy()[on], "cover": c[on]})

    return pair.mapInPandas(verify, "doc_id bigint, item_id bigint, cover double").groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"))
