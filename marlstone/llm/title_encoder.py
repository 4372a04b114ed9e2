"""Subword encoder of listings' wording, trained contrastively, and centroids of an inverted file over its vectors.

A wording is its words' character n-grams, hashed; its vector is the normalised sum of their embeddings. Training pulls a
wording and a corrupted copy (a letter changed, dropped, doubled or swapped; a word left out, moved or added from another wording)
together and pushes the others of the batch away, so that n-grams which many wordings share come to weigh little.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

BUCKETS = 1 << 13
DIM = 32
BATCH, STEPS, RATE, HEAT = 192, 160, 0.05, 0.12
LIKE = 0.5  # share of common n-grams from which two wordings of a batch are no negatives
SEED = 5


@lru_cache(maxsize=100_000)
def _grams(word: str) -> tuple[int, ...]:
    t = f"<{word}>"
    return tuple(zlib.crc32(t[i : i + n].encode()) % BUCKETS for n in (2, 3, 4) for i in range(len(t) - n + 1))


def subwords(text: str) -> list[int]:
    """Buckets of a text's words' character n-grams of 2 to 4 letters, word ends included."""
    return [g for w in text.split() for g in _grams(w)] or [0]


def corrupt(text: str, r: np.random.Generator, words_of: list[str] | None = None) -> str:
    """A copy as another seller would write it: one word misspelt, maybe one left out, one added of ``words_of``, and the order changed."""
    words = text.split()
    if len(words) > 1 and r.random() < 0.5:
        words.pop(int(r.integers(len(words))))
    at = [n for n, w in enumerate(words) if len(w) > 4]
    if at and r.random() < 0.5:
        n = at[r.integers(len(at))]
        w, k = words[n], int(r.integers(len(words[n])))
        kind = r.integers(4)
        j = max(k, 1)  # first and last letters take part in swaps too
        words[n] = w[:k] + w[k + 1 :] if kind == 0 else w[:k] + w[k] + w[k:] if kind == 1 else w[: j - 1] + w[j] + w[j - 1] + w[j + 1 :] if kind == 2 else w[:k] + chr(97 + int(r.integers(26))) + w[k + 1 :]
    if words_of and r.random() < 0.3:
        words.append(words_of[r.integers(len(words_of))])
    if len(words) > 1 and r.random() < 0.5:
        r.shuffle(words)
    return " ".join(words)


class Encoder:
    def __init__(self, table: np.ndarray):
        self.table = table.astype(np.float32)

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [subwords(t) for t in texts]
        lens = np.array([len(i) for i in ids])
        flat = np.fromiter((x for i in ids for x in i), dtype=np.int64, count=int(lens.sum()))
        return np.add.reduceat(self.table[flat], np.cumsum(lens) - lens) / np.sqrt(lens)[:, None], flat, lens

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, DIM), np.float32)
        v, _, _ = self.raw(texts)
        return (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype(np.float32)

    @classmethod
    def train(cls, texts: list[str]) -> Encoder:
        """Contrastive training on a bounded sample of distinct texts; with fewer than two the fresh embeddings stay."""
        r = np.random.default_rng(SEED)
        enc = cls(r.normal(0, 0.3, (BUCKETS, DIM)))
        if len(texts) < 2:
            return enc
        grad2 = np.full(BUCKETS, 1e-3)
        plain = cls(enc.table.copy())  # cosines of fresh embeddings are about the shares of common n-grams
        vocabulary = [w for t in texts[:2000] for w in t.split()]
        for _ in range(STEPS):
            pick = [texts[n] for n in r.choice(len(texts), min(BATCH, len(texts)), replace=False)]
            other = [corrupt(t, r, vocabulary) for t in pick]
            both, flat, lens = enc.raw(pick + other)
            norm = np.linalg.norm(both, axis=1, keepdims=True) + 1e-9
            u = both / norm
            n = len(pick)
            z = u[:n] @ u[n:].T / HEAT
            like = plain.encode(pick)
            z[(like @ like.T >= LIKE) & ~np.eye(n, dtype=bool)] = -np.inf  # maybe the same product; nothing to push away
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), np.arange(n)] -= 1
            p /= n * HEAT
            du = np.concatenate([p @ u[n:], p.T @ u[:n]])
            dv = (du - u * (u * du).sum(1, keepdims=True)) / norm / np.sqrt(lens)[:, None]
            g = np.zeros_like(enc.table)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            g[flat[order][first]] = np.add.reduceat(np.repeat(dv, lens, axis=0)[order], first)
            grad2 += (g**2).mean(1)
            enc.table -= (RATE * g / np.sqrt(grad2)[:, None]).astype(np.float32)
        return enc


def centroids(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    r = np.random.default_rng(SEED)
    c = v[r.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-9), c)
    return c.astype(np.float32)
