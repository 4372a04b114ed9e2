"""Recurrent labeller of page blocks: a bidirectional LSTM in numpy reads a page's leaves in order.

Each leaf is a vector of its tag path (hashed tokens), its hashed words and a few shapes of its text. The two directions
give every block the context of the whole page, so that the same sentence is main text under a title and furniture in a
footer. Roles: furniture, title, price, fact (the table of facts with its labels), text (description, post), reply
(reviews, replies). The weights were trained here by train_pages.py and lie beside this file.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib

import numpy as np

FURNITURE, TITLE, PRICE, FACT, TEXT, REPLY = range(6)
ROLES = 6
PATH_BUCKETS, WORD_BUCKETS = 1024, 4096
PATH_DIM, WORD_DIM, SHAPES, HIDDEN = 16, 16, 10, 24
INPUT = PATH_DIM + WORD_DIM + SHAPES
WEIGHTS = os.path.join(os.path.dirname(__file__), "page_model.npz")
BATCH = 128
CELLS = 1 << 16  # leaves of a batch with its padding

_word_ids: dict[str, int] = {}
_path_ids: dict[tuple[str, ...], np.ndarray] = {}
_leaf_cache: dict[str, tuple[list[int], tuple[float, ...]]] = {}
_DIGITS = re.compile(r"\d")
CACHE = 200_000


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


def path_ids(path: tuple[str, ...]) -> np.ndarray:
    """Buckets of a path: its tokens as a set, and its last three by place."""
    ids = _path_ids.get(path)
    if ids is None:
        if len(_path_ids) > CACHE:
            _path_ids.clear()
        toks = path[-12:]
        keys = sorted(set(toks)) + [f"{n}:{t}" for n, t in enumerate(reversed(toks[-3:]))] + ["2:" + "/".join(toks[-2:])]
        ids = _path_ids[path] = np.array([_bucket(k, PATH_BUCKETS) for k in keys], dtype=np.int64)
    return ids


def word_id(word: str) -> int:
    """Bucket of a word (a run without white space); digits count by number only."""
    i = _bucket(_DIGITS.sub("0", word), WORD_BUCKETS)
    if len(_word_ids) > CACHE:
        _word_ids.clear()
    _word_ids[word] = i
    return i


def leaf_features(text: str) -> tuple[list[int], tuple[float, ...]]:
    """(word buckets, shapes) of a leaf's text."""
    hit = _leaf_cache.get(text)
    if hit is not None:
        return hit
    words = text.lower().split()
    get = _word_ids.get
    ids = [get(w) or word_id(w) for w in words]
    n = len(text)
    t = text.strip()
    first, last = t[:1], t[-1:]
    out = (ids, (math.log1p(n) / 5, min(len(words), 40) / 20, first.isdigit(), last in ".!?…", first.islower(), t.isupper(), first in "(|/©", n > len(t), last.isdigit(), first in "$€£₿"))
    if n < 60:
        if len(_leaf_cache) > CACHE:
            _leaf_cache.clear()
        _leaf_cache[text] = out
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """The network. Parameters: path and word embeddings, two LSTMs (gates i, f, o, g), one output layer."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in params.items()}

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Labeller:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    @classmethod
    def fresh(cls, seed: int = 0) -> Labeller:
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.1: r.normal(0, k, s)
        p = {"path": n(PATH_BUCKETS, PATH_DIM), "word": n(WORD_BUCKETS, WORD_DIM), "out": n(2 * HIDDEN, ROLES), "outb": np.zeros(ROLES)}
        for d in ("f", "b"):
            p["w" + d], p["u" + d], p["c" + d] = n(INPUT, 4 * HIDDEN, k=0.15), n(HIDDEN, 4 * HIDDEN, k=0.15), np.zeros(4 * HIDDEN)
            p["c" + d][HIDDEN : 2 * HIDDEN] = 1
        return cls(p)

    def inputs(self, pages: list[tuple[list[str], list[tuple[str, ...]]]]) -> dict:
        """Padded input tensor (time, page, INPUT) with all that the backward pass needs."""
        lengths = np.array([len(t) for t, _ in pages])
        # Distinct paths are few: each is summed once.
        seen: dict[tuple[str, ...], int] = {}
        which = np.array([seen.setdefault(q, len(seen)) for _, ps in pages for q in ps])
        paths = [path_ids(q) for q in seen]
        feats = [leaf_features(x) for ts, _ in pages for x in ts]
        pl = np.array([len(a) for a in paths])
        wl = np.array([len(a) for a, _ in feats])
        pflat, wflat = np.concatenate(paths), np.fromiter(itertools.chain.from_iterable(a for a, _ in feats), dtype=np.int64, count=int(wl.sum()))
        ps, ws = np.cumsum(pl) - pl, np.cumsum(wl) - wl
        x = np.concatenate([np.add.reduceat(self.p["path"][pflat], ps)[which], np.add.reduceat(self.p["word"][wflat], ws) / np.sqrt(wl)[:, None].astype(np.float32), np.array([s for _, s in feats], dtype=np.float32)], axis=1)
        T, B = int(lengths.max()), len(pages)
        row = np.repeat(np.arange(B), lengths)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid = np.zeros((T, B, INPUT), dtype=np.float32)
        grid[col, row] = x
        mask = np.arange(T)[:, None] < lengths[None, :]
        return {"x": grid, "mask": mask, "row": row, "col": col, "pflat": pflat, "wflat": wflat, "which": which, "pl": pl, "wl": wl, "lengths": lengths}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction; padded places keep the state, so the backward direction starts at each page's end."""
        T, B, _ = x.shape
        z = (x.reshape(T * B, INPUT) @ self.p["w" + d] + self.p["c" + d]).reshape(T, B, 4 * HIDDEN)
        U = self.p["u" + d]
        h, c = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
        hs, saved = np.zeros((T, B, HIDDEN), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = z[t] + h @ U
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                saved.append((t, i, f, o, g, c, h, tc, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            hs[t] = h
        return hs, saved

    def logits(self, pages: list) -> tuple[np.ndarray, dict]:
        """Logits of all leaves of the pages, in order; pages must have leaves."""
        b = self.inputs(pages)
        hf, _ = self.run(b["x"], b["mask"], "f")
        hb, _ = self.run(b["x"], b["mask"], "b")
        h = np.concatenate([hf[b["col"], b["row"]], hb[b["col"], b["row"]]], axis=1)
        return h @ self.p["out"] + self.p["outb"], b

    def roles(self, pages: list[tuple[list[str], list[tuple[str, ...]]]]) -> list[np.ndarray]:
        """Role of each leaf of each page; pages are batched by length."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(pages)
        order = sorted((n for n in range(len(pages)) if pages[n][0]), key=lambda n: len(pages[n][0]))
        s = 0
        while s < len(order):
            part = order[s : s + BATCH]
            while len(part) > 1 and len(part) * len(pages[part[-1]][0]) > CELLS:  # padding is bounded, too
                part = part[: len(part) // 2]
            s += len(part)
            z, b = self.logits([pages[n] for n in part])
            best = z.argmax(1)
            at = 0
            for n, length in zip(part, b["lengths"]):
                out[n] = best[at : at + length]
                at += length
        return out
