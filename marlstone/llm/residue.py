"""Template residue, filler and error text in the place of a page's content.

Character n-gram models of filler (with unfilled template places), of error, gate and removal notices, and of natural text
give a log likelihood ratio at each character. Residue is localised by windows whose mean ratio is positive, and a page is
excluded by coverage: most of its title, price or main text lies in such windows. Which text is title, price and main text
is told by the page labeller, so mentions in replies, notes, scripts and furniture never count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_labeller as M
from .pages import hidden_notes, leaves

ORDERS = (2, 3, 4, 5)
BUCKETS = 1 << 16
FLOOR = 5e-6  # probability under which an n-gram tells nothing
WINDOW = 11  # characters; a window is judged for the character in its middle
RATIO = 0.1  # mean log ratio of a window that counts
FIELD_COVER = 0.85  # of a title or price, by filler
MIXED_COVER = (0.95, 0.4)  # of a title by either kind, and of that by filler
TEXT_COVER = 0.5  # of the main text
NOTICE_COVER = 0.6  # of title and text together, on pages without facts, price and replies
MODEL = os.path.join(os.path.dirname(__file__), "residue_model.npz")
FILLER, NOTICE = 0, 1
_SEP = 0x1F


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in lower case, each between separators; start of each text)."""
    clean = [" ".join(t.lower().split()) for t in texts]
    joined = "".join(f"\x1f{t}\x1f" for t in clean)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)  # digits are one
    lengths = np.array([len(t) + 2 for t in clean], dtype=np.int64)
    return c, np.cumsum(lengths) - lengths


def grams(c: np.ndarray) -> dict[int, np.ndarray]:
    """By order, the bucket of the n-gram that begins at each place."""
    out = {}
    h = np.full(len(c), 0x811C9DC5, dtype=np.uint32)
    for k in range(max(ORDERS)):
        h = (h[: len(c) - k] ^ c[k:]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out[k + 1] = (h % np.uint32(BUCKETS)).astype(np.int64)
    return out


class Ratios:
    """tables[kind, order] of log ratios against natural text, by bucket."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables.astype(np.float32)

    @classmethod
    def load(cls, path: str = MODEL) -> Ratios:
        with np.load(path) as z:
            return cls(z["tables"])

    @classmethod
    def fit(cls, filler: list[str], notices: list[str], natural: list[str]) -> Ratios:
        """Maximum likelihood n-gram frequencies; rare n-grams, under FLOOR, draw the ratio to 0."""
        def frequencies(texts: list[str]) -> list[np.ndarray]:
            c, _ = codes(texts)
            out = []
            for g in grams(c).values():
                out.append(np.bincount(g, minlength=BUCKETS) / max(1, len(g)))
            return out

        nat = frequencies(natural)
        t = np.zeros((2, len(ORDERS), BUCKETS))
        for k, texts in enumerate((filler, notices)):
            for o, f in enumerate(frequencies(texts)):
                t[k, o] = np.log((f + FLOOR) / (nat[o] + FLOOR))
        return cls(t)

    def cover(self, texts: list[str]) -> np.ndarray:
        """(texts, 3): share of each text's characters in windows of filler, of notices, and of either; 0 for blank texts."""
        out = np.zeros((len(texts), 3))
        if not texts:
            return out
        c, starts = codes(texts)
        ends = np.append(starts[1:], len(c))
        field = np.repeat(np.arange(len(texts)), ends - starts)
        place, begin, end = np.arange(len(c)), np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        masks = []
        g_of = grams(c)
        same = {o: field[: len(g)] == field[o - 1 :] for o, g in g_of.items()}
        lo, hi = np.maximum(place - WINDOW // 2, begin), np.minimum(place + WINDOW // 2 + 1, end)
        for k in range(2):
            r = np.zeros(len(c), dtype=np.float64)
            for o, (order, g) in enumerate(g_of.items()):
                v = self.tables[k, o][g] * same[order]
                # An n-gram speaks for its middle character.
                r[order // 2 : order // 2 + len(g)] += v / len(ORDERS)
            run = np.append(0.0, np.cumsum(r))
            masks.append((run[hi] - run[lo]) / (hi - lo) > RATIO)
        real = c != _SEP
        size = np.maximum(1, np.add.reduceat(real.astype(np.int64), starts))
        for k, m in enumerate((masks[0], masks[1], masks[0] | masks[1])):
            out[:, k] = np.add.reduceat((m & real).astype(np.int64), starts) / size
        return out


def fields(texts: list[str], roles: np.ndarray) -> tuple[str, str, str, bool]:
    """(title, price, main text, whether facts, a price or replies stand there) of a labelled page."""
    pick = lambda k: " ".join(t.strip() for t, r in zip(texts, roles) if r == k)
    return pick(M.TITLE), pick(M.PRICE), pick(M.TEXT), bool(((roles == M.FACT) | (roles == M.PRICE) | (roles == M.REPLY)).any())


def judge(pages: list[tuple[list[str], list[tuple[str, ...]]]], roles: list[np.ndarray], notes: list[str], ratios: Ratios) -> np.ndarray:
    """Whether each page is a case. ``notes`` is the text of noscript elements, which counts only on pages without content."""
    f = [fields(t, r) for (t, _), r in zip(pages, roles)]
    n = len(pages)
    every = ratios.cover([x[0] for x in f] + [x[1] for x in f] + [x[2] for x in f] + notes)
    title, price, text, note = every[:n], every[n : 2 * n], every[2 * n : 3 * n], every[3 * n :]
    out = np.zeros(len(pages), dtype=bool)
    for n, (ti, pr, te, facts) in enumerate(f):
        if not ti and not te and not facts:
            out[n] = bool(notes[n]) and note[n, 2] >= TEXT_COVER
        else:
            out[n] = (
                bool(ti) and (title[n, FILLER] >= FIELD_COVER or title[n, 2] >= MIXED_COVER[0] and title[n, FILLER] >= MIXED_COVER[1])
                or bool(pr) and price[n, FILLER] >= FIELD_COVER
                or bool(te) and text[n, 2] >= TEXT_COVER
                or not facts and (len(ti) * title[n, 2] + len(te) * text[n, 2]) / (len(ti) + len(te)) >= NOTICE_COVER
            )
    return out


_SHARED: dict[str, object] = {}


def models() -> tuple[M.Labeller, Ratios]:
    """The models of a worker process."""
    if not _SHARED:
        _SHARED["labeller"], _SHARED["ratios"] = M.Labeller.load(), Ratios.load()
    return _SHARED["labeller"], _SHARED["ratios"]  # type: ignore[return-value]


def labelled(batch: pd.DataFrame, html: str = "html") -> tuple[list, list[np.ndarray], np.ndarray]:
    """(pages, roles, cases) of a batch of pages."""
    net, ratios = models()
    raw = batch[html].tolist()
    pages = [leaves(h) for h in raw]
    roles = net.roles(pages)
    notes = [hidden_notes(h) if not r.any() else "" for h, r in zip(raw, roles)]
    return pages, roles, judge(pages, roles, notes, ratios)


SLICE = 512  # pages that are parsed and labelled together
ARROW_ROWS = "2048"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches of wide page rows small, for this session; a smaller setting stays."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= int(ARROW_ROWS):
        spark.conf.set(key, ARROW_ROWS)
    return df


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for s in range(0, len(b), SLICE):
            yield b.iloc[s : s + SLICE].reset_index(drop=True)


def find_residue(pages: DataFrame) -> DataFrame:
    """(row_id): pages whose title, price or main text is residue. Null, empty and blank html is none. One map, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            _, _, case = labelled(b)
            yield pd.DataFrame({"row_id": b["row_id"].to_numpy()[case]})

    return bounded_batches(pages).select("row_id", "html").filter("html is not null and trim(html) <> ''").mapInPandas(run, "row_id bigint")


def without_residue(pages: DataFrame) -> DataFrame:
    """The pages that are no cases, with all their columns; rows without html stay."""
    return pages.join(find_residue(pages), "row_id", "left_anti")


def main_body(pages: DataFrame) -> DataFrame:
    """(row_id, node_no): the leaves of the main body of pages that are no residue; node_no as in pages.leaves, from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            _, roles, case = labelled(b)
            ids, counts, nodes = b["row_id"].to_numpy(), [], []
            for r, c in zip(roles, case):
                at = np.zeros(0, dtype=np.int64) if c else np.flatnonzero(r) + 1
                counts.append(len(at))
                nodes.append(at)
            yield pd.DataFrame({"row_id": np.repeat(ids, counts), "node_no": np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)})

    return bounded_batches(pages).select("row_id", "html").filter("html is not null and trim(html) <> ''").mapInPandas(run, "row_id bigint, node_no bigint")


def main_text(pages: DataFrame) -> DataFrame:
    """(row_id, title, text): the main body's text, one line for each leaf; '' for residue and for pages without content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            parsed, roles, case = labelled(b)
            titles, texts = [], []
            for (t, _), r, c in zip(parsed, roles, case):
                titles.append("" if c else " ".join(x.strip() for x, k in zip(t, r) if k == M.TITLE))
                texts.append("" if c else "\n".join(x.strip() for x, k in zip(t, r) if k > 0))
            yield pd.DataFrame({"row_id": b["row_id"], "title": titles, "text": texts})

    return bounded_batches(pages).select("row_id", "html").mapInPandas(run, "row_id bigint, title string, text string")
