"""Abusive, hateful or sexual language: a calibrated score for each document, and rates by source.

Gradient-boosted trees over dense features: densities of general word lists and their closeness to each other and to the second
person, in windows of words that don't cross sentences; capitals, punctuation, and rates of words that are disguised (digits
for letters, starred, spaced, stretched) and belong to a list once undisguised; and the density of words and word pairs that the
labelled documents show to go with a label (log odds, learned out of fold). Trees and isotonic calibration are fitted on a bounded
sample of labelled documents, whose copies without the learned densities teach the trees to judge unseen wording by the lists.
Scoring is one map over all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import boosting
from .abuse_examples import EXAMPLES
from .lexicons import LISTS, NAMES, PHRASES

LABELS = ["abuse", "hate", "sexual"]
MAX_LABELLED = 20_000  # labelled documents that are fitted on, by hash order
WINDOW = 12
CUT = 0.5
FOLDS = 4
SLOTS = 1 << 17  # of the learned table
LEAST_DOCS = 3  # labelled documents that must hold a learned word
SURE = 2.5  # standard errors by which its odds must differ
MOST_ODDS = 4.0  # log odds of one word or pair at most
EXAMPLE_WEIGHT = 4.0
UNSEEN_WEIGHT = 0.5  # of a labelled document's copy without the learned densities; of those with no label every third is copied

_K = {k: n for n, k in enumerate(NAMES)}
_STRONG = sum(1 << _K[k] for k in ("insult", "violence", "dehumanise", "explicit", "belittle"))
_EXACT: dict[str, int] = {}
_STEMS: dict[str, int] = {}
for _name, _list in LISTS.items():
    for _w in _list:
        _at = _STEMS if _w.endswith("*") else _EXACT
        _at[_w.rstrip("*")] = _at.get(_w.rstrip("*"), 0) | 1 << _K[_name]
_STEM_SIZES = sorted({len(s) for s in _STEMS}, reverse=True)
_PHRASES = {tuple(p.split()): 1 << _K[k] for k, ps in PHRASES.items() for p in ps}
_PHRASE_SIZES: dict[str, list[int]] = {}
for _p in _PHRASES:
    _PHRASE_SIZES[_p[0]] = sorted({len(_p), *_PHRASE_SIZES.get(_p[0], [])})
_LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![\w'])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![\w'])")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-*@$!|.][^\W_]+|\*+[^\W_]+)*|[.!?\n;]+")
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[\d@$!|*.€]")
_STRETCH = re.compile(r"(\w)\1{2,}")
_TAGS = re.compile(r"<[/!?a-zA-Z][^<>]*>|https?://\S+")
# Words by first letter, length and last letter, for starred ones; only the lists that a disguise hides.
_MASKED: dict[tuple[str, int, str], int] = {}
for _w, _b in [*_EXACT.items(), *_STEMS.items()]:
    if _b & _STRONG and len(_w) > 2:
        _MASKED[_w[0], len(_w), _w[-1]] = _MASKED.get((_w[0], len(_w), _w[-1]), 0) | _b


def _listed(w: str) -> int:
    """Bits of the lists that hold a word as it is or by its stem."""
    b = _EXACT.get(w, 0)
    for n in _STEM_SIZES:
        if n <= len(w):
            b |= _STEMS.get(w[:n], 0)
    return b


def _read(token: str) -> tuple[int, bool, str]:
    """List bits of a token, whether it had to be undisguised, and its plain writing."""
    b = _listed(token)
    if b:
        return b, False, token
    if "*" in token:
        b = _MASKED.get((token[0], len(token), token[-1]), 0)
        return b, b > 0, token
    if _ODD.search(token) and any(c.isalpha() for c in token):
        t = token.translate(_LEET).replace(".", "")
        b = _listed(t)
        if b:
            return b, True, t
    if _STRETCH.search(token):
        for keep in (r"\1", r"\1\1"):
            t = _STRETCH.sub(keep, token)
            b = _listed(t)
            if b:
                return b, True, t
    if "-" in token or "'" in token or "’" in token:
        for p in _WORD.findall(token):
            b |= _listed(p)
    return b, False, token


_KNOWN: dict[str, tuple[int, bool, str, int]] = {}


def _known(token: str) -> tuple[int, bool, str, int]:
    """A token's reading and code; kept for words seen before, in a table of bounded size."""
    got = _KNOWN.get(token)
    if got is None:
        if len(_KNOWN) > 300_000:
            _KNOWN.clear()
        b, odd, plain = _read(token)
        got = _KNOWN[token] = (b, odd and b & _STRONG > 0, plain, zlib.crc32(plain.encode()))
    return got


def tokens(text: str) -> tuple[list[int], list[int], int, int, int, int]:
    """(bits of each word, its code, disguised words, capital words, loud marks, words); bits of -1 stand for an end of a sentence."""
    t = _TAGS.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
    spaced = 0

    def join(m: re.Match) -> str:
        nonlocal spaced
        spaced += 1
        return re.sub(r"[ .\-_*]", "", m.group(0))

    t = _SPACED.sub(join, t)
    bits: list[int] = []
    code: list[int] = []
    plain: list[str] = []
    odd = caps = words = 0
    for tok in _TOKEN.findall(t):
        if tok[0] in ".!?\n;":
            bits.append(-1)
            code.append(0)
            plain.append("")
            continue
        words += 1
        caps += len(tok) > 2 and tok.isupper()
        b, o, p, c = _known(tok.lower())
        bits.append(b)
        code.append(c)
        plain.append(p)
        odd += o
    for n, w in enumerate(plain):
        for size in _PHRASE_SIZES.get(w, ()):
            b = _PHRASES.get(tuple(plain[n : n + size]))
            if b:
                for k in range(n, n + size):
                    bits[k] |= b
    return bits, code, odd, caps, t.count("!!") + t.count("??") + t.count("?!") + spaced, words


_PAIRS = [
    ("insult", "you"), ("insult", "person"), ("insult", "belittle"), ("insult", "me"), ("insult", "thing"), ("insult", "report"), ("belittle", "you"), ("belittle", "person"), ("belittle", "thing"), ("violence", "you"), ("violence", "person"), ("violence", "injury"),
    ("violence", "report"), ("injury", "you"), ("group", "dehumanise"), ("group", "exclude"), ("group", "belittle"), ("group", "violence"), ("group", "report"), ("group", "care"), ("group", "collective"), ("collective", "dehumanise"), ("collective", "exclude"),
    ("sensual", "explicit"), ("sensual", "you"), ("sensual", "me"), ("sensual", "person"), ("sensual", "care"), ("explicit", "care"), ("explicit", "report"),
]
# What one list has in a window beyond others.
_LESS = [("insult", ("thing", "report", "me")), ("violence", ("thing", "report")), ("sensual", ("care", "report")), ("explicit", ("care", "report")), ("dehumanise", ("thing", "care", "report")), ("exclude", ("care", "report"))]
# Lists that are taken together, and in which company: (of these, beside these, beyond these).
_TOGETHER = {
    "attack": (("insult", "belittle", "violence", "injury"), (), ("thing", "report", "me", "care")), "attack_on": (("insult", "belittle", "violence", "injury"), ("you", "person"), ("thing", "report")),
    "scorn": (("dehumanise", "exclude", "belittle", "violence"), ("group",), ("report", "care")), "scorn_of_them": (("dehumanise", "exclude", "belittle"), ("group", "collective"), ("report", "care", "you")),
    "lewd": (("sensual", "explicit"), (), ("care", "report", "thing")), "lewd_person": (("sensual", "explicit"), ("you", "me", "person"), ("care", "report", "thing")),
}
# Lists that tell something by themselves; the others do only beside them.
_ALONE = ["insult", "belittle", "violence", "injury", "group", "dehumanise", "exclude", "sensual", "explicit"]
DENSE = [f"{k}_most" for k in _ALONE] + [f"{k}_density" for k in _ALONE] + [f"{a}_{b}" for a, b in _PAIRS] + [f"{a}_less" for a, _ in _LESS] + list(_TOGETHER) + ["disguised", "disguised_rate", "capitals", "loud", "words"]
FEATURES = DENSE + [f"learned_{k}_{w}" for k in LABELS for w in ("most", "sentence", "unreported")]


def grams(code: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the learned table of each word and of each pair of words that no end of a sentence parts; -1 where there is none."""
    c = code.astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOTS
    one = np.where(inside, mix(c + np.uint64(1)), -1)
    two = np.full(len(c), -1, dtype=np.int64)
    if len(c) > 1:
        two[:-1] = np.where(inside[:-1] & inside[1:], mix(c[:-1] * np.uint64(1000003) + c[1:] + np.uint64(7)), -1)
    return one, two


class Learned:
    """Log odds of words and word pairs that go with a label: a table of SLOTS by labels, 0 where the labels show nothing sure."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.table = np.zeros((SLOTS + 1, len(LABELS)), dtype=np.float32)  # the last row is for -1
        if not rows:
            return
        at = np.concatenate(rows)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        every = np.bincount(at, minlength=SLOTS).astype(float)
        for k in range(len(LABELS)):
            pos = y[:, k].sum()
            neg = len(y) - pos
            with_label = np.bincount(at, weights=y[doc, k], minlength=SLOTS)
            rest = every - with_label
            odds = np.log((with_label + 0.5) / (pos + 1)) - np.log((rest + 0.5) / (neg + 1))
            error = np.sqrt(1 / (with_label + 0.5) + 1 / (rest + 0.5))
            sure = (every >= LEAST_DOCS) & (np.abs(odds) / error >= SURE)
            self.table[:-1, k] = np.where(sure, np.clip(odds, -MOST_ODDS, MOST_ODDS), 0)


def features(texts: list[str | None], learned: Learned | None = None) -> np.ndarray:
    """One row of FEATURES for each text; zeros for null and empty texts, and for the learned ones without a table.

    Whole texts count. The words of all texts are laid out in one row, with gaps of a window's length between sentences.
    """
    out = np.zeros((len(texts), len(FEATURES)))
    read = [(n, *tokens(t)) for n, t in enumerate(texts) if t]
    read = [r for r in read if r[6]]
    if not read:
        return out
    row = np.array([r[0] for r in read])
    length = np.array([len(r[1]) for r in read])
    bits = np.concatenate([np.array(r[1], dtype=np.int64) for r in read])
    code = np.concatenate([np.array(r[2], dtype=np.int64) for r in read])
    words = np.array([r[6] for r in read], dtype=float)
    inside = bits >= 0
    first = np.zeros(len(bits), dtype=bool)
    first[np.cumsum(length)[:-1]] = True
    place = WINDOW + np.arange(len(bits)) + np.cumsum(~inside | first) * WINDOW
    start = place[np.cumsum(length) - length]
    size = int(place[-1]) + 1 + WINDOW
    b = np.where(inside, bits, 0)
    windows: dict[str, np.ndarray] = {}
    head = np.cumsum(length) - length

    def near(values: np.ndarray) -> np.ndarray:
        grid = np.zeros(size + 1, dtype=np.float32 if values.dtype.kind == "f" else np.int32)
        grid[place + 1] = values
        run = grid.cumsum(dtype=np.float64 if values.dtype.kind == "f" else np.int32)
        return run[WINDOW:] - run[:-WINDOW]

    idx = {f: i for i, f in enumerate(FEATURES)}
    # A text's windows start up to a window's length before it, where no other text reaches since gaps are as long.
    most = lambda w: np.maximum.reduceat(w, start - WINDOW + 1)
    for k, name in enumerate(NAMES):
        hit = ((b >> k) & 1).astype(np.int32)
        windows[name] = near(hit)
        if name in _ALONE:
            out[row, idx[f"{name}_most"]] = most(windows[name])
            out[row, idx[f"{name}_density"]] = np.add.reduceat(hit, head) / words
    for a, c in _PAIRS:
        out[row, idx[f"{a}_{c}"]] = most(np.minimum(windows[a], windows[c]))
    for a, less in _LESS:
        out[row, idx[f"{a}_less"]] = np.maximum(0, most(windows[a] - sum(windows[c] for c in less)))
    for f, (of, beside, beyond) in _TOGETHER.items():
        w = sum(windows[a] for a in of)
        if beside:
            w = np.minimum(w, 2 * sum(windows[a] for a in beside))
        out[row, idx[f]] = np.maximum(0, most(w - sum(windows[a] for a in beyond)))
    out[row, idx["disguised"]] = [r[3] for r in read]
    out[row, idx["disguised_rate"]] = out[row, idx["disguised"]] / words
    out[row, idx["capitals"]] = np.array([r[4] for r in read]) / words
    out[row, idx["loud"]] = [r[5] for r in read]
    out[row, idx["words"]] = np.minimum(words, 500)
    if learned is not None:
        joined = inside.copy()
        joined_next = np.append(~first[1:], False)  # the last word of a text pairs with none
        one, two = grams(code, joined)
        two = np.where(joined_next, two, -1)
        weight = learned.table[one] + learned.table[two]
        begins = first | np.append(True, ~inside[:-1])
        sentence = np.flatnonzero(begins)
        text_of_sentence = np.searchsorted(sentence, head)
        reports = np.add.reduceat((b >> _K["report"]) & 1, sentence)
        for k, lab in enumerate(LABELS):
            for_it = np.maximum(weight[:, k], 0)
            out[row, idx[f"learned_{lab}_most"]] = most(near(for_it))
            # The sentence for which most speaks, less what speaks against it; and that among those which report nothing.
            total = np.add.reduceat(weight[:, k], sentence)
            out[row, idx[f"learned_{lab}_sentence"]] = np.maximum.reduceat(total, text_of_sentence)
            out[row, idx[f"learned_{lab}_unreported"]] = np.maximum.reduceat(np.where(reports > 0, 0, total), text_of_sentence)
    return out


def slots(text: str | None) -> np.ndarray:
    """The distinct places of a text's words and word pairs in the learned table."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    bits, code, *_ = tokens(text)
    one, two = grams(np.array(code, dtype=np.int64), np.array(bits, dtype=np.int64) >= 0)
    u = np.unique(np.concatenate([one, two]))
    return u[u >= 0]


class Model:
    """One ensemble and one calibration for each label, and the table of learned words."""

    def __init__(self, texts: list[str], y: np.ndarray, group: np.ndarray):
        """``group`` is each row's document: a document's rows lie in one fold."""
        known = [t for ts in EXAMPLES.values() for t in ts]
        ky = np.array([[float(k == lab) for lab in LABELS] for k, ts in EXAMPLES.items() for _ in ts])
        kx = features(known)
        self.learned = Learned([slots(t) for t in texts], y)
        fold = np.array([zlib.crc32(str(g).encode()) % FOLDS for g in group], dtype=np.int64)
        bare = features(texts)
        seen = bare.copy()
        rows = [slots(t) for t in texts]
        for f in range(FOLDS):
            mine = np.flatnonzero(fold == f)
            if len(mine):
                rest = np.flatnonzero(fold != f)
                seen[mine] = features([texts[n] for n in mine], Learned([rows[n] for n in rest], y[rest]))
        copied = np.flatnonzero((seen != bare).any(1) & (y.any(1) | (np.arange(len(y)) % 3 == 0))) if len(texts) else np.zeros(0, dtype=np.int64)
        x = np.concatenate([kx, seen, bare[copied]])
        yy = np.concatenate([ky, y, y[copied]]) if len(texts) else ky
        weight = np.concatenate([np.full(len(kx), EXAMPLE_WEIGHT), np.ones(len(seen)), np.full(len(copied), UNSEEN_WEIGHT)])
        where = np.concatenate([np.arange(len(kx)) % FOLDS, fold, fold[copied]])
        real = np.concatenate([np.ones(len(kx) + len(seen), dtype=bool), np.zeros(len(copied), dtype=bool)])
        self.trees, self.curves = [], []
        for k in range(len(LABELS)):
            held = np.zeros(len(x))
            for f in range(FOLDS):
                inside = where != f
                held[~inside] = boosting.fit(x[inside], yy[inside, k], weight[inside]).margin(x[~inside])
            self.curves.append(boosting.isotonic(held[real], yy[real, k], weight[real]))
            self.trees.append(boosting.fit(x, yy[:, k], weight))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.learned)
        return np.stack([c(t.margin(x)) for t, c in zip(self.trees, self.curves)], axis=1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled documents and the written examples. Annotators' views of one document are rows of their own.

    Labels without a document, document id or label are left out; an empty table of labels leaves the examples.
    """
    views = labels.filter("doc_id is not null and label is not null").groupBy("doc_id", F.coalesce("annotator", F.lit("")).alias("annotator")).agg(F.collect_set("label").alias("ls"))  # at most four labels
    chosen = views.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    views = F.broadcast(cut_lineage(views.join(chosen, "doc_id", "left_semi")))  # at most MAX_LABELLED documents, so that no text is shuffled for them
    rows = docs.select("doc_id", "text").filter("text is not null").join(views, "doc_id").orderBy("doc_id", "annotator", F.xxhash64("text")).toPandas()
    y = np.array([[float(lab in ls) for lab in LABELS] for ls in rows["ls"]]).reshape(len(rows), len(LABELS))
    return Model(rows["text"].tolist(), y, rows["doc_id"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual): calibrated scores of every document; null, empty and blank texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                texts = part["text"].tolist()
                s = m.scores(texts)
                s[[not t or not t.strip() for t in texts]] = 0
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), **{lab: s[:, k] for k, lab in enumerate(LABELS)}})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, abuse double, hate double, sexual double")


def found(scores: DataFrame) -> DataFrame:
    """(doc_id, label) for each label that a document's score reaches; rows with equal doc_id count once."""
    pairs = F.filter(F.array(*[F.when(F.col(k) >= CUT, F.lit(k)) for k in LABELS]), lambda x: x.isNotNull())
    return scores.select("doc_id", F.explode(pairs).alias("label")).distinct()


def rates(scores: DataFrame) -> DataFrame:
    """(source, docs, abuse, hate, sexual): documents and the share of them that has each label; null sources are one."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *[F.round(F.avg((F.col(k) >= CUT).cast("double")), 6).alias(k) for k in LABELS])
