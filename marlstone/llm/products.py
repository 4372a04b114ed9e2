"""Listings of the same product, grouped through vectors of their wording.

1. Each listing is read: the words of its title that name something, the name that its description states, and the numeric variant
   (listing_attributes). Listings of equal reading are one wording at once, so that copies which hold a third of all rows are one
   row from here on. Nothing else is equal by itself: two wordings are the same product only if the search says so.
2. Wordings are encoded by the contrastive subword encoder, which learns that words many products share tell little, and are
   searched in an inverted file: cells by variant and nearest centroid, as many probes as a check against exact neighbours asks for.
   Cells are cut into blocks of bounded size.
3. Neighbours of another form, strength or pack are vetoed, and so are neighbours whose own names (the best attested word that is no
   substance) can't be one name: names within a small edit distance can, unless both are well attested. What remains and lies in each
   other's probes (mutual neighbours) is joined into groups; a task passes on its groups, not its pairs.
4. A wording that lacks attributes joins the only variant of its name that contradicts none of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import listing_attributes as A
from . import title_encoder as E
from ..session import Rounds, cut_lineage

SAMPLE = 6000  # wordings on which encoder and centroids are fitted, by hash order
CHECKED = 256  # of them searched exactly too, to tune the probes
RECALL = 0.995
BLOCK = 4096  # vectors of a cell in one block at most
TASK_ROWS = 20_000  # rows of the search in one group of cells, about
SIMILAR = 0.4  # cosine above which wordings are neighbours, at most; lower if damaged copies lie further apart
MISSED_COPIES = 0.001  # share of the damaged copies that may lie further
ATTESTED = 4  # listings that make a name well attested
MISSPELT = 0.1  # share of a name's listings up to which another spelling, however often it occurs, can be a misspelling of it
LEAST_A_CENTROID = 3  # wordings of the sample for each centroid

_FIELDS = "listing_id bigint, key string, words array<string>, name string, substance string, generic string, form string, strength string, pack string, offer string"
VARIANT = ["form", "strength", "pack"]


def _digest(*parts: object) -> str:
    return hashlib.blake2b(repr(parts).encode(), digest_size=16).hexdigest()


def attributes(listings: DataFrame) -> DataFrame:
    """One row of what each listing states; null fields state nothing.

    ``key`` is a digest of the wording: words, stated name and variant; '' for a listing that states no name. ``offer`` is a digest of
    seller and texts of such a listing, else ''; without title and description it is '' too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [A.read(t, d, s) for t, d, s in zip(b["listing_title"], b["description"], b["dosage"])]
            out = pd.DataFrame(rows, columns=A.Listing._fields)
            out["words"] = [sorted(set(r.words)) for r in rows]
            out["key"] = [_digest(w, r.name, r.form, r.strength, r.pack) if w or r.name else "" for w, r in zip(out["words"], rows)]
            texts = zip(b["market_name"], b["listing_title"], b["description"], b["dosage"])
            out["offer"] = [_digest(*[x or "" for x in t]) if not k and any((x or "").strip() for x in t[1:3]) else "" for k, t in zip(out["key"], texts)]
            out.insert(0, "listing_id", b["listing_id"].to_numpy())
            yield out[[f.split()[0] for f in _FIELDS.split(", ")]]

    return listings.filter("listing_id is not null").select("listing_id", "market_name", "listing_title", "description", "dosage").mapInPandas(run, _FIELDS)


def substances(attrs: DataFrame) -> DataFrame:
    """(word): words that listings state as substances more often than as names."""
    votes = attrs.select(F.explode(F.array(F.struct(F.col("substance").alias("w"), F.lit(1).alias("v")), F.struct(F.col("generic").alias("w"), F.lit(1).alias("v")), F.struct(F.col("name").alias("w"), F.lit(-1).alias("v")))).alias("x"))
    return votes.select("x.w", "x.v").filter("w <> ''").groupBy(F.col("w").alias("word")).agg(F.sum("v").alias("n")).filter("n > 0").select("word")


def wordings(attrs: DataFrame) -> DataFrame:
    """(sig, key, c, text, name, n, form, strength, pack): one row for each wording; ``sig`` is its least listing id, ``c`` its listings.

    ``name`` is the best attested of its words that is no substance, else the best attested substance, and ``n`` how many listings
    have that name.
    """
    w = attrs.filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("listing_id").alias("sig"), F.min(F.struct("words", "name", *VARIANT)).alias("a"))
    w = cut_lineage(w.select("sig", "key", "c", "a.*"))  # read three times below
    every = F.array_union("words", F.filter(F.array("name"), lambda x: x != ""))
    cand = w.select("sig", "c", F.explode(every).alias("word"))
    df = cand.groupBy("word").agg(F.sum("c").alias("df"))  # pre-aggregated; joined back on the word
    ranks = df.join(substances(attrs).withColumn("is_sub", F.lit(1)), "word", "left").select("word", F.struct(F.col("is_sub").isNull().alias("own"), "df", "word").alias("rank"))
    best = cand.join(ranks, "word").groupBy("sig", "c").agg(F.max("rank").alias("r")).select("sig", "c", F.col("r.word").alias("best"))
    n = best.groupBy("best").agg(F.sum("c").alias("n"))
    named = best.join(n, "best").select("sig", F.col("best").alias("_name"), "n")
    return w.join(named, "sig").select("sig", "key", "c", F.array_join(every, " ").alias("text"), F.col("_name").alias("name"), "n", *VARIANT)


def _distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent swaps), or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    p2: list[int] = []
    p1 = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(p1[j] + 1, row[j - 1] + 1, p1[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, p2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        p2, p1 = p1, row
    return p1[-1]


def same_name(a: str, b: str, na: int, nb: int) -> bool:
    """Whether two spellings can be one name: one edit, two in names of ten letters; never if both are well attested.

    A spelling is attested only beside the other: misspellings grow with their name's listings, so their share counts.
    """
    if a == b:
        return True
    if min(na, nb) >= max(ATTESTED, MISSPELT * max(na, nb)) or min(len(a), len(b)) < 5:
        return False
    most = 2 if min(len(a), len(b)) >= 10 else 1
    return _distance(a, b, most) <= most


class Index:
    """What every task of the search needs: encoder, centroids, number of probes. A MB or so, whatever the corpus."""

    def __init__(self, texts: list[str], vectors_a_variant: float):
        """``vectors_a_variant``: how many wordings share a variant, on average; their cells grow with its square root."""
        self.encoder = E.Encoder.train(texts)
        v = self.encoder.encode(texts)
        k = int(np.clip(np.sqrt(vectors_a_variant), 1, max(1, len(texts) // LEAST_A_CENTROID)))
        self.centroids = E.centroids(v, k) if len(v) else np.zeros((1, E.DIM), np.float32)
        self.similar = SIMILAR
        if len(v) > 1:
            r = np.random.default_rng(E.SEED + 1)
            at = np.arange(4 * CHECKED) % len(v)  # small tables give several copies each
            copies = self.encoder.encode([E.corrupt(texts[n], r) for n in at])
            self.similar = float(min(SIMILAR, np.quantile((copies * v[at]).sum(1), MISSED_COPIES)))
        self.probes = self.tune(texts, v)

    def cells(self, v: np.ndarray, probes: int) -> np.ndarray:
        s = v @ self.centroids.T
        probes = min(probes, s.shape[1])
        return np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(v), 1))

    def tune(self, texts: list[str], v: np.ndarray) -> int:
        """The fewest probes, two at least, with which RECALL of the exact neighbours of the checked queries is found.

        Queries are checked wordings and damaged copies of them; neighbours are all others that are similar enough, by brute force,
        and the wording that a copy was made of. A neighbour counts as found if each lies in the other's probes.
        """
        if len(v) < 2 or len(self.centroids) == 1:
            return 1
        r = np.random.default_rng(E.SEED)
        n = min(CHECKED, len(v))
        q = np.concatenate([v[:n], self.encoder.encode([E.corrupt(t, r) for t in texts[:n]])])
        near = q @ v.T >= self.similar
        near[np.arange(n), np.arange(n)] = False
        near[n + np.arange(n), np.arange(n)] = True
        a, b = near.nonzero()
        place = lambda x: np.argsort(np.argsort(-(x @ self.centroids.T), axis=1), axis=1)
        home = lambda x: (x @ self.centroids.T).argmax(1)
        need = np.maximum(place(q)[a, home(v)[b]], place(v)[b, home(q)[a]])
        copies = (a >= n) & (b == a - n)
        for probes in range(2, len(self.centroids)):
            if (need < probes).mean() >= RECALL and (need[copies] < probes).mean() >= RECALL:
                return probes
        return len(self.centroids)


def fit_index(signatures: DataFrame) -> Index:
    rows = signatures.select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()  # bounded sample
    size = signatures.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*VARIANT)).alias("v")).first()
    return Index([r.text for r in rows], size.n / max(1, size.v))


class _Rows:
    """The rows of a search task as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.v = np.frombuffer(b"".join(pdf["v"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32) / 127
        self.sig, self.n, self.home, self.probe = (pdf[c].to_numpy() for c in ("sig", "n", "home", "probe"))
        self.name, self.names = pd.factorize(pdf["name"])
        self.cut: dict[tuple[int, int], bool] = {}

    def one_name(self, i: int, j: int) -> bool:
        """``same_name`` for two rows."""
        a, b = self.name[i], self.name[j]
        if a == b:
            return True
        key = (a, b)
        if key not in self.cut:
            self.cut[key] = same_name(self.names[a], self.names[b], int(self.n[i]), int(self.n[j]))
        return self.cut[key]

    def edges(self, lo: int, mid: int, hi: int, similar: float) -> set[tuple[int, int]]:
        """Edges (less, greater) between the wordings stored in rows lo to mid and those asked for in mid to hi; queries come in slices, which bounds the memory."""
        out: set[tuple[int, int]] = set()
        stored = self.v[lo:mid].T
        for at in range(mid, hi, 1024):
            end = min(hi, at + 1024)
            hit = (self.v[at:end] @ stored >= similar) & (self.sig[at:end, None] != self.sig[None, lo:mid])
            for i in np.flatnonzero(hit.any(1)):
                q = at + int(i)
                mutual = [j for j in (lo + np.flatnonzero(hit[i])).tolist() if self.home[q] in self.probe[j]]
                # One edge to each name among the neighbours is enough: the block's wordings of one name meet through its own edges.
                least: dict[int, int] = {}
                for j in mutual:
                    k = self.name[j]
                    if k not in least or self.sig[j] < self.sig[least[k]]:
                        least[k] = j
                for j in least.values():
                    if self.one_name(q, j):
                        a, b = int(self.sig[q]), int(self.sig[j])
                        out.add((a, b) if a < b else (b, a))
        return out


def links(signatures: DataFrame, index: Index) -> DataFrame:
    """(a, b): wordings that are joined as mutual neighbours under the vetoes, a < b.

    Every wording asks ``probes`` cells of its own variant: a cell is a variant and a centroid, so that vectors with another form,
    strength or pack are never compared. A cell's vectors are cut into blocks of at most about BLOCK by hash; a query goes to all
    blocks of its cells, so none is left out. A row carries its home and its probes, so that a block knows which neighbours are
    mutual. A wording passes on one edge for each name that it finds in a block, however many wordings have it.
    """
    shared = signatures.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            v = ix.encoder.encode(b["text"].tolist())
            probes = ix.cells(v, ix.probes).astype(np.int32)
            home = (v @ ix.centroids.T).argmax(1).astype(np.int32) if len(v) else np.zeros(0, np.int32)
            small = np.rint(v * 127).astype(np.int8)
            yield pd.DataFrame({"sig": b["sig"], "variant": b["variant"], "name": b["name"], "n": b["n"], "v": [x.tobytes() for x in small], "home": home, "probe": list(probes)})

    kind = "sig bigint, variant bigint, name string, n bigint, v binary, home int, probe array<int>"
    placed = cut_lineage(signatures.select("sig", F.xxhash64(*VARIANT).alias("variant"), "text", "name", "n").mapInPandas(place, kind))  # read three times below
    cell = lambda c: F.xxhash64("variant", c)
    sizes = placed.groupBy(cell("home").alias("cell")).agg(F.count(F.lit(1)).alias("size")).filter(f"size > {BLOCK}").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    stored = placed.withColumn("cell", cell("home")).join(sizes, "cell", "left").withColumn("block", F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("side", F.lit(0))
    asked = placed.withColumn("p", F.explode("probe")).withColumn("cell", cell("p")).drop("p").join(sizes, "cell", "left")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).withColumn("side", F.lit(1)).withColumn("probe", F.lit(None).cast("array<int>"))
    groups_of_cells = max(1, int(signatures.count() * (1 + index.probes) / TASK_ROWS))
    similar = index.similar

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "block", "side"], kind="stable").reset_index(drop=True)
        key = pdf["cell"].to_numpy().astype(np.int64) * 1000003 + pdf["block"].to_numpy()
        side = pdf["side"].to_numpy()
        rows = _Rows(pdf)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(pdf)]])
        edges: set[tuple[int, int]] = set()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo < mid < hi and (mid - lo > 1 or hi - mid > 1):
                edges |= rows.edges(lo, mid, hi, similar)
        return pd.DataFrame(sorted(edges), columns=["a", "b"], dtype="int64")

    cols = ["cell", "block", "side", "sig", "name", "n", "v", "home", "probe"]
    both = stored.select(*cols).unionByName(asked.select(*cols)).withColumn("task", F.pmod(F.xxhash64("cell", "block"), F.lit(groups_of_cells)))
    return both.groupBy("task").applyInPandas(search, "a bigint, b bigint").distinct()


def completions(signatures: DataFrame) -> DataFrame:
    """(a, b): a signature with unknown attributes and the one it must belong to.

    An unknown attribute contradicts nothing, so every fuller signature of the name that agrees in what is known is a reading of it. It
    is linked if there is only one; between several strengths or packs nothing tells which is meant, and it stays by itself.
    """
    key = ["form", "strength", "pack"]
    blanks = sum(((F.col(c) == "").cast("int") for c in key), F.lit(0))
    t = signatures.select("sig", "name", *key, blanks.alias("blanks"))
    part = t.filter("blanks > 0").select(F.col("sig").alias("a"), "name", *[F.col(c).alias(f"{c}_a") for c in key], F.col("blanks").alias("blanks_a"))
    full = t.filter("blanks = 0").select(F.col("sig").alias("b"), "name", *key)
    j = part.join(full, "name")
    for c in key:
        j = j.filter((F.col(f"{c}_a") == "") | (F.col(f"{c}_a") == F.col(c)))
    return j.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("_most")).filter("b = _most").select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sig, grp): connected components under their least label. Only nodes that have edges take part.

    Each round takes the least label among the neighbours and then follows labels to their own labels (pointer jumping), so that even a
    chain needs rounds by the logarithm of its length only; it goes on until nothing moves. Lineage is cut each round.
    """
    rounds = Rounds(edges.sparkSession)
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    fixed = Rounds(edges.sparkSession)
    (both,) = fixed.keep(both)
    (label,) = rounds.keep(both.groupBy(F.col("x").alias("sig")).agg(F.least(F.min("y"), F.first("x")).alias("grp")))
    while True:
        least = both.join(label, both["y"] == label["sig"]).groupBy("x").agg(F.min("grp").alias("m"))
        near = label.join(least, label["sig"] == least["x"]).select("sig", F.col("grp").alias("was"), F.least("grp", "m").alias("grp"))
        (near,) = rounds.keep(near)
        up = near.select(F.col("sig").alias("_at"), F.col("grp").alias("_up"))
        (label,) = rounds.keep(near.join(up, near["grp"] == up["_at"], "left").select("sig", "was", F.least("grp", F.coalesce("_up", "grp")).alias("grp")))
        if not label.filter("grp <> was").limit(1).count():
            break
        label = label.drop("was")
    label = rounds.close(label.select("sig", "grp"))
    fixed.close(both.limit(0))
    return nodes.select("sig").join(label, "sig", "left").select("sig", F.coalesce("grp", "sig").alias("grp"))


def groups(listings: DataFrame, search: bool = True) -> DataFrame:
    """(listing_id, product): one row for each listing; rows with equal listing_id are one listing, rows without an id none.

    Listings without title and description state nothing, have product null and are in no group. Others that state no name are
    grouped with copies of the same offer (seller, title, description and dosage) only. Unknown attributes equal unknown ones, and
    the known ones of the only variant that agrees otherwise (``completions``). Without ``search`` only equal wordings are grouped.
    """
    read = attributes(listings)
    rest = [c for c in read.columns if c != "listing_id"]
    # Attributes are shuffled, not texts; of differing rows with one id the least counts.
    one = cut_lineage(read.groupBy("listing_id").agg(F.min(F.struct(*rest)).alias("a")).select("listing_id", "a.*"))  # read several times below
    sig = cut_lineage(wordings(one))
    member = sig.select("sig", F.col("sig").alias("grp"))
    if search:
        member = components(sig, links(sig, fit_index(sig)).unionByName(completions(sig)))
    stated = one.filter("key <> ''").select("listing_id", "key").join(sig.select("key", "sig").join(member, "sig"), "key").select("listing_id", F.col("grp").alias("product"))
    nameless = one.filter("key = ''").select("listing_id", "offer")
    copies = nameless.filter("offer <> ''").groupBy("offer").agg(F.min("listing_id").alias("product"))
    return stated.unionByName(nameless.join(copies, "offer", "left").select("listing_id", "product"))


def pairs(grouped: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b) of each two listings of one product, a < b; asked for by the result's definition.

    A product's listings are dealt into blocks by rank, and each pair of blocks is a task key of its own, so a hot product is
    spread instead of landing in one task.
    """
    g = grouped.filter("product is not null")
    size = g.groupBy("product").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("product", F.ceil(F.sqrt(F.col("size") / 64.0)).cast("int").alias("parts"))
    t = g.join(size, "product").withColumn("part", F.pmod(F.xxhash64("listing_id"), F.col("parts")).cast("int"))
    left = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("product", F.col("part").alias("p"), F.col("other").alias("q"), F.col("listing_id").alias("listing_id_a"))
    right = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("product", F.col("other").alias("p"), F.col("part").alias("q"), F.col("listing_id").alias("listing_id_b"))
    return left.join(right, ["product", "p", "q"]).filter("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
