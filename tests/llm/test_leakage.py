import random

import numpy as np

from marlstone.llm import leakage as L

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "xe") for b in ("ban", "dor", "fel", "gim", "hun", "jas", "kel", "lop", "mar", "nix")]
FOREIGN = ["parcel", "letter", "seal", "stamp", "quay"]


def make(n, seed):
    r = random.Random(seed)
    return [(i, "Read the passage below. " + " ".join(r.choices(WORDS, k=90)).capitalize() + ". And what then?") for i in range(n)]


def passage(text):
    return L.words(L.split_item(text)[1])


def plant(words, r, share, changed=0.08, pieces=2):
    """A share of an item's words, in pieces, with single words changed or left out."""
    n = int(len(words) * share)
    at = r.randrange(len(words) - n + 1)
    part = [w if r.random() > changed else r.choice(["", "other"]) for w in words[at : at + n]]
    cuts = [n * k // pieces for k in range(pieces + 1)]
    filler = lambda: " ".join(r.choices(FOREIGN, k=12))
    return f"{filler()}. " + f" -- {filler()} -- ".join("<b>" + ", ".join(part[a:b]).upper() + "</b>" for a, b in zip(cuts, cuts[1:])) + f" {filler()}"


def common(a, b):
    """Length of the longest common subsequence, in plain Python."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def found(df, it):
    return {(x.doc_id, x.item_id) for x in L.find_leaks(df, it).collect()}


def test_words_and_items():
    assert L.words("It’s <b>near-sighted</b>​, ＡＢ &amp; x_y 3 < 4 > 2") == ["its", "near", "sighted", "ab", "x", "y", "3", "4", "2"]
    assert L.words("a <b " + 'title="' + "x" * 900 + '">c') == ["a", "c"]  # tags of any length
    assert L.words(None) == [] and L.split_item(None) == ("", "")
    assert L.split_item("A b. C d. E?") == ("A b.", "C d.") and L.split_item("Only?") == ("Only?", "")


def test_against_brute_force(spark):
    """Pairs by plain common subsequences: planted copies carry half or more, nothing else comes near."""
    r = random.Random(4)
    items = make(40, 1)
    docs = []
    for d in range(200):
        i, t = r.choice(items)
        w = passage(t)
        docs.append((d, [plant(w, r, 0.75), " ".join(w[:18]) + " a short quote", " ".join(r.choices(FOREIGN, k=150)), "Read the passage below. And what then?"][d % 4]))
    want = {(d, i) for d, t in docs for i, it in items if common(passage(it), L.words(t)) >= 0.5 * len(passage(it))}
    extra = [(900, None), (901, ""), (902, "x " * 50000), (0, docs[0][1]), (None, docs[0][1])]
    df, it = frames(spark, docs + extra, items + [(777, None), (778, "too short"), items[0], (None, items[0][1])])
    df, it = df.selectExpr("doc_id", "text", "1 as item_id"), it.selectExpr("item_id", "text", "2 as doc_id")
    got = found(df, it)
    assert got == want and len(want) >= 48
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


def test_recall_with_many_changed_words(spark):
    """Of copies in which 30 % of the words are changed and that still carry half of the passage, by plain common subsequences."""
    r = random.Random(5)
    items = make(150, 3)
    docs = [(i, plant(passage(t), r, 0.8, changed=0.3, pieces=3)) for i, t in items]
    true = {(d, d) for d, t in docs if common(passage(items[d][1]), L.words(t)) >= 0.5 * len(passage(items[d][1]))}
    got = found(*frames(spark, docs, items))
    assert len(true) > 80 and len(true & got) / len(true) >= 0.95 and all(a == b for a, b in got)


def test_pieces_foreign_words_and_quotes(spark):
    r = random.Random(6)
    items = make(30, 4)
    docs = []
    for i, t in items:
        w = passage(t)
        docs.append((i, " ".join(r.choice(FOREIGN) if n % 4 == 3 else x for n, x in enumerate(w))))  # every fourth word replaced
        pieces = [w[n : n + 12] for n in range(0, len(w), 12)]
        docs.append((100 + i, " ".join(" ".join(p) + " " + " ".join(r.choices(FOREIGN, k=6)) for p in pieces)))
        docs.append((200 + i, " ".join(w[:8]) + " " + " ".join(r.choices(FOREIGN, k=60))))  # a short quote
        docs.append((300 + i, " ".join(r.sample(w, len(w)))))  # the same words in another order
    assert found(*frames(spark, docs, items)) == {(k + i, i) for i, _ in items for k in (0, 100)}


def test_repeated_and_nested_items(spark):
    """Items that share all or part of their passage are all reported, however many they are."""
    w = passage(make(1, 8)[0][1])
    items = [(i, "Read this. " + " ".join(w) + ".") for i in range(120)] + [(200, "Read this. " + " ".join(w[:45]) + ".")]
    docs = [(1, " ".join(w)), (2, " ".join(w[:40])), (3, " ".join(FOREIGN * 9))]
    assert found(*frames(spark, docs, items)) == {(1, i) for i, _ in items} | {(2, 200)}


def test_alignments_agree():
    """Both runs of the alignment, and for a passage in one piece the plain rule: matches less gaps."""
    r = np.random.default_rng(0)
    pairs = []
    for _ in range(200):
        a, b = r.integers(2, 40, r.integers(1, 60)).astype(np.uint64), r.integers(2, 40, r.integers(1, 150)).astype(np.uint64)
        pairs.append((a, np.concatenate([b[:20], a[: len(a) // 2], b[20:], a[len(a) // 2 + 1 :]]) if r.random() < 0.5 else b))
    assert L._chains(pairs).tolist() == [L._chain_of_long(a, b) for a, b in pairs]
    x = L.codes("a b c d e f g h".split())
    assert L.covers([(x, x), (x, x[::-1]), (x, x[:4]), (x, x[:0]), (x[:1], x)]).tolist() == [1.0, 0.0, 0.5, 0.0, 1.0]


def test_long_document(spark):
    items = make(3, 9)
    text = " ".join(FOREIGN * 20000) + " " + " ".join(passage(items[1][1])) + " " + " ".join(FOREIGN * 20000)
    assert found(*frames(spark, [(5, text)], items)) == {(5, 1)}


def test_walks_follow_from_the_target():
    passages = [passage(t) for _, t in make(60, 2)]
    walks = L.choose_walks(passages, [2, 4, 10])
    assert [w.size for w in walks].count(2) == 1 and [w.size for w in walks].count(4) == L.MAX_WALKS  # no passage of that size
    assert 1 <= [w.size for w in walks].count(10) <= L.MAX_WALKS


def test_short_items(spark):
    items = [
        (1, "Read the passage. Kaban lodor mifel negim puhun rajas sokel. And then?"), (2, "Read the passage. Tilop vumar."), (3, "Read the passage. What is meant?"), (4, "What is a kaban?"),
        (5, "Xenix"), (6, "Read the passage."), (7, None), (8, "Read the passage. " + " ".join(WORDS[:40]) + "."),
    ]
    docs = [
        (1, "so: KABAN, lodor mifel <b>negim</b> puhun rajas sokel it is"), (2, "kaban lodor mifel only"), (3, "kaban lodor parcel mifel negim puhun"), (4, "they tilop vumar here"), (5, "tilop and vumar"),
        (6, "Read the passage. What is meant? What is a kaban?"), (7, "xenix"), (8, None), (9, ""),
    ]
    df, it = frames(spark, docs, items)
    assert found(df, it) == {(1, 1), (3, 1), (4, 2), (7, 5)}
    assert {r.item_id for r in L.passages(it).collect()} == {1, 2, 5, 8}
    # Nothing but short items.
    assert found(df, it.filter("item_id < 3")) == {(1, 1), (3, 1), (4, 2)}


def test_items_of_every_short_length(spark):
    r = random.Random(12)
    items = [(n, "Read this one. " + " ".join(r.sample(WORDS, n)).capitalize() + ".") for n in range(3, 12)] + [(99, "Read this one. " + " ".join(WORDS) + ".")]
    docs = [(i, " ".join(FOREIGN) + " " + " ".join(passage(t)) + " " + " ".join(FOREIGN)) for i, t in items[:-1]]
    got = found(*frames(spark, docs, items))
    assert {(i, i) for i in range(3, 12)} <= got
