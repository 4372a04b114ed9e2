import numpy as np
import pytest

from marlstone.llm import products
from marlstone.llm import listing_attributes as A
from marlstone.llm import title_encoder as E


@pytest.mark.parametrize(("title", "desc", "dose", "want"), [
    ("Zivirmargol 200 mg 2 x 14 pessaries", "", "", ("pessary", "200000", "28")), ("TABS N7, Runo, 0,5 gr.", "", "", ("tablet", "500000", "7")), ("caps (10 ct) Runo", "Active content: 500 Mg.", "", ("capsule", "500000", "10")),
    ("Runo", "Supplied as box of 10 x 0.2 cl vial. Dose per unit is 20 mg/1 ml.", "", ("vial", "20000/ml", "10x2000ul")), ("Runo 60 ML bottle syrup", "", "100 mg | 20 milligrams/5 mL", ("syrup", "4000/ml", "1x60000ul")), (None, None, None, ("", "", "")),
    ("Runo", "Comes from a good shop. These are 28 tablets of 5 mg each.", "", ("tablet", "5000", "28")), ("Runo", "Tablets of 5 mg. Tablets of 10 mg.", "", ("tablet", "", "")),
    ("Runo 3 blisters of 14 film-coated tablets", "", "5 mg | 7 mg", ("tablet", "", "42")), ("1 vial 0.5cl Runo", None, None, ("vial", "", "1x5000ul")),
])
def test_attributes(title, desc, dose, want):
    r = A.read(title, desc, dose)
    assert (r.form, r.strength, r.pack) == want


def listing(i, title, desc="", dose=None):
    return (i, "m", title, desc, dose, "clash", "clash")


SCHEMA = "listing_id bigint, market_name string, listing_title string, description string, dosage string, name string, sig string"


def brute(data):
    """Pairs by plain comparison of resolved attributes of correctly spelt listings."""
    key = {}
    for i, _, t, d, s, *_ in data:
        r = A.read(t, d, s)
        name = r.name or next((w for w in r.words if w not in ("estrolinate",)), "")
        key[i] = (name, r.form, r.strength, r.pack)
    ids = sorted(key)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if key[a] == key[b] and key[a][0]}


def test_pairs(spark):
    names = ["gikunsubal", "togolbalba", "kurpilrifo", "goxgonamar", "terkinongon", "runonnafe"]
    data, i = [], 0
    for n in names:
        for strength in ("5 mg", "5000 mcg", "10 mg"):
            for pack in ("2 x 7 tablets", "tabs N14", "pack of 20 capsules"):
                i += 1
                data.append(listing(i, f"{n.title()} (estrolinate) {strength} {pack}" if i % 3 else f"hot deal | {pack} | {n.upper()} | {strength}"))
    data.append(listing(500, "Estrolinate generic 5 mg 14 tablets", "Brand: Gikunsubal."))
    df = spark.createDataFrame(data, SCHEMA)
    got = {tuple(r) for r in products.pairs(products.groups(df)).collect()}
    assert got == brute(data)
    typo = spark.createDataFrame([*data, listing(900, "Gikunsubl 5 mg 14 tablets"), listing(901, None, None), listing(902, "", ""), data[0]], SCHEMA)
    more = {tuple(r) for r in products.pairs(products.groups(typo)).collect()}
    assert got <= more and {900} == {x for p in more - got for x in p} - {p[0] for p in more - got} and (1, 900) in more
    assert products.pairs(products.groups(df.limit(0))).count() == 0


def test_hot_product_is_spread(spark):
    g = spark.range(1500).selectExpr("id AS listing_id", "CASE WHEN id < 500 THEN 1L ELSE id END AS product")
    assert products.pairs(g).distinct().count() == products.pairs(g).count() == 500 * 499 // 2


def names(n, seed=1):
    r = np.random.default_rng(seed)
    syll = ["ba", "ko", "ri", "nu", "ze", "xa", "mi", "lo", "te", "gu", "vi", "sar"]
    return sorted({"".join(r.choice(syll, 4)) for _ in range(n)})


def test_search_recall_against_exact():
    r = np.random.default_rng(1)
    texts = [f"{n} {r.choice(['estrolinate', 'dienovest', 'premium'])}" if r.random() < 0.5 else n for n in names(1500)]
    ix = products.Index(texts, 2500)
    v = ix.encoder.encode(texts)
    home, cells = (v @ ix.centroids.T).argmax(1), ix.cells(v, ix.probes)
    q = r.choice(len(texts), 300, replace=False)
    near = np.argwhere(v[q] @ v.T >= ix.similar)
    assert len(ix.centroids) > 20 and np.mean([home[b] in cells[q[a]] for a, b in near]) >= 0.9
    # A damaged copy stays nearer than the others, and shared words tell little.
    rng = np.random.default_rng(2)
    bad = [E.corrupt(t, rng, ["dienovest", "hello"]) for t in texts[:200]]
    assert np.mean((ix.encoder.encode(bad) @ v.T).argmax(1) == np.arange(200)) > 0.6
    a, b, c = ix.encoder.encode(["bakorinu dienovest", "bakorinu", "zexamilo dienovest"])
    assert a @ b > a @ c


def test_search_is_what_groups(spark):
    """Wordings that share no more than a name are one product through the search alone."""
    data, i = [], 0
    for n in names(60)[:40]:
        for t in (f"{n} 5 mg 14 tablets", f"{n} (estrolinate) 5 mg 14 tablets", f"best price {n} 0.005 g tabs N14"):
            data.append(listing(i := i + 1, t))
    df = spark.createDataFrame(data, SCHEMA)
    want = {(3 * k + a, 3 * k + b) for k in range(40) for a, b in ((1, 2), (1, 3), (2, 3))}
    with_search = {tuple(r) for r in products.pairs(products.groups(df)).collect()}
    without = {tuple(r) for r in products.pairs(products.groups(df, search=False)).collect()}
    assert with_search == want and len(without) == 40 and without < with_search


def test_cells_in_blocks(spark, monkeypatch):
    """However a cell is cut, the same groups come out."""
    data = [listing(n, f"{w} {extra} 5 mg 14 tablets") for n, (w, extra) in enumerate((w, e) for w in names(40)[:25] for e in ("", "(estrolinate)", "(estrolinate) best price"))]
    df = spark.createDataFrame(data, SCHEMA)
    whole = {(r.listing_id, r.product) for r in products.groups(df).collect()}
    monkeypatch.setattr(products, "BLOCK", 7)
    monkeypatch.setattr(products, "TASK_ROWS", 50)
    assert {(r.listing_id, r.product) for r in products.groups(df).collect()} == whole
    assert 23 <= len({p for _, p in whole}) <= 25  # two of the names are one edit apart


def test_same_name():
    assert products.same_name("camarbeci", "camrbeci", 9, 1) and products.same_name("cokurmanvil", "cokurmanvli", 5, 1)
    assert not products.same_name("camarbeci", "camrbeci", 9, 9) and not products.same_name("ab", "ac", 1, 1) and not products.same_name("gikunsubal", "togolbalba", 1, 1)


def test_frequent_misspelling_of_a_hot_product(spark):
    hot = [listing(n, "Gikunsubal 5 mg 14 tablets") for n in range(120)]
    typos = [listing(200 + n, f"{w} 5 mg 14 tablets") for n, w in enumerate(["Gikunsubl"] * 6 + ["Gikunsubla"] * 5)]
    other = [listing(300 + n, "Gikunsubol 5 mg 14 tablets") for n in range(40)]  # too frequent for a misspelling
    got = {r.listing_id: r.product for r in products.groups(spark.createDataFrame([*hot, *typos, *other], SCHEMA)).collect()}
    assert {got[i] for i, *_ in hot + typos} == {got[0]} and {got[i] for i, *_ in other} == {got[300]} != {got[0]}
    # The same shares give the same answer at every size.
    assert all(products.same_name("gikunsubal", "gikunsubl", 1000 * k, 5 * k) and not products.same_name("gikunsubal", "gikunsubol", 120 * k, 40 * k) for k in (1, 10, 1000))


def test_unknown_attributes_are_completed(spark):
    data = [
        listing(1, "Gikunsubal 5 mg 14 tablets"), listing(2, "Gikunsubal 5 mg tablets, a fortnight's worth"), listing(3, "Gikunsubal fourteen lozenges, 5 mg"), listing(4, "Gikunsubal 10 mg tablets"),
        listing(5, "Togolbalba 5 mg 14 tablets"), listing(6, "Togolbalba 5 mg 28 tablets"), listing(7, "Togolbalba 5 mg tablets"), listing(8, "Togolbalba 28 tablets"),
    ]
    got = {tuple(r) for r in products.pairs(products.groups(spark.createDataFrame(data, SCHEMA))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (6, 8)}  # 4 contradicts; 7 could be either pack


def test_nameless_listings_keep_a_row(spark):
    data = [listing(1, "Gikunsubal 5 mg 14 tablets"), listing(2, None, None), listing(3, " ", ""), listing(4, "5 mg 14 tablets"), listing(5, "5 mg 14 tablets"), listing(6, "best price tablets"), listing(7, "", "", "5 mg"), listing(8, "Gikunsubal 5 mg 14 tablets")]
    data += [(9, "another", *data[3][2:]), data[1]]
    g = products.groups(spark.createDataFrame(data, SCHEMA)).cache()
    got = {r.listing_id: r.product for r in g.collect()}
    assert g.count() == 9 and {i for i, p in got.items() if p is None} == {2, 3, 7}
    # Copies of one seller's offer are a pair, the same words of another seller aren't.
    assert {tuple(r) for r in products.pairs(g).collect()} == {(1, 8), (4, 5)}


def test_components(spark):
    n = spark.range(8).selectExpr("id AS sig")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
    assert sorted((r.sig, r.grp) for r in products.components(n, e).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert products.components(n, e.limit(0)).filter("sig <> grp").count() == 0
    # A long chain in an order of its own.
    ids = np.random.default_rng(3).permutation(200).tolist()
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    assert {r.grp for r in products.components(spark.range(200).selectExpr("id AS sig"), chain).collect()} == {0}
