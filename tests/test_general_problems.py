import json
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import compaction, dedupe, drift, units, windows
from marlstone.sources.json_records import complete_objects

from .conftest import rows

RECORD = "rec_id bigint, collector string, feed string, session_file string, pos bigint, payload string"


def test_bucketed_ordinal_and_prefix_sum(spark):
    r = random.Random(1)
    data = [(r.choice("ab"), i // 7, i, r.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, b int, i int, v int")
    got = {(x.k, x.i): x.o for x in windows.bucketed_ordinal(df, ["k"], F.col("b"), [F.col("i")], "o").collect()}
    for k in "ab":
        assert [got[k, i] for kk, _, i, _ in data if kk == k] == list(range(sum(x[0] == k for x in data)))
    total = 0
    want = {}
    for _, _, i, v in data:
        want[i], total = total, total + v
    assert {x.i: x.s for x in windows.prefix_sum(df, F.col("b"), [F.col("i")], "v", "s").collect()} == want


# ---- 1 ----------------------------------------------------------------------------------------------------------


def files(*payloads, collector="c", feed="products_html"):
    out = []
    for n, records in enumerate(payloads):
        for p, d in enumerate(records):
            out.append((len(out), collector, feed, f"{feed}_202601{n + 1:02d}_000000_1.json", p, d if isinstance(d, str) or d is None else json.dumps(d)))
    return out


def changes(spark, data):
    df = spark.createDataFrame(data, RECORD)
    return sorted((r.session_file[14:22], r.field, r.new_field, r.change) for r in drift.changes(df).collect())


def test_drift_changes(spark):
    u = "http://x.example.org/a"
    data = files(
        [{"category_page": u, "fetched_at": 1767225600, "x": 1}],
        [{"cat_page": u, "fetched_at": 1767225600, "x": None}, {"x": None}],  # renamed
        [{"cat_page": [u], "fetched_at": "2026-01-01T00:00:00"}],  # x removed, two retyped
        [{"retries": 3, "fetched_at": None}],  # cat_page removed, retries added
        [{"retries": "3", "fetched_at": 5, "Category Page": [u]}],  # added, retyped
        [{"fetched_at": 5, "retries": "4", "CATEGORY_PAGE": [u]}],  # renamed
    )
    assert changes(spark, data) == sorted([
        ("20260102", "category_page", "cat_page", "renamed"), ("20260103", "x", "", "removed"), ("20260103", "cat_page", "", "retyped"), ("20260103", "fetched_at", "", "retyped"),
        ("20260104", "cat_page", "", "removed"), ("20260104", "retries", "", "added"), ("20260105", "retries", "", "retyped"), ("20260105", "Category Page", "", "added"),
        ("20260106", "Category Page", "CATEGORY_PAGE", "renamed"),
    ])


def test_drift_null_keys(spark):
    u = "http://x.example.org/a"
    plain = files([{"a": 1, "url": u}], [{"b": "x", "URL": u}], [{"b": 2, "URL": u}])
    want = changes(spark, plain)
    assert len(want) == 4  # a removed, b added, url renamed, b retyped
    for null in (1, 2):  # collector, feed
        data = [(*r[:null], None, *r[null + 1 :]) for r in plain]
        assert changes(spark, data) == want
    both = changes(spark, [*plain, *[(*r[:1], None, *r[2:]) for r in plain]])
    assert both == sorted(want * 2)
    first = [(*r[:3], None, *r[4:]) if n == 0 else r for n, r in enumerate(plain)]
    assert changes(spark, first) == want


def test_drift_unreadable_and_empty(spark):
    assert changes(spark, []) == []
    data = files([{"a": 1}], ["not json", None, "[1]", ""], [{"a": 1}])
    # A file without a readable record has no fields, but stands in the order.
    assert changes(spark, data) == [("20260102", "a", "", "removed"), ("20260103", "a", "", "added")]
    t = drift.consistent(spark.createDataFrame(data, RECORD), "products_html")
    assert t.count() == 6 and t.filter("readable").count() == 2


def test_drift_edges_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/raw_records.parquet")
    kind = lambda v: {str: 1, bool: 2, list: 4, dict: 8}.get(type(v), 16)
    per = defaultdict(lambda: defaultdict(set))
    for r in df.collect():
        seen = per[r.collector, r.feed][re.search(r"\d{8}_\d{6}", r.session_file)[0], r.session_file]
        for k, v in json.loads(r.payload).items():
            seen.add((k, None if v is None else kind(v)))
    want = set()
    for (c, f), fs in per.items():
        names = sorted(fs)
        for a, b in zip(names, names[1:]):
            A, B = {k for k, _ in fs[a]}, {k for k, _ in fs[b]}
            ty = lambda s, k: {t for kk, t in s if kk == k and t}
            want |= {(c, f, b[1], k, "added") for k in B - A} | {(c, f, b[1], k, "removed") for k in A - B}
            want |= {(c, f, b[1], k, "retyped") for k in A & B if ty(fs[a], k) and ty(fs[b], k) and ty(fs[a], k) != ty(fs[b], k)}
    got = set()
    for r in drift.changes(df).collect():
        key = (r.collector, r.feed, r.session_file)
        got |= {(*key, r.field, "removed"), (*key, r.new_field, "added")} if r.change == "renamed" else {(*key, r.field, r.change)}
    assert got == want


def test_drift_consistent_casts(spark):
    data = files([{"url": {"href": "http://a"}, "timestamp": "2026-01-01T00:00:00", "raw_html": "<p>", "Market": "m", "cat_page": ["http://c"], "extra": [1]}])
    r = drift.consistent(spark.createDataFrame(data, RECORD), "products_html").first()
    assert (r.product_url, r.fetched_at, r.html, r.market, r.category_page) == ("http://a", 1767225600, "<p>", "m", "http://c")
    assert [tuple(x) for x in r.extras] == [("extra", "[1]"), ("url", '{"href":"http://a"}')] and r.cast_failures == []


def test_drift_consistent_loses_nothing(spark):
    twice = '{"zz":1,"zz":"b","title":"t","name":"n","stock":"many","original_url":["http://a","http://b"],"url":"http://c","price":{"amount":5,"unit":"EUR","tax":1},"fetched_at":"never","rating":3.5,"html":"","dose":null}'
    df = spark.createDataFrame([(1, "c", "parsed_merged", "f_20260101_000000.json", 0, twice), (2, "c", "parsed_merged", "f_20260101_000000.json", 1, "{"), (3, "c", "parsed_merged", "f_20260102_000000.json", 0, '{"zz": 1}'), (4, "c", "products_html", "f", 0, "{}")], RECORD)
    got = {r.rec_id: r for r in drift.consistent(df, "parsed_merged").collect()}
    r = got[1]
    assert (r.listing_title, r.price, r.original_url, r.number_in_stocks, r.fetched_at, r.rating, r.dosage) == ("n", "5 EUR", "http://a", None, None, "3.5", None)
    assert sorted(map(tuple, r.extras)) == sorted([("zz", "1"), ("zz", "b"), ("title", "t"), ("stock", "many"), ("original_url", '["http://a","http://b"]'), ("url", "http://c"), ("price", '{"amount":5,"unit":"EUR","tax":1}'), ("fetched_at", "never")])
    assert sorted(r.cast_failures) == ["fetched_at", "number_in_stocks"] and r.readable and not got[2].readable and got[2].extras is None and set(got) == {1, 2, 3}
    # A record that repeats a name is in the catalogue with the first of them.
    cat = {(x.session_file, x.field): x.types for x in drift.catalogue(df).collect()}
    assert cat["f_20260101_000000.json", "zz"] == 16 and ("f_20260102_000000.json", "zz") in cat and len(cat) == 12


# ---- 2 ----------------------------------------------------------------------------------------------------------

PAGE = "row_id bigint, product_url string, fetched_at string, _k string, _row string"


def test_deliveries(spark):
    data = [(1, "http://a/x", "100", "q", ""), (2, "https://A/x/", " 100.0", "q", ""), (3, "http://a/x", "101", "", ""), (4, "", "100", "", ""), (5, None, "100", "", ""), (6, "http://a/x", "never", "", ""), (7, "http://a/x", "never", "", ""), (8, "http://a/x#f", "100000000000", "", ""), (2, "https://A/x/", " 100.0", "q", "")]
    df = spark.createDataFrame(data, PAGE)
    assert rows(dedupe.surplus_deliveries(df)) == [(2,)]
    kept = dedupe.keep_one_delivery(df)
    assert sorted(r.row_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8] and kept.columns == df.columns
    assert rows(dedupe.surplus_deliveries(df.limit(0))) == []
    # Another order: the latest row stays.
    assert rows(dedupe.surplus_deliveries(df.dropDuplicates(["row_id"]), delivered=-F.col("row_id"))) == [(1,)]
    late = df.withColumn("session_file", F.when(F.col("row_id") == 1, "x_20260102_000000.json").when(F.col("row_id") == 2, "x_20260101_000000.json"))
    assert rows(dedupe.surplus_deliveries(late, delivered=dedupe.delivery_time(F.col("session_file")))) == [(1,)]
    negative = spark.createDataFrame([(-5, "http://a/x", "100"), (7, "http://a/x", "100"), (None, "http://a/x", "100")], "row_id bigint, product_url string, fetched_at string")
    assert rows(dedupe.surplus_deliveries(negative, delivered=F.lit(9))) == [(7,)] == rows(dedupe.surplus_deliveries(negative))
    assert "SortAggregate" not in dedupe.surplus_deliveries(df, delivered=F.col("row_id"))._jdf.queryExecution().toString()


def test_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "http://hot/").otherwise(F.concat(F.lit("http://h/"), "id")).alias("product_url"), F.lit("5").alias("fetched_at"))
    assert dedupe.surplus_deliveries(df).count() == 999


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", "5", 1), ("a", "7", 2), ("a", "7", 3), ("a", "x", 4), ("b", "NaN", 5), ("b", "-3", 6), ("", "1", 7), (None, "1", 8), ("", "1", 9)], "k string, r string, o int")
    latest = dedupe.latest_per_key(df, "k", "r", ["o"])
    assert sorted(r.o for r in latest.collect()) == [3, 5, 7, 8, 9]
    assert sorted(r.o for r in dedupe.latest_per_key(latest, "k", "r", ["o"]).collect()) == [3, 5, 7, 8, 9]
    assert sorted(r.o for r in dedupe.first_per_key(df, "k", ["o"]).collect()) == [1, 5, 7, 8, 9]


def test_walk_until_repeat(spark):
    df = spark.createDataFrame([("w", 1, ["a", "b"]), ("w", 2, ["c"]), ("w", 3, ["c"]), ("w", 4, ["d"]), ("v", 1, []), ("u", 1, ["b", "a"]), ("u", 2, ["a", "b", "b"])], "w string, p int, l array<string>")
    assert sorted((r.w, r.p) for r in dedupe.walk_until_repeat(df, "w", "p", "l").collect()) == [("u", 1), ("w", 1), ("w", 2)]


# ---- 6 ----------------------------------------------------------------------------------------------------------

FACTORS = [("USD", "price", "100"), ("EUR", "price", "109"), ("CHF", "price", "113"), ("BTC", "price", "6425000"), ("sat", "price", "0.06425"), ("cent", "price", "1"), ("ug", "mass", "1"), ("mg", "mass", "1000"), ("g", "mass", "1000000"), ("ml", "volume", "1000"), ("cl", "volume", "10000"), ("fl_oz", "volume", "29573.53")]


def quantities(spark, *listings):
    df = spark.createDataFrame([(n, *x, "c") for n, x in enumerate(listings)], "listing_id bigint, price string, dosage string, listing_title string, description string, alias string")
    f = spark.createDataFrame(FACTORS, "unit string, quantity string, factor string")
    return sorted(tuple(r) for r in units.listing_quantities(df, f).collect())


@pytest.mark.parametrize(("price", "text", "want"), [
    ("$5", "", (500, 500)), ("1,647.16 USD", "", (164716, 164716)), ("613,40 Swiss francs - 1.028,27 Swiss francs", "", (69314, 116195)), ("from $1 to $2,500", "", (100, 250000)), ("$3–7", "", (300, 700)), ("3–7 USD", "", (300, 700)),
    ("0.106", "We bill in bitcoin only.", (681050, 681050)), ("0,106", "All prices in bitcoin.", (681050, 681050)), ("17634 sats", "", (1133, 1133)), ("12", "no currency", None), ("N/A", "All prices in euro.", None), (None, "", None), ("", "", None),
    ("913 ¢", "", (913, 913)), ("1 067,30 Euro", "", (116336, 116336)), ("€1.500", "", (164, 164)), ("5 XYZ", "", None), ("9" * 40 + " USD", "", None), ("US$ 0.005", "", (1, 1)),
])
def test_prices(spark, price, text, want):
    assert quantities(spark, (price, None, "t", text)) == ([(0, "price", *want)] if want else [])


@pytest.mark.parametrize(("dose", "title", "want"), [
    ("5mg | 0.05 G | 400 IU", "", [("mass", 5000, 50000)]), ("250", "CAPS 250 МГ", [("mass", 250000, 250000)]), ("0.075", "x 0.075mg", [("mass", 75, 75)]), ("50", "50\u00a0мг, tab", [("mass", 50000, 50000)]), ("10", "nothing", []), ("400 IU", "10 mg", []),
    ("6.8 fl oz | 5000 mikrogramm / 1 mL", "", [("mass", 5000, 5000), ("volume", 1000, 201100)]), ("0,4 gr.", "", [("mass", 400000, 400000)]), (None, "5 mg", []), ("", "", []), ("50 µg", "", [("mass", 50, 50)]), ("50 μG", "", [("mass", 50, 50)]),
])
def test_doses(spark, dose, title, want):
    assert quantities(spark, (None, dose, title, None)) == [(0, *w) for w in want]


def test_units_empty_and_offset(spark):
    assert quantities(spark) == []
    a = spark.createDataFrame([(1, 10.0, "f")], "listing_id bigint, n double, alias string").select("listing_id", F.col("n").cast("decimal(20,8)").alias("number"), F.lit("mg").alias("alias"))
    f = spark.createDataFrame([("mg", "t", "2", "7")], "unit string, quantity string, factor string, offset string")
    assert [tuple(r) for r in units.common_units(a, f, ["listing_id"]).collect()] == [(1, "t", 27, 27)]


# ---- 7 ----------------------------------------------------------------------------------------------------------


def page(url, at=1, html="<p>{x}</p>"):
    return json.dumps({"product_url": url, "fetched_at": at, "html": html})


def test_complete_objects():
    a, b = page("a"), page("b")
    n = lambda t: [d["product_url"] for d in complete_objects(t)]
    assert n(f"[{a}, {b}]") == n(f"{a}\n{b}\n") == n(f"{a}{b}") == n(f"﻿[{a},\r\n{b}]") == ["a", "b"]
    assert n(f'[5, {a}, "x{{", null, [{b}], {b}]') == ["a", "b"]
    assert n(f"[{a}, {b[:-5]}") == ["a"] and n(a[:20]) == [] and n(f"{a[:30]}\n{b}") == ["b"]
    assert n("") == n(None) == n("[]") == n("\n") == []
    assert n("[" * 3000) == [] and n(page("z", html="{" * 20000)) == ["z"]


FILE = "file_id bigint, path string, size_bytes bigint, content string, group_no int"


def test_kept_records_and_rewrite(spark, tmp_path):
    a, b = page("a"), page("b")
    data = [(3, "p", 10, f"[{a}, {b}]", 0), (1, "p", 30, f"{b}\n{page('a', 2)}\n{page(None)}\n{page('')}", 0), (2, "p", 0, "", 0), (4, "p", 25, f"{b}{page(None)}", 0), (5, "p", None, None, 0), (6, "p", 5, a[:-3], 0)]
    df = spark.createDataFrame(data, FILE)
    assert rows(compaction.kept_records(df).drop("at")) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (4, 2)]
    report = compaction.rewrite(df, str(tmp_path / "out"), target=40)
    assert all(r.planned_records == r.written_records for r in report.collect()) and sum(r.written_records for r in report.collect()) == 6
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(json.loads(r.payload).get("product_url") or "" for r in back.collect()) == ["", "", "", "a", "a", "b"]
    assert rows(compaction.kept_records(df.limit(0))) == []


def test_a_large_file_is_cut_between_records(spark, tmp_path):
    big = "\n".join(page(f"u{n}") for n in range(30))
    df = spark.createDataFrame([(1, "p", len(big), big, 0), (2, "p", 10, page("z"), 0)], FILE)
    report = compaction.rewrite(df, str(tmp_path / "out"), target=len(big) // 5).collect()
    assert len(report) in (6, 7) and sum(r.written_records for r in report) == 31 and all(r.planned_records == r.written_records and r.written_records <= 7 for r in report)


def test_found_is_read_back_from_groups(spark, tmp_path, monkeypatch):
    from marlstone.plans.problems import p7_found

    data = [(n, "p", 30, f"{page(f'u{n}')}\n{page('same')}\n{page(None)}", 0) for n in range(1, 7)]
    spark.createDataFrame(data, FILE).write.parquet(str(tmp_path / "landed_files.parquet"))
    want = sorted([(n, r) for n in range(1, 7) for r in (1, 3)] + [(1, 2)])
    real, groups = compaction.rewrite, []

    def small(files, out, target=0):
        report = real(files, out, target=40)
        groups.extend(tuple(r) for r in report.collect())
        return report

    monkeypatch.setattr(compaction, "rewrite", small)
    assert rows(p7_found(spark, str(tmp_path))) == want
    assert len(groups) > 2 and all(p == w for _, p, w in groups) and sum(w for _, _, w in groups) == len(want)
    monkeypatch.setattr(compaction, "rewrite", lambda *a: real(*a).withColumn("written_records", F.col("written_records") - 1))
    with pytest.raises(RuntimeError):
        p7_found(spark, str(tmp_path))
    monkeypatch.undo()
    assert rows(compaction.consolidated(spark.createDataFrame(data, FILE).limit(0))) == []


def test_plan_groups(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "file_id bigint, size_bytes bigint")
    assert [r.n for r in compaction.plan_groups(df, target=50).groupBy("group_no").agg(F.count("*").alias("n")).orderBy("group_no").collect()] == [5] * 4


def test_repo_holds_no_data():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert not [f for d, _, fs in os.walk(here) if ".git" not in d for f in fs if f.endswith((".parquet", ".tiktoken"))]
