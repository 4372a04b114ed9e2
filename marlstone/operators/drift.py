"""Schemas that drift between files: a catalogue of column lifespans, the log of changes, and one consistent table.

The catalogue has one row for each file and field, made by a partially aggregated pass over the records. Lifespans
are islands in the order of a producer's files, found with lag; their starts and ends are the changes. The alias
table says which names mean one field, both for renames and for the casts of the consistent tables.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..session import cut_lineage
from .windows import bucketed_ordinal

# Other names of a feed's fields, in lower case without blanks and signs.
ALIASES = {
    "products_html": {
        "market": ["market", "host", "markethost", "marketname", "site"],
        "category_page": ["categorypage", "listingpage", "sourcepage", "catpage", "categoryurl", "categorylink"],
        "product_url": ["producturl", "url", "itemurl", "productlink", "pageurl", "link", "href"],
        "fetched_at": ["fetchedat", "fetched", "timestamp", "scrapedat", "crawledat"],
        "html": ["html", "rawhtml", "body", "pagehtml", "content"],
    },
    "parsed_merged": {
        "market_name": ["marketname", "shop", "market", "shopname"],
        "listing_title": ["listingtitle", "title", "name", "productname"],
        "price": ["price", "cost", "pricetext"],
        "dosage": ["dosage", "strength", "dose"],
        "rating": ["rating", "stars", "score"],
        "review": ["review", "reviews"],
        "description": ["description", "desc", "details"],
        "number_in_stocks": ["numberinstocks", "instock", "stock", "stockcount"],
        "original_url": ["originalurl", "sourceurl", "listingurl", "productlink", "href", "producturl", "url", "link"],
        "category_page": ["categorypage", "listingpage", "categoryurl"],
        "fetched_at": ["fetchedat", "fetched", "timestamp", "scrapedat", "crawledat"],
    },
}
# Types of the consistent tables' columns; the others are text. A moment is whole seconds since 1970.
TYPES = {"fetched_at": "moment", "number_in_stocks": "bigint"}
BUCKET = 4096


def _norm(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def alias_table(spark) -> DataFrame:
    """(feed, alias, canonical, type), about 60 fixed rows."""
    rows = [(f, a, c, TYPES.get(c, "string")) for f, m in ALIASES.items() for c, names in m.items() for a in names]
    return spark.createDataFrame(rows, "feed string, alias string, canonical string, type string")


def _kind(v: Column) -> Column:
    """Bit of the kind of a scalar's text: html, address, moment, money, rate, amount, whole number, number, other."""
    rules = [
        (r"^\s*<", 1), (r"^https?://", 2), (r"^\d{4}-\d\d-\d\d", 4), (r"^1\d{9}(\.\d+)?$|^1\d{12}$", 4),
        (r"^[$€£]\s*\d", 8), (r"^\d+(\.\d+)?\s*/\s*\d+$", 16), (r"(?i)^\d[\d.,]*\s*(mg|mcg|ug|g|ml)\b", 32), (r"^-?\d+$", 64), (r"^-?\d+\.\d+$", 128),
    ]
    c = F.lit(256)
    for pattern, bit in reversed(rules):
        c = F.when(v.rlike(pattern), bit).otherwise(c)
    return c


def catalogue(records: DataFrame) -> DataFrame:
    """(collector, feed, session_file, field, types, kinds): the footer of each file, made from its records.

    ``types`` is the sorted list of JSON types of the non-null values, '' if all are null; ``kinds`` a mask of the kinds of
    scalar values. A payload that is null, no JSON or no object has no fields. The first of equal names in a record counts.
    """
    v = records.select("collector", "feed", "session_file", "payload", F.try_parse_json(F.col("payload")).alias("_v"))
    # The parser refuses records that repeat a name; only those pass through Python.
    v = v.withColumn("_v", F.coalesce("_v", F.try_parse_json(_without_repeats(F.when(F.col("_v").isNull() & F.col("payload").rlike(r"^\s*\{"), F.col("payload"))))))
    v = v.filter(F.schema_of_variant("_v").startswith("OBJECT"))
    t = v.sparkSession.sql("SELECT collector, feed, session_file, key AS field, schema_of_variant(value) AS _t, cast(value AS string) AS _s FROM {v}, LATERAL variant_explode(_v)", v=v)
    bit = (
        F.when(F.col("_t") == "VOID", 0).when(F.col("_t") == "STRING", 1).when(F.col("_t") == "BOOLEAN", 2)
        .when(F.startswith("_t", F.lit("ARRAY")), 4).when(F.startswith("_t", F.lit("OBJECT")), 8).otherwise(16)
    )
    kind = F.when(bit.isin(1, 16), _kind(F.col("_s"))).otherwise(0)
    return t.groupBy("collector", "feed", "session_file", "field").agg(F.bit_or(bit).alias("types"), F.bit_or(kind).alias("kinds"))


def file_time(name: Column) -> Column:
    """The moment in a file's name, as sortable text; '' without one."""
    return F.regexp_extract(name, r"(\d{8}_\d{6})", 1)


def file_order(records: DataFrame) -> DataFrame:
    """(collector, feed, session_file, ord, last): the place of each file in its producer's order, from 0.

    Files are ordered by the time in the name, then by name. Works in buckets of a day, so no producer fills a task.
    """
    files = records.select("collector", "feed", "session_file").distinct()
    day = F.substring(file_time(F.col("session_file")), 1, 8)
    o = bucketed_ordinal(files, ["collector", "feed"], day, [file_time(F.col("session_file")), F.col("session_file")], "ord")
    return o


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left side."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in keys])


def lifespans(records: DataFrame) -> DataFrame:
    """Starts and ends of each field's islands: (collector, feed, field, ord, session_file, edge, types, kinds, prev_types).

    ``edge`` is 'start' (the field is in file ``ord`` but not in the one before), 'end' (``ord`` is the first file without it)
    or 'type' (the non-null values have another type than in the file before). First files and last files give no edge.
    The order is cut into buckets of 4096 files, whose last row is also the next bucket's first, so lag sees all neighbours.
    """
    order = file_order(records)
    cat = _same(catalogue(records), order, ["collector", "feed", "session_file"])
    b = F.floor(F.col("ord") / BUCKET)
    # A ghost copy stands in the neighbouring bucket, for lag and lead alike.
    homes = F.when(F.col("ord") % BUCKET == BUCKET - 1, F.array(b, b + 1)).when((F.col("ord") % BUCKET == 0) & (F.col("ord") > 0), F.array(b, b - 1)).otherwise(F.array(b))
    t = cat.withColumn("_b", F.explode(homes)).withColumn("_own", F.col("_b") == b)
    w = Window.partitionBy("collector", "feed", "field", "_b").orderBy("ord")
    t = t.withColumn("_lag", F.lag("ord").over(w)).withColumn("_lead", F.lead("ord").over(w)).withColumn("prev_types", F.lag("types").over(w)).filter("_own")
    starts = (F.col("ord") > 0) & ~F.col("_lag").eqNullSafe(F.col("ord") - 1)
    retyped = F.col("_lag").eqNullSafe(F.col("ord") - 1) & (F.col("types") != 0) & (F.col("prev_types") != 0) & (F.col("types") != F.col("prev_types"))
    ends = ~F.col("_lead").eqNullSafe(F.col("ord") + 1)
    edges = F.filter(
        F.array(
            F.when(starts, F.struct(F.lit("start").alias("edge"), F.col("ord").alias("at"))),
            F.when(retyped, F.struct(F.lit("type").alias("edge"), F.col("ord").alias("at"))),
            F.when(ends, F.struct(F.lit("end").alias("edge"), (F.col("ord") + 1).alias("at"))),
        ),
        lambda x: x.isNotNull(),
    )
    t = t.select("collector", "feed", "field", "types", "kinds", "prev_types", F.explode(edges).alias("_e"))
    t = t.select("collector", "feed", "field", "types", "kinds", "prev_types", F.col("_e.edge").alias("edge"), F.col("_e.at").alias("ord"))
    return _same(t, order, ["collector", "feed", "ord"])  # an end past the last file finds none


def changes(records: DataFrame) -> DataFrame:
    """(collector, feed, session_file, field, new_field, change) with change added, removed, renamed or retyped.

    An end and a start at one file are one rename if both names mean the same field (equal but for case, blanks and
    signs, or by the alias table) and the values agree in type and kind (all-null values agree with any); or if, of names
    of which at least one isn't in the alias table, they are the file's only pair of one specific kind and type. Null collectors,
    feeds and files are values of their own; a null file stands first in its producer's order.
    """
    spark = records.sparkSession
    alias = F.broadcast(alias_table(spark))  # fixed, about 60 rows
    e = cut_lineage(lifespans(records))  # read five times below
    e = e.withColumn("alias", _norm(F.col("field"))).join(alias.drop("type"), ["feed", "alias"], "left")
    e = e.withColumn("meaning", F.coalesce("canonical", F.concat(F.lit("?"), "alias")))
    k = ["collector", "feed", "session_file"]
    gone = e.filter("edge = 'end'").select(*k, F.col("field").alias("f0"), F.col("types").alias("t0"), F.col("kinds").alias("k0"), F.col("meaning").alias("m0"), F.col("canonical").alias("c0"))
    come = e.filter("edge = 'start'").select(*k, F.col("field").alias("f1"), F.col("types").alias("t1"), F.col("kinds").alias("k1"), F.col("meaning").alias("m1"), F.col("canonical").alias("c1"))
    pair = _same(gone, come, k)  # a file's own starts and ends: as many as it has fields, whatever the corpus
    fits = ((F.col("t0") == F.col("t1")) | (F.col("t0") == 0) | (F.col("t1") == 0)) & ((F.col("k0").bitwiseAND(F.col("k1")) != 0) | (F.col("k0") == 0) | (F.col("k1") == 0))
    named = F.col("m0") == F.col("m1")
    specific = (F.col("k0") == F.col("k1")) & (F.col("t0") == F.col("t1")) & F.col("k0").isin(1, 2, 4, 8, 16, 32) & (F.col("c0").isNull() | F.col("c1").isNull())
    pair = pair.filter(fits & (named | specific)).withColumn("_rank", F.when(named, 0).otherwise(1))
    w0, w1 = Window.partitionBy(*k, "f0"), Window.partitionBy(*k, "f1")
    pair = pair.withColumn("_best", F.least(F.min("_rank").over(w0), F.min("_rank").over(w1))).filter("_rank = _best")
    pair = pair.withColumn("_n", F.greatest(F.count(F.lit(1)).over(w0), F.count(F.lit(1)).over(w1)))
    # Several spellings of one field at once: pair them in name order; unnamed pairs must be the only ones.
    pair = pair.filter("_rank = 0 or _n = 1")
    wm = Window.partitionBy(*k, "m0", "_rank")
    pair = pair.withColumn("_i", F.dense_rank().over(wm.orderBy("f0"))).withColumn("_j", F.dense_rank().over(wm.orderBy("f1"))).filter("_i = _j")
    renamed = pair.select(*k, F.col("f0").alias("field"), F.col("f1").alias("new_field"))
    added = _same(e.filter("edge = 'start'").select(*k, "field"), renamed.select(*k, F.col("new_field").alias("field")), [*k, "field"], "left_anti")
    removed = _same(e.filter("edge = 'end'").select(*k, "field"), renamed.select(*k, "field"), [*k, "field"], "left_anti")
    retyped = e.filter("edge = 'type'").select(*k, "field")
    out = lambda d, c: d.select(*k, "field", F.lit("").alias("new_field"), F.lit(c).alias("change"))
    return renamed.select(*k, "field", "new_field", F.lit("renamed").alias("change")).unionByName(out(added, "added")).unionByName(out(removed, "removed")).unionByName(out(retyped, "retyped"))


def _first_wins(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


@F.pandas_udf(StringType())
def _without_repeats(payloads: pd.Series) -> pd.Series:
    """A JSON object with the first of its equal names; null for what is no JSON object."""

    def one(text: str | None) -> str | None:
        try:
            d = json.loads(text, object_pairs_hook=_first_wins) if text else None
        except (ValueError, RecursionError):
            return None
        return json.dumps(d, ensure_ascii=False) if isinstance(d, dict) else None

    return payloads.map(one)


class _Pairs(list):
    """A JSON object's names and values, repeated names too."""


def _plain(v: object) -> object:
    if isinstance(v, _Pairs):
        return _first_wins([(k, _plain(x)) for k, x in v])
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _written(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _main(v: object) -> tuple[str | None, bool]:
    """The one text of a value, and whether it says all of it: an array's first element, an object's href or amount and unit, else the value itself."""
    if isinstance(v, list):
        first = v[0] if v else None
        return (None if first is None else _written(first)), len(v) == 1 and not isinstance(first, (list, dict))
    if isinstance(v, dict):
        if v.get("href") is not None:
            return _written(v["href"]), False
        parts = [_written(v[k]) for k in ("amount", "unit") if v.get(k) is not None]
        return (" ".join(parts) or None), False
    return _written(v), True


def _entry_list(text: str | None) -> list[dict] | None:
    try:
        pairs = json.loads(text, object_pairs_hook=_Pairs) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(pairs, _Pairs):
        return None
    out = []
    for pos, (field, raw) in enumerate(pairs):
        v = _plain(raw)
        if v is not None and v != "":
            main, whole = _main(v)
            out.append({"field": field, "pos": pos, "raw": _written(v), "main": main or None, "whole": whole})
    return sorted(out, key=lambda e: (e["field"], e["pos"]))


_ENTRIES = ArrayType(StructType([StructField("field", StringType()), StructField("pos", IntegerType()), StructField("raw", StringType()), StructField("main", StringType()), StructField("whole", BooleanType())]))


@F.pandas_udf(_ENTRIES)
def entries(payloads: pd.Series) -> pd.Series:
    """The non-empty values of a record by name, repeated names too; null for what is no JSON object."""
    return payloads.map(_entry_list)


def _named(names: list[str]):
    return lambda e: _norm(e["field"]).isin(names)


def consistent(records: DataFrame, feed: str) -> DataFrame:
    """All records of a feed in one table that loses nothing: the feed's columns cast as the alias table says, ``extras`` and ``cast_failures``.

    Of several spellings of a column in one record the first non-empty by name counts. ``extras`` is a list of (field, value): values of
    unknown names, further spellings, arrays and objects of which a column holds only a part, and texts that a cast refused, whose columns
    ``cast_failures`` lists. Equal names in one record are all kept. Records that are no JSON objects come out with null columns and
    ``readable`` false.
    """
    from ..functions.moments import epoch_second

    r = records.filter(F.col("feed") == feed).withColumn("_e", entries("payload"))
    cols, taken, failed = [], [], []
    for canonical, names in ALIASES[feed].items():
        chosen = F.get(F.filter("_e", _named(names)), F.lit(0))
        text, kind = chosen["main"], TYPES.get(canonical, "string")
        value = epoch_second(text) if kind == "moment" else text if kind == "string" else text.try_cast(kind)
        cols.append(value.alias(canonical))
        taken.append(F.when(chosen["whole"] & value.isNotNull(), chosen["pos"]))
        if kind != "string":
            failed.append(F.when(text.isNotNull() & value.isNull(), F.lit(canonical)))
    some = lambda a: F.filter(F.array(*a), lambda x: x.isNotNull())
    t = r.select("rec_id", "collector", "session_file", "pos", *cols, "_e", some(taken).alias("_taken"), F.when(F.col("_e").isNotNull(), some(failed)).alias("cast_failures"), F.col("_e").isNotNull().alias("readable"))
    extras = F.transform(F.filter("_e", lambda e: ~F.array_contains(F.col("_taken"), e["pos"])), lambda e: F.struct(e["field"].alias("field"), e["raw"].alias("value")))
    return t.select("rec_id", "collector", "session_file", "pos", *ALIASES[feed], extras.alias("extras"), "cast_failures", "readable")
