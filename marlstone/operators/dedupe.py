"""Keeping one copy of what was delivered several times, and the other keyed reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import epoch_second
from ..functions.urls import page_key


_SPAN = 10**20  # more than there are row ids


def delivery_time(session_file: Column) -> Column:
    """Seconds since 1970 of the delivery that a session file's name tells; null without one."""
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(session_file, r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss")))


def keepers(df: DataFrame, identifier: Sequence[Column], row_id: str, delivered: Column | None = None) -> DataFrame:
    """The row id that stays for each identifier: one row per identifier, column ``row_id``.

    The least (delivery time, row id) stays; without ``delivered`` the row ids themselves are in the order of delivery. A null time
    comes after all others. This is min_by over a struct of both, which Spark can only sort for, since a struct is no fixed-width
    buffer; packed into one decimal it is aggregated by hash. Partial aggregates are made before the shuffle, so that an identifier
    that holds a third of all rows sends one row a task. Rows whose identifier has a null part belong to no identifier and give no
    row; neither do rows without an id.
    """
    ident = [c.alias(f"_i{n}") for n, c in enumerate(identifier)]
    names = [f"_i{n}" for n in range(len(identifier))]
    row = F.col(row_id)
    if delivered is None:
        t = df.select(*ident, row).dropna(subset=[*names, row_id])
        return t.groupBy(*names).agg(F.min(row_id).alias(row_id)).select(row_id)
    wide = lambda c: c.cast("decimal(38,0)")
    low, span = wide(F.lit(str(2**63))), wide(F.lit(str(_SPAN)))  # ids may be negative
    packed = wide(wide(F.coalesce(delivered.cast("bigint"), F.lit(10**15))) * span + wide(row) + low)
    t = df.select(*ident, packed.alias("_p"), row).dropna(subset=[*names, row_id])
    least = t.groupBy(*names).agg(F.min("_p").alias("_p"))
    rest = F.pmod(F.col("_p"), span)
    return least.select((rest - low).cast("bigint").alias(row_id))


def page_fetch_identifier(url: str = "product_url", moment: str = "fetched_at") -> list[Column]:
    return [page_key(F.col(url)), epoch_second(F.col(moment))]


def keep_one_delivery(df: DataFrame, row_id: str = "row_id", delivered: Column | None = None, url: str = "product_url", moment: str = "fetched_at") -> DataFrame:
    """All columns of one row of each fetch; rows without an identifier (blank address, unreadable time) or without an id all stay.

    ``row_id`` must be unique; rows that share one are one delivery and stay or go together. An empty input gives an empty output.
    The ids that stay are joined to the rows once.
    """
    ident = page_fetch_identifier(url, moment)
    alone = df.filter(ident[0].isNull() | ident[1].isNull()).select(row_id)
    stay = keepers(df, ident, row_id, delivered).unionByName(alone)
    return df.join(stay, row_id, "left_semi").select(*df.columns).unionByName(df.filter(F.col(row_id).isNull()))


def surplus_deliveries(df: DataFrame, row_id: str = "row_id", delivered: Column | None = None, url: str = "product_url", moment: str = "fetched_at") -> DataFrame:
    """The ids of the rows that go: those with an identifier that are not its keeper, each once."""
    ident = page_fetch_identifier(url, moment)
    have = df.filter(ident[0].isNotNull() & ident[1].isNotNull() & F.col(row_id).isNotNull()).select(row_id)
    return have.join(keepers(df, ident, row_id, delivered), row_id, "left_anti").distinct()


def latest_per_key(df: DataFrame, key: str, recency: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest recency of each key, ties to the later in ``order``; rows with a null or empty key all stay.

    Recency that is no number counts as -1, as does NaN. max_by over a struct keeps the partial aggregation that a
    window would lose.
    """
    rec = F.coalesce(F.col(recency).try_cast("double"), F.lit(-1.0))
    rec = F.when(F.isnan(rec), -1.0).otherwise(rec)
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.filter(~blank).groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(rec, *[F.col(c) for c in order])).alias("_row")).select("_row.*")
    return best.unionByName(df.filter(blank))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``; rows with a null or empty key all stay."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.filter(~blank).groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row")).select("_row.*")
    return first.unionByName(df.filter(blank))


def walk_until_repeat(df: DataFrame, walk: str, page: str, links: str, cap: int = 1000) -> DataFrame:
    """The pages of each walk before its first empty page, or the first whose set of links equals that of the page before.

    ``cap`` is the feature of the walk (a page number), not a row limit of the operator. Pages beyond it go first, so that no walk
    brings more than ``cap`` pages into a task, repeated page numbers aside.
    """
    df = df.filter(F.col(page) <= cap)
    w = Window.partitionBy(walk).orderBy(page)
    s = F.array_sort(F.array_distinct(F.coalesce(F.col(links), F.array().cast("array<string>"))))
    stop = F.when((F.size("_s") == 0) | F.coalesce(F.col("_s") == F.lag("_s").over(w), F.lit(False)), 1).otherwise(0)
    return df.withColumn("_s", s).withColumn("_stop", stop).withColumn("_stops", F.sum("_stop").over(w)).filter("_stops = 0").drop("_s", "_stop", "_stops")
