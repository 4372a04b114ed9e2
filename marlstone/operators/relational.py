"""Set, join and report operators of the listing pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell
from .windows import prefix_sum


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both as text; columns of ``a``, then new ones of ``b``; what is missing or null is ''."""
    u = a.select([F.col(c).cast("string") for c in a.columns]).unionByName(b.select([F.col(c).cast("string") for c in b.columns]), allowMissingColumns=True)
    return u.na.fill("")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str], folded: Sequence[str] = ()) -> DataFrame:
    """The rows of ``wanted`` without an equal key in ``done``; the ``folded`` keys compare without case."""
    k = [F.lower(F.col(c)).alias(f"_{c}") if c in folded else F.col(c).alias(f"_{c}") for c in keys]
    d = done.select(*k).distinct()
    w = wanted.select("*", *k)
    return w.join(d, [f"_{c}" for c in keys], "left_anti").select(*wanted.columns)


def grid(left: DataFrame, right: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """Every row of ``left`` with every value of a small dimension's column, which becomes one literal array.

    A dimension of more than ``most`` distinct values is refused: the result is asked for by its definition, but not by the gigabyte.
    """
    values = [r[0] for r in right.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} values of {column}; use the grid in parts")
    kind = right.schema[column].dataType
    return left.withColumn(column, F.explode(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind.simpleString()}>")))


def union_existing(spark, paths: Sequence[str], schema: str) -> DataFrame:
    """All rows of the Parquet tables that are there, by name; columns that a table lacks are null; tables that are missing are skipped."""
    from ..sources.storage import exists

    out = spark.createDataFrame([], schema)
    for p in paths:
        if exists(spark, p):
            out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out.select(*[f.name for f in spark.createDataFrame([], schema).schema])


def with_cache(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Each row with its cached columns, null where the cache has none; of equal cache keys the least row counts."""
    rest = [c for c in cache.columns if c != key]
    one = cache.groupBy(key).agg(F.min(F.struct(*rest)).alias("_c")).select(key, *[F.col(f"_c.{c}").alias(c) for c in rest])
    return df.join(one, key, "left")


def without_cache(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that the cache lacks."""
    return df.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


def overlay(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Row-wise merge in which the right side wins."""
    return df.withColumns(columns)


def approved(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true; null and false go."""
    return df.filter(F.col(flag).eqNullSafe(True))


def distinct_over(sources: Sequence[DataFrame], column: str) -> DataFrame:
    """One row with the number of distinct non-blank values of a column over several tables."""
    u = sources[0].select(column)
    for s in sources[1:]:
        u = u.unionByName(s.select(column))
    return u.filter(F.coalesce(F.col(column), F.lit("")) != "").agg(F.countDistinct(column).alias("n_distinct"))


def counts_by(df: DataFrame, group: str, flag: str, values: Sequence[str]) -> DataFrame:
    """Conditional counts: one column for each value of ``flag``."""
    return df.groupBy(group).agg(*[F.count_if(F.col(flag) == v).alias(f"n_{v}") for v in values])


def share(counts: DataFrame, total: DataFrame, parts: Sequence[str]) -> DataFrame:
    """One row: parts, their sum, the rest and the sum's share of the total in percent to four places.

    A total of 0, or one that the parts exceed, is an error.
    """
    s = counts.agg(*[F.coalesce(F.sum(p), F.lit(0)).cast("bigint").alias(p) for p in parts]).withColumn("_one", F.lit(1))
    t = s.join(total.select(F.col(total.columns[0]).alias("total")).withColumn("_one", F.lit(1)), "_one").drop("_one")
    both = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    bad = F.when(F.col("total") <= 0, F.raise_error(F.lit("the total is 0")).cast("bigint")).when(both > F.col("total"), F.raise_error(F.lit("the parts exceed the total")).cast("bigint")).otherwise(both)
    return t.withColumn("combined", bad).withColumn("other", F.col("total") - F.col("combined")).withColumn("share_pct", F.round(100.0 * F.col("combined") / F.col("total"), 4))


def candidates(mentions: DataFrame, key: str, source: str, name: str, order: str) -> DataFrame:
    """(key, name, sources, search_hits): a candidate's sources as a sorted set, its first non-blank name, and how many sources are searches."""
    t = mentions.filter(F.coalesce(F.col(key), F.lit("")) != "")
    g = t.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("_s"), F.min(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("_n"))
    return g.select(key, F.coalesce("_n.n", F.lit("")).alias("name"), F.array_join("_s", "; ").alias("sources"), F.size(F.filter("_s", lambda x: F.startswith(x, F.lit("search:")))).alias("search_hits"))


def ranked(df: DataFrame, score: str, hits: str, order: str) -> DataFrame:
    """Rows in rank order: score descending with null as -1, hits descending, then the input's order."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(-1)).desc(), F.col(hits).desc(), F.col(order))


def sorted_folded(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of a text column whatever its case; equal ones by the text itself."""
    return df.orderBy(F.lower(column), column)


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """A top-n report: the first n rows of each group. A first rank within salted parts leaves at most 64 n rows a group for
    the second, so a hot group fills no task; Catalyst turns both into group limits before their shuffles."""
    salt = F.pmod(F.xxhash64(order), F.lit(64))
    part = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order))).filter(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= n).drop("_salt", "_r")


def expand_pages(urls: DataFrame, url: str, group: str, cap: int = 1000) -> DataFrame:
    """(group, url): of each group the template with most distinct numbers, filled from its least number on, to its greatest or ``cap`` pages.

    A template is an address with its last run of digits cut out; ties go to the least template. Groups with fewer than two
    numbers keep their addresses. The numbers of one group's template are only counted, never gathered.
    """
    m = r"^(.*?)(\d+)(\D*)$"
    u = urls.select(F.col(group).alias("_g"), F.col(url).alias("_u")).filter("_u is not null").distinct()
    u = u.withColumn("_n", F.nullif(F.regexp_extract("_u", m, 2), F.lit("")).try_cast("bigint")).withColumn("_t", F.concat(F.regexp_extract("_u", m, 1), F.lit("{n}"), F.regexp_extract("_u", m, 3)))
    v = u.filter("_n is not null").groupBy("_g", "_t").agg(F.countDistinct("_n").alias("c"), F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    best = v.groupBy("_g").agg(F.min(F.struct((-F.col("c")).alias("k"), F.col("_t").alias("t"), "lo", "hi")).alias("b"))
    best = best.filter("b.k <= -2")
    filled = best.select("_g", F.explode(F.transform(F.sequence("b.lo", F.least(F.col("b.hi"), F.col("b.lo") + cap - 1)), lambda n: F.replace(F.col("b.t"), F.lit("{n}"), n.cast("string")))).alias("_u"))
    kept = u.select("_g", "_u").join(best.select("_g"), "_g", "left_anti")
    return filled.unionByName(kept).select(F.col("_g").alias(group), F.col("_u").alias(url))


def sheet(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A fixed list of columns as cells; columns that are missing are ''."""
    kinds = dict(df.dtypes)
    return df.select([cell(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns])


def running_metrics(runs: DataFrame, order: str, values: Sequence[str], bucket: Column) -> DataFrame:
    """Each run with ``total_<value>``: the sum up to and with it."""
    t = runs
    for v in values:
        t = prefix_sum(t, bucket, [F.col(order)], v, f"_before_{v}").withColumn(f"total_{v}", (F.col(f"_before_{v}") + F.coalesce(F.col(v), F.lit(0))).cast("bigint")).drop(f"_before_{v}")
    return t


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within ``depth`` hops of the start nodes, each with its least hops; rounds of anti joins over the edge table."""
    from ..session import cut_lineage

    seen = cut_lineage(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).filter("node is not null").distinct()
        front = cut_lineage(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    return seen


def attempt_status(attempts: DataFrame) -> DataFrame:
    """(…, status): done, retry or more, of each search attempt (fetched, n_results, countless, usable, page, links, repeated, cap_hit)."""
    status = (
        F.when(~F.coalesce(F.col("fetched"), F.lit(False)), "retry")
        .when(F.col("n_results").isNull() & ~F.col("countless"), "retry")
        .when(F.col("n_results") == 0, "done")
        .when((F.col("page") == 1) & (F.col("links") == 0), F.when(F.col("countless") & F.col("usable"), "done").otherwise("retry"))
        .when((F.col("links") == 0) | F.col("repeated"), "done")
        .when(F.col("cap_hit"), "retry")
        .otherwise("more")
    )
    return attempts.withColumn("status", status)
