"""Writers. Tables go to Parquet; the exports below are for results that people read."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import sheet
from .storage import exists, write_text

# The order in which an export's known columns come.
PREFERRED = ["market_name", "listing_title", "price", "dosage", "rating", "review", "description", "number_in_stocks", "original_url", "category_page", "fetched_at"]
EXPORT_ROWS = 1_000_000  # a JSON array is one file for people; larger results stay Parquet


def column_order(columns: Sequence[str], last: Sequence[str] = ("matched_terms", "matched_categories")) -> list[str]:
    """Preferred columns that are present, then the others sorted, then ``last``; each once."""
    head = [c for c in PREFERRED if c in columns]
    tail = [c for c in last if c in columns]
    return head + sorted(c for c in columns if c not in head and c not in tail) + tail


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, files: int | None = None) -> None:
    """A CSV folder with a header in each file; an empty result writes the header alone, so that nothing stale stays.

    ``files``, if given, is the number of files; one file makes one task of the last step, so it is for results that people read.
    """
    out = sheet(df, list(columns or column_order(df.columns)))
    if files:
        out = out.repartition(files)
    out.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One JSON array file, put in place at once; returns the number of rows.

    Rows stream through the driver, a partition at a time. More than EXPORT_ROWS rows are refused: those go to ``write_json_parts``.
    """
    n = df.count()
    if n > EXPORT_ROWS:
        raise ValueError(f"{n} rows are too many for one JSON file; use write_json_parts")

    def parts() -> Iterator[str]:
        yield "["
        for k, row in enumerate(df.toJSON().toLocalIterator()):
            yield (",\n" if k else "\n") + json.dumps(json.loads(row), ensure_ascii=False, indent=1)
        yield "\n]\n"

    write_text(df.sparkSession, path, parts())
    return n


def write_json_parts(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, written by the tasks; whatever the number of rows."""
    df.write.mode("overwrite").json(path)


def write_progress(progress: DataFrame, path: str) -> None:
    """{site: [terms sorted without case]} of a (site, term) table; a checkpoint of the crawl's own sites and terms."""
    rows = progress.groupBy("site").agg(F.array_sort(F.collect_set("term")).alias("terms")).collect()
    write_text(progress.sparkSession, path, [json.dumps({"markets": {r.site: sorted(r.terms, key=str.lower) for r in rows}}, ensure_ascii=False, indent=1)])


def append_new(new: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet table lacks; returns how many."""
    spark = new.sparkSession
    fresh = new.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n
