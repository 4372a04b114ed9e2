"""Landed pages as a stream: the latest record of each key, kept in a Parquet table by micro-batch.

The table lies in buckets of the key's hash. A micro-batch rewrites only the buckets that it touches, each into a new numbered
version; a small manifest, moved into place last, says which version of each bucket counts. A lost executor or driver leaves the old
manifest, and with it the old table, whole; a repeated batch changes nothing. Versions that no manifest names any more are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import latest_per_key
from ..sources.storage import delete, exists, read_text, write_text

PAGE_SCHEMA = "row_id bigint, session_file string, pos bigint, market string, category_page string, product_url string, fetched_at string, html string"
BUCKETS = 64


def _manifest(spark: SparkSession, table: str) -> dict[str, int]:
    path = f"{table}/MANIFEST.json"
    return {k: int(v) for k, v in json.loads(read_text(spark, path)).items()} if exists(spark, path) else {}


def _folders(table: str, manifest: dict[str, int]) -> list[str]:
    return [f"{table}/v{v}/_bucket={b}" for b, v in sorted(manifest.items())]


def upsert(batch: DataFrame, table: str, key: str, recency: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Merges a batch into the table; rows with a null or empty key are spread over the buckets and all stay."""
    spark = batch.sparkSession
    schema = batch.schema
    spot = F.pmod(F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.xxhash64(*order)).otherwise(F.xxhash64(key)), F.lit(buckets)).cast("int")
    b = batch.withColumn("_bucket", spot).persist()
    try:
        touched = sorted(r._bucket for r in b.select("_bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return
        old = _manifest(spark, table)
        rows = b.select(*batch.columns)
        have = _folders(table, {k: v for k, v in old.items() if int(k) in touched})
        if have:
            rows = rows.unionByName(spark.read.schema(schema).parquet(*have))
        version = max(old.values(), default=0) + 1
        new = latest_per_key(rows.dropDuplicates(), key, recency, order).withColumn("_bucket", spot)
        new.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/v{version}")
        manifest = old | {str(k): version for k in touched}
        write_text(spark, f"{table}/MANIFEST.json", [json.dumps(manifest)])
        for folder in _folders(table, {k: v for k, v in old.items() if int(k) in touched}):
            delete(spark, folder)
    finally:
        b.unpersist()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as its manifest names it."""
    return spark.read.schema(PAGE_SCHEMA).parquet(*_folders(table, _manifest(spark, table)))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads new Parquet files of a folder and keeps the latest page of each address in ``table``."""
    w = spark.readStream.schema(PAGE_SCHEMA).parquet(folder).writeStream.foreachBatch(lambda b, _: upsert(b, table, "product_url", "fetched_at", ["session_file", "pos"])).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
