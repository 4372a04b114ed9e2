"""Far too many small files: records without loss or repeats, grouped by cumulative size into few files.

Planning is SQL only: the manifest is frozen in an order, bytes are window-summed in that order, and files are assigned
to intervals of the target size. The rewrite is one shuffle by group, and counts are reconciled afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.json_records import records_column
from ..sources.storage import delete
from .windows import prefix_sum

TARGET_BYTES = 128 * 1024 * 1024
MANIFEST_BUCKET = 8192


def file_records(files: DataFrame, payload: bool = False) -> DataFrame:
    """(file_id, rec_no, at, product_url, fetched_at[, payload]): the complete records of all files; empty files have none."""
    t = files.select("file_id", F.explode(records_column(F.col("content"), ["product_url", "fetched_at"], payload)).alias("_r"))
    return t.select("file_id", "_r.*")


def kept_records(files: DataFrame) -> DataFrame:
    """(file_id, rec_no, at): of equal product_url and fetched_at the smallest (file_id, rec_no); all with a null or empty product_url.

    Null moments are equal to each other. One pass and one partially aggregated shuffle; a third of all rows being one record sends
    one row a task.
    """
    blank = F.coalesce(F.col("product_url"), F.lit("")) == ""
    r = file_records(files).withColumn("_own", F.when(blank, F.struct("file_id", "rec_no")))
    r = r.groupBy(F.when(~blank, F.col("product_url")).alias("_u"), F.when(~blank, F.col("fetched_at")).alias("_f"), "_own")
    return r.agg(F.min(F.struct("file_id", "rec_no", "at")).alias("_m")).select("_m.file_id", "_m.rec_no", "_m.at")


def plan_groups(manifest: DataFrame, size: str = "size_bytes", order: str = "file_id", target: int = TARGET_BYTES) -> DataFrame:
    """The manifest with ``start_byte`` and ``group_no``: files whose starts fall in one interval of ``target`` bytes go together.

    Null and negative sizes count as 0. The manifest is frozen in ranges of its order of about MANIFEST_BUCKET files each, whatever the
    ids look like; sums run inside the ranges, and only one row for each range meets in one task.
    """
    m = manifest.withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)))
    ranges = max(1, -(-m.count() // MANIFEST_BUCKET))
    m = cut_lineage(m.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    m = prefix_sum(m, F.col("_range"), [F.col(order)], "_size", "start_byte").drop("_size", "_range")
    return m.withColumn("group_no", F.floor(F.col("start_byte") / target).cast("bigint"))


def group_of(start: Column, at: Column, target: int) -> Column:
    """The interval of ``target`` bytes in which a record begins; a file that is larger than an interval is cut where records begin."""
    return F.floor((start + at) / target).cast("bigint")


def rewrite(files: DataFrame, out: str, target: int = TARGET_BYTES) -> DataFrame:
    """Writes every kept record to Parquet files of about ``target`` input bytes and returns the reconciliation of each group.

    Groups are ranges of the frozen manifest's bytes, so the rewrite is one range partitioning by group: a task writes one or a few whole
    groups, and a group is one file. The reconciliation (group_no, planned_records, written_records) is read back from what was written.
    """
    plan = plan_groups(files.select("file_id", "size_bytes"), target=target).select("file_id", "start_byte")
    keep = cut_lineage(kept_records(files).join(plan, "file_id").select("file_id", "rec_no", group_of(F.col("start_byte"), F.col("at"), target).alias("group_no")))  # read twice below
    rec = file_records(files, payload=True).drop("at").join(keep, ["file_id", "rec_no"])
    planned = cut_lineage(keep.groupBy("group_no").agg(F.count(F.lit(1)).alias("planned_records")))
    n = max(1, planned.count())
    rec.repartitionByRange(n, "group_no").sortWithinPartitions("group_no", "file_id", "rec_no").write.mode("overwrite").partitionBy("group_no").parquet(out)
    back = files.sparkSession.read.schema(rec.schema).parquet(out).groupBy("group_no").agg(F.count(F.lit(1)).alias("written_records"))
    return planned.join(back, "group_no", "full").na.fill(0, ["planned_records", "written_records"])


def own_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/groups-{uuid.uuid4().hex}"


def consolidated(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(file_id, rec_no) of every record as it stands in the planned, rewritten and reconciled groups.

    ``target`` is the size of a group in input bytes. The groups are written to a folder of their own beside the checkpoints and dropped once their rows are read back; ``rewrite``
    keeps them where it is told to. A group whose counts differ from the plan raises.
    """
    spark = files.sparkSession
    out = own_folder(spark)
    try:
        wrong = rewrite(files, out, target).filter("planned_records <> written_records").limit(5).collect()
        if wrong:
            raise RuntimeError(f"groups not written as planned: {wrong}")
        return cut_lineage(spark.read.schema("file_id bigint, rec_no bigint").parquet(out).select("file_id", "rec_no"))
    finally:
        delete(spark, out)


def group_report(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(group_no, n_files, n_bytes, n_records): the plan's groups with the kept records of each."""
    plan = plan_groups(files.select("file_id", "size_bytes"), target=target)  # a group's files are those that begin in it
    kept = kept_records(files).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        plan.join(kept, "file_id", "left").groupBy("group_no")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("n_bytes"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_records"))
    )
