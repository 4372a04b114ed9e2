"""Session set-up and the small pieces of run-time configuration that operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE and UTC; a cluster's own settings win wherever they are set."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that spark.checkpoint.dir names. Where it is unset, a session on this machine gets a folder of
    its own; on a cluster a machine's own folder would lose what a lost executor wrote, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "marlstone-checkpoint")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration, written to the shared folder round by round; each new one replaces the last.

    A checkpoint keeps the size that the plan before it was estimated at, and estimates of joins multiply, so that over many rounds they
    grow beyond all bounds; a written table has its own size.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.base, self.last = spark, f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}", []
        self.made = 0

    def keep(self, *tables: DataFrame) -> list[DataFrame]:
        """The tables of this round, written and read back; those of the round before are deleted."""
        paths = []
        for t in tables:
            self.made += 1
            paths.append(f"{self.base}/{self.made}")
            t.write.mode("overwrite").parquet(paths[-1])
        self._drop()
        self.last = paths
        return [self.spark.read.schema(t.schema).parquet(p) for t, p in zip(tables, paths)]

    def _drop(self) -> None:
        for p in self.last:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, table: DataFrame) -> DataFrame:
        """The last table as a checkpoint, without the folder."""
        out = cut_lineage(table)
        self._drop()
        return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, one Parquet file or folder each."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for a Python map that costs far more than its scan: if the scan has fewer splits than the cluster
    has cores (one small file), the rows are dealt out; otherwise, and so on any large table, nothing is shuffled."""
    t = read_table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return t.repartition(cores) if t.rdd.getNumPartitions() < cores else t
