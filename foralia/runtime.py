"""Session-level helpers: where intermediate tables go and how test tables are read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark setting: delete shuffle files at the end of the execution that wrote them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows in an Arrow batch between the JVM and Python: texts are kilobytes each, so Spark's 10,000 would be tens of MB.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_ROWS rows for this session; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs on this machine alone (local tests) a folder of this machine is used, and the
    setting is filled in; on a cluster without the setting executors would write where no other sees it: an error.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="foralia-scratch-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that runs in here go when it is done."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read of files, never a recomputation. The job's shuffle
    files go when it is done, as nothing will ask for them again.
    """
    spark = df.sparkSession
    text_batches(spark)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing will read again."""
    spark = df.sparkSession
    root = scratch_dir(spark).removeprefix("file://").rstrip("/")
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is never broadcast: for narrow tables, of which a shuffle costs little, in steps of many joins.

    Whatever its size, each broadcast costs the driver a buffer of spark.broadcast.blockSize (4 MB), the table's pages and a thread.
    """
    return df.hint("merge")


def free_driver(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage now, for steps of many small jobs.

    Each job leaves buffers of spark.broadcast.blockSize that count as garbage only; the JVM takes more memory for new ones until it
    happens to collect. Spark's cleaner frees what broadcasts and shuffles hold after a collection only, too.
    """
    spark._jvm.System.gc()


def spread(df: DataFrame, tasks_a_core: int = 1) -> DataFrame:
    """`df` over all cores where it comes in fewer parts, as one small file does; for work that costs far more than moving its rows.

    A file is read by its row groups, so parts of a file may be empty: rows that cost much more than their bytes ask for several tasks a core.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * tasks_a_core
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


#: Parts by key for each part that a table is read in: what is folded into arrays is many times its compressed bytes.
FOLD_PARTS = 16


def parts_to_fold(df: DataFrame) -> int:
    """How many parts to deal `df` into where rows of a key are folded into arrays; it grows with the bytes read.

    Left to itself Spark joins shuffled parts up to 64 MB of compressed bytes, which open into gigabytes in one task.
    """
    return df.rdd.getNumPartitions() * FOLD_PARTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by the path only Spark needs to understand."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
