"""Session helpers shared by every operator: table access, lineage cuts, sizing."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`; the scan stays prunable by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where the cluster names one, else (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def drop_shared(spark: SparkSession, path: str) -> None:
    """Removes what a query has written below the shared folder and no longer needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Seconds between two collections of garbage on the driver.
RELEASE_S = 5
_released = time.monotonic()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of plans that nothing refers to any more: it does so only when the
    driver's garbage is collected, which else may be after the query. Queries of a few seconds don't pay for it."""
    global _released
    if time.monotonic() - _released < RELEASE_S:
        return
    gc.collect()
    spark._jvm.System.gc()
    _released = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget how it was made; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    del df
    release(spark)
    return done


def shuffle_width(df: DataFrame) -> int:
    """Number of partitions the session wants for a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Balanced partitions for Python-heavy narrow work. A scan of many files has them; one of few is dealt out round-robin."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= 8 * cores else df.repartition(max(3 * cores, shuffle_width(df)))


def utc_month(ts) -> "F.Column":
    """`yyyy-MM` of a timestamp in UTC, whatever the session's time zone is."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM")


def data_dir(sf: str) -> str:
    return os.path.join("/root/testdata", sf)
