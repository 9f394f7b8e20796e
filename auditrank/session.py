"""Session settings and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Settings for a cluster run.  AQE coalesces small shuffle partitions, splits
#: skewed join partitions and turns a join into a broadcast only after it has
#: measured the side.  The runtime Bloom filter drops ledger rows without a
#: matching reversal header before they are shuffled.  Sets collected per
#: document or pair hold a few texts, so many of them fit into a hash aggregate
#: before it has to sort.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app_name: str = "auditrank", master: str | None = None, **settings: str) -> SparkSession:
    """Session with :data:`CLUSTER_SETTINGS`; ``settings`` override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder named in ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode; on a cluster a missing
    setting is an error, because executors do not share a local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"auditrank-{application}-")


#: Settings while a table is staged.  Shuffle files go when their query ends, not when the
#: driver's JVM next collects garbage, which may be many queries later.  Arrow batches of
#: texts stay small: a task holds several copies of one, here and in its Python worker.
STAGE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def _stage_settings(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STAGE_SETTINGS}
    for key, value in STAGE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Used where a result is read several times, or where a sampled layout must
    not change between reads.  The lineage ends at the files, so a lost
    executor costs a re-read and no recomputation, and the shuffle files behind
    the table are not needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _stage_settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
