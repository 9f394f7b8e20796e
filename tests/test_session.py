import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from auditrank.session import stage

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {Path(files.apply(i).getPath()).name for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_staged_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(FREED)
    table = stage(spark.range(1000).repartition("id"), "freed")
    end = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert table.count() == 1000
    assert spark.conf.get(FREED) == setting


def test_staged_texts_pass_in_small_arrow_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    texts = spark.range(0, 5_000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 512).alias("text"))
    found = [r.size for r in stage(texts.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) >= 5_000 * 4_096 and max(found) < 6 << 20
