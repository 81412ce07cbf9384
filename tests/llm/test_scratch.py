import os

from quillon.llm import scratch
from quillon.runtime import shared_dir


def test_tables_lie_in_the_shared_folder_and_can_be_purged(spark):
    scratch.prepare(spark)
    base = shared_dir(spark)
    assert base.startswith(spark.conf.get("spark.checkpoint.dir").replace("file:/", "file:///", 1) if "///" not in spark.conf.get("spark.checkpoint.dir") else spark.conf.get("spark.checkpoint.dir"))
    df = scratch.stash(spark.range(3), "three")
    assert df.count() == 3 and "three" in df.inputFiles()[0]
    other = scratch.new_path(spark, "three")
    assert other != scratch.new_path(spark, "three")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(scratch.BATCH_ROWS)
    scratch.purge(spark)
    assert not os.path.exists(base.removeprefix("file://"))
