"""What pinned tables leave behind."""
from pathlib import Path

from pyspark.sql import functions as F

from loanwatch import session


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def test_a_pinned_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(2000).groupBy((F.col("id") % 700).alias("k")).count().join(spark.range(900).withColumnRenamed("id", "k").hint("merge"), "k")
    was = spark.conf.get(session._CLEANUP, None)
    pinned = session.pin(df)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(session._CLEANUP, None) == was
    assert pinned.count() == df.count() == session.pin(df).count() == 700      # the frame itself can still be read
