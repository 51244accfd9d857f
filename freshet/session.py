"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # an expression that fails is an error, as is division by zero
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    # one store a partition for all of a join's state, batches commit their changes only, and no look-up for a count of rows at each write
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in (SETTINGS | STREAMING).items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate results go: the session's ``spark.checkpoint.dir``, and a temporary folder only for a local master."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            where = tempfile.mkdtemp(prefix="freshet-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """The rows as they are now, in partitions that stay as they are, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
