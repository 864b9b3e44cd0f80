"""The state store that keyed operators need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Groups that the keys of a stream's state are dealt into by their hash.  A group costs some
#: milliseconds a batch, a key inside it one or two look-ups, so many small keys share one.
GROUPS = 1024
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; a stream reads the setting when it starts."""
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)
