"""Cut lineage at a reused intermediate result.

A DataFrame that several branches of one plan read (e.g. the weekly flow
table feeding the calendar bounds, the entity list and the panel) is
written once as a parquet table under the shared folder the cluster
names in ``spark.checkpoint.dir`` and read back.  Compared with
``Dataset.checkpoint()`` this is one job instead of two (the RDD
checkpoint recomputes its input), the data is columnar and compressed,
and later reads still get column pruning and filter pushdown.  Like a
reliable checkpoint it survives the loss of executors; a
``localCheckpoint`` or ``cache`` would not.

A lazy result reads its intermediates when it runs, so they must outlive
the call that wrote them.  ``with intermediates(spark):`` around building
and running a query deletes what it wrote once the result is stored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from supplyrisk.session import checkpoint_dir

_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder; ``intermediates`` deletes it."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def materialize(df: DataFrame, enabled: bool = True, name: str = "mat") -> DataFrame:
    if not enabled:
        return df
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch paths handed out inside the block when it ends."""
    mark = len(_written)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in _written[mark:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        del _written[mark:]
