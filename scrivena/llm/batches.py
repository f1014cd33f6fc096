"""How much text goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of some BATCH_BYTES to Python, or one longer row, if it names no other size.

    Spark's own size, 64 MB, is held several times over by each core: as buffers that double, as sent and as received.
    """
    conf = df.sparkSession.conf
    if conf.get(KEY, None) is None:
        conf.set(KEY, BATCH_BYTES)
    return df
