"""Tables that cut lineage, checked broadcasts and bounded batches, as the operators of this subpackage use them."""

from pyspark.sql import SparkSession

from parcelyard.scratch import Scratch, delete, shared_folder, small

__all__ = ["Scratch", "bounded_batches", "delete", "shared_folder", "small"]

#: Bytes after which Spark sends a batch to a Python worker. Spark's own bound is 64 MB, which an executor holds several times for each task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own. A longer row is a batch of its own.

    The setting stays, as lazy results are computed later; it changes no result, as operators read batches as a stream.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
