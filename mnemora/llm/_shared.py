"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mnemora.session import fresh_path, remove, shared_dir
from mnemora.session import stored as written

__all__ = ["SPACES", "fresh_path", "remove", "shared_dir", "small_batches", "written"]

#: The characters that separate words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch between an executor and its Python workers; Spark's own 10,000 whole texts are many MB.
ARROW_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory that batches of whole texts take, in this session, unless it has a lower bound already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
