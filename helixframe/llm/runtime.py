"""What the corpus operators share: the cluster's services, with small batches of texts, and a few columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import cut, discard, freed_shuffles, shared_dir, written

__all__ = ["SPACES", "cut", "discard", "documents", "freed_shuffles", "id_bucket", "shared_dir", "ship", "text_or_empty", "written"]

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: White space of the contracts: blank and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give executors this package, and keep batches of texts small.

    A batch of rows lies in the JVM and in a Python worker at once, and texts have some KB each. The setting is changed
    only where the session has the default.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    runtime.ship(spark)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; an id that is null counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
