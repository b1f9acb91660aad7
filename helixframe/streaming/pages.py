"""An extension: landed JSON pages as a stream, parsed and appended once each. The batch readers are the main way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.assays import parsed


def assay_stream(spark: SparkSession, folder: str, schema: str = "genome_id string, study_pmid string, measurement string") -> DataFrame:
    """Records of every new file of folder, with parsed values."""
    return parsed(spark.readStream.schema(schema).option("multiLine", True).json(folder))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, as Parquet; a file is taken once even if the job starts again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
