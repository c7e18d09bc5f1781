"""The scan over a stream of fragments: stateless, the same plan as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyhound.operators.scan import findings, fragments
from keyhound.plans.rules import Config


def stream_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of Parquet files as a stream: of all that are in a folder or come into it, or of one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).isFile(at)
    # A stream's source is a folder or a pattern, so one file is a pattern that fits it alone.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)


def stream_findings(spark: SparkSession, folder: str, schema, config: Config, raw: str = "text", fragment_id: str = "doc_id") -> DataFrame:
    """Findings of the Parquet files that come into a folder. Rules are matched one fragment at a time: no state."""
    return findings(fragments(stream_rows(spark, folder, schema), raw, fragment_id), config)


def write_findings(found: DataFrame, path: str, checkpoint: str):
    """Appends findings to Parquet files, each fragment once, until what is there is read."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
