"""Usage tables over files that arrive one by one: the batch functions on a file stream.

Junction files are folded into running site counts; a file already seen is never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from splicelake.session import scratch_dir
from splicelake.sources.lines import parse_bed12


def junction_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Junction rows of every new file below ``folder``."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_bed12(lines)


def site_counts(junctions: DataFrame) -> DataFrame:
    """Alpha per site: one grouped sum over both junction ends (complete or update output mode)."""
    ends = F.explode(F.array("jleft", "jright"))
    return junctions.select("region", "strand", ends.alias("site"), "n").groupBy("region", "strand", "site").agg(F.sum("n").alias("alpha"))


def keep_counts(counts: DataFrame, name: str) -> tuple[StreamingQuery, str]:
    """Process everything available. Each batch writes the counts that it changed to a folder of its own; state lies beside them.

    A batch that is repeated overwrites its folder, so the output survives lost executors and drivers.
    """
    path = scratch_dir(counts.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    stream = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    return stream.start(), f"{path}/updates"


def latest_counts(spark: SparkSession, folder: str, keys: Sequence[str] = ("region", "strand", "site"), value: str = "alpha") -> DataFrame:
    """The last written count of each key."""
    updates = spark.read.parquet(folder)
    return updates.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
