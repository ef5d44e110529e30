"""A folder that documents are dropped into, as a stream of bundles.

Files arrive through the binary file source; each micro-batch is refined like a table. A document is known by the SHA-256 of its bytes, and one that the target already holds is left out by an anti
join of digests, so a file that is dropped twice, or a batch that is replayed after a failure, is not written again. No state is kept
besides the checkpoint and the target itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from .. import policy
from ..plans import refine

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = policy.MAX_BATCH) -> DataFrame:
    """Accepted files of the folder as a stream, so many a batch at most."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.where(f"length BETWEEN 1 AND {policy.MAX_INPUT}").where("lower(path) RLIKE '[.](epub|fb2|fb2[.]zip|pdf)$'")


def write_new(batch: DataFrame, target: str, outputs=None, profile: str | None = "archive") -> None:
    """Append the bundles of the documents that the target does not hold; failures are rows with their error."""
    spark = batch.sparkSession
    new = batch.withColumn("doc_id", F.sha2("content", 256)).dropDuplicates(["doc_id"])
    try:
        known = spark.read.parquet(target).select("doc_id")
    except AnalysisException:  # nothing written yet
        known = None
    if known is not None:
        new = new.join(known, "doc_id", "left_anti")
    digests = new.select("path", "doc_id")
    refine.bundles(new, outputs, profile).join(digests, "path").write.mode("append").parquet(target)


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, outputs=None, profile: str | None = "archive", once: bool = False) -> StreamingQuery:
    """Start the stream; ``once`` works off what is there and stops."""
    refine.chosen(outputs, profile)
    stream = arrivals(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    if once:
        stream = stream.trigger(availableNow=True)
    return stream.foreachBatch(lambda batch, _: write_new(batch, target, outputs, profile)).start()


def states(made: DataFrame) -> DataFrame:
    """Documents by state (``success`` or the error code), as a progress figure."""
    return made.groupBy(F.coalesce("error", F.lit("success")).alias("state")).agg(F.count("*").alias("documents"))
