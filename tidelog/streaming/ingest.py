"""Log lines as they arrive: a file stream whose micro-batches add to the stored lines and rebuild what they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.lines import stamped
from tidelog.plans.jobs import Collection, refreshed


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of new files below `path`: path, block_start, raw; their place in a split is numbered batch by batch."""
    text = spark.readStream.option("lineSep", "\n").schema("value string").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("raw")
    )


def incremental_ingest(lines: DataFrame, store: str, checkpoint: str, refresh: Callable[[DataFrame, DataFrame], None] | None = None) -> StreamingQuery:
    """Run the stream over all that has arrived. Each micro-batch is written below `store` (batch=n), with the time of each line.

    Then `refresh(all stored lines, changed days)` may rebuild the windows on those days. There is no watermark: lines
    may come however late. A batch that is run again replaces its own rows. Changed and deleted files don't show in a file
    stream; the catalog's comparison finds those.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{store}/batch={number}"
        placed = batch.withColumn("mid", F.monotonically_increasing_id())  # straight at the read, before any shuffle
        stamped(placed).drop("pattern").write.mode("overwrite").parquet(target)
        if refresh is not None:
            days = spark.read.parquet(target).where("ts is not null").select(F.to_date("ts").alias("day")).distinct()
            refresh(spark.read.parquet(store), days)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_current(spark: SparkSession, of: Collection, checkpoint: str) -> StreamingQuery:
    """Whenever files arrive below a root, scan the collection and rebuild the packages that they touch, however late they come.

    The stream only tells that something came; what changed or went since is the scan's own comparison, so packages that
    no rule gives any more go too.
    """
    arrived = None
    for root in of.roots.values():
        names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root).select("path")
        arrived = names if arrived is None else arrived.union(names)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            refreshed(batch.sparkSession, of)

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
