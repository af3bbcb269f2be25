"""Review statistics and change detection on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.sync import card_stats
from recallgrid.sources.catalog import REVIEWS
from recallgrid.tables import Store


def review_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New files of a review log folder, as they come."""
    return spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_stats(reviews: DataFrame) -> DataFrame:
    """Card statistics kept up to date; for output mode update or complete."""
    return card_stats(reviews)


def windowed_stats(reviews: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, reviews, fail_rate) of event-time windows; state is dropped once the watermark has passed."""
    timed = reviews.withColumn("ts", F.timestamp_millis("review_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("reviews"), F.avg((F.col("ease") == 1).cast("double")).alias("fail_rate")).select("w.start", "w.end", "reviews", "fail_rate")


def each_snapshot(apply: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function for foreachBatch that skips empty batches: snapshot sync on a stream."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply(batch)

    return run


def each_batch_once(store: Store, stream: str, apply: Callable[[DataFrame, tuple[str, int]], None]) -> Callable[[DataFrame, int], None]:
    """A batch function for foreachBatch that applies each batch of a stream to a store once.

    ``apply`` gets the batch with (stream, number), which it hands to the store's write: the manifest then has the number.
    A batch that comes again, as its stream failed between that write and its own commit, has a number that the manifest
    knows and is passed over. Empty batches are passed over too.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number > store.applied(stream) and not batch.isEmpty():
            apply(batch, (stream, number))

    return run
