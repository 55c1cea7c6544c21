"""New items as a stream: late and repeated deliveries, links to known content, counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing_to_null


def read_items(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def first_deliveries(items: DataFrame, late: str = "2 days") -> DataFrame:
    """Each item once: later deliveries within the watermark are dropped with bounded state."""
    return items.where("item_id IS NOT NULL").withWatermark("imported_at", late).dropDuplicatesWithinWatermark(["item_id"])


def imports_over_time(items: DataFrame, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Imports and unreadable items per source and time window."""
    unreadable = F.count_if(missing_to_null("sha256_pixels").isNull()).alias("n_unreadable")
    return items.withWatermark("imported_at", late).groupBy(F.window("imported_at", size), "source_dataset").agg(F.count("*").alias("n"), unreadable)


def link_known_content(batch: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links from the first item of equal content to new ones, and the index rows to append.

    index: ``sha256_pixels`` and ``item_id`` of the first item of each content.
    Within a batch the smallest id stands for new content.
    """
    read = batch.select("item_id", missing_to_null("sha256_pixels").alias("sha256_pixels")).where("sha256_pixels IS NOT NULL").distinct()
    known = index.select("sha256_pixels", F.col("item_id").alias("known"))
    fresh = read.groupBy("sha256_pixels").agg(F.min("item_id").alias("fresh")).join(known, "sha256_pixels", "left")
    firsts = fresh.select("sha256_pixels", F.coalesce("known", "fresh").alias("a"), F.col("known").isNull().alias("is_new"))
    links = read.join(firsts, "sha256_pixels").where("item_id <> a").select("a", F.col("item_id").alias("b"))
    return links, firsts.where("is_new").select("sha256_pixels", F.col("a").alias("item_id"))


def maintain_links(items: DataFrame, index_path: str, links_path: str, checkpoint: str):
    """Start a query that keeps an index of contents and a table of links up to date.

    Each micro-batch writes its own folder, replaced if the batch is repeated
    after a failure, and reads the index of earlier batches only.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], "sha256_pixels string, item_id long, batch long")
        try:
            index = spark.read.schema(empty.schema).parquet(index_path).where(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            index = empty
        links, new = link_known_content(batch, index)
        links.write.mode("overwrite").parquet(f"{links_path}/batch={number}")
        new.write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
