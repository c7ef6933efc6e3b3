"""Predictions that arrive as a stream: merged by id, cells rescored as they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a batch of fewer rows are broadcast to the stored ones.
SMALL_BATCH = 1_000_000
#: Folders of a stored batch, by the hash of the id.
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("query_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def merge_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, on_cells: Callable[[DataFrame, int], None] | None = None, on_conflict: str = "error", on_rows: Callable[[DataFrame, int], object] | None = None):
    """Append each new prediction of the Parquet files in source to store, exactly once by query_id.

    A batch writes its own folder of store, and a retried one writes it again, so
    a restart adds no row twice. A batch's rows are dealt to BUCKETS folders by the
    hash of their id; of earlier batches only the folders are read that an id of this one can be in. One id with two different rows is an error, or
    with on_conflict="keep" the row that came first stays (within a batch, any).
    on_cells gets the (domain, task) cells that a batch touched, on_rows the rows
    that it added; both may see a batch again after a restart, under its number.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    columns = [c.split()[0] for c in schema.split(",")]

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.distinct()
        known = None
        if number:
            touched = [r["bucket"] for r in fresh.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            known = spark.read.schema(schema + ", batch int, bucket int").option("basePath", store).parquet(f"{store}/batch=*").where((F.col("batch") < number) & F.col("bucket").isin(touched))
            known = known.select(*columns).join(F.broadcast(fresh.select("query_id").distinct()) if fresh.count() < SMALL_BATCH else fresh.select("query_id").distinct(), "query_id", "left_semi").select(*columns)
        rows = fresh.select(*columns).unionByName(known).distinct() if known is not None else fresh.select(*columns)
        twice = rows.groupBy("query_id").count().where("count > 1").agg(F.count(F.lit(1)), F.min("query_id")).first()
        if on_conflict == "keep":
            fresh = fresh.dropDuplicates(["query_id"])
        elif twice[0]:
            raise ValueError(f"{twice[0]} ids with different rows, e.g. {twice[1]}")
        if known is not None:
            fresh = fresh.join(known.select("query_id"), "query_id", "left_anti").select(*columns)
        fresh.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        if on_rows:
            on_rows(spark.read.schema(schema).parquet(f"{store}/batch={number}"), number)
        if on_cells:
            on_cells(spark.read.schema(schema).parquet(f"{store}/batch={number}").select("domain", "task").distinct(), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
