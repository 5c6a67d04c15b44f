"""Order of rows across files: an order key without a shuffle, dense numbers, and total order on writing.

Spark packs files into tasks by size, so neither partition ids nor row ids follow the files. A row's
place is its file, the offset of the block it was read from, and its running id, which grows within a
block. Numbers are made dense by prefix sums of block counts, never by sorting rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import materialize

#: Blocks up to this number are sent to all workers; more are joined by shuffle.
MAX_SENT = 200_000


def with_order(df: DataFrame) -> DataFrame:
    """``_ord`` of a DataFrame that reads files: (file, block, row), comparable across files of any size
    and number. Rows must come straight from the scan."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("_ord", place)


def running_total(spark: SparkSession, rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before each in ``order``. Rows are
    range-partitioned and summed within their range; only one total a range passes a single task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(spark, rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    joined = ranged.withColumn("_own", own).join(F.broadcast(before), "_range")  # one row a range
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def numbered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of ``with_order`` with ``_ord`` as a dense number from 0 in file and line order, and ``_line``,
    their number from 1 in their own file. They are written once, since a second scan could be cut into
    other blocks; rows need not be filtered yet, but none may have been dropped before if lines count."""
    held = materialize(spark, rows.withColumn("_file", F.col("_ord.file")).withColumn("_block", F.col("_ord.block")).withColumn("_row", F.col("_ord.row")).drop("_ord"), "numbered")
    blocks = held.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    summed = materialize(spark, running_total(spark, blocks, ["_file", "_block"], "_n", "_base"), "blocks")
    summed = summed.withColumn("_file_base", F.min("_base").over(Window.partitionBy("_file"))).drop("_n")
    side = F.broadcast(summed) if summed.count() <= MAX_SENT else summed
    at = F.col("_base") + F.col("_row") - F.col("_first")
    out = held.join(side, ["_file", "_block"]).withColumn("_ord", at).withColumn("_line", at - F.col("_file_base") + 1)
    return out.drop("_block", "_row", "_first", "_base", "_file_base")


def write_ordered(df: DataFrame, path: str, keys: list[str], columns: list[str], partitions: int | None = None) -> None:
    """JSON lines in total order of ``keys``: ranges are written by part number, so files read by name
    give the rows sorted."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*columns).write.mode("overwrite").json(path)


