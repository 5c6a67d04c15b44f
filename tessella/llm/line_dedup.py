"""Line deduplication: range-partitioned line hashes, keep bitmaps per document.

Line hashes are range-partitioned by (hash, document), so that a line found in a third of all documents
spreads over many tasks, and sorted by hash, document and position within. A window streams each range's
first occurrences, one row per hash and document, which are counted where they are before the counts are
shuffled; the few hashes over the limit are joined back. What travels to the documents is not text but
a sparse bitmap of 64-line words. Its bits are the keep bitmap's complement: most documents keep all their
lines, and then there is none.

Cases: a null or empty text is one empty line; lines of rows that share a ``doc_id`` count as one
document's, and a null ``doc_id`` is a document smaller than all others; rows equal in ``doc_id`` and
text each get a row; a text of any number of lines is split whole, and of a line's places in one document
all share its fate; extra columns are ignored; an empty table gives no rows. Keys are compared by
128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import materialize

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased; ``lower`` does just that to pure ASCII and is faster."""
    key = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row_key", F.xxhash64("text"))


def first_occurrences(hashed: DataFrame, parts: int) -> DataFrame:
    """The first row of every line hash and document. The window's keys hold all keys of the ranges, so it
    runs on them without another exchange, over rows sorted by hash, document and position."""
    ranges = hashed.select("h1", "h2", "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "doc_id")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    return ranges.withColumn("nth", nth).where("nth = 1").drop("nth")


def drop_bitmaps(spark: SparkSession, docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Documents that lose lines: their dropped lines as (word, bits) pairs, 64 lines to a word."""
    lines = _rows(docs).select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_length).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_length)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row_key", "pos")
    hashed = materialize(spark, hashed, "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = first_occurrences(hashed, parts)
    frequent = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents).drop("n")
    frequent = materialize(spark, frequent, "frequent")  # a join of its own, which can be split where a line is hot
    dropped = hashed.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc_id", "row_key", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every document row with ``n_lines``, ``n_dropped`` and ``kept``, the remaining text."""
    rows = _rows(docs)
    maps = drop_bitmaps(spark, docs, min_length, min_documents).withColumnsRenamed({"doc_id": "d", "row_key": "k"})
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    return joined.select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.aggregate("bitmap", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["bits"])), F.lit(0).cast("long")).alias("n_dropped"), kept_text(F.col("text"), F.col("bitmap")).alias("kept"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines whose bit isn't set. The sparse words become a dense array, looked up by position."""
    as_map = F.map_from_entries(bitmap)
    last = F.element_at(bitmap, -1)["word"]
    dense = F.transform(F.array(as_map), lambda m: F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("long"))))
    kept = lambda words: F.filter(F.split(text, "\n", -1), lambda line, i: F.coalesce(F.call_function("getbit", F.get(words, F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0)
    return F.when(bitmap.isNull(), text).otherwise(F.array_join(F.get(F.transform(dense, kept), F.lit(0)), "\n"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN dropped THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
