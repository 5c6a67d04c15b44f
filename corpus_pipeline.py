"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows are told apart by (doc_id, hash of text), so rows that share an id are judged each
on their own text. Null ids, null texts and empty tables pass through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate as contamination
from tessella.llm import jaccard_join, line_dedup, packing, quality_rules
from tessella.session import materialize


#: Columns that stages add for themselves; no column of the documents has such a name.
_ROW, _KEPT, _DOC, _KEY, _TEXT, _ID, _HEAD, _MAP = (f"__stage_{x}" for x in ("row", "kept", "doc", "key", "text", "id", "head", "map"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key standing for doc_id and text."""
    return docs.withColumn(_ROW, F.xxhash64("doc_id", "text", F.col("text").isNull()))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is the doc_id of a row of ``kept``."""
    keys = kept.select(F.col("doc_id").alias(_KEPT)).distinct()
    rows = _keyed(docs)
    return rows.join(keys.hint("shuffle_hash"), F.col(_ROW) == F.col(_KEPT), "left_semi").select(*docs.columns)


def _as_ids(docs: DataFrame, *columns: str) -> DataFrame:
    return _keyed(docs).select(F.col(_ROW).alias("doc_id"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    own = ["text", "lang"] if "lang" in docs.columns else ["text"]
    return _only(docs, quality_rules.quality_rules(spark, _as_ids(docs, *own)).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose their repeated lines; ``n_chars`` follows the text."""
    maps = line_dedup.drop_bitmaps(spark, docs).withColumnsRenamed({"doc_id": _DOC, "row_key": _KEY, "bitmap": _MAP})
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.withColumn(_ROW, key).join(maps.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(_DOC)) & (F.col(_ROW) == F.col(_KEY)), "left")
    text = F.when(F.col(_MAP).isNull(), F.col("text")).otherwise(line_dedup.kept_text(F.col("text"), F.col(_MAP)))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(_MAP).isNull(), F.col("n_chars")).otherwise(F.length(_TEXT)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumn(_TEXT, text).select(*(F.col(_TEXT).alias(c) if c == "text" else changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays, once; ids that are null come last, and
    of different texts with one id the one with the smallest row key comes first."""
    rows = _keyed(docs)
    joined = jaccard_join.jaccard_join(spark, _as_ids(docs, "text")).select(F.col("doc_id").alias(_KEY), "component_id").distinct()
    ids = rows.select(_ROW, F.col("doc_id").cast("long").alias(_ID)).distinct()
    order = F.struct(F.col(_ID).isNull(), _ID, _ROW)
    heads = joined.join(ids.hint("shuffle_hash"), F.col(_KEY) == F.col(_ROW)).groupBy("component_id").agg(F.min(order)[_ROW].alias(_HEAD))
    stay = rows.join(heads.select(_HEAD).hint("shuffle_hash"), F.col(_ROW) == F.col(_HEAD), "left_semi")
    # rows equal in id and text may differ in other columns: one of them by a hash of all
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(_DOC)
    return stay.groupBy(_ROW).agg(first).select(f"{_DOC}.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _only(docs, contamination.decontaminate(spark, _as_ids(docs, "text"), benchmark).where("not contaminated"))


def sequences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What is left, packed into sequences: the pieces with their ids."""
    return packing.pack(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of ``sequences``."""
    return sequences(spark, docs).drop("ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_free),
    ("packing", pack),
]

#: Fertility bands, set similarity and tokens have no SQL form; the tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
