"""Sharding by extendible hashing.

Documents are hashed to bit strings. The directory starts with one bucket; a bucket over the byte
limit splits on its next bit, others stay, until every shard fits. All levels of a stretch of bits
come from one aggregation of (prefix, bytes) and the directory is a small table of leaves joined back.

The hash of a document is the first 60 bits of SHA-256 over its id and the SHA-256 of its text. Rows
equal in both are copies of one another: they share all bits, so they are counted as one key, and a
key whose copies exceed the limit is dealt to as many numbered sub-shards as its bytes need.

Cases: a null or empty text has 0 bytes; a null ``doc_id`` hashes as the empty string; a single
document larger than the limit cannot be split and is a shard of its own, marked ``oversize``; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialize

LIMIT_BYTES = 8 << 20
#: Bytes of the shards of ``small_shards``.
SMALL_BYTES = 1 << 16
HASH_BITS = 60
#: Bits examined in one aggregation; a stretch has at most 2**STRETCH prefixes per open bucket.
STRETCH = 12


def keyed(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): its hash, bytes and copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    grouped = rows.groupBy("doc_id", "digest").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    hashed = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("digest")), 256)
    return grouped.select("doc_id", "n_bytes", "copies", F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").alias("hash"), (F.col("n_bytes") * F.col("copies")).alias("held"))


def _prefix(column: str, depth) -> F.Column:
    return F.expr(f"shiftright({column}, cast({HASH_BITS} - {depth} as int))")


def shard(spark: SparkSession, docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row per document row: its shard (depth, prefix, part), the shard's bytes and whether the
    shard is one document over the limit."""
    rows = materialize(spark, keyed(docs), "shard-keys")
    open_rows = rows.select("hash", "held")
    leaves, depth = None, 0
    while True:
        deep = min(depth + STRETCH, HASH_BITS)
        fine = open_rows.groupBy(_prefix("hash", deep).alias("fine")).agg(F.sum("held").alias("held"), F.count("*").alias("keys"))
        # every ancestor of a fine prefix at the depths of this stretch
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"), "fine", "held", "keys")
        level = levels.groupBy("depth", F.expr(f"shiftright(fine, cast({deep} - depth as int))").alias("prefix")).agg(F.sum("held").alias("held"), F.sum("keys").alias("keys"))
        level = level.withColumn("fits", (F.col("held") <= limit_bytes) | (F.col("keys") == 1) | ((F.col("depth") == deep) & F.lit(deep == HASH_BITS)))
        parent = level.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        found = level.where("fits").withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left_semi")
        if depth == 0:
            found = found.unionByName(level.where("fits and depth = 0").withColumn("up", F.lit(0).cast("long")))
        found = materialize(spark, found.select("depth", "prefix", "held", "keys"), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        over = materialize(spark, level.where(f"not fits and depth = {deep}").select("prefix"), "open")
        if deep == HASH_BITS or over.isEmpty():
            break
        open_rows = materialize(spark, open_rows.withColumn("prefix", _prefix("hash", deep)).join(over, "prefix", "left_semi").select("hash", "held"), "open-rows")
        depth = deep
    # a leaf's fine prefixes name it: leaves of one depth are joined on their own prefix length
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most HASH_BITS + 1 rows
    wanted = rows.withColumn("at", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix("hash", d).alias("prefix")) for d in depths)))) if depths else rows.withColumn("at", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    placed = wanted.select("doc_id", "n_bytes", "copies", F.col("at.depth").alias("depth"), F.col("at.prefix").alias("prefix")).join(leaves, ["depth", "prefix"])
    per_part = F.greatest(F.floor(F.lit(limit_bytes) / F.greatest(F.col("n_bytes"), F.lit(1))).cast("long"), F.lit(1).cast("long"))
    split = (F.col("held") > limit_bytes) & (F.col("copies") > 1)
    dealt = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    part = F.when(split, F.floor(F.col("copy") / per_part).cast("long")).otherwise(F.lit(0).cast("long"))
    held = F.when(split, F.least(per_part, F.col("copies") - part * per_part) * F.col("n_bytes")).otherwise(F.col("held"))
    return dealt.select(
        "doc_id", "n_bytes",
        F.col("depth").cast("int").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), part.alias("shard_part"),
        held.alias("shard_bytes"), (held > limit_bytes).alias("oversize"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a limit that small tables exceed many times, so that buckets split again and again."""
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), SMALL_BYTES)


def _oracle(limit: int) -> str:
    """Buckets of every depth, and those that fit while the one above didn't."""
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), keyed AS (
  SELECT doc_id, n_bytes, ('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest), 1, 15))::BIGINT AS hash
  FROM (SELECT doc_id, strlen(t)::BIGINT AS n_bytes, sha256(t) AS digest FROM base)
), levels AS (
  SELECT d.depth, hash >> ({HASH_BITS} - d.depth) AS prefix, sum(n_bytes) AS held, count(*) AS keys
  FROM keyed, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY ALL
), leaves AS (
  SELECT l.depth, l.prefix, l.held FROM levels l LEFT JOIN levels p ON p.depth = l.depth - 1 AND p.prefix = l.prefix >> 1
  WHERE (l.held <= {limit} OR l.keys = 1) AND (p.depth IS NULL OR NOT (p.held <= {limit} OR p.keys = 1))
)
SELECT doc_id, n_bytes, leaves.depth::INTEGER AS shard_depth, leaves.prefix AS shard_prefix, 0::BIGINT AS shard_part,
  leaves.held::BIGINT AS shard_bytes, leaves.held > {limit} AS oversize
FROM keyed JOIN leaves ON leaves.prefix = keyed.hash >> ({HASH_BITS} - leaves.depth)
"""


ORACLE, SMALL_ORACLE = _oracle(LIMIT_BYTES), _oracle(SMALL_BYTES)
