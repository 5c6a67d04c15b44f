"""Fill-in-middle transformation of whole texts, in Spark SQL functions alone.

A text is cut into units (a run of ASCII letters, or any other single code point). Two cuts, an
arrangement and a share left as it is come from the hash of seed and id, so a rerun or a lost executor
gives the same rows. ``restore`` parses the sentinels and rebuilds the text exactly: a text that holds
a sentinel stays plain, and as no proper ending of a sentinel begins another, none can arise where a
piece meets a sentinel.

Cases: a null text is empty, and an empty text is plain; a text of any length is cut whole; rows that
share an id share its hash, each cutting its own number of units, and rows equal in all are each returned;
a null id hashes as the empty string; both cuts may fall together, leaving an empty middle; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 1
#: Of a hundred texts so many are rearranged, and of a hundred rearranged ones so many begin with the suffix.
ARRANGED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = "[A-Za-z]+|[^A-Za-z]"


def _hash(digest: str, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, the number of units ``n``, ``form`` (plain, psm or spm), the three pieces and ``output``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    units = rows.withColumn("units", F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0)))
    sized = units.withColumn("n", F.size("units").cast("long"))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | holds | (_hash("digest", 2) % 100 >= arranged)
    form = F.when(plain, "plain").when(_hash("digest", 3) % 100 < suffix_first, "spm").otherwise("psm")
    cut = [_hash("digest", k) % (F.col("n") + 1) for k in (0, 1)]
    formed = sized.withColumn("form", form).withColumn("first", F.least(*cut).cast("int")).withColumn("second", F.greatest(*cut).cast("int"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    pieces = formed.select(
        "doc_id", "text", "n", "form",
        piece(F.lit(1), F.col("first")).alias("prefix"),
        piece(F.col("first") + 1, F.col("second") - F.col("first")).alias("middle"),
        piece(F.col("second") + 1, F.col("n").cast("int") - F.col("second")).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    return pieces.withColumn("output", output).drop("text")


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    whole = F.transform(F.array(parts), lambda p: F.when(form == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))))
    return F.when(form == "plain", output).otherwise(F.get(whole, F.lit(0)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
