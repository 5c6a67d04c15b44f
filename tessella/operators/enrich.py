"""Enrichment of an index with speaker and recognition reports; review exclusions and candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import vectors as vx

SPEAKER_THRESHOLD, CER_THRESHOLD = 0.45, 0.3
TOP_N = 40


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row in order."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in rows.columns))


def report_rows(report: DataFrame) -> DataFrame:
    """Rows of a report keyed by source, else by case; the last one of a key holds."""
    keyed = report.withColumn("key", slashed(F.coalesce(*(F.col(c) for c in ("source", "case_id") if c in report.columns)))).where("key is not null")
    return latest(keyed, "key", "_ord")


def with_provenance(index: DataFrame, provenance: DataFrame) -> DataFrame:
    """Left join of sidecar rows on the slash-normalised file; a sidecar text or label wins when it
    isn't blank. ``provenance`` has _ord, file, text, label."""
    p = latest(provenance.withColumn("file", slashed(F.col("file"))), "file", "_ord")
    p = p.select(F.col("file").alias("_file"), F.col("text").alias("provenance_text"), F.col("label").alias("_label"))
    joined = index.join(p, slashed(F.col("source")) == F.col("_file"), "left")
    pick = lambda new, old: F.when(tx.blank(new) != "", new).otherwise(old)
    return joined.withColumn("text", pick(F.col("provenance_text"), F.col("text"))).withColumn("label", pick(F.col("_label"), F.col("label"))).drop("_file", "_label")


def enrich(index: DataFrame, speaker: DataFrame, asr: DataFrame, speaker_threshold: float = SPEAKER_THRESHOLD, cer_threshold: float = CER_THRESHOLD) -> DataFrame:
    """Add report values as flags and back-fill empty texts; only rows with status ok change.

    ``speaker`` has key, speaker_cos; ``asr`` has key, cer, hypothesis; both one row per key. Flags of an
    earlier run are replaced, so running twice changes nothing."""
    own = ("speaker_cos", "speaker_mismatch", "asr_cer", "asr_mismatch", "text_from_asr")
    key = slashed(F.col("source"))
    rows = index.join(speaker.select(F.col("key").alias("_sk"), "speaker_cos"), key == F.col("_sk"), "left")
    rows = rows.join(asr.select(F.col("key").alias("_ak"), "cer", "hypothesis"), key == F.col("_ak"), "left")
    ok, cos, empty = F.col("status") == "ok", F.col("speaker_cos"), tx.blank(F.col("text")) == ""
    has_asr = F.col("_ak").isNotNull()
    filled = ok & has_asr & empty & (tx.strip(tx.blank(F.col("hypothesis"))) != "")
    flag = lambda cond, name, value: F.when(cond, F.concat(F.lit(f"{name}:"), value.cast("string")))
    added = F.filter(F.array(
        flag(cos.isNotNull(), "speaker_cos", cos),
        flag(cos < speaker_threshold, "speaker_mismatch", cos),
        F.when(filled, F.lit("text_from_asr")),
        flag(has_asr & ~empty, "asr_cer", F.col("cer")),
        flag(has_asr & ~empty & (F.col("cer") > cer_threshold), "asr_mismatch", F.col("cer")),
    ), lambda f: f.isNotNull())
    old = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: ~tx.prefix(f, ":").isin(*own))
    return (
        rows.withColumn("flags", F.when(ok, F.concat(old, added)).otherwise(F.col("flags")))
        .withColumn("text_asr", F.when(filled, F.col("hypothesis")))
        .drop("_sk", "_ak", "speaker_cos", "cer", "hypothesis")
    )


def cos_of(flags: Column) -> Column:
    """The number in the first speaker_cos flag; anything else is null."""
    hit = F.get(F.filter(flags, lambda f: f.startswith("speaker_cos:")), F.lit(0))
    return F.substring_index(hit, ":", -1).try_cast("double")


def pick_references(rows: DataFrame, top_n: int = TOP_N, min_cos: float | None = None) -> DataFrame:
    """Candidates by falling similarity, null last, ties by order; ``top_n`` 0 keeps all."""
    score = F.coalesce(F.col("speaker_cos"), F.lit(-1.0))
    out = rows if min_cos is None else rows.where(score >= min_cos)
    out = out.orderBy(score.desc(), F.col("_ord"))
    return out.limit(top_n) if top_n else out


def decisions(doc: DataFrame) -> DataFrame:
    """(key) rows of a decisions document: ``drop``, or the older ``exclude`` where drop is empty."""
    pick = F.when(F.size(F.coalesce("drop", F.array().cast("array<string>"))) > 0, F.col("drop")).otherwise(F.col("exclude"))
    return doc.select(F.explode(pick).alias("key")).distinct()


def decision_tags(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("tags").alias("key", "tags")).select("key", F.explode("tags").alias("tag"))


def speaker_similarity(rows: DataFrame, key: str, vector: str, group: str, leave_one_out: bool = False) -> DataFrame:
    """Cosine of every row's unit vector to the re-normalised mean of its group; with ``leave_one_out``
    the row's own vector is taken out of the mean first. Null vectors score null."""
    mean = vx.centroids(rows, group, vector).select(F.col(group).alias("_g"), "mean", "n")
    joined = rows.select(key, group, vx.unit(F.col(vector)).alias("_u")).join(mean, F.col(group).eqNullSafe(F.col("_g")), "left")
    center = F.col("mean")
    if leave_one_out:
        center = F.when(F.col("n") > 1, F.zip_with("mean", "_u", lambda m, u: (m * F.col("n") - u) / (F.col("n") - 1)))
    return joined.select(key, group, vx.cosine(F.col("_u"), vx.unit(center)).alias("speaker_cos"))
