"""Curation: text resolution, flags, rejects, exclusions, ordered de-duplication, freeze and audit.

Rows carry an explicit order column; "first" always means smallest order, never partition order.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.fuzzy import SIMILAR, similar_to_blocklist
from tessella.operators.graph import connected_components
from tessella.session import materialize, release

SPLITS = ("train", "validation", "test")
MIN_SECONDS, MAX_SECONDS = 0.4, 120.0
HARD_KINDS = ("too_short", "non_finite", "empty")
PREP_MIN_ROWS, PREP_MIN_SECONDS = 30, 120.0
PREP_MIN_DURATION, PREP_MAX_DURATION, PREP_SILENT_DB = 0.4, 90.0, -50.0
VALIDATION_ROWS = 8


def flag_issues(m: Column, min_s: float = MIN_SECONDS, max_s: float = MAX_SECONDS) -> Column:
    """Array of ``kind:value`` flags of a measure struct, in a fixed order; a measure that isn't ok has
    its reason as the only flag."""
    flag = lambda cond, kind, value, unit="": F.when(cond, F.concat(F.lit(f"{kind}:"), value.cast("string"), F.lit(unit)))
    checks = F.array(
        flag(m["duration_s"] < min_s, "too_short", m["duration_s"], "s"),
        flag(m["duration_s"] > max_s, "too_long", m["duration_s"], "s"),
        flag(m["clipped_samples"] > 0, "clipped", m["clipped_samples"]),
        flag(m["silence_ratio"] > 0.6, "mostly_silent", m["silence_ratio"]),
        flag(m["rms_dbfs"] < -45, "too_quiet", m["rms_dbfs"], "dBFS"),
        flag(m["rms_dbfs"] > -6, "too_hot", m["rms_dbfs"], "dBFS"),
        F.when(~m["finite"], F.lit("non_finite")),
    )
    return F.when(m["ok"], F.filter(checks, lambda f: f.isNotNull())).otherwise(F.array(F.coalesce(m["reason"], F.lit("unreadable"))))


def with_no_text(flags: Column, text: Column) -> Column:
    return F.when(tx.blank(text) == "", F.array_append(flags, F.lit("no_text"))).otherwise(flags)


def kinds(flags: Column) -> Column:
    return F.transform(flags, lambda f: tx.prefix(f, ":"))


def hard_reject(flags: Column, enabled: bool = True) -> Column:
    """The joined flags where one of them forbids the row, else null."""
    bad = F.exists(kinds(flags), lambda k: k.isin(*HARD_KINDS)) & F.lit(enabled)
    return F.when(bad, F.array_join(flags, ";"))


def resolve_text(text: Column, asr: Column, provenance: Column) -> Column:
    """struct(text, text_source): file name first, then recognised text, then provenance."""
    empty = tx.norm_text(text) == ""
    by_asr, by_prov = empty & (tx.blank(asr) != ""), empty & (tx.blank(provenance) != "")
    return F.struct(
        F.when(by_asr, asr).when(by_prov, provenance).otherwise(tx.blank(text)).alias("text"),
        F.when(by_asr, "asr").when(by_prov, "provenance").otherwise("filename").alias("text_source"),
    )


def exclude(rows: DataFrame, drops: DataFrame, keys: list[str], drop_key: str = "key") -> DataFrame:
    """Rows none of whose keys is in ``drops``: one anti join per key, never a disjunctive one."""
    return reduce(lambda d, k: d.join(drops.select(F.col(drop_key).alias(k)).distinct(), k, "left_anti"), keys, rows)


def mark_members(rows: DataFrame, members: DataFrame, key: str, name: str, member_key: str = "key") -> DataFrame:
    """Add a boolean ``name``: whether ``key`` is among ``members``."""
    m = members.select(F.col(member_key).alias("_m")).where("_m is not null").distinct()
    return rows.join(m, F.col(key) == F.col("_m"), "left").withColumn(name, F.col("_m").isNotNull()).drop("_m")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the smallest order. An aggregate, so a frequent key is combined before
    the shuffle."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in rows.columns))


#: Rounds of the fixpoint before what is left is folded component by component.
ROUNDS = 4


def greedy_two_key(spark: SparkSession, rows: DataFrame, first: str, second: str, order: str, rounds: int = ROUNDS) -> DataFrame:
    """Sequential "accept unless either key was accepted before".

    In each round a row that is the smallest undecided one under both keys is accepted, and every row
    that shares a key with an accepted one leaves; frequent keys fall in the first rounds. An alternating
    chain would need a round for every two of its rows, so after ``rounds`` the rest goes to
    ``fold_components``. Each round writes its undecided rows, so lineage stays short. A null key neither
    blocks nor is blocked."""
    keyless = F.col(first).isNull() & F.col(second).isNull()
    accepted = rows.where(keyless).select(first, second, order)
    open_rows = materialize(spark, rows.where(~keyless).select(first, second, order), "greedy")
    for _ in range(rounds):
        a = open_rows.groupBy(first).agg(F.min(order).alias("_a"))
        b = open_rows.groupBy(second).agg(F.min(order).alias("_b"))
        leads = lambda key, least: F.col(key).isNull() | (F.col(order) == F.col(least))
        won = open_rows.join(a, first, "left").join(b, second, "left").where(leads(first, "_a") & leads(second, "_b")).select(first, second, order)
        won = materialize(spark, won, "greedy-won")
        accepted = accepted.unionByName(won)
        before, left = open_rows, open_rows.join(won.select(first), first, "left_anti").join(won.select(second), second, "left_anti")
        open_rows = materialize(spark, left.select(first, second, order), "greedy")
        release(before)
        if open_rows.isEmpty():
            release(open_rows)
            return accepted
    return accepted.unionByName(fold_components(spark, open_rows, first, second, order))


def fold_components(spark: SparkSession, rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """``greedy_two_key`` by the components of the graph whose nodes are key values and whose edges are
    rows with a key at least. Components are found in rounds that grow with the logarithm of the longest
    chain; each is then decided by one pass over its sorted rows. A task streams its components and holds
    the accepted keys of one, as 128 bits of hash each."""
    hashed = lambda c, k: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(k), c))
    keyed = materialize(spark, rows.select(first, second, order, hashed(first, 1).alias("_a"), hashed(second, 2).alias("_b")), "greedy-keys")
    roots = connected_components(spark, keyed.where("_a is not null and _b is not null").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    placed = keyed.withColumn("node", F.coalesce("_a", "_b")).join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["_root", "_a", hashed(first, 3).alias("_a2"), "_b", hashed(second, 4).alias("_b2"), first, second, order]
    ordered = placed.select(*columns).repartition(tasks, "_root").sortWithinPartitions("_root", order)

    def fold(batches):
        root, seen = None, set()
        for batch in batches:
            keep = []
            for r, a, a2, b, b2 in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if r != root:
                    root, seen = r, set()
                keys = {(k, k2) for k, k2 in ((a, a2), (b, b2)) if k is not None}
                keep.append(seen.isdisjoint(keys))
                if keep[-1]:
                    seen |= keys
            yield batch.filter(pa.array(keep, pa.bool_())).select([5, 6, 7])

    out = materialize(spark, ordered.mapInArrow(fold, rows.select(first, second, order).schema), "greedy-folded")
    release(keyed, roots)
    return out


def decide(rows: DataFrame, accepted: DataFrame, first: str, second: str, order: str, late: Column | None = None) -> DataFrame:
    """Add ``why``: null for accepted rows, else dup_audio, dup_text or the row's own late reason."""
    a = accepted.select(F.col(first), F.col(order).alias("_ao"))
    b = accepted.select(F.col(second), F.col(order).alias("_bo"))
    joined = rows.join(a, first, "left").join(b, second, "left")
    why = F.when(F.col("_ao") == F.col(order), None).when(F.col("_ao") < F.col(order), "dup_audio").when(F.col("_bo") < F.col(order), "dup_text")
    return joined.withColumn("why", why if late is None else F.when(F.col("_ao") == F.col(order), None).otherwise(F.coalesce(why, late))).drop("_ao", "_bo")


def freeze(spark: SparkSession, index: DataFrame, excludes: DataFrame | None = None, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """Every index row with its fid and either a split or the reason it was dropped.

    ``index`` has _ord, text, text_asr, provenance_text, audio_sha256, file_exists (and any other
    columns, which are kept). Precedence: reviewed_out, no_text, dup_audio, dup_text, missing_audio;
    only accepted rows register their keys."""
    r = resolve_text(F.col("text"), F.col("text_asr"), F.col("provenance_text"))
    rows = index.withColumn("_t", r).withColumn("text", F.col("_t.text")).withColumn("text_source", F.col("_t.text_source")).drop("_t")
    rows = rows.withColumn("fid", tx.text_fid(F.col("text"), F.col("audio_sha256"))).withColumn("norm", tx.norm_text(F.col("text")))
    if excludes is None:
        rows = rows.withColumn("_out", F.lit(False))
    else:
        rows = mark_members(rows, excludes, "fid", "_by_fid")
        rows = mark_members(rows, excludes, "audio_sha256", "_by_sha").withColumn("_out", F.col("_by_fid") | F.col("_by_sha")).drop("_by_fid", "_by_sha")
    early = F.when(F.col("_out"), "reviewed_out").when(F.col("norm") == "", "no_text")
    rows = materialize(spark, rows.withColumn("_early", early).drop("_out"), "freeze")
    eligible = rows.where(F.col("_early").isNull() & F.col("file_exists"))
    accepted = greedy_two_key(spark, eligible, "audio_sha256", "norm", "_ord")
    late = F.when(~F.col("file_exists"), "missing_audio")
    decided = decide(rows.where("_early is null"), accepted, "audio_sha256", "norm", "_ord", late)
    out = decided.unionByName(rows.where("_early is not null").withColumn("why", F.col("_early")))
    return out.withColumn("split", F.when(F.col("why").isNull(), tx.split_bucket(F.col("fid"), val_frac, test_frac))).drop("_early")


def freeze_manifest(frozen: DataFrame) -> DataFrame:
    """One row of counts: splits (empty ones too), drops, labels and text sources as maps."""
    kept = F.col("why").isNull()
    counts = frozen.agg(
        *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS), F.count_if(~kept).alias("dropped"),
    )
    by = lambda c, n: frozen.where(kept).groupBy(F.coalesce(F.col(c), F.lit("null")).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(n))
    return counts.join(F.broadcast(by("label", "labels"))).join(F.broadcast(by("text_source", "text_sources")))


def audit_leaks(split_rows: DataFrame) -> DataFrame:
    """Rows whose audio or text belongs to an earlier split (train before validation before test)."""
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    rows = split_rows.withColumn("_rank", rank)
    both = rows.select("fid", "split", "_rank", F.explode(F.array(
        F.struct(F.lit("audio_leak").alias("kind"), F.col("audio_sha256").alias("key")),
        F.struct(F.lit("text_leak").alias("kind"), tx.norm_text(F.col("text")).alias("key")),
    )).alias("k")).select("fid", "split", "_rank", "k.kind", "k.key").where(F.col("key").isNotNull() & (F.col("key") != ""))
    both = materialize(split_rows.sparkSession, both, "audit")  # keys once for both sides of the join
    owner = both.groupBy("kind", "key").agg(F.min("_rank").alias("_own"))
    leaks = both.join(owner, ["kind", "key"]).where(F.col("_rank") > F.col("_own"))
    return leaks.select("fid", "kind", "key", F.element_at(F.array(*map(F.lit, SPLITS)), F.col("_own").cast("int")).alias("owner"), "split")


def audit(split_rows: DataFrame) -> DataFrame:
    """All violations as (kind, fid, split): missing audio, fid and hash mismatches, leaks. Rows carry
    ``file_sha256``, null where the file is missing; rows without audio_sha256 skip the hash checks."""
    missing = F.col("file_sha256").isNull()
    has = F.coalesce(F.col("audio_sha256"), F.lit("")) != ""
    checks = F.array(
        F.when(missing, "missing_audio"),
        F.when(~missing & has & (F.col("fid") != tx.text_fid(F.col("text"), F.col("audio_sha256"))), "fid_mismatch"),
        F.when(~missing & has & (F.col("file_sha256") != F.col("audio_sha256")), "sha_mismatch"),
    )
    own = split_rows.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("kind"), "fid", "split")
    return own.unionByName(audit_leaks(split_rows).select("kind", "fid", "split"))


def build_blocklist(parts: list[DataFrame]) -> DataFrame:
    """Union of (label, sha, text, fid) asset rows into one row of sorted distinct sets."""
    rows = reduce(DataFrame.unionByName, parts)
    gather = lambda c: F.sort_array(F.collect_set(c))
    return rows.agg(gather(F.lower("sha")).alias("audio_sha256"), gather(F.when(tx.blank(F.col("text")) != "", tx.norm_text(F.col("text")))).alias("norm_texts"), gather("fid").alias("fids"), F.count("*").alias("n_entries"))


def prepare_training(spark: SparkSession, rows: DataFrame, blocked_fids: DataFrame, blocked_shas: DataFrame, blocked_texts: DataFrame) -> DataFrame:
    """The reject cascade: every row with ``reason`` (null where accepted). Rows carry _ord, fid, text,
    file_sha256 (null where the file is missing), readable, duration_s, rms_dbfs. The block tables have
    one column ``key``."""
    rows = rows.withColumn("text", tx.strip(tx.blank(F.col("text")))).withColumn("norm", tx.norm_text(F.col("text")))
    rows = mark_members(rows.withColumn("_sha", F.lower("file_sha256")), blocked_fids, "fid", "_fid")
    rows = mark_members(rows, blocked_shas.select(F.lower("key").alias("key")), "_sha", "_audio")
    rows = mark_members(rows, blocked_texts, "norm", "_exact")
    near = similar_to_blocklist(rows.select(F.col("_ord").alias("key"), "norm"), blocked_texts.select(F.col("key").alias("norm")), SIMILAR)
    rows = rows.join(near.select(F.col("key").alias("_ord"), "similarity"), "_ord", "left")
    early = (
        F.when(F.col("_fid"), "leak_fid").when(F.col("file_sha256").isNull(), "missing_file").when(F.col("_audio"), "leak_audio_sha")
        .when(F.length("norm") < 2, "bad_text").when(F.col("_exact"), "leak_text_exact").when(F.col("similarity").isNotNull(), "leak_text_similar")
    )
    late = (
        F.when(~F.col("readable"), "bad_audio")
        .when(~F.col("duration_s").between(PREP_MIN_DURATION, PREP_MAX_DURATION), "bad_duration")
        .when(F.col("rms_dbfs") < PREP_SILENT_DB, "silent")
    )
    rows = materialize(spark, rows.withColumn("_early", early).withColumn("_late", late).drop("_fid", "_audio", "_exact", "_sha"), "prepare")
    accepted = greedy_two_key(spark, rows.where("_early is null and _late is null"), "file_sha256", "norm", "_ord")
    decided = decide(rows.where("_early is null"), accepted, "file_sha256", "norm", "_ord", F.col("_late"))
    renamed = F.when(F.col("why") == "dup_audio", "duplicate_audio").when(F.col("why") == "dup_text", "duplicate_text").otherwise(F.col("why"))
    out = decided.withColumn("reason", renamed).drop("why").unionByName(rows.where("_early is not null").withColumn("reason", F.col("_early")))
    return out.drop("_early", "_late")


def prepare_stats(prepared: DataFrame, min_rows: int = PREP_MIN_ROWS, min_seconds: float = PREP_MIN_SECONDS) -> DataFrame:
    """One row: counts, seconds, reasons as a map, and the decision gate."""
    ok = F.col("reason").isNull()
    reasons = prepared.where(~ok).groupBy("reason").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reject_reasons"))
    one = prepared.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok, F.col("duration_s"))), F.lit(0.0)).alias("total_seconds"))
    one = one.withColumn("mean_seconds", F.col("total_seconds") / F.greatest("accepted", F.lit(1)))
    one = one.withColumn("decision", F.when((F.col("accepted") < min_rows) | (F.col("total_seconds") < min_seconds), "DATA_BLOCKED").otherwise("ok"))
    return one.join(F.broadcast(reasons))


def validation_rows(rows: DataFrame, blocked_fids: DataFrame, blocked_shas: DataFrame, blocked_texts: DataFrame, limit: int = VALIDATION_ROWS) -> DataFrame:
    """The first distinct texts that no block rule hits; empty normal forms pass, as published."""
    rows = rows.withColumn("norm", tx.norm_text(F.col("text"))).withColumn("_sha", F.lower("file_sha256")).where("file_sha256 is not null")
    rows = exclude(rows, blocked_fids, ["fid"])
    rows = exclude(rows, blocked_shas.select(F.lower("key").alias("key")), ["_sha"])
    rows = exclude(rows, blocked_texts, ["norm"])
    return first_wins(rows.drop("_sha"), "norm", "_ord").orderBy("_ord").limit(limit)
