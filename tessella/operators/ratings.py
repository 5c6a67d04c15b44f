"""Ratings: verification, pair summaries, tallies, context variance, versioned snapshots."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.canonical import round_half_even

DIMENSIONS = ("clarity", "grit", "likeness", "naturalness")
FIELDS = (*DIMENSIONS, "text_complete", "artifact_type", "stability", "notes")


def score(value: Column) -> Column:
    """A rating string as a number; blank is unrated."""
    return F.nullif(F.trim(value), F.lit("")).try_cast("double")


def sha_status(ratings: DataFrame, cases: DataFrame) -> DataFrame:
    """unknown_case, verified or stale_sha per rating; a missing hash on either side is stale."""
    c = cases.select(F.col("case_id").alias("_c"), F.col("output_sha256").alias("_sha"))
    j = ratings.join(c, F.col("case_id") == F.col("_c"), "left")
    status = F.when(F.col("_c").isNull(), "unknown_case").when(F.coalesce(F.col("output_sha256") == F.col("_sha"), F.lit(False)), "verified").otherwise("stale_sha")
    return j.withColumn("sha_status", status).drop("_c", "_sha")


def pair_summary(samples: DataFrame, sides: tuple[str, str] = ("P0", "P2"), dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Per pair the rounded mean of each dimension and side, the rounded mean of those, and the delta; all
    are rounded on their exact binary value, ties to even."""
    long = samples.select("pair_id", "prompt_id", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), score(F.col(d)).alias("s")) for d in dims))).alias("x")).select("pair_id", "prompt_id", "x.dim", "x.s")
    means = long.groupBy("pair_id", "prompt_id", "dim").agg(round_half_even(F.avg("s"), 2).alias("m"))
    side = means.groupBy("pair_id").pivot("prompt_id", list(sides)).agg(round_half_even(F.avg("m"), 2))
    a, b = sides
    return side.select("pair_id", F.col(a).alias(f"{a}_mean"), F.col(b).alias(f"{b}_mean"), round_half_even(F.col(b) - F.col(a), 2).alias("delta"))


def winner_tally(choices: DataFrame, winner: str = "winner_condition") -> DataFrame:
    return choices.groupBy(F.substring_index(F.col(winner), "/", 1).alias("winner")).agg(F.count("*").alias("n"))


def context_variance(samples: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Hashes rated in two contexts at least, with the dimensions on which the ratings differ. A missing
    rating is a value of its own here."""
    differs = lambda d: F.when(F.size(F.collect_set(F.coalesce(F.nullif(F.trim(F.col(d)), F.lit("")), F.lit("\x00")))) > 1, d)
    g = samples.where("output_sha256 is not null").groupBy("output_sha256").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("case_id")).alias("case_ids"), *(differs(d).alias(f"_{d}") for d in sorted(dims)))
    return g.where("n > 1").select("output_sha256", "n", "case_ids", F.filter(F.array(*(F.col(f"_{d}") for d in sorted(dims))), lambda x: x.isNotNull()).alias("divergent"))


def rated(ratings: Column, mode: Column) -> Column:
    """Whether a rating struct holds anything: a choice for pairs, any field for samples."""
    fields = [F.trim(F.coalesce(ratings[f], F.lit(""))) != "" for f in FIELDS]
    some = fields[0]
    for f in fields[1:]:
        some = some | f
    return F.when(mode == "pairs", F.coalesce(ratings["choice"], F.lit("")) != "").otherwise(some)


def fold_snapshots(events: DataFrame) -> DataFrame:
    """Compare-and-set writes per name, in order: a write whose expected revision is set and isn't the
    current one is rejected. ``events`` has _ord, name, expected_revision, payload; the revision of an
    accepted write is derived from name and order. The writes of one name form one sequential history: they
    are sorted within their partition and streamed through, one state held at a time."""

    def run(frames):
        import hashlib

        name, state = None, (None, None, 0, 0)
        for pdf in frames:
            done = []
            for key, order, expected, payload in pdf[["name", "_ord", "expected_revision", "payload"]].itertuples(index=False):
                if key != name:
                    if name is not None:
                        done.append((name, *state))
                    name, state = key, (None, None, 0, 0)
                revision, body, accepted, rejected = state
                if expected is not None and expected != revision:
                    state = (revision, body, accepted, rejected + 1)
                else:
                    state = (hashlib.sha256(f"{key}|{order}".encode()).hexdigest()[:16], payload, accepted + 1, rejected)
            yield pd.DataFrame(done, columns=columns)
        if name is not None:
            yield pd.DataFrame([(name, *state)], columns=columns)

    columns = ["name", "revision", "payload", "accepted", "rejected"]
    ordered = events.where("name is not null").select("name", F.col("_ord").cast("string").alias("_ord"), "expected_revision", F.col("payload").cast("string").alias("payload"), F.col("_ord").alias("_at"))
    ordered = ordered.repartition("name").sortWithinPartitions("name", "_at").drop("_at")
    return ordered.mapInPandas(run, "name string, revision string, payload string, accepted int, rejected int")


def progress(wanted: DataFrame, rated: DataFrame, key: str) -> DataFrame:
    """One row: how many wanted ids are rated, how many are pending, and how many rated ids nobody wanted."""
    w, r = wanted.select(key).distinct(), rated.select(key).distinct()
    both = w.withColumn("_w", F.lit(1)).join(r.withColumn("_r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.expr("_w = 1 and _r = 1")).alias("verified"), F.count_if(F.expr("_w = 1 and _r is null")).alias("pending"), F.count_if(F.expr("_w is null and _r = 1")).alias("unknown"))


def verify_assets(contract: DataFrame, files: DataFrame) -> DataFrame:
    """(name, asset, ok) of every asset hash of a contract; ``asset_hashes`` is a map."""
    want = contract.select("name", F.explode("asset_hashes").alias("asset", "expected"))
    f = files.select(F.col("path").alias("_p"), F.col("sha256").alias("actual"))
    j = want.join(f, F.col("asset") == F.col("_p"), "left").drop("_p")
    return j.withColumn("ok", F.coalesce(F.lower("actual") == F.lower("expected"), F.lit(False)))


def review_status(assets_ok: Column, n_rated: Column, n_total: Column, fatigue: Column) -> Column:
    """BLOCKED before PENDING before fatigue before RATED."""
    return (
        F.when(~F.coalesce(assets_ok, F.lit(False)), "BLOCKED")
        .when((n_total == 0) | (n_rated < n_total), "PENDING_USER_LISTENING")
        .when(F.coalesce(fatigue, F.lit(False)), "UNCERTAIN_FATIGUE")
        .otherwise("RATED")
    )


def verified_legacy(legacy: DataFrame, contract: DataFrame) -> DataFrame:
    """Old ratings whose id, blind order and hashes agree with the contract. Both have review_id, order
    (array), hashes (array)."""
    c = contract.select(F.col("review_id").alias("_id"), F.col("order").alias("_order"), F.col("hashes").alias("_hashes"))
    return legacy.join(c, F.col("review_id") == F.col("_id")).where("`order` <=> _order and hashes <=> _hashes").drop("_id", "_order", "_hashes")


def check_truth(truth: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: counts of unknown cases, hash and condition mismatches, and whether the export may go on."""
    c = cases.select(F.col("case_id").alias("_c"), F.col("output_sha256").alias("_sha"), F.col("condition").alias("_cond"))
    j = truth.join(c, F.col("case_id") == F.col("_c"), "left")
    known = F.col("_c").isNotNull()
    one = j.agg(
        F.count_if(~known).alias("unknown"),
        F.count_if(known & ~F.col("output_sha256").eqNullSafe(F.col("_sha"))).alias("sha_mismatch"),
        F.count_if(known & ~F.col("condition").eqNullSafe(F.col("_cond"))).alias("condition_mismatch"),
    )
    return one.withColumn("ok", (F.col("unknown") + F.col("sha_mismatch") + F.col("condition_mismatch")) == 0)


def anonymous_labels(rows: DataFrame, group: str, order: str) -> DataFrame:
    """S-01, S-02, ... within each group."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("label", F.format_string("%s-%02d", F.col(group).cast("string"), k))


def blind_order(pair_id: Column, cells: Column) -> Column:
    """A deterministic order of the cells by a salted hash, evaluated in the JVM."""
    keyed = F.transform(cells, lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit("20261008"), pair_id, c), 256).alias("h"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def seeded_shuffle(seed: pd.Series, cells: pd.Series) -> pd.Series:
    """The order that Python's generator gives for a string seed, for parity with published orders."""
    out = []
    for s, c in zip(seed, cells):
        c = list(c)
        random.Random(s).shuffle(c)
        out.append(c)
    return pd.Series(out)


def score_cell(*scores: Column) -> Column:
    """c/g/l/n a/b/c/d, or - when all are blank."""
    parts = [F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit("-")) for s in scores]
    empty = parts[0] == "-"
    for p in parts[1:]:
        empty = empty & (p == "-")
    return F.when(empty, "-").otherwise(F.concat(F.lit("c/g/l/n "), F.concat_ws("/", *parts)))
