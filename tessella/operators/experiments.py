"""Experiment analytics: case matrices, verified reuse, pairs and packs, screening, report upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROZEN_ARGS = ("cfg_value", "inference_timesteps", "normalize", "denoise", "retry_badcase")
BUDGETS = {"5A": 18, "5A2": 10, "pilot": 24}
CHECKPOINTS = (50, 100, 150)


def expand_matrix(groups: DataFrame, sides: tuple[str, ...] = ("P0", "P2")) -> DataFrame:
    """Cells of groups x seeds x sides. ``groups`` has pair_group, text, seeds (array)."""
    cells = groups.select("*", F.explode("seeds").alias("seed")).drop("seeds")
    cells = cells.withColumn("prompt_id", F.explode(F.array(*map(F.lit, sides))))
    return cells.withColumn("pair_id", F.concat_ws("_s", "pair_group", "seed")).withColumn("case_id", F.concat_ws("_", "pair_id", "prompt_id"))


def checkpoint_cells(cases: DataFrame, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """Every case under the base model and every checkpoint."""
    conditions = F.array(F.lit("base"), *(F.lit(f"ckpt{c}") for c in checkpoints))
    return cases.withColumn("condition", F.explode(conditions)).withColumn("cell_id", F.concat_ws("/", "condition", "case_id"))


def checkpoint_pairs(cases: DataFrame, late_cases: Column | None = None, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """Base against every checkpoint for all cases, and first against last checkpoint where
    ``late_cases`` holds."""
    base = cases.select("case_id", F.explode(F.array(*(F.lit(f"ckpt{c}") for c in checkpoints))).alias("right")).withColumn("left", F.lit("base"))
    late = cases.where(F.lit(False) if late_cases is None else late_cases).select("case_id", F.lit(f"ckpt{checkpoints[-1]}").alias("right"), F.lit(f"ckpt{checkpoints[0]}").alias("left"))
    pairs = base.unionByName(late)
    return pairs.select(F.concat_ws("__", "case_id", "left", "right").alias("pair_id"), "case_id", F.array(F.concat_ws("/", "left", "case_id"), F.concat_ws("/", "right", "case_id")).alias("cells"))


def rest_pack(pairs: DataFrame, *packs: DataFrame) -> DataFrame:
    """Pairs in none of the packs."""
    for p in packs:
        pairs = pairs.join(p.select("pair_id"), "pair_id", "left_anti")
    return pairs


def verify_reuse(wanted: DataFrame, prior: DataFrame, files: DataFrame, frozen: dict[str, str]) -> DataFrame:
    """Why a wanted cell can't take an earlier result; null where it can. First failing check holds.

    ``wanted`` has case_id, prior_id, text, seed, prompt_sha256, model_revision; ``prior`` case_id, status,
    text, seed, prompt_sha256, output, output_sha256, model_revision, effective_args (map); ``files`` path,
    sha256. A prior without a revision isn't checked for it."""
    p = prior.select(*(F.col(c).alias(f"p_{c}") for c in prior.columns))
    f = files.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"))
    j = wanted.join(p, F.col("prior_id") == F.col("p_case_id"), "left").join(f, F.col("p_output") == F.col("f_path"), "left")
    args = F.lit(False)
    for k in FROZEN_ARGS:
        args = args | ~F.try_element_at("p_effective_args", F.lit(k)).eqNullSafe(F.lit(frozen.get(k)))
    reason = (
        F.when(F.col("p_case_id").isNull(), "missing_prior")
        .when(~F.col("p_status").eqNullSafe(F.lit("ok")), "prior_not_ok")
        .when(F.col("f_sha").isNull(), "missing_file")
        .when(F.lower("f_sha") != F.lower("p_output_sha256"), "sha_mismatch")
        .when(~F.col("prompt_sha256").eqNullSafe(F.col("p_prompt_sha256")), "prompt_mismatch")
        .when(~F.col("seed").eqNullSafe(F.col("p_seed")), "seed_mismatch")
        .when(~F.col("text").eqNullSafe(F.col("p_text")), "text_mismatch")
        .when(args, "args_mismatch")
        .when(F.col("p_model_revision").isNotNull() & ~F.col("p_model_revision").eqNullSafe(F.col("model_revision")), "revision_mismatch")
    )
    return j.select(*wanted.columns, reason.alias("blocked_reason"), F.when(reason.isNull(), F.col("p_output")).alias("reused_from"))


def screening_flags(status: Column, finite: Column, clip_ratio: Column, silence_ratio: Column, retries: Column) -> Column:
    """The status alone where it isn't ok, else the flags of the signal."""
    flags = F.array(
        F.when(~finite, "non_finite"), F.when(clip_ratio > 0, "clipping"), F.when(silence_ratio > 0.85, "mostly_silent"),
        F.when(retries > 0, F.concat(F.lit("retry_"), retries.cast("string"))),
    )
    return F.when(status != "ok", F.array(status)).otherwise(F.filter(flags, lambda x: x.isNotNull()))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, then all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def attach_asr(cases: DataFrame, asr: DataFrame) -> DataFrame:
    """Last recognition result of each case as a struct column. ``asr`` has _ord, case_id and values."""
    values = [c for c in asr.columns if c not in ("_ord", "case_id")]
    last = asr.groupBy("case_id").agg(F.max_by(F.struct(*values), F.col("_ord")).alias("asr_aux"))
    return cases.join(last, "case_id", "left")


def pair_sides(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs with their cells looked up in order; cells without a case are left out."""
    cells = pairs.select("pair_id", F.posexplode("cells").alias("pos", "case_id"))
    rest = [c for c in cases.columns if c != "case_id"]
    joined = cells.join(cases, "case_id").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "case_id", *rest))).alias("sides"))
    return pairs.join(joined, "pair_id", "left")


def pack_pairs(packs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (pack_id, pos, pair) of the pairs that exist, in pack order."""
    return packs.select("pack_id", F.posexplode("pairs").alias("pos", "pair_id")).join(pairs, "pair_id")


def duplicate_sha(rows: DataFrame) -> DataFrame:
    """Mark rows whose output hash occurs more than once; null hashes never do."""
    n = rows.where("output_sha256 is not null").groupBy("output_sha256").agg(F.count("*").alias("_n"))
    return rows.join(n, "output_sha256", "left").withColumn("duplicate_sha", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")


def status_counts(cases: DataFrame) -> DataFrame:
    """One row: ok, total and whether all are ok; an empty table is not."""
    one = cases.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("total"))
    return one.withColumn("all_ok", (F.col("total") > 0) & (F.col("ok") == F.col("total")))


def log_failures(line: Column) -> Column:
    """Failure classes of a log text; plain substring patterns, so 'info' counts as 'inf' as published."""
    low = F.lower(line)
    checks = (("oom", "out of memory|oom"), ("nan_or_inf", "nan|inf"), ("exception", "traceback|error:"))
    return F.filter(F.array(*(F.when(F.regexp_like(low, F.lit(p)), n) for n, p in checks)), lambda x: x.isNotNull())


def parameter_summary(items: Column) -> Column:
    """k=v strings, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), ", ")


def quartile_picks(rows: DataFrame, length: Column, order: str) -> DataFrame:
    """The rows at a quarter, half and three quarters of the length order. Ranks come from counts per
    length, so no task sorts all rows."""
    from pyspark.sql import Window

    rows = rows.withColumn("_len", length)
    sizes = rows.groupBy("_len").agg(F.count("*").alias("_c"))  # one row per distinct length
    before = sizes.select("_len", (F.sum("_c").over(Window.orderBy("_len")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    picks = before.select("_len", "_before", F.explode(F.array(*(F.expr(f"({q} * _n) div 4") for q in (1, 2, 3)))).alias("_at"))
    size = sizes.select(F.col("_len").alias("_l2"), "_c")
    hit = picks.join(size, F.col("_len") == F.col("_l2")).where("_at >= _before and _at < _before + _c").select("_len", "_before", "_at").distinct()
    ranked = rows.join(F.broadcast(hit.select("_len").distinct()), "_len", "left_semi")
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("_len").orderBy(order)) - 1)
    return ranked.join(F.broadcast(hit), "_len").where(F.col("_rn") == F.col("_at") - F.col("_before")).drop("_len", "_rn", "_at", "_before")


def stitch_gaps(segments: DataFrame, max_gap_ms: int = 300) -> DataFrame:
    """Per file the gap kept before each segment: what lay since the previous one ended, at most
    ``max_gap_ms``. ``segments`` has file, start_ms, end_ms."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("start_ms", "end_ms")
    gap = F.greatest(F.col("start_ms") - F.lag("end_ms").over(w), F.lit(0))
    return segments.withColumn("kept_gap_ms", F.coalesce(F.least(gap, F.lit(max_gap_ms)), F.lit(0)))


def collision_names(rows: DataFrame, stem: str, order: str) -> DataFrame:
    """Unique names: the first of a stem keeps it, later ones get -1, -2, ..."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(stem).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(k == 0, F.col(stem)).otherwise(F.concat_ws("-", F.col(stem), k.cast("string"))))


def require_sha(rows: DataFrame, actual: str, expected: str, name: str) -> DataFrame:
    """``rows`` as they are, unless a hash differs from the expected one whatever its letter case (or is
    missing): then reading them fails and names the row."""
    same = F.coalesce(F.lower(actual) == F.lower(expected), F.lit(False))
    message = F.concat(F.lit("hash mismatch: "), F.col(name).cast("string"))
    return rows.withColumn(actual, F.when(same, F.col(actual)).otherwise(F.raise_error(message).cast("string")))
