"""Adapter audits: key classes, weight census, weight differences, load and on/off verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED_GROUPS = ("lm", "dit")
ARGUMENTS = ("text", "prompt_text", "prompt_wav_path", "cfg_value", "inference_timesteps", "normalize", "denoise", "retry_badcase")


def has(key: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(key, F.lit(p))
    return out


def key_group(key: Column) -> Column:
    return F.when(has(key, "base_lm.", "residual_lm."), "lm").when(has(key, "feat_decoder."), "dit").when(has(key, "_proj", "fusion_concat"), "proj").otherwise("other")


def key_matrix(key: Column) -> Column:
    return F.when(has(key, ".lora_A"), "A").when(has(key, ".lora_B"), "B").otherwise("other")


def weights_census(header: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per group: keys, elements, A and B counts, types, root sum of squared norms, mean share of
    nonzero entries and anomalies. ``header`` has key, dtype, numel; ``stats`` key, l2, nonzero, nan, inf."""
    rows = header if stats is None else header.join(stats, "key", "left")
    if stats is None:
        rows = rows.selectExpr("*", "cast(null as double) l2", "cast(null as double) nonzero", "0L nan", "0L inf")
    matrix = key_matrix(F.col("key"))
    odd = F.when((F.coalesce("nan", F.lit(0)) > 0) | (F.coalesce("inf", F.lit(0)) > 0), F.concat("key", F.lit(":not_finite")))
    zero = F.when(F.col("l2") == 0, F.concat("key", F.lit(":all_zero")))
    return rows.groupBy(key_group(F.col("key")).alias("grp")).agg(
        F.count("*").alias("keys"), F.sum("numel").alias("numel"),
        F.count_if(matrix == "A").alias("a"), F.count_if(matrix == "B").alias("b"),
        F.sort_array(F.collect_set("dtype")).alias("dtypes"),
        F.sqrt(F.coalesce(F.sum(F.col("l2") * F.col("l2")), F.lit(0.0))).alias("l2"),
        F.avg("nonzero").alias("nonzero_mean"),
        F.sort_array(F.flatten(F.collect_list(F.filter(F.array(odd, zero), lambda x: x.isNotNull())))).alias("anomalies"),
    )


def weight_diffs(diffs: DataFrame) -> DataFrame:
    """Changed and unchanged keys and the largest change, per transition and per transition and group
    (grp null: the whole transition). A null difference counts as unchanged."""
    rel = F.coalesce("rel_l2", F.lit(0.0))
    same = F.coalesce("identical", F.lit(False)) | (rel == 0)
    rows = diffs.select("transition", key_group(F.col("key")).alias("grp"), rel.alias("rel"), same.alias("same"))
    return rows.groupingSets([["transition"], ["transition", "grp"]], "transition", "grp").agg(
        F.count_if(~F.col("same")).alias("changed"), F.count_if("same").alias("unchanged"), F.max("rel").alias("max_rel_l2"),
        F.bool_or(~F.col("same")).alias("trained"),
    )


def load_integrity(ckpt: Column, loaded: Column, skipped: Column, required: tuple[str, ...] = REQUIRED_GROUPS) -> Column:
    """struct of key-set differences and the verdict."""
    missing = F.sort_array(F.array_except(F.array_except(ckpt, loaded), skipped))
    unexplained = F.sort_array(F.array_intersect(skipped, ckpt))
    unexpected = F.sort_array(F.array_except(skipped, ckpt))
    groups = F.sort_array(F.array_distinct(F.transform(loaded, key_group)))
    absent = F.array_except(F.array(*map(F.lit, required)), groups)
    ok = (F.size(loaded) > 0) & (F.size(missing) == 0) & (F.size(unexplained) == 0) & (F.size(absent) == 0)
    return F.struct(
        ok.alias("ok"), missing.alias("missing_keys"), unexplained.alias("unexplained_skipped"), unexpected.alias("unexpected_skipped"),
        groups.alias("loaded_groups"), absent.alias("missing_required_groups"),
        F.when(ok, "LOAD_OK").otherwise("ADAPTER_LOAD_FAILED").alias("verdict"),
    )


def onoff_verdict(a: Column, b: Column, c: Column, again: Column, ab_corr: Column, bc_corr: Column) -> Column:
    """Verdict of the four-run switch experiment from hashes, then correlations."""
    return (
        F.when(~F.coalesce(c == again, F.lit(False)), "NONDETERMINISTIC_RUN")
        .when(~F.coalesce(a == b, F.lit(False)), F.when(F.coalesce(ab_corr >= 0.9999, F.lit(False)), "DISABLED_NEAR_BASE_ONLY").otherwise("DISABLED_NOT_EQ_BASE"))
        .when(~F.coalesce(b != c, F.lit(False)), "ADAPTER_NOT_EFFECTIVE")
        .when(F.coalesce(bc_corr > 0.99999, F.lit(False)), "ADAPTER_NUMERIC_NOISE_ONLY")
        .otherwise("ADAPTER_EFFECTIVE")
    )


def final_verdict(load_ok: Column, trained: Column, onoff: Column, comparable: Column) -> Column:
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(~yes(load_ok) | ~yes(trained), "ADAPTER_NOT_EFFECTIVE")
        .when(onoff.isin("NONDETERMINISTIC_RUN", "DISABLED_NOT_EQ_BASE"), "COMPARABILITY_LIMITED")
        .when(onoff == "ADAPTER_EFFECTIVE", F.when(yes(comparable), "ADAPTER_EFFECTIVE_NO_CLEAR_GAIN").otherwise("COMPARABILITY_LIMITED"))
        .when(onoff.isin("ADAPTER_NOT_EFFECTIVE", "ADAPTER_NUMERIC_NOISE_ONLY"), "ADAPTER_NOT_EFFECTIVE")
        .otherwise("INCONCLUSIVE")
    )


def argument_diffs(base: Column, other: Column) -> Column:
    """Map of the named arguments that differ (null-safe); paths compare by their last part."""
    def one(name: str) -> Column:
        x, y = F.try_element_at(base, F.lit(name)), F.try_element_at(other, F.lit(name))
        if name == "prompt_wav_path":
            leaf = lambda v: F.element_at(F.split(F.replace(v, F.lit("\\"), F.lit("/")), "/"), -1)
            both = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
            x, y = F.when(both, leaf(x)).otherwise(x), F.when(both, leaf(y)).otherwise(y)
        return F.when(~x.eqNullSafe(y), F.struct(F.lit(name).alias("key"), F.struct(x.alias("base"), y.alias("other")).alias("value")))

    return F.map_from_entries(F.filter(F.array(*map(one, ARGUMENTS)), lambda e: e.isNotNull()))


def verify_outputs(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases against the hashes of the files they name; ``files`` has path, sha256."""
    f = files.select(F.col("path").alias("_p"), F.col("sha256").alias("actual"))
    joined = cases.join(f, F.col("output") == F.col("_p"), "left").drop("_p")
    return joined.withColumn("match", F.coalesce(F.col("actual") == F.col("output_sha256"), F.lit(False)))


def config_identical(rows: DataFrame, column: str) -> DataFrame:
    """One row: whether all configurations (maps) are the same, whatever their key order."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(column)))))
    return rows.agg((F.count_distinct(canonical) <= 1).alias("identical"))


def transitions(values: DataFrame) -> DataFrame:
    """Every key from one step to the next one that any key has: (transition, key, rel_l2, identical), null
    where a side is missing. ``values`` has step, key, value; steps are few."""
    steps = values.select("step").distinct()
    order = Window.orderBy("step")  # one row per step
    moves = steps.select(F.col("step").alias("_a"), F.lead("step").over(order).alias("_b")).where("_b is not null")
    sides = values.join(moves, F.col("step") == F.col("_a")).select("_a", "_b", "key", F.col("value").alias("x"), F.lit(None).cast("double").alias("y"))
    sides = sides.unionByName(values.join(moves, F.col("step") == F.col("_b")).select("_a", "_b", "key", F.lit(None).cast("double").alias("x"), F.col("value").alias("y")))
    both = sides.groupBy("_a", "_b", "key").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return both.select(F.concat_ws("->", "_a", "_b").alias("transition"), "key", F.try_divide(F.abs(F.col("y") - F.col("x")), F.abs("x")).alias("rel_l2"), (F.col("x") == F.col("y")).alias("identical"))
