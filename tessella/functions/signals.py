"""Signal measures as higher-order functions over ``array<double>``; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated, and written in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def db(value: Column, floor: float = EPS) -> Column:
    return 20 * F.log10(F.greatest(value, F.lit(floor)))


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) / F.size(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def is_finite(x: Column) -> Column:
    return F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def frames(x: Column, size: Column, hop: Column) -> Column:
    """Whole frames of ``size`` samples every ``hop`` samples."""
    n = F.floor((F.size(x) - size) / hop).cast("int") + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(x, i * hop + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def measure(x: Column, sr: Column) -> Column:
    return let(x, lambda v: _measure(v, sr))


def _measure(x: Column, sr: Column) -> Column:
    """struct of sanity measures; ``silence_ratio`` is the share of 20 ms frames whose peak is below
    -50 dBFS. Empty signals are not ok."""
    size = F.greatest(F.floor(sr * 0.02).cast("int"), F.lit(1))
    fs = frames(x, size, size)
    quiet = F.size(F.filter(fs, lambda f: peak(f) < 10 ** (-50 / 20)))
    empty = F.size(x) == 0
    return F.struct(
        (~empty).alias("ok"),
        F.when(empty, "empty").alias("reason"),
        sr.alias("sample_rate"),
        F.when(~empty, F.size(x) / sr).alias("duration_s"),
        F.when(~empty, peak(x)).alias("peak"),
        F.when(~empty, db(rms(x))).alias("rms_dbfs"),
        F.size(F.filter(x, lambda v: F.abs(v) > 0.999)).alias("clipped_samples"),
        F.when(~empty, F.when(F.size(fs) > 0, quiet / F.size(fs)).otherwise(1.0)).alias("silence_ratio"),
        is_finite(x).alias("finite"),
    )


def sanity(x: Column, sr: Column) -> Column:
    """Sanity of a generated signal: a sample-wise silence ratio and a status."""
    n = F.size(x)
    r = rms(x)
    return F.struct(
        F.when(n == 0, "empty").when(~is_finite(x), "non_finite").when(r < 1e-5, "silent").otherwise("ok").alias("status"),
        F.when(n > 0, n / sr).alias("duration_s"),
        F.when(n > 0, peak(x)).alias("peak"),
        F.when(n > 0, r).alias("rms"),
        F.when(n > 0, F.size(F.filter(x, lambda v: F.abs(v) >= 0.999)) / n).alias("clip_ratio"),
        F.when(n > 0, F.size(F.filter(x, lambda v: F.abs(v) < 1e-3)) / n).alias("silence_ratio"),
    )


def trim_silence(x: Column, sr: Column, gate_db: float = -45.0, pad_ms: int = 80, win_ms: int = 10) -> Column:
    """Without quiet ends, padded; short or all-quiet signals stay whole."""
    return let(x, lambda v: _trim(v, sr, gate_db, pad_ms, win_ms))


def _trim(x: Column, sr: Column, gate_db: float, pad_ms: int, win_ms: int) -> Column:
    n = F.greatest(F.floor(sr * win_ms / 1000).cast("int"), F.lit(1))
    pad = F.floor(sr * pad_ms / 1000).cast("int")

    def cut(loud: Column) -> Column:
        first, last = F.array_position(loud, F.lit(True)), F.size(loud) - F.array_position(F.reverse(loud), F.lit(True)) + 1
        lo, hi = F.greatest((first - 1) * n - pad, F.lit(0)), F.least(last * n + pad, F.size(x))
        return F.when((F.size(loud) < 3) | (first == 0), x).otherwise(F.slice(x, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")))

    return let(F.transform(frames(x, n, n), lambda f: db(rms(f), 1e-9) > gate_db), cut)


def normalize_loudness(x: Column, target_dbfs: float = -25.0, ceiling: float = 0.98) -> Column:
    """Scaled to a level, less where the peak would pass the ceiling; near silence stays as it is."""
    def scaled(v: Column) -> Column:
        gain = lambda r: F.least(F.pow(F.lit(10.0), (target_dbfs - 20 * F.log10(r)) / 20), ceiling / peak(v))
        return let(rms(v), lambda r: F.when((F.size(v) == 0) | (r < 1e-9), v).otherwise(let(gain(r), lambda g: F.transform(v, lambda s: s * g))))

    return let(x, scaled)


def fade_edges(x: Column, sr: Column, fade_ms: int = 10) -> Column:
    """sin^2 in, cos^2 out over at most half the signal."""
    def faded(v: Column) -> Column:
        n = F.least(F.floor(F.size(v) / 2), F.floor(sr * fade_ms / 1000)).cast("int")
        ramp = lambda k: F.pow(F.sin(F.lit(3.141592653589793 / 2) * k / (n - 1)), F.lit(2.0))
        size = F.size(v)
        edge = lambda s, i: s * F.when(i < n, ramp(i)).otherwise(1.0) * F.when(i >= size - n, ramp(size - 1 - i)).otherwise(1.0)
        return F.when(n < 2, v).otherwise(F.transform(v, edge))

    return let(x, faded)


def preprocess(x: Column, sr: Column, segments: Column | None = None, highpass: bool = True, trim: bool = True, loudness: bool = True) -> Column:
    """High-pass, then the cut by speech segments where they are given or else the trim of quiet ends, then
    the level; any step can be left out. ``segments`` is an array of [start, end] in milliseconds."""
    from tessella.functions import dsp

    y = dsp.highpass_signal(x, sr) if highpass else x
    if segments is not None:
        y = dsp.cut_signal(y, sr, segments)["x"]
    elif trim:
        y = trim_silence(y, sr)
    return normalize_loudness(y) if loudness else y


def energy_delta(energies: Column) -> Column:
    """Mean step of the log energy from frame to frame; null with fewer than two frames."""
    logs = F.transform(energies, lambda e: F.log10(e + EPS))
    steps = F.zip_with(F.slice(logs, 2, F.size(logs)), F.slice(logs, F.lit(1), F.greatest(F.size(logs) - 1, F.lit(0))), lambda b, a: F.abs(b - a))
    return F.when(F.size(energies) > 1, total(steps) / (F.size(energies) - 1))


def wave_diff(a: Column, b: Column) -> Column:
    """struct(cosine, rmse) over the common length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    prod = lambda u, v: total(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")))
    gap = total(F.zip_with(x, y, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))))
    return F.struct(F.try_divide(prod(x, y), F.sqrt(prod(x, x) * prod(y, y))).alias("cosine"), F.sqrt(F.try_divide(gap, n.cast("double"))).alias("rmse"))
