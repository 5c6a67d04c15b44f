import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.functions import signals as sg
from tessella.functions import vectors as vx
from tessella.operators import curate


def sine(freq, seconds, amp, rate=48000):
    return amp * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def one(spark, column, x, rate):
    return spark.createDataFrame([(list(map(float, x)), rate)], "x array<double>, sr int").select(column.alias("v")).first().v


def test_levels(spark):
    m = one(spark, sg.measure(F.col("x"), F.col("sr")), sine(440, 0.5, 0.5, 8000), 8000)
    assert m.ok and abs(m.rms_dbfs + 9.03) < 0.05 and m.clipped_samples == 0 and m.silence_ratio == 0 and m.duration_s == 0.5
    assert one(spark, sg.measure(F.col("x"), F.col("sr")), [], 8000).reason == "empty"
    assert abs(dsp.analyze(sine(1000, 1, 0.5), 48000)["rms_dbfs"] + 9.03) < 0.05


def test_flags_in_order(spark):
    loud = one(spark, curate.flag_issues(sg.measure(F.col("x"), F.col("sr"))), np.ones(400), 8000)
    assert [f.split(":")[0] for f in loud] == ["too_short", "clipped", "too_hot"]
    quiet = one(spark, curate.flag_issues(sg.measure(F.col("x"), F.col("sr"))), np.zeros(8000), 8000)
    assert [f.split(":")[0] for f in quiet] == ["mostly_silent", "too_quiet"]


def test_band_energy_and_spectra():
    assert dsp.Spectrum(sine(6000, 1, 0.5, 24000), 24000).share(4000, 8000) > 0.9
    noise = np.random.default_rng(1).normal(size=24000) * 0.1
    tone = dsp.Spectrum(sine(1000, 1, 0.5, 24000), 24000).shapes()
    rough = dsp.Spectrum(noise, 24000).shapes()
    assert rough["spectral_flatness"] > tone["spectral_flatness"] and rough["spectral_entropy"] > tone["spectral_entropy"] and tone["spectral_crest"] > rough["spectral_crest"]
    assert dsp.Spectrum(np.zeros(4096), 24000).shapes()["spectral_flatness"] is None
    assert dsp.Spectrum(noise, 24000).delta() > 0


def test_alignment():
    rng = np.random.default_rng(3)
    x = rng.normal(size=20000) * 0.2
    out = dsp.compare(x, np.concatenate([np.zeros(400), 0.7 * x]), 24000)
    assert out["lag"] == 400 and abs(out["gain"] - 1 / 0.7) < 0.02 and out["nmse"] < 1e-6 and out["corr"] > 0.999 and len(out["bands"]) == 3
    assert dsp.delay(np.concatenate([np.zeros(50), x]), x)[0] == -50
    for band in out["bands"]:
        assert abs(band["mean_diff_db"] - 10 * math.log10(0.7)) < 0.01 and abs(band["rmse_db"] + band["mean_diff_db"]) < 0.01 and band["logmag_corr"] > 0.999
    assert [b["lo"] for b in dsp.compare(x, x, 8000)["bands"]] == [0] and dsp.compare(x[:300], x[:300], 24000)["bands"][0]["rmse_db"] == 0


@pytest.mark.parametrize("rate", [16000, 24000, 44100, 48000])
def test_loudness_of_the_standards_tones(rate):
    """A full-scale tone of 997 Hz on one channel reads -3.01; levels add up, gates leave silence out."""
    tone = sine(997, 2, 1.0, rate)
    assert dsp.loudness(tone, rate) == pytest.approx(-3.01, abs=0.06)
    assert dsp.loudness(tone / 10, rate) == pytest.approx(-23.01, abs=0.06)
    quiet = np.concatenate([tone / 10, np.zeros(6 * rate), tone / 10])
    assert dsp.loudness(quiet, rate) == pytest.approx(-23.01, abs=0.4)
    assert dsp.loudness(np.concatenate([tone, tone / 1000]), rate) == pytest.approx(dsp.loudness(tone, rate), abs=0.4)
    assert dsp.loudness(np.zeros(rate), rate) is None and dsp.loudness(tone[: rate // 4], rate) is None and dsp.loudness(tone, 2000) is None
    if rate == 48000:  # the standard's own coefficients
        (b, a), (_, c) = dsp.k_weighting(rate)
        assert np.allclose(b, [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=1e-9) and np.allclose(a[1:], [-1.69065929318241, 0.73248077421585], atol=1e-9) and np.allclose(c[1:], [-1.99004745483398, 0.99007225036621], atol=1e-9)


def test_highpass_and_resample():
    dc = dsp.highpass(sine(1000, 0.5, 0.3, 8000) + 0.4, 8000)
    assert abs(dc[1000:3000].mean()) < 1e-3 and abs(np.abs(dc[1000:3000]).max() - 0.3) < 0.01
    y = dsp.resample(sine(440, 1, 0.5, 48000), 48000, 24000)
    assert len(y) == 24000 and np.abs(y[500:-500] - sine(440, 1, 0.5, 24000)[500:-500]).max() < 1e-2
    assert dsp.true_peak(sine(440, 0.2, 0.5), 48000) == pytest.approx(-6.02, abs=0.05)


def test_trim_fade_level(spark):
    x = np.concatenate([np.zeros(800), sine(440, 0.2, 0.5, 8000), np.zeros(800)])
    t = one(spark, sg.trim_silence(F.col("x"), F.col("sr")), x, 8000)
    assert len(t) == 1600 + 2 * 640
    assert len(one(spark, sg.trim_silence(F.col("x"), F.col("sr")), np.zeros(800), 8000)) == 800
    y = np.array(one(spark, sg.normalize_loudness(F.col("x")), x, 8000))
    assert abs(20 * math.log10(math.sqrt((y**2).mean())) + 25) < 0.01
    z = one(spark, sg.fade_edges(F.col("x"), F.col("sr")), np.ones(1000), 8000)
    assert z[0] == 0 and abs(z[-1]) < 1e-12 and z[500] == 1


def test_cut_segments():
    rate = 1000
    x = np.full(3000, 0.1)
    x[1500:1700] = 1.0
    out, st = dsp.cut_segments(x, rate, [[0, 500], [600, 650], [1500, 1700], [2500, 3000]])
    assert st["segments_kept"] == 2 and [d["reason"] for d in st["dropped"]] == ["too_short", "clipped"]
    assert len(out) == 500 + 300 + 500 and st["removed_s"] == pytest.approx(1.7)
    assert dsp.cut_segments(x, rate, [])[1]["all_dropped"]


def test_sanity_and_frames(spark):
    s = one(spark, sg.sanity(F.col("x"), F.col("sr")), [0.0, 1.0, -1.0, 0.5], 4)
    assert (s.status, s.clip_ratio, s.silence_ratio) == ("ok", 0.5, 0.25)
    assert one(spark, sg.sanity(F.col("x"), F.col("sr")), [0.0] * 4, 4).status == "silent"
    assert one(spark, F.size(sg.frames(F.col("x"), F.lit(4), F.lit(2))), range(10), 1) == 4
    assert one(spark, F.size(sg.frames(F.col("x"), F.lit(4), F.lit(2))), range(3), 1) == 0


def test_unit_vectors(spark):
    assert one(spark, vx.unit(F.col("x")), [3, 4], 1) == [0.6, 0.8]
    assert one(spark, vx.unit(F.col("x")), [0, 0], 1) == [0, 0]


def test_udf_columns(spark):
    x = sine(6000, 0.3, 0.5, 24000)
    a = one(spark, dsp.analyze_signal("x", "sr"), x, 24000)
    assert a.band_energy_4k_8k > 0.9 and a.lufs is None and a.native_energy_above_12k is None
    c = one(spark, dsp.compare_signals("x", "x", "sr"), x, 24000)
    assert c.lag == 0 and c.corr > 0.999
