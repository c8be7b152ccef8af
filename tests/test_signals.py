"""Signal operators at the sizes of recordings, against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import filters, spectra, stretch

RNG = np.random.default_rng(3)


def rows(spark, *signals):
    return spark.createDataFrame([(t, i, float(v)) for t, x in enumerate(signals) for i, v in enumerate(x)], "track_id long, i long, x double")


def samples(df, track=0):
    return np.array([r.x for r in sorted(df.filter(F.col("track_id") == track).collect(), key=lambda r: r.i)])


def stft(x, size, hop):
    w = np.hanning(size + 1)[:-1]
    p = np.pad(x, size)
    return np.array([np.fft.rfft(p[f * hop + size // 2 : f * hop + size // 2 + size] * w) for f in range(len(x) // hop + 1)]).T


@pytest.mark.parametrize(("n", "size", "hop"), [(3000, 2048, 512), (1, 32, 8), (100, 24, 6)])
def test_spectrum_equals_numpy_and_comes_back(spark, n, size, hop):
    x = RNG.uniform(-1, 1, n)
    s = rows(spark, x)
    got = spectra.spectrum(s, size, hop)
    want = stft(x, size, hop)
    z = np.zeros_like(want)
    for r in got.collect():
        z[r.k, r.frame] = complex(r.re, r.im)
    assert np.allclose(z, want, atol=1e-9)
    back = samples(spectra.resynthesis(got, spark.createDataFrame([(0, n)], "track_id long, length long"), size, hop))
    assert np.allclose(back, x, atol=1e-9)


def test_transform_needs_one_exchange(spark):
    plan = spectra.spectrum(rows(spark, RNG.uniform(-1, 1, 50)), 32, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    physical = spectra.spectrum(rows(spark, RNG.uniform(-1, 1, 50)), 32, 8)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoop" not in physical


def test_features_of_known_sounds(spark):
    rate, size, hop = 22_050.0, 2048, 512
    t = np.arange(8192) / rate
    tone, noise = np.sin(2 * np.pi * 440 * t), RNG.normal(0, 0.3, 8192)
    f = spectra.frame_features(spectra.spectrum(rows(spark, tone, noise), size, hop), rate, size, hop).filter("frame = 8").collect()
    a, b = sorted(f, key=lambda r: r.track_id)
    assert abs(a.centroid - 440) < 15 and b.centroid > 3000
    assert a.c9 == 1.0 and a.mid > 0.99 and a.flatness < 0.01 < b.flatness and a.low < 0.01
    # a Hann window of a tone of amplitude one: mean power of the windowed samples
    assert a.rms == pytest.approx(np.sqrt(np.mean((tone[8 * hop - size // 2 : 8 * hop + size // 2] * np.hanning(size + 1)[:-1]) ** 2)), rel=1e-3)


def test_banks():
    mel, chroma = spectra.mel_bank(22_050, 2048, 128), spectra.chroma_bank(22_050, 2048)
    assert len(mel) == 128 and all(mel) and len(chroma) == 1025 and all(len(c) == 12 for c in chroma)
    area = [sum(w for _, w in m) * 22_050 / 2048 for m in mel[60:]]
    assert all(abs(v - 1) < 0.05 for v in area)
    a4 = chroma[round(440 / 22_050 * 2048)]
    assert a4.index(max(a4)) == 9


@pytest.mark.parametrize(("frames", "width"), [(9, 31), (40, 5), (1, 7)])
def test_running_medians_and_masks(spark, frames, width):
    size = 16
    m = RNG.uniform(0, 1, (size // 2 + 1, frames))
    m[2, :] = 3.0
    s = spark.createDataFrame([(0, f, k, float(m[k, f]), 0.0) for k in range(m.shape[0]) for f in range(frames)], "track_id long, frame long, k int, re double, im double")

    def median(v, axis):
        r = width // 2
        pads = [(r, r) if a == axis else (0, 0) for a in range(2)]
        return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, pads, mode="symmetric"), width, axis=axis), axis=-1)

    h, p = median(m, 1), median(m, 0)
    for r in spectra.harmonic_percussive(s, size, width).collect():
        a, b = h[r.k, r.frame], p[r.k, r.frame]
        assert r.harmonic == pytest.approx(a * a / (a * a + b * b)) and r.harmonic + r.percussive == pytest.approx(1)


def test_maps_are_repaired_or_refused(spark):
    lengths = spark.createDataFrame([(0, 100), (1, 10)], "track_id long, length long")
    keys = spark.createDataFrame([(0, 10, 12), (0, 20, 11), (0, 20, 40), (0, 150, 3), (0, 50, 60)], "track_id long, source long, target long")
    got = sorted((r.track_id, r.source, r.target) for r in spectra.valid_map(keys, lengths).collect())
    assert got == [(0, 0, 0), (0, 10, 12), (0, 20, 13), (0, 50, 60), (0, 100, 142), (1, 0, 0), (1, 10, 10)]
    with pytest.raises(Exception, match="time map turns back in track 0"):
        spectra.valid_map(keys, lengths, strict=True).collect()
    assert spectra.valid_map(keys.filter("target <> 11"), lengths, strict=True).count() == 7


def test_stretched_tone_keeps_its_pitch(spark):
    n, rate = 4096, 8000
    x = 0.5 * np.sin(2 * np.pi * 500 * np.arange(n) / rate)
    keys = spark.createDataFrame([(0, 1024, 1100), (0, 2048, 2500), (0, n, 5500)], "track_id long, source long, target long")
    y = samples(spectra.stretched(rows(spark, x), keys, 256))
    assert len(y) == 5500
    z = np.abs(np.fft.rfft(y[500:5000] * np.hanning(4500)))
    assert abs(z.argmax() * rate / 4500 - 500) < 4


def recursive(x, sections, start=None):
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        p, q = start[k] if start else (0.0, 0.0)
        y = np.empty_like(x)
        for i, v in enumerate(x):
            y[i] = b0 * v + p
            p, q = b1 * v - a1 * y[i] + q, b2 * v - a2 * y[i]
        x = y
    return x


def response(sections, w):
    z = np.exp(-1j * np.pi * w)
    return np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in sections])


def test_filters_have_their_cutoffs():
    for kind, passes, stops in (("low", 0.05, 0.6), ("high", 0.6, 0.02)):
        s = filters.butterworth(kind, 0.2)
        assert response(s, 0.2) == pytest.approx(0.5**0.5) and response(s, passes) == pytest.approx(1, abs=0.01) and response(s, stops) < 0.01
    s = filters.bandpass(0.1, 0.3)
    assert response(s, 0.1) == pytest.approx(0.5**0.5) and response(s, 0.3) == pytest.approx(0.5**0.5) and response(s, 0.18) > 0.99 > 0.01 > response(s, 0.9)


def test_bands_equal_recursion_and_add_up(spark):
    x, y = RNG.uniform(-1, 1, 1000), RNG.uniform(-1, 1, 33)
    got = filters.three_bands(rows(spark, x, y), 8000.0).collect()
    for t, v in enumerate((x, y)):
        r = sorted((r for r in got if r.track_id == t), key=lambda r: r.i)
        low = recursive(v, filters.butterworth("low", 220 / 4000))
        high = recursive(v - low, filters.butterworth("high", 2600 / 4000))
        assert np.allclose([q.low for q in r], low, atol=1e-10) and np.allclose([q.high for q in r], high, atol=1e-10)
        assert np.allclose([q.low + q.mid + q.high for q in r], v, atol=1e-12)


def test_struck_envelopes_equal_recursion_both_ways(spark):
    x, short, rate = RNG.uniform(-1, 1, 300), RNG.uniform(-1, 1, 15), 1024.0
    got = filters.struck(rows(spark, x, short), rate)
    s = filters.bandpass(25 / 512, 190 / 512)
    zi, reach = filters.settled(s), 21
    for t, v in enumerate((x, short)):
        b = v
        if len(v) > reach:
            e = np.concatenate([2 * v[0] - v[reach:0:-1], v, 2 * v[-1] - v[-2 : -reach - 2 : -1]])
            y = recursive(e, s, [(p * e[0], q * e[0]) for p, q in zi])[::-1]
            b = recursive(y, s, [(p * y[0], q * y[0]) for p, q in zi])[::-1][reach:-reach]
        k = max(1, round(0.008 * rate))
        energy = np.convolve(b * b, np.ones(k) / k, mode="full")[(k - 1) // 2 :][: len(b)]
        rise = np.maximum(np.diff(energy, prepend=energy[0]), 0)
        assert np.allclose(samples(got, t), np.clip(rise / (np.percentile(rise, 95) + 1e-12), 0, 5), atol=1e-8)


@pytest.mark.parametrize(("rate", "to"), [(44_100, 22_050), (48_000, 44_100), (24_000, 44_100)])
def test_resampling_keeps_a_tone(spark, rate, to):
    n = 2000
    x = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    y = samples(filters.resampled(rows(spark, x), rate, to))
    assert len(y) == -(-n * to // rate)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(y)) / to)
    assert np.abs(y - want)[100:-100].max() < 2e-3


def test_padding_reaches_a_second(spark):
    got = filters.padded(rows(spark, np.ones(5), np.ones(30)), 24)
    assert [len(samples(got, t)) for t in (0, 1)] == [24, 30] and samples(got)[5:].max() == 0


def test_stretch_by_name(spark):
    x = np.sin(np.arange(600) / 5) * np.linspace(0, 1, 600)
    s = rows(spark, x)
    assert np.allclose(samples(stretch.stretch(s, 1.0)), x)
    for backend, options in (("overlap", dict(frame=64, hop=16, radius=16)), ("vocoder", dict(size=64)), ("no such", dict(size=64)), ("auto", dict(size=64, width=5, frame=64, radius=16))):
        y = samples(stretch.stretch(s, 1.25, backend, **options))
        assert len(y) == 480 and 0.2 < np.abs(y[200:]).max() < 1.3
