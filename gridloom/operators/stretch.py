"""Signals (track_id, i, x) stretched at one rate with their pitch kept, by a named backend.

The overlap backend is a chain: each frame starts where it best continues the one before, which needs that one's place. The
chain is folded per track in one grouped step over the samples of one recording; frames then meet their samples in a join and
are added up as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_track
from . import spectra


def lengths(signal: DataFrame, rate: float = 1.0) -> DataFrame:
    n = signal.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("length", F.greatest(F.bround(F.col("n") / rate).cast("long"), F.lit(1).cast("long")))


def matched(signal: DataFrame, to: DataFrame) -> DataFrame:
    """Signals cut, or padded with zeros, to lengths (track_id, length)."""
    full = to.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("i"))
    return full.join(signal, ["track_id", "i"], "left").select("track_id", "i", F.coalesce("x", F.lit(0.0)).alias("x"))


def best_places(x: np.ndarray, rate: float, frame: int, hop: int, radius: int) -> list[int]:
    """Start of each frame: within radius of where the rate puts it, the first place most alike the end of the frame before."""
    n, overlap = len(x), frame - hop
    last = max(0, n - frame)
    # one frame of zeros behind the end: frames of a short signal reach there
    padded = np.concatenate([x, np.zeros(frame)])
    places: list[int] = []
    expected = 0.0
    for _ in range(0, max(1, round(n / rate)), hop):
        at = min(max(round(expected), 0), last)
        if places and overlap > 0:
            tail = padded[places[-1] + hop : places[-1] + frame]
            tail = tail - tail.mean()
            tries = np.arange(max(0, at - radius), min(last, at + radius) + 1, max(1, radius // 24))
            if len(tries):
                heads = padded[tries[:, None] + np.arange(overlap)]
                heads = heads - heads.mean(1, keepdims=True)
                alike = heads @ tail / ((np.linalg.norm(tail) + 1e-9) * (np.linalg.norm(heads, axis=1) + 1e-9))
                at = int(tries[np.argmax(alike)])
        places.append(at)
        expected = at + hop * rate
    return places


def overlapped(signal: DataFrame, rate: float, frame: int = 2048, hop: int = 512, radius: int = 256) -> DataFrame:
    """Frames chained by likeness, weighted by the root of a Hann window and added up."""
    to = lengths(signal, rate)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        places = best_places(rows.sort_values("i")["x"].to_numpy(), rate, frame, hop, radius)
        return pd.DataFrame({"track_id": rows["track_id"].iloc[0], "o": np.arange(len(places)), "at": places})

    chain = signal.select("track_id", "i", "x").groupBy("track_id").applyInPandas(fold, f"track_id {dict(signal.dtypes)['track_id']}, o long, at long")
    each = chain.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frame - 1).cast("long"))))
    met = each.select("track_id", (F.col("at") + F.col("j")).alias("i"), (F.col("o") * hop + F.col("j")).alias("to"), "j").join(signal, ["track_id", "i"], "left")
    w = F.sqrt(0.5 - 0.5 * F.cos(F.col("j") * (2 * np.pi / (frame - 1))) + 1e-8)
    added = met.groupBy("track_id", F.col("to").alias("i")).agg(F.sum(F.coalesce("x", F.lit(0.0)) * w).alias("y"), F.sum(w).alias("w"))
    return matched(added.select("track_id", "i", (F.col("y") / F.greatest("w", F.lit(1e-5))).alias("x")), to)


def vocoder(signal: DataFrame, rate: float, size: int = 2048) -> DataFrame:
    """One phase vocoder over the whole signal."""
    hop = size // 4
    to = lengths(signal, rate)
    frames = (F.floor(F.col("n") / hop) + 1).alias("n_frames")
    steps = to.select("track_id", frames).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_frames") / rate) - 1)))
    place = F.col("o") * rate
    at = steps.filter(place < F.col("n_frames")).select("track_id", "o", F.floor(place).alias("frame"), (place - F.floor(place)).alias("alpha"))
    out = spectra.vocoded(spectra.spectrum(signal, size, hop), at, size, hop, phase_first=False)
    return spectra.resynthesis(out, to.select("track_id", "length"), size, hop)


def hybrid(signal: DataFrame, rate: float, size: int = 2048, width: int = 31, margins: tuple[float, float] = (1.0, 1.5), frame: int = 2048, radius: int = 256) -> DataFrame:
    """The steady part by the vocoder, the struck part by overlap, which keeps it sharp; the peak stays below 0.995."""
    hop = size // 4
    n = lengths(signal).select("track_id", F.col("n").alias("length"))
    masked = spectra.harmonic_percussive(spectra.spectrum(signal, size, hop), size, width, margins)
    part = lambda m: spectra.resynthesis(masked.select("track_id", "frame", "k", (F.col("re") * F.col(m)).alias("re"), (F.col("im") * F.col(m)).alias("im")), n, size, hop)
    steady, struck = vocoder(part("harmonic"), rate, size), overlapped(part("percussive"), rate, frame, frame // 4, radius)
    both = steady.join(struck.withColumnRenamed("x", "y"), ["track_id", "i"]).select("track_id", "i", (F.col("x") + F.col("y")).alias("x"))
    peak = F.max(F.abs("x")).over(by_track()) + 1e-9
    return both.withColumn("x", F.when(peak > 0.995, F.col("x") * 0.995 / peak).otherwise(F.col("x")))


BACKENDS: dict[str, Callable[..., DataFrame]] = {"vocoder": vocoder, "overlap": overlapped, "hybrid": hybrid, "auto": hybrid}


def stretch(signal: DataFrame, rate: float, backend: str = "auto", **options) -> DataFrame:
    """By a registered backend; an unknown name means the vocoder. A rate of one changes nothing; above one is faster."""
    if abs(rate - 1.0) <= 1e-4:
        return signal.select("track_id", "i", "x")
    return BACKENDS.get(backend.strip().lower(), vocoder)(signal, rate, **options)
