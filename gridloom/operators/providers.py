"""What surrounds models whose outputs are inputs here: which windows they look at, and how their outputs become profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import arrays

# Width of a cue window in frames, share of it that overlaps the next one, and frames of padding before the first.
WINDOW, OVERLAP, PADDING = 355, 0.75, 266
# Length of an embedding window, where the first and last centre lie, and how many last layers are pooled.
CLIP_SECONDS, FIRST, LAST, LAYERS = 14.0, 0.05, 0.95, 4
TRIM_DB = 48.0


def clip_windows(tracks: DataFrame, rate: int, windows: int = 7, seconds: float = CLIP_SECONDS) -> DataFrame:
    """(track_id, window, start, length, position) of the clips to embed, from tracks (track_id, n samples, padded to a second)."""
    n = F.greatest(F.col("n"), F.lit(rate))
    length = F.least(n, F.lit(max(rate, round(seconds * rate)))).cast("long")
    t = tracks.select("track_id", n.alias("n"), length.alias("length"))
    step = (LAST - FIRST) / max(windows - 1, 1)
    start = lambda k: F.greatest(F.lit(0.0), F.least((FIRST + k * step) * (F.col("n") - 1) - F.col("length") / 2.0, (F.col("n") - F.col("length")).cast("double"))).cast("long")
    starts = F.when(F.col("n") <= F.col("length"), F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(F.array(*[start(k) for k in range(windows)]))))
    w = t.select("track_id", "n", "length", F.posexplode(starts).alias("window", "start"))
    position = F.when(F.col("n") <= F.col("length"), 0.5).otherwise((F.col("start") + F.col("length") / 2.0) / F.col("n"))
    return w.select("track_id", "window", "start", "length", position.alias("position"))


def mean_vector(v: str, dims: int) -> Column:
    return F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(dims)])


def pooled_layers(hidden: DataFrame, dims: int) -> DataFrame:
    """(track_id, window, v) of hidden (track_id, window, layer, n_layers, frame, v): the last layers and all frames averaged, of length 1."""
    last = hidden.filter(F.col("layer") >= F.col("n_layers") - LAYERS)
    return last.groupBy("track_id", "window").agg(mean_vector("v", dims).alias("v")).withColumn("v", arrays.l2_normalize(F.col("v")))


def profiles(windows: DataFrame, dims: int) -> DataFrame:
    """(track_id, global, intro, outro) of windows (track_id, window, v): the mean of all, the first and the last, of length 1."""
    p = windows.groupBy("track_id").agg(mean_vector("v", dims).alias("global"), F.min_by("v", "window").alias("intro"), F.max_by("v", "window").alias("outro"))
    return p.select("track_id", *[arrays.l2_normalize(F.col(n)).alias(n) for n in ("global", "intro", "outro")])


def cue_windows(images: DataFrame) -> DataFrame:
    """(track_id, window, left, right) over images (track_id, n frames): windows begin PADDING frames before the first."""
    step = WINDOW * (1 - OVERLAP)
    count = F.greatest(F.lit(1), F.floor((F.col("n") + PADDING) / step)).cast("int")
    w = images.select("track_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    left = F.floor(F.col("window") * step).cast("long") - PADDING
    return w.select("track_id", "window", left.alias("left"), (left + WINDOW).alias("right"))


def placed(detections: DataFrame, images: DataFrame) -> DataFrame:
    """(track_id, position, score): detections (track_id, window, at, score) in frames of their track; of windows that overlap the largest score."""
    d = detections.join(cue_windows(images), ["track_id", "window"]).join(images, "track_id").withColumn("position", F.col("left") + F.col("at"))
    ok = (F.col("position") >= 0) & (F.col("position") < F.col("n")) & F.col("score").isNotNull() & ~F.isnan("score")
    return d.filter(ok).groupBy("track_id", "position").agg(F.max("score").alias("score"))


def trim_bounds(levels: DataFrame, top_db: float = TRIM_DB) -> DataFrame:
    """(track_id, first, last) frames that are at most top_db below the loudest, from levels (track_id, frame, rms)."""
    loudest = levels.groupBy("track_id").agg(F.max("rms").alias("top"))
    heard = levels.join(loudest, "track_id").filter(20.0 * F.log10(F.greatest("rms", F.lit(1e-5)) / F.greatest("top", F.lit(1e-5))) > -top_db)
    return heard.groupBy("track_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def segments(results: DataFrame) -> DataFrame:
    """(track_id, seg, start, end, label, confidence) of results (track_id, segments): labels in lower case, each wholly sure."""
    s = results.select("track_id", F.posexplode("segments").alias("seg", "s"))
    return s.select("track_id", "seg", F.col("s.start").cast("double").alias("start"), F.col("s.end").cast("double").alias("end"), F.lower("s.label").alias("label"), F.lit(1.0).alias("confidence"))


# beats by a model

BATCH = 6
BEAT, NEAR = 0.5, 2


def activations(windows: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, batch: int = BATCH) -> DataFrame:
    """(track_id, frame, beat, down): a model's two outputs for each of windows (track_id, frame, x array of `size`).

    make_model runs once per Python worker and returns a function from (n, size) to (n, 2); n is `batch`, less at the end of a
    partition's Arrow batch, so that no window is padded or left out.
    """
    predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[size]])
    out = windows.select("track_id", "frame", predict("x").alias("y"))
    return out.select("track_id", "frame", F.get("y", F.lit(0)).alias("beat"), F.get("y", F.lit(1)).alias("down"))


def beats(scored: DataFrame, step: float, threshold: float = BEAT, near: int = NEAR) -> DataFrame:
    """(track_id, t, score, down) where the beat output is the first of the largest within `near` frames and reaches the threshold."""
    w = W.partitionBy("track_id").orderBy("frame")
    before, after = F.max("beat").over(w.rowsBetween(-near, -1)), F.max("beat").over(w.rowsBetween(1, near))
    s = scored.withColumns({"before": F.coalesce(before, F.lit(-1.0)), "after": F.coalesce(after, F.lit(-1.0))})
    top = s.filter((F.col("beat") >= threshold) & (F.col("beat") > F.col("before")) & (F.col("beat") >= F.col("after")))
    return top.select("track_id", (F.col("frame") * step).alias("t"), F.col("beat").alias("score"), (F.col("down") >= threshold).alias("down"))
