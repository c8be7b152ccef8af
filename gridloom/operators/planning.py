"""Plans of hand-overs: feasible cues with fallbacks, semantic terms, rendering styles, policy, assembled plans.

All inputs are tables of bars, candidates or scored candidates of matching.py; every step is a projection, a window per track
or pair, or an equi-join on track or pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import arrays, scalar
from ..functions.scalar import clip
from ..functions.windows import by_track
from .matching import CUE_THRESHOLD, cue_window, eligible, entry_quality, or_all

ARCHETYPES = ("Short Blend", "Bass Swap", "Echo Out")


def beat_samples(bpm: Column, rate: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(60.0 / F.greatest(bpm, F.lit(1.0)) * rate).cast("long"))


def feasible_cues(bars: DataFrame, bpm: Column, rate: Column, total: Column, floor: Column, pre_beats: float = 4.0, release_beats: float = 2.0, threshold: float = CUE_THRESHOLD) -> DataFrame:
    """Eligible cues whose pre-roll and release fit the track; all eligible ones of a track where none does."""
    beat = beat_samples(bpm, rate)
    pre, post = F.bround(pre_beats * beat).cast("long"), F.bround(release_beats * beat).cast("long")
    start = F.col("start_sample")
    return or_all(eligible(bars, floor, threshold), (start - pre >= floor) & (start + post < total))


def tail_entries(bars: DataFrame, bpm: Column, rate: Column, total: Column, k: int) -> DataFrame:
    """Entries for the case that the first track ends: those with a beat after them (or all), the k that carry on alone best.

    Adds quality; of equal ones the stronger mix_in, then the earlier bar.
    """
    room = F.greatest(F.lit(64), beat_samples(bpm, rate))
    q = bars.withColumn("quality", entry_quality(bars, bpm, rate, total))
    some = or_all(eligible(q, F.lit(0)), F.col("start_sample") + room < total)
    w = by_track().orderBy(F.desc("quality"), F.desc("mix_in"), "bar")
    return some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def tail_blend(score: Column, quality: Column) -> Column:
    return 0.86 * score + 0.14 * quality


def timing_metrics(length: Column, handoff: Column, bpm: Column, rate: Column) -> Column:
    """A map of how long a transition and its parts are, in beats, and where in it the hand-over lies."""
    per = F.greatest(bpm, F.lit(1.0)) / (60.0 * rate)
    whole, pre = length * per, handoff * per
    parts = {"transition_beats": whole, "pre_roll_beats": pre, "release_beats": F.greatest(F.lit(0.0), whole - pre), "handoff_phase": handoff / F.greatest(length, F.lit(1.0))}
    return F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v)])


def merge_metrics(*maps: Column) -> Column:
    """Maps of metrics put together; of equal names the last one counts, whatever spark.sql.mapKeyDedupPolicy says."""
    def merged(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    return reduce(merged, maps)


def or_fallback(candidates: DataFrame, exits: DataFrame, entries: DataFrame, pairs: DataFrame, requested: int = 4) -> DataFrame:
    """candidates, and for pairs without any the last exit with the first entry and as many bars as fit.

    exits (a_track, exit, a_n) and entries (b_track, entry, b_n).
    """
    none = pairs.join(candidates.select("pair_id").distinct(), "pair_id", "left_anti")
    last = exits.groupBy("a_track").agg(F.max("exit").alias("exit"), F.max("a_n").alias("a_n"))
    first = entries.groupBy("b_track").agg(F.min("entry").alias("entry"), F.max("b_n").alias("b_n"))
    room = F.least(F.col("a_n") - F.col("exit"), F.col("b_n") - F.col("entry"))
    more = none.join(last, "a_track").join(first, "b_track").withColumn("bars", F.greatest(F.lit(1), F.least(room, F.lit(requested))).cast("int"))
    return candidates.unionByName(more.select(candidates.columns))


def semantic_terms(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """candidates (pair_id, a_track, b_track, exit, entry, bars, a_n, b_n) with style, segment and trajectory; 0.5 where a vector is unavailable.

    profiles (track_id, global, timeline, positions). The middle of each slice picks the nearest window of the timeline.
    """
    tracks, ends = ("a_track", "b_track"), ("a_at", "b_at")
    places = lambda p: profiles.select(F.col("track_id").alias(f"{p}_track"), F.col("positions").alias(f"{p}_positions"))
    middle = lambda start, n: clip((F.col(start) + 0.5 * F.col("bars")) / F.greatest(F.col(n), F.lit(1)))
    at = lambda p, start: F.coalesce(arrays.nearest_at(middle(start, f"{p}_n"), F.col(f"{p}_positions")), F.lit(0))
    c = candidates.join(places("a"), "a_track", "left").join(places("b"), "b_track", "left").withColumns({"a_at": at("a", "exit"), "b_at": at("b", "entry")})
    # candidates of a pair share few pairs of windows: vectors travel and align once for each of those
    side = lambda p: profiles.select(F.col("track_id").alias(f"{p}_track"), F.col("global").alias(f"{p}_global"), F.col("timeline").alias(f"{p}_timeline"))
    w = c.select(*tracks, *ends).distinct().join(side("a"), "a_track", "left").join(side("b"), "b_track", "left")
    known = F.coalesce((F.size("a_global") > 0) & (F.size("b_global") > 0), F.lit(False))
    half = lambda x: F.when(known, x).otherwise(0.5)
    near = lambda p: F.coalesce(F.get(f"{p}_timeline", F.col(f"{p}_at") - 1), F.col(f"{p}_global"))
    walk = lambda p: arrays.around(F.col(f"{p}_timeline"), F.col(f"{p}_at"), 1)
    terms = w.select(
        *tracks, *ends,
        half(arrays.cosine_similarity(F.col("a_global"), F.col("b_global"))).alias("style"),
        half(arrays.cosine_similarity(near("a"), near("b"))).alias("segment"),
        half(arrays.dtw_similarity(walk("a"), walk("b"), 0.5)).alias("trajectory"),
    )
    return c.join(terms, [*tracks, *ends]).select(*candidates.columns, "style", "segment", "trajectory")


def style_fit(role_a: Column, role_b: Column, intent: Column) -> dict[str, Column]:
    """Fit of each rendering style from the terms edm_confidence, vocal_clean, harmonic, bass_clean, cue_alignment, phrase_alignment."""
    t = {n: clip(F.coalesce(F.col(n), F.lit(0.5))) for n in ("edm_confidence", "vocal_clean", "harmonic", "bass_clean", "cue_alignment", "phrase_alignment")}
    risk = 1.0 - t["vocal_clean"]
    opens = F.upper(role_b).isin("INTRO", "PHRASE", "SECTION", "BUILDUP", "BREAKDOWN").cast("double")
    sings = F.upper(role_a).isin("VOCAL", "VERSE", "CHORUS", "SOLO").cast("double")
    order = scalar.recommended_styles(intent)
    # the plan of last resort has no preference for bass swaps
    bonus = lambda s: F.when(F.get(order, F.lit(0)) == s, 0.16).when(F.get(order, F.lit(1)) == s, 0.08).otherwise(0.0)
    return {
        "Short Blend": clip(0.26 + 0.24 * t["harmonic"] + 0.20 * t["phrase_alignment"] + 0.14 * t["bass_clean"] + 0.10 * opens + 0.06 * (1.0 - risk) + bonus("Short Blend")),
        "Bass Swap": clip(0.24 + 0.22 * t["edm_confidence"] + 0.18 * t["cue_alignment"] + 0.16 * t["phrase_alignment"] + 0.14 * (1.0 - t["bass_clean"]) + 0.06 * opens + bonus("Bass Swap")),
        "Echo Out": clip(0.08 + 0.28 * risk + 0.22 * (1.0 - t["harmonic"]) + 0.18 * sings + 0.14 * t["cue_alignment"] + 0.10 * t["phrase_alignment"] + bonus("Echo Out")),
    }


def style_order(role_a: Column, role_b: Column, intent: Column, most: int = 3) -> Column:
    """Styles to render, best fit first, of equal ones the later name; echo only over busy vocals or dissonance."""
    fit = style_fit(role_a, role_b, intent)
    echo = (1.0 - F.coalesce("vocal_clean", F.lit(0.5)) >= 0.45) | (F.coalesce("harmonic", F.lit(0.5)) <= 0.42)
    rows = [F.when(F.lit(s != "Echo Out") | echo, F.struct(v.alias("fit"), F.lit(s).alias("style"))) for s, v in fit.items()]
    return F.slice(F.transform(F.reverse(F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull()))), lambda r: r["style"]), 1, max(1, most))


def automix(plans: DataFrame, policy: str | Column = "structure", least: float = 0.60) -> DataFrame:
    """plans with automix_confidence and mode; policy is a name, or a column of names. Reads score, edm_confidence, cue_alignment, phrase_alignment, policy, intent, tail."""
    confidence = clip(0.43 * F.col("score") + 0.20 * F.coalesce("edm_confidence", F.lit(0.5)) + 0.10 * F.col("cue_alignment") + 0.07 * F.col("phrase_alignment") + 0.20 * clip("policy"))
    p = plans.withColumn("automix_confidence", confidence)
    simple = (F.col("score") >= 0.43) | (F.col("cue_alignment") >= 0.46)
    wanted = F.lit(policy) if isinstance(policy, str) else policy
    kind = scalar.automix_policy("tail", wanted == "always dj", wanted == "crossfade", F.col("automix_confidence") + (0.60 - least), "policy", "intent", simple)
    return p.withColumn("mode", kind)


def assemble(best: DataFrame, pairs: DataFrame) -> DataFrame:
    """Complete plans: window around both cues, ends, switch positions, recommended styles and mode.

    best: best candidates with their terms. pairs: pair_id, bpm, rate, a_total, b_total, earliest, b_first, force_tail, samples_per_bar.
    """
    p = best.join(pairs, "pair_id").withColumn("a_cue", (F.col("exit") * F.col("samples_per_bar")).cast("long")).withColumn("b_cue", (F.col("entry") * F.col("samples_per_bar")).cast("long"))
    w = cue_window(p)
    w = w.withColumns({
        "a_end": F.col("a_start") + F.col("length"), "b_end": F.when(F.col("b_resume") >= 0, F.col("b_resume")).otherwise(F.col("b_start") + F.col("length")),
        "switch": F.col("handoff") / F.greatest(F.col("length"), F.lit(1)), "switch_a": F.col("a_start") + F.col("handoff"), "switch_b": F.col("b_start") + F.col("handoff"),
        "styles": scalar.recommended_styles("intent"), "intent_code": scalar.intent_code("intent"),
    })
    return automix(w)


# Complexity of plain hand-overs by mode, with the name of their policy.
SIMPLE = {"gapless": ("short smooth hand-over", 0.15), "simple": ("short beat crossfade", 0.42), "crossfade": ("short beat crossfade", 0.42), "tail": ("endpoint-safe tail fade", 0.42)}


def simple_plans(plans: DataFrame) -> DataFrame:
    """The plain hand-overs that plans of any mode but creative become.

    Cues and starts stay; the window shrinks to what both tracks still hold, one sample at least, and the next track resumes
    after the last sample that was played. No effects. Reads mode, a_start, b_start, length, a_total, b_total.
    """
    left = lambda total, start: F.greatest(F.lit(1), F.col(total) - F.col(start))
    length = F.greatest(F.lit(1), F.least(F.col("length"), left("a_total", "a_start"), left("b_total", "b_start"))).cast("long")
    p = plans.filter(F.col("mode").isin(*SIMPLE)).withColumn("length", length)
    named = lambda k: F.create_map(*(F.lit(x) for m, v in SIMPLE.items() for x in (m, v[k])))[F.col("mode")]
    return p.withColumns({"a_end": F.col("a_start") + F.col("length"), "b_resume": F.col("b_start") + F.col("length"), "policy_name": named(0), "complexity": named(1), "effect": F.lit(0.0)})


def band_correlation(samples: DataFrame) -> DataFrame:
    """(track_id, band, rho) of samples (track_id, band, a, b)."""
    s = samples.groupBy("track_id", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    size = F.sqrt(F.col("aa") * F.col("bb"))
    return s.select("track_id", "band", F.when((F.col("n") < 64) | (size <= 1e-9), 0.0).otherwise(clip(F.col("ab") / size, -1.0, 1.0)).alias("rho"))


def adapted_gains(curves: DataFrame, samples: DataFrame) -> DataFrame:
    """curves (track_id, band, i, gain_out, gain_in) scaled by the correlation of their band; reduction is the largest in decibels."""
    c = curves.join(band_correlation(samples), ["track_id", "band"], "left")
    out, into, scale = scalar.correlated_gains("gain_out", "gain_in", F.coalesce("rho", F.lit(0.0)))
    worst = -20.0 * F.log10(F.min(scale).over(W.partitionBy("track_id", "band")))
    return c.select("track_id", "band", "i", out.alias("gain_out"), into.alias("gain_in"), worst.alias("reduction"))
