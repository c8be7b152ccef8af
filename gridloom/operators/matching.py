"""Hand-over points between neighbours: candidates, features of both slices, phrase policy, score, window.

Bars (track_id, bar, rms, low_ratio, onset, brightness, vocal, chroma, role, function, boundary, phrase, mix_in, mix_out, cue,
start_sample). A pair is (pair_id, a_track, b_track). Candidates per pair are at most 32 exits x 24 entries x 3 lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import arrays, scalar, slices
from ..functions.scalar import clip
from ..functions.windows import by_bar, by_track
from .structure import unit

MAX_EXITS, MAX_ENTRIES, LENGTHS = 32, 24, (4, 8, 16)
CUE_THRESHOLD = 0.34

def with_context(bars: DataFrame) -> DataFrame:
    """Adds what the phrase policy reads of a bar's surroundings: all windows share one sort per track."""
    role, bar = F.upper("role"), F.col("bar")
    changed = F.when(F.lag("role").over(by_bar()).isNull(), 1.0).otherwise(((role != F.upper(F.lag("role").over(by_bar()))) | (F.upper("function") != F.upper(F.lag("function").over(by_bar())))).cast("double"))
    b = bars.withColumn("n", F.count(F.lit(1)).over(by_track())).withColumn("edge", clip(0.50 * changed + 0.28 * F.coalesce("boundary", F.lit(0.5)) + 0.22 * F.coalesce("phrase", F.lit(0.5))))
    drop_before = F.max(F.when(role == "DROP", bar)).over(by_bar().rowsBetween(-8, -1))
    # the first bar after this one with another role, or the end of the track
    other = F.coalesce(F.lead("role").over(by_bar()) != F.col("role"), F.lit(True))
    run_end = F.min(F.when(other, bar)).over(by_bar().rowsBetween(0, W.unboundedFollowing))
    return b.withColumns({
        "since_drop": F.when(role != "DROP", bar - drop_before), "until_change": F.least(run_end - bar + 1, F.lit(17)),
        "rms_policy": unit(F.col("rms"), flat=0.5, eps=1e-10), "rms_match": unit(F.col("rms"), 0.10, 0.90, 0.0, 1e-10),
    })


def eligible(bars: DataFrame, earliest: Column, threshold: float = CUE_THRESHOLD) -> DataFrame:
    return bars.filter((F.col("cue") >= threshold) & (F.col("start_sample") >= earliest))


def or_all(df: DataFrame, ok: Column, key: str = "track_id") -> DataFrame:
    """Rows that hold ok; all rows of a key of which none does."""
    w = W.partitionBy(key)
    return df.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(w)).filter(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def top_by(df: DataFrame, score: str, k: int, key: str = "track_id") -> DataFrame:
    """The k rows of a key of the highest score; of equal ones the earlier bar."""
    w = W.partitionBy(key).orderBy(F.desc(score), "bar")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def entry_quality(bars: DataFrame, bpm: Column, rate: float, total: Column) -> Column:
    """How well an entry carries on alone, for rows of `bars` in windows."""
    two = by_bar().rowsBetween(0, 1)
    energy = clip(1.0 - F.exp(-F.avg(F.greatest("rms", F.lit(0.0))).over(two) / (F.percentile(F.greatest("rms", F.lit(0.0)), F.lit(0.5)).over(by_track()) + 1e-8)))
    onset, vocal = clip(F.avg("onset").over(two)), clip(F.avg("vocal").over(two))
    beat = F.greatest(F.lit(1.0), F.bround(60.0 / F.greatest(bpm, F.lit(1.0)) * rate))
    room = clip((total - F.col("start_sample")) / F.greatest(8.0 * beat, F.lit(1.0)))
    return clip(0.34 * clip(F.coalesce("mix_in", F.lit(0.5))) + 0.27 * energy + 0.22 * room + 0.11 * onset + 0.06 * (1.0 - 0.35 * vocal))


def ends(bars: DataFrame, exits: int = MAX_EXITS, entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The best exits (a_track, exit, a_n) and entries (b_track, entry, b_n) of each track, with its number of bars."""
    b = bars.withColumn("n", F.count(F.lit(1)).over(by_track()))
    leave = top_by(eligible(b, F.lit(0)), "mix_out", exits).select(F.col("track_id").alias("a_track"), F.col("bar").alias("exit"), F.col("n").alias("a_n"))
    enter = top_by(eligible(b, F.lit(0)), "mix_in", entries).select(F.col("track_id").alias("b_track"), F.col("bar").alias("entry"), F.col("n").alias("b_n"))
    return leave, enter


def candidates(pairs: DataFrame, bars: DataFrame, lengths: tuple[int, ...] = LENGTHS, exits: int = MAX_EXITS, entries: int = MAX_ENTRIES) -> DataFrame:
    """(pair_id, a_track, b_track, exit, entry, bars): both slices must lie within their tracks."""
    leave, enter = ends(bars, exits, entries)
    c = pairs.join(leave, "a_track").join(enter, "b_track").withColumn("bars", F.explode(F.array(*map(F.lit, lengths))))
    return c.filter("exit + bars <= a_n AND entry + bars <= b_n").select("pair_id", "a_track", "b_track", "exit", "entry", "bars")


def _sides(bars: DataFrame) -> DataFrame:
    """Per track one array per field of its bars, in order; roles and labels as codes. Dealt by track, so that it is made once for both sides of pairs."""
    named = F.array(*map(F.lit, slices.NAMES))
    code = lambda c: F.coalesce(F.array_position(named, F.upper(c)), F.lit(0)).cast("byte").alias(f"{c}_code")
    ctx = with_context(bars.select("*", code("role"), code("function")))
    values = {n: F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in dict.fromkeys((*slices.FIELDS, *slices.CONTEXT))}
    values |= {"role": F.col("role_code"), "function": F.col("function_code"), "chroma": F.col("chroma")}
    t = ctx.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("bar", *[v.alias(n) for n, v in values.items()]))).alias("rows"))
    return t.select("track_id", *[F.col(f"rows.{n}").alias(n) for n in values if n != "chroma"], F.flatten("rows.chroma").alias("chroma")).repartition(_parts(bars), "track_id")


def _parts(df: DataFrame) -> int:
    """Pairs are few bytes and many candidates: a fixed number of partitions, or adaptive execution would merge them into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


PAIRS_AT_ONCE = 16
KNOWN = ("key_score", "edm_confidence", "style", "segment", "trajectory")
"""Terms of a whole pair; 0.5 where they are unknown."""
_PLACES = {"exit": T.LongType(), "entry": T.LongType(), "bars": T.IntegerType()}
_NUMBERS = (*slices.WEIGHTS, "post_drop", "drop_landing", "role_path", "energy_arc", "boundary", "drop_guard", "local_gain", "score")
SCORED = ("pair_id", *_PLACES, *_NUMBERS, "intent", "role_a", "role_b")
"""Columns of scored candidates. Roles that no rule names are empty."""


def _scored(both: DataFrame, columns: tuple[str, ...], places: int | None, choose=None, only_best: bool = False) -> DataFrame:
    """A row per candidate, or per pair its best one. both: pair_id, KNOWN, both sides, and `listed` candidates, or none where choose(a, b) names them.

    Only `columns` leave the kernel, in their order and rounded if places are given: a projection of so many columns on rows
    in the JVM is one method too long to be compiled.
    """
    kinds = {"pair_id": both.schema["pair_id"].dataType, **_PLACES, **dict.fromkeys(_NUMBERS, T.DoubleType()), **dict.fromkeys(("intent", "role_a", "role_b"), T.StringType())}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in columns])

    def lists(column: pa.Array) -> list[np.ndarray]:
        values, at = column.values, column.offsets.to_numpy()
        names = [f.name for f in values.type] if pa.types.is_struct(values.type) else [None]
        every = [(values.field(n) if n else values).to_numpy(zero_copy_only=False) for n in names]
        return [every[0][i:j] if names[0] is None else tuple(v[i:j].astype(np.int64) for v in every) for i, j in zip(at[:-1], at[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {"intent": pa.array(scalar.INTENTS), **dict.fromkeys(("role_a", "role_b"), pa.array(("", *slices.NAMES)))}
        for part in (b.slice(i, PAIRS_AT_ONCE) for b in batches for i in range(0, b.num_rows, PAIRS_AT_ONCE)):
            sides = [{n[2:]: lists(part.column(n)) for n in part.schema.names if n.startswith(s)} for s in ("a_", "b_")]
            given = None if choose else lists(part.column("listed"))
            known = {n: part.column(n).to_numpy() for n in KNOWN}
            found = []
            for k in range(part.num_rows):
                a, b = ({n: v[k].reshape(-1, 12) if n == "chroma" else v[k] for n, v in side.items()} for side in sides)
                x = given[k] if given else choose(a, b)
                if len(x[0]):
                    t = slices.score(a, b, *x, {n: v[k] for n, v in known.items()}) | dict(zip(_PLACES, x, strict=True)) | {"pair_id": np.full(len(x[0]), k)}
                    at = slices.best(t, *x) if only_best else slice(None)
                    found.append({n: t[n][at] for n in columns})
            if not found:
                continue
            out = []
            for n in columns:
                v = np.concatenate([t[n] for t in found])
                if n in _NUMBERS:
                    out.append(pa.array(v if places is None else slices.rounded(v, places)))
                elif n in _PLACES:
                    out.append(pa.array(v.astype(np.int32 if n == "bars" else np.int64)))
                else:
                    out.append((part.column("pair_id") if n == "pair_id" else words[n]).take(pa.array(v)))
            yield pa.RecordBatch.from_arrays(out, names=list(columns))

    return both.mapInArrow(run, schema)


def _with_sides(listed: DataFrame, bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bars of both tracks travel once per pair; its candidates are scored and unfold behind the last exchange."""
    sides = _sides(bars)
    of = lambda p: sides.select(*[F.col(c).alias(f"{p}_track" if c == "track_id" else f"{p}_{c}") for c in sides.columns])
    known = pairs.select("pair_id", *[F.coalesce(F.col(n), F.lit(0.5)).alias(n) for n in KNOWN])
    return listed.join(known, "pair_id").join(of("a"), "a_track").repartition(_parts(bars), "b_track").join(of("b"), "b_track").drop("a_track", "b_track")


def score_candidates(cands: DataFrame, bars: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = SCORED, places: int | None = None) -> DataFrame:
    """cands with the 18 terms, the policy's sub-scores and intent, both roles and the score. pairs: pair_id and KNOWN (null: 0.5)."""
    listed = cands.groupBy("pair_id", "a_track", "b_track").agg(F.collect_list(F.struct("exit", "entry", "bars")).alias("listed"))
    return _scored(_with_sides(listed, bars, pairs), columns, places)


def score_pairs(pairs: DataFrame, bars: DataFrame, columns: tuple[str, ...] = SCORED, places: int | None = None, only_best: bool = False, lengths: tuple[int, ...] = LENGTHS, exits: int = MAX_EXITS, entries: int = MAX_ENTRIES) -> DataFrame:
    """score_candidates() of all candidates() of pairs (pair_id, a_track, b_track and KNOWN), or of each pair the best one alone.

    Candidates are no rows before they are scored, and none but the best one becomes a row where that is all that is asked for.
    """

    def choose(a: slices.Track, b: slices.Track) -> tuple[np.ndarray, ...]:
        return slices.every(slices.leading(a, "mix_out", exits, CUE_THRESHOLD), slices.leading(b, "mix_in", entries, CUE_THRESHOLD), lengths, len(a["rms"]), len(b["rms"]))

    return _scored(_with_sides(pairs.select("pair_id", "a_track", "b_track"), bars, pairs), columns, places, choose, only_best)


def best_candidate(scored: DataFrame) -> DataFrame:
    """The first best candidate per pair in order of (bars, exit, entry)."""
    w = W.partitionBy("pair_id").orderBy(F.desc("score"), "bars", "exit", "entry")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def structural_prior(ctx: DataFrame, leaving: bool) -> DataFrame:
    """(track_id, bar, prior) for exits or entries from roles, edges and the last drop."""
    # Priors of roles.
    exits = {"OUTRO": 1.00, "COOLDOWN": 0.96, "BREAKDOWN": 0.90, "BREAK": 0.88, "PHRASE": 0.72, "SECTION": 0.58, "BUILDUP": 0.34, "VOCAL": 0.30, "VERSE": 0.28, "CHORUS": 0.26, "DROP": 0.16}
    entries = {"INTRO": 1.00, "BUILDUP": 0.96, "BREAKDOWN": 0.80, "BREAK": 0.78, "PHRASE": 0.75, "SECTION": 0.60, "DROP": 0.62, "CHORUS": 0.48, "VOCAL": 0.22, "VERSE": 0.20, "OUTRO": 0.08}
    role = F.upper("role")
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (exits if leaving else entries).items() for x in kv]), role), F.lit(0.48))
    if leaving:
        d = F.col("since_drop")
        base = base + F.when(d.isNotNull(), 0.24 * F.exp(-0.35 * F.greatest(F.lit(0), d - 1))).otherwise(0.0)
        base = F.when((role == "DROP") & (F.col("until_change") <= 2), F.greatest(base, F.lit(0.58))).otherwise(base)
    return ctx.select("track_id", "bar", clip(0.78 * base + 0.22 * F.col("edge")).alias("prior"))


def cue_window(c: DataFrame, pre_beats: float = 4.0, release_beats: float = 2.0) -> DataFrame:
    """Adds the window around both cues: a_start, b_start, length, handoff, b_resume and tail.

    Reads bpm, rate, a_cue, b_cue, a_total, b_total, earliest, b_first (first downbeat), force_tail. Short releases and
    forced tails fade out at the end of a.
    """
    f, zero = F.col, F.lit(0)
    c = c.withColumn("beat", F.greatest(F.lit(1), F.bround(60.0 / F.greatest(f("bpm"), F.lit(1.0)) * f("rate")).cast("long")))
    want_pre, want_post = F.bround(pre_beats * f("beat")).cast("long"), F.greatest(F.lit(1), F.bround(release_beats * f("beat")).cast("long"))
    pre = F.least(F.greatest(zero, f("a_cue") - F.greatest(zero, f("earliest"))), F.greatest(zero, f("b_cue")), want_pre)
    post = F.least(F.greatest(zero, f("a_total") - f("a_cue")), F.greatest(zero, f("b_total") - f("b_cue")), want_post)
    c = c.withColumns({"pre": pre, "post": post, "want_pre": want_pre})
    tail = f("force_tail") | (f("post") < F.greatest(F.lit(64), F.bround(0.25 * f("beat")).cast("long")))
    fade = F.greatest(F.lit(64), F.least(f("want_pre"), 2 * f("beat")))
    low = F.greatest(zero, F.least(f("earliest"), F.greatest(zero, f("a_total") - 1)))
    c = c.withColumns({"tail": tail, "fade": fade, "low": low})
    at = F.greatest(zero, F.least(f("b_cue"), F.greatest(zero, f("b_total") - 1)))
    at = F.when(f("b_total") - at < F.least(f("fade"), f("beat")), F.coalesce("b_first", zero)).otherwise(at)
    c = c.withColumn("at", at)
    room = F.greatest(F.lit(1), f("b_total") - f("at"))
    n = F.greatest(F.lit(1), F.least(f("fade"), F.greatest(F.lit(1), f("a_total") - f("low")), room))
    start = F.greatest(zero, f("a_total") - n)
    late = start < f("low")
    n = F.when(late, F.greatest(F.lit(1), F.least(f("a_total") - f("low"), room))).otherwise(n)
    start = F.when(late, f("low")).otherwise(start)
    pick = lambda a, b: F.when(f("tail"), a).otherwise(b).cast("long")
    return c.withColumns({
        "a_start": pick(start, f("a_cue") - f("pre")), "b_start": pick(f("at"), f("b_cue") - f("pre")), "length": pick(n, f("pre") + f("post")),
        "handoff": pick(n, f("pre")), "b_resume": pick(F.least(f("b_total"), f("at") + n), f("b_cue") + f("post")),
    }).drop("beat", "pre", "post", "want_pre", "fade", "low", "at")


def gain_curves(n: Column, gain: Column, strength: float = 0.72, style: str = "club", centre: float = 0.53, width: float = 0.18) -> dict[str, Column]:
    """Six gain curves of n points as arrays: fade, bass and high band, out and in."""
    phase = arrays.linspace(F.lit(0.0), F.lit(1.0), n)
    duck = lambda p: 1.0 - 0.13 * strength * F.sin(math.pi * p) * F.sin(math.pi * p)
    out = lambda p: F.cos(p * (math.pi / 2)) * duck(p)
    into = lambda p: F.sin(p * (math.pi / 2)) * (gain + (1.0 - gain) * scalar.smoothstep(p)) * duck(p)
    bass = lambda p: scalar.smoothstep((p - (centre - width / 2)) / width)
    # Depth, start and length of the outgoing sweep; floor, start and length of the incoming one.
    sweep = {"filter": (0.92, 0.10, 0.70, 0.12, 0.04, 0.62), "echo": (0.68, 0.34, 0.50, 0.22, 0.02, 0.48), "club": (0.78, 0.27, 0.56, 0.18, 0.03, 0.52)}
    if style == "smooth":
        high_out, high_in = out, into
    else:
        d, a, w, low, a2, w2 = sweep.get(style, sweep["club"])
        high_out = lambda p: out(p) * (1.0 - strength * d * scalar.smoothstep((p - a) / w))
        high_in = lambda p: into(p) * ((1.0 - strength) + strength * (low + (1 - low) * scalar.smoothstep((p - a2) / w2)))
    curves = {"fade_out": out, "fade_in": into, "bass_out": lambda p: F.sqrt(clip(1.0 - bass(p))), "bass_in": lambda p: F.sqrt(clip(bass(p))), "high_out": high_out, "high_in": high_in}
    return {name: F.transform(phase, f) for name, f in curves.items()}


# Beats before and after the cue between which the decks, and their basses, change over.
CUE_RAMPS = {"decks": (1.40, 1.10), "bass": (0.55, 0.35)}


def cue_curves(phase: Column, switch: Column, beats: Column, gain: Column) -> dict[str, Column]:
    """Gains of a plain crossfade around the cue at `switch`, both from 0 to 1: fade, bass and high band, out and in.

    beats is the length of the window. What the second deck gains in level is released until the window ends.
    """

    def over(name: str) -> Column:
        before, after = CUE_RAMPS[name]
        w = 1.0 / F.greatest(beats, F.lit(1.0))
        return scalar.ramp(phase, clip(clip(switch) - before * w), clip(clip(switch) + after * w), smoother=False)

    level = gain + (1.0 - gain) * scalar.smoothstep(phase)
    out, into = scalar.equal_power(over("decks"))
    bass = over("bass")
    return {"fade_out": out, "fade_in": into * level, "bass_out": 1.0 - bass, "bass_in": bass * level, "high_out": out, "high_in": into * level}
