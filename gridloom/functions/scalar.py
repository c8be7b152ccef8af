"""Scalar expressions: easing, tempo, keys, role tables, intents. All are plain Column functions."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | float | int | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def number(x: ColumnLike) -> Column:
    """A column as it is, any number as a double."""
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


def clip(x: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(x)))


def smoothstep(x: ColumnLike, clipped: bool = True) -> Column:
    """The cubic from 0 to 1. Not clipped, it goes on beyond the range, as do all curves below."""
    v = clip(x) if clipped else col(x)
    return v * v * (3.0 - 2.0 * v)


def smootherstep(x: ColumnLike, clipped: bool = True) -> Column:
    v = clip(x) if clipped else col(x)
    return v * v * v * (v * (v * 6.0 - 15.0) + 10.0)


def ramp(phase: ColumnLike, start: ColumnLike | float, end: ColumnLike | float, smoother: bool = True) -> Column:
    """0 before start, 1 after end, eased between; a step at start where there is no room between."""
    p, a, b = col(phase), number(start), number(end)
    ease = smootherstep if smoother else smoothstep
    return F.when(b <= a + 1e-6, F.when(p >= a, 1.0).otherwise(0.0)).otherwise(ease((p - a) / F.greatest(b - a, F.lit(1e-6))))


def equal_power(p: ColumnLike, clipped: bool = True) -> tuple[Column, Column]:
    """Outgoing and incoming gains of equal summed power."""
    x = (clip(p) if clipped else col(p)) * (math.pi / 2)
    return F.cos(x), F.sin(x)


def bar_quantized(v: ColumnLike, steps: int) -> Column:
    """Half-even rounding to whole steps."""
    return F.bround(col(v) * float(steps)) / float(steps)


def decibels(x: ColumnLike) -> Column:
    return 20.0 * F.log10(F.greatest(col(x), F.lit(1e-8)))


def related_bpm(source: ColumnLike, target: ColumnLike) -> Column:
    """source halved, kept or doubled, whichever is nearest to target in octaves; the first of equals."""
    s, t = col(source), F.greatest(col(target), F.lit(1e-6))
    d = [F.abs(F.log2(F.greatest(s * m, F.lit(1e-6)) / t)) for m in (0.5, 1.0, 2.0)]
    return F.when((d[0] <= d[1]) & (d[0] <= d[2]), s * 0.5).when(d[1] <= d[2], s).otherwise(s * 2.0)


def fold_bpm(bpm: ColumnLike, low: float = 70.0, high: float = 190.0) -> Column:
    """Doubled until at least low, then halved until at most high."""
    b = col(bpm)
    return (
        F.when(b < low, b * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(low) / b))))
        .when(b > high, b * F.pow(F.lit(2.0), -F.ceil(F.log2(b / high))))
        .otherwise(b)
    )


Rule = tuple[dict[str, tuple], object]


def first_rule(rules: tuple[Rule, ...], fields: dict[str, Column], otherwise) -> Column:
    """Value of the first rule of an ordered table all of whose fields hold one of its values."""
    out = None
    for wanted, value in rules:
        holds = reduce(and_, [fields[name].isin(*values) for name, values in wanted.items()])
        out = F.when(holds, F.lit(value)) if out is None else out.when(holds, F.lit(value))
    return out.otherwise(F.lit(otherwise))


# Score of two keys by distance in semitones and by whether their modes are the same.
KEY_RULES: tuple[Rule, ...] = (
    ({"unknown": (True,)}, 0.55),
    ({"delta": (0,), "same": (True,)}, 1.0),
    ({"delta": (5, 7), "same": (True,)}, 0.90),
    ({"delta": (3, 9), "same": (False,)}, 0.92),
    ({"delta": (2, 10)}, 0.70),
)
KEY_ELSE = 0.42


def camelot_compatibility(key_a: ColumnLike, mode_a: ColumnLike, key_b: ColumnLike, mode_b: ColumnLike) -> Column:
    a, b = col(key_a), col(key_b)
    return first_rule(KEY_RULES, {"unknown": (a < 0) | (b < 0), "delta": F.pmod(b - a, F.lit(12)), "same": col(mode_a) == col(mode_b)}, KEY_ELSE)


def soft_limit(x: ColumnLike, peak: ColumnLike | None = None, drive: float = 1.08) -> Column:
    """A sample of a block whose largest magnitude is `peak` (its own, if none is given): bent only in loud blocks, never beyond 1."""
    drive = max(1.0, drive)
    loud = (F.abs(col(x)) if peak is None else col(peak)) > 0.86
    return clip(F.when(loud, F.tanh(col(x) * drive) / math.tanh(drive)).otherwise(col(x)), -1.0, 1.0)


# Bars over which a tempo difference up to a share is undone, and the least of them where the style is sure.
RESTORE_BARS = ((0.008, 4), (0.020, 8), (0.040, 16), (math.inf, 32))
RESTORE_SURE = (0.55, 0.015, 16)


def restore_bars(delta: ColumnLike, edm_confidence: ColumnLike) -> Column:
    """Bars over which a tempo difference, as a share, is undone: those of the first limit that it does not exceed."""
    d, (sure, beyond, least) = col(delta), RESTORE_SURE
    base = F.coalesce(*[F.when(d <= limit, bars) for limit, bars in RESTORE_BARS])
    return F.when((col(edm_confidence) >= sure) & (d > beyond), F.greatest(base, F.lit(least))).otherwise(base)


def eased_bpm(bpm_from: ColumnLike, bpm_to: ColumnLike, phase: ColumnLike, clipped: bool = True) -> Column:
    """Geometric interpolation along an eased phase."""
    a, b = F.greatest(col(bpm_from), F.lit(1e-6)), F.greatest(col(bpm_to), F.lit(1e-6))
    return F.exp(F.log(a) + (F.log(b) - F.log(a)) * smootherstep(phase, clipped))


def stretch_rate(source_bpm: ColumnLike, target_bpm: ColumnLike, limit: float) -> Column:
    """Rate that matches tempos; 1 if it is further than limit from 1."""
    rate = related_bpm(target_bpm, source_bpm) / F.greatest(col(source_bpm), F.lit(1e-6))
    return F.when(F.abs(rate - 1.0) <= limit, rate).otherwise(1.0)


def clock_text(seconds: ColumnLike) -> Column:
    s = F.floor(F.greatest(col(seconds), F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def decay(x: ColumnLike, rate: float) -> Column:
    return F.exp(-rate * F.abs(col(x)))


def energy_arc_term(previous: ColumnLike, following: ColumnLike) -> Column:
    """Rewards a controlled reversal of energy, penalises two moves one way and abrupt acceleration."""
    p, f = col(previous), col(following)
    value = -0.055 * F.least(F.lit(1.0), F.abs(f - p) / 0.60)
    both = F.least(F.lit(1.0), F.least(F.abs(p), F.abs(f)) / 0.28)
    return F.when((F.abs(p) < 0.035) | (F.abs(f) < 0.035), value).when(p * f < 0, value + 0.075 * both).otherwise(value - 0.065 * both)


# Score of an outgoing last label followed by an incoming first label.
EDGE_LABELS = {
    ("outro", "intro"): 1.00,
    ("outro", "verse"): 0.88,
    ("outro", "chorus"): 0.76,
    ("break", "chorus"): 0.92,
    ("bridge", "chorus"): 0.90,
    ("inst", "intro"): 0.90,
    ("solo", "intro"): 0.70,
    ("verse", "intro"): 0.80,
    ("chorus", "intro"): 0.82,
    ("chorus", "verse"): 0.75,
    ("break", "intro"): 0.86,
}

# Score of an outgoing role followed by an incoming role.
ROLE_PAIRS = {
    ("OUTRO", "INTRO"): 1.00,
    ("BREAKDOWN", "DROP"): 0.98,
    ("BUILDUP", "DROP"): 0.96,
    ("VERSE", "INTRO"): 0.88,
    ("VOCAL", "INTRO"): 0.86,
    ("CHORUS", "BREAKDOWN"): 0.84,
    ("DROP", "BREAKDOWN"): 0.82,
    ("SOLO", "INTRO"): 0.82,
    ("PHRASE", "INTRO"): 0.80,
    ("OUTRO", "DROP"): 0.78,
    ("BREAKDOWN", "INTRO"): 0.78,
}

# Codes of transition intents.
INTENTS = ("Safe Phrase Blend", "Outro-Intro Blend", "Energy Relay Blend", "Breakdown Blend", "Phrase Landing Blend", "Bass Handover", "Vocal Echo Exit")


def pair_lookup(a: Column, b: Column, table: dict[tuple[str, str], float]) -> Column:
    """Value of a pair in a small fixed table, null if it has none. A map literal: no join."""
    entries = [F.lit(x) for (p, q), v in table.items() for x in (f"{p}>{q}", v)]
    return F.try_element_at(F.create_map(*entries), F.concat_ws(">", a, b))


# Scores of an ending label followed by a beginning one that EDGE_LABELS does not name.
_LEADS = ("verse", "chorus", "solo")
EDGE_RULES: tuple[Rule, ...] = (
    ({"same": (True,)}, 0.70),
    ({"out": ("outro", "inst", "break", "bridge")}, 0.72),
    ({"into": ("intro", "inst", "verse")}, 0.68),
    ({"out": _LEADS, "into": _LEADS}, 0.48),
)
EDGE_ELSE, EDGE_UNKNOWN = 0.58, 0.5
# Scores of two roles that ROLE_PAIRS does not name, by their labels (fa, fb) and by themselves (a, b).
_SUNG = ("VOCAL", "VERSE", "CHORUS")
ROLE_RULES: tuple[Rule, ...] = (
    ({"fa": ("OUTRO", "END"), "fb": ("INTRO", "START", "INST")}, 0.96),
    ({"fa": ("BREAK", "BRIDGE"), "fb": ("CHORUS", "INST")}, 0.86),
    ({"fa": ("VERSE", "CHORUS", "SOLO"), "fb": ("INTRO", "BREAK", "INST")}, 0.78),
    ({"a": _SUNG, "b": _SUNG}, 0.34),
    ({"same": (True,), "a": ("DROP", "CHORUS")}, 0.52),
)
ROLE_ELSE = 0.62
# Roles that a phrase arrives at or opens with, how fresh a drop counts, and how well keys and basses must fit.
ARRIVALS = ("DROP", "CHORUS")
OPENERS = ("INTRO", "BUILDUP", "PHRASE", "BREAKDOWN")
FRESH_DROP, FITTING_KEYS, FITTING_BASS = 0.65, 0.58, 0.50
# Scores and intents of a path of roles.
PATH_RULES: tuple[Rule, ...] = (
    ({"fresh": (True,), "opens": (True,), "arrives": (True,)}, 1.0),
    ({"a": ("BREAKDOWN", "BREAK", "BRIDGE"), "opens": (True,), "arrives": (True,)}, 0.98),
    ({"landing": ARRIVALS, "arrives": (True,)}, 0.91),
    ({"a": ("OUTRO",), "b": ("INTRO", "PHRASE", "SECTION")}, 0.96),
    ({"a": ("VOCAL", "VERSE", "CHORUS", "SOLO"), "b": ("INTRO", "PHRASE", "SECTION", "BREAKDOWN")}, 0.82),
    ({"arrives": (True,), "opens": (True,)}, 0.88),
    ({"a": _SUNG, "b": _SUNG}, 0.18),
    ({"a": ("DROP",), "b": ("DROP",)}, 0.40),
    ({"a": ("COOLDOWN", "OUTRO", "BREAKDOWN", "PHRASE"), "b": ("INTRO", "PHRASE", "SECTION")}, 0.82),
)
PATH_ELSE = 0.58
INTENT_RULES: tuple[Rule, ...] = (
    ({"landing": ARRIVALS, "arrives": (True,), "fits": (True,)}, "Bass Handover"),
    ({"fresh": (True,), "opens": (True,), "arrives": (True,)}, "Energy Relay Blend"),
    ({"a": ("BREAKDOWN", "BREAK", "BRIDGE"), "opens": (True,), "arrives": (True,)}, "Breakdown Blend"),
    ({"a": ("OUTRO",), "b": ("INTRO", "PHRASE", "SECTION")}, "Outro-Intro Blend"),
    ({"a": ("VOCAL", "VERSE", "CHORUS", "SOLO"), "b": ("INTRO", "PHRASE", "SECTION", "BREAKDOWN")}, "Vocal Echo Exit"),
    ({"arrives": (True,)}, "Phrase Landing Blend"),
)
INTENT_ELSE = "Safe Phrase Blend"


def structure_score(last_label: ColumnLike, first_label: ColumnLike) -> Column:
    out, into = col(last_label), col(first_label)
    rules = first_rule(EDGE_RULES, {"out": out, "into": into, "same": out == into}, EDGE_ELSE)
    return F.when((out == "unknown") | (into == "unknown"), EDGE_UNKNOWN).otherwise(F.coalesce(pair_lookup(out, into, EDGE_LABELS), rules))


def role_compatibility(role_a: ColumnLike, role_b: ColumnLike, function_a: ColumnLike, function_b: ColumnLike) -> Column:
    a, b, fa, fb = (F.upper(col(x)) for x in (role_a, role_b, function_a, function_b))
    return F.coalesce(pair_lookup(a, b, ROLE_PAIRS), first_rule(ROLE_RULES, {"a": a, "b": b, "fa": fa, "fb": fb, "same": a == b}, ROLE_ELSE))


def _path(role_a, landing_a, role_b, landing_b, post_drop) -> dict[str, Column]:
    return {"a": col(role_a), "b": col(role_b), "landing": col(landing_a), "arrives": col(landing_b).isin(*ARRIVALS), "opens": col(role_b).isin(*OPENERS), "fresh": col(post_drop) >= FRESH_DROP}


def role_path_score(role_a: ColumnLike, landing_a: ColumnLike, role_b: ColumnLike, landing_b: ColumnLike, post_drop: ColumnLike) -> Column:
    return first_rule(PATH_RULES, _path(role_a, landing_a, role_b, landing_b, post_drop), PATH_ELSE)


def choose_intent(role_a, landing_a, role_b, landing_b, post_drop, harmonic, bass_clean) -> Column:
    fits = (col(harmonic) >= FITTING_KEYS) & (col(bass_clean) >= FITTING_BASS)
    return first_rule(INTENT_RULES, _path(role_a, landing_a, role_b, landing_b, post_drop) | {"fits": fits}, INTENT_ELSE)


def intent_code(intent: ColumnLike) -> Column:
    return (F.array_position(F.array(*map(F.lit, INTENTS)), col(intent)) - 1).cast("int")


def recommended_styles(intent: ColumnLike) -> Column:
    """Renderings to try for an intent, best first."""
    i = col(intent)
    styles = lambda *s: F.array(*map(F.lit, s))
    return (
        F.when(i.isin("Energy Relay Blend", "Bass Handover"), styles("Bass Swap", "Short Blend", "Echo Out"))
        .when(i == "Vocal Echo Exit", styles("Echo Out", "Short Blend", "Bass Swap"))
        .otherwise(styles("Short Blend", "Bass Swap", "Echo Out"))
    )


def automix_policy(tail, always, crossfade, confidence, structure, intent, simple) -> Column:
    """Kind of transition: the first rule that holds."""
    creative = (col(confidence) >= 0.60) | ((col(structure) >= 0.72) & (col(intent) != "Safe Phrase Blend"))
    return F.when(col(tail), "tail").when(col(always), "creative").when(col(crossfade), "crossfade").when(creative, "creative").when(col(simple), "simple").otherwise("gapless")


def correlated_gains(out_gain: ColumnLike, in_gain: ColumnLike, rho: ColumnLike) -> tuple[Column, Column, Column]:
    """Both gains scaled so that correlated material does not swell, and the scale."""
    a, b, r = col(out_gain), col(in_gain), clip(rho, 0.0, 0.97)
    power = a * a + b * b
    scale = clip(F.sqrt(power / F.greatest(power + 2.0 * r * a * b, F.lit(1e-12))), 0.70, 1.0)
    return a * scale, b * scale, scale


def deadline_policy(remaining_s: ColumnLike, deadline_s: ColumnLike, reachable: ColumnLike) -> Column:
    """What to do about a next track that is not ready: simple once little is left and the plan is out of reach, urgent within the deadline."""
    left, deadline = col(remaining_s), col(deadline_s)
    # in hundredths: 0.35 of a whole number of seconds is then the nearest double, so that a tie is a tie
    late = (left <= F.greatest(F.lit(8.0), 35.0 * deadline / 100.0)) & ~col(reachable)
    return F.when(late, "simple").when(left <= deadline, "urgent").otherwise("wait")


# The styles a listener may choose, older names of them, and what model names begin with.
STYLE_MODES = ("Natural Auto", "Short Blend", "Bass Swap", "Echo Out")
STYLE_ALIASES = {"Adaptive Human": "Natural Auto", "Long Blend": "Short Blend"}
MODEL_PREFIX = "harmonix-"


def style_mode(value: ColumnLike) -> Column:
    """A style, older names renamed; null for unknown ones."""
    v = col(value)
    for old, new in STYLE_ALIASES.items():
        v = F.when(v == old, new).otherwise(v)
    return F.when(v.isin(*STYLE_MODES), v)


def model_name(value: ColumnLike) -> Column:
    """A model's name without blanks around it; null where it is empty or of another family."""
    v = F.trim(col(value))
    return F.when(v.startswith(MODEL_PREFIX), v)
