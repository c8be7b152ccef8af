"""A keyed stateful stream that advances along a timeline: one deck per key, commands and ticks as rows.

Rows (deck_id, seq, command, frames, arg): queue, plan, tick, seek, pause, resume, stop, next, order, auto, volume. Each command
but a tick lays out what the deck will play as a timeline of stretches: one track alone, or two of them mixed. A tick only
moves a cursor along it, so that the places after a run of ticks are one cumulated sum and one search among the ends of the
stretches. The state of a deck is one JSON string, so it survives restarts and schema changes of the code. Late plans
(another generation or index) are rejected: the analogue of late data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "deck_id long, seq long, track string, idx int, pos long, playing boolean, transitioning boolean, transition_pos long, next_pos long, generation int, consumed long, fade_left long, volume double, note string"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
FADE_FRAMES, LOUDEST = 1323, 1.25
"""Frames that fade in after a seek (30 ms at 44.1 kHz), and the largest volume."""

ALONE, MIXED = 0, 1


def lay(queue: list[dict], place: dict, plan: dict | None) -> list[list[int]]:
    """Stretches [kind, index, start, frames, start of the next track, offset in the plan, generation] from a place to the end of the queue."""
    out, pos, generation, mixed = [], place["pos"], place["generation"], place["mixed"]
    for i in range(place["index"], len(queue)):
        total, after = queue[i]["total"], queue[i + 1] if i + 1 < len(queue) else None
        if after is None or plan is None or plan["start"] > total:
            out.append([ALONE, i, pos, max(0, total - pos), 0, 0, generation])
            enter = after.get("cue", 0) if after else 0
        else:
            begin = max(pos, plan["start"])
            if not mixed:
                out.append([ALONE, i, pos, begin - pos, 0, 0, generation])
            offset = begin - plan["start"]
            other = plan["next_start"] + offset
            n = max(0, min(plan["length"] - offset, total - begin, after["total"] - other))
            out.append([MIXED, i, begin, n, other, offset, generation])
            enter = plan["resume"] if plan.get("resume", -1) >= 0 else other + n
        if after:
            pos = max(0, min(enter, after["total"] - 1))
        plan, mixed, generation = None, False, generation + 1
    return out


class Timeline:
    """Stretches with the frames at which they end. A track's last frame alone belongs to it, that of a mix to the next track."""

    def __init__(self, stretches: list[list[int]]):
        self.rows = np.array(stretches, dtype=np.int64).reshape(-1, 7)
        self.ends = np.cumsum(self.rows[:, 3])
        self.keys = np.maximum.accumulate(2 * self.ends + (self.rows[:, 0] == ALONE))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def places(self, at: np.ndarray) -> list[dict]:
        """Where the cursor is after so many frames."""
        which = np.minimum(np.searchsorted(self.keys, 2 * at, "right"), len(self.rows) - 1)
        inside = at - (self.ends - self.rows[:, 3])[which]
        return [
            {"index": int(r[1]), "pos": int(r[2] + k), "mixed": bool(r[0] == MIXED), "next": int(r[4] + k) if r[0] == MIXED else 0, "offset": int(r[5] + k) if r[0] == MIXED else 0, "generation": int(r[6])}
            for r, k in zip(self.rows[which], inside, strict=True)
        ]


def fresh(generation: int = 0, queue: list[dict] | None = None) -> dict:
    return {"queue": queue or [], "lane": [], "at": 0, "plan": None, "skip": False, "auto": True, "playing": False, "paused": False, "generation": generation, "fade": 0, "volume": 1.0}


def place_of(s: dict) -> dict:
    if not s["lane"]:
        return {"index": 0, "pos": 0, "mixed": False, "next": 0, "offset": 0, "generation": s["generation"]}
    return Timeline(s["lane"]).places(np.array([s["at"]]))[0]


def _lay(s: dict, place: dict) -> None:
    """A new timeline from the place; a plan counts for the track it was made for."""
    plan = s["plan"] if s["plan"] and s["plan"]["index"] == place["index"] else None
    used = plan if place["mixed"] or s["auto"] and not s["skip"] else None
    s.update(plan=plan, at=0, lane=lay(s["queue"], place, used))


def nearest_beat(track: dict, target: int) -> int:
    """The nearest point of the track's grid (`beats`, or every `beat` frames), the earlier of two."""
    grid = np.array(track.get("beats") or [], dtype=np.int64)
    if not len(grid) and track.get("beat"):
        grid = np.arange(0, track["total"], track["beat"])
    return int(grid[np.abs(grid - target).argmin()]) if len(grid) else target


def ticks(s: dict, frames: np.ndarray) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """Moves the cursor by each of frames in turn: places, frames consumed, whether the deck plays, and the fade left."""
    line = Timeline(s["lane"])
    if not s["playing"] or s["paused"] or not len(line.rows):
        n = len(frames)
        return [place_of(s)] * n, np.zeros(n, dtype=np.int64), np.full(n, s["playing"] and bool(s["lane"])), np.full(n, s["fade"])
    wanted = s["at"] + np.cumsum(frames)
    at = np.minimum(wanted, len(line))
    plays = wanted <= len(line)
    consumed = np.diff(at, prepend=s["at"])
    fade = np.maximum(0, s["fade"] - np.cumsum(consumed))
    s.update(at=int(at[-1]), playing=bool(plays[-1]), fade=int(fade[-1]))
    return line.places(at), consumed, plays, fade


def apply(s: dict, command: str, frames: int, arg: str) -> str:
    """Changes the state by one command other than a tick; returns a note."""
    here = place_of(s)
    if command == "queue":
        s.update(fresh(s["generation"], json.loads(arg)), volume=s["volume"], auto=s["auto"], playing=True)
        _lay(s, here | {"index": 0, "pos": 0, "mixed": False, "generation": here["generation"] + 1})
        s["generation"] = here["generation"] + 1
        return "started"
    if command == "plan":
        p = json.loads(arg)
        if p.get("generation") != here["generation"] or p.get("index") != here["index"] or not s["playing"]:
            return "late plan rejected"
        s["plan"] = p
        _lay(s, here)
        return "plan installed"
    if command == "seek":
        return _seek(s, here, frames)
    if command == "order":
        return _order(s, here, json.loads(arg))
    if command == "next":
        if not s["plan"] or s["plan"]["index"] != here["index"] or here["mixed"]:
            return "no plan"
        s.update(plan=s["plan"] | {"start": here["pos"]}, auto=True)
        _lay(s, here)
        return "next requested"
    if command == "auto":
        s["auto"] = bool(frames)
        _lay(s, here)
        return "auto " + ("on" if frames else "off")
    if command == "volume":
        s["volume"] = min(max(float(arg), 0.0), LOUDEST)
        return "volume"
    if command in ("pause", "resume"):
        s["paused"] = command == "pause"
        s["playing"] = s["playing"] or (command == "resume" and bool(s["lane"]))
        return command
    if command == "stop":
        s.update(fresh(here["generation"] + 1), volume=s["volume"])
        return "stopped"
    return f"unknown command {command}"


def _seek(s: dict, here: dict, target: int) -> str:
    if not s["lane"]:
        return "nothing to seek"
    track = s["queue"][here["index"]]
    target = nearest_beat(track, max(0, min(target, track["total"] - 1)))
    plan, note = s["plan"], "sought"
    offset = target - plan["start"] if plan and plan["index"] == here["index"] and here["index"] + 1 < len(s["queue"]) else -1
    mixed = 0 <= offset < (plan["length"] if plan else 0)
    past = offset >= 0 and not mixed
    s.update(skip=past, fade=FADE_FRAMES)
    _lay(s, here | {"pos": target, "mixed": mixed})
    return "resumed inside the transition" if mixed else "past the transition" if past else note


def _order(s: dict, here: dict, ids: list[str]) -> str:
    known = {t["id"]: t for t in s["queue"]}
    wanted = [known[i] for i in ids if i in known]
    if not s["lane"] or not s["playing"]:
        s.update(queue=wanted, lane=[], at=0, plan=None, generation=here["generation"])
        return "order taken"
    now, after = ([t["id"] for t in s["queue"]] + [None])[here["index"] : here["index"] + 2]
    if now not in ids:
        return "error: the current track is missing"
    i = ids.index(now)
    changed = (ids + [None])[i + 1] != after and not here["mixed"]
    plan = s["plan"] if s["plan"] and s["plan"]["index"] == here["index"] and not changed else None
    s.update(queue=wanted, skip=False, plan=plan and plan | {"index": i})
    _lay(s, here | {"index": i, "generation": here["generation"] + 1})
    return "next invalidated" if changed else "order taken"


def deadline_policy(remaining_s: float, deadline_s: float, reachable: bool) -> str:
    """simple once the rest is at most max(8, 0.35*deadline) seconds and the plan is out of reach; urgent within the deadline."""
    if remaining_s <= max(8.0, 35.0 * deadline_s / 100.0) and not reachable:
        return "simple"
    return "urgent" if remaining_s <= deadline_s else "wait"


def rows_of(key: int, s: dict, pdf: pd.DataFrame) -> pd.DataFrame:
    """One status row per row of pdf, in order of seq; runs of ticks move the cursor together."""
    pdf = pdf.sort_values("seq", kind="stable")
    command, seq, arg = pdf["command"].to_numpy(), pdf["seq"].to_numpy(), pdf["arg"].fillna("").to_numpy()
    frames = pdf["frames"].fillna(0).to_numpy().astype(np.int64)
    tick = command == "tick"
    starts = np.flatnonzero(np.append(True, ~tick[1:] | (tick[1:] != tick[:-1]))) if len(pdf) else np.array([], dtype=int)
    out = []
    for a, z in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
        if tick[a]:
            places, consumed, plays, fade = ticks(s, frames[a:z])
            note = ""
        else:
            note = apply(s, command[a], int(frames[a]), arg[a])
            places, consumed, plays, fade = [place_of(s)], [0], [s["playing"]], [s["fade"]]
        for k, p in enumerate(places):
            name = s["queue"][p["index"]]["id"] if s["lane"] and p["index"] < len(s["queue"]) else None
            out.append((key, seq[a + k], name, p["index"], p["pos"], bool(plays[k]), p["mixed"], p["offset"], p["next"], p["generation"], int(consumed[k]), int(fade[k]), s["volume"], note))
    return pd.DataFrame(out, columns=NAMES)


def _processor():
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Deck(StatefulProcessor):
        """The JSON of a deck in a value state of its key."""

        def init(self, handle) -> None:
            self.state = handle.getValueState("deck", "deck string")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            s = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
            out = rows_of(key[0], s, pd.concat(list(rows)))
            self.state.update((json.dumps(s),))
            yield out

        def close(self) -> None:
            pass

    return Deck()


def stream(commands: DataFrame) -> DataFrame:
    """Streaming rows in, one status row out per command; state per deck in a RocksDB state store."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return commands.groupBy("deck_id").transformWithStateInPandas(_processor(), OUTPUT, "Append", "None")


def replay(commands: DataFrame) -> DataFrame:
    """The same over a finished log."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return rows_of(key[0], fresh(), pdf)

    return commands.groupBy("deck_id").applyInPandas(run, OUTPUT)


def status_sink(status: DataFrame, path: str, checkpoint: str):
    """Appends status rows as Parquet, exactly once per micro-batch."""
    return status.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_levels(samples: DataFrame, size: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """RMS per sliding window of event time; rows later than the watermark are dropped. samples (track_id, ts, v)."""
    return samples.withWatermark("ts", late).groupBy("track_id", F.window("ts", size, slide)).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("n"))
