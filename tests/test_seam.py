"""Seams against a maximum flow by augmenting paths, and the whole crossfade against NumPy."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest

from gridloom.operators import seam


def brute_cut(cost: np.ndarray) -> tuple[list[int], int]:
    """First time on the sink side of each frequency, and the flow, by breadth-first augmenting paths."""
    v = cost - cost.min()
    v = v / v.max() if v.max() > 1e-12 else v
    n_f, n_t = v.shape
    room: dict = {}
    for f in range(n_f):
        for t in range(n_t):
            if t + 1 < n_t:
                c = 1 + int(2200.0 * (v[f, t] + v[f, t + 1]) / 2.0)
                room[(f, t), (f, t + 1)] = room[(f, t + 1), (f, t)] = c
            if f + 1 < n_f:
                c = 40 + int(3100.0 * (v[f, t] + v[f + 1, t]) / 2.0)
                room[(f, t), (f + 1, t)] = room[(f + 1, t), (f, t)] = c
    near: dict = {}
    for a, b in room:
        near.setdefault(a, []).append(b)
    flow = 0
    while True:
        came, todo = {(f, 0): None for f in range(n_f)}, deque((f, 0) for f in range(n_f))
        end = None
        while todo and end is None:
            a = todo.popleft()
            for b in near[a]:
                if b not in came and room[a, b] > 0:
                    came[b] = a
                    if b[1] == n_t - 1:
                        end = b
                        break
                    todo.append(b)
        if end is None:
            return [min(t for t in range(n_t) if (f, t) not in came) for f in range(n_f)], flow
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        edges = list(zip(path[1:], path, strict=False))
        some = min(room[e] for e in edges)
        for a, b in edges:
            room[a, b] -= some
            room[b, a] += some
        flow += some


def test_least_cuts_equal_maximum_flow(spark):
    rng = np.random.default_rng(5)
    grids = [rng.random((6, 9)), rng.random((2, 2)), rng.random((7, 4)), np.zeros((4, 5)), np.round(rng.random((8, 8)) * 3), np.ones((3, 6)), rng.random((12, 20)) ** 3]
    # a wall with one gap forces the seam to turn back upwards
    wall = np.ones((9, 12))
    wall[4, :10] = 0.0
    wall[1:8, 9] = 0.0
    wall[1, 3:10] = 0.0
    wall[0:2, 3] = 0.0
    wall[7, 2:10] = 0.0
    wall[7:, 2] = 0.0
    grids.append(wall)
    rows = [(p, f, t, float(g[f, t])) for p, g in enumerate(grids) for f in range(g.shape[0]) for t in range(g.shape[1])]
    got: dict = {}
    for r in seam.least_cuts(spark.createDataFrame(rows, "pair_id long, f long, t long, cost double")).collect():
        got.setdefault(r.pair_id, {})[r.f] = (r.seam, r.flow)
    for p, g in enumerate(grids):
        want, flow = brute_cut(g)
        assert [got[p][f][0] for f in range(g.shape[0])] == want and {x[1] for x in got[p].values()} == {flow}, p


def test_whole_grid(spark):
    g = np.random.default_rng(7).random((seam.GRID_BINS, seam.GRID_FRAMES))
    rows = [(0, f, t, float(g[f, t])) for f in range(g.shape[0]) for t in range(g.shape[1])]
    got = sorted((r.f, r.seam, r.flow) for r in seam.least_cuts(spark.createDataFrame(rows, "pair_id long, f long, t long, cost double")).collect())
    # an upper bound: the best straight column, and any single path that only goes down
    assert [f for f, *_ in got] == list(range(seam.GRID_BINS)) and len({x[2] for x in got}) == 1
    v = (g - g.min()) / (g.max() - g.min())
    straight = min(sum(1 + int(2200.0 * (v[f, t] + v[f, t + 1]) / 2.0) for f in range(g.shape[0])) for t in range(g.shape[1] - 1))
    assert 0 < got[0][2] <= straight


def zoomed(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    for axis, m in enumerate(shape):
        n = x.shape[axis]
        at = np.arange(m) * ((n - 1) / max(m - 1, 1))
        low = np.minimum(np.floor(at).astype(int), n - 1)
        w = (at - low).reshape([-1 if a == axis else 1 for a in range(2)])
        x = np.take(x, low, axis) * (1 - w) + np.take(x, np.minimum(low + 1, n - 1), axis) * w
    return x


@pytest.mark.parametrize(("size", "hop", "n"), [(32, 8, 100), (32, 2, 300), (16, 4, 20)])
def test_crossfade_equals_numpy(spark, size, hop, n):
    rng = np.random.default_rng(n)
    a, b, rate = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n + 7), 1000.0
    rows = [(0, i, float(v)) for i, v in enumerate(a)] + [(1, i, float(v)) for i, v in enumerate(b)]
    y, s = seam.seam_crossfade(spark.createDataFrame([(0, 0, 1)], "pair_id long, a_track long, b_track long"), spark.createDataFrame(rows, "track_id long, i long, x double"), size, hop, rate)
    got = np.array([r.x for r in sorted(y.collect(), key=lambda r: r.i)])
    found = s.collect()[0]
    b = b[:n]
    if n < 2 * size:
        p = np.linspace(0, np.pi / 2, n)
        assert np.allclose(got, a * np.cos(p) + b * np.sin(p)) and (found.flow, found.seam_std) == (0.0, 0.0) and found.seam_mean == pytest.approx(n / rate / 2)
        return
    w = np.hanning(size + 1)[:-1]
    stft = lambda x: np.array([np.fft.rfft(np.pad(x, size)[f * hop + size // 2 : f * hop + size // 2 + size] * w) for f in range(n // hop + 1)]).T
    za, zb = stft(a), stft(b)

    def db(z):
        m = np.maximum(np.abs(z) + 1e-7, 1e-5)
        return np.maximum(20 * np.log10(m) - 20 * np.log10(m.max()), -80)

    full = np.abs(db(za) - db(zb))
    grid = zoomed(full, (min(seam.GRID_BINS, full.shape[0]), min(seam.GRID_FRAMES, full.shape[1])))
    raw, flow = brute_cut(grid)
    raw = np.array(raw, float)
    mid = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(raw, 2, mode="edge"), 5), axis=1)
    bell = np.exp(-0.5 * (np.arange(-4, 5) / 1.1) ** 2)
    soft = np.lib.stride_tricks.sliding_window_view(np.pad(mid, 4, mode="edge"), 9) @ (bell / bell.sum())
    at = np.interp(np.linspace(0, 1, full.shape[0]), np.linspace(0, 1, len(soft)), soft) * (full.shape[1] - 1) / max(grid.shape[1] - 1, 1)
    t = np.arange(full.shape[1])[None, :]
    p = np.clip(0.78 * (0.5 + 0.5 * np.tanh((t - at[:, None]) / max(1.3, full.shape[1] * 0.014))) + 0.22 * np.linspace(0, 1, full.shape[1])[None, :], 0, 1)
    p[:, 0], p[:, -1] = 0, 1
    z = za * np.cos(p * np.pi / 2) + zb * np.sin(p * np.pi / 2)
    num, den = np.zeros(n + 2 * size), np.zeros(n + 2 * size)
    for f in range(z.shape[1]):
        num[f * hop + size // 2 : f * hop + size // 2 + size] += np.fft.irfft(z[:, f], size) * w
        den[f * hop + size // 2 : f * hop + size // 2 + size] += w * w
    num, den = num[size : size + n], den[size : size + n]
    want = np.where(den > 1e-9, num / np.where(den > 1e-9, den, 1), num)
    edge = min(n // 8, max(32, int(0.012 * rate)))
    fade = np.linspace(0, 1, edge)
    want[:edge] = a[:edge] * (1 - fade) + want[:edge] * fade
    want[-edge:] = want[-edge:] * (1 - fade) + b[-edge:] * fade
    peak = np.abs(want).max() + 1e-9
    want = want * (0.98 / peak) if peak > 0.98 else want
    assert found.flow == flow and np.allclose(got, want, atol=1e-9)
    assert found.seam_mean == pytest.approx((at * hop / rate).mean()) and found.seam_std == pytest.approx((at * hop / rate).std())
