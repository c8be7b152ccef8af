"""The ordering search of one queue on arrays: the same levels as in operators.ranking, for queues that fit a task.

A frontier is a matrix of paths with one value, weakest edge and energy step per row. All continuations of a level are built,
scored and thinned out at once. m: scores[src][dst]; en: energies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Least score that counts, weight of the weakest edge, terms of the energy arc, and of the look-ahead.
FLOOR, WEAKEST = 1e-4, 0.28
FLAT, STEP_COST, STEP_SCALE, TURN, SAME, ARC_SCALE = 0.035, 0.055, 0.60, 0.075, 0.065, 0.28
FRONT, ONWARD, BEST_ROUTE, NEXT_ROUTE, BEST_STEP = 0.12, 0.52, 0.105, 0.035, 0.025
EXACT_ITEMS, POLISHED_ITEMS, LEAST_WIDTH = 10, 36, 12


def arc(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What two energy steps in a row are worth: turns are liked, runs in one direction and large changes are not."""
    before, after = np.asarray(before, dtype=float), np.asarray(after, dtype=float)
    size = np.minimum(1.0, np.minimum(np.abs(before), np.abs(after)) / ARC_SCALE)
    kind = np.where(before * after < 0, TURN, -SAME) * ((np.abs(before) >= FLAT) & (np.abs(after) >= FLAT))
    return kind * size - STEP_COST * np.minimum(1.0, np.abs(after - before) / STEP_SCALE)


def log_floor(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, FLOOR))


@dataclass
class Frontier:
    paths: np.ndarray
    value: np.ndarray
    weakest: np.ndarray
    step: np.ndarray

    def take(self, rows: np.ndarray) -> Frontier:
        return Frontier(self.paths[rows], self.value[rows], self.weakest[rows], self.step[rows])

    def order(self, *first: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
        """Rows by the given keys, the largest first, and by larger paths where those are equal; within groups if there are any."""
        keys = [*self.words()[::-1], *first[::-1]]
        return np.lexsort([-k for k in keys] + ([groups] if groups is not None else []))

    def words(self) -> list[np.ndarray]:
        """The paths as whole numbers that sort alike: as many items as fit go into one, the first words first."""
        base = int(self.paths.max()) + 1
        fit = max(1, int(62 // max(1.0, np.log2(base))))
        return [self.paths[:, i : i + fit].astype(np.int64) @ (base ** np.arange(min(fit, self.paths.shape[1] - i), dtype=np.int64)[::-1]) for i in range(0, self.paths.shape[1], fit)]

    def unused(self, n: int) -> np.ndarray:
        free = np.ones((len(self.paths), n), dtype=bool)
        free[np.arange(len(self.paths))[:, None], self.paths] = False
        return free

    def groups(self) -> np.ndarray:
        """A number per set of items used and last two items: what decides how a path can go on."""
        number = lambda x, **k: np.unique(x, return_inverse=True, **k)[1].ravel()
        width = int(self.paths.max()) + 1
        used = number(np.left_shift(np.int64(1), self.paths).sum(1)) if width < 63 else number(np.sort(self.paths, 1), axis=0)
        prev = self.paths[:, -2] if self.paths.shape[1] > 1 else 0
        return number((used * width + prev) * width + self.paths[:, -1])


def begin(start: int) -> Frontier:
    return Frontier(np.array([[start]]), np.zeros(1), np.ones(1), np.zeros(1))


def extended(f: Frontier, m: np.ndarray, en: np.ndarray) -> Frontier:
    """Each path with each item it lacks."""
    row, item = np.nonzero(f.unused(len(en)))
    last = f.paths[row, -1]
    score, step = m[last, item], en[item] - en[last]
    weakest = np.minimum(f.weakest[row], score)
    value = f.value[row] + log_floor(score) + WEAKEST * log_floor(weakest)
    if f.paths.shape[1] > 1:
        value = value + arc(f.step[row], step)
    return Frontier(np.concatenate([f.paths[row], item[:, None]], 1), value, weakest, step)


def skyline(f: Frontier) -> tuple[Frontier, np.ndarray]:
    """Of each group the paths that no other matches in value and weakest edge, and their groups."""
    groups = f.groups()
    order = f.order(f.value, f.weakest, groups=groups)
    f, groups = f.take(order), groups[order]
    rank = np.unique(f.weakest, return_inverse=True)[1].ravel() + groups * (len(groups) + 1)
    best = np.maximum.accumulate(rank)
    keep = np.append(True, rank[1:] > best[:-1])
    return f.take(np.flatnonzero(keep)), groups[keep]


def best_path(f: Frontier) -> tuple[int, ...]:
    return tuple(f.paths[f.order(f.value, f.weakest)[0]].tolist())


def exact(m, en, start: int) -> tuple[int, ...]:
    m, en = np.asarray(m, dtype=float), np.asarray(en, dtype=float)
    f = begin(start)
    for _ in range(len(en) - 1):
        f, _ = skyline(extended(f, m, en))
    return best_path(f)


def look_ahead(f: Frontier, log: np.ndarray) -> np.ndarray:
    """Optimistic worth of the next two steps of each path: its two best routes and its best single step."""
    free = f.unused(len(log))
    if not free.any():
        return np.zeros(len(free))
    step = np.where(free, log[f.paths[:, -1]], -np.inf)
    other = np.where(np.eye(len(log), dtype=bool), -np.inf, log)
    onward = np.where(free[:, None, :], other[None], -np.inf).max(2)
    route = np.sort(step + ONWARD * np.where(np.isfinite(onward), onward, step), 1)[:, ::-1]
    second = np.where(free.sum(1) > 1, route[:, min(1, route.shape[1] - 1)], route[:, 0])
    return BEST_ROUTE * route[:, 0] + NEXT_ROUTE * second + BEST_STEP * step.max(1)


def first_rows(groups: np.ndarray, most: int) -> np.ndarray:
    """Whether a row is among the first `most` of its group; rows of a group follow one another."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups)))) < most


def beam(m, en, start: int, width: int = 192) -> tuple[int, ...]:
    """At most two paths of a group and `width` in all go on, a fifth of them the best of distinct last items."""
    m, en, width = np.asarray(m, dtype=float), np.asarray(en, dtype=float), max(LEAST_WIDTH, width)
    log, f = log_floor(m), begin(start)
    for _ in range(len(en) - 1):
        f, groups = skyline(extended(f, m, en))
        order = f.order(f.value + FRONT * log_floor(f.weakest), f.weakest, groups=groups)
        f = f.take(order[first_rows(groups[order], 2)])
        f = f.take(f.order(f.value + look_ahead(f, log), f.weakest, f.value))
        leads = np.sort(np.unique(f.paths[:, -1], return_index=True)[1])[: max(1, width // 5)]
        f = f.take(np.append(leads, np.setdiff1d(np.arange(len(f.paths)), leads))[:width])
    return best_path(f)


def scored(paths: np.ndarray, m: np.ndarray, en: np.ndarray) -> Frontier:
    """Whole paths with their objective."""
    edge, step = m[paths[:, :-1], paths[:, 1:]], np.diff(en[paths], axis=1)
    weakest = np.minimum(1.0, np.minimum.accumulate(edge, 1))
    gain = log_floor(edge) + WEAKEST * log_floor(weakest)
    gain[:, 1:] += arc(step[:, :-1], step[:, 1:])
    value = np.cumsum(gain, 1)[:, -1] if gain.shape[1] else np.zeros(len(paths))
    return Frontier(paths, value, weakest[:, -1] if gain.shape[1] else np.ones(len(paths)), value)


def objective(path, m, en) -> tuple[float, float]:
    f = scored(np.array([path]), np.asarray(m, dtype=float), np.asarray(en, dtype=float))
    return float(f.value[0]), float(f.weakest[0])


def variations(path: np.ndarray) -> np.ndarray:
    """All swaps of two items and moves of one, the first item staying."""
    n = len(path)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij"))
    swapped = np.tile(np.arange(n), (len(i), 1))
    swapped[np.arange(len(i)), i], swapped[np.arange(len(i)), j] = j, i
    # the item at i goes to place j: those between shift by one
    k = np.arange(n)[None, :]
    a, b = i[:, None], j[:, None]
    moved = np.where(k == b, a, np.where((k >= a) & (k < b), k + 1, np.where((k > b) & (k <= a), k - 1, k)))
    return path[np.concatenate([swapped, moved])]


def polish(path: tuple[int, ...], m, en, passes: int = 2) -> tuple[int, ...]:
    """The best variation, as long as it is better, for paths of some tens of items."""
    m, en, best = np.asarray(m, dtype=float), np.asarray(en, dtype=float), np.array(path)
    for _ in range(passes if 1 < len(path) <= POLISHED_ITEMS else 0):
        f = scored(np.concatenate([best[None], variations(best)]), m, en)
        top = f.order(f.value, f.weakest)[0]
        if (f.value[top], f.weakest[top]) <= (f.value[0], f.weakest[0]):
            break
        best = f.paths[top]
    return tuple(best.tolist())


def order(m, en, start: int = 0) -> tuple[int, ...]:
    """Exactly up to EXACT_ITEMS items, else by beam and polish."""
    return exact(m, en, start) if len(en) <= EXACT_ITEMS else polish(beam(m, en, start), m, en)
