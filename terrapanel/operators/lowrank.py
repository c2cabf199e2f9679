"""Two-way low-rank fits of panels with gaps, from few rows that stand for all paths.

A pass fills the gaps of every path from the fit before and fits levels, time effects and directions anew. For a fixed pattern of
gaps every fit is an affine map of the observed cells, so a frequent pattern needs no more than the Gram matrix of its paths (with a
constant): its factor has at most t + 1 rows, and passes work on these and on the paths of rare patterns alike. One job gathers them;
a pass then costs rows x t x (t + directions). Rows beyond a bound of memory are replayed from the passes so far: each pass then adds
their sums by one job for all fits at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of statistics that the driver holds for one set of fits, and bytes of rows of patterns beyond them.
MOST_BYTES, MOST_ROW_BYTES = 64 << 20, 128 << 20
#: Rows whose passes are replayed together, so that they stay in the cache.
REPLAYED = 1024


@dataclass(frozen=True)
class Fit:
    """Time effects (sum zero) and directions (columns, orthonormal, sum zero) with the share of each that is kept.

    ``first`` has the effects of the additive fit that the passes start from, ``history`` what each pass before gave.
    """

    effect: np.ndarray
    basis: np.ndarray
    weights: np.ndarray
    first: np.ndarray | None = None
    history: tuple[Fit, ...] = ()

    @property
    def projection(self) -> np.ndarray:
        return (self.basis * self.weights) @ self.basis.T

    def design(self) -> tuple[np.ndarray, np.ndarray]:
        """Orthonormal columns of level and directions, and the share of each."""
        t = len(self.effect)
        return np.column_stack([np.full(t, t**-0.5), self.basis]), np.concatenate([[1.0], self.weights])


@dataclass
class Statistics:
    """Rows (constant, cells) whose products sum to those of all paths, and what is seen of them; cells not observed are 0."""

    seen: np.ndarray
    constant: np.ndarray
    cells: np.ndarray


@dataclass
class Paths:
    """What is known of a key's paths: rows with weights, and matrices of each pattern and weight over (constant, cells)."""

    seen: np.ndarray
    cells: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    #: (patterns, weights, upper triangle) of order t + 1.
    products: np.ndarray

    def place(self, j: int, t: int) -> Statistics:
        """Rows of weight j over the first t periods."""
        w, size = self.weights[:, j], self.seen.shape[1] + 1
        root, upper = np.sqrt(w[w > 0]), np.triu_indices(size)
        parts = [(self.seen[w > 0], root, self.cells[w > 0] * root[:, None])]
        for pattern, product in zip(self.patterns, self.products[:, j], strict=True):
            full = np.zeros((size, size))
            full[upper] = product
            values, vectors = np.linalg.eigh(full + np.triu(full, 1).T)
            kept = values > max(values[-1], 0) * 1e-15
            rows = (vectors[:, kept] * np.sqrt(values[kept])).T
            parts.append((np.tile(pattern, (len(rows), 1)), rows[:, 0], rows[:, 1:] * pattern))
        seen, constant, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Statistics(seen[:, :t], constant, cells[:, :t])


def matrix(column: Iterable, t: int) -> np.ndarray:
    """Paths as rows, gaps as NaN."""
    # Arrays come from Arrow with NaN for null, and numpy takes None for NaN: no cell is looked at here.
    return np.array([np.asarray(y, float) for y in column], float).reshape(-1, t)


def distinct(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The patterns among rows of booleans, and which one each row has."""
    bits = np.packbits(seen, axis=1)
    _, at, which = np.unique(bits.view(f"V{bits.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    return seen[at], which.reshape(-1)


def fitted(ys: np.ndarray, fit: Fit) -> np.ndarray:
    """Time effect, level and directions of each row, with loadings fitted to what is seen of it.

    Loadings b solve b (X_O'X_O + 1/d - 1) = g_O X_O for the deviations g from the time effects; where too few cells are seen, they
    are the shortest ones that do.
    """
    x, share = fit.design()
    seen = np.isfinite(ys)
    patterns, which = distinct(seen)
    o = patterns.astype(float)
    k = np.einsum("mt,ta,tb->mab", o, x, x, optimize=True) + np.diag(1 / share - 1)
    loads, g = np.linalg.pinv(k, hermitian=True), np.where(seen, ys - fit.effect, 0.0) @ x
    return fit.effect + np.einsum("na,nab->nb", g, loads[which], optimize=True) @ x.T


def _start(s: Statistics, first: np.ndarray) -> np.ndarray:
    """The additive fit of each row: time effect and the mean of what is seen beside it."""
    left = np.where(s.seen, s.cells - s.constant[:, None] * first, 0.0).sum(1) / np.maximum(s.seen.sum(1), 1)
    return s.constant[:, None] * first + left[:, None]


def _refitted(s: Statistics, full: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Rows fitted anew after their gaps are taken from ``full``, and their loadings."""
    done = np.where(s.seen, s.cells, full)
    level, effect = done.mean(1, keepdims=True), s.constant[:, None] * fit.effect
    loads = ((done - effect) @ fit.basis) * fit.weights
    return level + effect + loads @ fit.basis.T, loads


def complete(ys: np.ndarray, fit: Fit) -> np.ndarray:
    """Rows with their gaps as the passes of the fit left them."""
    out = np.array(ys)
    gaps = np.flatnonzero(~np.isfinite(ys).all(1))
    for at in range(0, len(gaps), REPLAYED):
        rows = gaps[at : at + REPLAYED]
        seen = np.isfinite(ys[rows])
        s = Statistics(seen, np.ones(len(rows)), np.where(seen, ys[rows], 0.0))
        full = _start(s, fit.first)
        for step in (*fit.history, fit):
            full = _refitted(s, full, step)[0]
        out[rows] = np.where(seen, ys[rows], full)
    return out


def _moments(s: Statistics, full: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, sum and Gram matrix of completed paths."""
    done = np.where(s.seen, s.cells, full)
    return float(s.constant @ s.constant), s.constant @ done, done.T @ done


def _size(v: np.ndarray) -> float:
    """Sum of squares over all paths."""
    return float(np.vdot(v, v))


def _apart(one: tuple, other: tuple | None = None) -> float:
    """Sum of squares of a b' of the first, or of its difference from the other's, by the triangular factor of both b."""
    (a, b), (c, d) = one, other or (one[0][:, :0], None if one[1] is None else one[1][:, :0])
    if b is None:
        return _size(a - c if other else a)
    return _size(np.column_stack([a, -c]) @ np.linalg.qr(np.column_stack([b, d]), mode="r").T)


def _normal(s: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the periods' effects, which the unit means have left."""
    o = s.seen.astype(float)
    share, n = o / np.maximum(o.sum(1, keepdims=True), 1), s.constant**2
    return np.diag(n @ o) - (o * n[:, None]).T @ share, s.constant @ s.cells - (s.constant * s.cells.sum(1)) @ share


def _additive(s: Statistics) -> np.ndarray:
    """Time effects of the two-way additive fit: unit means leave the normal equations of the periods, which are solved at once."""
    effect = np.linalg.lstsq(*_normal(s), rcond=1e-12)[0] if s.seen.shape[1] else np.zeros(0)
    return effect - effect.mean()


def _centred(n: float, total: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time effects and Gram matrix of the deviations from them and from the levels, of completed paths."""
    mean = total / max(n, 1e-300)
    spread = gram - n * np.outer(mean, mean)
    spread = spread - spread.mean(0)
    spread = spread - spread.mean(1, keepdims=True)
    return mean - mean.mean(), (spread + spread.T) / 2


def _directions(spread: np.ndarray, rank: int, soft: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The directions that are kept of a Gram matrix, and the share of each."""
    w, v = np.linalg.eigh(spread)
    size, t = np.sqrt(np.maximum(w, 0)), len(w)
    keep = np.arange(t) >= t - rank if soft is None else size > soft
    return v[:, keep], np.ones(int(keep.sum())) if soft is None else 1 - soft / size[keep]


class _Run:
    """One fit on its way: a pass takes the moments of all completed paths.

    Every second pass is followed by a squared extrapolation of the rows' fits, which is taken back where the observed cells are then
    fitted worse; such a fit keeps no history.
    """

    fast = True

    def __init__(self, s: Statistics, rank: int, soft: float | None, tol: float):
        self.s, self.rank, self.soft, self.tol = s, rank, soft, tol
        first = _additive(s)
        t = s.seen.shape[1]
        self.fit = Fit(first, np.zeros((t, 0)), np.zeros(0), first)
        self.low: tuple[np.ndarray, np.ndarray] | None = None
        self.passes, self.held, self.back = 0, [], None
        self._begin()

    def _begin(self) -> None:
        self.full = _start(self.s, self.fit.first)

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        return _moments(self.s, self.full)

    def _refit(self) -> None:
        self.full, loads = _refitted(self.s, self.full, self.fit)
        self.low = loads, self.fit.basis

    def _state(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The rows' fits, or factors whose product they are: a and b of a b'."""
        return self.full, None

    def advance(self, n: float, total: np.ndarray, gram: np.ndarray) -> bool:
        """One pass; whether it is known to change the fit (and its directions' part) by no more than the tolerance."""
        effect, spread = _centred(n, total, gram)
        past = (*self.fit.history, self.fit) if self.passes and not self.fast else ()
        self.fit = Fit(effect, *_directions(spread, self.rank, self.soft), self.fit.first, past)
        state, low = self._state(), self.low
        self._refit()
        self.passes += 1
        if self.fast and self.passes % 3 == 1:
            self._take_back()
        checked = self.passes % 3 == 2 if self.fast else self.passes % 4 == 0 or not self.rank and self.soft is None
        settled = checked and self._change(state, low) <= self.tol
        if self.fast and not settled:
            self.held.append(self.full)
            if self.passes % 3 == 0:
                self._extrapolate()
        return settled

    def _change(self, state: tuple, low: tuple | None) -> float:
        change = (_apart(self._state(), state) / max(_apart(state), 1e-300)) ** 0.5
        if self.soft is None and self.rank:
            before = _size(low[0]) if low else 0.0
            if not low:
                return np.inf
            if before > 1e-20:
                change = max(change, (_apart(self.low, low) / before) ** 0.5)
        return change

    def _misfit(self) -> float:
        misfit = _size(np.where(self.s.seen, self.s.cells - self.full, 0.0))
        if self.soft is not None and self.fit.basis.shape[1]:
            loads = self.low[0]
            misfit += 2 * self.soft * float(np.sqrt(np.maximum(np.linalg.eigvalsh(loads.T @ loads), 0)).sum())
        return misfit

    def _extrapolate(self) -> None:
        f0, f1, f2 = self.held
        step, turn = f1 - f0, f2 - 2 * f1 + f0
        by = (_size(step) / max(_size(turn), 1e-300)) ** 0.5
        self.held, self.back = [], None
        if by > 1:
            self.back = (f2, self._misfit(), self.fit, self.low)
            self.full = f0 + 2 * by * step + by * by * turn

    def _take_back(self) -> None:
        if self.back and not self._misfit() <= self.back[1]:
            self.full, _, self.fit, self.low = self.back
        self.back = None


class _Steady(_Run):
    """Passes without extrapolation, which keep their history.

    The rows' fits are u z: a row of u has its constant, level and loadings, z the time effects, ones and directions. Rows of one
    pattern have their gaps in the same periods, so that their part of the Gram matrix needs no more than u'u and u'cells, and their
    gaps' part of new loadings is u times a small matrix. Rows of patterns with fewer than ``few`` rows come last and are completed.
    """

    fast, few = False, 16

    def _begin(self) -> None:
        s, first = self.s, self.fit.first
        patterns, which = distinct(s.seen)
        count = np.bincount(which, minlength=len(patterns))
        rank = np.argsort(np.argsort(count < self.few, kind="stable"))
        order = np.argsort(rank[which], kind="stable")
        self.s = s = Statistics(s.seen[order], s.constant[order], s.cells[order])
        often = count >= self.few
        ends = np.cumsum(count[often]).tolist()
        self.gap, self.runs, self.often = (~patterns[often]).astype(float), list(zip([0, *ends], ends, strict=False)), int(count[often].sum())
        self.n, self.total, self.gram = float(s.constant @ s.constant), s.constant @ s.cells, s.cells.T @ s.cells
        left = (s.cells.sum(1) - s.constant * (s.seen @ first)) / np.maximum(s.seen.sum(1), 1)
        self._keep(np.column_stack([s.constant, left]), np.array([first, np.ones(len(first))]))

    def _keep(self, u: np.ndarray, z: np.ndarray) -> None:
        self.u, self.z = u, z
        # From here on rows are completed one by one: all of them where patterns have too few rows for so many directions.
        self.at = self.often if 2 * len(self.gap) * len(z) <= self.often else 0
        self.filled = np.where(self.s.seen[self.at :], 0.0, u[self.at :] @ z)
        self.gaps = z * self.gap[:, None, :] if self.at else None

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        u, cells, at, (k, t) = self.u, self.s.cells, self.at, self.z.shape
        total, half = self.total + u[at:, 0] @ self.filled, self.filled.T @ (cells[at:] + self.filled / 2)
        if at:
            mixed, own = np.empty((len(self.gaps), k, t)), np.empty((len(self.gaps), k, k))
            for (a, b), x, y in zip(self.runs, mixed, own, strict=True):
                turned = u[a:b].T
                np.matmul(turned, cells[a:b], out=x)
                np.matmul(turned, u[a:b], out=y)
            total = total + np.einsum("pk,pkt->t", own[:, 0], self.gaps)
            half = half + self.gaps.reshape(-1, t).T @ (mixed + own @ self.gaps / 2).reshape(-1, t)
        return self.n, total, self.gram + half + half.T

    def _refit(self) -> None:
        s, fit, at = self.s, self.fit, self.at
        t = len(fit.effect)
        to = np.column_stack([np.full(t, 1 / t), fit.basis])
        new = s.cells @ to
        new[at:] += self.filled @ to
        if at:
            for (a, b), by in zip(self.runs, self.gaps @ to, strict=True):
                new[a:b] += self.u[a:b] @ by
        loads = (new[:, 1:] - s.constant[:, None] * (fit.effect @ fit.basis)) * fit.weights
        self.low = loads, fit.basis
        self._keep(np.column_stack([s.constant, new[:, 0], loads]), np.vstack([fit.effect, np.ones(t), fit.basis.T]))

    def _state(self):
        return self.u, self.z.T


def loading(seen: np.ndarray, fit: Fit) -> np.ndarray:
    """For each pattern the matrix that turns X_O'g_O into loadings; see ``fitted``. Scaled by the shares, so that small ones do no harm."""
    x, share = fit.design()
    root = np.sqrt(share)
    k = (seen[:, None, :] * x.T) @ x * np.outer(root, root) + np.diag(1 - share)
    solved = np.linalg.inv(k) if (share[1:] < 1).all() and seen.any(1).all() else np.linalg.pinv(k, hermitian=True)
    return solved * np.outer(root, root)


class LeftOut:
    """Settled fits under a threshold without one path each, of rows and matrices of patterns.

    Completed paths give time effects and a Gram matrix, these give the fit, and the fit completes the paths, with loadings solved for
    what is seen. Where a round changes nothing the passes settle too, and as the problem is convex there is one such fit. Rounds are
    mixed (Anderson) until effects and matrix change by no more than the tolerance: one path changes the fit by a share of one over
    their number, which a loose tolerance would hide. A fit without directions is the additive one, which is solved at once.
    """

    mixed = 6

    def __init__(self, known: Paths, t: int, soft: float, rounds: int = 5000, tol: float = 1e-11):
        s, root = known.place(0, t), np.sqrt(known.weights[:, 0])
        self.t, self.soft, self.rounds, self.tol, self.normal = t, soft, rounds, tol, _normal(s)
        self.inverse = np.linalg.pinv(self.normal[0], rcond=1e-12, hermitian=True)
        self.n, self.total, self.gram = float(s.constant @ s.constant), s.constant @ s.cells, s.cells.T @ s.cells
        gappy, some, upper = ~known.seen.all(1) & (root > 0), ~known.patterns.all(1), np.triu_indices(t + 1)
        self.rows = s = Statistics(known.seen[gappy], root[gappy], known.cells[gappy] * root[gappy, None])
        patterns, self.which = distinct(s.seen) if len(s.seen) else (s.seen, np.zeros(0, int))
        self.patterns, self.seen = patterns.astype(float), known.patterns[some].astype(float)
        products = np.zeros((len(self.seen), t + 1, t + 1))
        products[:, *upper] = known.products[some, 0]
        self.products = products + np.triu(products, 1).transpose(0, 2, 1)
        # Without directions (constant, sum of what is seen) is all that a row gives to its gaps: rare patterns are summed up too.
        few = np.column_stack([s.constant, s.cells.sum(1) * t**-0.5])
        turned, own = np.zeros((len(patterns), t + 1, 2)), np.zeros((len(patterns), 2, 2))
        np.add.at(turned, self.which, np.column_stack([s.constant, s.cells])[:, :, None] * few[:, None, :])
        np.add.at(own, self.which, few[:, :, None] * few[:, None, :])
        often = self._turned(np.full((t, 1), t**-0.5))
        # Rounding of the cells' squares, which paths without any spread leave, is no change.
        self.least = 0.01 * float(np.trace(self.gram)) / max(self.n * t, 1)
        self.level = np.concatenate([self.seen, self.patterns]), np.concatenate([often[0], turned]), np.concatenate([often[1], own])
        self.whole = self._settled(None, None)
        self.begin = self._moments(self.whole)

    def _turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of (constant, cells) of each pattern with (constant, X_O), and of these with themselves."""
        w = np.zeros((len(self.seen), self.t + 1, x.shape[1] + 1))
        w[:, 0, 0], w[:, 1:, 1:] = 1, self.seen[:, :, None] * x
        turned = self.products @ w
        return turned, w.transpose(0, 2, 1) @ turned

    def _moments(self, fit: Fit) -> tuple[float, np.ndarray, np.ndarray]:
        """Weight, sum and Gram matrix of all paths, completed by the fit."""
        x, total, half = fit.design()[0], self.total, np.zeros_like(self.gram)
        if x.shape[1] > 1:
            s, by = self.rows, loading(self.patterns, fit)[self.which]
            left = np.where(s.seen, s.cells - s.constant[:, None] * fit.effect, 0.0) @ x
            fill = np.where(s.seen, 0.0, s.constant[:, None] * fit.effect + (left[:, None, :] @ by)[:, 0] @ x.T)
            total, half = total + s.constant @ fill, fill.T @ (s.cells + fill / 2)
        seen, turned, own = self.level if x.shape[1] == 1 else (self.seen, *self._turned(x))
        # A gap is (constant, X_O'y_O) times a small matrix.
        each = loading(seen, fit) @ x.T
        first = fit.effect - (((seen * fit.effect) @ x)[:, None, :] @ each)[:, 0]
        at = np.concatenate([first[:, None, :], each], 1) * (1 - seen)[:, None, :]
        mixed = turned[:, 1:].transpose(0, 2, 1) + own @ at / 2
        total = total + turned[:, 0].reshape(-1) @ at.reshape(-1, self.t)
        half = half + at.reshape(-1, self.t).T @ mixed.reshape(-1, self.t)
        return self.n, total, self.gram + half + half.T

    def _without(self, moments: tuple, y: np.ndarray | None, fit: Fit) -> tuple[float, np.ndarray, np.ndarray]:
        if y is None:
            return moments
        seen, (x, _) = np.isfinite(y), fit.design()
        g = np.where(seen, y - fit.effect, 0.0)
        done = np.where(seen, y, fit.effect + (g @ x) @ loading(seen[None].astype(float), fit)[0] @ x.T)
        n, total, gram = moments
        return n - 1, total - done, gram - np.outer(done, done)

    def _additive(self, y: np.ndarray | None) -> Fit:
        (left, right), effect = self.normal, None
        if y is None:
            effect = self.inverse @ right
        else:
            o, cells = np.isfinite(y).astype(float), np.nan_to_num(y)
            own = np.diag(o) - np.outer(o, o) / max(o.sum(), 1)
            left, right = left - own, right - cells + cells.sum() * o / max(o.sum(), 1)
            # What one path takes from the equations is small: few steps with the inverse of all of them solve its own.
            if (self.inverse * own).sum() < 0.5:
                effect = self.inverse @ right
                for _ in range(60):
                    step = self.inverse @ (right - left @ effect)
                    effect = effect + step
                    if np.abs(step).max() <= 1e-15 * np.abs(effect).max():
                        break
        if effect is None:
            effect = np.linalg.pinv(left, rcond=1e-12, hermitian=True) @ right
        return Fit(effect - effect.mean(), np.zeros((self.t, 0)), np.zeros(0))

    def fit(self, y: np.ndarray) -> Fit:
        """The fit without one path that equals this one."""
        return self._settled(y, self._without(self.begin, y, self.whole) if self.whole.basis.shape[1] else None)

    def _settled(self, y: np.ndarray | None, moments: tuple | None) -> Fit:
        t, n, additive, past, drops = self.t, max(self.n - (y is not None), 1e-300), False, [], 0

        def packed(moments):
            effect, spread = _centred(*moments)
            return np.concatenate([effect, spread.ravel() / n])

        def kept(z):
            spread = n * z[t:].reshape(t, t)
            try:
                np.linalg.cholesky(self.soft**2 * np.eye(t) - spread)
            except np.linalg.LinAlgError:
                return Fit(z[:t], *_directions(spread, 0, self.soft))
            return Fit(z[:t], np.zeros((t, 0)), np.zeros(0))

        z = packed(moments) if moments else None
        for _ in range(self.rounds):
            fit = None if z is None else kept(z)
            if not additive and (fit is None or not fit.basis.shape[1]):
                fit = self._additive(y)
                z, past, additive = packed(self._without(self._moments(fit), y, fit)), [], True
                if not kept(z).basis.shape[1]:
                    return fit
                continue
            change = packed(self._without(self._moments(fit), y, fit)) - z
            size = float(np.linalg.norm(change))
            if size <= self.tol * max(float(np.linalg.norm(z)), self.least):
                return kept(z + change)
            if past and size > 2 * past[-1][2]:
                past, drops = [], drops + 1
            past = [*past[-self.mixed :], (z, change, size)]
            z = z + change
            if len(past) > 1 and drops < 3:
                turn, step = (np.array([b[1] - a[1] + k * (b[0] - a[0]) for a, b in zip(past, past[1:], strict=False)]).T for k in (0, 1))
                z = z - step @ np.linalg.lstsq(turn, change, rcond=1e-10)[0]
        raise RuntimeError(f"low-rank fits aren't settled after {self.rounds} rounds")


def _held(rows: DataFrame, t: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Key -> (paths, weights) of rows (key, y, w), which the caller has counted."""
    got = rows.select("key", F.transform("y", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("y"), "w").toArrow()
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    keys, y = got["key"].to_numpy(), flat("y").reshape(-1, t)
    w = flat("w").reshape(len(keys), -1)
    return {int(key): (y[keys == key], w[keys == key]) for key in np.unique(keys)}


def statistics(source: DataFrame, t: int, width: int, most_bytes: int = MOST_BYTES) -> tuple[dict[int, Paths], DataFrame | None]:
    """What is known of each key's paths and the rows that it leaves out, or None.

    source: (key int, y array<double> of length t, w array<double> of ``width`` weights), written or checkpointed. Each row counts
    with weight w[j] for (key, j). The most frequent patterns are kept as long as the bound of bytes allows: as matrices where these
    are smaller than the pattern's rows, and else as rows.
    """
    rows = source.select("key", "y", "w", F.concat_ws("", F.transform("y", lambda v: F.when(v.isNull() | F.isnan(v), "0").otherwise("1"))).alias("seen"))
    rows = rows.where(F.contains("seen", F.lit("1")))
    most = max(1, most_bytes // (8 * width * (1 + t + t * t)))
    found = rows.groupBy("key", "seen").count().orderBy(F.desc("count"), "key", "seen").limit(most + 1).collect()
    frequent = lambda r: r["count"] * (t + width) > width * (1 + t + t * t)
    chosen = [(r["key"], r["seen"], frequent(r)) for r in found[:most]]
    names = F.broadcast(source.sparkSession.createDataFrame(chosen, "key int, seen string, frequent boolean"))
    rest = rows.join(names, ["key", "seen"], "left_anti").select("key", "y", "w").checkpoint() if len(found) > most else None
    rows = rows.join(names, ["key", "seen"])
    upper = np.triu_indices(t + 1)

    def sums(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for (key, seen), part in pdf.groupby(["key", "seen"]):
                y = np.column_stack([np.ones(len(part)), np.nan_to_num(matrix(part["y"], t))])
                w = np.array(part["w"].tolist(), float)
                total[key, seen] = total.get((key, seen), 0.0) + np.array([((y * x[:, None]).T @ y)[upper] for x in w.T])
        for (key, seen), v in total.items():
            yield pd.DataFrame({"key": np.int32(key), "seen": [seen], "v": [v.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x) for x in pdf["v"])
        return pdf.head(1).assign(v=[v.tobytes()])

    # A pattern's paths meet in few tasks, so that few matrices are handed on.
    dealt = rows.where("frequent").select("key", "seen", "y", "w").repartition("key", "seen", F.pmod(F.xxhash64("y"), F.lit(8)))
    kind = "key int, seen string, v binary"
    got = dealt.mapInPandas(sums, kind).groupBy("key", "seen").applyInPandas(added, kind).collect() if any(c[2] for c in chosen) else []
    held = _held(rows.where("not frequent"), t) if not all(c[2] for c in chosen) else {}
    known = {}
    for key in {c[0] for c in chosen}:
        y, w = held.get(key, (np.zeros((0, t)), np.zeros((0, width))))
        mine = [r for r in got if r["key"] == key]
        patterns = np.array([list(r["seen"]) for r in mine]).reshape(-1, t) == "1"
        products = np.array([np.frombuffer(r["v"]) for r in mine]).reshape(-1, width, len(upper[0]))
        known[key] = Paths(np.isfinite(y), np.nan_to_num(y), w, patterns, products)
    return known, rest


def _row_moments(rest: DataFrame, t: int, wanted: dict[int, Fit], of: dict) -> dict:
    """Moments of the rows outside the statistics, completed by each wanted fit's passes so far: one job for all of them."""
    upper = np.triu_indices(t)

    def sums(batches):
        total: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("key"):
                ys, w = matrix(part["y"], t), np.array(part["w"].tolist(), float)
                for name, fit in wanted.items():
                    if of[name][0] == key:
                        x, f = w[:, of[name][1]], complete(ys, fit)
                        total[name] = total.get(name, 0.0) + np.concatenate([[x.sum()], x @ f, ((f * x[:, None]).T @ f)[upper]])
        for name, v in total.items():
            yield pd.DataFrame({"name": [name], "v": [v]})

    got = rest.mapInPandas(sums, "name int, v array<double>").select("name", F.posexplode("v").alias("pos", "v")).groupBy("name", "pos").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = {}
    for name in wanted:
        part, v, gram = got[got["name"] == name], np.zeros(1 + t + len(upper[0])), np.zeros((t, t))
        v[part["pos"]] = part["v"]
        gram[upper] = v[t + 1 :]
        out[name] = (v[0], v[1 : t + 1], gram + np.triu(gram, 1).T)
    return out


@dataclass
class Panel:
    """Donor paths for fits of one or more keys: what is known of each key, and rows beyond the bound."""

    t: int
    known: dict[int, Paths]
    rest: DataFrame | None = None
    #: Periods of a key where it has fewer than t: the first ones.
    lengths: dict[int, int] = field(default_factory=dict)
    session: SparkSession | None = None
    #: Whether the rows beyond the bound are held too, so that no pass reads them.
    held: bool = False

    def fit(self, plan: dict[int, tuple[tuple[int, int], int, float | None]], rounds: int = 5000, tol: float = 1e-5, fast: bool = True) -> dict[int, Fit]:
        """Settled fits of ``plan``: name -> ((key, place), rank, threshold or None). An error is raised where one doesn't settle.

        Where all rows are held the fits are dealt out to executors, which get them by a broadcast of at most their bounds.
        Others count in every pass; the additive start and the change of a pass are taken from the statistics.
        ``fast`` extrapolates (see ``_Run``), which early stopping under a loose tolerance must not.
        """
        apart = None if self.held else self.rest
        if apart is not None and self.lengths:
            raise ValueError("shortened panels must fit the bounds of the statistics")
        kind = _Run if fast and apart is None else _Steady
        new = lambda at, rank, soft: kind(self._statistics(at), rank, soft, tol)
        if apart is None and self.session is not None and len(plan) > 1:
            return self._dealt_out(plan, rounds, tol, fast)
        runs, done = {name: new(*p) for name, p in plan.items()}, {}
        for _ in range(rounds):
            active = {name: run for name, run in runs.items() if name not in done}
            if not active:
                return done
            more = _row_moments(apart, self.t, {name: run.fit for name, run in active.items()}, {name: p[0] for name, p in plan.items()}) if apart is not None else {}
            for name, run in active.items():
                got = run.moments()
                if name in more:
                    got = tuple(a + b for a, b in zip(got, more[name], strict=True))
                if run.advance(*got):
                    done[name] = run.fit
        if len(done) == len(runs):
            return done
        raise RuntimeError(f"low-rank fits aren't settled after {rounds} passes")

    def _dealt_out(self, plan, rounds, tol, fast) -> dict[int, Fit]:
        data, order = self.session.sparkContext.broadcast((self.t, self.known, self.lengths)), list(plan)

        def run(batches):
            for pdf in batches:
                t, known, lengths = data.value
                own = Panel(t, known, None, lengths)
                for name in (order[k] for k in pdf["id"]):
                    yield pd.DataFrame({"name": [name], "fit": [pickle.dumps(own.fit({name: plan[name]}, rounds, tol, fast)[name])]})

        rows = self.session.range(0, len(plan), 1, len(plan)).mapInPandas(run, "name int, fit binary").collect()
        return {r["name"]: pickle.loads(bytes(r["fit"])) for r in rows}

    def spread(self, at: tuple[int, int] = (0, 0)) -> np.ndarray:
        """Gram matrix of what the additive fit leaves of the completed paths."""
        s = self._statistics(at)
        n, total, gram = _moments(s, _start(s, _additive(s)))
        gram = gram - np.outer(total, total) / max(n, 1e-300)
        gram = gram - gram.mean(0)
        return gram - gram.mean(1, keepdims=True)

    def _statistics(self, at: tuple[int, int]) -> Statistics:
        known, t = self.known.get(at[0]), self.lengths.get(at[0], self.t)
        return known.place(at[1], t) if known else Statistics(np.zeros((0, t), bool), np.zeros(0), np.zeros((0, t)))


def panel(source: DataFrame, t: int, width: int = 1, most_bytes: int = MOST_BYTES, lengths: dict[int, int] | None = None, most_row_bytes: int = MOST_ROW_BYTES) -> Panel:
    """Gather a panel; see ``statistics`` for the columns of source. Rows that it leaves out are held too where they fit a bound."""
    known, rest = statistics(source, t, width, most_bytes)
    held = rest is not None and rest.count() * 8 * (t + width) <= most_row_bytes
    for key, (y, w) in (_held(rest, t) if held else {}).items():
        of = known.get(key, Paths(np.zeros((0, t), bool), np.zeros((0, t)), np.zeros((0, width)), np.zeros((0, t), bool), np.zeros((0, width, (t + 1) * (t + 2) // 2))))
        known[key] = Paths(*(np.concatenate(x) for x in ((of.seen, np.isfinite(y)), (of.cells, np.nan_to_num(y)), (of.weights, w))), of.patterns, of.products)
    return Panel(t, known, rest, lengths or {}, source.sparkSession, held)


def single(donors: DataFrame, t: int, most_bytes: int = MOST_BYTES) -> Panel:
    """The panel of one fit of rows (y)."""
    return panel(donors.select(F.lit(0).alias("key"), "y", F.array(F.lit(1.0)).alias("w")), t, 1, most_bytes)


def fit_one(donors: DataFrame, t: int, rank: int, soft: float | None = None, rounds: int = 5000, tol: float = 1e-5) -> Fit:
    return single(donors, t).fit({0: ((0, 0), rank, soft)}, rounds, tol)[0]


def left_out(rows: DataFrame, data: Panel, soft: float) -> DataFrame:
    """Rows (unit, n, effect, basis, weights): the fit without one path of each row (unit, y, n) of a panel of one key and weight, and
    the fit of all, with n = 0 and no unit. The basis is written row by row. The panel must fit the bounds, as every refit needs it all.
    """
    if data.rest is not None and not data.held:
        raise ValueError("refits without one path each need a panel within the bounds of the statistics")
    t = data.t
    none = Paths(np.zeros((0, t), bool), np.zeros((0, t)), np.zeros((0, 1)), np.zeros((0, t), bool), np.zeros((0, 1, (t + 1) * (t + 2) // 2)))
    solver = LeftOut(data.known.get(0, none), t, soft)
    shared = rows.sparkSession.sparkContext.broadcast(solver)
    flat = lambda fit: (fit.effect.tolist(), fit.basis.ravel().tolist(), fit.weights.tolist())

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                fits = [flat(shared.value.fit(np.asarray(y, float))) for y in part["y"]]
                yield part[["unit", "n"]].assign(**{c: list(v) for c, v in zip(("effect", "basis", "weights"), zip(*fits, strict=True), strict=True)})

    kind = "unit long, n long, effect array<double>, basis array<double>, weights array<double>"
    whole = rows.sparkSession.createDataFrame([(None, 0, *flat(solver.whole))], kind)
    dealt = rows.select("unit", "y", "n").repartition(min(1024, -(-max(rows.count(), 1) // 128)), "unit")
    return dealt.mapInPandas(run, kind).unionByName(whole)
