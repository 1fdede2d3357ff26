"""Linear fits for many weightings at once, from sums per cell.

A cell is a combination of groups and, for classification, a label. A game gives all rows of a cell one weight, so rows are read for what does
not depend on weights: least squares need one pass for the Gram matrix of every cell, and each further fit, error and weighting is
arithmetic on those. A logistic fit is a Newton search started at the last solution; one pass returns, for every search that waits, the losses and
gradients per cell at its coefficients, which serve any weighting, and the Hessian of its weighting. Searches are generators that
yield the coefficients they want looked at, so that many games share each pass.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import EVAL_EPS
from ..lookup import pin
from ..session import spread
from .batches import dense_sums
from .linear import LinearLearner, LinearModel, LogisticLearner, PairedLearner

GRAM_CELLS = 1 << 24
SLACK = 1e-10
NOISE = 1e-12


@dataclass
class Cells:
    """Rows ``_c, _y, _x0..`` (cached) with the table of their cells: group values, label (0 or 1; 0 throughout for regressions) and size."""

    rows: DataFrame
    features: tuple[str, ...]
    groups: tuple[str, ...]
    keys: list[tuple]
    label: np.ndarray
    n: np.ndarray
    top: float
    shift: np.ndarray
    y_shift: float
    names: list[list] = field(init=False)
    at: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        """``names``: the sorted groups of every group column; ``at``: the one of each cell."""
        self.names, self.at = [], []
        for i in range(len(self.groups)):
            names = sorted({k[i] for k in self.keys})
            place = {name: j for j, name in enumerate(names)}
            self.names.append(names)
            self.at.append(np.array([place[k[i]] for k in self.keys]))

    def unpersist(self) -> None:
        self.rows.unpersist()

    def __len__(self) -> int:
        return len(self.keys)


def cells_of(
    df: DataFrame, features: Sequence[str], y: str, groups: Sequence[str], by_label: bool, center: bool = True, like: Cells | None = None
) -> Cells | None:
    """The cells of a table by one aggregation, or None when there are more than the lookup bound. ``like`` gives the centre of its features."""
    label = F.when(F.col(y) == 1, F.lit(1)).otherwise(F.lit(0)) if by_label else F.lit(0)
    names = [f"_x{i}" for i in range(len(features))]
    base = df.select(*groups, F.col(y).cast("double").alias("_y"), label.alias("_l"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, names)])
    sums = [F.sum(c).alias(f"s{c}") for c in ("_y", *names)]
    table = pin(base.groupBy(*groups, "_l").agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("_y")).alias("_top"), *sums))
    if not table.small:
        return None
    found = sorted(table.rows.to_pylist(), key=lambda r: (*[(r[g] is not None, r[g]) for g in groups], r["_l"]))
    if any(r[g] is None for r in found for g in groups):
        raise ValueError(f"NULL in the group columns {list(groups)}; name that group or leave its rows out")
    if not found:
        raise ValueError("a fit needs rows")
    n = np.array([r["_n"] for r in found], float)
    if like is not None:
        shift, y_shift = like.shift, like.y_shift
    elif center:
        mean = [sum(r[f"s{c}"] or 0.0 for r in found) / n.sum() for c in ("_y", *names)]
        y_shift, shift = mean[0], np.array(mean[1:])
    else:
        y_shift, shift = 0.0, np.zeros(len(names))
    schema = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    codes = df.sparkSession.createDataFrame([(*[r[g] for g in groups], r["_l"], i) for i, r in enumerate(found)], f"{schema}, _l int, _c int")
    rows = base.join(F.broadcast(codes), [*groups, "_l"]).select("_c", "_y", *names)  # within the lookup bound
    rows = spread(rows, int(n.sum())).persist(StorageLevel.MEMORY_AND_DISK)
    keys = [tuple(r[g] for g in groups) for r in found]
    top = max((r["_top"] or 0.0 for r in found), default=0.0)
    return Cells(rows, tuple(features), tuple(groups), keys, np.array([r["_l"] for r in found]), n, float(top), shift, float(y_shift))


def _design(table: pa.Table, cells_shift: np.ndarray, intercept: bool) -> np.ndarray:
    x = np.column_stack([table.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(cells_shift))]) if len(cells_shift) else np.zeros((table.num_rows, 0))
    x = x - cells_shift
    return np.column_stack([x, np.ones(len(x))]) if intercept else x


def gram(cells: Cells, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per cell ``X'X``, ``X'y``, ``y'y`` and ``X'1`` of the centred rows, in one pass."""
    c, d, shift, y_shift = len(cells), len(cells.features) + intercept, cells.shift, cells.y_shift
    block = d * d + 2 * d + 1

    def fill(table: pa.Table, out: np.ndarray) -> None:
        x, y, code = _design(table, shift, intercept), table.column("_y").to_numpy(zero_copy_only=False) - y_shift, table.column("_c").to_numpy()
        order = np.argsort(code, kind="stable")
        present, starts = np.unique(code[order], return_index=True)
        sums = out.reshape(c, block)
        for k, at in zip(present, np.split(order, starts[1:])):
            a, b = x[at], y[at]
            sums[k] += np.concatenate([(a.T @ a).ravel(), a.T @ b, a.sum(0), [b @ b]])

    sums = _known(dense_sums(cells.rows, c * block, fill)).reshape(c, block)
    return sums[:, : d * d].reshape(c, d, d), sums[:, d * d : d * d + d], sums[:, -1], sums[:, d * d + d : -1]


def _known(sums: np.ndarray) -> np.ndarray:
    if np.isnan(sums).any():
        raise ValueError("missing values among the features or labels of a linear fit")
    return sums


@dataclass
class Look:
    """What a pass returns for one coefficient vector: sums per cell, gradient per cell, and the Hessian of the weighting it was asked with."""

    wrong: np.ndarray
    logloss: np.ndarray
    over_logloss: np.ndarray
    loss: np.ndarray
    grad: np.ndarray
    hess: np.ndarray


STATS = 4


def look(cells: Cells, asked: Sequence[tuple[np.ndarray, np.ndarray]], intercept: bool, logistic: bool) -> list[Look]:
    """One pass for all ``(coefficients, weight per cell)``. Only decisions are judged where ``logistic`` is False."""
    c, d, shift = len(cells), len(cells.features) + intercept, cells.shift
    betas, weights = [b for b, _ in asked], [w for _, w in asked]
    block = c * (STATS + d) + d * d

    def fill(table: pa.Table, out: np.ndarray) -> None:
        x, y, code = _design(table, shift, intercept), table.column("_y").to_numpy(zero_copy_only=False), table.column("_c").to_numpy()
        sums = out.reshape(len(betas), block)
        for j, (beta, w) in enumerate(zip(betas, weights)):
            m = x @ beta
            decided = m > 0
            per_cell = sums[j, : c * (STATS + d)].reshape(STATS + d, c)
            per_cell[0] += np.bincount(code, y != decided, c)
            if not logistic:
                continue
            p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
            q = np.clip(p, EVAL_EPS, 1 - EVAL_EPS)
            log = -(y * np.log(q) + (1 - y) * np.log(1 - q))
            per_cell[1] += np.bincount(code, log, c)
            per_cell[2] += np.bincount(code, log * (y < decided), c)
            per_cell[3] += np.bincount(code, np.logaddexp(0, m) - y * m, c)
            for i in range(d):
                per_cell[STATS + i] += np.bincount(code, (p - y) * x[:, i], c)
            sums[j, c * (STATS + d) :] += ((x * (w[code] * p * (1 - p))[:, None]).T @ x).ravel()

    sums = _known(dense_sums(cells.rows, len(betas) * block, fill)).reshape(len(betas), block)
    out = []
    for s in sums:
        per_cell = s[: c * (STATS + d)].reshape(STATS + d, c)
        out.append(Look(*per_cell[:STATS], per_cell[STATS:].T, s[c * (STATS + d) :].reshape(d, d)))
    return out


Search = Generator[tuple[np.ndarray, np.ndarray], Look, tuple[np.ndarray, "dict[str, np.ndarray]"]]


class LeastSquares:
    """Least squares on weighted Gram matrices; its fits and errors need no further pass."""

    logistic = False

    def __init__(self, learner: LinearLearner, cells: Cells):
        self.alpha, self.intercept = learner.alpha, learner.fit_intercept
        self.xx, self.xy, self.yy, _ = gram(cells, self.intercept)

    def again(self) -> "LeastSquares":
        return self

    def solve(self, weight: np.ndarray) -> Search:
        yield from ()  # it never waits
        a = np.tensordot(weight, self.xx, 1)
        k = a.shape[0] - self.intercept
        a[range(k), range(k)] += self.alpha
        beta = np.linalg.lstsq(a, weight @ self.xy, rcond=None)[0]
        return beta, self.errors(beta)

    def errors(self, beta: np.ndarray) -> dict[str, np.ndarray]:
        fitted = np.einsum("i,cij,j->c", beta, self.xx, beta)
        return {"MSE": np.maximum(self.yy - 2 * self.xy @ beta + fitted, 0.0)}


class Paired:
    """Two unweighted regressions on ``y * w`` and ``(1 - y) * w``; the sign of their difference is judged in a pass."""

    logistic = False

    def __init__(self, learner: PairedLearner, cells: Cells):
        self.intercept = learner.fit_intercept
        self.xx, self.xy, _, self.x1 = gram(cells, self.intercept)
        self.xy = self.xy + cells.y_shift * self.x1

    def again(self) -> "Paired":
        return self

    def solve(self, weight: np.ndarray) -> Search:
        beta = np.linalg.lstsq(self.xx.sum(0), weight @ (2 * self.xy - self.x1), rcond=None)[0]
        seen = yield beta, weight
        return beta, {"0/1 Loss": seen.wrong}


class Logistic:
    """Newton search with a line search, continued from the last solution; ``l1`` penalties take proximal steps."""

    logistic = True

    def __init__(self, learner: LogisticLearner, cells: Cells):
        self.learner, self.intercept = learner, learner.fit_intercept
        n, pos = cells.n.sum(), cells.n[cells.label == 1].sum()
        if pos == 0 or pos == n:
            raise ValueError("a logistic fit needs both classes")
        up, down = (n / (2 * pos), n / (2 * (n - pos))) if learner.balanced else (1.0, 1.0)
        self.factor = np.where(cells.label == 1, up, down)
        d = len(cells.features) + self.intercept
        self.free = np.arange(d) < len(cells.features)  # the intercept is not penalised
        self.beta, self.seen = np.zeros(d), None

    def again(self) -> "Logistic":
        """A search of its own: it keeps the last solution of one game."""
        other = copy(self)
        other.beta, other.seen = np.zeros_like(self.beta), None
        return other

    def penalty(self, beta: np.ndarray) -> float:
        b = beta[self.free]
        return {"l2": 0.5 * b @ b, "l1": np.abs(b).sum(), "none": 0.0}[self.learner.penalty] / self.learner.C

    def step(self, beta: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
        """A step and the decrease it promises."""
        if self.learner.penalty != "l1":
            ridge = self.free / self.learner.C if self.learner.penalty == "l2" else np.zeros(len(beta))
            g = grad + ridge * beta
            move = -np.linalg.lstsq(hess + np.diag(ridge), g, rcond=None)[0]
            return move, -0.5 * float(g @ move)
        new, rate, h = beta.copy(), self.free / self.learner.C, np.maximum(np.diag(hess), 1e-300)
        for _ in range(1000):
            before = new.copy()
            for i in range(len(new)):
                z = new[i] - (grad[i] + hess[i] @ (new - beta)) / h[i]
                new[i] = np.sign(z) * max(abs(z) - rate[i] / h[i], 0.0)
            if np.abs(new - before).max() <= 1e-14 * (1 + np.abs(new).max()):
                break
        move = new - beta
        return move, -float(grad @ move + 0.5 * move @ hess @ move + rate @ (np.abs(new) - np.abs(beta)))

    def solve(self, weight: np.ndarray) -> Search:
        w = weight * self.factor
        if self.seen is None:
            self.seen = yield self.beta, w
        beta, seen = self.beta, self.seen
        value = w @ seen.loss + self.penalty(beta)
        for _ in range(self.learner.max_iter):
            move, gain = self.step(beta, w @ seen.grad, seen.hess)
            if gain <= SLACK * self.learner.tol * max(abs(value), 1e-300):
                break
            size = 1.0
            while size > 1e-8:
                ahead = yield beta + size * move, w
                next_value = w @ ahead.loss + self.penalty(beta + size * move)
                if next_value <= value + NOISE * abs(value):  # the loss itself is only known so well
                    break
                size /= 2
            else:
                break
            beta, seen, value = beta + size * move, ahead, next_value
        self.beta, self.seen = beta, seen
        return beta, {"0/1 Loss": seen.wrong, "Log-Loss": seen.logloss, "FP-Log-Loss": seen.over_logloss}


def solver(learner, cells: Cells):
    """The search of a learner on the cells, or None where sums per cell would not fit a task."""
    kind = SOLVERS.get(type(learner))
    if kind is None or (kind is not Logistic and len(cells) * (len(cells.features) + 1) ** 2 > GRAM_CELLS):
        return None
    return kind(learner, cells)


SOLVERS = {LinearLearner: LeastSquares, PairedLearner: Paired, LogisticLearner: Logistic}
KINDS = {LinearLearner: "linear", PairedLearner: "paired", LogisticLearner: "logistic"}


def model_of(learner, cells: Cells, beta: np.ndarray) -> LinearModel:
    """Coefficients of the rows as they are, not centred."""
    coef = beta[: len(cells.features)]
    at = float(beta[-1]) if learner.fit_intercept else 0.0
    at += (cells.y_shift if isinstance(learner, LinearLearner) else 0.0) - float(coef @ cells.shift)
    return LinearModel(KINDS[type(learner)], cells.features, tuple(coef.tolist()), at)


def beta_of(model: LinearModel, cells: Cells, intercept: bool) -> np.ndarray:
    coef = np.array(model.coef)
    if not intercept:
        return coef
    return np.append(coef, model.intercept + coef @ cells.shift - (cells.y_shift if model.kind == "linear" else 0.0))


def error_sums(learner, cells: Cells, models: Sequence[LinearModel]) -> list[dict[str, np.ndarray]]:
    """Error sums per cell of given models, all in one pass."""
    if isinstance(learner, LinearLearner):
        fit = LeastSquares(learner, cells)
        return [fit.errors(beta_of(m, cells, learner.fit_intercept)) for m in models]
    logistic = isinstance(learner, LogisticLearner)
    asked = [(beta_of(m, cells, learner.fit_intercept), np.zeros(len(cells))) for m in models]
    out = []
    for seen in look(cells, asked, learner.fit_intercept, logistic):
        sums = {"0/1 Loss": seen.wrong}
        if logistic:
            sums |= {"Log-Loss": seen.logloss, "FP-Log-Loss": seen.over_logloss}
        out.append(sums)
    return out


def run_together(cells: Cells, searches: Sequence[Generator], intercept: bool, logistic: bool) -> list:
    """Run all searches to their ends; a pass serves every search that waits. Returns what they return."""
    results: list = [None] * len(searches)
    waiting: dict[int, tuple] = {}

    def go(i: int, value) -> None:
        try:
            waiting[i] = searches[i].send(value)
        except StopIteration as end:
            results[i] = end.value

    for i in range(len(searches)):
        go(i, None)
    while waiting:
        asked, waiting = waiting, {}
        for i, seen in zip(asked, look(cells, list(asked.values()), intercept, logistic)):
            go(i, seen)
    return results
