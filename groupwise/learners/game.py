"""Repeated game between a weighted learner and a regulator that re-weights groups.

All rows of a cell (combination of groups, and label) have one weight. The linear learners therefore work on sums per cell (:mod:`cells`): a
least-squares game reads its rows once, a logistic one a few times per round, and games that differ in their settings only share every pass.
Other learners take a weighted fit and one aggregation of the errors per group in every round. Only group-sized vectors live on the
driver; errors of single rows are never kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import ERROR_TYPES, error_rows, sample_error
from ..lookup import LOOKUP_ROWS, pin
from ..operators.dual import GAME_MODES, game_update, step_size
from ..operators.groups import group_sizes
from ..operators.history import highest_gamma, trajectory
from ..operators.metrics import group_logloss
from ..session import release, settle, spread
from ..spec import require_columns
from .cells import Cells, cells_of, error_sums, model_of, run_together, solver
from .linear import LinearLearner, LogisticLearner, PairedLearner
from .mixture import MixtureModel, mixture


def bounded_rows(df: DataFrame, what: str) -> pd.DataFrame:
    """Group-sized table on the driver, refused when it is not group-sized."""
    pinned = pin(df)
    if not pinned.small:
        raise ValueError(f"more than {LOOKUP_ROWS} {what}; training keeps one weight per group on the driver")
    return pinned.rows.to_pandas()


def cached_rows(df: DataFrame) -> DataFrame:
    """Training rows, cached for many passes and spread over the cores when they are few."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    even = spread(held, held.count())
    if even is held:
        return held
    even.persist(StorageLevel.MEMORY_AND_DISK).count()
    held.unpersist()
    return even


def refuse_null_groups(rows: DataFrame, groups: Sequence[str]) -> None:
    """Rows without a group would be missing in the fit but not in the population error."""
    if not rows.where(reduce(or_, [F.col(c).isNull() for c in groups])).isEmpty():
        raise ValueError(f"NULL in the group columns {list(groups)}; name that group or leave its rows out")


@dataclass
class _GroupType:
    """Sizes, weights and multipliers of the groups of one column."""

    column: str
    names: list
    n: np.ndarray
    pos: np.ndarray
    w: np.ndarray
    lam: np.ndarray
    w_pos: np.ndarray
    w_neg: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.n / self.n.sum()


@dataclass
class GameResult:
    """``history`` and ``valid_history``: ``(round, group_type, g, error_type, err, n, pop_err, weight, lam)``; ``rounds`` played."""

    model: MixtureModel
    history: DataFrame
    valid_history: DataFrame | None
    rounds: int
    main_error: str
    pop_error: str

    def errors(self, error_type: str | None = None, valid: bool = False) -> DataFrame:
        """History of one error type, with group ids unique over group types, in the form :mod:`operators.history` takes."""
        source = self.valid_history if valid else self.history
        picked = source.where(F.col("error_type") == (error_type or self.main_error))
        return picked.select("round", F.concat_ws("@", "group_type", "g").alias("g"), "err", "n", "pop_err")


HISTORY = "round int, group_type string, g string, error_type string, err double, n bigint, pop_err double, weight double, lam double"


@dataclass
class MinimaxGame:
    """Settings of a game.

    ``mode``: ``minimax`` (exponential weights), ``relaxed`` (group errors only need to reach ``gamma``) or ``equal`` (classifiers only). ``error_type``
    drives the weights; FP and FN kinds report the 0/1 loss for the population, log-loss kinds need a learner with probabilities, regressions play on MSE.
    The step is ``a * t^-b``; ``scale_by_label`` divides ``a`` by the squared largest label. From round 4 on the game stops when no row weight
    moves by ``threshold`` or more. ``penalize_errors`` adds a logistic learner's penalty to its log-losses.
    """

    learner: object = field(default_factory=LogisticLearner)
    mode: str = "minimax"
    rounds: int = 100
    a: float = 1.0
    b: float = 0.5
    gamma: float = 0.0
    error_type: str = "0/1 Loss"
    extra_error_types: Sequence[str] = ()
    threshold: float = 1e-15
    scale_by_label: bool = False
    penalize_errors: bool = False

    @property
    def regression(self) -> bool:
        """Whether the members answer with values: the learner says so itself, or is a linear one."""
        return bool(getattr(self.learner, "regression", isinstance(self.learner, LinearLearner)))

    def check(self) -> None:
        if self.mode not in GAME_MODES:
            raise ValueError(f"unknown game mode {self.mode!r}; expected one of {GAME_MODES}")
        for kind in (self.error_type, *self.extra_error_types):
            if kind not in ERROR_TYPES:
                raise ValueError(f"unknown error type {kind!r}; expected one of {ERROR_TYPES}")
        if self.regression:
            if self.mode == "equal":
                raise ValueError("equal errors are for classifiers; play a regression in mode 'minimax' or 'relaxed'")
            return
        no_p = not getattr(self.learner, "has_probability", not isinstance(self.learner, PairedLearner))
        if no_p and any(k.endswith("Log-Loss") for k in (self.error_type, *self.extra_error_types)):
            raise ValueError("log-loss kinds need a learner that gives probabilities")
        if self.penalize_errors and not isinstance(self.learner, LogisticLearner):
            raise ValueError("only a logistic learner has a penalty to add to its log-losses")

    def kinds(self) -> tuple[str, str, list[str]]:
        """The error kind that drives the weights, that of the population, and all that are logged."""
        main = "MSE" if self.regression else self.error_type
        pop = "0/1 Loss" if main[:2] in ("FP", "FN") else main
        extra = [] if self.regression else [e for e in self.extra_error_types if e != main]
        if main in ("FP-Log-Loss", "FN-Log-Loss"):
            extra.append(main.split("-")[0])
        kinds = list(dict.fromkeys([main, pop, *extra]))
        if any(k[:2] in ("FP", "FN") for k in kinds):
            kinds = list(dict.fromkeys([*kinds, "0/1 Loss"]))
        return main, pop, kinds

    def fit(self, df: DataFrame, features: Sequence[str], y: str = "y", groups: Sequence[str] = ("g",), valid: DataFrame | None = None) -> GameResult:
        return fit_games([self], df, features, y, groups, valid)[0]

    def _play(self, rows, held, features, y, groups) -> GameResult:
        """The rounds of a learner that fits weighted rows."""
        spark = rows.sparkSession
        main, pop, kinds = self.kinds()
        types = [_group_type(rows, c, y) for c in groups]
        label = F.when(F.col(y) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
        combos = settle(rows.select(*groups, label.alias(y)).distinct()) if len(groups) > 1 and main != "MSE" else None
        top = rows.agg(F.max(F.abs(y))).first()[0] if self.scale_by_label else None
        members, log, valid_log = [], [], []
        previous = None
        played = 0
        for t in range(1, self.rounds + 1):
            if t > 3 and _largest_move(spark, previous, types, combos, y) < self.threshold:
                break
            previous = [replace(gt) for gt in types]
            weighted = _weighted(spark, rows, types, y)
            member = self.learner.fit(weighted, features, y, "_w")
            members.append(member)
            played = t
            errors = _round_errors(member, rows, groups, y, kinds).plus(self._penalty(member))
            self._update(types, errors, t, top)
            log += errors.log(t, types, kinds)
            if held is not None:
                valid_log += _round_errors(member, held, groups, y, kinds).plus(self._penalty(member)).log(t, types, kinds)
        if combos is not None:
            release(combos)
        return self._result(spark, members, log, valid_log if held is not None else None, played)

    def _rounds(self, solve, cells: Cells):
        """The rounds of a learner on sums per cell: a search (see :mod:`cells`) that returns members, errors and group states per round."""
        main, _, kinds = self.kinds()
        types = _cell_types(cells)
        members, errors, states = [], [], []
        previous = None
        for t in range(1, self.rounds + 1):
            weight = _cell_weights(types, cells)
            if t > 3 and float(np.max(np.abs(weight - previous))) < self.threshold:
                break
            previous = weight
            beta, sums = yield from solve.solve(weight)
            members.append(model_of(self.learner, cells, beta))
            errors.append(_cell_errors(cells, sums, kinds).plus(self._penalty(members[-1])))
            self._update(types, errors[-1], t, cells.top if self.scale_by_label else None)
            states.append([replace(gt) for gt in types])
        return members, errors, states

    def _update(self, types: list[_GroupType], errors: "_Errors", t: int, top: float | None) -> None:
        main = self.kinds()[0]
        eta = step_size(self.a, self.b, t, top)
        for i, gt in enumerate(types):
            gt.w, gt.lam = game_update(gt.w, gt.lam, gt.share, errors.lookup(gt, main), eta, self.mode, self.gamma, errors.mean(main))
            _set_row_weights(types, i, main, self.mode, not isinstance(self.learner, PairedLearner))

    def _penalty(self, member) -> float:
        if not self.penalize_errors or self.learner.penalty == "none":
            return 0.0
        coef = np.array(member.coef)
        return float(np.abs(coef).sum() if self.learner.penalty == "l1" else 0.5 * coef @ coef) / self.learner.C

    def _result(self, spark, members, log, valid_log, played) -> GameResult:
        main, pop, _ = self.kinds()
        history = spark.createDataFrame(log, HISTORY)
        valid_history = spark.createDataFrame(valid_log, HISTORY) if valid_log is not None else None
        return GameResult(mixture(members), history, valid_history, played, main, pop)


def fit_games(
    games: Sequence[MinimaxGame], df: DataFrame, features: Sequence[str], y: str = "y", groups: Sequence[str] = ("g",), valid: DataFrame | None = None,
    cells: Cells | None = None,
) -> list[GameResult]:
    """Play games of one learner and error type on one table. Linear learners play all of them on shared passes (``cells``: the rows, where a caller has them)."""
    for game in games:
        game.check()
    first, features, groups = games[0], list(features), list(groups)
    if any((g.learner, g.error_type) != (first.learner, first.error_type) for g in games):
        raise ValueError("games played together share learner and error type")
    columns = [*dict.fromkeys([*features, y, *groups])]
    own = cells is None
    if own:
        cells = game_cells(first, require_columns(df, *columns), features, y, groups)
    try:
        solves = [solver(g.learner, cells) if cells is not None else None for g in games[:1]]
        if solves[0] is not None:
            return _play_on_cells(games, solves[0], cells, valid, features, y, groups)
    finally:
        if own and cells is not None:
            cells.unpersist()
    # a caller that plays several games on one table hands in the cached rows
    ready = df.is_cached and df.columns == columns
    rows = df if ready else cached_rows(require_columns(df, *columns).select(*columns))
    held = valid.select(*columns).persist(StorageLevel.MEMORY_AND_DISK) if valid is not None else None
    try:
        refuse_null_groups(rows, groups)
        return [g._play(rows, held, features, y, groups) for g in games]
    finally:
        if not ready:
            rows.unpersist()
        if held is not None:
            held.unpersist()


def game_cells(game: MinimaxGame, df: DataFrame, features: Sequence[str], y: str, groups: Sequence[str], like: Cells | None = None) -> Cells | None:
    """The cells of a table for the learner of a game, None for learners that need the rows."""
    if type(game.learner) not in (LinearLearner, LogisticLearner, PairedLearner):
        return None
    return cells_of(df, features, y, groups, not game.regression, game.learner.fit_intercept, like)


def _play_on_cells(games, solve, cells: Cells, valid, features, y, groups) -> list[GameResult]:
    spark, learner = cells.rows.sparkSession, games[0].learner
    searches = [g._rounds(solve.again(), cells) for g in games]
    played = run_together(cells, searches, learner.fit_intercept, solve.logistic)
    held_errors: list = []
    if valid is not None:
        held = game_cells(games[0], valid, features, y, groups, like=cells)
        if held is None:
            raise ValueError("more combinations of groups in the validation part than the lookup bound")
        try:
            sums = error_sums(learner, held, [m for members, _, _ in played for m in members])
        finally:
            held.unpersist()
        held_errors = [_cell_errors(held, s, games[0].kinds()[2]) for s in sums]
    out, at = [], 0
    for game, (members, errors, states) in zip(games, played):
        kinds = game.kinds()[2]
        log = [row for t, (e, types) in enumerate(zip(errors, states), 1) for row in e.log(t, types, kinds)]
        valid_log = None
        if valid is not None:
            mine = [e.plus(game._penalty(m)) for e, m in zip(held_errors[at : at + len(members)], members)]
            valid_log = [row for t, (e, types) in enumerate(zip(mine, states), 1) for row in e.log(t, types, kinds)]
            at += len(members)
        out.append(game._result(spark, members, log, valid_log, len(members)))
    return out


def _cell_types(cells: Cells) -> list[_GroupType]:
    out = []
    for column, names, at in zip(cells.groups, cells.names, cells.at):
        n, pos = np.bincount(at, cells.n, len(names)), np.bincount(at, cells.n * cells.label, len(names))
        uniform = np.full(len(n), 1.0 / n.sum())
        out.append(_GroupType(column, names, n, pos, n / n.sum(), np.zeros(len(n)), uniform.copy(), uniform.copy()))
    return out


def _cell_weights(types: list[_GroupType], cells: Cells) -> np.ndarray:
    parts = [np.where(cells.label == 1, gt.w_pos[at], gt.w_neg[at]) for gt, at in zip(types, cells.at)]
    return sum(parts) / len(types)


def _cell_errors(cells: Cells, sums: dict[str, np.ndarray], kinds: Sequence[str]) -> "_Errors":
    """Group errors from sums per cell: FP kinds live in the negative cells, FN kinds in the positive ones."""
    out, totals = {}, {}
    for kind in kinds:
        side = {"FP": cells.label == 0, "FN": cells.label == 1}.get(kind[:2], np.ones(len(cells), bool))
        base = kind if kind in sums else "Log-Loss" if kind == "FN-Log-Loss" else "0/1 Loss"
        s, n = sums[base] * side, cells.n * side
        totals[kind] = (float(s.sum()), int(cells.n.sum()))
        for column, names, at in zip(cells.groups, cells.names, cells.at):
            by = zip(names, np.bincount(at, s, len(names)).tolist(), np.bincount(at, n, len(names)).tolist())
            out |= {(column, str(name), kind): (err, int(count)) for name, err, count in by}
    return _Errors(out, totals)


def _group_type(rows: DataFrame, column: str, y: str) -> _GroupType:
    sized = rows.where(F.col(column).isNotNull())
    # a regression label has no positives; only the counts matter there
    label = F.when(F.col(y) == 1, F.lit(1)).otherwise(F.lit(0))
    t = bounded_rows(group_sizes(sized.withColumn("_l", label), [column], "_l"), f"groups in {column}").sort_values(column)
    n, pos = t["n"].to_numpy(float), t["n_pos"].to_numpy(float)
    uniform = np.full(len(n), 1.0 / n.sum())
    return _GroupType(column, t[column].tolist(), n, pos, n / n.sum(), np.zeros(len(n)), uniform.copy(), uniform.copy())


def _set_row_weights(types: list[_GroupType], i: int, main: str, mode: str, lift: bool) -> None:
    """Translate group weights of type ``i`` into the weight of its positives and negatives."""
    gt = types[i]
    if mode != "minimax" and main[:2] in ("FP", "FN"):
        base = 1.0 / gt.n.sum()
        gt.w_pos, gt.w_neg = np.full(len(gt.n), base), np.full(len(gt.n), base)
        side, count = (gt.w_neg, gt.n - gt.pos) if main.startswith("FP") else (gt.w_pos, gt.pos)
        side += np.divide(gt.lam, count, out=np.zeros_like(gt.lam), where=count > 0)
    else:
        gt.w_pos = gt.w / gt.n
        gt.w_neg = gt.w_pos.copy()
    if mode == "equal" and lift:
        low = min(min(np.min(o.w_pos), np.min(o.w_neg)) for o in types)
        if low < 0:
            gt.w_pos, gt.w_neg = gt.w_pos - low, gt.w_neg - low


def _largest_move(spark: SparkSession, before: list[_GroupType], now: list[_GroupType], combos: DataFrame | None, y: str) -> float:
    """Largest change of a row weight: one weight per (group, label), or per combination of groups when there are several types."""
    if combos is None:
        return max(float(np.max(np.abs(b - a))) for o, n in zip(before, now) for a, b in ((o.w_pos, n.w_pos), (o.w_neg, n.w_neg)))
    old = _weighted(spark, combos, before, y).select(*combos.columns, F.col("_w").alias("_old"))
    return _weighted(spark, old, now, y).agg(F.max(F.abs(F.col("_w") - F.col("_old")))).first()[0]


def _weighted(spark: SparkSession, rows: DataFrame, types: list[_GroupType], y: str) -> DataFrame:
    total = None
    for i, gt in enumerate(types):
        kind = rows.schema[gt.column].dataType.simpleString()
        table = spark.createDataFrame(
            list(zip(gt.names, gt.w_pos.tolist(), gt.w_neg.tolist())), f"`{gt.column}` {kind}, _p{i} double, _n{i} double"
        )
        rows = rows.join(F.broadcast(table), gt.column)
        part = F.when(F.col(y) == 1, F.col(f"_p{i}")).otherwise(F.col(f"_n{i}"))
        total = part if total is None else total + part
    return rows.withColumn("_w", total / F.lit(float(len(types))))


@dataclass
class _Errors:
    """Summed errors and denominators per (group type, group, error kind)."""

    sums: dict[tuple[str, str, str], tuple[float, int]]
    totals: dict[str, tuple[float, int]]

    def plus(self, penalty: float) -> "_Errors":
        """The same errors with a penalty on every row of the log-loss kinds."""
        if not penalty:
            return self
        add = {k: (s + n * penalty if k[2].endswith("Log-Loss") else s, n) for k, (s, n) in self.sums.items()}
        return _Errors(add, {k: (s + n * penalty if k.endswith("Log-Loss") else s, n) for k, (s, n) in self.totals.items()})

    def lookup(self, gt: _GroupType, kind: str) -> np.ndarray:
        pairs = [self.sums.get((gt.column, str(g), kind), (0.0, 0)) for g in gt.names]
        return np.array([s / n if n else 0.0 for s, n in pairs])

    def mean(self, kind: str) -> float:
        s, n = self.totals[kind]
        return s / n if n else 0.0

    def log(self, t: int, types: list[_GroupType], kinds: Sequence[str]) -> list[tuple]:
        out = []
        for gt in types:
            for i, g in enumerate(gt.names):
                for kind in kinds:
                    s, n = self.sums.get((gt.column, str(g), kind), (0.0, 0))
                    pop = self.mean("0/1 Loss" if kind[:2] in ("FP", "FN") else kind)
                    out.append((t, gt.column, str(g), kind, s / n if n else None, n, pop, float(gt.w[i]), float(gt.lam[i])))
        return out


def _round_errors(member, rows: DataFrame, groups: Sequence[str], y: str, kinds: Sequence[str]) -> _Errors:
    """One aggregation for all group types and error kinds: rows fan out once per type, then sum map-side."""
    scored = member.transform(rows)
    pairs = F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).cast("string").alias("g")) for c in groups])
    aggs = []
    for i, kind in enumerate(kinds):
        counted = error_rows(y, kind)
        aggs += [F.sum(F.col(f"_e{i}")).alias(f"s{i}"), F.sum(counted.cast("bigint")).alias(f"n{i}")]
    errs = [sample_error(y, "pred", "p", kind).alias(f"_e{i}") for i, kind in enumerate(kinds)]
    long = scored.select(y, *errs, F.inline(pairs))
    table = long.groupBy("type", "g").agg(*aggs, F.count(F.lit(1)).alias("rows"))
    sums, totals = {}, {k: [0.0, 0] for k in kinds}
    for row in bounded_rows(table, "groups").to_dict("records"):
        for i, kind in enumerate(kinds):
            s, n = float(row[f"s{i}"] or 0.0), int(row[f"n{i}"] or 0)
            sums[(row["type"], row["g"], kind)] = (s, n)
            if row["type"] == groups[0]:
                totals[kind][0] += s
                totals[kind][1] += int(row["rows"])
    return _Errors(sums, {k: (v[0], v[1]) for k, v in totals.items()})


def gamma_range(game: MinimaxGame, df: DataFrame, features: Sequence[str], y: str, groups: Sequence[str], cells: Cells | None = None) -> tuple[float, float]:
    """The useful gammas of a game.

    An unrelaxed run gives the worst mixture group error at its end and the worst group error at the best population error. FP and FN kinds can always reach 0, so
    one round gives their upper end. Of an equal-error game only the error it reaches is of use.
    """
    one_sided = game.error_type[:2] in ("FP", "FN") and not game.regression
    if game.mode == "equal":
        run = replace(game, mode="equal")
    else:
        run = replace(game, mode="minimax", rounds=1 if one_sided else game.rounds)
    base = fit_games([run], df, features, y, groups, cells=cells)[0]
    errors = base.errors()
    low = trajectory(errors).orderBy(F.col("round").desc()).first()["max_group_err"]
    if game.mode == "equal":
        return float(low), float(low)
    return (0.0 if one_sided else float(low)), float(highest_gamma(errors).first()[0])


def gamma_sweep(
    game: MinimaxGame, df: DataFrame, features: Sequence[str], y: str = "y", groups: Sequence[str] = ("g",), n: int = 10, cap: float | None = None,
    valid: DataFrame | None = None,
) -> DataFrame:
    """Trade-off curve ``(gamma, pop_err, max_group_err, rounds)``; with ``valid`` also ``valid_pop_err, valid_max_group_err``.

    Relaxed games at both ends of :func:`gamma_range` and at ``n - 1`` points between (``n`` equal increments); one game where the range is a single value. Gammas
    above ``cap`` are skipped. Linear learners play all of them together on the passes of the longest one.
    """
    game.check()
    columns = [*dict.fromkeys([*features, y, *groups])]
    cells = game_cells(game, require_columns(df, *columns), features, y, groups)
    rows = df.select(*columns) if cells is not None else cached_rows(df.select(*columns))
    try:
        low, high = gamma_range(game, rows, features, y, groups, cells)
        gammas = [low] if high <= low else [low + (high - low) * i / n for i in range(n + 1)]
        gammas = [g for g in gammas if cap is None or g <= cap]
        if not gammas:
            return df.sparkSession.createDataFrame([], SWEEP + (VALID_SWEEP if valid is not None else ""))
        runs = fit_games([replace(game, mode="relaxed", gamma=g) for g in gammas], rows, features, y, groups, valid, cells)
        out = []
        for gamma, run in zip(gammas, runs):
            row = [float(gamma), *_last_errors(run, False), run.rounds]
            out.append(tuple(row + (_last_errors(run, True) if valid is not None else [])))
        return df.sparkSession.createDataFrame(out, SWEEP + (VALID_SWEEP if valid is not None else ""))
    finally:
        (cells or rows).unpersist()


SWEEP = "gamma double, pop_err double, max_group_err double, rounds int"
VALID_SWEEP = ", valid_pop_err double, valid_max_group_err double"


def _last_errors(run: GameResult, valid: bool) -> list[float]:
    last = trajectory(run.errors(valid=valid)).orderBy(F.col("round").desc()).first()
    return [float(last["pop_err"]), float(last["max_group_err"])]


@dataclass
class MixtureClassifier:
    """Mixture of logistic models under a bound on the group losses.

    A plain fit gives the range of group log-losses; ``gamma`` in [0, 1] places the relaxation inside it. ``relaxed=False`` plays the
    unrelaxed game.
    """

    n_estimators: int = 10
    gamma: float = 1.0
    relaxed: bool = True
    a: float = 1.0
    b: float = 0.5
    C: float = 1.0
    constraint: str = "equalized_loss"
    max_iter: int = 100

    def fit(self, df: DataFrame, features: Sequence[str], y: str = "y", g: str = "g") -> GameResult:
        if self.constraint not in ("equalized_loss", "true_positive_rate"):
            raise ValueError("constraint must be 'equalized_loss' or 'true_positive_rate'")
        learner = LogisticLearner(C=self.C, max_iter=self.max_iter)
        rows = cached_rows(df.select(*dict.fromkeys([*features, y, g])))
        plain = LogisticLearner(C=self.C, max_iter=self.max_iter, balanced=False)  # the range of gamma comes from a fit without class weights
        start = plain.fit(rows, features, y).transform(rows)
        loss = bounded_rows(group_logloss(start, self.constraint, [g], y, "p"), "groups")["loss"].dropna()
        gamma = float(loss.min() + self.gamma * (loss.max() - loss.min()))
        kind = "Log-Loss" if self.constraint == "equalized_loss" else "FN-Log-Loss"
        game = MinimaxGame(learner, "relaxed" if self.relaxed else "minimax", self.n_estimators, self.a, self.b, gamma, kind)
        try:
            return game.fit(rows, features, y, [g])
        finally:
            rows.unpersist()


@dataclass
class MixtureRegressor:
    """Mixture of ridge models under a bound on the group errors; the relaxation lies between the smallest and the largest group MSE of a plain fit."""

    n_estimators: int = 10
    gamma: float = 1.0
    relaxed: bool = True
    a: float = 1.0
    b: float = 0.5
    C: float = 1.0

    def fit(self, df: DataFrame, features: Sequence[str], y: str = "y", g: str = "g") -> GameResult:
        learner = LinearLearner(alpha=self.C)
        rows = cached_rows(df.select(*dict.fromkeys([*features, y, g])))
        start = learner.fit(rows, features, y).transform(rows)
        d = F.col(y) - F.col("p")
        mse = bounded_rows(start.groupBy(g).agg(F.avg(d * d).alias("mse")), "groups")["mse"]
        gamma = float(mse.min() + self.gamma * (mse.max() - mse.min()))
        game = MinimaxGame(learner, "relaxed" if self.relaxed else "minimax", self.n_estimators, self.a, self.b, gamma, "MSE", scale_by_label=True)
        try:
            return game.fit(rows, features, y, [g])
        finally:
            rows.unpersist()


__all__ = ["MinimaxGame", "GameResult", "MixtureClassifier", "MixtureRegressor", "fit_games", "gamma_range", "gamma_sweep", "bounded_rows"]
