"""Histogram gradient boosting with min-max group weights.

Rows stay on the executors: they are binned once, cached, and every tree level is one pass in which each task adds its batches to a
dense histogram. The shuffle carries the cells of these, so its size depends on nodes, features and bins and not on the row count. The
group losses of a round come from the pass over the root, so a tree takes one job per level.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.losses import (
    CONSTRAINTS,
    constraint_grad,
    constraint_hess,
    constraint_loss,
    logloss,
    logloss_grad,
    logloss_hess,
    sigmoid,
    sq_grad,
    sq_hess,
    sq_loss,
)
from ..functions.numeric import flag, ratio
from ..operators.dual import DUAL_MODES, EarlyStop, dual_update
from ..operators.ranks import cuts_of, pooled_points
from ..session import release, settle, spread
from .batches import chunks
from .game import bounded_rows

MAX_BINS = 255
HISTOGRAM_CELLS = 1 << 20
LITERAL_GROUPS = 1_000
MIN_GAIN = 1e-12


# ---- trees -----------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A node of a growing tree; ``gain`` is None until its histogram is known."""

    grad: float
    hess: float
    rows: int
    depth: int
    parent: int = -1
    gain: float | None = None
    feature: int = -1
    bin: int = -1
    left: int = -1
    right: int = -1
    known: bool = False


@dataclass(frozen=True)
class Tree:
    """Flat arrays; ``feature`` is -1 at leaves. Rows with ``x < threshold`` go left; missing values go right."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            node = at[inner]
            goes_left = x[inner, feature[node]] < threshold[node]
            at[inner] = np.where(goes_left, left[node], right[node])


@dataclass
class BoostModel:
    """Fitted trees. ``kind`` is ``classifier`` (sigmoid of the margin) or ``regressor``."""

    kind: str
    features: tuple[str, ...]
    init: float
    trees: list[Tree]
    info: pd.DataFrame | None = None

    TABLES = ("trees", "settings")

    def _margins(self, counts: Sequence[int], start: int = 0):
        trees, init, names = self.trees, self.init, list(self.features)
        stops = [start + c for c in counts]

        @F.pandas_udf("array<double>")
        def margins(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for pdf in parts:
                x = pdf[names].to_numpy(float)
                total = np.full(len(x), init if start == 0 else 0.0)
                out = np.empty((len(x), len(stops)))
                done = start
                for i in np.argsort(stops, kind="stable"):
                    for tree in trees[done : stops[i]]:
                        total = total + tree.predict(x)
                    done = max(done, min(stops[i], len(trees)))
                    out[:, i] = total
                yield pd.Series(list(out))

        return margins(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))

    def transform(self, df: DataFrame, start: int = 0, num: int | None = None, p: str = "p", pred: str = "pred") -> DataFrame:
        """Add ``p`` (probability or value) and ``pred`` (``p > 0.5`` or value) from trees ``[start, start + num)``.

        One vectorised pass over the feature columns only; works on streams.
        """
        count = len(self.trees) - start if num is None else num
        out = df.withColumn("_m", self._margins([count], start)[0])
        return self._answer(out, F.col("_m"), p, pred).drop("_m")

    def staged(self, df: DataFrame, iters: Sequence[int], p: str = "p", pred: str = "pred") -> DataFrame:
        """Every row once per tree count in ``iters``, with column ``iter``; the trees are walked once per row."""
        iters = list(iters)
        numbered = F.array(*[F.lit(int(i)) for i in iters])
        out = df.withColumn("_s", F.arrays_zip(numbered.alias("iter"), self._margins(iters).alias("m")))
        out = out.select(*df.columns, F.inline("_s").alias("iter", "_m"))
        return self._answer(out, F.col("_m"), p, pred).drop("_m")

    def _answer(self, df: DataFrame, margin: Column, p: str, pred: str) -> DataFrame:
        if self.kind == "classifier":
            return df.withColumn(p, sigmoid(margin, eps=0)).withColumn(pred, flag(F.col(p) > 0.5))
        return df.withColumn(p, margin).withColumn(pred, F.col(p))

    def to_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [
            (t, i, int(tr.feature[i]), float(tr.threshold[i]), int(tr.left[i]), int(tr.right[i]), float(tr.value[i]))
            for t, tr in enumerate(self.trees)
            for i in range(len(tr.feature))
        ]
        trees = spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double")
        settings = spark.createDataFrame([(self.kind, list(self.features), float(self.init))], "kind string, features array<string>, init double")
        return {"trees": trees, "settings": settings}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> "BoostModel":
        head = tables["settings"].first()
        trees = []
        for _, t in tables["trees"].toPandas().sort_values(["tree", "node"]).groupby("tree"):
            trees.append(Tree(*[tuple(t[c].tolist()) for c in ("feature", "threshold", "left", "right", "value")]))
        return cls(head["kind"], tuple(head["features"]), head["init"], trees)


def score_models(df: DataFrame, models: Mapping[int, BoostModel], model: str = "model", score: str = "score") -> DataFrame:
    """Long frame with one row per (row, model): all models score a batch while it is in the task, so the table is read once."""
    numbers = sorted(models)
    fitted = [models[i] for i in numbers]
    if len({(m.kind, m.features) for m in fitted}) != 1:
        raise ValueError("models scored together share kind and features")
    names, sigmoid_out = list(fitted[0].features), fitted[0].kind == "classifier"

    @F.pandas_udf("array<double>")
    def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in parts:
            x = pdf[names].to_numpy(float)
            out = np.empty((len(x), len(fitted)))
            for i, m in enumerate(fitted):
                out[:, i] = m.init
                for tree in m.trees:
                    out[:, i] += tree.predict(x)
            yield pd.Series(list(1 / (1 + np.exp(-out)) if sigmoid_out else out))

    arrays = scores(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))
    ids = F.array(*[F.lit(int(i)) for i in numbers])
    zipped = df.withColumn("_z", F.arrays_zip(ids.alias("m"), arrays.alias("s")))
    return zipped.select(*df.columns, F.inline("_z").alias(model, score))


# ---- binned rows -----------------------------------------------------------------------------------------------------


@dataclass
class Binned:
    """Binned training rows ``(_y, _g, _b0.._bk)`` with bin edges per feature; shared by all fits on the same table."""

    rows: DataFrame
    features: tuple[str, ...]
    edges: list[list[float]]
    groups: list
    sizes: np.ndarray

    def unpersist(self) -> None:
        self.rows.unpersist()

    def bin(self, df: DataFrame, y: str, g: str | None) -> DataFrame:
        return _bin(df, self.features, self.edges, y, _codes(df, g, self.groups))


def _codes(df: DataFrame, g: str | None, groups: list) -> DataFrame | None:
    if g is None:
        return None
    kind = df.schema[g].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(groups)], f"`{g}` {kind}, _g int")


def _bin(df: DataFrame, features: Sequence[str], edges: list[list[float]], y: str, codes: DataFrame | None) -> DataFrame:
    """Without ``codes`` all rows are one group; with them a NULL or unknown group stops the job, no row is dropped."""
    if codes is None:
        coded, group = df, F.lit(0)
    else:
        g = codes.columns[0]
        coded = df.join(F.broadcast(codes), g, "left")
        stop = F.raise_error(F.concat(F.lit("group without training rows: "), F.coalesce(F.col(g).cast("string"), F.lit("NULL"))))
        group = F.when(F.col("_g").isNull(), stop.cast("int")).otherwise(F.col("_g"))
    base = coded.select(
        F.col(y).cast("double").alias("_y"), group.alias("_g"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    )
    cut = [i for i, e in enumerate(edges) if e]
    if cut:
        base = Bucketizer(
            splitsArray=[[-float("inf"), *edges[i], float("inf")] for i in cut],
            inputCols=[f"_f{i}" for i in cut],
            outputCols=[f"_o{i}" for i in cut],
            handleInvalid="keep",
        ).transform(base)
    # missing values share the bin after the last one
    made = [F.coalesce(F.col(f"_o{i}"), F.lit(len(edges[i]) + 1)) if i in cut else F.lit(0) for i in range(len(features))]
    return base.select("_y", "_g", *[e.cast("smallint").alias(f"_b{i}") for i, e in enumerate(made)])


def prepare(df: DataFrame, features: Sequence[str], y: str = "y", g: str | None = "g", max_bins: int = MAX_BINS) -> Binned:
    """Quantile edges by one sketch aggregation, then bin and cache. A feature with few values gets one bin per value."""
    features = tuple(features)
    if not 2 <= max_bins <= 1024:
        raise ValueError("max_bins must lie in 2..1024")
    numbers = [F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)]
    base = df.select(F.col(y), *([F.col(g)] if g is not None else []), *numbers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found, n = pooled_points(base, [f"_v{i}" for i in range(len(features))])
        edges = [cuts_of(found[f"_v{i}"], max_bins) for i in range(len(features))]
        names, sizes = ["all"], [n]
        if g is not None:
            counts = bounded_rows(base.where(F.col(g).isNotNull()).groupBy(g).agg(F.count(F.lit(1)).alias("n")), "groups").sort_values(g)
            names, sizes = counts[g].tolist(), counts["n"].tolist()
        named = base.select(y, *([g] if g is not None else []), *[F.col(f"_v{i}").alias(f) for i, f in enumerate(features)])
        rows = spread(_bin(named, features, edges, y, _codes(named, g, names)), n).persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()  # fills the cache while the table behind it is still held
    finally:
        base.unpersist()
    return Binned(rows, features, edges, names, np.array(sizes, float))


# ---- histograms ------------------------------------------------------------------------------------------------------


CELLS = "model int, node int, feature int, bin int, g double, h double, n bigint"
LOSS = -1


@dataclass
class Request:
    """What a pass has to sum for one growing tree: ``nodes`` of ``node`` over the columns ``bins`` of at most ``width`` bins each; with ``groups`` also the known ``loss`` per ``_g``."""

    node: Column
    grad: Column
    hess: Column
    bins: Sequence[str]
    nodes: Sequence[int]
    width: int
    groups: int = 0
    loss: Column | None = None


def histograms(rows: DataFrame, requests: Sequence[Request]) -> DataFrame:
    """Gradient, Hessian and row sums per (model, node, feature, bin) for all requests (``model`` is the position of the request, ``feature`` the one in its ``bins``).

    Every task keeps one dense histogram per request and adds whole batches to it; only its cells that are not empty are merged by key, so what
    moves depends on models, nodes, features and bins and not on the row count. Node ``LOSS`` holds the sum and count of the known losses per group, in
    place of a pass of their own.
    """
    plans = [(list(r.bins), np.array(r.nodes), r.width, r.groups) for r in requests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((3, len(bins), len(nodes) * width)) for bins, nodes, width, _ in plans]
        losses = [np.zeros((2, groups)) for *_, groups in plans]
        for table in chunks(batches):
            for i, (bins, nodes, width, groups) in enumerate(plans):
                if groups:
                    loss, g = table.column(f"_loss{i}").to_numpy(), table.column("_g").to_numpy()
                    known = ~np.isnan(loss)
                    losses[i] += [np.bincount(g[known], loss[known], groups), np.bincount(g[known], minlength=groups)]
                at = np.full(int(max(nodes.max(), table.column(f"_node{i}").to_numpy().max())) + 1, -1)
                at[nodes] = np.arange(len(nodes))
                place = at[table.column(f"_node{i}").to_numpy()]
                mine = np.flatnonzero(place >= 0)
                if not len(mine):
                    continue
                grad, hess = (table.column(f"_{c}{i}").to_numpy()[mine] for c in ("grad", "hess"))
                base, size = place[mine] * width, len(nodes) * width
                for j, name in enumerate(bins):
                    cell = base + table.column(name).to_numpy()[mine]
                    totals[i][:, j] += [np.bincount(cell, grad, size), np.bincount(cell, hess, size), np.bincount(cell, minlength=size)]
        for i, (total, lost, (_, nodes, width, _)) in enumerate(zip(totals, losses, plans)):
            f, cell = np.nonzero(total[2])
            seen = np.flatnonzero(lost[1])
            count = len(f) + len(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, i), pa.int32()),
                    pa.array(np.r_[nodes[cell // max(width, 1)], np.full(len(seen), LOSS)].astype("int32")),
                    pa.array(np.r_[f, np.zeros(len(seen))].astype("int32")),
                    pa.array(np.r_[cell % max(width, 1), seen].astype("int32")),
                    pa.array(np.r_[total[0, f, cell], lost[0, seen]]),
                    pa.array(np.r_[total[1, f, cell], np.zeros(len(seen))]),
                    pa.array(np.r_[total[2, f, cell], lost[1, seen]].astype("int64")),
                ],
                names=["model", "node", "feature", "bin", "g", "h", "n"],
            )

    columns, bins = [], {}
    for i, r in enumerate(requests):
        columns += [r.node.cast("int").alias(f"_node{i}"), r.grad.cast("double").alias(f"_grad{i}"), r.hess.cast("double").alias(f"_hess{i}")]
        if r.groups:
            columns.append(F.coalesce(r.loss.cast("double"), F.lit(float("nan"))).alias(f"_loss{i}"))
            bins["_g"] = None
        bins |= dict.fromkeys(r.bins)
    cells = rows.select(*bins, *columns)
    # rows outside all asked nodes stay where they are; a pass over roots or losses needs every row
    if all(not r.groups and list(r.nodes) != [0] for r in requests):
        cells = cells.where(reduce(or_, [F.col(f"_node{i}").isin(list(map(int, r.nodes))) for i, r in enumerate(requests)]))
    merged = cells.mapInArrow(run, CELLS).groupBy("model", "node", "feature", "bin")
    return merged.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def dense_histograms(cells: pa.Table, nodes: Sequence[int], features: int, bins: int) -> dict[int, np.ndarray]:
    """The histograms as one ``(sum, feature, bin)`` array per node. Callers check ``nodes * features * bins`` first."""
    out = {i: np.zeros((3, features, bins)) for i in nodes}
    node, f, b, g, h, n = (cells.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h", "n"))
    for i in nodes:
        mine = node == i
        out[i][:, f[mine], b[mine]] = np.stack([g[mine], h[mine], n[mine]])
    return out


def _soft(g: Column, alpha: float) -> Column:
    """Soft threshold by the l1 penalty."""
    if not alpha:
        return g
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(alpha), F.lit(0.0))


@dataclass(frozen=True)
class Split:
    """Totals of a node and its best split; ``gain`` is None when no split is allowed."""

    total: tuple[float, float, int]
    gain: float | None = None
    feature: int = -1
    bin: int = -1
    left: tuple[float, float, int] = (0.0, 0.0, 0)


def best_split(cells: np.ndarray, p: "BoostParams") -> Split:
    """Best split of one node from its dense histogram; ties go to the lowest feature, then the lowest bin."""
    total = cells[:, 0, :].sum(axis=1)
    left = cells.cumsum(axis=2)
    right = total[:, None, None] - left

    def score(part: np.ndarray) -> np.ndarray:
        g = np.sign(part[0]) * np.maximum(np.abs(part[0]) - p.reg_alpha, 0.0)
        den = part[1] + p.reg_lambda
        return np.divide(g * g, den, out=np.zeros_like(g), where=den > 0)

    gain = 0.5 * (score(left) + score(right) - score(total))
    allowed = (np.minimum(left[2], right[2]) >= max(p.min_child_samples, 1)) & (np.minimum(left[1], right[1]) >= p.min_child_weight)
    gain = np.where(allowed & (gain > max(p.min_gain_to_split, MIN_GAIN)), gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    whole = (float(total[0]), float(total[1]), int(round(total[2])))
    if not np.isfinite(gain[f, b]):
        return Split(whole)
    return Split(whole, float(gain[f, b]), int(f), int(b), (float(left[0, f, b]), float(left[1, f, b]), int(round(left[2, f, b]))))


def best_splits(hist: DataFrame, p: "BoostParams") -> dict[int, Split]:
    """:func:`best_split` of many nodes on the executors, for histograms too large to gather.

    The windows run inside one (node, feature) and see at most one row per bin; one row per node reaches the driver.
    """
    key = Window.partitionBy("node", "feature")
    run = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}l": F.sum(c).over(run) for c in "ghn"} | {f"{c}t": F.sum(c).over(key) for c in "ghn"}
    t = hist.select("node", "feature", "bin", *[e.alias(k) for k, e in sums.items()])
    gr, hr, nr = (F.col(f"{c}t") - F.col(f"{c}l") for c in "ghn")

    def score(g: Column, h: Column) -> Column:
        soft = _soft(g, p.reg_alpha)
        return F.coalesce(ratio(soft * soft, F.when(h + p.reg_lambda > 0, h + p.reg_lambda)), F.lit(0.0))

    gain = 0.5 * (score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("gt"), F.col("ht")))
    allowed = (F.least(F.col("nl"), nr) >= max(p.min_child_samples, 1)) & (F.least(F.col("hl"), hr) >= p.min_child_weight)
    option = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "nl")
    usable = allowed & (gain > F.lit(max(p.min_gain_to_split, MIN_GAIN)))
    found = t.groupBy("node").agg(
        F.max(F.when(usable, option)).alias("best"), F.max_by(F.struct("gt", "ht", "nt"), -F.col("feature")).alias("total")
    )
    out = {}
    for node, best, total in found.collect():
        out[node] = Split(tuple(total)) if best is None else Split(tuple(total), best[0], -best[1], -best[2], tuple(best)[3:])
    return out


# ---- fitting ---------------------------------------------------------------------------------------------------------


@dataclass
class BoostParams:
    """Settings of the boosters.

    ``fair_weight`` (0..1) is the mass of the group weights. ``objective`` replaces the built-in one: a function of Columns
    ``(y, margin, scale) -> (grad, hess)``, where ``scale`` is ``n/n_g * mu[g]`` of the previous round. ``metric`` replaces the early-stopping
    loss: a function of the validation frame ``(_y, _g, _m)`` to a number, lower is better.
    """

    fairness_constraint: str = "equalized_loss"
    fair_weight: float = 0.5
    dual_learning: str = "optim"
    multiplier_learning_rate: float = 0.1
    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    min_gain_to_split: float = 0.0
    random_state: int = 0
    early_stopping_rounds: int = 10
    min_delta: float = 1e-5
    checkpoint_every: int = 10
    max_bins: int = MAX_BINS
    objective: Callable[[Column, Column, Column], tuple[Column, Column]] | None = None
    metric: Callable[[DataFrame], float] | None = None


@dataclass
class _Booster:
    """Common settings and losses of the four estimators; :func:`boost_together` fits them."""

    p: BoostParams
    kind: str
    fair: bool
    info: pd.DataFrame | None = field(default=None)

    def fit(
        self, df: DataFrame, features: Sequence[str], y: str = "y", g: str | None = "g", valid: DataFrame | None = None, binned: Binned | None = None
    ) -> BoostModel:
        """``g`` may be None for a plain booster, which has no use for groups and leaves them unread unless ``binned`` has them."""
        p, own = self.p, binned is None
        self._check()
        if not self.fair and (binned is None or binned.groups == ["all"]):
            g = None
        elif g is None:
            raise ValueError("a fair booster needs a group column")
        binned = binned or prepare(df, features, y, g, p.max_bins)
        held = binned.bin(valid, y, g) if valid is not None else None
        try:
            return boost_together([self], binned, held)[0]
        finally:
            if own:
                binned.unpersist()

    def _check(self) -> None:
        p = self.p
        if p.dual_learning not in DUAL_MODES:
            raise ValueError(f"unknown dual mode {p.dual_learning!r}; expected one of {DUAL_MODES}")
        if p.fairness_constraint not in CONSTRAINTS:
            raise ValueError(f"unknown constraint {p.fairness_constraint!r}; expected one of {CONSTRAINTS}")
        if self.kind == "regressor" and p.fairness_constraint != "equalized_loss":
            raise ValueError("the regressor only supports equalized_loss")
        if not 0 <= p.fair_weight <= 1:
            raise ValueError("fair_weight must lie in [0, 1]")

    def _start(self, rows: DataFrame) -> float:
        """Margin 0 for the fair objective; log-odds or mean for the plain one."""
        if self.fair or self.p.objective is not None:
            return 0.0
        mean = float(rows.agg(F.avg("_y")).first()[0])
        if self.kind == "regressor":
            return mean
        if not 0 < mean < 1:
            raise ValueError("a classifier needs both classes")
        return float(np.log(mean / (1 - mean)))

    def _row_loss(self, m: Column) -> Column:
        if self.kind == "regressor":
            return sq_loss("_y", m)
        return constraint_loss("_y", sigmoid(m), self.p.fairness_constraint)

    def _gradients(self, scale: Column, m: Column) -> tuple[Column, Column]:
        p = self.p
        if p.objective is not None:
            return p.objective(F.col("_y"), m, scale)
        lam = p.fair_weight if self.fair else 0.0
        if self.kind == "regressor":
            return (1 - lam + scale) * sq_grad("_y", m), (1 - lam + scale) * sq_hess()
        q = sigmoid(m)
        grad, hess = logloss_grad(F.col("_y"), q), logloss_hess(F.col("_y"), q)
        if not self.fair:
            return grad, hess
        kind = p.fairness_constraint
        return (
            (1 - lam) * grad + scale * constraint_grad("_y", q, kind),
            (1 - lam) * hess + scale * constraint_hess("_y", q, kind),
        )

    def _watch_loss(self, watch: DataFrame, groups: int) -> float:
        if self.p.metric is not None:
            return float(self.p.metric(watch))
        base = sq_loss("_y", F.col("_m")) if self.kind == "regressor" else logloss(F.col("_y"), sigmoid(F.col("_m")))
        by = watch.groupBy("_g").agg(F.sum(base).alias("s"), F.count(F.lit(1)).alias("n"))
        t = by.agg(F.sum("s") / F.sum("n"), F.max(F.col("s") / F.col("n"))).first()
        lam = self.p.fair_weight if self.fair else 0.0
        return (1 - lam) * t[0] + lam * (t[1] or 0.0)


@dataclass
class _Fit:
    """One booster on its way: its group weights, trees and the tree that grows; its margin is column ``_m<number>``."""

    booster: _Booster
    number: int
    binned: Binned
    init: float
    rng: random.Random
    mu: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    log: list = field(default_factory=list)
    growth: "_Growth | None" = None
    done: bool = False

    @property
    def margin(self) -> Column:
        return F.col(f"_m{self.number}")

    def start_tree(self, frame: DataFrame) -> DataFrame:
        """Choose features and set up the root; returns the frame with the value of each row's group where that takes a join."""
        b, p = self.booster, self.booster.p
        usable = [i for i, e in enumerate(self.binned.edges) if e]
        count = max(1, round(p.colsample_bytree * len(usable)))
        features = sorted(self.rng.sample(usable, count)) if count < len(usable) else usable
        scale: Column = F.lit(0.0)
        if b.fair:
            frame, scale = _scaled(frame, self.binned.sizes.sum() / self.binned.sizes * self.mu, f"_scale{self.number}")
        grad, hess = b._gradients(scale, self.margin)
        bins = max((len(self.binned.edges[f]) for f in features), default=0) + 2
        self.growth = _Growth(grad, hess, features, bins, len(self.binned.groups) if b.fair else 0, b._row_loss(self.margin))
        return frame

    def reweigh(self, t: int) -> None:
        """The next group weights from the losses that came with the root."""
        b, p, loss = self.booster, self.booster.p, self.growth.loss
        mu = dual_update(self.mu, loss, p.fair_weight, p.multiplier_learning_rate, p.dual_learning, b.kind == "classifier")
        top = float(np.nanmax(loss)) if not np.isnan(loss).all() else float("nan")
        self.log += [(t, str(name), float(loss[i]), float(mu[i]), top) for i, name in enumerate(self.binned.groups)]
        self.mu = mu

    def finish_tree(self) -> Tree | None:
        g = self.growth
        chosen = _best_first(g.nodes, self.booster.p.num_leaves) if g.features else []
        tree = _flatten(g.nodes, chosen, self.binned.edges, self.booster.p) if chosen else None
        if tree is None:
            self.done = True
        else:
            self.trees.append(tree)
        return tree


def boost_together(boosters: Sequence[_Booster], binned: Binned, held: DataFrame | None = None) -> list[BoostModel]:
    """Fit boosters on one binned table, round by round and level by level: a pass serves the trees of all of them.

    ``held`` (binned validation rows) is for a single booster, which it stops.
    """
    if held is not None and len(boosters) > 1:
        raise ValueError("validation rows are for a single booster")
    for b in boosters:
        b._check()
    spark_rows = binned.rows
    fits = []
    for j, b in enumerate(boosters):
        mu = np.full(len(binned.groups), b.p.fair_weight / len(binned.groups))
        fits.append(_Fit(b, j, binned, b._start(spark_rows), random.Random(b.p.random_state), mu))
    first = boosters[0]
    frame = spark_rows.withColumns({f"_m{f.number}": F.lit(f.init) for f in fits})
    watch = held.withColumn("_m0", F.lit(fits[0].init)).persist(StorageLevel.MEMORY_AND_DISK) if held is not None else None
    stop = EarlyStop(first.p.early_stopping_rounds, 1.0, first.p.min_delta, inclusive=True)
    cut = min(b.p.checkpoint_every for b in boosters)
    stale: list[DataFrame] = []
    tables: list[tuple[int, DataFrame]] = []
    for t in range(1, max((b.p.n_estimators for b in boosters), default=0) + 1):
        live = [f for f in fits if not f.done and t <= f.booster.p.n_estimators]
        if not live:
            break
        ready = frame
        for f in live:
            ready = f.start_tree(ready)
        wanted = {f.number: [0] for f in live}
        while wanted:
            _measure(ready, [f for f in live if f.number in wanted], wanted)
            if any(nodes == [0] for nodes in wanted.values()):
                for f in live:
                    if f.booster.fair:
                        f.reweigh(t)
            wanted = {f.number: nodes for f in live if f.growth.features and (nodes := _next_open(f.growth.nodes, f.booster.p))}
        # growing the trees has filled the cache of this frame, so the one before it can go
        for old in stale:
            old.unpersist()
        grown = {f.number: tree for f in live if (tree := f.finish_tree()) is not None}
        stale = [frame] if t > 1 else []
        if not grown:
            break
        frame = _advance(frame, grown, binned, t, cut, tables)
        if watch is not None:
            watch, old = _advance(watch, grown, binned, t, cut, tables), watch
            _, halt = stop.update(first._watch_loss(watch.withColumnRenamed("_m0", "_m"), len(binned.groups)))
            old.unpersist()
            if halt:
                break
    for old in [*stale, frame, *([watch] if watch is not None else [])]:
        old.unpersist()
    release(*[table for _, table in tables])
    out = []
    for f in fits:
        trees = f.trees
        if watch is not None and stop.best_round >= 0:  # the best round counts whether patience or the rounds ran out
            trees = trees[: stop.best_round + 1]
        f.booster.info = pd.DataFrame(f.log, columns=["round", "g", "loss", "mu", "epsilon"])
        out.append(BoostModel(f.booster.kind, binned.features, f.init, trees, f.booster.info))
    return out


def _advance(frame: DataFrame, trees: Mapping[int, Tree], binned: Binned, t: int, cut: int, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """Add the trees to the margins: a narrow projection, cached; lineage is cut every ``cut`` rounds."""
    out = frame.withColumns({f"_m{j}": F.col(f"_m{j}") + _value_expr(tree, binned.edges) for j, tree in trees.items()})
    if t % cut:
        return out.persist(StorageLevel.MEMORY_AND_DISK)
    kept = settle(out)
    # a lost partition goes back to the table of the latest cut, so those before the last two are not read again
    for made, old in [x for x in tables if x[0] < t - cut]:
        tables.remove((made, old))
        release(old)
    tables.append((t, kept))
    return kept.persist(StorageLevel.MEMORY_AND_DISK)


def _measure(frame: DataFrame, fits: Sequence[_Fit], wanted: Mapping[int, list[int]]) -> None:
    """Histograms and best splits of the ``wanted`` nodes of every booster, in one pass over the rows.

    While all histograms of a tree fit ``HISTOGRAM_CELLS``, only the smaller child of each split is summed: its sibling is the
    difference to the parent. Larger trees are searched on the executors, in a pass of their own, and every wanted node is summed.
    """
    requests, plans = [], []
    for f in fits:
        g, p = f.growth, f.booster.p
        nodes, names = g.nodes, [f"_b{i}" for i in g.features]
        node = _route_expr(nodes, 0)
        groups = g.groups if wanted[f.number] == [0] else 0
        if p.num_leaves * len(names) * g.bins > HISTOGRAM_CELLS:
            found = best_splits(histograms(frame, [Request(node, g.grad, g.hess, names, wanted[f.number], g.bins)]), p)
            _absorb(f, wanted[f.number], found)
            if groups:
                requests.append(Request(F.lit(1), g.grad, g.hess, [], [0], 0, groups, g.row_loss))
                plans.append((f, [], []))
            continue
        pairs = [(i, nodes[i].left, nodes[i].right) for i in sorted({nodes[w].parent for w in wanted[f.number]}) if i >= 0]
        pairs = [(i, *sorted(lr, key=lambda c: nodes[c].rows)) for i, *lr in pairs]  # noqa: B023
        summed = [low for _, low, _ in pairs] or [0]
        requests.append(Request(node, g.grad, g.hess, names, summed, g.bins, groups, g.row_loss))
        plans.append((f, summed, pairs))
    if not requests:
        return
    cells = histograms(frame, requests).toArrow()
    model = cells.column("model").to_numpy()
    for i, (f, summed, pairs) in enumerate(plans):
        g, mine = f.growth, cells.filter(pa.array(model == i))
        if requests[i].groups:
            g.loss = _loss_vector(mine, g.groups)
        if not g.features or not summed:
            continue
        g.store.update(dense_histograms(mine, summed, len(g.features), g.bins))
        for parent, low, high in pairs:
            rest = g.store.pop(parent) - g.store[low]
            g.store[high] = np.where(rest[2] > 0.5, rest, 0.0)
        _absorb(f, wanted[f.number], {w: best_split(g.store[w], f.booster.p) for w in wanted[f.number]})


def _absorb(f: _Fit, wanted: Sequence[int], found: Mapping[int, Split]) -> None:
    """Enter the splits found into the tree."""
    nodes, features, p = f.growth.nodes, f.growth.features, f.booster.p
    for i in wanted:
        node, split = nodes[i], found.get(i)
        node.known = True
        if split is None:
            continue
        if i == 0:
            node.grad, node.hess, node.rows = split.total
        if split.gain is None or 0 < p.max_depth <= node.depth:
            continue
        (gl, hl, nl) = split.left
        node.gain, node.feature, node.bin = split.gain, features[split.feature], split.bin
        node.left, node.right = len(nodes), len(nodes) + 1
        nodes[node.left] = Node(gl, hl, nl, node.depth + 1, i)
        nodes[node.right] = Node(node.grad - gl, node.hess - hl, node.rows - nl, node.depth + 1, i)


@dataclass
class _Growth:
    """A growing tree: what its rows are summed over, the nodes so far, and the histograms of nodes without children (``store``)."""

    grad: Column
    hess: Column
    features: list[int]
    bins: int
    groups: int
    row_loss: Column
    loss: np.ndarray | None = None
    nodes: dict[int, Node] = field(default_factory=lambda: {0: Node(0.0, 0.0, 0, 0)})
    store: dict[int, np.ndarray] = field(default_factory=dict)


def _loss_vector(cells: pa.Table, groups: int) -> np.ndarray:
    """Mean loss per group from the cells of node ``LOSS``; NaN for a group without a row under the constraint."""
    node, b, g, n = (cells.column(c).to_numpy() for c in ("node", "bin", "g", "n"))
    mine = node == LOSS
    out = np.full(groups, np.nan)
    out[b[mine]] = g[mine] / n[mine]
    return out


def _scaled(frame: DataFrame, scale: np.ndarray, name: str) -> tuple[DataFrame, Column]:
    """``frame`` with a Column of the value of each row's group: looked up in a literal array, or joined where that would bloat the plan."""
    if len(scale) <= LITERAL_GROUPS:
        return frame, F.get(F.array(*[F.lit(float(v)) for v in scale]), F.col("_g"))
    table = frame.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(scale)], f"_g int, {name} double")
    return frame.join(F.broadcast(table), "_g"), F.col(name)


def _best_first(nodes: dict[int, Node], num_leaves: int) -> list[int]:
    """Nodes split by the best-first order among the known gains."""
    heap = [(-nodes[0].gain, 0)] if nodes[0].gain is not None else []
    chosen = []
    while heap and len(chosen) < num_leaves - 1:
        _, i = heapq.heappop(heap)
        chosen.append(i)
        for child in (nodes[i].left, nodes[i].right):
            if nodes[child].gain is not None:
                heapq.heappush(heap, (-nodes[child].gain, child))
    return chosen


def _next_open(nodes: dict[int, Node], p: BoostParams) -> list[int]:
    """Unmeasured children of chosen splits, unless the tree is full and they could not be split anyway."""
    chosen = _best_first(nodes, p.num_leaves)
    if p.num_leaves <= 2:
        return []
    out = []
    for i in chosen:
        for child in (nodes[i].left, nodes[i].right):
            node = nodes[child]
            splittable = node.rows >= 2 * p.min_child_samples and (p.max_depth <= 0 or node.depth < p.max_depth)
            if not node.known and splittable:
                out.append(child)
            elif not splittable:
                node.known = True
    return out


def _route_expr(nodes: dict[int, Node], i: int) -> Column:
    """Explored node a binned row falls into, as one nested CASE."""

    def at(i: int) -> str:
        n = nodes[i]
        return str(i) if n.left < 0 else f"CASE WHEN _b{n.feature} <= {n.bin} THEN {at(n.left)} ELSE {at(n.right)} END"

    return F.expr(at(i))


def _flatten(nodes: dict[int, Node], chosen: list[int], edges: list[list[float]], p: BoostParams) -> Tree:
    split = set(chosen)
    order: list[int] = []
    stack = [0]
    while stack:
        i = stack.pop(0)
        order.append(i)
        if i in split:
            stack += [nodes[i].left, nodes[i].right]
    at = {i: k for k, i in enumerate(order)}

    def value(n: Node) -> float:
        g = np.sign(n.grad) * max(abs(n.grad) - p.reg_alpha, 0.0)
        den = n.hess + p.reg_lambda
        return float(-g / den * p.learning_rate) if den > 0 else 0.0

    rows = []
    for i in order:
        n = nodes[i]
        if i in split:
            rows.append((n.feature, _threshold(edges[n.feature], n.bin), at[n.left], at[n.right], 0.0))
        else:
            rows.append((-1, float("nan"), -1, -1, value(n)))
    return Tree(*[tuple(c) for c in zip(*rows)])


def _threshold(edges: list[float], bin_id: int) -> float:
    """Upper edge of a bin; infinite for the last one, after which only missing values follow."""
    return float(edges[bin_id]) if bin_id < len(edges) else float("inf")


def _value_expr(tree: Tree, edges: list[list[float]]) -> Column:
    """Leaf value of a tree on binned rows, as one nested CASE."""

    def at(i: int) -> str:
        f = tree.feature[i]
        if f < 0:
            return f"{tree.value[i]!r}D"
        last = len(edges[f]) if tree.threshold[i] == float("inf") else edges[f].index(tree.threshold[i])
        return f"CASE WHEN _b{f} <= {last} THEN {at(tree.left[i])} ELSE {at(tree.right[i])} END"

    return F.expr(at(0))


def _params(defaults: dict, given: dict) -> BoostParams:
    return replace(BoostParams(**defaults), **given)


class MinMaxBoostClassifier(_Booster):
    """Boosted classifier whose group weights follow the worst group loss."""

    def __init__(self, **params):
        super().__init__(_params({}, params), "classifier", True)


class MinMaxBoostRegressor(_Booster):
    """Boosted regressor on squared loss, protecting the group with the largest error."""

    def __init__(self, **params):
        super().__init__(_params({}, params), "regressor", True)


class BoostClassifier(_Booster):
    """Plain boosted classifier, started at the log-odds."""

    def __init__(self, **params):
        super().__init__(_params({"fair_weight": 0.0, "min_delta": 1e-4}, params), "classifier", False)


class BoostRegressor(_Booster):
    """Plain boosted regressor, started at the mean."""

    def __init__(self, **params):
        super().__init__(_params({"fair_weight": 0.0, "min_delta": 1e-4}, params), "regressor", False)


__all__ = [
    "Binned",
    "BoostClassifier",
    "BoostModel",
    "BoostParams",
    "BoostRegressor",
    "MinMaxBoostClassifier",
    "MinMaxBoostRegressor",
    "Tree",
    "best_split",
    "Request",
    "best_splits",
    "boost_together",
    "dense_histograms",
    "histograms",
    "prepare",
    "score_models",
]
