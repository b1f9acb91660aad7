"""Prediction with lineages kept apart: folds, models for censored values and for extreme classes, nested cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from .censored import MAX_LOG_SIGMA, Outcome

# Registered settings.
OUTER, INNER, TOP_K, L2_GRID, C_GRID, L1_RATIO = 5, 3, 200, (0.1, 1.0, 10.0, 100.0), (0.01, 0.1, 1.0), 0.5


def interval_mae(prediction: str, low: str, high: str) -> Column:
    """An aggregate: mean distance of predictions from intervals, 0 inside."""
    p = F.col(prediction)
    return F.avg(F.greatest(F.col(low) - p, p - F.col(high), F.lit(0.0)))


def blocked_folds(groups: DataFrame, group: str, n_folds: int) -> DataFrame:
    """group, fold: groups by falling size (ties by name), each into the fold with the fewest rows so far (the first on a tie)."""
    sizes = groups.groupBy(F.col(group).cast("string").alias(group)).count().orderBy(F.desc("count"), group).collect()  # one row a lineage
    if len(sizes) < n_folds:
        raise ValueError(f"{n_folds} folds need as many lineages, there are {len(sizes)}")
    load, rows = [0] * n_folds, []
    for name, n in sizes:
        fold = load.index(min(load))
        load[fold] += n
        rows.append((name, fold))
    return groups.sparkSession.createDataFrame(rows, f"{group} string, fold int")


def random_folds(rows: DataFrame, key: str, n_folds: int, seed: int = 0) -> DataFrame:
    """rows and fold: folds of near equal size by a hash of the key."""
    from .ranks import numbered

    return numbered(rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), "_h", key, name="_n").withColumn("fold", ((F.col("_n") - 1) % n_folds).cast("int")).drop("_h", "_n")


def ranked(x: np.ndarray) -> np.ndarray:
    """Mean ranks of each column."""
    return pd.DataFrame(x).rank(axis=0).to_numpy()


def screened(x: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest rank correlations with code, by size and then place."""
    a, b = ranked(x), ranked(np.asarray(code, float)[:, None])[:, 0]
    a, b = a - a.mean(axis=0), b - b.mean()
    size = np.sqrt((a * a).sum(axis=0) * (b @ b))
    with np.errstate(all="ignore"):
        r = np.where(size > 0, b @ a / size, 0.0)
    return np.argsort(-np.abs(r), kind="stable")[:k]


def area(y: np.ndarray, score: np.ndarray) -> float:
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return float("nan")
    r = ranked(score[:, None])[:, 0]
    return float((r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def alone(climb, at):
    """What a search finds that yields points and is sent their values."""
    point = next(climb)
    while True:
        try:
            point = climb.send(at(point))
        except StopIteration as end:
            return end.value


def newton(point: np.ndarray, close: float, steps: int = 100, least: float = -np.inf):
    """A search for a maximum by Newton steps with halving: yields points, is sent (value, gradient, Hessian), returns the last.

    It also ends where the last number of the point falls under `least`: a log sigma that far down has no maximum above it.
    """
    value, grad, hess = yield point
    for _ in range(steps):
        if np.abs(grad).max() < close or point[-1] < least:
            break
        values, vectors = np.linalg.eigh(-hess)
        step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-8))
        size = 1.0
        while size > 1e-8:
            new = yield point + size * step
            if np.isfinite(new[0]) and new[0] >= value:
                break
            size /= 2
        else:
            break
        point, (value, grad, hess) = point + size * step, new
    return point


def tobit_start(k: int, mean: float, deviation: float) -> np.ndarray:
    """Intercept, k coefficients and log sigma of a model of guesses (Outcome.guess) that are all at their mean."""
    return np.array([mean, *np.zeros(k), np.log(max(deviation, 1e-2))])


def tobit_scaled(p: np.ndarray) -> tuple[np.ndarray, float]:
    """The coefficients over sigma, and 1 over sigma, in which likelihoods add up."""
    theta = np.exp(-np.clip(p[-1], -300, 300))  # a search may try a sigma that no number holds
    return p[:-1] * theta, theta


def tobit_penalised(p: np.ndarray, likelihood: tuple, l2: float) -> tuple:
    """Value, gradient and Hessian in coefficients and log sigma, less half l2 times the squared coefficients but the intercept."""
    value, grad, hess = likelihood
    k = len(p) - 1
    sigma, beta = np.exp(p[k]), p[:k]
    weight = np.full(k, float(l2))
    weight[0] = 0
    turn = np.zeros((k + 1, k + 1))
    turn[:k, :k], turn[:k, k], turn[k, k] = np.eye(k) / sigma, -beta / sigma, -1 / sigma
    curve = turn.T @ hess @ turn
    curve[:k, k] -= grad[:k] / sigma
    curve[k, :k] -= grad[:k] / sigma
    curve[k, k] += grad[:k] @ beta / sigma + grad[k] / sigma
    grad = turn.T @ grad
    grad[:k] -= weight * beta
    curve[np.arange(k), np.arange(k)] -= weight
    return value - 0.5 * float(weight @ (beta * beta)), grad, curve


def ridge_tobit(x: np.ndarray, y: Outcome, l2: float, steps: int = 100) -> np.ndarray:
    """Intercept, coefficients and log sigma that maximise the censored likelihood less half l2 times the squared coefficients."""
    a = np.column_stack([np.ones(len(x)), x])
    guess = y.guess()

    def at(p: np.ndarray):
        with np.errstate(all="ignore"):
            return tobit_penalised(p, y.derivatives(*tobit_scaled(p), a), l2)

    return alone(newton(tobit_start(x.shape[1], guess.mean(), guess.std()), 1e-7 * len(x), steps, -MAX_LOG_SIGMA), at)


def net_residual(b: np.ndarray, slope: np.ndarray, l1: float) -> float:
    """How far (b, slope of the loss) is from a minimum with penalties l1 and half (1 - l1) squared, but on the intercept."""
    whole = slope[1:] + (1 - l1) * b[1:]
    off = np.where(b[1:] != 0, np.abs(whole + l1 * np.sign(b[1:])), np.maximum(np.abs(whole) - l1, 0))
    return float(max(abs(slope[0]), off.max(initial=0)))


def net_step(b: np.ndarray, slope: np.ndarray, hess: np.ndarray, l1: float, sweeps: int = 300) -> np.ndarray:
    """Where the quadratic model of the loss at b and the penalties have their minimum, or near it, by one coordinate after another."""
    curve = hess + np.diag([1e-12, *np.full(len(b) - 1, 1 - l1)])
    linear = slope - hess @ b
    new, pull = b.copy(), curve @ b
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            free = curve[j, j] * new[j] - pull[j] - linear[j]
            to = free / curve[j, j] if j == 0 else np.sign(free) * max(abs(free) - l1, 0.0) / curve[j, j]
            if (change := to - new[j]) != 0:
                pull += curve[:, j] * change
                new[j] = to
                most = max(most, abs(change))
        if most < 1e-10 * max(1.0, np.abs(new).max()):
            break
    return new


def net_search(b: np.ndarray, l1: float = L1_RATIO, close: float = 1e-8, steps: int = 200):
    """A search for an elastic net by proximal Newton steps with halving; is sent (loss, slope, Hessian), returns coefficients."""
    cost = lambda x: l1 * np.abs(x[1:]).sum() + 0.5 * (1 - l1) * (x[1:] @ x[1:])
    loss, slope, hess = yield b
    for _ in range(steps):
        if net_residual(b, slope, l1) < close:
            break
        step = net_step(b, slope, hess, l1) - b
        promised = slope @ step + cost(b + step) - cost(b)
        size = 1.0
        while size > 1e-10:
            new = yield b + size * step
            if new[0] + cost(b + size * step) <= loss + cost(b) + 1e-4 * size * promised + 1e-13 * abs(loss):
                break
            size /= 2
        else:
            break
        b, (loss, slope, hess) = b + size * step, new
    return b


def net_loss(a: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss, its slope and its Hessian; these add up over rows."""
    eta = a @ b
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    return float(w @ (np.logaddexp(0, eta) - y * eta)), a.T @ (w * (p - y)), (a * (w * p * (1 - p))[:, None]).T @ a


def class_weights(n0: float, n1: float) -> tuple[float, float]:
    return (n0 + n1) / (2 * max(n0, 1)), (n0 + n1) / (2 * max(n1, 1))


def elastic_net(x: np.ndarray, y: np.ndarray, c: float, l1: float = L1_RATIO, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of a logistic model with classes of equal weight: c times the loss, and l1 and l2 penalties."""
    w = c * np.where(y == 1, *class_weights((y == 0).sum(), (y == 1).sum())[::-1])
    a = np.column_stack([np.ones(len(x)), x])
    b = alone(net_search(np.zeros(a.shape[1]) if start is None else start, l1), lambda p: net_loss(a, y, w, p))
    return float(b[0]), b[1:]


@dataclass(frozen=True)
class Cohort:
    """Samples in one order: features x, bounds, ordinal code, extreme class (NaN: none), lineage."""

    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    code: np.ndarray
    lineage: np.ndarray

    def rows(self, keep: np.ndarray) -> Cohort:
        return Cohort(self.x[keep], self.low[keep], self.high[keep], self.code[keep], self.lineage[keep])

    def extreme(self) -> np.ndarray:
        """0 for upper bounds under every lower bound, 1 for lower bounds over all of those, NaN for the rest."""
        left, right = np.isneginf(self.low), np.isposinf(self.high)
        out = np.full(len(self.low), np.nan)
        if left.any() and right.any():
            low = left & (self.high < self.low[right].min())
            if low.any():
                out[low] = 0
                out[right & (self.low > self.high[low].max())] = 1
        return out


def packed_folds(lineage: np.ndarray, n_folds: int) -> np.ndarray:
    names, counts = np.unique(lineage.astype(str), return_counts=True)
    if len(names) < n_folds:
        raise ValueError(f"{n_folds} folds need as many lineages, there are {len(names)}")
    load, fold = [0] * n_folds, {}
    for i in np.lexsort((names, -counts)):
        at = load.index(min(load))
        fold[names[i]], load[at] = at, load[at] + counts[i]
    return np.array([fold[x] for x in lineage.astype(str)])


def inner_folds(train: Cohort, blocked: bool, n_folds: int, seed: int) -> np.ndarray:
    return packed_folds(train.lineage, n_folds) if blocked else np.random.default_rng(seed).permutation(np.arange(len(train.x)) % n_folds)


def evaluate(train: Cohort, test: Cohort, blocked: bool = True, seed: int = 0, top_k: int = TOP_K, n_inner: int = INNER) -> tuple[dict, np.ndarray, np.ndarray]:
    """Settings chosen on train alone by inner folds, models fitted on all of it, and their figures on test."""
    chosen = screened(train.x, train.code, top_k)
    a, b = train.x[:, chosen], test.x[:, chosen]
    inner = inner_folds(train, blocked, n_inner, seed)
    parts = [(inner != f, inner == f) for f in range(n_inner) if (inner == f).any() and (inner != f).any()]

    def distance(model: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
        p = model[0] + x @ model[1:-1]
        return float(np.maximum(np.maximum(low - p, p - high), 0).mean())

    def inner_error(l2: float) -> float:
        return float(np.mean([distance(ridge_tobit(a[t], Outcome(train.low[t], train.high[t]), l2), a[v], train.low[v], train.high[v]) for t, v in parts]))

    l2 = min(L2_GRID, key=inner_error)
    model = ridge_tobit(a, Outcome(train.low, train.high), l2)
    y, z = train.extreme(), test.extreme()
    known, seen = ~np.isnan(y), ~np.isnan(z)
    score = model[0] + b @ model[1:-1]
    out = {"ridge_tobit_l2": l2, "interval_mae": distance(model, b, test.low, test.high), "tobit_extreme_auc": area(z[seen], score[seen])}
    out |= {"enet_C": None, "enet_extreme_auc": float("nan"), "n_train_extreme": int(known.sum()), "n_test_extreme": int(seen.sum())}
    coefficients = np.zeros(len(chosen))
    if len(np.unique(y[known])) == 2:
        usable = [(t & known, v & known) for t, v in parts]
        usable = [(t, v) for t, v in usable if len(np.unique(y[t])) == len(np.unique(y[v])) == 2]

        def inner_area(c: float) -> float:
            fits = [(elastic_net(a[t], y[t], c), v) for t, v in usable]
            return float(np.mean([area(y[v], b0 + a[v] @ w) for (b0, w), v in fits]))

        if usable:
            c = max(C_GRID, key=inner_area)
            b0, coefficients = elastic_net(a[known], y[known], c)
            out |= {"enet_C": c, "enet_extreme_auc": area(z[seen], (b0 + b @ coefficients)[seen])}
    return out, chosen, coefficients


FOLD = "fold int, ridge_tobit_l2 double, interval_mae double, tobit_extreme_auc double, enet_C double, enet_extreme_auc double, n_train_extreme long, n_test_extreme long, n_train long, n_test long, n_test_lineages long, lineage_overlap_train_test long, chosen array<int>, coefficients array<double>"


def cross_validated(spark, cohort: Cohort, blocked: bool = True, seed: int = 0, n_folds: int = OUTER) -> DataFrame:
    """A row a fold: figures of models that were chosen and fitted without it. Folds are tasks; the cohort goes to each.

    blocked: whole lineages are held out. Random folds show how much shared lineages leak, and are no estimate.
    """
    ship(spark)
    outer = packed_folds(cohort.lineage, n_folds) if blocked else np.random.default_rng(seed).permutation(np.arange(len(cohort.x)) % n_folds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf.fold.iloc[0])
        test = outer == f
        figures, chosen, coefficients = evaluate(cohort.rows(~test), cohort.rows(test), blocked, seed)
        a, b = set(cohort.lineage[test].tolist()), set(cohort.lineage[~test].tolist())
        figures |= {"fold": f, "n_train": int((~test).sum()), "n_test": int(test.sum()), "n_test_lineages": len(a), "lineage_overlap_train_test": len(a & b)}
        return pd.DataFrame([figures | {"chosen": chosen.tolist(), "coefficients": coefficients.tolist()}])[[c.split()[0] for c in FOLD.split(", ")]]

    folds = spark.createDataFrame([(int(f),) for f in range(n_folds) if (outer == f).any()], "fold int")
    return folds.groupBy("fold").applyInPandas(run, FOLD)


def importance(folds: DataFrame, names: list[str]) -> DataFrame:
    """feature_id, selected_in_n_folds, mean_enet_coefficient, rank_in_model: use for prediction, which isn't cause."""
    n = folds.count()
    each = folds.select(F.explode(F.arrays_zip("chosen", "coefficients")).alias("x")).groupBy("x.chosen").agg(F.count(F.lit(1)).alias("selected_in_n_folds"), (F.sum("x.coefficients") / n).alias("mean_enet_coefficient"))
    feature = F.get(F.array(*[F.lit(x) for x in names]), F.col("chosen"))
    order = Window.orderBy(F.desc("selected_in_n_folds"), F.desc("mean_enet_coefficient"), "chosen")  # at most TOP_K rows a fold
    return each.select(feature.alias("feature_id"), "selected_in_n_folds", "mean_enet_coefficient", F.row_number().over(order).alias("rank_in_model"))
