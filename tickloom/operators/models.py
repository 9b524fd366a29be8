"""Weighted models: prior, scaling, logistic, small networks, interval bootstrap, inference and importance."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.folds import purged
from tickloom.operators.stats import clipped_loss, logistic
from tickloom.session import written


def weighted_prior(rows: DataFrame, by: list[str], y: str, w: str) -> DataFrame:
    return rows.where(f"{y} is not null and {w} > 0").groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("prior"))


@dataclass(frozen=True)
class LogisticState:
    """Everything inference needs; scales of constant columns are one."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    facts: dict = field(default_factory=dict, compare=False)

    def logit(self) -> Column:
        """The score as one SQL expression: it stays in the JVM and costs no Python."""
        z = F.lit(self.intercept)
        for c, m, s, b in zip(self.columns, self.mean, self.scale, self.coef):
            z = z + (F.col(c) - m) / s * b
        return z

    def probability(self) -> Column:
        return logistic(self.logit())


def _gram(columns: tuple[str, ...], theta: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Each partition's share of loss, gradient and Hessian: d * d numbers, whatever its rows."""

    def run(batches):
        d = len(columns) + 1
        total = np.zeros(1 + d + d * d)
        for b in batches:
            if not b.num_rows:
                continue
            X = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d - 1)] or [np.zeros((b.num_rows, 0))])
            X = np.column_stack(((X - mean) / scale, np.ones(b.num_rows)))
            y, w = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (d - 1, d))
            z = X @ theta
            p = 1 / (1 + np.exp(-np.clip(z, -709, 709)))
            total[0] += float(np.sum(w * (np.logaddexp(0, z) - y * z)))
            total[1 : 1 + d] += X.T @ (w * (p - y))
            total[1 + d :] += ((X * (w * p * (1 - p))[:, None]).T @ X).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    return run


def fit_logistic(rows: DataFrame, columns: list[str], y: str = "y", w: str = "w", *, C: float = 1.0, rounds: int = 50, tol: float = 1e-9) -> LogisticState:
    """L2-penalised logistic regression on weighted, standardised columns; the intercept is free.

    Newton's method: a round is one pass in which every partition sends d*d sums, which are
    added up by a shuffle on their index before the (d*d) totals reach the driver, so nothing
    that grows with the data does. Rows with nulls or no weight are left out. Raises if it has
    not converged after ``rounds``.
    """
    columns = list(columns)
    use = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias(y), F.col(w).cast("double").alias(w)).dropna().where(f"{w} > 0")
    use = written(use, "fit")  # every round reads it: columnar once, instead of its lineage each time
    wm = lambda e: F.sum(F.col(w) * e) / F.sum(w)
    first = use.agg(F.count("*").alias("n"), F.sum(w).alias("W"), *[wm(F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if not first.n:
        raise ValueError("no rows to fit")
    mean = np.array([first[f"m{i}"] for i in range(len(columns))])
    var = use.agg(*[wm((F.col(c) - float(m)) * (F.col(c) - float(m))).alias(f"v{i}") for i, (c, m) in enumerate(zip(columns, mean))]).first() if columns else []
    scale = np.sqrt(np.maximum(np.array(list(var), dtype=float), 0))
    scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0  # constant, but for rounding of the mean
    d = len(columns) + 1
    theta = np.zeros(d)
    penalty = np.append(np.full(d - 1, 1 / C), 0.0)
    done = 0
    for done in range(1, rounds + 1):
        sums = use.mapInArrow(_gram(tuple(columns), theta, mean, scale), "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
        v = np.zeros(1 + d + d * d)
        for r in sums.collect():  # d * d + d + 1 rows
            v[r.k] = r.v
        grad = v[1 : 1 + d] + penalty * theta
        hess = v[1 + d :].reshape(d, d) + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-12 * np.eye(d), grad)
        theta = theta - step
        if np.max(np.abs(step)) < tol:
            break
    else:
        raise ValueError(f"not converged after {rounds} rounds")
    return LogisticState(tuple(columns), tuple(mean), tuple(scale), tuple(theta[:-1]), float(theta[-1]), {"rows": first.n, "weight": first.W, "rounds": done})


def _pair_sums(d: int, theta: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Each partition's share of the gradient (2) and Hessian (3) of every column's own fit: 5 d numbers."""

    def run(batches):
        total = np.zeros((5, d))
        for b in batches:
            if b.num_rows:
                x = (b.column(0).flatten().to_numpy().reshape(b.num_rows, d) - mean) / scale
                y, w = (b.column(i).to_numpy()[:, None] for i in (1, 2))
                p = 1 / (1 + np.exp(-np.clip(x * theta[0] + theta[1], -709, 709)))
                g, h = w * (p - y), w * p * (1 - p)
                total += np.stack([(g * x).sum(0), g.sum(0), (h * x * x).sum(0), (h * x).sum(0), h.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(5 * d, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

    return run


def fit_each(rows: DataFrame, columns: list[str], y: str = "y", w: str = "w", *, C: float = 1.0, rounds: int = 50, tol: float = 1e-10) -> dict[str, LogisticState]:
    """A logistic fit on every column alone, all in the same passes: Newton's method on two numbers a column.

    A round sends 5 sums a column and partition, added up before they reach the driver. Raises
    if a column has not converged after ``rounds``.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    use = rows.select(x, F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w")).where("_y is not null and _w > 0").where(~F.exists("_x", lambda v: v.isNull()))
    use = written(use, "fit")
    d = len(columns)
    part = use.select("_w", F.posexplode("_x").alias("k", "v")).groupBy("k").agg(F.sum("_w").alias("W"), (F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("m"), F.var_pop("v").alias("s"))
    facts = {r.k: r for r in part.collect()}  # a row a column
    if not facts:
        raise ValueError("no rows to fit")
    mean, scale = np.array([facts[i].m for i in range(d)]), np.sqrt(np.array([facts[i].s for i in range(d)]))
    scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0
    theta = np.zeros((2, d))
    for _ in range(rounds):
        v = np.zeros(5 * d)
        for r in use.mapInArrow(_pair_sums(d, theta, mean, scale), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 5 d rows
            v[r.k] = r.v
        gx, g1, hxx, hx1, h11 = v.reshape(5, d)
        gx, hxx = gx + theta[0] / C, hxx + 1 / C
        det = hxx * h11 - hx1 * hx1
        move = np.stack([(h11 * gx - hx1 * g1) / det, (hxx * g1 - hx1 * gx) / det])
        theta = theta - move
        if np.abs(move).max() < tol:
            return {c: LogisticState((c,), (mean[i],), (scale[i],), (theta[0, i],), float(theta[1, i])) for i, c in enumerate(columns)}
    raise ValueError(f"not converged after {rounds} rounds")


def single_importance(rows: DataFrame, folds: list[tuple[int, int, int]], columns: list[str], *, start: str, info_end: str, y: str = "y", w: str = "w", buffer_s: int = 14_460) -> DataFrame:
    """``(feature, fold, gain)``: how much less the test rows' loss is by a fit on the column alone than by the weighted prior.

    Folds are those of ``walk_forward``; one whose training rows lack a class has null gains.
    """
    rows = written(rows.select(start, info_end, y, w, *columns), "folds")
    out = None
    for fold, boundary, stop in folds:
        part = rows.withColumn("_role", purged(F.col(start), F.col(info_end), F.lit(boundary), F.lit(stop), buffer_s))
        train, yc = part.where("_role = 'train'"), F.col(y).cast("double")
        have = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("prior")).first()
        states = fit_each(train, columns, y, w) if min(have.p, have.n) else {}
        gain = lambda c: F.avg(clipped_loss(yc, F.lit(have.prior)) - clipped_loss(yc, states[c].probability())) if states else F.lit(None).cast("double")  # noqa: B023, E731
        wide = part.where("_role = 'test'").agg(*[gain(c).alias(c) for c in columns])
        one = wide.unpivot([], columns, "feature", "gain").select("feature", F.lit(fold).alias("fold"), "gain")
        out = one if out is None else out.unionByName(one)
    return out


def walk_forward(rows: DataFrame, folds: list[tuple[int, int, int]], columns: list[str], *, start: str, info_end: str, y: str = "y", w: str = "w", buffer_s: int = 14_460) -> DataFrame:
    """Scores of each fold's test rows by a model fitted on the rows purged before it, beside the weighted prior.

    ``folds`` are ``(fold, boundary, stop)`` in epoch seconds. A fold whose training rows lack a
    class is reported with the reason and null scores: unknown is not zero.
    """
    rows = written(rows.select(start, info_end, y, w, *columns), "folds")  # each fold reads it several times
    out = None
    for fold, boundary, stop in folds:
        side = purged(F.col(start), F.col(info_end), F.lit(boundary), F.lit(stop), buffer_s)
        part = rows.withColumn("_role", side)
        train, test = part.where("_role = 'train'"), part.where("_role = 'test'")
        have = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("prior")).first()
        if min(have.p, have.n):
            p, reason = fit_logistic(train, columns, y, w).probability(), None
        else:
            p, reason = F.lit(None).cast("double"), "no_positives" if have.n else "no_negatives" if have.p else "empty"
        yc = F.col(y).cast("double")
        x = test.select(yc.alias("_y"), p.alias("_p"))
        one = x.agg(
            F.lit(fold).alias("fold"), F.lit(have.p + have.n).cast("bigint").alias("train_rows"), F.count("*").alias("test_rows"),
            F.avg(clipped_loss(F.col("_y"), F.col("_p"))).alias("log_loss"), F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("brier"),
            F.avg(clipped_loss(F.col("_y"), F.lit(have.prior))).alias("prior_log_loss"), F.lit(reason).cast("string").alias("reason"),
        )
        out = one if out is None else out.unionByName(one)
    return out


class AdamNet:
    """One hidden layer, logistic output, Adam on mini-batches, an exact number of updates."""

    def __init__(self, hidden: int, seed: int, lr: float = 1e-3, alpha: float = 1e-4, batch: int = 200):
        self.hidden, self.lr, self.alpha, self.batch, self.rng = hidden, lr, alpha, batch, np.random.default_rng(seed)

    def fit(self, X: np.ndarray, y: np.ndarray, w: np.ndarray, updates: int, after=None) -> AdamNet:
        """``after`` is called with the net at the end of each pass over the rows."""
        self.mean = np.average(X, axis=0, weights=w)
        scale = np.sqrt(np.average((X - self.mean) ** 2, axis=0, weights=w))
        self.scale = np.where(scale == 0, 1.0, scale)
        X = (X - self.mean) / self.scale
        d, h = X.shape[1], self.hidden
        glorot = lambda a, b, k: self.rng.uniform(-np.sqrt(k / (a + b)), np.sqrt(k / (a + b)), (a, b))
        self.p = [glorot(d, h, 6.0), np.zeros(h), glorot(h, 1, 2.0), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        self.losses, t = [], 0
        while t < updates:
            order = self.rng.permutation(len(X))
            for at in range(0, len(X), self.batch):
                if t == updates:
                    break
                i = order[at : at + self.batch]
                n = len(i)
                a = X[i] @ self.p[0] + self.p[1]
                r = np.maximum(a, 0)
                z = (r @ self.p[2] + self.p[3]).ravel()
                q = 1 / (1 + np.exp(-np.clip(z, -709, 709)))
                self.losses.append(float(np.sum(w[i] * (np.logaddexp(0, z) - y[i] * z)) / n))
                g = (w[i] * (q - y[i]))[:, None] / n
                back = (g @ self.p[2].T) * (a > 0)
                grads = [X[i].T @ back + self.alpha * self.p[0] / n, back.sum(0), r.T @ g + self.alpha * self.p[2] / n, g.sum(0)]
                t += 1
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    self.p[k] = self.p[k] - self.lr * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-8)
            if after is not None:
                after(self)
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        r = np.maximum(((X - self.mean) / self.scale) @ self.p[0] + self.p[1], 0)
        return 1 / (1 + np.exp(-np.clip((r @ self.p[2] + self.p[3]).ravel(), -709, 709)))


def _known(rows: DataFrame, population: str, columns: list[str], y: str, w: str, *more: Column) -> DataFrame:
    """Labelled rows ``(population, _x, _y, _w)`` without nulls; the columns are one array, so that plans stay small however many there are."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    use = rows.select(F.col(population).cast("string").alias("population"), x, F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w"), *more)
    return use.where("population is not null and _w > 0 and _y in (0, 1)").where(~F.exists("_x", lambda v: v.isNull()))


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("_x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _bounded(use: DataFrame, sample_rows: int) -> DataFrame:
    """Whole buckets of 4,096 in hashed order, to about ``sample_rows`` rows a population."""
    use = use.withColumn("_h", F.pmod(F.xxhash64("_x", "_y"), F.lit(4096)))
    sizes = use.groupBy("population", "_h").agg(F.count("*").alias("_c"))
    run_c = F.sum("_c").over(W.partitionBy("population").orderBy("_h").rowsBetween(W.unboundedPreceding, 0))
    sizes = sizes.withColumn("_r", run_c).where(f"_r <= {sample_rows} or _r = _c").select("population", "_h")
    return use.join(sizes, ["population", "_h"]).drop("_h")


def _weighted_loss(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(np.average(-(y * np.log(p) + (1 - y) * np.log1p(-p)), weights=w))


def fit_ensembles(rows: DataFrame, population: str, order: str, columns: list[str], y: str, w: str, *, seeds: list[int], epochs: int = 8, hidden: int = 16, sample_rows: int = 200_000) -> DataFrame:
    """Per population: how many passes over the rows to train for, and the mean of networks of several seeds.

    The last fifth of the rows in order is held out; the number of passes with the least mean loss
    there, over the seeds, is chosen, and each seed is fitted anew to all rows for so many. A population
    whose first four fifths or whose last lack a class is given the ``reason`` and no fit. Training rows
    are bounded as in ``fit_networks``.
    """
    use = _known(rows, population, columns, y, w, F.col(order).alias("_o"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        X = _matrix(t)
        yv, wv, n = t.column("_y").to_numpy(), t.column("_w").to_numpy(), t.num_rows
        cut, best, inner, loss, reason = n - n // 5, None, None, None, None
        if len(set(yv[:cut])) < 2 or len(set(yv[cut:])) < 2:
            reason = "class_missing"
        else:
            tried = np.zeros((len(seeds), epochs))
            for i, seed in enumerate(seeds):
                seen: list[float] = []
                passes = -(-cut // AdamNet(hidden, seed).batch)
                AdamNet(hidden, seed).fit(X[:cut], yv[:cut], wv[:cut], epochs * passes, lambda net: seen.append(_weighted_loss(yv[cut:], net.predict(X[cut:]), wv[cut:])))  # noqa: B023
                tried[i] = seen
            best = int(tried.mean(axis=0).argmin()) + 1
            inner = float(tried.mean(axis=0)[best - 1])
            whole = best * -(-n // AdamNet(hidden, 0).batch)
            mean = np.mean([AdamNet(hidden, s).fit(X, yv, wv, whole).predict(X) for s in seeds], axis=0)
            loss = _weighted_loss(yv, mean, wv)
        name = t.column("population")[0].as_py()
        return pa.table({"population": [name], "n": pa.array([n], pa.int64()), "epochs": pa.array([best], pa.int32()), "inner_loss": pa.array([inner], pa.float64()), "loss": pa.array([loss], pa.float64()), "reason": pa.array([reason], pa.string())})

    return _bounded(use, sample_rows).groupBy("population").applyInArrow(run, "population string, n bigint, epochs int, inner_loss double, loss double, reason string")


def fit_networks(rows: DataFrame, population: str, columns: list[str], y: str, w: str, *, seeds: list[int], updates: int, hidden: int = 16, sample_rows: int = 200_000) -> DataFrame:
    """One network per (population, seed), each in its own task: ``(population, seed, n, loss, state)``.

    A network is fitted to about ``sample_rows`` labelled rows of its population at most, whole
    buckets of 4,096 in hashed order: a documented bound of the training set, so that a task's
    memory is bounded and no population is ordered in one task.
    ``state`` is JSON for ``network_probability``.
    """
    use = _bounded(_known(rows, population, columns, y, w), sample_rows).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def run(t: pa.Table) -> pa.Table:
        X = _matrix(t)
        yv, wv = t.column("_y").to_numpy(), t.column("_w").to_numpy()
        order = np.lexsort((*X.T, yv))  # the same rows in the same order, whatever the shuffle did
        X, yv, wv = X[order], yv[order], wv[order]
        seed = t.column("seed")[0].as_py()
        net = AdamNet(hidden, seed).fit(X, yv, wv, updates)
        loss = _weighted_loss(yv, net.predict(X), wv)
        state = json.dumps({"mean": net.mean.tolist(), "scale": net.scale.tolist(), "p": [x.tolist() for x in net.p]})
        return pa.table({"population": [t.column("population")[0].as_py()], "seed": pa.array([seed], pa.int32()), "n": pa.array([len(X)], pa.int64()), "loss": [loss], "state": [state]})

    return use.groupBy("population", "seed").applyInArrow(run, "population string, seed int, n bigint, loss double, state string")


def network_probability(state: str, columns: list[str]) -> Column:
    """A fitted network's probability as one SQL expression."""
    s = json.loads(state)
    xs = [(F.col(c) - m) / k for c, m, k in zip(columns, s["mean"], s["scale"])]
    w1, b1, w2, b2 = s["p"]
    z = F.lit(b2[0])
    for j in range(len(b1)):
        a = F.lit(b1[j])
        for x, row in zip(xs, w1):
            a = a + x * row[j]
        z = z + F.greatest(a, F.lit(0.0)) * w2[j][0]
    return logistic(z)


# --- interval bootstrap ----------------------------------------------------------------------------


def member_stream(*facts) -> np.random.Generator:
    """A random stream of its own for each combination of facts, the same on every run and machine."""
    return np.random.default_rng(list(hashlib.blake2b(repr(facts).encode(), digest_size=32).digest()))


class UniqueShare:
    """Average uniqueness of every interval beside those drawn so far, kept up to date draw by draw.

    Time is cut at all ends. A draw lowers the worth of the spans it covers; an interval loses the part
    of that loss that lies between its own ends, a difference of two running losses over the drawn
    spans alone.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray):
        cuts = np.unique(np.concatenate((start, end)))
        self.a, self.z = np.searchsorted(cuts, start), np.searchsorted(cuts, end)
        self.width, self.length = np.diff(cuts).astype(float), (end - start).astype(float)
        self.drawn = np.zeros(len(self.width))
        self.worth = self.length.copy()

    def add(self, i: int) -> None:
        a, z = self.a[i], self.z[i]
        times = self.drawn[a:z]
        lost = np.zeros(z - a + 1)
        np.cumsum(self.width[a:z] / ((times + 1) * (times + 2)), out=lost[1:])
        times += 1
        inside = lambda x: np.minimum(np.maximum(x, a), z) - a
        self.worth -= lost[inside(self.z)] - lost[inside(self.a)]

    def odds(self) -> np.ndarray:
        return self.worth / self.length


def sequential_draws(start: np.ndarray, end: np.ndarray, uniforms: np.ndarray, sequential: bool) -> tuple[np.ndarray, np.ndarray]:
    """Draws with replacement; sequentially with probability in proportion to the average uniqueness
    that each interval would have beside those drawn so far. Each uniform number is turned into a
    row by the running total of the odds; the second result is the probability of that row."""
    share = UniqueShare(start, end)
    rows, chances = [], []
    for u in uniforms:
        odds = share.odds() if sequential else np.ones(len(start))
        running = np.cumsum(odds)
        i = min(int(np.searchsorted(running, u * running[-1], side="right")), len(odds) - 1)
        rows.append(i)
        chances.append(odds[i] / running[-1])
        share.add(i)
    return np.array(rows, np.int64), np.array(chances)


def interval_bootstrap(intervals: DataFrame, population: list[str], key: str, start: str, end: str, *, members: int, draws: int, sequential: bool = True, seed: int = 7) -> DataFrame:
    """``(population, member, step, key, p)``: members of each population are tasks of their own.

    Draws depend on each other, so a (population, member) is the unit of work; populations are
    meant to be bounded, a fold or a month, not a whole table.
    """
    x = intervals.select(F.concat_ws("/", *population).alias("population"), F.col(key).cast("bigint").alias("_id"), F.col(start).cast("bigint").alias("_a"), F.col(end).cast("bigint").alias("_z"))
    x = x.where("_id is not null and _z > _a").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def run(t: pa.Table) -> pa.Table:
        ids, a, z = (t.column(c).to_numpy() for c in ("_id", "_a", "_z"))
        o = np.argsort(ids, kind="stable")
        pop, member = t.column("population")[0].as_py(), t.column("member")[0].as_py()
        u = member_stream(pop, member, seed).random(draws)
        i, p = sequential_draws(a[o], z[o], u, sequential)
        n = len(i)
        return pa.table({"population": [pop] * n, "member": pa.array([member] * n, pa.int32()), "step": pa.array(np.arange(n), pa.int32()), "id": pa.array(ids[o][i]), "p": p})

    return x.groupBy("population", "member").applyInArrow(run, "population string, member int, step int, id bigint, p double")


def bagged(predictions: DataFrame, by: list[str], members: int) -> DataFrame:
    """Mean of the members' probabilities; null where any member has none."""
    g = predictions.groupBy(*by).agg(F.count("p").alias("_n"), F.avg("p").alias("_p"))
    return g.select(*by, F.when(F.col("_n") == members, F.col("_p")).alias("p"))


def block_importance(rows: DataFrame, order: str, families: dict[str, list[str]], state: LogisticState, y: str, *, block: int = 128, seed: int = 0) -> DataFrame:
    """Rise of the log loss when a family's columns come from another block of rows.

    Blocks of consecutive rows are moved as a whole: a row at place ``j`` of block ``k`` takes the
    columns of place ``j`` of block ``a * k + c`` (mod the number of blocks; ``a`` and ``c`` seeded, ``a``
    coprime), a permutation that needs no order of the blocks. Places in the last, shorter block
    wrap around. Ranks by two levels; no global sort in one task.
    """
    cols = sorted({c for f in families.values() for c in f})
    x = rows.select(order, y, *state.columns)
    # Place in the order by two levels: ranges of the key are counted, rows numbered within them.
    span = x.agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n")).first()
    rows_n = span.n
    width = max(1, -(-((span.z or 0) - (span.a or 0) + 1) // 256))
    x = x.withColumn("_r", F.floor((F.col(order) - (span.a or 0)) / width))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    base_n = x.groupBy("_r").agg(F.count("*").alias("_c")).select("_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    x = x.join(base_n, "_r")
    n = F.col("_b") + F.row_number().over(W.partitionBy("_r").orderBy(order)) - 1
    x = x.withColumn("_n", n).withColumn("_k", F.floor(F.col("_n") / block)).withColumn("_j", F.col("_n") % block)
    blocks = max(1, -(-rows_n // block))
    rng = np.random.default_rng(seed)
    a = next(int(v) for v in rng.integers(1, max(2, blocks), 1000) if math.gcd(int(v), blocks) == 1)
    c0 = int(rng.integers(blocks))
    donors = x.select(F.col("_k").alias("_from"), F.col("_j").alias("_fj"), *[F.col(c).alias(f"_d_{c}") for c in cols])
    src = F.pmod(F.col("_k") * a + c0, F.lit(blocks))
    size = F.when(src == blocks - 1, rows_n - (blocks - 1) * block).otherwise(block)
    j = x.withColumn("_from", src).withColumn("_fj", F.col("_j") % size).join(donors, ["_from", "_fj"])
    yc = F.col(y).cast("double")
    base = clipped_loss(yc, state.probability())
    out = []
    for name, own in families.items():
        z = F.lit(state.intercept)
        for c, m, s, b in zip(state.columns, state.mean, state.scale, state.coef):
            z = z + ((F.col(f"_d_{c}") if c in own else F.col(c)) - m) / s * b
        out.append(F.avg(clipped_loss(yc, logistic(z)) - base).alias(name))
    return j.agg(*out)
