"""Correlation, permutation tests, regression and dominance of columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.special import correlation_p
from graphloom.model import null_div, require

#: Rows up to which a permutation test may be one task that draws as numpy's RandomState does.
MAX_DRAWN = 1_000_000


def _in_one_task(df: DataFrame, draws: str) -> bool:
    """Whether signs are drawn in one task; the choice is the caller's, and a table too large for it is refused."""
    if draws not in ("numpy", "hash"):
        raise ValueError(f"draws is 'numpy' or 'hash', not {draws!r}")
    if draws == "numpy" and df.limit(MAX_DRAWN + 1).count() > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} rows; take draws='hash'")
    return draws == "numpy"


def _number(column: str, policy: str) -> Column:
    if policy not in ("propagate", "raise", "omit"):
        raise ValueError(f"nan_policy is 'propagate', 'raise' or 'omit', not {policy!r}")
    value = F.col(column).cast("double")
    return F.when(F.isnan(value), F.lit(None)).otherwise(value) if policy == "omit" else value


def efficient_pearsonr(df: DataFrame, a: list[str], b: list[str], nan_policy: str = "propagate", ddof: int = 1) -> DataFrame:
    """``(a, b, r, p, n)`` for each two columns in turn; one column against several if a list has one only.

    ``omit`` leaves out rows in which either is NaN or NULL, ``propagate`` makes r NaN, ``raise`` refuses them.  All
    columns take one pass.  Deviations over n - ``ddof`` rows, and products over n - 1, make r; only with a ``ddof`` of 1
    is it the correlation.
    """
    if len(a) != len(b):
        if 1 not in (len(a), len(b)):
            raise ValueError("the lists differ in length")
        a, b = (a * len(b), b) if len(a) == 1 else (a, b * len(a))
    require(df, *a, *b)
    if nan_policy == "raise":
        bad = [F.isnan(F.col(c).cast("double")) | F.col(c).isNull() for c in {*a, *b}]
        either = bad[0]
        for c in bad[1:]:
            either = either | c
        if df.filter(either).take(1):
            raise ValueError("there are rows without a number")
    aggs = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        u, v = _number(x, nan_policy), _number(y, nan_policy)
        both = u.isNotNull() & v.isNotNull()
        aggs += [F.corr(F.when(both, u), F.when(both, v)).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    sums = df.agg(*aggs)

    def r(i: int) -> Column:
        found = F.col(f"r{i}") if ddof == 1 else null_div(F.col(f"r{i}") * (F.col(f"n{i}") - ddof), F.col(f"n{i}") - 1)
        return F.least(F.greatest(found, F.lit(-1.0)), F.lit(1.0))

    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), r(i).alias("r"), F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(zip(a, b, strict=True))]))
    return sums.select(rows.alias("x")).select("x.a", "x.b", F.coalesce("x.r", F.lit(float("nan"))).alias("r"), "x.n").withColumn("p", correlation_p("r", F.col("n").cast("double")))


def weighted_pearsonr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """``(r)``: correlation with weights; rows without all three do not count."""
    t = require(df, x, y, w).select(*[F.col(c).cast("double").alias(k) for k, c in zip("xyw", (x, y, w), strict=True)]).dropna()
    mean = t.agg(null_div(F.sum(F.expr("w * x")), F.sum("w")).alias("mx"), null_div(F.sum(F.expr("w * y")), F.sum("w")).alias("my"))
    z = t.crossJoin(F.broadcast(mean)).selectExpr("w", "x - mx AS x", "y - my AS y")
    s = z.agg(F.sum(F.expr("w * x * y")).alias("a"), F.sum(F.expr("w * x * x")).alias("b"), F.sum(F.expr("w * y * y")).alias("c"))
    return s.select(null_div(F.col("a"), F.sqrt(F.col("b") * F.col("c"))).alias("r"))


def correlated_vectors(corr: float | np.ndarray, size: int | tuple[int, ...], seed: int | None = None, tol: float = 0.001) -> np.ndarray:
    """Normal vectors whose correlations are within ``tol`` of ``corr``; the draw is repeated up to 500 times."""
    rng = np.random.RandomState(seed)
    goal = np.asarray(corr, float)
    if (np.abs(goal) > 1).any():
        raise ValueError("correlations lie within -1 and 1")
    if goal.ndim == 0:
        goal = np.array([[1, float(goal)], [float(goal), 1]])
    if goal.ndim != 2 or goal.shape[0] != goal.shape[1] or isinstance(corr, tuple):
        raise ValueError(f"corr must be a number or a square matrix, not of shape {goal.shape}")
    if (np.diag(goal) != 1).any():
        raise ValueError("the diagonal of corr must be 1")
    for _ in range(501):
        found = rng.multivariate_normal(np.zeros(len(goal)), goal * 0.111, size=size).T
        if (np.abs(np.corrcoef(found.reshape(len(found), -1)) - goal) < tol).all():
            break
    return found


def make_correlated_xy(spark: SparkSession, corr: float | np.ndarray = 0.85, size: int = 10_000, seed: int | None = None, tol: float = 0.001) -> DataFrame:
    """``(row, v0, v1, ...)`` with such columns."""
    found = correlated_vectors(corr, size, seed, tol).reshape(-1, size) if np.ndim(corr) else correlated_vectors(corr, size, seed, tol)
    return spark.createDataFrame(pd.DataFrame({"row": np.arange(found.shape[1])} | {f"v{i}": x for i, x in enumerate(found)}))


def _p(true: float, null: np.ndarray) -> float:
    return (1 + int((np.abs(null) >= abs(true)).sum())) / (len(null) + 1)


def _drawn(df: DataFrame, columns: list[str], order: str, statistic, schema: str) -> DataFrame:
    """A test in one task over rows in order."""
    rows = df.select(F.lit(0).alias("test"), F.col(order).alias("o"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        t = part.sort_values("o", kind="stable")
        return pd.DataFrame([statistic(*[t[f"c{i}"].to_numpy() for i in range(len(columns))])], columns=[x.split()[0] for x in schema.split(", ")])

    return rows.groupBy("test").applyInPandas(run, schema)


def _sign_sums(df: DataFrame, value, order: str, n_perm: int, seed: int) -> DataFrame:
    """``(mean, p)`` of sign flips where the signs come from a hash of row and permutation, so no row moves."""
    rows = df.select(F.col(order).cast("long").alias("o"), value.cast("double").alias("d")).dropna()

    def run(parts):
        total, n, true = np.zeros(n_perm), 0, 0.0
        for part in parts:
            d, key = part["d"].to_numpy(), part["o"].to_numpy(np.int64).view(np.uint64)
            n, true = n + len(d), true + d.sum()
            for at in range(0, n_perm, 64):  # a hash has 64 signs
                h = (key + np.uint64(seed * 1_000_003 + at + 1)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
                for k in range(min(64, n_perm - at)):
                    total[at + k] += d @ (1.0 - 2.0 * ((h >> np.uint64(k)) & np.uint64(1)).astype(float))
        yield pd.DataFrame({"perm": np.arange(-1, n_perm), "s": np.append(true, total), "n": n})

    sums = rows.mapInPandas(run, "perm long, s double, n long").groupBy("perm").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    true = sums.filter("perm = -1").select(F.col("s").alias("seen"))
    hits = sums.filter("perm >= 0").crossJoin(F.broadcast(true)).agg(F.sum(F.expr("int(abs(s) >= abs(seen))")).alias("hits"), F.first("seen").alias("seen"), F.first("n").alias("n"))
    return hits.select(null_div(F.col("seen"), F.col("n")).alias("mean"), ((F.col("hits") + 1) / F.lit(n_perm + 1)).alias("p"))


def permtest_1samp(df: DataFrame, a: str, order: str, popmean: float = 0.0, n_perm: int = 1000, seed: int = 0, draws: str = "numpy") -> DataFrame:
    """``(mean, p)``: the mean of ``a`` less ``popmean``, and the share of sign flips whose mean is at least as far from 0.

    ``order`` numbers the rows.  Signs are drawn in their order, as ``numpy.random.RandomState`` gives them, in one task;
    with ``draws="hash"`` they come from a hash of row and permutation, and no row moves.
    """
    if not _in_one_task(df, draws):
        return _sign_sums(df, F.col(a) - popmean, order, n_perm, seed)

    def test(x: np.ndarray) -> tuple[float, float]:
        rng, d = np.random.RandomState(seed), x - popmean
        return d.mean(), _p(d.mean(), np.array([(d * rng.choice([-1, 1], size=len(d))).mean() for _ in range(n_perm)]))

    return _drawn(df, [a], order, test, "mean double, p double")


def permtest_rel(df: DataFrame, a: str, b: str, order: str, n_perm: int = 1000, seed: int = 0, draws: str = "numpy") -> DataFrame:
    """``(mean, p)``: the mean of b - a, and the share of swaps within rows whose mean is at least as far from 0.

    ``draws`` is that of ``permtest_1samp``.
    """
    if not _in_one_task(df, draws):
        return _sign_sums(df, F.col(b) - F.col(a), order, n_perm, seed)

    def test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        rng, d, null = np.random.RandomState(seed), y - x, np.empty(n_perm)
        pair = np.stack((x, y))
        for k in range(n_perm):
            put = np.take_along_axis(pair, rng.random_sample(pair.shape).argsort(axis=0), 0)
            null[k] = (put[1] - put[0]).mean()
        return d.mean(), _p(d.mean(), null)

    return _drawn(df, [a, b], order, test, "mean double, p double")


def permtest_pearsonr(df: DataFrame, a: str, b: str, order: str, n_perm: int = 1000, resamples: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(r, p)``: the correlation, and the share of shuffles of ``a`` that correlate at least as much.

    ``resamples`` ``(perm, position, row)`` gives the row whose value of ``a`` stands at each position instead; rows
    and positions are values of ``order``.  Permutations are spread over tasks by a join; without them the rows, of
    which there may be ``MAX_DRAWN``, are shuffled in one task.
    """
    if resamples is not None:
        some = require(resamples, "perm", "position", "row").filter(F.col("perm") < n_perm)
        if some.select("perm").distinct().count() < n_perm:
            raise ValueError(f"fewer than {n_perm} resamples")
        t = df.select(F.col(order).alias("row"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        null = some.join(t.select("row", "x"), "row").join(t.select(F.col("row").alias("position"), "y"), "position").groupBy("perm").agg(F.corr("x", "y").alias("shuffled"))
        hits = null.crossJoin(F.broadcast(t.agg(F.corr("x", "y").alias("r"))))
        return hits.agg(F.first("r").alias("r"), ((F.sum(F.expr("int(abs(shuffled) >= abs(r))")) + 1) / F.lit(n_perm + 1)).alias("p"))
    if df.limit(MAX_DRAWN + 1).count() > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} rows; give resamples")

    def test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        rng = np.random.RandomState(seed)
        zx, zy = ((v - v.mean()) / v.std() / np.sqrt(len(v)) for v in (x, y))
        r = float(np.clip(zx @ zy, -1, 1))
        return r, _p(r, np.array([zx[rng.permutation(len(zx))] @ zy for _ in range(n_perm)]))

    return _drawn(df, [a, b], order, test, "r double, p double")


def add_constant(df: DataFrame, name: str = "const") -> DataFrame:
    """A last column of ones."""
    return df.withColumn(name, F.lit(1.0))


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and sums of products about the means, in two passes; rows without all columns do not count."""
    t = require(df, *columns).select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    k = len(columns)
    first = t.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(k)])
    sums = t.agg(*[F.sum((F.col(f"c{i}") - float(mean[i])) * (F.col(f"c{j}") - float(mean[j]))).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return first["n"], mean, out


def residualize(df: DataFrame, x: list[str], y: list[str], comparison: DataFrame | None = None, normalize: bool = True, add_intercept: bool = True) -> DataFrame:
    """The rows with ``<y>_residual``: y less the slopes fitted on ``comparison``, or on the rows themselves, times x.

    The intercept is fitted but not subtracted.  ``normalize`` expresses residuals by mean and population deviation
    of those of the comparison.  Fitting takes sums over the rows only.
    """
    fit_on = df if comparison is None else comparison
    n, mean, g = gram(fit_on, [*x, *y])
    k = len(x)
    if not add_intercept:
        g = g + n * np.outer(mean, mean)
    slopes = np.linalg.lstsq(g[:k, :k], g[:k, k:], rcond=None)[0]
    out = df
    for j, name in enumerate(y):
        parts = [F.col(c).cast("double") * float(s) for c, s in zip(x, slopes[:, j], strict=True)]
        value = F.col(name).cast("double")
        for p in parts:
            value = value - p
        if normalize:
            beta = np.append(-slopes[:, j], 1.0)
            which = [*range(k), k + j]
            centre = mean[which] @ beta
            about = g[np.ix_(which, which)] - (0 if add_intercept else n * np.outer(mean[which], mean[which]))
            spread = float(np.sqrt(max(beta @ about @ beta, 0) / n)) if n else 0.0
            value = null_div(value - float(centre), F.lit(spread))
        out = out.withColumn(f"{name}_residual", value)
    return out


def get_dominance_stats(df: DataFrame, x: list[str], y: str, use_adjusted_r_sq: bool = True) -> DataFrame:
    """``(kind, predictors, size, value)``: how much of y the columns x explain, alone and beside others.

    ``r_sq`` for each subset of x; ``individual``, ``partial`` (mean gain in subsets of one size) and ``total`` (mean
    over sizes) for each column; ``full``.  The rows are read twice, for means and products; subsets need no more.
    """
    n, _, g = gram(df, [*x, y])
    k = len(x)
    r_sq: dict[tuple[int, ...], float] = {}
    for size in range(1, k + 1):
        for s in combinations(range(k), size):
            cross = g[list(s), k]
            r = float(cross @ np.linalg.lstsq(g[np.ix_(s, s)], cross, rcond=None)[0] / g[k, k]) if g[k, k] else float("nan")
            r_sq[s] = 1 - (1 - r) * (n - 1) / (n - size - 1) if use_adjusted_r_sq and n > size + 1 else r
    rows = [("r_sq", list(s), len(s), v) for s, v in r_sq.items()]
    gains = np.zeros((k, k))
    for i in range(k):
        gains[0, i] = r_sq[(i,)]
        rows.append(("individual", [i], 1, gains[0, i]))
        for size in range(2, k + 1):
            gains[size - 1, i] = np.mean([r_sq[s] - r_sq[tuple(j for j in s if j != i)] for s in r_sq if len(s) == size and i in s])
            rows.append(("partial", [i], size, float(gains[size - 1, i])))
    rows += [("total", [i], k, float(v)) for i, v in enumerate(gains.mean(axis=0))]
    rows.append(("full", list(range(k)), k, r_sq[tuple(range(k))]))
    return df.sparkSession.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "kind string, predictors array<int>, size int, value double")

