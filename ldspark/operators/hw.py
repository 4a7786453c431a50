"""One-parameter fit of the expected decay of r2 with distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, ROUNDS, TOLERANCE = 0.1, 100, 1e-8
MOST_PAIRS = 100_000


#: Up to so many distances (24 bytes each) the fit goes on in the driver; beyond, each step is a job.
LOCAL_DISTANCES = 1_000_000


def expected(c, dist, n):
    """E[r2] at a distance, for population parameter c a bp and n haplotypes: of columns or of arrays."""
    x = c * dist
    return ((10 + x) / ((2 + x) * (11 + x))) * (1 + ((3 + x) * (12 + 12 * x + x * x)) / (n * (2 + x) * (11 + x)))


def slope(c, dist, n):
    """Derivative of `expected` by c."""
    x = c * dist
    u, v = 10 + x, (2 + x) * (11 + x)
    p = (3 + x) * (12 + 12 * x + x * x)
    dv, dp = 13 + 2 * x, (12 + 12 * x + x * x) + (3 + x) * (12 + 2 * x)
    f, g = u / v, 1 + p / (n * v)
    return dist * (((v - u * dv) / (v * v)) * g + f * ((dp * v - p * dv) / (n * v * v)))


def _terms(c, d, n, w, wv, wvv):
    """By distance: squared error, and the two terms of a Gauss-Newton step, from the sums of weights, of weighted
    values and of their weighted squares."""
    e, s = expected(c, d, n), slope(c, d, n)
    return wvv - 2 * e * wv + w * e * e, s * (wv - w * e), w * s * s


def fit(points: DataFrame, n: int, start: float = START, limit: int | None = None) -> float:
    """c by weighted Gauss-Newton over points (dist, value, weight), summed up by distance first, so nothing is
    expanded by its count and any number of pairs will do; a step that does not lessen the squared error is
    halved. limit: refuse more pairs than that (the established tool's is MOST_PAIRS)."""
    sums = points.filter("weight > 0").groupBy(F.col("dist").cast("double").alias("d")).agg(
        F.sum("weight").cast("double").alias("w"), F.sum(F.col("weight") * F.col("value")).alias("wv"), F.sum(F.col("weight") * F.col("value") * F.col("value")).alias("wvv")
    ).persist()
    try:
        distances, total = sums.agg(F.count("*"), F.sum("w")).collect()[0]
        if not total or limit is not None and total > limit:
            raise ValueError(f"{total} pairs; the fit takes 1 to {limit}")
        if distances <= LOCAL_DISTANCES:
            table = sums.toArrow()
            cols = [table.column(c).to_numpy() for c in ("d", "w", "wv", "wvv")]
            state = lambda c: tuple(float(t.sum()) for t in _terms(c, cols[0], n, *cols[1:]))
        else:
            state = lambda c: tuple(sums.agg(*[F.sum(t) for t in _terms(c, F.col("d"), n, F.col("w"), F.col("wv"), F.col("wvv"))]).collect()[0])
        return _gauss_newton(state, start)
    finally:
        sums.unpersist()


def _gauss_newton(state, c: float) -> float:
    error, grad, curve = state(c)
    for _ in range(ROUNDS):
        if not curve:
            break
        step = grad / curve
        while True:
            new = max(c + step, c / 10)  # a decay rate stays positive
            after = state(new)
            if after[0] <= error or abs(step) <= TOLERANCE * c:
                break
            step /= 2
        done = abs(new - c) <= TOLERANCE * c
        c, (error, grad, curve) = new, after
        if done:
            break
    return c


def fitted_curve(points: DataFrame, c: float, n: int) -> DataFrame:
    """(dist, fitted) at the distinct distances."""
    return points.select("dist").distinct().withColumn("fitted", expected(c, F.col("dist"), n))
