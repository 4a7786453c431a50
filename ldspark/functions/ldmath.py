"""Pair statistics from a 2x2 table of haplotype counts.

Each function is written once and runs on Spark Columns, where it stays in generated code, or on numpy
arrays, in the block kernel; `columns` and `arrays` are the few operations in which they differ.
n11: both minor, n10: first minor, n01: second minor, n00: both major. A pair with no minor allele at
either site has no value (null, NaN).
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10
LN10 = 2.302585092994046

columns = SimpleNamespace(
    where=lambda c, a, b: F.when(c, a).otherwise(b),
    least=F.least, floor=lambda x: F.greatest(x, F.lit(FLOOR)), log=F.ln, real=lambda x: x.cast("double"),
    div=lambda a, b: F.try_divide(a, b),
)
arrays = SimpleNamespace(
    where=np.where, least=np.minimum, floor=lambda x: np.maximum(x, FLOOR), log=np.log, real=lambda x: x.astype(float),
    div=lambda a, b: np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=np.asarray(b) != 0),
)


def counted(n11, n10, n01):
    """Whether a pair counts at all."""
    return ((n11 + n10) > 0) & ((n11 + n01) > 0)


def _shares(n00, n01, n10, n11, x):
    n = x.real(n00 + n01 + n10 + n11)
    return x.div(x.real(n00), n), x.div(x.real(n01), n), x.div(x.real(n10), n)


def _r2_parts(p0, p1, p2, left_to_right):
    a1, a2 = p0 + p1, p0 + p2
    b = a1 * a2
    a = (1.0 - a1 - a2 + b) if left_to_right else (1.0 - (a1 + a2) + b)
    return a, b, p0 - b


def r2(n00, n01, n10, n11, x=columns, left_to_right=True):
    """Squared correlation. left_to_right: the order of adding up, which matters in the last place only."""
    p = _shares(n00, n01, n10, n11, x)
    a, b, d = _r2_parts(*p, left_to_right)
    fa, fb, fd = _r2_parts(*map(x.floor, p), left_to_right)
    edge = (a == 0) | (b == 0)
    a, b, d = x.where(edge, fa, a), x.where(edge, fb, b), x.where(edge, fd, d)
    return x.div(d * d, a * b)


def _d_parts(p0, p1, p2, x, positive):
    a1, a2 = p0 + p1, p0 + p2
    b1, b2 = 1.0 - a1, 1.0 - a2
    d = p0 - a1 * a2
    up = (d > 0) if positive else (d >= 0)
    a = x.where(up, b1 * a2, b1 * b2)
    b = x.where(up, a1 * b2, a1 * a2)
    return a, b, x.where(up, d, 0.0 - d)


def dprime_r2(n00, n01, n10, n11, x=columns):
    """D' and r2 from the same terms."""
    p = _shares(n00, n01, n10, n11, x)
    a, b, d = _d_parts(*p, x, True)
    fa, fb, fd = _d_parts(*map(x.floor, p), x, True)
    edge = x.least(a, b) == 0
    a, b, d = x.where(edge, fa, a), x.where(edge, fb, b), x.where(edge, fd, d)
    return x.div(d, x.least(a, b)), x.div(d, a) * x.div(d, b)


def dprime_r2_lod(n00, n01, n10, n11, x=columns):
    """D', r2 and the log10 likelihood ratio; all shares have a floor."""
    p0, p1, p2 = _shares(n00, n01, n10, n11, x)
    p3 = x.floor(1.0 - p0 - p1 - p2)
    p0, p1, p2 = map(x.floor, (p0, p1, p2))
    a, b, d = _d_parts(p0, p1, p2, x, False)
    a1, a2 = p0 + p1, p0 + p2
    b1, b2 = 1.0 - a1, 1.0 - a2
    k = [x.real(n) for n in (n00, n01, n10, n11)]
    one = sum((n * x.log(q) for n, q in zip(k[1:], (p1, p2, p3), strict=True)), k[0] * x.log(p0)) / LN10
    none = sum((n * x.log(q) for n, q in zip(k[1:], (a1 * b2, b1 * a2, b1 * b2), strict=True)), k[0] * x.log(a1 * a2)) / LN10
    return x.div(d, x.least(a, b)), x.div(d, a) * x.div(d, b), one - none


def likelihood_interval(n00, n01, n10, n11):
    """Ends of the central 90 % of the likelihood over D' = 0, .01 .. 1, in hundredths (low may be -1), for
    numpy arrays. The surface is summed from both ends up to 5 % of its total; no crossing gives 0."""
    k = np.stack([n.astype(float) for n in (n00, n01, n10, n11)], axis=1)
    n = k.sum(axis=1, keepdims=True)
    p = k / n
    p[:, 3] = 1.0 - p[:, 0] - p[:, 1] - p[:, 2]
    p = np.maximum(p, FLOOR)
    one = (k * np.log(p)).sum(axis=1) / LN10
    a1, a2 = p[:, 0] + p[:, 1], p[:, 0] + p[:, 2]
    flip = p[:, 0] - a1 * a2 < 0  # then the second site's alleles change names
    k = np.where(flip[:, None], k[:, [1, 0, 3, 2]], k)
    b1, b2 = 1.0 - a1, 1.0 - a2
    a2, b2 = np.where(flip, b2, a2), np.where(flip, a2, b2)
    top = np.minimum(a2 * b1, a1 * b2)
    aa = (np.arange(101) * 0.01)[None, :] * top[:, None] + (a1 * a2)[:, None]
    ab, ba = a1[:, None] - aa, a2[:, None] - aa
    cells = np.stack([aa, ab, ba, b1[:, None] - ba])
    cells[:, :, 100] = np.maximum(cells[:, :, 100], FLOOR)
    with np.errstate(divide="ignore", invalid="ignore"):
        surface = 10.0 ** ((k.T[:, :, None] * np.log(cells)).sum(axis=0) / LN10 - one[:, None])
    cut = surface.sum(axis=1) * 0.05

    def crossing(s):
        total = s.cumsum(axis=1)
        over = (total > cut[:, None]) & (total - s < cut[:, None])
        return np.where(over.any(axis=1), over.argmax(axis=1), -999)

    low, high = crossing(surface), crossing(surface[:, ::-1])
    return np.where(low < -1, 0, low - 1), np.where(high < 0, 0, np.minimum(100 - high + 1, 100))


def popcount(words: list[Column]) -> Column:
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("long")
