"""Bayesian change-point detector.

Per lake, the exact posterior probability that a new segment starts at each
date, for a piecewise-constant Gaussian model (product partition model,
Barry & Hartigan 1993; exact recursions as in Fearnhead 2006):

* each boundary between consecutive dates is a change point independently
  with prior probability ``p``;
* each segment has its own level and variance with a Normal-Inverse-Gamma
  prior, so a segment's marginal likelihood is closed form;
* with ``max_order`` 1 a segment may also have a slope: it is a Bayesian
  linear regression on time, closed form from running cross products, and
  the two orders are averaged with equal weight, so that a steady decline is
  one segment and not a staircase;
* forward and backward sums over all segmentations (O(n^2) per lake, in
  log space) give P(change at t | series).

Masked dates stay in the calendar grid (they carry no likelihood), so the
neighbours of a break are calendar neighbours. The kernel only returns one
probability per row; ranking, neighbours and statistics are Spark windows.
Probabilities are the model's own and do not reproduce any sampler.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..family import DATE, ID, Family
from .breaks import BREAK_COLUMNS, change_stats
from .panel import norm


def segment_loglik(x: np.ndarray, mu0: float, kappa0: float = 0.01, alpha0: float = 1.0,
                   beta0: float = 1e-3) -> np.ndarray:
    """log marginal likelihood of every segment x[i..j] (inclusive), NaN ignored; shape (n, n).

    Entries with j < i are -inf. Sufficient statistics come from cumulative
    sums, so all n^2 segments cost O(n^2) vector operations.
    """
    n = len(x)
    ok = ~np.isnan(x)
    v = np.where(ok, x - mu0, 0.0)  # centred: keeps the sum of squares well conditioned
    c0 = np.concatenate([[0.0], np.cumsum(ok.astype(float))])
    c1 = np.concatenate([[0.0], np.cumsum(v)])
    c2 = np.concatenate([[0.0], np.cumsum(v * v)])
    i = np.arange(n)[:, None]
    j = np.arange(n)[None, :]
    jj = np.maximum(j, i)
    m = c0[jj + 1] - c0[i]
    s1 = c1[jj + 1] - c1[i]
    s2 = c2[jj + 1] - c2[i]
    mean = np.where(m > 0, s1 / np.maximum(m, 1.0), 0.0)  # of the centred values
    dev2 = np.maximum(s2 - m * mean * mean, 0.0)
    kn = kappa0 + m
    an = alpha0 + m / 2.0
    bn = beta0 + 0.5 * dev2 + kappa0 * m * mean ** 2 / (2.0 * kn)
    # an = alpha0 + m / 2 takes only n + 1 values: look lgamma up in a table
    table = np.array([math.lgamma(alpha0 + k / 2.0) for k in range(n + 1)])
    ll = (table[m.astype(int)] - math.lgamma(alpha0) + alpha0 * math.log(beta0) - an * np.log(bn)
          + 0.5 * (math.log(kappa0) - np.log(kn)) - 0.5 * m * math.log(2 * math.pi))
    return np.where(j >= i, ll, -np.inf)


def line_loglik(x: np.ndarray, at: np.ndarray, mu0: float, kappa0: float = 0.01, kappa1: float = 0.01,
                alpha0: float = 1.0, beta0: float = 1e-3) -> np.ndarray:
    """log marginal likelihood of every segment x[i..j] as a line over ``at``; shape (n, n), -inf below the diagonal.

    Level (at the segment's first time) and slope have independent normal
    priors of precision ``kappa0`` and ``kappa1`` times that of the noise.
    Cumulative cross products give all segments in O(n^2) vector operations.
    """
    n = len(x)
    v = x - mu0
    sums = [np.concatenate([[0.0], np.cumsum(w)]) for w in (np.ones(n), at, at * at, v, at * v, v * v)]
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    jj = np.maximum(j, i)
    m, st, stt, sv, stv, svv = (c[jj + 1] - c[i] for c in sums)
    t0 = at[:, None]
    # times from the first one of the segment
    stt, st, stv = stt - 2 * t0 * st + t0 * t0 * m, st - t0 * m, stv - t0 * sv
    a, b, d = kappa0 + m, st, kappa1 + stt
    det = a * d - b * b
    explained = (d * sv * sv - 2 * b * sv * stv + a * stv * stv) / det
    bn = beta0 + 0.5 * np.maximum(svv - explained, 0.0)
    an = alpha0 + m / 2.0
    table = np.array([math.lgamma(alpha0 + k / 2.0) for k in range(n + 1)])
    ll = (table[m.astype(int)] - math.lgamma(alpha0) + alpha0 * math.log(beta0) - an * np.log(bn)
          + 0.5 * (math.log(kappa0 * kappa1) - np.log(det)) - 0.5 * m * math.log(2 * math.pi))
    return np.where(j >= i, ll, -np.inf)


def evidence(x: np.ndarray, at: np.ndarray, max_order: int) -> np.ndarray:
    """log marginal likelihood of every segment, averaged over the orders 0 to ``max_order``."""
    mu0 = float(np.nanmean(x))
    level = segment_loglik(x, mu0)
    if max_order == 0:
        return level
    with np.errstate(invalid="ignore"):
        both = np.logaddexp(level, line_loglik(x, at, mu0)) - math.log(2.0)
    return np.where(np.isfinite(level), both, -np.inf)


def _logsumexp(v: np.ndarray) -> float:
    m = v.max()
    if not np.isfinite(m):
        return m
    return m + math.log(np.exp(v - m).sum())


def changepoint_probability(x: np.ndarray, p: float | None = None, max_order: int = 0,
                            at: np.ndarray | None = None) -> np.ndarray:
    """P(a segment starts at t | x) for t = 0..n-1 (0 at t = 0).

    ``max_order`` 1 allows lines over the times ``at`` (by default the
    positions, scaled to 0..1) and needs a series without gaps.
    """
    if max_order not in (0, 1):
        raise ValueError("max_order is 0 (levels) or 1 (lines)")
    n = len(x)
    out = np.zeros(n)
    if n < 2 or np.isnan(x).all():
        return out
    p = p if p is not None else min(0.5, 1.0 / n)
    lp, lq = math.log(p), math.log1p(-p)
    L = evidence(x, np.arange(n) / (n - 1.0) if at is None else at, max_order)
    # forward: A[j] = log sum over segmentations of x[0..j-1] ending at j-1
    idx = np.arange(n + 1)
    start_pen = np.where(idx > 0, lp, 0.0)   # a segment after a boundary pays p
    A = np.full(n + 1, -np.inf)
    A[0] = 0.0
    for jend in range(1, n + 1):
        terms = A[:jend] + L[:jend, jend - 1] + lq * (jend - 1 - idx[:jend]) + start_pen[:jend]
        A[jend] = _logsumexp(terms)
    # backward: B[i] = log sum over segmentations of x[i..n-1] given a segment starts at i
    B = np.full(n + 1, -np.inf)
    B[n] = 0.0
    end_pen = np.where(idx < n, lp, 0.0)     # a boundary after the segment pays p
    for ist in range(n - 1, -1, -1):
        ends = idx[ist + 1:]
        terms = L[ist, ist:n] + lq * (ends - ist - 1) + end_pen[ist + 1:] + B[ist + 1:]
        B[ist] = _logsumexp(terms)
    z = A[n]
    # a segment starts at t (t >= 1): previous segment ends at t-1, boundary prob p
    t = np.arange(1, n)
    out[1:] = np.exp(A[t] + lp + B[t] - z)
    return np.clip(out, 0.0, 1.0)


def valid_probability(x: np.ndarray, p: float | None = None, min_sep: int = 1, max_order: int = 0) -> np.ndarray:
    """``changepoint_probability`` over the values that are there; 0 at missing ones.

    Lines run over the places of the whole calendar grid, gaps included.

    A change inside a gap so belongs to the first value after it. Of several
    changes less than ``min_sep`` values apart the most probable stays.
    """
    there = ~np.isnan(x)
    at = np.arange(len(x))[there] / max(len(x) - 1.0, 1.0)
    found = changepoint_probability(x[there], p, max_order, at)
    for t in np.lexsort((np.arange(len(found)), -found)):
        if min_sep > 1 and found[t] > 0:
            near = slice(max(0, t - min_sep + 1), t + min_sep)
            peak, found[near] = found[t], 0.0
            found[t] = peak
    out = np.zeros(len(x))
    out[there] = found
    return out


PROB_SCHEMA = f"{ID} string, {DATE} date, proba double"


def changepoint_probabilities(rows: DataFrame, value: str, p: float | None = None,
                              partitions: int | None = None, carry: str | None = None,
                              min_sep: int = 1, max_order: int = 0) -> DataFrame:
    """``applyInPandas`` over lakes of ``(id, date, value)``; one probability per row.

    The task count comes from the input's partitioning by lake: prepare the
    panel with ``prepare(..., partitions=kernel_partitions(spark))`` so its
    single exchange is sized for the Python work (``partitions`` here adds a
    repartition of the thin frame instead, for inputs not partitioned by lake).
    ``carry`` names one DOUBLE column passed through unchanged.
    """
    from ..session import ship_package
    ship_package(rows.sparkSession)
    extra = [F.col(carry).alias("_carry")] if carry else []
    slim = rows.select(ID, DATE, F.col(value).alias("v"), *extra)
    if partitions:
        slim = slim.repartition(int(partitions), ID)
    schema = PROB_SCHEMA + (f", {carry} double" if carry else "")

    def per_lake(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        x = pdf["v"].to_numpy(dtype=float, na_value=np.nan)
        out = {ID: pdf[ID].to_numpy(), DATE: pdf[DATE].to_numpy(), "proba": valid_probability(x, p, min_sep, max_order)}
        if carry:
            out[carry] = pdf["_carry"].to_numpy(dtype=float, na_value=np.nan)
        return pd.DataFrame(out)

    return slim.groupBy(ID).applyInPandas(per_lake, schema=schema)


def bayes_breaks(prepared: DataFrame, family: Family, threshold: float = 0.5,
                 p: float | None = None, min_sep: int = 1, max_order: int = 0) -> DataFrame:
    """Change points with probability above ``threshold``, ranked per lake (D2), ``min_sep`` valid dates apart.

    ``max_order`` 0: segments are levels; 1: a segment may also be a line.

    Output: the break columns plus ``break_number`` (1 = most probable) and
    ``proba``; neighbours are calendar neighbours (NULL at the ends).

    One pass: the kernel carries the absolute water along, and calendar
    neighbours and running pre/post statistics are windows over its output
    (masked water is NULL and skipped), so no second read and no join.
    """
    wn, wa = norm(family.water_col), family.water_col
    probs = changepoint_probabilities(prepared, wn, p, carry=wa, min_sep=min_sep, max_order=max_order)
    w = Window.partitionBy(ID).orderBy(DATE)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    x = F.col(wa)
    stats = {
        "pre_break_mean": F.avg(x).over(upto), "pre_break_median": F.percentile(x, F.lit(0.5)).over(upto),
        "pre_break_std": F.stddev_samp(x).over(upto), "pre_break_min": F.min(x).over(upto),
        "pre_break_max": F.max(x).over(upto),
        "post_break_mean": F.avg(x).over(after), "post_break_median": F.percentile(x, F.lit(0.5)).over(after),
        "post_break_std": F.stddev_samp(x).over(after), "post_break_min": F.min(x).over(after),
        "post_break_max": F.max(x).over(after),
    }
    cal = probs.select(ID, F.col(DATE).alias("date_break"), "proba",
                       F.lag(DATE).over(w).alias("date_before_break"),
                       F.lead(DATE).over(w).alias("date_after_break"),
                       *[e.alias(k) for k, e in stats.items()])
    hits = cal.filter(F.col("proba") > F.lit(threshold))
    rank = Window.partitionBy(ID).orderBy(F.desc("proba"), F.col("date_break"))
    found = hits.withColumns({"break_method": F.lit("bayes"),
                              "break_number": F.row_number().over(rank).cast("int")})
    return change_stats(found).select(*BREAK_COLUMNS, "break_number", "proba")
