"""Change points between lines: evidence and posterior against brute force, declines against drops."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lakeshift.family import DW
from lakeshift.operators.bayes import bayes_breaks, changepoint_probability, line_loglik, segment_loglik, valid_probability
from lakeshift.operators.panel import prepare
from lakeshift.sources.derived import planted_panel


def t_density(x, design, precision, a0=1.0, b0=1e-3):
    """The segment's marginal likelihood as a multivariate t density, with dense matrices."""
    m = len(x)
    shape = (b0 / a0) * (np.eye(m) + design @ np.diag(1 / np.array(precision)) @ design.T)
    _, logdet = np.linalg.slogdet(shape)
    q = x @ np.linalg.solve(shape, x)
    nu = 2 * a0
    return (math.lgamma((nu + m) / 2) - math.lgamma(nu / 2) - 0.5 * m * math.log(nu * math.pi) - 0.5 * logdet
            - (nu + m) / 2 * math.log1p(q / nu))


def brute_segment(x, at, max_order):
    ones = np.ones((len(x), 1))
    level = t_density(x, ones, [0.01])
    if max_order == 0:
        return level
    line = t_density(x, np.hstack([ones, (at - at[0])[:, None]]), [0.01, 0.01])
    return np.logaddexp(level, line) - math.log(2)


def test_evidence_is_the_t_density():
    rng = np.random.default_rng(1)
    x, at = rng.normal(0.5, 0.2, 9), np.sort(rng.uniform(0, 1, 9))
    mu = x.mean()
    line, level = line_loglik(x, at, mu), segment_loglik(x, mu)
    for i, j in itertools.combinations_with_replacement(range(9), 2):
        part = slice(i, j + 1)
        assert np.logaddexp(level[i, j], line[i, j]) - math.log(2) == pytest.approx(
            brute_segment(x[part] - mu, at[part], 1), abs=1e-6)


@pytest.mark.parametrize("max_order", [0, 1])
def test_posterior_over_all_segmentations(max_order):
    rng = np.random.default_rng(2)
    x = np.concatenate([0.8 - 0.05 * np.arange(5), 0.2 + 0.02 * np.arange(4)]) + rng.normal(0, 0.01, 9)
    n, p, at = len(x), 1 / 9, np.arange(9) / 8
    total, starts = 0.0, np.zeros(n)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        bounds = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
        weight = math.exp(sum(brute_segment(x[a:b] - x.mean(), at[a:b], max_order) for a, b in zip(bounds, bounds[1:]))
                          + sum(cuts) * math.log(p) + (n - 1 - sum(cuts)) * math.log1p(-p))
        total += weight
        starts[bounds[1:-1]] += weight
    assert changepoint_probability(x, max_order=max_order) == pytest.approx(starts / total, abs=1e-8)


def test_decline_is_one_line_and_a_drop_is_not():
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.004, 60)
    decline = np.linspace(0.9, 0.2, 60) + noise
    assert valid_probability(decline, max_order=1).sum() < 0.5  # changes expected in the whole series
    assert valid_probability(decline, max_order=0).sum() > 3.0
    drop = np.where(np.arange(60) < 33, 0.9 - 0.002 * np.arange(60), 0.3) + noise
    found = valid_probability(drop, max_order=1)
    assert found.argmax() == 33 and found[33] > 0.9 and (found > 0.5).sum() == 1
    gaps = drop.copy()
    gaps[[5, 20, 33, 50]] = np.nan  # the change falls to the first value after the gap
    assert valid_probability(gaps, max_order=1).argmax() == 34


def test_lakes_with_a_trend(spark):
    """Every planted drop is found with lines too; a lake that shrinks steadily has a break only without them."""
    panel = planted_panel(spark, SF_SMALL)
    shrink = F.lit(1.0) - F.lit(0.012) * F.months_between("date", F.lit("2017-01-01"))
    slow = (panel.filter("id_geohash in ('lk000001', 'lk000002')")
            .withColumn("id_geohash", F.concat(F.lit("slow"), "id_geohash"))
            .withColumn("bare", F.col("bare") + F.col("water") * (1 - shrink)).withColumn("water", F.col("water") * shrink))
    prepared = prepare(panel.unionByName(slow), DW)
    lines = {r.id_geohash for r in bayes_breaks(prepared, DW, threshold=0.15, max_order=1).collect()}
    levels = {r.id_geohash for r in bayes_breaks(prepared, DW, threshold=0.15).collect()}
    drops = {f"lk{k:06d}" for k in range(1, 11) if k % 3 == 0}
    assert drops <= lines and drops <= levels
    assert not any(i.startswith("slow") for i in lines) and any(i.startswith("slow") for i in levels)
