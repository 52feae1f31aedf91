"""Maximum-likelihood ARIMA: dense likelihoods, tests and searches by hand; ranges, failures and the stream."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lakeshift.family import DW
from lakeshift.operators.arima import aligned, coefficients, differences, fitted, from_partial, kpss, likelihood, one_step
from lakeshift.operators.forecast import forecast_rows
from lakeshift.operators.nrt import nrt_all_dates, nrt_breaks
from lakeshift.operators.panel import prepare
from lakeshift.plans.nrt_jobs import nrt_month, nrt_range, read_counts, run_nrt_range
from lakeshift.sources.derived import planted_panel


def dense(z, phi, theta, mean):
    """Likelihood and forecast from the whole covariance matrix of series and next value."""
    psi = np.zeros(3000)
    for k in range(len(psi)):
        psi[k] = (k == 0) + (theta[k - 1] if 0 < k <= len(theta) else 0.0)
        psi[k] += sum(phi[i] * psi[k - 1 - i] for i in range(len(phi)) if k - 1 - i >= 0)
    n = len(z)
    cov = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n + 1)])
    whole = cov[np.abs(np.subtract.outer(np.arange(n + 1), np.arange(n + 1)))]
    own, cross = whole[:n, :n], whole[:n, n]
    inverse, ones = np.linalg.inv(own), np.ones(n)
    mu = (ones @ inverse @ z) / (ones @ inverse @ ones) if mean else 0.0
    e = z - mu
    sigma2 = e @ inverse @ e / n
    loglik = -0.5 * (n * math.log(2 * math.pi * sigma2) + np.linalg.slogdet(own)[1] + n)
    return loglik, mu + cross @ inverse @ e, sigma2 * (whole[n, n] - cross @ inverse @ cross)


@pytest.mark.parametrize("p, q", [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1), (2, 2)])
@pytest.mark.parametrize("mean", [True, False])
def test_likelihood_against_dense_matrices(p, q, mean):
    rng = np.random.default_rng(p * 10 + q)
    series = [rng.normal(0.4, 0.2, n) for n in (5, 12, 30)]
    x = rng.normal(0, 0.5, (3, p + q))
    phi, theta = coefficients(x, p, q)
    z, seen = aligned(series)
    got = likelihood(z, seen, phi, theta, np.full(3, mean))
    for i, s in enumerate(series):
        loglik, ahead, spread = dense(s, phi[i], theta[i], mean)
        assert got["loglik"][i] == pytest.approx(loglik, rel=1e-8)
        assert got["ahead"][i] == pytest.approx(ahead, rel=1e-7) and got["spread"][i] == pytest.approx(spread, rel=1e-7)


def test_coefficients_are_stationary():
    rng = np.random.default_rng(5)
    for r in np.tanh(rng.normal(0, 2, (50, 3))):
        roots = np.roots([1.0, *-from_partial(r[None])[0]])
        assert np.abs(roots).max() < 1


def test_search_finds_the_top_of_the_likelihood():
    rng = np.random.default_rng(6)
    noise = rng.normal(0, 0.05, 81)
    z, seen = aligned([0.6 + noise[1:] + 0.6 * noise[:-1]])
    grid = [likelihood(z, seen, *coefficients(np.array([[x]]), 0, 1), np.array([True]))["loglik"][0]
            for x in np.linspace(-3, 3, 601)]
    assert fitted(z, seen, 0, 1, np.array([True]))["loglik"][0] >= max(grid) - 1e-3


def brute_kpss(v):
    n = len(v)
    e = v - v.mean()
    lags = int(4 * (n / 100) ** 0.25)
    spread = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n ** 2 / spread


def test_unit_root_test_and_differences():
    rng = np.random.default_rng(7)
    series = [rng.normal(0, 1, 60), rng.normal(0, 1, 60).cumsum(), rng.normal(0, 1, 60).cumsum().cumsum(),
              np.full(20, 0.3), rng.normal(0, 1, 9), np.arange(30) * 0.5]
    z, seen = aligned(series)
    got = kpss(z, seen)
    for i, s in enumerate(series):
        if np.ptp(s):
            assert got[i] == pytest.approx(brute_kpss(s), rel=1e-9)
    w, there, d = differences(z, seen, 2)
    assert d.tolist()[0] == 0 and d.tolist()[1] == 1 and d.tolist()[2] == 2 and d.tolist()[3] == 0 and d.tolist()[5] == 1
    assert np.allclose(w[2][there[2]], np.diff(series[2], 2)) and there.sum(1).tolist() == [len(s) - k for s, k in zip(series, d)]


def test_orders_and_closed_forms():
    rng = np.random.default_rng(8)
    e = rng.normal(0, 1, 301)
    found = one_step([e[1:] + 0.8 * e[:-1], np.linspace(0.2, 0.8, 40), np.full(10, 0.7), np.array([1.0, 2.0, 4.0])])
    assert (found["d"][0], found["q"][0] >= 1) == (0, True)  # a moving average is seen as one
    assert found["predicted"][1] == pytest.approx(0.8 + 0.6 / 39) and found["upper"][1] - found["lower"][1] < 1e-9
    assert found["predicted"][2] == pytest.approx(0.7) and found["upper"][2] == pytest.approx(0.7)
    assert np.isfinite(found["predicted"][3])
    alone = one_step([np.linspace(0.2, 0.8, 40)])
    assert alone["predicted"][0] == pytest.approx(found["predicted"][1])  # batching changes nothing


def test_moving_average_forecasts_better_than_lags():
    """Over many series with a fading shock the fitted MA model's errors are near the noise."""
    rng = np.random.default_rng(9)
    e = rng.normal(0, 0.1, (60, 102))
    x = 0.5 + e[:, 1:] + 0.9 * e[:, :-1]
    found = one_step(list(x[:, :-1]), max_d=0)
    errors = x[:, -1] - found["predicted"]
    assert np.sqrt((errors ** 2).mean()) < 0.115
    covered = (x[:, -1] > found["lower"]) & (x[:, -1] < found["upper"])
    assert covered.mean() > 0.75


def test_a_bad_series_fails_alone():
    good = [0.5, 0.6, 0.55, 0.5]
    for method in ("arima", "arima_ml"):
        rows = forecast_rows([good, [0.5, float("inf"), 0.2, 0.1], [0.1], None, good], method, 3, {})
        assert rows[0] == rows[4] and rows[0][0] is not None and rows[0][4] is None
        assert rows[1][0] is None and rows[1][4] == "values that are not finite"
        assert rows[2] == rows[3] == (None,) * 5


@pytest.fixture(scope="module")
def panel(spark):
    return planted_panel(spark, SF_SMALL)


@pytest.mark.parametrize("forecast", ["arima", "arima_ml"])
@pytest.mark.parametrize("period", ["all", "monthly"])
def test_range_equals_single_months(panel, forecast, period):
    orders = {"max_p": 1, "max_d": 1} | ({"max_q": 1} if forecast == "arima_ml" else {})
    months = ["2019-05", "2019-06"]
    ranged = nrt_range(panel, *months, DW, period=period, drained_only=False, forecast=forecast, orders=orders)
    single = None
    for m in months:
        part = nrt_month(panel, m, DW, period=period, drained_only=False, forecast=forecast, orders=orders)
        single = part if single is None else single.unionByName(part)
    keys = ["analysis_month", "id_geohash", "water_predicted", "water_predicted_lower_90", "water_residual",
            "drainage_confidence"]
    assert sorted(map(tuple, ranged.select(*keys).collect())) == sorted(map(tuple, single.select(*keys).collect()))


def test_a_poisoned_lake_is_counted_and_the_month_complete(spark, panel, tmp_path):
    prepared = prepare(panel, DW)
    bad = prepared.withColumn("water_norm", F.when(
        (F.col("id_geohash") == "lk000003") & (F.col("date") == F.lit("2018-04-01").cast("date")), F.lit(float("inf")))
        .otherwise(F.col("water_norm")))
    for forecast in ("ar1", "arima_ml"):
        rows = nrt_all_dates(bad, DW, "2019-06", "2019-06", forecast=forecast, mark_failed=True).collect()
        whole = {r.id_geohash: r for r in nrt_all_dates(prepared, DW, "2019-06", "2019-06", forecast=forecast).collect()}
        assert {r.id_geohash for r in rows if r.failed} == {"lk000003"} and len(rows) == len(whole)
        assert all(r.water_predicted is None for r in rows if r.failed)
        assert all(r.water_predicted == whole[r.id_geohash].water_predicted for r in rows if not r.failed)


def test_job_writes_failures_beside_counts(spark, panel, tmp_path):
    out = str(tmp_path / "job")
    counts = run_nrt_range(panel, "2019-04", "2019-06", out, DW, forecast="arima_ml", orders={"max_p": 1, "max_q": 1})
    assert set(counts.columns) == {"analysis_month", "drained_lake_count"} and counts.count() == 3
    failed = read_counts(spark, f"{out}/counts", failed=True).collect()
    assert [r.failed for r in failed] == [0, 0, 0]
    breaks = spark.read.parquet(f"{out}/breaks")
    assert "failed" not in breaks.columns
    assert breaks.count() == sum(r.drained_lake_count for r in failed)


def test_unknown_forecast(panel):
    with pytest.raises(ValueError):
        nrt_breaks(prepare(panel, DW), DW, "2019-06", forecast="ets")
