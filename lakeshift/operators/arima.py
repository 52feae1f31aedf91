"""Non-seasonal ARIMA by maximum likelihood, many series at a time.

Differences come from the KPSS test of a constant level, orders from a
stepwise search by the corrected Akaike criterion, coefficients from the
exact Gaussian likelihood of the ARMA process in state-space form. Series
differ in length, so a batch is an array with the series at its right edge
and unseen values before them: the filter starts from the stationary
distribution, which unseen steps leave as it is.

All steps are numpy over the batch; nothing loops over series. The mean and
the noise variance are solved in closed form inside the likelihood, and the
search runs over partial autocorrelations, so every point of it is
stationary and invertible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Two-sided 90 % normal quantile, and the 5 % point of the KPSS test of a constant level.
Z90 = 1.6448536269514722
KPSS_5 = 0.463


def aligned(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as rows of one array, at its right edge, and which entries are theirs."""
    width = max((len(s) for s in series), default=0)
    z, seen = np.zeros((len(series), width)), np.zeros((len(series), width), bool)
    for i, s in enumerate(series):
        if len(s):
            z[i, -len(s):], seen[i, -len(s):] = s, True
    return z, seen


def kpss(z: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The KPSS statistic of a constant level, with Bartlett weights over ``4 (n / 100)^(1/4)`` lags."""
    n = seen.sum(1)
    safe = np.maximum(n, 1)
    e = np.where(seen, z - (z.sum(1) / safe)[:, None], 0.0)
    lags = np.floor(4.0 * (n / 100.0) ** 0.25)
    spread = (e * e).sum(1) / safe
    for k in range(1, int(lags.max(initial=0)) + 1):
        weight = np.where(k <= lags, 1.0 - k / (lags + 1.0), 0.0)
        spread += 2.0 * weight * (e[:, k:] * e[:, :-k]).sum(1) / safe
    paths = np.where(seen, np.cumsum(e, 1), 0.0)
    level = (z * z).sum(1) / safe
    flat = spread <= 1e-20 * np.maximum(level, 1e-300)
    return np.where(flat, 0.0, (paths ** 2).sum(1) / safe ** 2 / np.where(flat, 1.0, spread))


def differences(z: np.ndarray, seen: np.ndarray, max_d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each series differenced until the test accepts a level; values, mask and how often."""
    z, seen, d = z.copy(), seen.copy(), np.zeros(len(z), int)
    for k in range(max_d):
        again = (d == k) & (kpss(z, seen) > KPSS_5) & (seen.sum(1) > 3)
        if not again.any():
            break
        own = z[again]
        both = seen[again] & np.pad(seen[again], ((0, 0), (1, 0)))[:, :-1]
        z[again] = np.where(both, own - np.pad(own, ((0, 0), (1, 0)))[:, :-1], 0.0)
        seen[again] = both
        d[again] += 1
    return z, seen, d


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of the autoregression with partial autocorrelations ``r`` (rows)."""
    out = r[:, :0]
    for k in range(r.shape[1]):
        out = np.concatenate([out - r[:, k: k + 1] * out[:, ::-1], r[:, k: k + 1]], 1)
    return out


def coefficients(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA coefficients of unbounded parameters: stationary and invertible."""
    r = np.tanh(x)
    return from_partial(r[:, :p]), -from_partial(r[:, p: p + q])


def likelihood(z: np.ndarray, seen: np.ndarray, phi: np.ndarray, theta: np.ndarray, mean: np.ndarray) -> dict:
    """Exact log likelihood of each row, its variance, and the forecast of the next value.

    ``mean`` says which rows have one; the series and a row of ones run
    through the same filter, which gives the best mean in closed form.
    """
    rows, p, q = len(z), phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    ar = np.pad(phi, ((0, 0), (0, r - p)))
    load = np.concatenate([np.ones((rows, 1)), np.pad(theta, ((0, 0), (0, r - 1 - q)))], 1)
    noise = load[:, :, None] * load[:, None, :]
    move = np.zeros((rows, r, r))
    move[:, :, 0] = ar
    move[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    kron = np.einsum("nij,nkl->nikjl", move, move).reshape(rows, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - kron, noise.reshape(rows, r * r, 1)).reshape(rows, r, r)
    state = np.zeros((rows, r, 2))
    yy, y1, one, logs = (np.zeros(rows) for _ in range(4))
    for t in range(z.shape[1]):
        here = seen[:, t]
        f = np.maximum(cov[:, 0, 0], 1e-12)
        e = np.stack([z[:, t], np.ones(rows)], 1) - state[:, 0]
        yy += np.where(here, e[:, 0] ** 2 / f, 0.0)
        y1 += np.where(here, e[:, 0] * e[:, 1] / f, 0.0)
        one += np.where(here, e[:, 1] ** 2 / f, 0.0)
        logs += np.where(here, np.log(f), 0.0)
        gain = np.where(here[:, None], cov[:, :, 0] / f[:, None], 0.0)
        state = state + gain[:, :, None] * e[:, None]
        cov = cov - gain[:, :, None] * gain[:, None] * f[:, None, None]
        state = ar[:, :, None] * state[:, :1] + np.pad(state, ((0, 0), (0, 1), (0, 0)))[:, 1:]
        half = ar[:, :, None] * cov[:, :1] + np.pad(cov, ((0, 0), (0, 1), (0, 0)))[:, 1:]
        cov = half[:, :, :1] * ar[:, None] + np.pad(half, ((0, 0), (0, 0), (0, 1)))[:, :, 1:] + noise
    n = np.maximum(seen.sum(1), 1)
    mu = np.where(mean & (one > 0), y1 / np.where(one > 0, one, 1.0), 0.0)
    sigma2 = np.maximum(yy - 2 * mu * y1 + mu * mu * one, 0.0) / n
    floor = 1e-24 * np.maximum((z * z).sum(1) / n, 1e-300)
    loglik = -0.5 * (n * np.log(2 * np.pi * np.maximum(sigma2, floor)) + logs + n)
    ahead = mu + state[:, 0, 0] - mu * state[:, 0, 1]
    return {"loglik": loglik, "sigma2": sigma2, "mu": mu, "ahead": ahead, "spread": sigma2 * cov[:, 0, 0]}


def fitted(z: np.ndarray, seen: np.ndarray, p: int, q: int, mean: np.ndarray, steps: int = 40) -> dict:
    """The likelihood at its highest point found: a compass search from zero, each row with its own step."""
    rows, k = len(z), p + q
    x, width = np.zeros((rows, k)), np.full(rows, 0.5)
    best = likelihood(z, seen, *coefficients(x, p, q), mean)
    if not k:
        return best
    moves = np.concatenate([np.eye(k), -np.eye(k)])
    for _ in range(steps):
        live = np.flatnonzero(width > 2e-3)
        if not len(live):
            break
        tries = x[live][:, None] + width[live][:, None, None] * moves[None]
        many = np.repeat(live, 2 * k)
        found = likelihood(z[many], seen[many], *coefficients(tries.reshape(-1, k), p, q), mean[many])
        score = found["loglik"].reshape(len(live), 2 * k)
        pick = score.argmax(1)
        better = score[np.arange(len(live)), pick] > best["loglik"][live] + 1e-9
        took = np.arange(len(live)) * 2 * k + pick
        x[live[better]] = tries.reshape(-1, k)[took[better]]
        for name, values in found.items():
            best[name][live[better]] = values[took[better]]
        width[live[~better]] /= 2.0
    return best


def neighbours(p: int, q: int, max_p: int, max_q: int) -> Iterator[tuple[int, int]]:
    for dp, dq in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1)):
        if 0 <= p + dp <= max_p and 0 <= q + dq <= max_q:
            yield p + dp, q + dq


def one_step(series: list[np.ndarray], max_p: int = 2, max_d: int = 2, max_q: int = 2) -> dict[str, np.ndarray]:
    """``predicted, lower, upper`` of the value after each series, and the orders ``p, d, q`` chosen.

    Series differenced fewer than twice have a mean (a drift, if differenced
    once). An order is tried where the series has two values more than it
    has parameters. Equal criteria: the order tried first.
    """
    raw, there = aligned(series)
    z, seen, d = differences(raw, there, max_d)
    rows, n, mean = len(z), seen.sum(1), d < 2
    best = {name: np.zeros(rows) for name in ("ahead", "spread")}
    value, order = np.full(rows, np.inf), np.zeros((rows, 2), int)
    tried: list[set] = [set() for _ in range(rows)]

    def attempt(which: np.ndarray, p: int, q: int) -> None:
        count = p + q + 1 + mean[which]
        allowed = (p + q == 0) | (n[which] >= count + 2)
        for i in which:
            tried[i].add((p, q))
        which, count = which[allowed], count[allowed]
        if not len(which):
            return
        found = fitted(z[which], seen[which], p, q, mean[which])
        room = n[which] - count - 1
        score = np.where(room > 0, 2 * count - 2 * found["loglik"] + 2 * count * (count + 1) / np.maximum(room, 1), 1e300)
        better = score < value[which] - 1e-9
        own = which[better]
        value[own], order[own] = score[better], (p, q)
        for name in best:
            best[name][own] = found[name][better]

    everyone = np.arange(rows)
    starts = dict.fromkeys([(0, 0), (min(2, max_p), min(2, max_q)), (min(1, max_p), 0), (0, min(1, max_q))])
    for p, q in starts:
        attempt(everyone, p, q)
    moving = everyone
    while len(moving):
        before = value.copy()
        wanted: dict[tuple[int, int], list[int]] = {}
        for i in moving:
            for pq in neighbours(*order[i], max_p, max_q):
                if pq not in tried[i]:
                    wanted.setdefault(pq, []).append(i)
        for (p, q), which in sorted(wanted.items()):
            attempt(np.array(which), p, q)
        moving = np.flatnonzero(value < before)
    # undo the differences with the last values of the series and of its first difference
    last = np.array([s[-1] if len(s) else np.nan for s in series])
    step = np.array([s[-1] - s[-2] if len(s) > 1 else 0.0 for s in series])
    predicted = best["ahead"] + np.where(d >= 1, last, 0.0) + np.where(d >= 2, step, 0.0)
    half = Z90 * np.sqrt(best["spread"])
    return {"predicted": predicted, "lower": predicted - half, "upper": predicted + half,
            "p": order[:, 0], "d": d, "q": order[:, 1]}
