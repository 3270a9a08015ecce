"""State-space model over years: Polya-Gamma weights, Kalman filter, RTS smoother, EM and posterior paths.

State: weights of the random features, a random walk with variance tau2 a year. The surveys of a year enter an update either as
rows of features (fewer rows than weights) or as sums (Phi' W Phi, Phi' W z and three numbers), which add up over blocks
of rows; `fitting` makes these sums in many tasks. A pass keeps one covariance of (2D)^2 doubles a year, as the
prediction for a year is the filter of the year before plus tau2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

Z0 = float(np.log(0.001 / 0.999))  # the logit of the prior prevalence
JITTER = 1e-10


@dataclass
class Year:
    """Surveys of a year: features (n x 2D), positives and samples; n may be 0."""

    phi: np.ndarray
    y: np.ndarray
    n: np.ndarray


@dataclass
class Passes:
    """Filtered means and covariances by year; those predicted for a year follow from the year before."""

    m_filt: np.ndarray
    c_filt: np.ndarray
    tau2: float
    loglik: float = 0.0

    def m_pred(self, t: int) -> np.ndarray:
        return self.m_filt[t - 1] if t else np.zeros_like(self.m_filt[0])

    def c_pred(self, t: int) -> np.ndarray:
        return (self.c_filt[t - 1] if t else 0) + self.tau2 * np.eye(self.m_filt.shape[1])


def pg_weights(n: np.ndarray, z: np.ndarray) -> np.ndarray:
    a = np.maximum(np.abs(z), 1e-6)
    with np.errstate(invalid="ignore"):
        w = np.where(np.isfinite(z) & (np.abs(z) >= 1e-6), 0.5 * n / a * np.tanh(a / 2), n / 4)
    return np.maximum(w, 1e-10)


@dataclass
class Information:
    """What the surveys of a year say: sums over surveys of w phi phi', w z phi, w z z, log w, and their number."""

    s: np.ndarray
    h: np.ndarray
    q: float
    log_w: float
    n: int


    @staticmethod
    def zero(d: int) -> Information:
        return Information(np.zeros((d, d)), np.zeros(d), 0.0, 0.0, 0)

    def add(self, phi: np.ndarray, z: np.ndarray, w: np.ndarray) -> Information:
        wphi = w[:, None] * phi
        self.s += phi.T @ wphi
        self.h += wphi.T @ z
        self.q += float(z @ (w * z))
        self.log_w += float(np.log(w).sum())
        self.n += len(z)
        return self

    def merge(self, other: Information) -> Information:
        self.s += other.s
        self.h += other.h
        self.q, self.log_w, self.n = self.q + other.q, self.log_w + other.log_w, self.n + other.n
        return self


def information(year: Year, target: np.ndarray, omega: np.ndarray, at_once: int = 4096) -> Information:
    out = Information.zero(year.phi.shape[1])
    for k in range(0, len(year.y), at_once):
        out.add(year.phi[k : k + at_once], target[k : k + at_once], omega[k : k + at_once])
    return out


def pseudo(phi: np.ndarray, y: np.ndarray, n: np.ndarray, b: np.ndarray, z0: float = Z0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pseudo-observations of surveys at weights b."""
    w = pg_weights(n, z0 + phi @ b)
    return w, (y - n / 2) / w - z0


def update_rows(m: np.ndarray, c: np.ndarray, phi: np.ndarray, z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and covariance after surveys z = phi b + N(0, 1/w), as a solve in the surveys; and their log-likelihood."""
    pc = phi @ c
    root = np.linalg.cholesky(pc @ phi.T + np.diag(1 / w) + JITTER * np.eye(len(z)))
    both = np.linalg.solve(root, np.column_stack([pc, z - phi @ m]))
    half, white = both[:, :-1], both[:, -1]
    return m + half.T @ white, c - half.T @ half, -float(np.log(np.diag(root)).sum() + 0.5 * (white @ white + len(z) * np.log(2 * np.pi)))


def update_sums(m: np.ndarray, c: np.ndarray, info: Information) -> tuple[np.ndarray, np.ndarray, float]:
    """The same in the weights (information form)."""
    root = np.linalg.cholesky(c)
    inner = np.linalg.cholesky(np.eye(len(m)) + root.T @ info.s @ root)
    half = np.linalg.solve(inner, root.T)
    g = info.h - info.s @ m  # sum of w phi (z - phi m)
    miss = info.q - 2 * m @ info.h + m @ info.s @ m
    c = half.T @ half
    return m + c @ g, c, -float(np.log(np.diag(inner)).sum() + 0.5 * (miss - g @ c @ g - info.log_w + info.n * np.log(2 * np.pi)))


def filter_years(d: int, years: Iterable, tau2: float) -> Passes:
    """The filter from b_0 = 0 exactly; years gives for each year, in order, None, Information or (phi, z, w)."""
    means, covariances, loglik = [], [], 0.0
    m, c = np.zeros(d), np.zeros((d, d))
    for said in years:
        c = c + tau2 * np.eye(d)
        if said is not None:
            m, c, new = update_sums(m, c, said) if isinstance(said, Information) else update_rows(m, c, *said)
            c = (c + c.T) / 2
            loglik += new
        means.append(m)
        covariances.append(c)
    return Passes(np.array(means), np.array(covariances), tau2, loglik)


def said_by(phi: np.ndarray, z: np.ndarray, w: np.ndarray):
    """What filter_years takes for surveys in memory: rows if they are fewer than weights, else their sums."""
    if len(z) == 0:
        return None
    return (phi, z, w) if len(z) < phi.shape[1] else information(Year(phi, z, w), z, w)


def kalman_filter(years: list[Year], target: list[np.ndarray], omega: list[np.ndarray], tau2: float) -> Passes:
    """Filter of pseudo-observations target = phi b + N(0, 1/omega)."""
    return filter_years(years[0].phi.shape[1], (said_by(y.phi, z, w) for y, z, w in zip(years, target, omega)), tau2)


def gain(p: Passes, t: int) -> np.ndarray:
    """Smoother gain C_filt(t) C_pred(t+1)^-1."""
    return np.linalg.solve(p.c_pred(t + 1), p.c_filt[t]).T


def smoothed_means(p: Passes) -> np.ndarray:
    """The smoother's means alone: a solve for one vector a year instead of a gain."""
    m = p.m_filt.copy()
    for t in range(len(m) - 2, -1, -1):
        m[t] += p.c_filt[t] @ np.linalg.solve(p.c_pred(t + 1), m[t + 1] - p.m_pred(t + 1))
    return m


def rts_smoother(p: Passes, covariances: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    m = p.m_filt.copy()
    c = p.c_filt.copy() if covariances else None
    for t in range(len(m) - 2, -1, -1):
        j = gain(p, t)
        m[t] += j @ (m[t + 1] - p.m_pred(t + 1))
        if c is not None:
            c[t] += j @ (c[t + 1] - p.c_pred(t + 1)) @ j.T
    return m, c


def em(years: list[Year], tau2: float, rounds: int = 5, z0: float = Z0) -> tuple[np.ndarray, Passes, list[float]]:
    """Smoothed weights, the last pass and the relative change of each round; a fixed number of rounds."""
    b = np.zeros((len(years), years[0].phi.shape[1]))
    change = []
    for _ in range(rounds):
        omega, target = zip(*(pseudo(yr.phi, yr.y, yr.n, b[i], z0) for i, yr in enumerate(years)))
        p = kalman_filter(years, target, omega, tau2)
        new = smoothed_means(p)
        change.append(float(np.linalg.norm(new - b) / np.sqrt(np.linalg.norm(b) ** 2 + 1e-12)))
        b = new
    return b, p, change


def _root(c: np.ndarray, factor: str) -> np.ndarray:
    low = np.linalg.cholesky(c + 1e-9 * max(np.trace(c) / len(c), 1e-12) * np.eye(len(c)))
    return low if factor == "lower" else low.T


def posterior_paths(p: Passes, n: int, seed: int, factor: str = "lower", noise: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
    """n joint draws of the weights (T x 2D x n), backwards in time; gains and roots are made once a year.

    noise: the standard normal numbers (2D x n) of a year, by its place; by default drawn with the seed.
    factor='upper' multiplies by the transposed root, whose draws have another covariance; it is there for comparison.
    """
    rng = np.random.default_rng(seed)
    t, s = p.m_filt.shape
    out = np.zeros((t, s, n))
    noise = noise or (lambda i: rng.normal(size=(s, n)))
    out[-1] = p.m_filt[-1][:, None] + _root(p.c_filt[-1], factor) @ noise(t - 1)
    for i in range(t - 2, -1, -1):
        j = gain(p, i)
        var = p.c_filt[i] - j @ p.c_pred(i + 1) @ j.T
        out[i] = p.m_filt[i][:, None] + j @ (out[i + 1] - p.m_pred(i + 1)[:, None]) + _root((var + var.T) / 2, factor) @ noise(i)
    return out


def gp_equivalent(years: list[Year], target: list[np.ndarray], omega: list[np.ndarray], tau2: float) -> np.ndarray:
    """The smoothed weights by one Gaussian-process solve over all surveys: independent of the filter, for checks and few data."""
    at = np.concatenate([np.full(len(y.y), i + 1) for i, y in enumerate(years)])
    phi = np.concatenate([y.phi for y in years])
    k = tau2 * np.minimum(at[:, None], at[None, :]) * (phi @ phi.T)
    a = np.linalg.solve(k + np.diag(1 / np.concatenate(omega)) + JITTER * np.eye(len(at)), np.concatenate(target))
    return np.array([tau2 * (phi * np.minimum(i + 1, at)[:, None]).T @ a for i in range(len(years))])


def pointwise_interval(phi: np.ndarray, mean: np.ndarray, cov: np.ndarray, z0: float = Z0) -> np.ndarray:
    """Lower and upper 95 % prevalence by a normal interval on the logit, variances as row sums of (phi C) * phi."""
    z, sd = z0 + phi @ mean, np.sqrt(np.maximum(((phi @ cov) * phi).sum(1), 0))
    return 1 / (1 + np.exp(-np.stack([z - 1.96 * sd, z + 1.96 * sd], axis=1)))
