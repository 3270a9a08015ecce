"""Random Fourier features of the squared-exponential kernel, and the prototypes around them, as NumPy kernels."""

from __future__ import annotations

import numpy as np


def frequencies(d: int, ell: float, seed: int, dims: int = 2, spectrum: str = "normal", scale: float = 1.0) -> np.ndarray:
    """d frequencies: normal with standard deviation 1/ell, Cauchy (exponential kernel) or a single value (cosine)."""
    rng = np.random.default_rng(seed)
    if spectrum == "normal":
        return rng.normal(0.0, 1.0 / ell, (d, dims))
    if spectrum == "cauchy":
        return rng.standard_cauchy((d, dims)) * scale / ell
    if spectrum == "delta":
        return np.full((d, dims), scale / ell)
    raise ValueError(f"spectrum must be normal, cauchy or delta, not {spectrum!r}")


def halton_frequencies(d: int, ell: float, dims: int = 2) -> np.ndarray:
    """Quasi-random normal frequencies from the Halton sequence."""
    from statistics import NormalDist

    def radical(i: int, base: int) -> float:
        f, out = 1.0, 0.0
        while i:
            f /= base
            out += f * (i % base)
            i //= base
        return out

    primes = [2, 3, 5, 7, 11, 13][:dims]
    return np.array([[NormalDist().inv_cdf(radical(i, p)) / ell for p in primes] for i in range(1, d + 1)])


def features(xy_km: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """[cos(s omega'), sin(s omega')] / sqrt(D): rows of unit length whose products approach the kernel."""
    a = xy_km @ omega.T
    return np.concatenate([np.cos(a), np.sin(a)], axis=1) / np.sqrt(omega.shape[0])


def squared_kernel(d: np.ndarray, ell: float) -> np.ndarray:
    return np.exp(-(d**2) / (2 * ell**2))


def exponential_kernel(d: np.ndarray, ell: float) -> np.ndarray:
    return np.exp(-d / ell)


def gp_sample(k: np.ndarray, rng: np.random.Generator, jitter: float = 1e-8) -> np.ndarray:
    return np.linalg.cholesky(k + jitter * np.eye(len(k))) @ rng.normal(size=len(k))


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def ridge_cv(x: np.ndarray, y: np.ndarray, penalties: np.ndarray | None = None, folds: int = 10, seed: int = 1) -> tuple[float, np.ndarray]:
    """The penalty with the least cross-validated error of 100 log-spaced ones, and its weights."""
    penalties = np.logspace(-4, 4, 100) if penalties is None else penalties
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    errors = [sum(float(((y[fold == k] - x[fold == k] @ ridge(x[fold != k], y[fold != k], p)) ** 2).sum()) for k in range(folds)) for p in penalties]
    best = float(penalties[int(np.argmin(errors))])
    return best, ridge(x, y, best)


def bayes_linear(x: np.ndarray, y: np.ndarray, noise: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of weights with a normal prior of variance `prior` and noise variance `noise`."""
    cov = np.linalg.inv(x.T @ x / noise + np.eye(x.shape[1]) / prior)
    return cov @ x.T @ y / noise, cov


def bayes_draws(x_new: np.ndarray, mean: np.ndarray, cov: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    root = np.linalg.cholesky(cov + 1e-12 * np.eye(len(cov)))
    return x_new @ (mean[:, None] + root @ rng.normal(size=(len(mean), n)))
