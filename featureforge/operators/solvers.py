"""Small dense solves on moment matrices (features × features), run inside tasks.

Inputs are the covariance ``C`` of the scaled features, their covariance ``r``
with the target, and the number of training rows ``n``.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-12


def f_scores(cov: np.ndarray, cov_y: np.ndarray, var_y: float, n: float) -> np.ndarray:
    """Univariate F statistic per feature; 0 for a constant feature, infinite for a perfect fit."""
    var = np.diag(cov)
    den = var * var_y
    ok = (var > EPS * max(var.max(initial=0.0), 1e-300)) & (var_y > 0)
    r2 = np.zeros_like(var)
    r2[ok] = np.minimum(cov_y[ok] ** 2 / den[ok], 1.0)
    with np.errstate(divide="ignore"):
        return np.where(r2 < 1.0, r2 / np.where(r2 < 1.0, 1.0 - r2, 1.0), np.inf) * max(n - 2.0, 0.0)


def capped(wanted: int, p: int, n: float) -> int:
    return max(1, min(wanted, p, int(n) - 1))


def best_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns with the k largest scores, in column order; of equal scores the later one counts."""
    return np.sort(np.argsort(scores, kind="stable")[-k:])


def principal_axes(cov: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their axes; the largest entry of every axis is positive."""
    lam, vec = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(lam)[::-1][:m]
    vec = vec[:, order]
    signs = np.sign(vec[np.argmax(np.abs(vec), axis=0), np.arange(vec.shape[1])])
    return lam[order], vec * np.where(signs == 0, 1.0, signs)


def reduction_basis(name: str, cov, cov_y, var_y: float, n: float) -> np.ndarray:
    """Matrix from scaled features to model inputs: all, the k best, or m principal axes."""
    p = len(cov_y)
    if name in ("none", "all_features"):
        return np.eye(p)
    if name.startswith("select_k_"):
        k = capped(int(name.removeprefix("select_k_")), p, n)
        return np.eye(p)[:, best_k(f_scores(cov, cov_y, var_y, n), k)]
    if name.startswith("pca_"):
        return principal_axes(cov, capped(int(name.removeprefix("pca_")), p, n))[1]
    raise ValueError(f"Unknown reduction: {name}")


def ols(cov, cov_y, n) -> np.ndarray:
    """Least squares; the solution of least norm where columns are dependent."""
    lam, vec = np.linalg.eigh((cov + cov.T) / 2)
    keep = lam > max(lam.max(initial=0.0), 0.0) * len(lam) * EPS
    return vec[:, keep] @ ((vec[:, keep].T @ cov_y) / lam[keep])


def ridge(cov, cov_y, n, alpha: float) -> np.ndarray:
    """Minimises ‖y − Xw‖² + alpha ‖w‖²."""
    return np.linalg.solve(cov * n + alpha * np.eye(len(cov_y)), cov_y * n)


def _settled(cov, cov_y, w, soft: float, ridge_part: float) -> np.ndarray | None:
    """Exact solution for the signs of ``w``, if these signs are right."""
    on = np.flatnonzero(w)
    out = np.zeros_like(w)
    if len(on):
        sign = np.sign(w[on])
        try:
            out[on] = np.linalg.solve(
                cov[np.ix_(on, on)] + ridge_part * np.eye(len(on)), cov_y[on] - soft * sign
            )
        except np.linalg.LinAlgError:
            return None
        if np.any(np.sign(out[on]) != sign):
            return None
    gap = np.abs(cov_y - cov @ out - ridge_part * out)
    gap[on] = 0.0
    return out if np.all(gap <= soft * (1 + 1e-9) + 1e-12) else None


def elastic_net(cov, cov_y, n, alpha: float, l1_ratio: float, max_iter: int = 50_000, tol: float = 1e-10):
    """Minimises ‖y − Xw‖²/2n + alpha·l1‖w‖₁ + alpha(1 − l1)‖w‖²/2.

    Coordinate descent finds the signs; as soon as they satisfy the optimality
    conditions, one linear solve gives the exact answer.
    """
    soft, ridge_part = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(len(cov_y))
    gap = cov_y.astype(float).copy()
    diag = np.diag(cov).copy()
    free = np.flatnonzero(diag > EPS)
    stop = tol * max(np.abs(cov_y).max(initial=0.0), 1e-300)
    attempt = 4
    for sweep in range(1, max_iter + 1):
        largest = 0.0
        for j in free:
            rho = gap[j] + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - soft, 0.0) / (diag[j] + ridge_part)
            step = new - w[j]
            if step:
                gap -= cov[:, j] * step
                w[j] = new
                largest = max(largest, abs(step) * diag[j])
        if largest <= stop:
            break
        if sweep == attempt:
            exact = _settled(cov, cov_y, w, soft, ridge_part)
            if exact is not None:
                return exact
            attempt *= 2
    return w


def pls(cov, cov_y, n, components: int) -> np.ndarray:
    """Partial least squares for one target, by deflating the moments; columns get unit variance first."""
    p = len(cov_y)
    if not 1 <= components <= min(p, int(n)):
        raise ValueError(f"components must be between 1 and {min(p, int(n))}, got {components}")
    spread = np.sqrt(np.diag(cov))
    spread = np.where(spread > 0, spread, 1.0)
    s, g = cov / np.outer(spread, spread), cov_y / spread
    weights, loadings, inner = [], [], []
    for _ in range(components):
        norm = np.linalg.norm(g)
        if norm <= EPS:
            break
        w = g / norm
        sw = s @ w
        tt = float(w @ sw)
        if tt <= EPS:
            break
        weights.append(w)
        loadings.append(sw / tt)
        inner.append(float(g @ w) / tt)
        s = s - np.outer(sw, sw) / tt
        g = g - sw * inner[-1]
    if not weights:
        return np.zeros(p)
    w, load = np.array(weights).T, np.array(loadings).T
    return (w @ np.linalg.solve(load.T @ w, np.array(inner))) / spread


LINEAR = {"ols": ols, "ridge": ridge, "elastic_net": elastic_net, "pls": pls}
