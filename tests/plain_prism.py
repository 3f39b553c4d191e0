"""Segmented fits by brute force on numpy arrays: a coarse grid of breaks, then a fine one, each combination solved by least squares."""

from math import exp, lgamma, log

import numpy as np

from gridloom.operators.prism import BEYOND, COARSE, COOLING, HEATING

FINE = 0.05


def evaluate(model: str, t: np.ndarray, p: dict) -> np.ndarray:
    """Load at temperatures t."""
    y = np.full(len(t), p["y1"], float)
    if model in ("2ch", "3sg", "3be", "4sg"):
        y += np.where(t < p["x1"], p["k1"] * (t - p["x1"]), 0.0)
    if model in ("2cl", "3sg", "4sg"):
        y += np.where(t > p["x2"], p["k2"] * (t - p["x2"]), 0.0)
    if model in ("3be", "4sg"):
        y = np.where(t <= p["x0"], p["y0"] + p["k0"] * (t - p["x0"]), y)
    return y


def _grid(model: str, t: np.ndarray, step: float, around: dict | None) -> list[np.ndarray]:
    """Columns of break candidates (x0, x1, x2), as far as the model has them."""
    ranges = []
    if model in ("3be", "4sg"):
        ranges.append(("x0", (float(max(t.min(), -40.0)), 0.0)))
    if model != "2cl":
        ranges.append(("x1", HEATING))
    if model in ("2cl", "3sg", "4sg"):
        ranges.append(("x2", COOLING))
    axes = []
    for name, (low, high) in ranges:
        if around is not None:
            low, high = max(low, around[name] - COARSE), min(high, around[name] + COARSE)
        axes.append(np.arange(low, high + 1e-9, step if around is not None or model != "4sg" else 2 * step))
    grid = [g.ravel() for g in np.meshgrid(*axes, indexing="ij")]
    names = [n for n, _ in ranges]
    keep = np.ones(len(grid[0]), bool)
    for a, b in (("x0", "x1"), ("x1", "x2")):
        if a in names and b in names:
            keep &= grid[names.index(a)] <= grid[names.index(b)] - (1e-9 if a == "x0" else 0)
    return [g[keep] for g in grid]


def _best(model: str, t: np.ndarray, y: np.ndarray, step: float, around: dict | None) -> dict | None:
    """The parameters of least error among break candidates whose slopes and levels have the right signs."""
    breaks = _grid(model, t, step, around)
    if not len(breaks[0]):
        return None
    left = [True, True, False] if model == "4sg" else {"3be": [True, True], "3sg": [True, False], "2ch": [True], "2cl": [False]}[model]
    columns, places, at = [np.ones((len(t), 1))], [], 1
    for g, down in zip(breaks, left, strict=True):
        values, inverse = np.unique(g, return_inverse=True)
        columns.append(np.maximum(values - t[:, None], 0) if down else np.maximum(t[:, None] - values, 0))
        places.append(at + inverse)
        at += len(values)
    design = np.hstack(columns)
    products, target = design.T @ design, design.T @ y
    own = np.stack([np.zeros(len(breaks[0]), int), *places], 1)
    a, b = products[own[:, :, None], own[:, None, :]], target[own]
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-12))
    a = a / scale[:, :, None] / scale[:, None, :] + 1e-10 * np.eye(own.shape[1])
    x = np.linalg.solve(a, (b / scale)[..., None])[..., 0] / scale
    error = float(y @ y) - (x * b).sum(1)
    names = [n for n in ("x0", "x1", "x2") if (n == "x0") <= (model in ("3be", "4sg")) and (n == "x1") <= (model != "2cl") and (n == "x2") <= (model in ("2cl", "3sg", "4sg"))]
    ok = x[:, 0] >= 0
    if "x1" in names:
        ok &= x[:, 1 + names.index("x1")] >= 0
    if "x2" in names:
        ok &= x[:, 1 + names.index("x2")] >= 0
    if not ok.any():
        return None
    g = int(np.where(ok, error, np.inf).argmin())
    p = {"x0": -10.0, "x1": 10.0, "x2": 20.0, "y0": 0.0, "y1": float(x[g, 0]), "k0": 0.0, "k1": 0.0, "k2": 0.0}
    p |= {n: float(breaks[k][g]) for k, n in enumerate(names)}
    if "x1" in names:
        p["k1"] = -float(x[g, 1 + names.index("x1")])
    if "x2" in names:
        p["k2"] = float(x[g, 1 + names.index("x2")])
    if "x0" in names:
        p["k0"] = p["k1"] - float(x[g, 1])
        p["y0"] = p["y1"] + p["k1"] * (p["x0"] - p["x1"])
    return p


def f_density(x: float, d1: int, d2: int) -> float:
    """The density of the F distribution."""
    a, b = d1 / 2, d2 / 2
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(d1 / d2) + (a - 1) * log(x) - (a + b) * log(1 + d1 * x / d2))


def f_critical(level: float, d1: int, d2: int) -> float:
    """The value that an F variable exceeds with probability level, by integration of the density and bisection."""
    u = (np.arange(4000) + 0.5) / 4000  # x = u / (1 - u)
    density = np.array([f_density(v / (1 - v), d1, d2) / (1 - v) ** 2 for v in u]) / 4000
    k = int(np.searchsorted(np.cumsum(density), 1 - level))
    v = u[min(k, len(u) - 1)]
    return float(v / (1 - v))


def _valid(model: str, t: np.ndarray, p: dict) -> bool:
    cold = model == "2cl" or (p["k1"] < 0 and (t < p["x1"]).sum() > BEYOND)
    warm = model in ("2ch", "3be") or (p["k2"] > 0 and (t > p["x2"]).sum() > BEYOND)
    return bool(cold and warm and (model not in ("3be", "4sg") or p["k0"] >= 0))


def fit_segments(t: np.ndarray, y: np.ndarray, models: tuple[str, ...] = ("2ch", "2cl", "3seg"), f_rule: str = "pdf") -> dict | None:
    """The chosen model with its parameters, errors and all candidates; None if no model has slopes of the right signs.

    More segments win if the F statistic exceeds a threshold: with f_rule "pdf" the density at 0.05
    (a very lenient rule, kept for equal choices), with "critical" the 5 % critical value. If the winner isn't
    among models the allowed candidate of least error replaces it.
    """
    n, fits = len(t), {}
    for name in ("2ch", "2cl", "3sg", "3be", "4sg"):
        rough = _best(name, t, y, COARSE, None)
        fine = _best(name, t, y, FINE if name != "4sg" else 4 * FINE, rough) if rough else None
        if fine:
            p = {k: round(v, 4) for k, v in fine.items()}
            sse = float(((y - evaluate(name, t, p)) ** 2).sum())
            fits[name] = {"p": p, "sse": sse, "cvrmse": float(np.sqrt(sse / max(n - 3, 1)) / max(y.mean(), 1e-9))}
    if not fits:
        return None
    good = {m: m in fits and _valid(m, t, fits[m]["p"]) for m in ("2ch", "2cl", "3sg", "3be", "4sg")}

    def pick(names: tuple[str, ...], default: str) -> tuple[str, float]:
        valid = [m for m in names if good[m]]
        best = min(valid, key=lambda m: fits[m]["sse"], default=default)
        return best, fits[best]["sse"] if valid else np.inf

    two, three, four = pick(("2ch", "2cl"), "2cl"), pick(("3sg", "3be"), "3be"), pick(("4sg",), "4sg")

    def better(a: float, b: float, k_a: int, k_b: int) -> bool:
        free = max(n - k_b + 1, 1)
        if not np.isfinite(b):
            return False
        ratio = (a - b) / (k_b - k_a) / max(b / free, 1e-9)
        return ratio > (f_density(0.05, k_b - k_a, free) if f_rule == "pdf" else f_critical(0.05, k_b - k_a, free))

    name = two[0]
    if np.isfinite(three[1]):
        if better(two[1], three[1], 3, 5):
            name = three[0]
        if better(two[1], four[1], 3, 7) or better(three[1], four[1], 5, 7):
            name = four[0]
    allowed = {m.replace("3seg", "3sg") for m in models} & set(fits)
    if name not in allowed and allowed:
        name = min(sorted(allowed), key=lambda m: fits[m]["sse"])
    if name not in fits:
        name = min(fits, key=lambda m: fits[m]["sse"])
    return {"model": name, **fits[name], "candidates": fits}
