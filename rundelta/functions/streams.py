"""Random streams that depend on a seed and a cohort, never on partitions."""

from __future__ import annotations

import hashlib

import numpy as np

#: Draws of a cohort are made in blocks of this many, each with its own stream.
BLOCK = 1000


def cohort_stream(seed: int, label: str, key: tuple, block: int = 0) -> np.random.Generator:
    """A generator for one block of draws of one cohort."""
    words = hashlib.sha256(repr((label, tuple(map(str, key)), block)).encode()).digest()
    return np.random.default_rng(np.random.SeedSequence([seed, *np.frombuffer(words, dtype="<u4").tolist()]))


def log_gamma(x):
    """Natural log of the gamma function for positive arguments."""
    x = np.asarray(x, dtype=float)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def odp_lpdf(y, mu, phi):
    """Over-dispersed Poisson: y / phi is Poisson with mean mu / phi, as a density of the amount."""
    k = np.asarray(y, dtype=float) / phi
    m = np.asarray(mu, dtype=float) / phi
    return k * np.log(m) - m - log_gamma(k + 1) - np.log(phi)


def odp_draw(rng, mu, phi):
    """phi times a Poisson draw of mu / phi, with the sign of mu; above the sampler's range the mean itself."""
    rate = np.abs(mu) / phi
    return np.where(rate > 1e15, mu, np.sign(mu) * phi * rng.poisson(np.minimum(rate, 1e15)))


def nelder_mead(f, start, scale=0.1, rounds=2000, tolerance=1e-12):
    """Minimum of a function of a few variables by the simplex method."""
    x = [np.array(start, dtype=float)]
    for i in range(len(start)):
        p = x[0].copy()
        p[i] += scale if p[i] == 0 else scale * abs(p[i])
        x.append(p)
    v = [f(p) for p in x]
    for _ in range(rounds):
        order = np.argsort(v)
        x, v = [x[i] for i in order], [v[i] for i in order]
        if abs(v[-1] - v[0]) <= tolerance * (abs(v[0]) + tolerance) and np.abs(x[-1] - x[0]).max() < 1e-9:
            break
        centre = np.mean(x[:-1], axis=0)
        away = centre + (centre - x[-1])
        fa = f(away)
        if fa < v[0]:
            far = centre + 2 * (centre - x[-1])
            ff = f(far)
            x[-1], v[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < v[-2]:
            x[-1], v[-1] = away, fa
        else:
            near = centre + 0.5 * ((away if fa < v[-1] else x[-1]) - centre)
            fn = f(near)
            if fn < min(fa, v[-1]):
                x[-1], v[-1] = near, fn
            else:
                x = [x[0]] + [x[0] + 0.5 * (p - x[0]) for p in x[1:]]
                v = [v[0]] + [f(p) for p in x[1:]]
    best = int(np.argmin(v))
    return x[best], v[best]
