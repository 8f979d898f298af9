"""Degree distributions as expressions of uniform columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopframe.functions.rng import standard_normal, uniform
from hopframe.plans.degree import zeta_tail

HEAD = 64
SEARCH = 3  # steps around the continuous guess that the exact inversion looks at
PART = 64.0  # a Poisson variable is summed from parts with at most this mean


def _count_below(cdf: list[float], u: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in cdf]), lambda c: c <= u))


def zipf_table(gamma: float) -> list[float]:
    """P(degree <= k) for k = 1..HEAD."""
    if gamma <= 1:
        raise ValueError("gamma must exceed 1")
    z = float(zeta_tail(gamma, 1.0))
    cdf, acc = [], 0.0
    for k in range(1, HEAD + 1):
        acc += k ** -gamma / z
        cdf.append(acc)
    return cdf


def tail_terms(gamma: float) -> list[tuple[float, float]]:
    """(factor, power) of the Euler-Maclaurin series of sum(j^-gamma, j >= k) in powers of k.

    Beyond HEAD the first term left out is below 1e-12 of the sum.
    """
    g = gamma
    return [(1 / (g - 1), 1 - g), (0.5, -g), (g / 12, -g - 1), (-g * (g + 1) * (g + 2) / 720, -g - 3)]


def zipf_degree(u: Column, gamma: float, n: int) -> Column:
    """Power-law degree P(k) ~ k^-gamma, k >= 1, capped at n - 1: the exact inverse CDF of a uniform.

    The smallest k whose remaining mass sum(j^-gamma, j > k) is at most (1 - u) * zeta(gamma). The table holds the sums
    up to HEAD; beyond it the same sums come from their series, evaluated around the continuous solution.

    The uniform is bound to a variable first: written into the comparisons it would be hashed again for each of them.
    """
    return F.element_at(F.transform(F.array(u), lambda x: _zipf_inverse(x, gamma, n)), 1)


def _zipf_inverse(u: Column, gamma: float, n: int) -> Column:
    cdf = zipf_table(gamma)
    left = (F.lit(1.0) - u) * F.lit(float(zeta_tail(gamma, 1.0)))
    guess = F.floor(F.pow(left * F.lit(gamma - 1), F.lit(-1 / (gamma - 1)))).cast("double")

    def mass(k: Column) -> Column:
        terms = [F.lit(c) * F.pow(k, F.lit(p)) for c, p in tail_terms(gamma)]
        return terms[0] + terms[1] + terms[2] + terms[3]

    first = F.greatest(guess - SEARCH, F.lit(float(HEAD + 1)))
    steps = F.array(*[F.lit(float(i)) for i in range(2 * SEARCH + 1)])
    far = first + F.size(F.filter(steps, lambda i: mass(first + i + 1) > left))
    cap = F.lit(float(max(n - 1, 0)))
    k = F.when(u < F.lit(cdf[-1]), (_count_below(cdf, u) + 1).cast("double")).otherwise(far)
    return F.least(k, cap).cast("bigint")


class Draw(NamedTuple):
    """Where a sampler gets its randomness from: ``of(part)`` is a uniform column of that part's own stream."""

    spec: Mapping
    of: Callable[..., Column]

    def number(self, name: str) -> float:
        return float(self.spec[name])


def _fixed(draw: Draw) -> Column:
    return F.lit(draw.number("value"))


def _between(draw: Draw) -> Column:
    low, high = draw.number("low"), draw.number("high")
    if high < low:
        raise ValueError(f"uniform degree: low {low} above high {high}")
    return F.lit(low) + draw.of("") * F.lit(high - low)


def _around(draw: Draw) -> Column:
    middle, reach = draw.number("median"), draw.number("sigma")
    return F.lit(middle - reach) + draw.of("") * F.lit(2 * reach)


def _bell(draw: Draw) -> Column:
    return F.lit(draw.number("mean")) + _noise(draw)


def _noise(draw: Draw) -> Column:
    return standard_normal(draw.of(""), draw.of("/2")) * F.lit(draw.number("sigma"))


def _skewed(draw: Draw) -> Column:
    if draw.number("median") <= 0:
        raise ValueError("lognormal degree: the median must be positive")
    return F.lit(draw.number("median")) * F.exp(_noise(draw))


def _skewed_log(draw: Draw) -> Column:
    return F.exp(F.lit(draw.number("meanlog")) + _noise(draw))


def _events(name: str) -> Callable[[Draw], Column]:
    def sample(draw: Draw) -> Column:
        rate = draw.number(name)
        if rate < 0:
            raise ValueError("poisson degree: a negative rate")
        parts = max(1, math.ceil(rate / PART))
        each = rate / parts
        chance, cdf = math.exp(-each), []
        while sum(cdf[-1:]) < 1 - 1e-15 and len(cdf) < 40 + 4 * PART:
            cdf.append(sum(cdf[-1:]) + chance)
            chance *= each / len(cdf)
        # Sums of independent parts are Poisson again, whatever the rate.
        return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0),
                           lambda total, i: total + _count_below(cdf, draw.of("/part", i))).cast("double")

    return sample


# Each way to state a distribution: its name, the settings it needs, its sampler. The first that fits is taken.
FAMILIES = (
    ("fixed", ("value",), _fixed),
    ("uniform", ("low", "high"), _between),
    ("uniform", ("median", "sigma"), _around),
    ("normal", ("mean", "sigma"), _bell),
    ("lognormal", ("meanlog", "sigma"), _skewed_log),
    ("lognormal", ("median", "sigma"), _skewed),
    ("poisson", ("lam",), _events("lam")),
    ("poisson", ("lambda",), _events("lambda")),
)
# What a spec means that leaves settings out.
DEFAULT_DIST = "uniform"
DEFAULTS = {
    "uniform": {"median": 1.0, "sigma": 0.5},
    "normal": {"mean": 1.0, "sigma": 1.0},
    "lognormal": {"median": 1.0, "sigma": 1.0},
    "poisson": {"lam": 1.0},
}
ROUNDING = {"round": F.rint, "floor": F.floor, "ceil": F.ceil}


def degree(spec: Mapping, seed: int, stream: str, *keys: Column, algo: str = "xxhash64") -> Column:
    """A degree column from a spec: ``dist`` and the settings of one of its FAMILIES.

    The first way whose settings are all given is taken, else the first that is complete with the DEFAULTS; a fixed
    degree has no default.

    ``round`` says how to make an integer (round by default); ``min`` (0 by default) and ``max`` bound the result.
    """
    dist = str(spec.get("dist", DEFAULT_DIST)).lower()
    named = [f for f in FAMILIES if f[0] == dist]
    if not named:
        raise ValueError(f"degree distribution {dist!r}: expected one of {sorted({f[0] for f in FAMILIES})}")
    given = {key: value for key, value in spec.items() if value is not None}
    full = {**DEFAULTS.get(dist, {}), **given}
    fitting = [f for known in (given, full) for f in named if all(key in known for key in f[1])]
    if not fitting:
        raise ValueError(f"{dist} degree: needs " + " or ".join(" and ".join(f[1]) for f in named))
    if float(full.get("sigma", 0)) < 0:
        raise ValueError("degree: sigma must not be negative")
    to_integer = ROUNDING.get(spec.get("round", "round"))
    if to_integer is None:
        raise ValueError(f"degree rounding {spec['round']!r}: expected one of {sorted(ROUNDING)}")
    least, most = spec.get("min", 0), spec.get("max")
    if None not in (least, most) and most < least:
        raise ValueError(f"degree: bounds {least}..{most} are empty")

    def of(part: str, *more: Column) -> Column:
        return uniform(seed, stream + part, *keys, *more, algo=algo)

    drawn = to_integer(fitting[0][2](Draw(full, of))).cast("bigint")
    bounds = [(F.greatest, least), (F.least, most)]
    for pick, bound in bounds:
        if bound is not None:
            drawn = pick(drawn, F.lit(int(bound)).cast("bigint"))
    return drawn
