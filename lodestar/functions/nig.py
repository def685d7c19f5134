"""Normal-inverse-gamma statistics as Column expressions: posteriors, predictive densities, merges, information criteria."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prior: fixed values.
MU0, KAPPA0, ALPHA0, BETA0 = 0.0, 0.01, 0.01, 0.01
#: Lanczos coefficients for g = 7: fixed values.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def ln_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x > 0.5 to full precision and above 0 by reflection-free recurrence."""
    small = x < 0.5
    z = F.when(small, x).otherwise(x - 1)  # ln gamma(x) = ln gamma(x + 1) - ln x
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    out = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)
    return F.when(small, out - F.ln(x)).otherwise(out)


def posterior(n: Column, mean: Column, m2: Column) -> Column:
    """(mu, nu, sigma2, logc) of the posterior predictive, a Student t: all that a density needs, but the value."""
    kappa, alpha = n + KAPPA0, n / 2 + ALPHA0
    mu = n * mean / kappa
    beta = BETA0 + m2 / 2 + KAPPA0 * n * mean * mean / (2 * kappa)
    nu = F.greatest(2 * alpha, F.lit(1e-8))
    s2 = F.greatest(beta * (kappa + 1) / (alpha * F.greatest(kappa, F.lit(1e-8))), F.lit(1e-12))
    logc = ln_gamma((nu + 1) / 2) - ln_gamma(nu / 2) - 0.5 * (F.ln(nu) + math.log(math.pi) + F.ln(s2))
    return F.struct(mu.alias("mu"), nu.alias("nu"), s2.alias("sigma2"), logc.alias("logc"))


def log_density(x: Column, post: Column) -> Column:
    d = x - post["mu"]
    return post["logc"] - (post["nu"] + 1) / 2 * F.log1p(d * d / (post["nu"] * post["sigma2"]))


def combined(a: Column, b: Column) -> Column:
    """The statistics (n, mean, m2) of two sets together; either may be empty."""
    n = a["n"] + b["n"]
    safe = F.when(n > 0, n)
    delta = b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), ((a["mean"] * a["n"] + b["mean"] * b["n"]) / safe).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / safe).alias("m2"))
    return F.when(b["n"] <= 0, F.struct(a["n"].alias("n"), a["mean"].alias("mean"), a["m2"].alias("m2"))).when(a["n"] <= 0, F.struct(b["n"].alias("n"), b["mean"].alias("mean"), b["m2"].alias("m2"))).otherwise(both)


def bic(stats: Column) -> Column:
    """The Bayesian information criterion of an array of (n, mean, m2), one for each dimension."""
    used = F.filter(stats, lambda s: s["n"] > 0)
    fit = F.aggregate(used, F.lit(0.0), lambda t, s: t - 0.5 * s["n"] * F.ln(F.lit(2 * math.pi) * F.greatest(s["m2"] / F.greatest(s["n"], F.lit(1.0)), F.lit(1e-12))))
    n = F.aggregate(used, F.lit(0.0), lambda t, s: t + s["n"])
    return fit - 2.0 * F.size(used) * F.ln(F.greatest(n, F.lit(2.0)))


def bic_gain(a: Column, b: Column) -> Column:
    """What merging gains; minus infinity if either side is empty."""
    merged = F.zip_with(a, b, combined)
    none = (F.size(F.filter(a, lambda s: s["n"] > 0)) == 0) | (F.size(F.filter(b, lambda s: s["n"] > 0)) == 0)
    return F.when(none, F.lit(float("-inf"))).otherwise(bic(merged) - bic(a) - bic(b))
