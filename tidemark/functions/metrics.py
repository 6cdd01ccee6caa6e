"""Forecast losses and intervals on columns. Probabilities are arrays in class order, outcomes class numbers from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .odds import let

CLIP = 1e-15


def log_loss(p: Column, outcome: Column) -> Column:
    return -F.log(F.greatest(F.least(F.get(p, outcome), F.lit(1.0)), F.lit(CLIP)))


def brier(p: Column, outcome: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == outcome).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def rps(p: Column, outcome: Column) -> Column:
    """Ranked probability score: mean squared difference of the cumulative distributions, without the last class."""
    state = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        return let(s["cum"] + x - (s["i"] == outcome).cast("double"), lambda c: F.struct(c.alias("cum"), (s["sum"] + c * c).alias("sum"), (s["i"] + 1).alias("i")))

    return F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), state, step, lambda s: s["sum"] / (F.size(p) - 1))


def valid(p: Column, slack: float = 1e-6) -> Column:
    """Finite, within [0, 1], and summing to 1."""
    inside = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(inside & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1.0) <= slack), F.lit(False))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of a share; (0, 1) without observations."""
    p, z2 = hits / n, z * z
    den = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / den
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / den
    return F.when(n == 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def floored(p: Column, floor: float) -> Column:
    """Probabilities raised to the floor, the rest scaled to keep the sum at 1; two passes settle three classes."""

    def once(q: Column) -> Column:
        low = F.aggregate(q, F.lit(0.0), lambda a, x: a + F.when(x <= floor, 1.0).otherwise(0.0))
        rest = F.aggregate(q, F.lit(0.0), lambda a, x: a + F.when(x > floor, x).otherwise(0.0))
        return let(F.struct(low.alias("n"), rest.alias("s")), lambda s: F.transform(q, lambda x: F.when(x <= floor, F.lit(floor)).otherwise(x * (1.0 - floor * s["n"]) / s["s"])))

    return let(let(let(p, once), once), once)


def ordered_logit(x: Column, low: Column, log_gap: Column, slope: Column) -> Column:
    """Probabilities (win, draw, loss) of an ordered logit on a rating difference."""
    sigma = lambda z: 1.0 / (1.0 + F.exp(-z))
    c0, c1 = sigma(low - slope * x), sigma(low + F.exp(log_gap) - slope * x)
    return F.array(1.0 - c1, c1 - c0, c0)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by the error function's rational approximation (error under 1.5e-7)."""
    # Coefficients of Abramowitz and Stegun 7.1.26.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    tail = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-x * x) / 2.0
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0 by Stirling's series after eight steps up (error under 1e-12)."""
    shift = x
    product = F.lit(1.0)
    for _ in range(8):
        product, shift = product * shift, shift + 1.0
    inverse = 1.0 / (shift * shift)
    series = 1.0 / 12 - inverse * (1.0 / 360 - inverse * (1.0 / 1260 - inverse * (1.0 / 1680 - inverse / 1188)))
    return (shift - 0.5) * F.ln(shift) - shift + 0.5 * F.ln(F.lit(2.0) * F.pi()) + series / shift - F.ln(product)


def _beta_fraction(x: Column, a: Column, b: Column, rounds: int) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its end inward in one fold."""

    def inward(inner: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(m > 0, 1.0 + even / (1.0 + odd / inner)).otherwise(1.0 + odd / inner)

    steps = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: (F.lit(rounds - 1) - i).cast("double"))
    return F.aggregate(steps, F.lit(1.0), inward)


def incomplete_beta(x: Column, a: Column, b: Column, rounds: int = 200) -> Column:
    """Regularised incomplete beta function; of x and 1 - x the side whose fraction converges fast."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1.0 - x))
    direct = front / (a * _beta_fraction(x, a, b, rounds))
    other = 1.0 - front / (b * _beta_fraction(1.0 - x, b, a, rounds))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(other)


def t_tail(t: Column, df: Column) -> Column:
    """Upper tail of Student's t with df degrees of freedom (within 1e-9 for 1 to 10,000 degrees)."""
    df = df.cast("double")
    half = incomplete_beta(df / (df + t * t), df / 2.0, F.lit(0.5)) / 2.0
    return F.when(t >= 0, half).otherwise(1.0 - half)
