"""Price functions on columns. Odds arrays hold decimal odds; results that are not defined are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 60  # halvings of a bracket
METHODS = ("multiplicative", "additive", "power", "shin", "odds_ratio")


def implied(odds: Column) -> Column:
    return F.transform(odds, lambda o: 1.0 / o)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def overround(odds: Column) -> Column:
    return total(implied(odds)) - 1.0


def _halved(low: float, high: float, too_low) -> Column:
    """Where too_low(x) turns false within [low, high]."""
    state = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        left = too_low(mid)
        return F.struct(F.when(left, mid).otherwise(s["lo"]).alias("lo"), F.when(left, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step, lambda s: (s["lo"] + s["hi"]) / 2.0)


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda over an array of one. Plain reuse would repeat it per element."""
    return F.transform(F.array(value), use)[0]


def fair(odds: Column, method: str = "power") -> Column:
    """Margin-free probabilities of a complete market; null where an odd is missing or not above 1, or additive fails.

    power: p^k; shin: insider share z; odds_ratio: common ratio c; each found by halving in native expressions. Without
    a positive margin all but additive only normalise.
    """
    if method not in METHODS:
        raise ValueError(f"no margin is removed by {method!r}, only by one of {', '.join(METHODS)}")
    valid = F.forall(odds, lambda o: o.isNotNull() & (o > 1.0)) & (F.size(odds) >= 2)
    normal = lambda p: let(p, lambda q: let(total(q), lambda s: F.transform(q, lambda x: x / s)))

    def power(pi: Column, s: Column) -> Column:
        return let(_halved(1.0, 50.0, lambda m: total(F.transform(pi, lambda x: F.pow(x, m))) > 1.0), lambda k: F.transform(pi, lambda x: F.pow(x, k)))

    def shin(pi: Column, s: Column) -> Column:
        of = lambda z: F.transform(pi, lambda x: (F.sqrt(z * z + 4.0 * (1.0 - z) * x * x / s) - z) / (2.0 * (1.0 - z)))
        return let(_halved(0.0, 0.999, lambda m: total(of(m)) > 1.0), of)

    def odds_ratio(pi: Column, s: Column) -> Column:
        of = lambda c: F.transform(pi, lambda x: x / (c + x - c * x))
        return let(_halved(1.0, 100.0, lambda m: total(of(m)) > 1.0), of)

    def additive(pi: Column, s: Column) -> Column:
        p = F.transform(pi, lambda x: x - (s - 1.0) / F.size(pi))
        return let(p, lambda q: F.when(F.forall(q, lambda x: x > 0), normal(q)))

    def freed(pi: Column, s: Column) -> Column:
        if method == "additive":
            return additive(pi, s)
        plain = F.transform(pi, lambda x: x / s)
        if method == "multiplicative":
            return plain
        found = {"power": power, "shin": shin, "odds_ratio": odds_ratio}[method](pi, s)
        return F.when(s - 1.0 <= 1e-12, plain).otherwise(normal(found))

    return F.when(valid, let(implied(odds), lambda pi: let(total(pi), lambda s: freed(pi, s))))


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1.0


def kelly(p: Column, odds: Column) -> Column:
    b = odds - 1.0
    return F.when(b > 0, F.greatest(F.lit(0.0), (p * b - (1.0 - p)) / b)).otherwise(0.0)


def stake(p: Column, odds: Column, method: str = "fractional_kelly", unit: float = 0.01, share: float = 0.25, most: float = 0.02) -> Column:
    """Fraction of the bankroll; 0 without a positive expected value. Only history-free methods exist."""
    if method not in ("fixed", "fractional_kelly"):
        raise ValueError(f"staking method {method!r} is not allowed")
    if not 0 < share <= 1 or not 0 < most <= 0.1:
        raise ValueError("share must be in (0, 1] and most in (0, 0.1]")
    size = F.lit(unit) if method == "fixed" else share * kelly(p, odds)
    return F.when(F.coalesce(expected_value(p, odds) > 0, F.lit(False)), F.least(size, F.lit(most))).otherwise(0.0)


def clv_price(taken: Column, closing: Column) -> Column:
    return F.when((taken > 1) & (closing > 1), taken / closing - 1.0)


def clv_fair(taken: Column, closing_fair: Column) -> Column:
    return F.when((taken > 1) & (closing_fair > 0) & (closing_fair < 1), taken * closing_fair - 1.0)


def freshness(age_hours: Column, fresh: float = 6, stale: float = 72) -> Column:
    return F.when(age_hours.isNull(), "UNKNOWN").when(age_hours <= fresh, "FRESH").when(age_hours <= stale, "AGING").otherwise("STALE")


def settle(won: Column, units: Column, odds: Column) -> Column:
    """Profit in units: odds - 1 per unit won, minus the stake lost; null if open."""
    return F.when(won.isNull(), F.lit(None).cast("double")).when(won, units * (odds - 1.0)).otherwise(-units)
