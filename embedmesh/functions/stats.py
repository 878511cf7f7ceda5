"""Statistics as column expressions. Counts are numbers of any kind; everything is computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _d(c: Column | str | float) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("double")


def xlogx(x: Column) -> Column:
    """0 at 0. Every operand is written once: these expressions nest, and what repeats one grows past what can be compiled."""
    return x * F.ln(F.greatest(x, F.lit(1e-300)))


def entropy(*counts: Column | str | float) -> Column:
    """Unnormalised: xlogx of the sum less the sum of xlogx. Null where a count is negative."""
    own = [_d(c) for c in counts]
    total, parts = own[0], xlogx(own[0])
    for c in own[1:]:
        total, parts = total + c, parts + xlogx(c)
    return F.when(F.least(*own, F.lit(0.0)) >= 0, xlogx(total) - parts)


def log_likelihood_ratio(k11, k12, k21, k22) -> Column:
    a, b, c, d = map(_d, (k11, k12, k21, k22))
    rows, columns, matrix = entropy(a + b, c + d), entropy(a + c, b + d), entropy(a, b, c, d)
    # rounding can make it slightly negative; null stays null, which greatest() would pass over
    return F.abs(2.0 * (rows + columns - matrix) * ((rows + columns) >= matrix).cast("double"))


def root_log_likelihood_ratio(k11, k12, k21, k22) -> Column:
    """Negative where the first share is under the second; an undefined share (0 of 0) is never under."""
    a, b, c, d = map(_d, (k11, k12, k21, k22))
    root = F.sqrt(log_likelihood_ratio(a, b, c, d))
    under = F.coalesce(F.try_divide(a, a + b) < F.try_divide(c, c + d), F.lit(False))
    return root * F.when(under, -1.0).otherwise(1.0)


def divided(a, b) -> Column:
    """IEEE division: 0 / 0 is NaN, x / 0 infinite."""
    a, b = _d(a), _d(b)
    at_zero = F.when(F.isnan(a), NAN).when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(NAN)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def phi(n, mij, mi, mj) -> Column:
    n, mij, mi, mj = map(_d, (n, mij, mi, mj))
    return divided(n * mij - mi * mj, F.sqrt(mi * mj * (n - mi) * (n - mj)))


def phi_t(own_phi: Column, mi, mj) -> Column:
    return divided(own_phi * F.sqrt(F.greatest(_d(mi), _d(mj)) - 2), F.sqrt(1 - own_phi * own_phi))


def above(x: Column, threshold) -> Column:
    """x > threshold with NaN above nothing (Spark orders NaN over all numbers)."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")) > threshold, F.lit(False))


def mean(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def sample_std(c: str) -> Column:
    """NaN for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(NAN))


def compare_frequencies(a: DataFrame, b: DataFrame, item: str = "item", max_return: int = 100, threshold: float = 0.0) -> DataFrame:
    """(item, score) of two multisets of rows: the root log-likelihood ratio of each item's share in ``a`` against that in
    ``b``, from ``threshold`` up, best first. Items only in ``b`` take part if the threshold is negative."""
    count = lambda d, name: d.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias(name))
    ca, cb = count(a, "ka"), count(b, "kb")
    totals = ca.agg(F.coalesce(F.sum("ka"), F.lit(0)).alias("ta")).crossJoin(cb.agg(F.coalesce(F.sum("kb"), F.lit(0)).alias("tb")))
    both = ca.join(cb, item, "full" if threshold < 0 else "left").na.fill(0, ["ka", "kb"]).crossJoin(F.broadcast(totals))  # totals: one row
    score = root_log_likelihood_ratio("ka", F.col("ta") - F.col("ka"), "kb", F.col("tb") - F.col("kb"))
    return both.select(item, score.alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), item).limit(max_return)
