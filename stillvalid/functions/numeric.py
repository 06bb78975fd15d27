"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are clipped here before a logarithm.
PROBA_FLOOR = 1e-12
# Risk and threshold are compared with a strict ``>``. Rounding both removes the last-bit noise a
# different partition order puts into an average, so the comparison does not depend on the layout.
RISK_DECIMALS = 12


def finite(x: Column) -> Column:
    """NaN and infinities become NULL; NaN would otherwise sort above every number."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def settle(x: Column) -> Column:
    return F.round(x, RISK_DECIMALS)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def items(arr: Column | str, n: int) -> list[Column]:
    """The ``n`` entries of a short fixed-length array as separate columns (keeps codegen)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return [arr.getItem(i) for i in range(n)]


def _digest(seed: str, keys: Sequence[Column | str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def _fraction(digest: Column, part: int) -> Column:
    """Eight hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: str, *keys: Column | str) -> Column:
    """Deterministic draw in [0, 1): a pure function of the seed and the row key.

    Unlike ``rand`` it survives any re-partitioning or task retry, and SQL can state it.
    """
    return _fraction(_digest(seed, keys), 0)


def normal(seed: str, *keys: Column | str) -> Column:
    """Standard normal draw by the Box-Muller transform on two parts of one digest."""
    return bind(_digest(seed, keys), lambda d: F.sqrt(
        F.lit(-2.0) * F.log(_fraction(d, 0) + F.lit(2.0**-33)))
        * F.cos(F.lit(6.283185307179586) * _fraction(d, 1)))


def argmax(p: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def clipped(p: Column) -> Column:
    return F.transform(p, lambda x: clip(x, PROBA_FLOOR, 1.0))


def entropy(p: Column) -> Column:
    """Entropy of a probability array.

    Array folds keep the generated code small: the same formula unrolled over classes and members
    grows past the size the JVM compiles and then runs many times slower.
    """
    return -F.aggregate(clipped(p), F.lit(0.0), lambda s, x: s + x * F.log(x))


def mean_distribution(members: Column) -> Column:
    """Element-wise mean of an array of probability arrays."""
    first = F.transform(F.get(members, F.lit(0)), lambda _: F.lit(0.0))
    summed = F.aggregate(members, first, lambda s, p: F.zip_with(s, p, lambda a, b: a + b))
    return bind(F.size(members).cast("double"), lambda n: F.transform(summed, lambda v: v / n))


def top_two_gap(p: Column) -> Column:
    """Largest minus second largest probability; 0 with a single class."""
    ranked = F.sort_array(clipped(p), asc=False)
    return bind(ranked, lambda r: F.when(F.size(r) >= 2, F.get(r, F.lit(0)) - F.get(r, F.lit(1)))
                .otherwise(F.lit(0.0)))


def log_sum_exp(scores: Column) -> Column:
    """A single score is a binary margin and is read as the pair (0, margin)."""
    full = F.when(F.size(scores) == 1, F.array(F.lit(0.0), F.get(scores, F.lit(0)))
                  ).otherwise(scores)
    return bind(full, lambda r: bind(F.array_max(r), lambda top: top + F.log(
        F.aggregate(r, F.lit(0.0), lambda s, v: s + F.exp(v - top)))))


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def spread(x: Column) -> Column:
    """Population deviation, exactly 0 for a constant column.

    Merging partial aggregates can leave a deviation of about 1e-16 on a constant, which would
    pass a ``> 0`` test and then blow up a division.
    """
    return F.when(F.max(x) > F.min(x), F.stddev_pop(x)).otherwise(F.lit(0.0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column used inside an array lambda is evaluated for every element; passing it through a
    one-element array makes it a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_std(a: Column) -> Column:
    """Population standard deviation of an array."""
    def deviation(s: Column) -> Column:
        return F.sqrt(F.try_divide(F.aggregate(
            s["a"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])), F.size(s["a"])))

    return bind(F.struct(a.alias("a"), array_mean(a).alias("m")), deviation)


def array_median(a: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        lower = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
        upper = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
        return (lower + upper) / 2.0

    return bind(F.array_sort(a), middle)


def pair_slopes(y: Column) -> Column:
    """Slopes of all point pairs of a short array (trailing risks, never more than the context)."""
    n = F.size(y)
    rows = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.transform(
            F.sequence(i + 1, n - 1),
            lambda j: (F.get(y, j) - F.get(y, i)) / (j - i).cast("double")))
    return F.flatten(rows)


def theil_sen_slope(y: Column) -> Column:
    return bind(y, lambda v: F.when(F.size(v) >= 2, array_median(pair_slopes(v)))
                .otherwise(F.lit(0.0)))


def tail(a: Column, k: int) -> Column:
    """Last ``k`` entries, or the whole array when it is shorter."""
    take = F.least(F.lit(k), F.size(a))
    return F.when(take > 0, F.slice(a, -take, take)).otherwise(a)


def smooth(a: Column, alpha: float | Column) -> Column:
    """Exponentially smoothed level of an array; NULL when empty."""
    alpha = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    return F.aggregate(a, F.lit(None).cast("double"),
                       lambda s, x: F.coalesce(alpha * x + (F.lit(1.0) - alpha) * s, x))


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(6.283185307179586) * (value % period) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
