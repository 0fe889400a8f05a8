"""Numeric and date answers, and binomial intervals."""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def significant_digits(c: Column) -> Column:
    """Significant digits written in a decimal literal (commas aside); null for anything else.

    A zero counts the digits after its point, at least one.
    """
    t = F.regexp_replace(F.trim(c), ",", "")
    mantissa = F.regexp_replace(F.regexp_replace(t, r"[eE].*$", ""), r"^[+-]", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"^0+", "")
    decimals = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1))
    return F.when(t.rlike(_LITERAL), F.when(F.length(digits) > 0, F.length(digits)).otherwise(F.greatest(F.lit(1), decimals)))


def _number(text: object) -> Decimal | None:
    try:
        v = Decimal(str(text).strip().replace(",", ""))
    except InvalidOperation:
        return None
    return v if v.is_finite() else None


def numbers_match(prediction: str, references: list[str], tolerance: str = "0", decimals: int | None = None, least_digits: int | None = None, most_digits: int | None = None) -> bool:
    """Whether a written number lies within the tolerance of a reference and is written precisely enough.

    References that are no finite numbers raise; a prediction that is none does not match.
    """
    slack = _number(tolerance)
    if slack is None or slack < 0:
        raise ValueError("the tolerance must be a number of at least 0")
    wanted = [_number(r) for r in references]
    if not wanted or None in wanted:
        raise ValueError("references must be finite numbers, at least one")
    value = _number(prediction)
    if value is None:
        return False
    written = str(prediction).strip().replace(",", "").lower().partition("e")[0].lstrip("+-")
    whole, _, part = written.partition(".")
    if decimals is not None and len(part) < decimals:
        return False
    digits = len((whole + part).lstrip("0")) or max(1, len(part))
    if (least_digits is not None and digits < least_digits) or (most_digits is not None and digits > most_digits):
        return False
    return min(abs(value - w) for w in wanted) <= slack


def numeric_match(prediction: Column, references: Column, tolerance: str = "0", decimals: int | None = None, least_digits: int | None = None, most_digits: int | None = None) -> Column:
    """Arrow UDF of :func:`numbers_match` in exact decimal arithmetic; null where a side is null."""

    @F.pandas_udf("boolean")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(
            [None if a is None or b is None else numbers_match(a, list(b), tolerance, decimals, least_digits, most_digits) for a, b in zip(p, r)], dtype="boolean"
        )

    return run(prediction, references)


# Written forms of dates by granularity.
DATE_FORMS = {"year": (r"^\d{4}$", "yyyy"), "month": (r"^\d{4}-\d{2}$", "yyyy-MM"), "day": (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd")}


def valid_date(c: Column, granularity: str) -> Column:
    """Whether a text is a zero-padded calendar date of the granularity."""
    form, pattern = DATE_FORMS[granularity]
    return F.coalesce(F.trim(c).rlike(form) & (F.substring(F.trim(c), 1, 4) != "0000") & F.try_to_timestamp(F.trim(c), F.lit(pattern)).isNotNull(), F.lit(False))


def date_match(prediction: Column, references: Column, granularity: str) -> Column:
    """Whether a date of the given granularity is one of the references, all inside the JVM."""
    return valid_date(prediction, granularity) & F.array_contains(F.transform(references, lambda x: F.trim(x)), F.trim(prediction))


def typed_match(kind: Column, prediction: Column, references: Column, granularity: str = "day", tolerance: str = "0") -> Column:
    """Categorical, numeric or date match by the value of ``kind``; null for other kinds."""
    from lucidra.functions.text import exact_match

    return (
        F.when(kind == "categorical", exact_match(prediction, references))
        .when(kind == "numeric", numeric_match(F.when(kind == "numeric", prediction), F.when(kind == "numeric", references), tolerance))
        .when(kind == "date", date_match(prediction, references, granularity))
    )


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """``struct(lower, upper)`` of the Wilson score interval; null for an empty total."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n, p = total.cast("double"), successes / total.cast("double")
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(total > 0, F.struct(F.when(low < 1e-15, 0.0).otherwise(low).alias("lower"), F.when(high > 1 - 1e-15, 1.0).otherwise(high).alias("upper")))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial variable, summed over the terms that matter."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    width = int(40 * math.sqrt(n * p * (1 - p)) + 60)
    lo, hi = k, min(n, max(k, int(n * p)) + width)
    if int(n * p) - width > k:
        return 1.0
    x = np.arange(lo, hi + 1, dtype=float)
    steps = np.log((n - x[:-1]) / (x[:-1] + 1)) + math.log(p) - math.log1p(-p) if len(x) > 1 else np.zeros(0)
    first = math.lgamma(n + 1) - math.lgamma(lo + 1) - math.lgamma(n - lo + 1) + lo * math.log(p) + (n - lo) * math.log1p(-p)
    logs = first + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def exact_interval(successes: int, total: int, confidence: float = 0.95) -> tuple[float, float]:
    """Equal-tailed exact binomial interval: the proportions at which the observed tail has half the error."""
    if total < 1 or not 0 <= successes <= total or not 0 < confidence < 1:
        raise ValueError("need 0 <= successes <= total, total >= 1 and a confidence within (0, 1)")
    half = (1 - confidence) / 2

    def root(k: int, level: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(70):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _tail(k, total, mid) < level else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if successes == 0 else root(successes, half), 1.0 if successes == total else root(successes + 1, 1 - half))


def clopper_pearson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """``struct(lower, upper)`` of the exact interval; an Arrow UDF for a few groups, null for an empty total."""

    @F.pandas_udf("struct<lower: double, upper: double>")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if pd.isna(a) or pd.isna(b) or b < 1 else exact_interval(int(a), int(b), confidence) for a, b in zip(k, n)]
        return pd.DataFrame(rows, columns=["lower", "upper"], dtype="float64")

    return run(successes, total)


def hash_fraction(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first eight bytes of SHA-256 of ``seed:key``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_split(key: Column, fractions: tuple[float, ...] = (0.2, 0.3, 0.5), names: tuple[str, ...] = ("development", "calibration", "test"), seed: int = 0) -> Column:
    """A stable split for a key; fractions sum to 1."""
    if len(fractions) != len(names) or abs(sum(fractions) - 1) > 1e-12 or min(fractions) < 0:
        raise ValueError("fractions must be non-negative, sum to 1 and match the names")
    x, out, upto = hash_fraction(key, seed), F.lit(names[-1]), sum(fractions[:-1])
    for name, share in reversed(list(zip(names[:-1], fractions[:-1]))):
        out = F.when(x < F.lit(upto), name).otherwise(out)
        upto -= share
    return out
