"""Array expressions on vectors (double arithmetic, JVM side; late interaction as matrix products in Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column, floor: float = 1e-12) -> Column:
    """L2-normalised vector; the norm is floored."""
    lengths = F.array_repeat(F.greatest(norm(vector), F.lit(floor)), F.size(vector))
    return F.zip_with(vector, lengths, lambda x, n: x / n)


def is_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def fold_rows(vector: Column, rows: int, width: int) -> Column:
    """Flat vector -> list of ``rows`` vectors of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(vector, i * width + 1, F.lit(width)))


def maxsim(query: Column, candidate: Column) -> Column:
    """Mean over query tokens of the best dot product with a candidate token (unit tokens, masked ones removed).

    One matrix product per pair; 0 without query tokens, null without candidate tokens.
    """
    def best(q, c):
        if q is None or c is None or (len(q) and not len(c)):
            return None
        return float((np.stack(q) @ np.stack(c).T).max(axis=1).mean()) if len(q) else 0.0

    @F.pandas_udf("double")
    def batch(queries: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([best(q, c) for q, c in zip(queries, candidates)], dtype="object")

    return batch(query, candidate)


def keep_valid(tokens: Column, mask: Column) -> Column:
    """Tokens whose mask is 1."""
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"] == 1), lambda p: p["t"])


def mean_token(tokens: Column) -> Column:
    """Element-wise mean of a list of equal-width vectors."""
    first = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(tokens, first, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
    return F.transform(summed, lambda x: x / F.size(tokens))
