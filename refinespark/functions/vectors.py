"""Vector expressions on ARRAY<FLOAT> columns, accumulated in DOUBLE.

Spark has no dot-product built-in; these lambda forms stay JVM-side and are
used for small fixed partners (gold pairs, centroids).  Bulk all-against-all
scoring goes through the block operator in ``operators.exact``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2sq(a, b) -> Column:
    sq = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v)


def vec_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def rounded(x, decimals: int = SCORE_DECIMALS) -> Column:
    return F.round(_c(x), decimals)
