"""Exact quantiles of columns of any size, without a buffer of their values.

Values are narrowed to those around each wanted rank: an approximate percentile (whose summary is bounded) gives two values on either side of it,
counts say exactly which ranks lie between them, and only what is between is looked at again. Each pass leaves a few thousandths of the
rows; at HELD rows, or where one value is left, the answer is read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows among which a rank is read off by sorting, and the accuracy of the percentiles that narrow the rest.
HELD, ACCURACY = 100_000, 10_000


def ranked(df: DataFrame, column: str, rank: int) -> float:
    """The value at a rank (from 1) among those of a column of doubles that are not null."""
    x, rows = F.col(column), df.where(F.col(column).isNotNull()).select(column)
    inside, below, n = rows, 0, rows.count()
    while n > HELD:
        share, near = (rank - below) / n, 2 / ACCURACY
        a, b, low, high = inside.agg(
            F.percentile_approx(x, F.lit(max(share - near, 0.0)), F.lit(ACCURACY)), F.percentile_approx(x, F.lit(min(share + near, 1.0)), F.lit(ACCURACY)), F.min(x), F.max(x)
        ).first()
        if low == high:
            return low
        if a == low and b == high:
            a, b = low, low / 2 + high / 2  # no narrower: halve
        before, between = inside.agg(F.count_if(x < a), F.count_if((x >= a) & (x <= b))).first()
        if rank <= below + before:
            inside, n = inside.where(x < a), before
        elif rank <= below + before + between:
            inside, below, n = inside.where((x >= a) & (x <= b)), below + before, between
        else:
            inside, below, n = inside.where(x > b), below + before + between, n - before - between
    counts = inside.groupBy(column).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(column, upto.alias("__to")).where(F.col("__to") >= rank - below).agg(F.min(column)).first()[0]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbouring values; null without values. NaN counts as larger than all numbers."""
    values = df.select(F.col(column).cast("double").alias("__x")).where("__x IS NOT NULL")
    n, found = values.count(), {}
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = share * (n - 1)
        low, part = int(at), at - int(at)
        for r in {low + 1, min(low + 2, n)} - found.keys():
            found[r] = ranked(values, "__x", r)
        a, b = found[low + 1], found[min(low + 2, n)]
        out.append(a if part == 0 or a == b else a + (b - a) * part)
    return out
