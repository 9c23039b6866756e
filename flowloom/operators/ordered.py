"""Order within groups of any size: scans of two levels, halos, and chains of successors.

Rows are ordered within blocks of a group, and only a row a block over the whole group, so no group, however hot, is sorted in
one task. Group columns must not be null. Blocks are given by a column of whole numbers that doesn't fall in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.written import written

BLOCK = "__blk"


def with_before(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: value in the row before, in order of BLOCK and `order` (null for a group's first)."""
    by = Window.partitionBy(*groups, BLOCK).orderBy(*order)
    ends = rows.groupBy(*groups, BLOCK).agg(F.max_by(value, F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*groups).orderBy(BLOCK)))
    out = rows.withColumns({name: F.lag(value).over(by), "__first": F.row_number().over(by) == 1}).join(ends, [*groups, BLOCK])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__end")).otherwise(F.col(name))).drop("__first", "__end")


def with_totals(rows: DataFrame, groups: list[str], order: list[str], values: dict[str, Column], kind=F.sum) -> DataFrame:
    """Adds, by name, the sum (or F.max) of each value over a group's rows so far, this one included, in order of BLOCK and `order`."""
    rows = rows.withColumns({f"__v_{n}": v for n, v in values.items()})
    ahead = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, BLOCK).agg(*(kind(f"__v_{n}").alias(f"__s_{n}") for n in values))
    sums = sums.select(*groups, BLOCK, *(kind(f"__s_{n}").over(ahead).alias(f"__a_{n}") for n in values))
    by = Window.partitionBy(*groups, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({n: kind(f"__v_{n}").over(by) for n in values}).join(sums, [*groups, BLOCK])
    both = lambda n: F.coalesce(F.col(n) + F.col(f"__a_{n}"), F.col(n), F.col(f"__a_{n}")) if kind is F.sum else F.greatest(n, f"__a_{n}")
    return out.withColumns({n: both(n) for n in values}).drop(*(f"__{k}_{n}" for n in values for k in "va"))


def with_halo(rows: DataFrame, groups: list[str], order: list[str], reach: int, size: int = 10_000) -> DataFrame:
    """Rows dealt to BLOCKs of `size` in order of `order`; each block also has copies of the `reach` rows before it (__halo is true).

    A window of up to `reach` rows back, by groups and BLOCK, is then whole for rows that aren't copies. Needs a BLOCK of its own to count by.
    """
    at = with_totals(rows, groups, order, {"__r": F.lit(1).cast("long")}).drop(BLOCK)
    own = F.floor((F.col("__r") - 1) / size)
    last = F.floor((F.col("__r") - 1 + reach) / size)  # the last block that reaches back to this row
    out = at.withColumn(BLOCK, F.explode(F.sequence(own, last)))
    return out.withColumn("__halo", F.col(BLOCK) != own).drop("__r")


def following(points: DataFrame, at: Column, marks: DataFrame, mark_at: Column, tag: Column, groups: list[str], width: float) -> DataFrame:
    """Points with `found`: struct(at, tag) of the first mark at or after `at` in the same group (null if none).

    Both sides are cut into buckets of `width`; only one row a bucket is ordered over a group.
    """
    asked = points.withColumn("__t", at)
    both = asked.unionByName(marks.select(*groups, mark_at.alias("__t"), F.struct(mark_at.alias("at"), tag.alias("tag")).alias("__g")), allowMissingColumns=True)
    both = both.withColumn("__b", F.floor(F.col("__t") / width))
    # Backwards in time, so that frames only grow.
    later = Window.partitionBy(*groups).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(*groups, "__b").agg(F.min("__g").alias("__g")).select(*groups, "__b", F.last("__g", ignorenulls=True).over(later).alias("__next"))
    own = F.min("__g").over(Window.partitionBy(*groups, "__b").orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("__own", own).where(F.col("__g").isNull()).join(firsts, [*groups, "__b"])
    return found.select(*points.columns, F.coalesce("__own", "__next").alias("found"))


def reached(starts: DataFrame, steps: DataFrame, at: str, within: Column | None = None) -> DataFrame:
    """Starts, and for each the rows that take its place when `at` is followed along steps (__from, __to), any number of times.

    within: a condition on a start's columns and __to, false for all further steps once it is false. Steps are doubled in each
    round (binary lifting), so rounds are the logarithm of the longest chain; each is a written table.
    """
    found, jumps = written(starts, "chain"), written(steps.where("__to IS NOT NULL"), "chain-steps")
    while not jumps.isEmpty():
        further = found.join(jumps, F.col(at) == F.col("__from"))
        if within is not None:
            further = further.where(within)
        further = further.withColumn(at, F.col("__to")).select(*starts.columns)
        if (further := written(further, "chain-further")).isEmpty():
            break
        found = written(found.union(further), "chain")
        half = jumps.select(F.col("__from").alias("__mid"), F.col("__to").alias("__end"))
        jumps = written(jumps.join(half, F.col("__to") == F.col("__mid")).select("__from", F.col("__end").alias("__to")), "chain-steps")
    return found


def _ahead(sums: DataFrame, at: str, names: list[str], fan: int, most: int) -> DataFrame:
    """sums (a row for each value of `at`) with what all earlier rows sum to, over a tree whose nodes have up to `fan` children."""
    top = at.removeprefix("__").split("_")[0]
    before = lambda w: [F.coalesce(F.sum(n).over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__a_{n}") for n in names]
    if most <= fan:
        return sums.select(at, *before(Window.partitionBy()))
    up = f"__{top}_{most}"
    sums = sums.withColumn(up, F.floor(F.col(at) / fan))
    above = _ahead(sums.groupBy(up).agg(*(F.sum(n).alias(n) for n in names)), up, names, fan, -(-most // fan))
    own = sums.select(at, up, *before(Window.partitionBy(up)))
    above = above.select(up, *(F.col(f"__a_{n}").alias(f"__u_{n}") for n in names))
    return own.join(above, up).select(at, *((F.col(f"__a_{n}") + F.col(f"__u_{n}")).alias(f"__a_{n}") for n in names))


def with_running(rows: DataFrame, order: str, values: dict[str, Column], fan: int = 4096) -> DataFrame:
    """Adds, by name, the sum of each value over all rows up to this one in order of a column of whole numbers, by a tree of sums.

    No task orders more than `fan` numbers of a level, however many rows there are.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    most = ((high or 0) - (low or 0)) // fan + 1
    rows = rows.withColumns({"__leaf": F.floor((F.col(order) - (low or 0)) / fan), **{f"__v_{n}": v for n, v in values.items()}})
    sums = rows.groupBy("__leaf").agg(*(F.sum(f"__v_{n}").alias(n) for n in values))
    by = Window.partitionBy("__leaf").orderBy(order)
    out = rows.withColumns({n: F.sum(f"__v_{n}").over(by) for n in values}).join(_ahead(sums, "__leaf", [*values], fan, most), "__leaf")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__a_{n}") for n in values}).drop("__leaf", *(f"__{k}_{n}" for n in values for k in "va"))
