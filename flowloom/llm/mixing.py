"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Leaves of a tree (domain, language, source) get a token budget from the weights on their path. From the root down,
each node's budget is dealt to its children by weight, but none gets more than it can give (its tokens times
`max_epochs`); what a child can't take goes to its siblings by weight, and since a node is never asked for more
than its children can give together, only a shortage of a whole subtree reaches the node's own siblings.

A leaf's budget is a prefix, in tokens, of its stream: epochs one after another, each a permutation of the leaf's
documents by a seeded digest. Whole epochs need no order. In the epoch where the budget ends, digests are cut into
buckets; bucket totals locate the one in which it ends, and only that bucket's rows are sorted.

Edge cases: rows with null level values form leaves of their own (null is a value). Null or empty texts have no
tokens and are taken with every epoch position before the cut. Ties of digests are broken by identifier; repeated
rows share both and are kept or cut together, each counting its tokens. An empty table gives an empty table.
A missing or null weight counts as 1; weight 0 gives a node nothing, and its budget goes to its siblings and theirs. All amounts are whole tokens; what
rounding down leaves goes to the nodes with the largest remainders (ties by name), so the whole budget is dealt. Columns of
df, whatever their names, come back untouched with `whole_rows`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

#: About how many rows of a leaf share a digest bucket, and the most buckets of a leaf.
BUCKET_ROWS, MOST_BUCKETS = 200, 65536


def word_count(text: Column) -> Column:
    """Words: runs of anything but blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def weights_column(level: Column, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its name at its level; 1 where none is given."""
    if not weights:
        return F.lit(1)
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.element_at(table, level.cast("string")), F.lit(1))


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling: adds `given`, each node's part of its parent's __budget, by __weight and up to __most.

    In order of __most / __weight, a node is full if what is left, shared by weight with all after it, would be
    more than it can take; the others share what the full ones leave.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("__most").cast("double") / F.col("__weight"), F.col(name))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    dealt = nodes.where("__weight > 0").withColumns(
        {
            "__left": (F.col("__budget") - F.coalesce(F.sum("__most").over(before), F.lit(0))).cast(wide),
            "__share": F.sum("__weight").over(after).cast(wide),
        }
    )
    dealt = dealt.withColumn("__full", F.col("__most") * F.col("__share") <= F.col("__left") * F.col("__weight"))
    first = Window.partitionBy(*parent)
    open_left = F.max(F.when(~F.col("__full"), F.col("__left"))).over(first)
    open_share = F.max(F.when(~F.col("__full"), F.col("__share"))).over(first)
    dealt = dealt.withColumns({"__open_left": open_left, "__open_share": open_share})
    dealt = dealt.withColumns({
        "__floor": F.expr("CASE WHEN __full THEN CAST(__most AS BIGINT) ELSE CAST((__open_left * __weight) div __open_share AS BIGINT) END"),
        "__part": F.expr("CASE WHEN __full THEN CAST(-1 AS DECIMAL(38,0)) ELSE (__open_left * __weight) % __open_share END"),
    })
    # Whole tokens that rounding down has left go to the largest remainders; a node that isn't full can take one more.
    missing = F.coalesce(F.max("__open_left").over(first), F.lit(0)) - F.coalesce(F.sum(F.when(~F.col("__full"), F.col("__floor"))).over(first), F.lit(0))
    place = F.row_number().over(first.orderBy(F.desc("__part"), F.col(name)))
    return dealt.withColumn("given", (F.col("__floor") + (~F.col("__full") & (place <= missing)).cast("long")).cast("long"))


def leaf_budgets(stats: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Per leaf (columns of levels, __docs, __tokens): its budget as `quota`. Tables here have a row per node of the tree."""
    # What lies below a node of weight 0 is never dealt anything, so it counts for nothing in what its ancestors can give.
    lives = reduce(and_, [weights_column(F.col(c), weights.get(c, {})) > 0 for c in levels])
    leaves = stats.withColumns({"__most": F.when(lives, F.col("__tokens") * max_epochs).otherwise(0).cast("decimal(38,0)"), "__root": F.lit(1)})
    above = leaves.groupBy("__root").agg(F.least(budget, F.sum("__most")).cast("decimal(38,0)").alias("__budget"))
    at = ["__root"]
    for depth, level in enumerate(levels, 1):
        below = ["__root", *levels[:depth]]
        nodes = leaves.groupBy(*below).agg(F.sum("__most").cast("decimal(38,0)").alias("__most"))
        up = above.select(*(F.col(c).alias(f"__up_{c}") for c in at), "__budget")
        nodes = _join_levels(nodes, up, at).withColumn("__weight", weights_column(F.col(level), weights.get(level, {})))
        above = deal(nodes, at, level).select(*below, F.col("given").alias("__budget"))
        at = below
    up = above.select(*(F.col(c).alias(f"__up_{c}") for c in levels), F.col("__budget").cast("long").alias("quota"))
    return _join_levels(stats, up, levels)


def _join_levels(df: DataFrame, right: DataFrame, levels: list[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """Join on level columns (right's are named __up_...), nulls equal to nulls. Spark broadcasts `right` where its measured size allows, and otherwise splits hot leaves."""
    on = more
    for c in levels:
        same = F.col(c).eqNullSafe(F.col(f"__up_{c}"))
        on = same if on is None else on & same
    return df.join(right, on, how).drop(*(f"__up_{c}" for c in levels))


def _digest(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), ident.cast("string")))


def mix(df: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], fraction: float | None = None, budget: int | None = None, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", tokens: Column | None = None, whole_rows: bool = False) -> DataFrame:
    """The chosen rows: id, the level columns, epoch (from 0), n_tokens, take_tokens; with whole_rows the columns of df instead, a row for each epoch.

    levels: names and SQL expressions from the root down. budget: tokens to draw; or fraction of all tokens in the table. take_tokens is n_tokens but in the row where a
    leaf's budget ends, which gives only the tokens still missing.
    """
    names = [*levels]
    tokens = word_count(F.col("text")) if tokens is None else tokens
    needed = [F.col(id_col).alias("__id"), *(F.expr(c).alias(n) for n, c in levels.items()), tokens.cast("long").alias("n_tokens")]
    docs = materialize(df.select(*needed), "mixing-rows")
    stats = docs.groupBy(*names).agg(F.count("*").alias("__docs"), F.sum("n_tokens").alias("__tokens"))
    stats = materialize(stats, "mixing-leaves")
    if budget is None:
        budget = int((stats.agg(F.sum("__tokens")).first()[0] or 0) * fraction)
    plan = leaf_budgets(stats, names, weights, F.lit(budget).cast("decimal(38,0)"), max_epochs)
    plan = plan.withColumns(
        {
            "__whole": F.expr("CASE WHEN __tokens > 0 THEN quota div __tokens ELSE 0 END"),
            "__rest": F.expr("CASE WHEN __tokens > 0 THEN quota % __tokens ELSE 0 END"),
            "__buckets": F.least(F.greatest(F.ceil(F.col("__docs") / BUCKET_ROWS), F.lit(1)), F.lit(MOST_BUCKETS)),
        }
    )
    plan = materialize(plan.select(*(F.col(c).alias(f"__up_{c}") for c in names), "__whole", "__rest", "__buckets"), "mixing-plan")

    digest = _digest(seed, F.col("__whole"), F.col("__id"))
    bucket = F.floor(F.conv(F.substring(F.col("__h"), 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("__buckets")).cast("int")
    last = _join_levels(docs, plan.where("__rest > 0"), names).withColumn("__h", digest).withColumn("__b", bucket)

    sums = last.groupBy(*names, "__b").agg(F.sum("n_tokens").alias("__sum"), F.max("__rest").alias("__rest"))
    w = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__to", F.sum("__sum").over(w))
    cut_at = sums.where("__to > __rest AND __to - __sum <= __rest").select(*(F.col(c).alias(f"__up_{c}") for c in names), F.col("__b").alias("__cut_b"), (F.col("__to") - F.col("__sum")).alias("__ahead"))
    cut_at = materialize(cut_at, "mixing-cuts")

    near = _join_levels(last, cut_at, names, more=F.col("__b") == F.col("__cut_b"))
    w = Window.partitionBy(*names).orderBy("__h", "__id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__to", F.col("__ahead") + F.sum("n_tokens").over(w))
    near = near.groupBy(*names, "__h", "__id", "__to", "__rest").agg(F.sum("n_tokens").alias("__own"))
    ends = near.where("__to > __rest AND __to - __own <= __rest").select(*(F.col(c).alias(f"__up_{c}") for c in names), F.col("__h").alias("__end_h"), F.col("__id").alias("__end_id"), (F.col("__rest") - F.col("__to") + F.col("__own")).alias("__end_take"))
    ends = ends.groupBy(*(f"__up_{c}" for c in names)).agg(F.min_by(F.struct("__end_h", "__end_id", "__end_take"), F.struct("__end_h", "__end_id")).alias("__end"))
    cuts = plan
    on = None
    for c in names:
        same = F.col(f"__up_{c}").eqNullSafe(F.col(f"__e_{c}"))
        on = same if on is None else on & same
    ends = ends.select(*(F.col(f"__up_{c}").alias(f"__e_{c}") for c in names), "__end.*")
    cuts = materialize(cuts.join(ends, on, "left").drop(*(f"__e_{c}" for c in names), "__buckets"), "mixing-ends")

    source = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("__row"), *needed) if whole_rows else docs
    rows = _join_levels(source, cuts, names).withColumn("__h", digest)
    here = F.struct("__h", "__id")
    end = F.struct(F.col("__end_h").alias("__h"), F.col("__end_id").alias("__id"))
    part = F.when(F.col("__end_h").isNull(), 0).when(here < end, F.col("n_tokens")).when(here == end, F.least("n_tokens", "__end_take")).otherwise(0)
    in_part = F.col("__end_h").isNotNull() & ((here < end) | ((here == end) & (F.col("__end_take") > 0)))
    rows = rows.withColumns({"__part": part, "__epochs": F.col("__whole").cast("int") + in_part.cast("int")}).where("__epochs > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    if whole_rows:
        return rows.select("__row.*")
    take = F.when(F.col("epoch") < F.col("__whole"), F.col("n_tokens")).otherwise(F.col("__part")).cast("long")
    return rows.select(F.col("__id").alias(id_col), *names, "epoch", "n_tokens", take.alias("take_tokens"))
