"""Forests as flat tables of nodes: walked by column expressions or by SQL, and stored as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NODES = "node int, root boolean, feature int, `limit` double, left int, right int, value double, levels int, columns array<string>, scale double, offset double"


@dataclass
class Forest:
    """Trees one after the other: the feature to test (-1: leaf), its limit, both children, and a leaf's value; `levels` steps reach all leaves.

    The result is the mean of the leaves' values, or with a scale -2**(-mean / scale) - offset.
    """

    columns: list[str]
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    levels: int = 0
    scale: float = 0.0
    offset: float = 0.0

    def leaf(self, value: float, level: int) -> int:
        """A new node, a leaf until `split`; its number."""
        me = len(self.feature)
        for a, v in ((self.feature, -1), (self.limit, 0.0), (self.left, me), (self.right, me), (self.value, float(value))):
            a.append(v)
        self.levels = max(self.levels, level)
        return me

    def mean(self, x: np.ndarray) -> np.ndarray:
        """The mean of the leaves' values for rows of features."""
        feature, limit, left, right, value = (np.asarray(a) for a in (self.feature, self.limit, self.left, self.right, self.value))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.levels):
                goes = x[rows, np.maximum(feature[at], 0)] < limit[at]
                at = np.where(feature[at] < 0, at, np.where(goes, left[at], right[at]))
            total += value[at]
        return total / len(self.roots)

    def result(self) -> Column:
        """The result for columns of these names; missing values count as 0. The nodes are constant arrays, and a tree's walk takes a level a step."""
        # One constant each once plans are optimised; so many single literals would take long to plan.
        kinds = {"feature": "int", "limit": "double", "left": "int", "right": "int", "value": "double", "roots": "int"}
        arrays = {n: F.split(F.lit(",".join(map(repr, getattr(self, n)))), ",").cast(f"array<{kind}>") for n, kind in kinds.items()}
        zero = F.lit(0.0)
        x = F.array(*(F.nanvl(F.coalesce(F.col(c).cast("double"), zero), zero) for c in self.columns))

        def step(at: Column, _: Column) -> Column:
            feature = F.get(arrays["feature"], at)
            return F.when(feature < 0, at).when(F.get(x, feature) < F.get(arrays["limit"], at), F.get(arrays["left"], at)).otherwise(F.get(arrays["right"], at))

        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(self.levels, 1))), root, step)
        total = F.aggregate(F.transform(arrays["roots"], lambda root: F.get(arrays["value"], leaf(root))), zero, lambda a, v: a + v)
        mean = total / len(self.roots)
        return -F.pow(F.lit(2.0), -mean / self.scale) - self.offset if self.scale else mean

    def sql(self, rows: str, key: str, name: str, prefix: str = "forest") -> str:
        """The same as recursive SQL: a table <prefix>_scores (key, name) for `rows`, a table with key and the features."""
        real = lambda a: "[" + ", ".join(f"{float(v)!r}" + ("" if "e" in repr(float(v)) else "e0") for v in a) + "]"
        whole = lambda a: "[" + ", ".join(map(str, a)) + "]"
        x = ", ".join(f"coalesce({c}, 0)::DOUBLE" for c in self.columns)
        mean = f"sum(n.value) / {len(self.roots)}"
        result = f"-pow(2, -{mean} / {self.scale!r}) - ({self.offset!r})" if self.scale else mean
        return f"""{prefix}_nodes AS (SELECT unnest(range({len(self.feature)})) AS node, unnest({whole(self.feature)}) AS feature, unnest({real(self.limit)}) AS edge, unnest({whole(self.left)}) AS low, unnest({whole(self.right)}) AS high, unnest({real(self.value)}) AS value),
  {prefix}_walk AS (SELECT {key}, [{x}] AS x, unnest({whole(self.roots)})::BIGINT AS node FROM {rows}
   UNION ALL SELECT w.{key}, w.x, (CASE WHEN w.x[n.feature + 1] < n.edge THEN n.low ELSE n.high END)::BIGINT FROM {prefix}_walk w JOIN {prefix}_nodes n ON n.node = w.node WHERE n.feature >= 0),
  {prefix}_scores AS (SELECT w.{key}, {result} AS {name} FROM {prefix}_walk w JOIN {prefix}_nodes n ON n.node = w.node WHERE n.feature < 0 GROUP BY w.{key})"""

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node as Parquet, on any file system that Spark reaches; a forest has some thousand nodes."""
        roots = set(self.roots)
        each = zip(self.feature, self.limit, self.left, self.right, self.value, strict=True)
        rows = [(n, n in roots, *v, self.levels, self.columns, self.scale, self.offset) for n, v in enumerate(each)]
        spark.createDataFrame(rows, _NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        rows = spark.read.parquet(path).orderBy("node").collect()
        part = lambda c: [r[c] for r in rows]
        first = rows[0]
        return Forest(list(first["columns"]), [r["node"] for r in rows if r["root"]], *(part(c) for c in ("feature", "limit", "left", "right", "value")), first["levels"], first["scale"], first["offset"])


def fit_votes(x: np.ndarray, y: np.ndarray, columns: Sequence[str], trees: int = 30, depth: int = 5, seed: int = 42) -> Forest:
    """A random forest on a reference sample of some hundred rows: the result is the share of the class 1 (y is 0 or 1).

    Each tree takes a sample with replacement, each split the best of a random few features by Gini's impurity.
    """
    rng, out = np.random.default_rng(seed), Forest(list(columns))
    few = max(1, int(np.sqrt(x.shape[1])))

    def best(rows: np.ndarray) -> tuple[int, float] | None:
        found, least = None, np.inf
        for f in rng.choice(x.shape[1], few, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            with np.errstate(divide="ignore", invalid="ignore"):
                below, above = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                impurity = np.where(values[1:] > values[:-1], n * below * (1 - below) + (len(order) - n) * above * (1 - above), np.inf)
            at = int(np.argmin(impurity))
            if impurity[at] < least:
                found, least = (int(f), float((values[at] + values[at + 1]) / 2)), impurity[at]
        return found

    def grow(rows: np.ndarray, level: int) -> int:
        me = out.leaf(y[rows].mean(), level)
        cut = best(rows) if level < depth and 0 < y[rows].sum() < len(rows) else None
        if cut is not None:
            below = x[rows, cut[0]] < cut[1]
            out.feature[me], out.limit[me] = cut
            out.left[me], out.right[me] = grow(rows[below], level + 1), grow(rows[~below], level + 1)
        return me

    for _ in range(trees):
        out.roots.append(grow(rng.integers(0, len(x), len(x)), 0))
    return out


def with_result(df: DataFrame, forest: Forest, name: str) -> DataFrame:
    """Adds the forest's result; features that aren't there count as 0."""
    missing = {c: F.lit(0.0) for c in forest.columns if c not in df.columns}
    return df.withColumns(missing).withColumn(name, forest.result()).drop(*missing)
