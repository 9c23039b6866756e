"""How likely a name's letter pairs and triples are, given a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(rows: DataFrame, text: str, n: int) -> DataFrame:
    """One row per run of n characters; texts shorter than n give none."""
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return rows.where(F.length(text) >= n).withColumn("gram", F.explode(F.transform(at, lambda i: F.col(text).substr(i, F.lit(n)))))


@dataclass
class Ngrams:
    """Counts of a corpus's n-grams. There are at most (distinct characters)^n of them, whatever the corpus."""

    n: int
    counts: DataFrame
    size: int  # total of counts + (distinct characters)^n


def fit(corpus: DataFrame, text: str, n: int) -> Ngrams:
    counts = grams(corpus, text, n).groupBy("gram").agg(F.count("*").alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    letters = grams(corpus, text, 1).agg(F.count_distinct("gram")).first()[0]
    return Ngrams(n, counts, total + letters**n)


def likelihood(rows: DataFrame, label: str, model: Ngrams, name: str) -> DataFrame:
    """Adds the mean of log2((count + 1) / size) over a label's n-grams; 0 if it is shorter than n.

    Each distinct label is scored once. The table of n-grams has a size bound by the alphabet, so Spark may broadcast it.
    """
    each = grams(rows.select(label).distinct(), label, model.n).join(model.counts, "gram", "left")
    scores = each.groupBy(label).agg(F.avg(F.log2((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.size)))).alias(name))
    return rows.join(scores, label, "left").fillna(0.0, [name])


def combined(bigram: Column, trigram: Column) -> Column:
    return 0.4 * bigram + 0.6 * trigram
