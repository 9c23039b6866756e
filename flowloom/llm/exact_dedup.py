"""Exact duplicates by a tree merge of sorted digest runs (DataFrame functions only).

Each input partition becomes a run: its distinct fingerprints in order, each with the identifier to keep and the
number of rows. In binomial rounds, FAN_IN runs (four doublings) at a time merge into one: rows of the runs that meet are
exchanged by run and fingerprint, sorted, and of each stretch of equal fingerprints the best identifier and the sum of rows
stay, in order, as the next run. The winners then travel down the same tree to every row, by merge joins. A group of copies,
however large, is one row per run before anything is exchanged, and at most FAN_IN rows meet for one fingerprint.

A fingerprint is (SHA-256, length in bytes, xxHash64): at every level a digest that meets its equal is verified by length and
by the second, independent hash, and rows stay apart unless all three agree. Whole texts are never exchanged.

Edge cases: null text counts as empty; empty texts are equal to each other. Repeated rows (same identifier) count
once each in group_size; all rows whose identifier is the one kept have kept = true, and `deduplicate` returns one of them.
A row without identifier is kept only if no equal text has one. An empty table gives an empty
table. Extra columns, whatever their names, are ignored by `duplicates` and returned untouched by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

FAN_IN = 16
_KEY = ["__sha", "__bytes", "__xx"]


def fingerprint(text) -> list:
    """The columns that stand for a text's content."""
    whole = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(whole, 256)).alias("__sha"), F.octet_length(whole).alias("__bytes"), F.xxhash64(whole).alias("__xx")]


def _merged(runs: DataFrame, best) -> DataFrame:
    """The runs of the next level, each sorted: one row per fingerprint of the FAN_IN runs below."""
    stretch = Window.partitionBy("__run", *_KEY)
    rows = runs.withColumn("__run", F.floor(F.col("__run") / FAN_IN).cast("int"))
    rows = rows.select("__run", *_KEY, best("__keep").over(stretch).alias("__keep"), F.sum("__n").over(stretch).alias("__n"), F.row_number().over(stretch.orderBy("__keep")).alias("__r"))
    return rows.where("__r = 1").drop("__r")


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. keep: 'smallest' or 'largest' identifier of equal texts."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = df.select(F.col(id_col).alias("__id"), *fingerprint(F.col(text_col)), F.spark_partition_id().alias("__run"))
    rows = materialize(rows.sortWithinPartitions(*_KEY), "digest-runs")
    runs = (rows.agg(F.max("__run")).first()[0] or 0) + 1

    levels = [rows.groupBy(*_KEY, "__run").agg(best("__id").alias("__keep"), F.count("*").alias("__n"))]
    while runs > 1:
        levels.append(materialize(_merged(levels[-1], best), "digest-level"))
        runs = -(-runs // FAN_IN)

    won = levels.pop()
    while levels:
        below = levels.pop().select(*_KEY, "__run", F.floor(F.col("__run") / FAN_IN).cast("int").alias("__up"))
        won = below.join(won.withColumnRenamed("__run", "__up"), [*_KEY, "__up"]).select(*_KEY, "__run", "__keep", "__n")
    return rows.join(won, [*_KEY, "__run"]).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def short(sha) -> Column:
    """60 bits of a digest in hexadecimal: with an identifier, enough to tell its texts apart."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def without(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that `rows` (__id, __sha, kept: one for each of df's) keeps; of rows equal in identifier and text, one.

    What to drop is written as (identifier, short digest), so texts are exchanged only where that table is too large to broadcast.
    """
    rows = rows.select("__id", short(F.col("__sha")).alias("__x"), "kept")
    dropped = materialize(rows.where("NOT kept").select("__id", "__x").distinct(), "dropped-texts")
    again = materialize(rows.where("kept").groupBy("__id", "__x").agg(F.count("*").alias("__n")).where("__n > 1").select("__id", "__x"), "repeated-texts")
    digest = short(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("__digest")
    own = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("__row"), F.col(id_col).alias("__own"), digest)
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__x"))
    out = own.join(dropped, same, "left_anti")
    if not again.isEmpty():
        out = out.join(again, same, "left_anti").union(own.join(again, same, "left_semi").dropDuplicates(["__own", "__digest"]))
    return out.select("__row.*")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of df whose identifier is the one kept of their text; of rows equal in identifier and text, one."""
    rows = duplicates(df, id_col, text_col, keep).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    return without(df, materialize(rows, "digest-kept"), id_col, text_col)
