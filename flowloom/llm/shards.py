"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn beforehand, so that all rows together are dealt as
a uniform shuffle would: partition by partition from a multivariate hypergeometric law over what the shards still
lack. Each partition then permutes its rows, hands the first run to shard 0, the next to shard 1 and so on, and
every shard permutes what it received. The matrix has a row per partition and a column per shard, whatever the
number of rows.

Law `rows`: counts of any two shards differ by one at most. Texts stay with their rows: equal texts (groups) are
spread like any others.

Edge cases: null text has size 16 and the checksum of no bytes. Repeated rows are placed one by one. With fewer
rows than shards some shards stay empty. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

#: About how many rows of a shard share a bucket when slots are numbered.
BUCKET_ROWS = 256


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """matrix[p, s]: rows that partition p sends to shard s; its sums are `rows` and `shards`."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lack = np.array(shards, dtype=np.int64)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for p, n in enumerate(rows):
        for s in range(len(lack) - 1):  # one hypergeometric draw per shard, given what this partition still holds
            rest = int(lack[s + 1 :].sum())
            own = n - int(out[p, :s].sum())
            out[p, s] = _hypergeometric(rng, int(lack[s]), rest, own)
        out[p, -1] = n - int(out[p, :-1].sum())
        lack -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw: numpy's below its limit of 1e9, else by inversion of the same law around its mode.

    Neighbouring probabilities have simple ratios, so the law is summed outwards from the mode as far as a double can
    tell probabilities from 0 (beyond 12 standard deviations less than 1e-31 is left). That takes some 24 standard deviations
    of terms, of which there are at most the square root of draws.
    """
    if not draws or not good:
        return 0
    whole = good + bad
    if whole < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lowest, highest = max(0, draws - bad), min(good, draws)
    mode = (draws + 1) * (good + 1) // (whole + 2)
    share = good / whole
    reach = int(12 * np.sqrt(max(draws * share * (1 - share) * (whole - draws) / (whole - 1), 0.0))) + 40
    up = np.arange(mode, min(highest, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(lowest, mode - reach), -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) / (up + 1)) + np.log((draws - up) / (bad - draws + up + 1)))
    fall = np.cumsum(np.log(down / (good - down + 1)) + np.log((bad - draws + down) / (draws - down + 1)))
    weights = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    return mode - len(down) + int(min(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()), len(weights) - 1))


def shard(df: DataFrame, n_shards: int = 40, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (from 0, without gaps in each shard), grown_shard (null under this law)."""
    spark = df.sparkSession
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"))
    # Permute locally: by a seeded hash; the row's place in its partition is then the low 33 bits of this counter.
    rows = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "__id", "text_crc32"), "__id").withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumns({"__part": F.shiftright("__at", 33), "__rank": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at"), "shard-rows")

    parts = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row per partition
    total = sum(n for _, n in parts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in parts], sizes, seed)
    ends = np.cumsum(matrix, axis=1)
    plan = spark.createDataFrame([(int(p), [int(x) for x in e]) for (p, _), e in zip(parts, ends, strict=True)], "__part long, __ends array<long>")

    # Exchange: a row goes to the shard whose run in its partition holds its rank.
    sent = rows.join(plan, "__part").withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
    # Permute again: by a second hash, in buckets whose sizes are known before any row is numbered.
    buckets = max(1, -(-total // (n_shards * BUCKET_ROWS)))
    key = F.xxhash64(F.lit(seed + 1), "__part", "__rank")
    sent = sent.withColumn("__key", key).withColumn("__bucket", F.pmod(F.col("__key"), F.lit(buckets)).cast("int"))
    sent = sent.select("__id", "size", "text_crc32", "shard", "__key", "__bucket", "__part", "__rank")
    held = sent.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("shard", "__bucket").orderBy("__key", "__part", "__rank")
    numbered = sent.withColumn("__slot", F.row_number().over(within) - 1).join(held, ["shard", "__bucket"])
    return numbered.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("__ahead") + F.col("__slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
