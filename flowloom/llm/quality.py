"""Document quality by hierarchical empirical Bayes.

A ridge logistic classifier on surface features and hashed words and byte triples gives each document's evidence. Grouped aggregation sums the expected
number of good documents by host and by path, and Beta posteriors shrink them: a host towards the whole corpus, a
path towards its host, the more so the fewer documents they have. How strongly follows from how much hosts differ from the
corpus, and paths from their hosts, beyond chance, by the method of moments. A document's posterior log-odds are its own evidence plus what the
other documents of its path and host say (its path's posterior without it) beyond the corpus' prior.

The classifier is fitted on at most `max_labels` labelled documents (chosen by a digest of the identifier);
everything else looks at every row.

Edge cases: null text counts as empty; an empty text has all features 0. Null hosts or paths form a group of
their own. Labels that are null, not 0 or 1, or of documents that aren't there are ignored; with fewer than two
classes left the classifier says the share of good labels (or 1/2 without labels) for every document. Repeated
rows each count. An empty table gives an empty table. Other columns, whatever their names, are returned untouched by `keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

FEATURES = ("log_words", "symbols", "capitals", "digits", "repeats", "distinct", "word_length", "stops", "foreign", "lines")
_SYMBOLS = "!$%&*#@^~<>{}[]=+\\/_|"
#: Buckets of hashed words, and of hashed triples of bytes.
HASHED = 128
#: Probabilities stay this far from 0 and 1.
_EDGE = 1e-6


def surface(text: str, words: list[str]) -> list[float]:
    """Surface features of a text with words, each of the order of 1."""
    n, lower = len(text), text.lower()
    return [
        math.log(len(words)) / 5,
        10 * sum(map(text.count, _SYMBOLS)) / n,
        sum(map(str.isupper, words)) / len(words),
        10 * sum(map(text.count, "0123456789")) / n,
        sum(map(eq, words, words[1:])) / len(words),
        len(set(words)) / len(words),
        (n - len(words)) / len(words) / 5,
        10 * (text.count(". ") + text.count(".\n") + text.count(", ")) / len(words),
        (len(lower.encode()) - len(lower)) / n,
        10 * text.count("\n") / len(words),
    ]


def features(text: str) -> np.ndarray:
    """Surface features, their square roots (small shares matter most), and square roots of the shares of hashed words and of hashed triples of bytes; all 0 without words."""
    words = text.split()
    out = np.zeros(2 * len(FEATURES) + 2 * HASHED, np.float32)
    if not words:
        return out
    plain = np.array(surface(text, words))
    data = text.encode()
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    triples = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(25)
    hashed = np.bincount(np.fromiter(map(crc32, data.split()), np.uint32) % np.uint32(HASHED), minlength=HASHED), np.bincount(triples, minlength=HASHED)
    out[: 2 * len(FEATURES)] = np.concatenate([plain, np.sqrt(np.abs(plain))])
    out[2 * len(FEATURES) :] = np.concatenate([np.sqrt(h / max(h.sum(), 1)) for h in hashed])
    return out


WIDTH = 2 * len(FEATURES) + 2 * HASHED


def _expand(x: np.ndarray) -> np.ndarray:
    """Features and a constant."""
    return np.hstack([x.astype(np.float64), np.ones((len(x), 1))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return np.array([0.0] * WIDTH + [math.log(share / (1 - share))])
    w, keep = np.zeros(WIDTH + 1), np.diag([ridge] * WIDTH + [1e-6])
    for _ in range(rounds):
        slope, bend = -keep @ w, keep.copy()
        for k in range(0, len(x), 2000):  # beside the features themselves, little is held at once
            z = _expand(x[k : k + 2000])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[k : k + 2000] - p)
            bend += (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from a bounded sample: at most max_labels rows of identifiers and labels are broadcast, and one task fits their features. Only weights go to the driver."""
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__lid"), F.col(label_col).cast("double").alias("__y"))
    sample = sample.orderBy(F.xxhash64("__lid"), "__lid", "__y").limit(max_labels)
    chosen = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    chosen = chosen.join(F.broadcast(sample), F.col("__id") == F.col("__lid")).select(F.col("__y"), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array([features(t.as_py()).tobytes() for t in b.column("__text")], pa.binary())], names=["y", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.empty((0, WIDTH), np.float32)], [np.empty(0)]
        for b in batches:
            x.append(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, WIDTH))
            y.append(b.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([fit(np.concatenate(x), np.concatenate(y)).tobytes()], pa.binary())], names=["w"])

    rows = chosen.mapInArrow(run, "y double, x binary")
    rows = rows.orderBy(F.xxhash64("x"), "y").limit(max_labels)  # the join gives more only where identifiers repeat
    found = rows.coalesce(1).mapInArrow(solve, "w binary").collect()
    return np.frombuffer(found[0]["w"]) if found else fit(np.empty((0, WIDTH), np.float32), np.empty(0))


def classified(df: DataFrame, weights: np.ndarray, columns: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The given columns and p_classifier, the classifier's probability for each row's text."""
    at = [f"__c{i}" for i in range(len(columns))]
    rows = df.select(*(c.alias(a) for a, c in zip(at, columns.values(), strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                x = np.array([features(t.as_py()) for t in part.column("__text")]).reshape(-1, WIDTH)
                p = 1 / (1 + np.exp(-np.clip(_expand(x) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], names=[*part.schema.names[:-1], "p_classifier"])

    kinds = ", ".join(f"{a} {t}" for a, t in rows.dtypes[:-1])
    out = rows.mapInArrow(run, f"{kinds}, p_classifier double")
    return out.select(*(F.col(a).alias(n) for a, n in zip(at, columns, strict=True)), "p_classifier")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, within: float, parents: int) -> float:
    """Pseudo-count of Beta priors with means __m, from how much the groups' rates (__s / __n) differ from them.

    Method of moments: the rates' spread around their parents' means, less what chance gives (`within`: the spread of
    single documents in a group, over the group's documents), is the spread of the groups themselves.
    """
    rate, m = F.col("__s") / F.col("__n"), F.col("__m")
    spread, room, n, count = groups.agg(F.sum(F.col("__n") * F.pow(rate - m, 2)), F.sum(F.col("__n") * m * (1 - m)), F.sum("__n"), F.count("*")).first()
    own = ((spread or 0.0) - max(count - parents, 0) * within) / max(n or 0, 1)
    return min(max((room or 0.0) / max(n or 0, 1) / max(own, 1e-9) - 1, 1.0), 10_000.0)


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """From rows (host, path, p_classifier): per (host, path) its sums and its host's, p_host and p_path; the corpus' mean; and the strengths of both priors."""
    p = F.col("p_classifier")
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("__n"), F.sum(p).alias("__s"), F.sum(p * p).alias("__q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"))
    n, s, inside, n_paths = paths.agg(F.sum("__n"), F.sum("__s"), F.sum(F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")), F.count("*")).first()
    mean = min(max((s or 0.5) / (n or 1), _EDGE), 1 - _EDGE)
    within = max(inside or 0.0, 0.0) / max((n or 0) - n_paths, 1)
    k_host = _strength(hosts.withColumn("__m", F.lit(mean)), within, 1)
    hosts = hosts.select(F.col("host").alias("__host"), F.col("__n").alias("__hn"), F.col("__s").alias("__hs"), ((F.col("__s") + k_host * mean) / (F.col("__n") + k_host)).alias("p_host"))
    paths = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))), "quality-hosts")
    k_path = _strength(paths.withColumn("__m", F.col("p_host")), within, paths.select("__host").distinct().count())
    paths = paths.withColumn("p_path", (F.col("__s") + k_path * F.col("p_host")) / (F.col("__n") + k_path))
    return materialize(paths.select("__host", F.col("path").alias("__path"), "p_host", "p_path", "__n", "__s", "__hn", "__hs"), "quality-sites"), mean, k_host, k_path


def with_posterior(scored: DataFrame, sites: DataFrame, mean: float, k_host: float, k_path: float) -> DataFrame:
    """Adds p_host, p_path and p_quality. sites has a row per path: Spark broadcasts it if it is small, else splits hot hosts.

    A document's own probability is taken out of its path's and host's sums before they speak for it, so its evidence counts once.
    """
    rows = scored.join(sites, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path"))).drop("__host", "__path")
    p = F.col("p_classifier")
    others_host = (F.col("__hs") - p + k_host * mean) / (F.col("__hn") - 1 + k_host)
    others = (F.col("__s") - p + k_path * others_host) / (F.col("__n") - 1 + k_path)
    odds = _logit(p) + _logit(others) - float(math.log(mean / (1 - mean)))
    return rows.withColumn("p_quality", 1 / (1 + F.exp(-odds))).drop("__n", "__s", "__hn", "__hs")


def assess(docs: DataFrame, labels: DataFrame, host: str, path: str, threshold: float = 0.5, label_col: str = "quality", max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, p_classifier, p_host, p_path, p_quality, kept (p_quality >= threshold). host, path: SQL expressions."""
    weights = train(docs, labels, label_col, max_labels, id_col, text_col)
    scored = classified(docs, weights, {"__id": F.col(id_col), "host": F.expr(host), "path": F.expr(path)}, text_col)
    scored = materialize(scored, "quality-scores")
    out = with_posterior(scored, *site_posteriors(scored))
    return out.select(F.col("__id").alias(id_col), "p_classifier", "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str, path: str, threshold: float = 0.5, label_col: str = "quality", max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `assess` keeps, with their columns. Texts are read twice rather than exchanged."""
    weights = train(docs, labels, label_col, max_labels, id_col, text_col)
    sites = site_posteriors(classified(docs, weights, {"host": F.expr(host), "path": F.expr(path)}, text_col))
    row = F.struct(*(F.col(c) for c in docs.columns))
    scored = classified(docs, weights, {"__row": row, "host": F.expr(host), "path": F.expr(path)}, text_col)
    return with_posterior(scored, *sites).where(F.col("p_quality") >= threshold).select("__row.*")
