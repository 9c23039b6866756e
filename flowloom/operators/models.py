"""Models behind the detectors: fitted on small reference samples, stored, and applied to columns."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import isolation, trees

#: Ranges of harmless traffic and handshakes, and of regular and irregular contacts.
CALM_TRAFFIC = {
    "packets_per_sec": (1, 100), "bytes_per_sec": (100, 100_000), "syn_ack_ratio": (0.5, 2), "unique_src_per_sec": (0.1, 10),
    "src_ip_entropy": (0, 3), "protocol_mix_ratio": (0.3, 1), "half_open_count": (0, 5),
}
CALM_HANDSHAKES = {
    "cipher_suite_count": (12, 30), "extension_count": (8, 16), "pkt_size_mean": (250, 850), "pkt_size_std": (100, 450),
    "pkt_ipt_mean": (0.01, 0.25), "pkt_ipt_std": (0.01, 0.2),
}
IRREGULAR = {
    "iat_mean": (0.1, 30), "iat_cv": (0.5, 2.5), "periodicity_score": (0, 0.25), "dst_cardinality": (3, 40),
    "session_duration_cv": (0.4, 2), "byte_size_cv": (0.4, 1.8),
}
REGULAR = {
    "iat_mean": (5, 120), "iat_cv": (0, 0.15), "periodicity_score": (0.45, 0.98), "dst_cardinality": (1, 2),
    "session_duration_cv": (0, 0.15), "byte_size_cv": (0, 0.2),
}
NAME_FEATURES = ["entropy", "ngram_score", "digit_ratio", "consonant_ratio", "label_length"]


#: Frequent English words, of which the default name model takes letters' runs and its harmless names.
KNOWN_WORDS = (
    "about above across after again against all almost also always among another answer any because been before began being below between book both boy "
    "bring came change children city close come could country course cut day different does down each early earth eat end enough even every example eye "
    "face family far father feet few find first follow food form found four from girl give good great group grow had hand hard has have head hear help her "
    "here high him his home house how idea important into just keep kind know land large last later learn leave left letter life light like line list little "
    "live long look made make man many may mean might mile more most mother mountain move much must name near need never next night now number off often old "
    "once only open or other our out over own page paper part people place plant play point press put question quick read really right river run said same saw "
    "say school sea second see seem sentence set she should show side small some something sometimes song soon sound spell start state still stop story study "
    "such take talk tell than that the their them then there these they thing think this those thought three through time together took tree try turn two under "
    "until use very walk want was watch water way well went were what when where which while white who why will with without word work world would write year you young your"
).split()


def traffic_forest() -> trees.Forest:
    return isolation.fit(isolation.uniform(list(CALM_TRAFFIC.values())), list(CALM_TRAFFIC))


def handshake_forest() -> trees.Forest:
    return isolation.fit(isolation.uniform(list(CALM_HANDSHAKES.values())), list(CALM_HANDSHAKES))


def contact_rows(per_class: int = 150, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Reference rows of irregular (0) and regular (1) contacts."""
    x = np.vstack([isolation.uniform(list(r.values()), per_class, seed + i) for i, r in enumerate((IRREGULAR, REGULAR))])
    return x, np.repeat([0.0, 1.0], per_class)


def beacon_forest() -> trees.Forest:
    return trees.fit_votes(*contact_rows(), list(IRREGULAR))


def name_features(labels: Sequence[str], words: Sequence[str] = KNOWN_WORDS) -> np.ndarray:
    """NAME_FEATURES of single names, with the n-grams of words between blanks; what column functions give for rows."""
    text, out = " ".join(sorted(words)), []
    counts = {n: Counter(text[i : i + n] for i in range(len(text) - n + 1)) for n in (1, 2, 3)}

    def score(name: str, n: int) -> float:
        size = sum(counts[n].values()) + len(counts[1]) ** n
        each = [np.log2((counts[n][name[i : i + n]] + 1) / size) for i in range(len(name) - n + 1)]
        return float(np.mean(each)) if each else 0.0

    for name in labels:
        n, shares = len(name), np.array([*Counter(name).values()]) / max(len(name), 1)
        entropy = float(-(shares * np.log2(shares)).sum()) if n > 1 else 0.0
        inside = lambda chars: sum(c in chars for c in name) / n if n else 0.0  # noqa: B023, E731
        out.append([entropy, 0.4 * score(name, 2) + 0.6 * score(name, 3), inside("0123456789"), inside("bcdfghjklmnpqrstvwxyz"), float(n)])
    return np.array(out)


def name_forest(words: Sequence[str] = KNOWN_WORDS) -> trees.Forest:
    """Told from generated names: words of four letters and more."""
    known, made = [w for w in words if len(w) > 3], random_names()
    return trees.fit_votes(name_features([*known, *made], words), np.repeat([0.0, 1.0], [len(known), len(made)]), NAME_FEATURES)


def contacts(spark: SparkSession, per_class: int = 150, seed: int = 42) -> DataFrame:
    """Labelled reference rows of irregular (0) and regular (1) contacts."""
    rows = [(*map(float, r), float(label)) for r, label in zip(*contact_rows(per_class, seed), strict=True)]
    return spark.createDataFrame(rows, [*IRREGULAR, "label"])


def random_names(n: int = 200, seed: int = 42) -> list[str]:
    """Names as generators make them: of letters and digits, of consonants, or of hexadecimal digits."""
    rng = random.Random(seed)
    kinds = ("abcdefghijklmnopqrstuvwxyz0123456789", "bcdfghjklmnpqrstvwxyz", "0123456789abcdef")
    return ["".join(rng.choices(kinds[i % 3], k=rng.randint(8, 20))) for i in range(n)]


def fit_forest(rows: DataFrame, features: Sequence[str], trees: int = 30, depth: int = 5, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="__features", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    return Pipeline(stages=[assembler, forest]).fit(rows.fillna(0.0, list(features)))


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model stored at path; if there is none, a new one, stored there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def with_probability(df: DataFrame, model: PipelineModel, name: str = "probability") -> DataFrame:
    """Adds the probability of the class 1. Missing features count as 0."""
    features = model.stages[0].getInputCols()
    rows = df.fillna(0.0, [c for c in features if c in df.columns]).withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
    out = model.transform(rows).withColumn(name, vector_to_array("__probability")[1])
    return out.select(*df.columns, name)
