"""Training rows of all detectors' features per flow, evaluation of models, and model cards."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from flowloom.functions import net, ngram
from flowloom.operators import features as feat
from flowloom.operators import models

KEY = ["flow_id", "flow_no"]


def rows(flows: DataFrame, packets: DataFrame, capture: str, label: str, ngrams: tuple[ngram.Ngrams, ngram.Ngrams] | None = None, denylist: Mapping[str, str] = net.BAD_JA3) -> DataFrame:
    """One row per flow: its features by each detector, prefixed, with label, is_attack and session_id.

    flows: as operators.flows.build gives them. Packet features (gaps, sizes and periodicity of c2_ where there are two
    packets or more; enc_, with the handshake's where packets have tls_raw; dns_ where they have questions) come from
    all packets of either direction between the flow's hosts, summed once per pair and then joined.
    """
    pair = [F.least("src_ip", "dst_ip").alias("__a"), F.greatest("src_ip", "dst_ip").alias("__b")]
    paired = packets.select("*", *pair)
    own = ["__a", "__b"]
    by_pair = {"ddos": feat.handshakes(paired, own), "enc": feat.encrypted(paired, own, denylist) if "tls_raw" in packets.columns else feat.first_packets(paired, own)}
    if {"dns_qname", "dns_qtype"} <= set(packets.columns):
        questions = paired.where("dns_qname != ''").withColumns({"qname": F.col("dns_qname"), "qtype": F.col("dns_qtype")})
        by_pair["dns"] = feat.dns(questions, own, ngrams)
    prefixed = lambda df, name: df.select(*own, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in own))
    pairs = reduce(lambda a, p: a.join(prefixed(p[1], p[0]), own, "left"), by_pair.items(), feat.packet_rhythm(paired, own))
    named = [F.lit(f"{capture}_{label}").alias("session_id"), F.lit(label).alias("label"), F.lit(int(label != "benign")).alias("is_attack")]
    alone = feat.exfiltration_against(flows, [*KEY, *_alone(), *pair, *named])
    exfil = [F.col(c).alias(f"exfil_{c}") for c in alone.columns[-5:]]
    base = alone.select(*own, *KEY, *(c for c in alone.columns[2:-5] if c not in own), *exfil)
    return feat.by_packets(base.join(pairs, own, "left"), "__packets", "c2_").drop(*own)


def _alone() -> list:
    """Features by ddos, c2 and recon of a group that is one flow: of gaps, spread and runs there are none."""
    span = F.greatest("duration", F.lit(net.SHORTEST))
    tcp = F.col("protocol") == net.TCP
    one, none = F.lit(1).cast("long"), F.lit(0.0)
    found = {
        "ddos": {"packets_per_sec": F.col("total_packets") / span, "bytes_per_sec": F.col("total_bytes") / span, "unique_src_count": one, "unique_src_per_sec": 1 / span, "src_ip_entropy": none, "protocol_mix_ratio": F.lit(1.0)},
        "c2": {"iat_mean": none, "iat_variance": none, "iat_cv": none, "dst_cardinality": one, "session_duration_mean": F.col("duration"), "session_duration_cv": none, "byte_size_cv": none, "periodicity_score": none},
        "recon": {
            "unique_dst_hosts": one, "syn_no_completion_ratio": (tcp & (F.col("packets_fwd") > 0) & (F.col("packets_bwd") == 0)).cast("double"), "scan_rate": 1 / span,
            "unique_dst_ports": one, "port_sequence_score": none,
        },
    }
    return [c.alias(f"{name}_{n}") for name, columns in found.items() for n, c in columns.items()]


def save(training: DataFrame, path: str) -> None:
    """The rows as CSV with a header; lists become their values between blanks."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in training.dtypes]
    training.select(*flat).write.csv(path, header=True)


def split(training: DataFrame, train: float = 0.70, validate: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds `part` (train, validation, test): by session within each label, so that no session is on two sides.

    Sessions stand in the order of a seeded hash. A label of fewer than three sessions is split by rows, each by its own
    hash, so its shares hold to within chance. Where no session is left for the test, validation rows serve for it too, once more.
    """
    sessions = training.groupBy("label", "session_id").agg(F.count("*").alias("__n"))
    of_label, order = Window.partitionBy("label"), Window.partitionBy("label").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), "session_id")), "session_id")
    sessions = sessions.select("label", "session_id", F.count("*").over(of_label).alias("__k"), F.row_number().over(order).alias("__r"))
    n_train = F.greatest(F.lit(1), F.floor(F.col("__k") * train))
    n_both = n_train + F.greatest(F.lit(1), F.floor(F.col("__k") * validate))
    both = F.when(F.col("__k") <= n_both, F.array(F.lit("validation"), F.lit("test"))).otherwise(F.array(F.lit("validation")))
    parts = F.when(F.col("__r") <= n_train, F.array(F.lit("train"))).when(F.col("__r") <= n_both, both).otherwise(F.array(F.lit("test")))
    names = [c for c in training.columns if not isinstance(training.schema[c].dataType, (ArrayType, MapType))]
    u = F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 30)) / (1 << 30)
    by_row = F.array(F.when(u < train, "train").when(u < train + validate, "validation").otherwise("test"))
    rows = training.join(sessions, ["label", "session_id"]).withColumn("part", F.explode(F.when(F.col("__k") >= 3, parts).otherwise(by_row)))
    return rows.select(*training.columns, "part")


def fit(training: DataFrame, positive: str, features: list[str], trees: int = 50) -> PipelineModel:
    """A forest that tells `positive` from harmless rows."""
    known = training.where(F.col("label").isin("benign", positive)).withColumn("label", (F.col("label") == positive).cast("double"))
    return models.fit_forest(known.select("label", *(F.col(f).cast("double").alias(f) for f in features)), features, trees=trees)


def metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: confusion counts, precision, recall and f1 of two columns of 0 and 1; ratios without a base are 0."""
    y, p = F.col(actual), F.col(predicted)
    counts = df.agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))))
    ratio = lambda a, b: net.safe_ratio(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def evaluate(model: PipelineModel, test: DataFrame, positive: str, least: float = 0.5) -> DataFrame:
    """Metrics of a model on held-out rows of `positive` and harmless ones."""
    known = test.where(F.col("label").isin("benign", positive)).withColumn("__y", (F.col("label") == positive).cast("int"))
    judged = models.with_probability(known, model, "__p").withColumn("__p", (F.col("__p") >= least).cast("int"))
    return metrics(judged, "__y", "__p")


def card(name: str, method: str, threat: str, measured: dict, n_train: int, n_test: int) -> str:
    """A model card in Markdown; `measured` is the row of `evaluate` as a dict."""
    figures = "\n".join(f"| {title} | `{measured[key]:.4f}` |" for title, key in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1")))
    return f"""# Model card: {name}

| | |
|---|---|
| Method | {method} |
| Threat class | {threat} |
| Rows for training | {n_train:,} |
| Rows held out | {n_test:,}, of sessions that training has not seen |

| Measure | Score |
|---|---|
{figures}

| | predicted harmless | predicted attack |
|---|---|---|
| harmless | {measured["tn"]} | {measured["fp"]} |
| attack | {measured["fn"]} | {measured["tp"]} |
"""


def report(results: list[dict]) -> str:
    """A report of replays in Markdown; each result has target_mbps, effective_mbps, packets_per_sec, alerts, median_latency_ms, p95_latency_ms and drops."""
    names = {"target_mbps": "Target Mbit/s", "effective_mbps": "Mbit/s", "packets_per_sec": "Packets/s", "alerts": "Alerts", "median_latency_ms": "Median ms", "p95_latency_ms": "95 % ms", "drops": "Drops"}
    line = lambda cells: "| " + " | ".join(cells) + " |"
    shown = lambda x: f"{x:.2f}" if isinstance(x, float) else str(x)
    passes = all(r["median_latency_ms"] <= 5000 and r["drops"] == 0 for r in results)
    rows = [line(shown(r[c]) for c in names) for r in results]
    return "\n".join(["# Replay report", "", line(names.values()), line(["---"] * len(names)), *rows, "", f"Result: {'PASS' if passes else 'FAIL'} (median latency of at most 5000 ms, no drops)", ""])
