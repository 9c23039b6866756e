"""Feature vectors of groups of flows, packets or DNS questions.

Each function takes the columns that name a group and gives one row per group. Everything is partial aggregation
by those columns, so nothing is exchanged but partial sums, distinct values and, where order matters, times.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import net, ngram
from flowloom.operators import ordered
from flowloom.sources import frames


def _duration(start: str, end: Column) -> Column:
    return F.greatest(F.max(end) - F.min(start), F.lit(net.SHORTEST))


def with_entropy(counted: DataFrame, groups: list[str], n: str, name: str) -> DataFrame:
    """Per group, the entropy in bits of a value counted by (groups, value) in column n."""
    # H = log2 N - sum(c log2 c) / N needs only one pass over the counts.
    total, weighted = F.sum(n), F.sum(F.col(n) * F.log2(F.col(n)))
    return counted.groupBy(*groups).agg(F.when(F.count("*") > 1, F.log2(total) - weighted / total).otherwise(0.0).alias(name))


def ddos(flows: DataFrame, groups: list[str]) -> DataFrame:
    """Rates, spread of sources and mix of protocols per group."""
    end = F.col("start_time") + F.col("duration")
    base = flows.groupBy(*groups).agg(
        _duration("start_time", end).alias("span"), F.sum(F.col("packets_fwd") + F.col("packets_bwd")).alias("packets"),
        F.sum(F.col("bytes_fwd") + F.col("bytes_bwd")).alias("bytes"), F.count("*").alias("n_flows"),
    )
    by_src = flows.groupBy(*groups, "src_ip").agg(F.count("*").alias("n"))
    spread = by_src.groupBy(*groups).agg(F.count("*").alias("unique_src_count"), F.when(F.count("*") > 1, F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).otherwise(0.0).alias("src_ip_entropy"))
    mix = flows.groupBy(*groups, "protocol").agg(F.count("*").alias("n")).groupBy(*groups).agg((F.max("n") / F.sum("n")).alias("protocol_mix_ratio"))
    out = base.join(spread, groups).join(mix, groups)
    return out.select(
        *groups, (F.col("packets") / F.col("span")).alias("packets_per_sec"), (F.col("bytes") / F.col("span")).alias("bytes_per_sec"), "unique_src_count",
        (F.col("unique_src_count") / F.col("span")).alias("unique_src_per_sec"), "src_ip_entropy", "protocol_mix_ratio",
    )


def handshakes(packets: DataFrame, groups: list[str]) -> DataFrame:
    """SYN to ACK ratio and SYNs never answered, from packets of a group and its TCP flows with traffic both ways."""
    syn, ack = net.has_flags(F.col("tcp_flags"), net.SYN), net.has_flags(F.col("tcp_flags"), net.ACK)
    keyed = packets.select("*", *[c for c in net.flow_key() if c is not None][:4], net.flow_key()[5])
    keyed = keyed.withColumn("__fwd", F.col("is_forward"))
    by_flow = keyed.groupBy(*groups, "ip_a", "port_a", "ip_b", "port_b", "protocol").agg(
        F.count_if(syn).alias("syn"), F.count_if(ack).alias("ack"), F.count_if(syn & ~ack).alias("bare"), F.count_if(~F.col("__fwd")).alias("back"),
    )
    both = (F.col("protocol") == net.TCP) & (F.col("back") > 0)
    return by_flow.groupBy(*groups).agg(
        net.safe_ratio(F.sum("syn").cast("double"), F.sum("ack").cast("double")).alias("syn_ack_ratio"), F.greatest(F.sum("bare") - F.count_if(both), F.lit(0)).alias("half_open_count")
    )


def recon(flows: DataFrame, groups: list[str], also: tuple[Column, ...] = ()) -> DataFrame:
    """Fan-out over ports and hosts, unanswered TCP flows, runs of neighbouring ports and the rate of flows; and aggregates of `also`."""
    tcp = F.col("protocol") == net.TCP
    lone = tcp & (F.col("packets_fwd") > 0) & (F.col("packets_bwd") == 0)
    base = flows.groupBy(*groups).agg(
        F.count_distinct("dst_ip").alias("unique_dst_hosts"), net.safe_ratio(F.count_if(lone).cast("double"), F.count_if(tcp).cast("double")).alias("syn_no_completion_ratio"),
        (F.count("*") / _duration("start_time", F.col("start_time") + F.col("duration"))).alias("scan_rate"), *also,
    )
    ports = flows.select(*groups, "dst_port").distinct()
    after = F.lead("dst_port").over(Window.partitionBy(*groups).orderBy("dst_port"))
    ports = ports.withColumn("__next", after).groupBy(*groups).agg(
        F.count("*").alias("unique_dst_ports"), net.safe_ratio(F.count_if(F.col("__next") - F.col("dst_port") == 1).cast("double"), (F.count("*") - 1).cast("double")).alias("port_sequence_score")
    )
    return base.join(ports, groups)


def gaps(rows: DataFrame, groups: list[str], at: str, width: float = 3600.0) -> DataFrame:
    """Per group: mean, variance and coefficient of variation of the gaps between rows in order of time (0 where there is none).

    Gaps are taken within spans of `width` seconds and between neighbouring spans of a group, whose means and variances are then
    joined, so no group's rows are ordered in one task.
    """
    rows = rows.select(*groups, F.col(at).alias("__at"), F.floor(F.col(at) / width).alias("__span"))
    inner = rows.withColumn("__gap", F.col("__at") - F.lag("__at").over(Window.partitionBy(*groups, "__span").orderBy("__at")))
    parts = inner.groupBy(*groups, "__span").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count("__gap").alias("n"), F.avg("__gap").alias("m"), F.var_pop("__gap").alias("v"))
    gap = F.col("__first") - F.lag("__last").over(Window.partitionBy(*groups).orderBy("__span"))
    both = F.array(F.struct("n", "m", "v"), F.struct(F.when(gap.isNotNull(), 1).otherwise(0).cast("long").alias("n"), gap.alias("m"), F.lit(0.0).alias("v")))
    parts = parts.select(*groups, both.alias("__both")).select(*groups, F.inline("__both"))
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*groups)) / F.sum("n").over(Window.partitionBy(*groups))
    parts = parts.withColumn("__mean", mean)
    variance = F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("__mean"), 2))) / F.sum("n")
    out = parts.groupBy(*groups).agg(F.max("__mean").alias("iat_mean"), F.when(F.sum("n") > 0, variance).alias("iat_variance"))
    cv = F.when(F.abs("iat_mean") < 1e-12, 0.0).otherwise(F.sqrt("iat_variance") / F.abs("iat_mean"))
    return out.withColumn("iat_cv", cv).fillna(0.0, ["iat_mean", "iat_variance", "iat_cv"])


def _variation(c: str) -> Column:
    return F.coalesce(F.when(F.abs(F.avg(c)) < 1e-12, 0.0).otherwise(F.coalesce(F.stddev_pop(c), F.lit(0.0)) / F.abs(F.avg(c))), F.lit(0.0))


def beacon(flows: DataFrame, groups: list[str]) -> DataFrame:
    """Regularity of start times, sizes and durations, and the number of peers."""
    size = (F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double")
    sums = flows.withColumn("__size", size).groupBy(*groups).agg(
        F.count_distinct("dst_ip").alias("dst_cardinality"), F.avg("duration").alias("session_duration_mean"), _variation("duration").alias("session_duration_cv"), _variation("__size").alias("byte_size_cv"),
    )
    return gaps(flows, groups, "start_time").join(sums, groups)


def rhythm(rows: DataFrame, groups: list[str], at: str = "ts", size: str = "length") -> DataFrame:
    """Per group: n, regularity of gaps between rows in order of time, of sizes, and the periodicity score of times."""
    sums = rows.withColumn("__size", F.col(size).cast("double")).groupBy(*groups).agg(F.count("*").alias("n"), _variation("__size").alias("byte_size_cv"))
    return sums.join(gaps(rows, groups, at), groups).join(periodicity(rows, groups, at=at), groups)


def by_packets(features: DataFrame, counted: str, prefix: str, names: tuple[str, ...] = ("iat_mean", "iat_variance", "iat_cv", "byte_size_cv", "periodicity_score")) -> DataFrame:
    """Takes each of `names` (with `prefix`) from the packets' column of that name where there are two packets or more, and drops the packets' columns."""
    better = {f"{prefix}{c}": F.when(F.col(counted) >= 2, F.col(f"__packets_{c}")).otherwise(F.col(f"{prefix}{c}")) for c in names}
    return features.withColumns(better).drop(counted, *(f"__packets_{c}" for c in names))


def packet_rhythm(packets: DataFrame, groups: list[str]) -> DataFrame:
    """`rhythm` of packets, with columns named as `by_packets` takes them (n as __packets)."""
    found = rhythm(packets, groups)
    return found.select(*groups, F.col("n").alias("__packets"), *(F.col(c).alias(f"__packets_{c}") for c in found.columns if c not in (*groups, "n")))


def periodicity(flows: DataFrame, groups: list[str], bins: int = 256, at: str = "start_time") -> DataFrame:
    """The largest share of one frequency in the spectrum of times, binned over the group's span (constant part aside).

    Counts are summed per group and bin before they meet; a group is then one row of at most `bins` counts, and a batch of
    groups one matrix.
    """
    span = flows.groupBy(*groups).agg(F.min(at).alias("__t0"), F.max(at).alias("__t1"), F.count("*").alias("__n"))
    bin_ = F.least(F.floor((F.col(at) - F.col("__t0")) / ((F.col("__t1") - F.col("__t0")) / bins)), F.lit(bins - 1))
    fit = span.where((F.col("__n") >= 4) & (F.col("__t1") - F.col("__t0") >= net.SHORTEST))
    counts = flows.join(fit, groups).select(*groups, bin_.cast("long").alias("__bin")).groupBy(*groups, "__bin").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*groups).agg(F.collect_list(F.col("n") * 1024 + F.col("__bin")).alias("__counts"))  # at most `bins` of them

    @F.pandas_udf("double")
    def strongest(counts: pd.Series) -> pd.Series:
        at, packed = np.repeat(np.arange(len(counts)), counts.map(len)), np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
        signal = np.zeros((len(counts), bins))
        signal[at, packed % 1024] = packed // 1024
        power = np.abs(np.fft.rfft(signal)[:, 1:]) ** 2
        total = power.sum(axis=1)
        return pd.Series(np.where(total < 1e-12, 0.0, power.max(axis=1) / np.maximum(total, 1e-12)))

    score = packed.select(*groups, strongest("__counts").alias("periodicity_score"))
    return span.select(*groups).join(score, groups, "left").select(*groups, F.coalesce("periodicity_score", F.lit(0.0)).alias("periodicity_score"))


def dns(queries: DataFrame, groups: list[str], ngrams: tuple[ngram.Ngrams, ngram.Ngrams] | None = None) -> DataFrame:
    """Lexical and volume features of DNS questions; with models of letter pairs and triples also mean_ngram_score."""
    q = F.coalesce("qname", F.lit(""))
    label, named = net.label_of(q), q != ""
    rows = queries.withColumns({"__q": q, "__label": label, "__named": named})
    text = F.when(F.col("__named"), F.col("__label"))
    scored = ()
    if ngrams:
        for model, name in zip(ngrams, ("__bigram", "__trigram"), strict=True):
            rows = ngram.likelihood(rows, "__label", model, name)
        scored = (F.avg(F.when(F.col("__named"), ngram.combined(F.col("__bigram"), F.col("__trigram")))).alias("mean_ngram_score"),)
    base = rows.groupBy(*groups).agg(
        F.avg(F.when(F.col("__named"), net.entropy_of_text(F.col("__label")))).alias("mean_entropy"), F.avg(F.length(text)).alias("mean_label_length"), F.max(F.length(text)).alias("max_label_length"),
        F.avg(F.when(F.col("__named"), net.ratio_of(F.col("__label"), "0-9"))).alias("mean_digit_ratio"), F.avg(net.carries_data(F.col("qtype")).cast("int")).alias("txt_null_ratio"),
        F.when(F.count("*") >= 2, F.count("*") / F.greatest(F.max("ts") - F.min("ts"), F.lit(net.SHORTEST))).otherwise(0.0).alias("query_rate"), F.count_distinct("__q").alias("unique_qnames"), *scored,
    )
    subs = rows.select(*groups, net.apex_of(F.col("__q")).alias("__apex"), net.subdomain_of(F.col("__q")).alias("__sub")).where("__apex IS NOT NULL")
    subs = subs.distinct().groupBy(*groups, "__apex").agg(F.count("*").alias("n")).groupBy(*groups).agg(F.avg("n").alias("unique_subdomains_per_apex"))
    return base.join(subs, groups, "left").fillna(0.0, ["unique_subdomains_per_apex"])


def exfiltration(flows: DataFrame, window: int = 100, width: float = 3600.0, block: int = 10_000) -> DataFrame:
    """Per flow: ratios, the score of its outbound bytes against the source's last `window` flows, novelty of the destination.

    A source's flows are dealt to blocks, each with a copy of the `window` flows before it, so no source is ordered in one task.
    """
    order = ["start_time", "seq"]
    rows = ordered.with_halo(flows.withColumn(ordered.BLOCK, F.floor(F.col("start_time") / width)), ["src_ip"], order, window, block)
    earlier = Window.partitionBy("src_ip", ordered.BLOCK).orderBy(*order).rowsBetween(-window, -1)
    rows = rows.withColumns({"__m": F.avg("bytes_fwd").over(earlier), "__sd": F.stddev_pop("bytes_fwd").over(earlier), "__n": F.count("*").over(earlier)}).where("NOT __halo")
    first = flows.groupBy("src_ip", "dst_ip").agg(F.min(F.struct(*order)).alias("__at")).select("__at.seq", "src_ip", "dst_ip", F.lit(1).alias("__new"))
    rows = rows.join(first, ["seq", "src_ip", "dst_ip"], "left")
    flat = F.when(F.col("bytes_fwd") > F.col("__m"), F.lit(float("inf"))).otherwise(0.0)
    z = F.when(F.col("__n") < 2, 0.0).when(F.col("__sd") < 1e-9, flat).otherwise(F.try_divide(F.col("bytes_fwd") - F.col("__m"), F.col("__sd")))
    return rows.select(
        "seq", "src_ip", "dst_ip", net.safe_ratio(F.col("bytes_fwd").cast("double"), F.col("bytes_bwd").cast("double")).alias("outbound_inbound_ratio"), z.alias("outbound_volume_zscore"),
        net.safe_ratio(F.col("duration"), (F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double")).alias("duration_bytes_ratio"), net.off_hours(F.col("start_time")).alias("off_hours_flag"), F.coalesce("__new", F.lit(0)).alias("destination_novel"),
    )


def exfiltration_against(flows: DataFrame, keep: list[str], baseline: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Per flow, the features of `exfiltration` against a given baseline (src_ip, bytes_fwd) and given pairs (src_ip, dst_ip).

    Without a baseline the score is 0; a pair not given as seen is new, each time it comes.
    """
    rows = flows
    if baseline is not None:
        known = baseline.groupBy("src_ip").agg(F.avg("bytes_fwd").alias("__m"), F.stddev_pop("bytes_fwd").alias("__sd"), F.count("*").alias("__n"))
        rows = rows.join(known, "src_ip", "left")
    else:
        rows = rows.withColumns({"__m": F.lit(0.0), "__sd": F.lit(0.0), "__n": F.lit(0)})
    if seen is not None:
        rows = rows.join(seen.select("src_ip", "dst_ip").distinct().withColumn("__seen", F.lit(1)), ["src_ip", "dst_ip"], "left")
    else:
        rows = rows.withColumn("__seen", F.lit(None).cast("int"))
    flat = F.when(F.col("bytes_fwd") > F.col("__m"), F.lit(float("inf"))).otherwise(0.0)
    z = F.when(F.coalesce("__n", F.lit(0)) < 2, 0.0).when(F.col("__sd") < 1e-9, flat).otherwise(F.try_divide(F.col("bytes_fwd") - F.col("__m"), F.col("__sd")))
    return rows.select(
        *keep, net.safe_ratio(F.col("bytes_fwd").cast("double"), F.col("bytes_bwd").cast("double")).alias("outbound_inbound_ratio"), z.alias("outbound_volume_zscore"),
        net.safe_ratio(F.col("duration"), (F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double")).alias("duration_bytes_ratio"), net.off_hours(F.col("start_time")).alias("off_hours_flag"),
        F.col("__seen").isNull().cast("int").alias("destination_novel"),
    )


def first_packets(packets: DataFrame, groups: list[str], n: int = 10, lists: bool = False) -> DataFrame:
    """Mean and deviation of sizes and gaps of each group's first n packets by time; with lists also these n sizes and n - 1 gaps."""
    order = Window.partitionBy(*groups).orderBy("ts", "seq")
    rows = packets.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    rows = rows.withColumn("__gap", F.col("ts") - F.lag("ts").over(order))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    held = F.array_sort(F.collect_list(F.struct("__r", "length", "__gap")))
    more = [F.transform(held, lambda x: x["length"]).alias("pkt_sizes_first10"), F.slice(F.transform(held, lambda x: x["__gap"]), 2, n).alias("pkt_ipt_first10")]
    return rows.groupBy(*groups).agg(
        F.avg("length").alias("pkt_size_mean"), F.stddev_pop("length").alias("pkt_size_std"), zero(F.avg("__gap")).alias("pkt_ipt_mean"), zero(F.stddev_pop("__gap")).alias("pkt_ipt_std"),
        *(more if lists else []),
    )


def hellos(df: DataFrame, raw: str = "tls_raw", denylist: Mapping[str, str] = net.BAD_JA3) -> DataFrame:
    """Adds ja3_string, ja3_hash, sni, cipher_suite_count, extension_count and denylist_match of a handshake's first message.

    Texts are empty and counts 0 for what isn't such a message; the match is what the list says of a known fingerprint.
    """
    hello = df.withColumn("__h", frames.client_hello(F.col(raw)))
    h = lambda c: F.col(f"__h.{c}")
    whole = h("version").isNotNull()
    text = F.when(whole, net.ja3_text(h("version"), h("cipher_suites"), h("extensions"), h("elliptic_curves"), h("ec_point_formats"))).otherwise("")
    known = F.create_map(*(F.lit(x) for pair in denylist.items() for x in pair))
    count = lambda c: F.when(whole, F.size(h(c))).otherwise(0)
    out = hello.withColumns({"ja3_string": text, "sni": F.coalesce(h("sni"), F.lit("")), "cipher_suite_count": count("cipher_suites"), "extension_count": count("extensions")})
    out = out.withColumn("ja3_hash", F.when(F.col("ja3_string") != "", F.md5("ja3_string")).otherwise(""))
    return out.withColumn("denylist_match", F.coalesce(F.try_element_at(known, "ja3_hash"), F.lit(""))).drop("__h")


def encrypted(packets: DataFrame, groups: list[str], denylist: Mapping[str, str] = net.BAD_JA3, lists: bool = False) -> DataFrame:
    """Per group: features of its first packets, and of its first handshake message (packets have tls_raw, null for all others)."""
    first = packets.where("tls_raw IS NOT NULL").groupBy(*groups).agg(F.min_by("tls_raw", F.struct("ts", "seq")).alias("tls_raw"))
    return hellos(first_packets(packets, groups, lists=lists).join(first, groups, "left"), "tls_raw", denylist).drop("tls_raw")
