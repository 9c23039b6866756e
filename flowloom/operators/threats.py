"""From flows, packets and questions to candidates of all six classes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import isolation, net, ngram, trees
from flowloom.operators import alerts as al
from flowloom.operators import detectors as det
from flowloom.operators import features as feat
from flowloom.operators import models

PAIR = ["src_ip", "dst_ip"]


def scores(flows: DataFrame, packets: DataFrame, questions: DataFrame, ngrams: tuple[ngram.Ngrams, ngram.Ngrams], denylist: Mapping[str, str] = net.BAD_JA3) -> DataFrame:
    """Per source and destination that have a flow: ts and flow_id of the newest, and a confidence for each class.

    Floods are judged by destination, beacons, scans and names by source, handshakes and volumes by pair; each joins the pairs once, and
    the tables that join are a row per host or pair. flows: of operators.flows.build; packets have tls_raw; questions: qname, qtype, src_ip, ts.
    """
    pairs = flows.groupBy(*PAIR).agg(F.max("end_time").alias("ts"), F.max_by("flow_id", F.struct("end_time", "first_seq")).alias("flow_id"))
    flows = flows.withColumn("seq", F.col("first_seq"))
    floods = feat.ddos(flows, ["dst_ip"]).join(feat.handshakes(packets, ["dst_ip"]), "dst_ip", "left")
    floods = det.fused_ddos(isolation.with_decision(floods, models.traffic_forest()), F.col("decision"))
    contacts = feat.beacon(flows, ["src_ip"]).join(feat.periodicity(flows, ["src_ip"]), "src_ip")
    contacts = det.beacon(trees.with_result(contacts, models.beacon_forest(), "probability"), F.col("probability"))
    names = det.name_vector(feat.dns(questions, ["src_ip"], ngrams))
    names = det.dns(trees.with_result(names, models.name_forest(), "probability"), F.col("probability"))
    hellos = det.handshake(isolation.with_decision(feat.encrypted(packets, PAIR, denylist), models.handshake_forest()), F.col("decision"))
    volumes = det.exfiltration(feat.exfiltration(flows)).groupBy(*PAIR).agg(F.max("confidence").alias("confidence"))
    scans = det.recon(feat.recon(flows, ["src_ip"]))
    judged = (("ddos", floods, ["dst_ip"]), ("c2_beacon", contacts, ["src_ip"]), ("dga_dns", names, ["src_ip"]), ("encrypted_malware", hellos, PAIR), ("recon_scan", scans, ["src_ip"]), ("exfiltration", volumes, PAIR))
    return reduce(lambda a, j: a.join(j[1].select(*j[2], F.col("confidence").alias(j[0])), j[2], "left"), judged, pairs).fillna(0.0, [j[0] for j in judged])


def alerts(scored: DataFrame, window: float = 30.0) -> DataFrame:
    """Candidates of all classes at or above the floor, repeats suppressed, with severity."""
    found = al.fan_out(scored, ["src_ip", "dst_ip", "ts", "flow_id"]).drop("rank")
    found = found.withColumn("alert_id", F.concat_ws("|", "src_ip", "dst_ip", "threat_class"))
    return al.with_severity(al.deduplicate(found, window))
