"""Columns as people read them: rates, times, severities and protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def rate_mbps(text: Column) -> Column:
    """'10', '10mbps', '2.5 Mbit/s' as a number of Mbit/s; null for anything else."""
    number = F.regexp_replace(F.lower(F.trim(text)), r"(mbps|mb/s|mbit/s|mbit)$", "")
    return F.trim(number).try_cast("double")


def time_text(ts: Column) -> Column:
    """Seconds since 1970 as '2023-11-14 22:13:20 UTC'; a dash for 0 and null."""
    text = F.concat(F.date_format(F.timestamp_micros(F.floor(ts * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return F.when(ts != 0, text).otherwise(NOTHING)


def age_text(ts: Column, now: Column) -> Column:
    """How long before `now`, in whole seconds, minutes or hours."""
    age = F.floor(now - ts).cast("long")
    whole = lambda n, unit: F.concat(F.floor(age / n).cast("string"), F.lit(f"{unit} ago"))
    text = F.when(age < 5, "just now").when(age < 60, whole(1, "s")).when(age < 3600, whole(60, "m")).otherwise(whole(3600, "h"))
    return F.when(ts != 0, text).otherwise(NOTHING)


def severity_text(severity: Column) -> Column:
    """Upper case; LOW for an empty or missing one."""
    return F.upper(F.when(severity != "", severity).otherwise("LOW"))


def severity_style(severity: Column) -> Column:
    text = F.lower(severity_text(severity))
    return F.concat(F.lit("chip-"), F.when(text.isin("critical", "high", "medium"), text).otherwise("low"))


def protocol_text(protocol: Column) -> Column:
    return F.when(protocol == 6, "TCP (6)").when(protocol == 17, "UDP (17)").otherwise(protocol.cast("string"))
