"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (DataFrame functions only).

Kinds: email, ip, card and phone (base kinds), and iban. A pattern's matches are marked in the text by a control
character; cutting at the marks gives matches and what stands between them, and lengths give positions. Then a
validator has its say: parts of at most 255 (ip), Luhn (card), the number of digits (card, phone), mod 97 (iban).
A match that fails is dropped and nothing inside it is tried again; only an iban, whose length follows from its
country's code, is tried at every place where one may start, and the leftmost valid ones that don't overlap stay. A confirmed span's score is its kind's prior,
more if one of the kind's context words stands within CONTEXT characters before it (back to the span before).

Patterns are possessive and may only start where a run of their first characters starts (or a match has just
ended), which gives the same leftmost matches as plain ones in time linear in the text.

Positions count code points from 0, ends are exclusive. Edge cases: null text counts as empty; no span gives an
empty string and counts of 0. An empty table gives an empty table. Repeated rows each give a row. `report` ignores other columns;
`find` raises ValueError if the column for the spans is there already. Overlapping spans of different kinds all stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
#: Stands around matches; a text's own get another control character in their place, which no pattern takes either.
MARK, STAND_IN = "\x01", "\x02"

#: Countries by the number of characters of their account numbers; other codes have none.
_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "AO|CV|GW|LY|MZ|PT|ST",
    26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD", 28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _COUNTRIES.items()) + ")(?![A-Za-z0-9])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind: (pattern, prior score, context words), in the order in which kinds are listed.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|address"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login"),
    "card": (r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++", 0.7, "card|visa|credit|payment|master"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.5, "phone|call|tel|mobile|fax"),
    "iban": (f"(?<![A-Z0-9]){_IBAN}", 0.8, "iban|bank|account|transfer|konto"),
}
BASE = ("email", "ip", "card", "phone")


#: No valid span of a kind has fewer characters.
_SHORTEST = {"email": 5, "ip": 7, "card": 12, "phone": 10, "iban": 15}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 when its first four characters stand last and A is 10, B 11, ..."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return rest == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.regexp_replace(match, " ", "")
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def _ibans(text: Column) -> Column:
    """What `spans_of` finds for iban before scores: marks stand where one may start, and each reads on over the next marks."""
    pieces = F.split(F.regexp_replace(text, f"(?={KINDS['iban'][0]})", MARK), MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.lit("").alias("last"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["match"])
        takes = (x["i"] > 0) & (acc["at"] >= acc["free"]) & valid("iban", x["match"])
        before = F.right(acc["last"], F.least(F.lit(CONTEXT), acc["at"] - acc["free"]))
        here = F.struct(acc["at"].alias("start"), stop.alias("end"), x["match"].alias("match"), before.alias("before"))
        return F.struct(
            (acc["at"] + F.length(x["s"])).alias("at"), F.when(takes, stop).otherwise(acc["free"]).alias("free"),
            F.right(F.concat(acc["last"], x["s"]), F.lit(CONTEXT)).alias("last"), F.when(takes, F.array_append(acc["found"], here)).otherwise(acc["found"]).alias("found"),
        )

    # Starts are five characters or more apart and a number with spaces has at most 65, so 15 pieces hold it and what follows.
    ahead = lambda ps, i: F.left(F.array_join(F.slice(ps, i + 1, 15), ""), F.lit(80))
    each = lambda ps: F.transform(ps, lambda s, i: F.struct(s.alias("s"), i.alias("i"), F.regexp_extract(ahead(ps, i), f"^{_IBAN}", 0).alias("match")))
    return F.element_at(F.transform(F.array(pieces), lambda ps: F.aggregate(each(ps), begin, step, lambda acc: acc["found"])), 1)


def spans_of(kind: str, text: Column) -> Column:
    """Array of confirmed spans of a kind: struct(start, rank, kind, end, score)."""
    pattern, prior, words = KINDS[kind]
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    # One pass over the pieces (0 between, 1 match, 2 between, ...) with the position so far.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>").alias("found"), F.lit("").alias("last"))

    def step(acc: Column, piece: Column) -> Column:
        here = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(piece["s"])).alias("end"), piece["s"].alias("match"), acc["last"].alias("before"))
        return F.struct(
            (acc["at"] + F.length(piece["s"])).alias("at"),
            F.when((piece["i"] % 2 == 1) & (F.length(piece["s"]) >= _SHORTEST[kind]), F.array_append(acc["found"], here)).otherwise(acc["found"]).alias("found"),
            F.right(piece["s"], F.lit(CONTEXT)).alias("last"),
        )

    numbered = F.transform(pieces, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    found = _ibans(text) if kind == "iban" else F.aggregate(numbered, start, step, lambda acc: acc["found"])
    rank = list(KINDS).index(kind)
    score = lambda x: F.when(F.lower(x["before"]).rlike(words), F.lit(prior) + (1 - F.lit(prior)) / 2).otherwise(F.lit(prior))
    kept = found if kind == "iban" else F.filter(found, lambda x: valid(kind, x["match"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), score(x).alias("score")))


#: What a text must hold for a kind to be looked for at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def find(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """df with one more column: array of struct(start, rank, kind, end, score), by start and then by kind as listed. No shuffle."""
    if spans_col in df.columns:
        raise ValueError(f"there is a column {spans_col} already")
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, STAND_IN)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    each = [F.when(F.contains(text, F.lit(_NEEDS[k])) if k in _NEEDS else text.rlike("[0-9]"), spans_of(k, text)).otherwise(none) for k in kinds]
    return df.withColumn(spans_col, F.array_sort(reduce(F.concat, each)))


def listed(spans: Column, with_score: bool = False) -> Column:
    """kind:start:end of spans, comma-joined."""
    item = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"], *([F.format_number(x["score"], 2)] if with_score else []))
    return F.array_join(F.transform(spans, item), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_<kind> of the base kinds, base_sha256 over their spans, spans (of all kinds), scored (with scores)."""
    rows = find(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", "__spans").select("__id", "__spans")
    base = F.filter("__spans", lambda x: x["kind"].isin(*BASE))
    counts = [_count("__spans", k).alias(f"n_{k}") for k in BASE]
    return rows.select(F.col("__id").alias(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"), listed(F.col("__spans"), True).alias("scored"))
