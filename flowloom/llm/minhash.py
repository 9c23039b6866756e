"""Near-duplicate texts by ProbMinHash signatures, banding and verification.

A text is the set of its shingles of five words, each of weight 1 however often it occurs, for candidates as for
verification. Each shingle is a Poisson process whose rate is its weight, drawn from its hash alone; every arrival
falls on one of the signature's components, which keeps the shingle that arrives first. A shingle is left as soon as
its next arrival comes later than the latest of all components, so most give one or two arrivals. Two signatures agree
in a component with the probability Jaccard similarity of the weighted sets, which for weights of 1 is the Jaccard similarity.

Texts that agree in all components of a band share a bucket and are candidates. Candidates are verified on the texts
themselves: Jaccard similarity of shingle sets of at least `threshold`. Classes are connected components of verified links.

Rounds link texts to leaders. In every round each bucket that holds several classes draws one of its texts as leader, and
each text is compared with one leader only, the one that leads most of its buckets: a round makes no more pairs than there
are texts. Classes that meet are merged, and buckets left with one class drop out. Rounds go on while they pay, that is while
at least one pair in PAYS is a link.

Texts in buckets that still hold several classes are then compared by prefixes. All shingles stand in one fixed
order, rare ones first, by counters over all these texts (each shingle has two, of which the smaller counts; one that shares both with others only stands later). Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, and at
their first shared shingle what is left of both sets still suffices for t. Pairs that meet so, and lie in different
classes, are verified; no other pair can be alike. So any two alike texts that share a bucket end in one class, however many
rounds there were. A shingle whose counter stands at one is in no other text and is left out. Hot shingles are salted; the work on one
grows with the square of its texts, but pairs that can't reach t, or that have met at the shingle just ahead in both texts, leave the join.

Before texts are compared, their parities are: each of PARITY bits tells whether the set has an odd number of shingles there. Bits that differ
are at most as many as the shingles that only one set has, so pairs with too many of them are not alike. Texts meet at hot shingles under this condition
too, else all texts of a group that falls just short of t would be paired with each other.

Most keys and texts share nothing. Those that may matter are found by a filter of fixed size, so that the others are never
exchanged; it lets some more pass, which drop out by themselves where buckets and pairs are formed.

Edge cases: null text counts as empty. Texts without words are copies of each other only if identical. A text of
fewer than five words is one shingle. Equal texts are always in one class, through one representative, and are
never paired with each other. Repeated rows belong to one class and are all marked as kept if one is; `keep_one` returns one of
them. One identifier on several texts: each text is its own node, and is kept or dropped by itself. A row without
identifier stays only where no equal text has one. An empty table gives an empty table. Other columns, whatever their names, are ignored or returned untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.exact_dedup import duplicates, short, without
from flowloom.llm.scratch import materialize

WORDS, BANDS, ROWS = 5, 26, 5
#: Rounds with leaders go on while one pair in so many is a link; the stop changes the work, not the result.
PAYS = 10
#: Counters of shingles (two rows of them) that give the order of prefixes, in PARTS parts, and the texts of a hot shingle that one salt takes.
COUNTERS, PARTS, SALTED = 1 << 21, 16, 512
#: Bits of a set's parities, and how many texts may share a shingle before these are looked at where they meet.
PARITY, MANY = 512, 32
#: Bitmaps of a filter, and bits of each (Spark's own size).
BITMAPS, BITS = 1024, 32768
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all runs of `words` words, with repeats, in order; one for a shorter text, none without words."""
    split = text.split()
    if not split:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(" ".join(split).encode(), np.uint8)
    up, down = _power_tables(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)])])
    gaps = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    k = max(1, len(starts) - words + 1)
    s, e = starts[:k], ends[-k:]
    return _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def signature(hashes: np.ndarray, components: int = BANDS * ROWS) -> np.ndarray:
    """For each component the shingle whose process arrives there first; repeats add to a shingle's rate."""
    h, counts = np.unique(hashes, return_counts=True)
    rate = counts.astype(np.float64)
    first, who = np.full(components, np.inf), np.zeros(components, np.uint64)
    time, step = np.zeros(len(h)), 0
    at_once = max(1, int(1.2 * components * np.log(components) / len(h)))
    while len(h):
        steps = np.arange(step, step + at_once, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        z = _mixed(h[:, None] + steps[None, :] * _BASE)
        gap = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate[:, None]
        arrivals = time[:, None] + np.cumsum(gap, axis=1)
        place = (_mixed(z) % np.uint64(components)).astype(np.int64)
        np.minimum.at(first, place.ravel(), arrivals.ravel())
        won = arrivals == first[place]
        who[place[won]] = np.broadcast_to(h[:, None], place.shape)[won]
        time = arrivals[:, -1]
        left = time < first.max()  # later arrivals of the others cannot matter
        h, rate, time, step = h[left], rate[left], time[left], step + at_once
        at_once = 1 if np.isfinite(first.max()) else at_once
    return who


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band, of a set of shingles; none for the empty set."""
    if not len(hashes):
        return []
    key = np.arange(BANDS, dtype=np.uint64) * _BASE
    for column in signature(hashes).reshape(BANDS, ROWS).T:
        key = _mixed(key + column)
    return key.view(np.int64).tolist()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct shingles; 0 for empty ones, which only equal texts make alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def jaccard(a: str, b: str) -> float:
    """Jaccard similarity of two texts' sets of shingles; 0 for texts without words."""
    return similarity(np.unique(shingles(a)), np.unique(shingles(b)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of PARITY shares of all shingles whether an odd number of these distinct ones is in it, packed into 64-bit integers."""
    place = (_mixed(hashes) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def _facts(texts: DataFrame) -> DataFrame:
    """Per row (__node, __text): __node, its number of distinct shingles and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = [np.unique(shingles(t.as_py())) for t in part.column("__text")]
                columns = [part.column("__node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["__node", "__n", "__bits"])

    kind = texts.schema["__node"].dataType.simpleString()
    return texts.select("__node", "__text").mapInArrow(run, f"__node {kind}, __n bigint, __bits array<bigint>")


def _near_enough(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, threshold: float) -> Column:
    """Whether sets of these sizes and parities may have that similarity; null where parities are missing."""
    differ = reduce(Column.__add__, (F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k)))) for k in range(PARITY // 64)))
    return differ <= (1 - threshold) / (1 + threshold) * (n_a + n_b) + 1e-6


def _sketches(docs: DataFrame) -> DataFrame:
    """Per row (__id, __text): __id and its band keys. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = [np.unique(shingles(t.as_py())) for t in part.column("__text")]
                columns = [part.column("__id"), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", "__keys"])

    return docs.mapInArrow(run, f"__id {docs.schema['__id'].dataType.simpleString()}, __keys array<bigint>")


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITMAPS * BITS))


def _filtered(rows: DataFrame, value: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose value is in the one column of `wanted`, and few others, without an exchange of rows.

    What is broadcast has at most BITMAPS * BITS bits, whatever the table; beyond some ten million values more and more others pass.
    """
    slot = _slot(F.col(wanted.columns[0]))
    marks = wanted.select(F.floor(slot / BITS).cast("int").alias("__bitmap"), (slot % BITS).alias("__bit")).groupBy("__bitmap")
    marks = materialize(marks.agg(F.bitmap_construct_agg("__bit").alias("__marks")), "near-filter")
    bit = _slot(value) % BITS
    byte = F.conv(F.hex(F.substring("__marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__bitmap", F.floor(_slot(value) / BITS).cast("int")).join(F.broadcast(marks), "__bitmap")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, lead) whose texts are at least that similar.

    Only texts of these pairs move, those of the other nodes once, to their leads, of which there are few; a hot lead's rows are split by adaptive execution.
    """
    members = pairs.withColumn("__member", F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    left = _filtered(texts, F.col("__node"), pairs.select("lead")).select(F.col("__node").alias("lead"), F.col("__text").alias("__ta"))
    right = _filtered(texts, F.col("__node"), members.select("__member")).select(F.col("__node").alias("__member"), F.col("__text").alias("__tb"))
    kind = texts.schema["__node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[str | None, np.ndarray]] = {"__ta": (None, np.empty(0)), "__tb": (None, np.empty(0))}

        def distinct(side: str, text: str) -> np.ndarray:
            if last[side][0] != text:  # rows of one leader mostly follow each other
                last[side] = (text, np.unique(shingles(text)))
            return last[side][1]

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                alike = [
                    similarity(distinct("__ta", x.as_py()), distinct("__tb", y.as_py())) >= threshold
                    for x, y in zip(part.column("__ta"), part.column("__tb"), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return members.join(right, "__member").join(left, "lead").select("a", "b", "__ta", "__tb").mapInArrow(run, f"a {kind}, b {kind}")


def _counters(docs: DataFrame) -> np.ndarray:
    """How often shingles of each counter's share occur in all texts, up to 65535: two rows of COUNTERS numbers, however many texts there are.

    Tasks give their counters in PARTS packed parts, which are added up part by part.
    """
    width, most = 2 * COUNTERS // PARTS, (1 << 16) - 1

    def packed(part: int, counts: np.ndarray) -> tuple[int, bytes]:
        return part, zlib.compress(np.minimum(counts, most).astype("<u2").tobytes(), 1)

    def unpacked(content: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(content), "<u2").astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * COUNTERS, np.int64)
        for b in batches:
            for t in b.column("__text"):
                np.add.at(counts, counters(np.unique(shingles(t.as_py()))).ravel(), 1)
        if counts.any():
            parts = [packed(k, counts[k * width : (k + 1) * width]) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*parts, strict=True)], names=["__part", "__counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("__part").to_pylist(), b.column("__counts"), strict=True):
                totals[k] = totals.get(k, 0) + unpacked(x.as_py())
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*(packed(k, v) for k, v in totals.items()), strict=True)], names=["__part", "__counts"])

    parts = docs.select("__text").mapInArrow(count, "__part bigint, __counts binary")
    sums = materialize(parts.repartition(PARTS, "__part").mapInArrow(add, "__part bigint, __counts binary"), "near-counters")
    order = np.zeros(2 * COUNTERS, np.uint16)
    for r in sums.collect():  # 2 * COUNTERS numbers of 2 bytes at most
        order[r["__part"] * width : (r["__part"] + 1) * width] = unpacked(r["__counts"])
    return order


def counters(hashes: np.ndarray) -> np.ndarray:
    """The two counters of each shingle, one of either row."""
    return np.stack([hashes % np.uint64(COUNTERS), (hashes >> np.uint64(32)) % np.uint64(COUNTERS) + np.uint64(COUNTERS)]).astype(np.int64)


def prefix(hashes: np.ndarray, threshold: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(threshold n) + 1 of n distinct shingles; those in `known` (sorted) stand last, by `rank`."""
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(known[at] == hashes, rank[at] + 1, 0)))]
    n = len(hashes)
    return hashes[: n - max(1, int(np.ceil(threshold * n - 1e-6))) + 1 if n else 0]


def _prefix_pairs(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of members (__node, __class) of different classes that may be alike: a superset of those that are."""
    texts = _filtered(texts, F.col("__node"), members.select("__node"))  # what passes beside members only counts
    counts = texts.sparkSession.sparkContext.broadcast(_counters(texts))
    kind = texts.schema["__node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                sets, shared = [np.unique(shingles(t.as_py())) for t in b.column("__text").slice(k, 500)], []
                for x in sets:
                    keys = prefix(x, threshold, x, counts.value[counters(x)].min(axis=0).astype(np.int64))
                    many = counts.value[counters(keys)].min(axis=0).astype(np.int32)
                    at = np.flatnonzero(many > 1)  # the others are in no other text
                    shared.append((keys[at].view(np.int64), at.astype(np.int32), many[at]))
                found = [[b.column("__node").slice(k, 500), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))]]
                found += [[pa.array(list(xs), pa.list_(t))] for xs, t in zip(zip(*shared, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(sum(found, []), names=["__node", "__n", "__bits", "__keys", "__places", "__texts"])

    rows = texts.select("__node", "__text").mapInArrow(run, f"__node {kind}, __n bigint, __bits array<bigint>, __keys array<bigint>, __places array<int>, __texts array<int>")
    rows = rows.join(members, "__node").select("*", F.posexplode("__keys").alias("__j", "__key"))
    rows = rows.withColumns({"__i": F.get("__places", F.col("__j")), "__m": F.get("__texts", F.col("__j"))})
    # With the shingle ahead, if any other text may have it: where two texts have the same one they have met at it, or before.
    ahead = F.when(F.get("__places", F.col("__j") - 1) == F.col("__i") - 1, F.get("__keys", F.col("__j") - 1)).alias("__ahead")
    rows = rows.select("__node", "__class", "__n", "__i", "__key", ahead, F.when(F.col("__m") > MANY, F.col("__bits")).alias("__bits"), "__m")
    rows = materialize(rows, "near-prefixes")
    of = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    (a_n, b_n), (a_i, b_i), (a_ahead, b_ahead) = of("__n"), of("__i"), of("__ahead")
    enough = F.least(a_n - a_i, b_n - b_i) >= threshold / (1 + threshold) * (a_n + b_n) - 1e-6
    new = F.coalesce(a_ahead != b_ahead, F.lit(True))
    near = F.coalesce(_near_enough(a_n, b_n, *of("__bits"), threshold), F.lit(True))
    meet = (F.col("a.__node") < F.col("b.__node")) & (F.col("a.__class") != F.col("b.__class")) & enough & new & near

    def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        same = reduce(Column.__and__, (x == y for x, y in map(of, keys)))
        return left.alias("a").join(right.alias("b"), same & meet).select(F.col("a.__node").alias("a"), F.col("b.__node").alias("b"))

    # Counters never fall short, so only what they call hot has to be looked at by key; the rest goes through one exchange, which serves both sides.
    cold, rows = rows.where(F.col("__m") <= SALTED).drop("__m"), rows.where(F.col("__m") > SALTED).drop("__m")
    keys = rows.groupBy("__key").agg(F.min("__class").alias("__lo"), F.max("__class").alias("__hi"), F.ceil(F.count("*") / SALTED).cast("int").alias("__salts"))
    keys = materialize(keys.where("__lo < __hi").select("__key", "__salts"), "near-prefix-keys")
    rows = materialize(rows.join(keys, "__key"), "near-postings")
    # Alike sets lie in one band of lengths or in neighbouring ones; texts of a hot shingle meet by band.
    band = F.when(F.col("__salts") > 1, F.floor(F.log("__n") / float(np.log(1 / threshold)))).otherwise(0).cast("int")
    bands = F.when(F.col("__salts") > 1, F.array(band - 1, band, band + 1)).otherwise(F.array(F.lit(0)))
    left = rows.withColumns({"__salt": F.pmod(F.xxhash64("__node"), "__salts").cast("int"), "__band": band})
    right = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).withColumn("__band", F.explode(bands))
    pairs = met(cold, cold, "__key").union(met(left, right, "__key", "__salt", "__band"))
    return pairs.distinct().withColumn("lead", F.col("a"))


def components(edges: DataFrame) -> DataFrame:
    """Per identifier in edges (a, b): (id, label), label being the smallest identifier connected to it.

    Rounds of taking the smallest label among neighbours and then the label's own label, until none changes;
    each round is a written table, and only a count goes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "component-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label"))
    labels = materialize(labels, "component-labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("__near"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("__near").alias("__near"))
        closer = labels.join(near, "id").select("id", F.col("label").alias("__old"), F.least("label", "__near").alias("label"))
        closer = materialize(closer, "component-labels")
        own = closer.select(F.col("id").alias("label"), F.col("label").alias("__up"))
        jumped = materialize(closer.join(own, "label").select("id", "__old", F.least("label", "__up").alias("label")), "component-labels")
        labels = jumped.select("id", "label")
        if jumped.where("label < __old").isEmpty():
            return labels


def _node(ident: Column, sha: Column) -> Column:
    """What stands for a text: its identifier (of equal texts, the smallest) and 60 bits of its digest."""
    return F.struct(ident.alias("id"), short(sha).alias("x"))


def _leaders(named: DataFrame, k: int) -> DataFrame:
    """A leader (node, class) for each bucket of (__node, __key, __class) that holds several classes."""
    drawn = F.min_by(F.struct(F.col("__node").alias("node"), F.col("__class").alias("class")), F.xxhash64(F.lit(k), "__node"))
    found = named.groupBy("__key").agg(F.min("__class").alias("__lo"), F.max("__class").alias("__hi"), drawn.alias("__leader"))
    return materialize(found.where("__lo < __hi").select("__key", "__leader"), "near-leaders")


def _plausible(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets' sizes and parities allow that similarity."""
    of = lambda side: facts.select(F.col("__node").alias(side), F.col("__n").alias(f"__n_{side}"), F.col("__bits").alias(f"__bits_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    like = F.least("__n_a", "__n_b") >= threshold * F.greatest("__n_a", "__n_b") - 1e-6
    return materialize(both.where(like & _near_enough(*map(F.col, ("__n_a", "__n_b", "__bits_a", "__bits_b")), threshold)).select("a", "b", "lead"), "near-like")


def _links(keys: DataFrame, chosen: DataFrame, repeated: bool, texts_of, threshold: float) -> DataFrame | None:
    """Links (a, b) between those nodes of (__node, __key) that are chosen: enough to connect any two alike ones that share a key."""
    # Buckets of one text, by far the most, are found from their keys alone; those that pass the filters never get a leader.
    keys = _filtered(keys, F.col("__node"), chosen).select("__node", F.explode("__keys").alias("__key"))
    shared = keys.groupBy("__key").agg(F.count("*").alias("__m")).where("__m > 1").select("__key")
    keys = _filtered(keys, F.col("__key"), materialize(shared, "near-shared")).join(chosen, "__node", "left_semi")
    keys = materialize(keys.distinct() if repeated else keys, "near-buckets")
    named, tried, links, texts = keys.select("__node", "__key", F.col("__node").alias("__class")), [], [], None
    for k in count():
        open_ = materialize(named.join(_leaders(named, k), "__key"), "near-open")
        if texts is None:
            nodes = materialize(open_.select("__node").distinct(), "near-nodes")
            texts = materialize(texts_of(nodes), "near-texts")
            facts = materialize(_facts(texts), "near-facts")
        met = open_.where("__leader.class != __class").groupBy("__node", F.col("__leader.node").alias("__other")).agg(F.count("*").alias("__n"))
        one = met.groupBy("__node").agg(F.max_by("__other", F.struct("__n", "__other")).alias("__other"))
        pairs = one.select(F.least("__node", "__other").alias("a"), F.greatest("__node", "__other").alias("b"), F.col("__other").alias("lead"))
        pairs = pairs.groupBy("a", "b").agg(F.min("lead").alias("lead"))
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        tried.append(materialize(pairs, "near-pairs"))
        found = materialize(_verified(_plausible(tried[-1], facts, threshold), texts, threshold), "near-links")
        n_found, n_tried = found.count(), tried[-1].count()
        named = open_.select("__node", "__key", "__class")
        if n_found:
            links.append(found)
            # Only classes of buckets that are still open are looked up again.
            classes = components(reduce(DataFrame.union, links))
            named = named.drop("__class").join(classes, F.col("__node") == F.col("id"), "left").select("__node", "__key", F.coalesce("label", "__node").alias("__class"))
            named = materialize(named, "near-members")
        if n_found * PAYS < n_tried or not n_tried:
            break

    rest = materialize(named.join(_leaders(named, k + 1), "__key").select("__node", "__class").distinct(), "near-mixed")
    if not rest.isEmpty():
        pairs = _prefix_pairs(rest, texts, threshold).join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        links.append(materialize(_verified(_plausible(materialize(pairs, "near-pairs"), facts, threshold), texts, threshold), "near-links"))
    return reduce(DataFrame.union, links) if links else None


def _classes(df: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Per row: __id, __sha (digest of its text), __label (the node of its class's smallest text); and the verified links (a, b) between nodes."""
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    copies = duplicates(docs, "__id", "__text", "smallest")
    copies = materialize(copies.select("__id", F.col("text_sha256").alias("__sha"), _node(F.col("keep_id"), F.col("text_sha256")).alias("__node"), "kept"), "near-copies")
    nodes = docs.select(_node(F.col("__id"), F.sha2("__text", 256)).alias("__id"), "__text")
    sketches = materialize(_sketches(nodes), "near-sketches").withColumnRenamed("__id", "__node")
    nodes = nodes.withColumnRenamed("__id", "__node")
    kept = copies.where("kept").groupBy("__node").agg(F.count("*").alias("__m"))
    chosen = materialize(kept, "near-distinct")
    repeated = not chosen.where("__m > 1").isEmpty()  # rows of one identifier and text

    def texts_of(some: DataFrame) -> DataFrame:
        found = _filtered(nodes, F.col("__node"), some)
        return found.dropDuplicates(["__node"]) if repeated else found

    links = _links(sketches, chosen.select("__node"), repeated, texts_of, threshold)
    if links is None:
        return copies.select("__id", "__sha", F.col("__node").alias("__label")), None
    labels = components(links).select(F.col("id").alias("__node"), "label")
    return copies.join(labels, "__node", "left").select("__id", "__sha", F.coalesce("label", "__node").alias("__label")), links


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the smallest identifier of its class), kept (whether it is that row), class_size (its class's rows), n_links (pairs of different texts of its class that were found alike).

    Links are enough to connect a class; copies of one text need none.
    """
    rows, links = _classes(df, threshold, id_col, text_col)
    rows = materialize(rows, "near-classes")
    sizes = rows.groupBy("__label").agg(F.count("*").alias("__size")).where("__size > 1")
    if links is None:
        classes = sizes.withColumn("__links", F.lit(0).cast("long"))
    else:
        of_link = rows.select(_node(F.col("__id"), F.col("__sha")).alias("a"), "__label").distinct()
        counts = links.distinct().join(of_link, "a").groupBy("__label").agg(F.count("*").alias("__links"))
        classes = sizes.join(counts, "__label", "left")
    classes = materialize(classes, "near-class-sizes").withColumnRenamed("__label", "__class")
    kept = _node(F.col("__id"), F.col("__sha")) == F.col("__label")
    return rows.join(classes, F.col("__label") == F.col("__class"), "left").select(
        F.col("__id").alias(id_col), F.col("__label.id").alias("class_id"), kept.alias("kept"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those of a class beside its smallest identifier; of repeated rows, one."""
    rows = _classes(df, threshold, id_col, text_col)[0].select("__id", "__sha", (_node(F.col("__id"), F.col("__sha")) == F.col("__label")).alias("kept"))
    return without(df, materialize(rows, "near-kept"), id_col, text_col)
