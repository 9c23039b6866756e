"""Token ids in compact files: context mixing and range coding in independent, checksummed blocks.

Every BLOCK ids form a block whose model starts anew. For each id, the two ids before it (order 2) and the one
before it (order 1) each predict one id, and order 0 gives magnitudes shares by how often they came; ids of one magnitude share alike.
The orders' shares are added: an order weighs by the odds at which its predictions of that confidence came true
in this block. The mixed distribution drives a range coder with 64-bit state and 32-bit output; carries go into words already put out.

Ids are the tokenizers library's, which encodes distinct words and pieces between spaces, not their repeats (`Library`).

Coder and model are sequential within a block, so all blocks of a stripe (some STRIPE ids) advance in step, each
a lane of numpy arrays. A stripe is a row of a Parquet table: document ids, their numbers of ids, and the blocks.
Documents never span stripes; stripes ascend by (part, stripe), documents by identifier.

Block layout (little-endian): "CMR2", number of ids, CRC-32 of the ids (32-bit each), CRC-32 of the payload, payload.

Edge cases: a null text counts as empty and holds the end id only. Repeated identifiers follow each other by a
hash of their texts. A null identifier comes first. A damaged block raises ValueError. An empty table gives an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm import vocab as V

BLOCK, STRIPE = 2048, 5_000_000
MAGIC = b"CMR2"
#: Bytes of texts whose ids are looked up together, new words in one text; pieces in each of a worker's two tables, and their characters.
TOGETHER, PACK, REMEMBERED, KNOWN_CHARS = 4_000_000, 50, 450_000, 8_000_000
_HEAD = struct.Struct("<4sIII")
_SLOTS = 10  # bits of the slot number in each order's table of predictions
_LEVELS = 8  # confidences
_CLASSES = 18  # magnitudes of ids: 0, 1, 2-3, 4-7, ...
_REFRESH = 16  # ids between updates of order 0's shares
_WHOLE = 512  # order 0's shares together; with both orders' largest it stays below 2**16
_FIRST = np.array([0, *(1 << c for c in range(_CLASSES - 1))])
_BITS = np.array([0, *range(_CLASSES - 1)])
_MAGNITUDE = np.repeat(np.arange(_CLASSES, dtype=np.int8), [1, *(1 << c for c in range(_CLASSES - 1))])
#: An order's share by probability in 4096ths: its odds of order 0's shares.
_SHARE = np.array([max(_WHOLE * min(256 * p // (4096 - p), 256 * 63) >> 8, 1) for p in range(4096)])


class _Lanes:
    """The models of many blocks, advanced together; the same steps while coding and decoding.

    Arrays over both orders hold order 1 of all lanes, then order 2 of all lanes.
    """

    def __init__(self, n: int):
        self.n = n
        self.tables = np.full(2 * n << _SLOTS, -_LEVELS, np.int32)  # id * _LEVELS + confidence; without an entry: -1, 0
        self.belief = np.tile(np.array([0, 1200, 2000, 2600, 3000, 3300, 3500, 3600], np.int32), 2 * n)
        self.counts, self.upto = np.ones((_CLASSES, n), np.int32), np.zeros((_CLASSES + 1, n), np.int32)
        both = np.arange(2 * n)
        self.lane, self.slot, self.place = both[:n], both << _SLOTS, both * _LEVELS
        self.mixed, self.earlier, self.seen = np.zeros(2 * n, np.int64), np.zeros(n, np.int64), np.empty(2 * n, np.int32)
        self._share()

    def _share(self) -> None:
        """Order 0's shares from its counts, _WHOLE in each lane: upto[m] is where those of magnitude m begin."""
        each = self.counts * np.int32(_WHOLE - _CLASSES) // self.counts.sum(axis=0, dtype=np.int32)
        each += 1
        np.cumsum(each, axis=0, out=self.upto[1:])
        self.upto[-1] = _WHOLE
        self.ends, self.edges = self.upto[1:-1].astype(np.int16), self.upto.ravel()

    def refresh(self, magnitudes: np.ndarray) -> None:
        """Order 0 takes in the magnitudes of the latest ids: rows of one for each lane."""
        c = self.counts
        c += 2 * np.bincount((magnitudes * np.int32(self.n) + self.lane).ravel(), minlength=c.size).reshape(c.shape).astype(np.int32)
        many = np.flatnonzero(c.sum(axis=0) > 512)
        c[:, many] = (c[:, many] + 1) >> 1
        self._share()

    def predict(self) -> None:
        n = self.n
        self.at = (self.mixed >> 9) & ((1 << _SLOTS) - 1)
        self.at += self.slot
        self.entry = self.tables.take(self.at)
        self.guess = self.entry | (_LEVELS - 1)  # as `seen` has it: id * _LEVELS + 7
        self.confidence = self.entry & (_LEVELS - 1)
        self.level = self.place + self.confidence
        self.p = self.belief.take(self.level)
        share = _SHARE.take(self.p)
        self.w1, self.w2 = share[:n], share[n:]
        moved = self.w1 * (self.guess[:n] == self.guess[n:])
        self.w2 += moved
        self.w1 -= moved
        self.known = self.w1 + self.w2

    def see(self, x: np.ndarray) -> np.ndarray:
        """Where the orders' guesses are right."""
        last = x * _LEVELS
        last += _LEVELS - 1
        self.seen[: self.n] = self.seen[self.n :] = last
        self.hits = np.flatnonzero(self.guess == self.seen)
        return self.hits

    def learn(self, x: np.ndarray) -> None:
        e, c, hits, p, n = self.entry, self.confidence, self.hits, self.p, self.n
        held = e[hits] + (c[hits] < _LEVELS - 1)
        p -= p >> 4
        p[hits] += 255
        self.belief[self.level] = p
        new = np.where(c > 1, e - ((c + 1) >> 1), self.seen - (_LEVELS - 2))
        new[hits] = held
        self.tables[self.at] = new
        np.multiply(x, 2654435761, out=self.mixed[n:], dtype=np.int64)
        self.mixed[:n] = self.mixed[n:]
        self.mixed[n:] += self.earlier
        np.multiply(x, 40503 << 4, out=self.earlier, dtype=np.int64)


_FULL = 0xFFFFFFFFFFFFFFFF
_S32 = np.uint64(32)
_LEAST = np.uint64(1 << 32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of consecutive ids (each below 2**17)."""
    n = -(-len(ids) // block)
    if not n:
        return []
    ids = ids.astype("<u4")
    grid = np.zeros((n, block + 16), np.int32)  # rows of a power of two would share cache lines when turned
    grid[: n - 1, :block] = ids[: (n - 1) * block].reshape(n - 1, block)
    grid[n - 1, : len(ids) - (n - 1) * block] = ids[(n - 1) * block :]
    grid = np.ascontiguousarray(grid[:, :block].T)
    magnitude = _MAGNITUDE.take(grid)
    lanes = _Lanes(n)
    low, span = np.zeros(n, np.uint64), np.full(n, _FULL, np.uint64)
    width = block * 33 // 32 + 4
    words, begin = np.empty(n * width, np.uint32), np.arange(n) * width
    end = begin.copy()
    for t in range(block if n > 1 else len(ids)):
        if t and t % _REFRESH == 0:
            lanes.refresh(magnitude[t - _REFRESH : t])
        lanes.predict()
        x, m = grid[t], magnitude[t].astype(np.int64)
        at = m * n
        at += lanes.lane
        start = lanes.edges.take(at)
        at += n
        share = (lanes.edges.take(at) - start).astype(np.int64)
        start = start + lanes.known
        bits, rest = _BITS.take(m), x - _FIRST.take(m)
        hits = lanes.see(x)
        if len(hits):
            first = hits[: np.searchsorted(hits, n)]
            second = hits[len(first) :] - n
            for which, s, w in ((first, lanes.w2, lanes.w1), (second, None, lanes.w2)):
                start[which] = 0 if s is None else s[which]
                share[which] = w[which]
                bits[which] = rest[which] = 0
        unit = span // (lanes.known + _WHOLE).view(np.uint64)
        span = unit * share.view(np.uint64) >> bits.view(np.uint64)
        unit *= start.view(np.uint64)
        unit += span * rest.view(np.uint64)
        unit += low
        over = np.flatnonzero(unit < low)
        low = unit
        back = end[over]
        while len(back):
            back -= 1
            words[back] += np.uint32(1)
            back = back[words[back] == 0]
        due = np.flatnonzero(span < _LEAST)
        if len(due):
            place = end[due]
            some = low[due]
            words[place] = some >> _S32
            end[due] = place + 1
            low[due] = some << _S32
            span[due] <<= _S32
        lanes.learn(x)
    out = []
    for i, (a, b, tail) in enumerate(zip(begin.tolist(), end.tolist(), low.tolist(), strict=True)):
        payload = words[a:b].astype("<u4").tobytes() + struct.pack("<II", tail >> 32, tail & 0xFFFFFFFF)
        own = ids[i * block : (i + 1) * block].tobytes()
        out.append(_HEAD.pack(MAGIC, len(own) // 4, zlib.crc32(own), zlib.crc32(payload)) + payload)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks of which none but the last may be shorter than the first; raises ValueError if a checksum is wrong."""
    n = len(blocks)
    if not n:
        return np.empty(0, "<u4")
    heads = [_HEAD.unpack_from(b) for b in blocks]
    payloads = [b[_HEAD.size :] for b in blocks]
    for (magic, _, _, crc), p in zip(heads, payloads, strict=True):
        if magic != MAGIC or zlib.crc32(p) != crc:
            raise ValueError("damaged block")
    block, last = heads[0][1], heads[-1][1]
    words = np.frombuffer(b"".join(payloads) + bytes(8), "<u4").astype(np.uint64)
    sizes = np.array([len(p) // 4 for p in payloads])
    end = np.cumsum(sizes) - sizes
    code = words[end] << _S32 | words[end + 1]
    end += 2
    span = np.full(n, _FULL, np.uint64)
    grid, magnitude = np.empty((block, n), np.int32), np.empty((_REFRESH, n), np.int8)
    lanes = _Lanes(n)
    for t in range(block):
        if t and t % _REFRESH == 0:
            lanes.refresh(magnitude)
        lanes.predict()
        known = lanes.known
        unit = span // (known + _WHOLE).view(np.uint64)
        target = (code // unit).view(np.int64)
        rest = target - known
        m = (lanes.ends <= np.maximum(rest, -1).astype(np.int16)).view(np.int8).sum(axis=0, dtype=np.int8)
        at = m * np.int64(n)
        at += lanes.lane
        start = lanes.edges.take(at)
        at += n
        share = (lanes.edges.take(at) - start).astype(np.int64)
        start = start + known
        bits, x = _BITS.take(m), _FIRST.take(m)
        guessed = np.flatnonzero(rest < 0)
        if len(guessed):
            w1, w2 = lanes.w1[guessed], lanes.w2[guessed]
            second = target[guessed] < w2
            start[guessed], share[guessed], bits[guessed] = np.where(second, 0, w2), np.where(second, w2, w1), 0
        span = unit * share.view(np.uint64) >> bits.view(np.uint64)
        unit *= start.view(np.uint64)
        code -= unit
        rest = code // span
        code -= rest * span
        x += rest.view(np.int64)
        if len(guessed):
            x[guessed] = lanes.guess[guessed + n * second] // _LEVELS
            m[guessed] = _MAGNITUDE.take(x[guessed])
        magnitude[t % _REFRESH] = m
        due = np.flatnonzero(span < _LEAST)
        if len(due):
            place = end[due]
            code[due] = code[due] << _S32 | words[place]
            span[due] <<= _S32
            end[due] = place + 1
        grid[t] = x
        lanes.see(x)
        lanes.learn(x)
    ids = np.ascontiguousarray(grid.T).ravel()[: (n - 1) * block + last].astype("<u4")
    for i, (_, size, crc, _) in enumerate(heads):
        if zlib.crc32(ids[i * block : i * block + size].tobytes()) != crc:
            raise ValueError("damaged block")
    return ids


_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++"
#: Pieces of letters and single marks, whose words the byte-level pattern cuts in the same places.
_WORDS = re.compile(f"({_LETTERS})([.,;:!?]*+\n?)(?:({_LETTERS})([.,;:!?]*+))?")


class Library:
    """The library's ids of whole texts, without truncation and padding; words and pieces that are known aren't encoded again.

    A piece is what stands between two spaces, with the space before it. Its byte-level pattern always starts a new word at a
    space, but within longer runs of white space (V._ODD), so ids of the pieces one after another are those of the text. Pieces of letters
    and marks (_WORDS) are cut further. Texts with such runs or special strings, and all texts of a vocabulary with another pattern, are
    encoded whole. Known pieces stand in two tables: a full one takes the older one's place, which loses what wasn't used meanwhile.
    """

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(content)
        cut = data.get("pre_tokenizer") or {}
        self.cuts = data.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        self.sizes = np.array([len(x) for x in V.token_bytes(content)])
        self.known: dict[str, bytes] = {}  # by what follows the space
        self.older: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}  # words and marks within pieces
        self.chars = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _spaced(self, words: list[str]) -> None:
        """Learn words, many in one text: their bytes tell which ids are whose."""
        if not words:
            return
        packed = b"".join(self.whole(" " + " ".join(words[at : at + PACK])) for at in range(0, len(words), PACK))
        reach = np.cumsum(self.sizes.take(np.frombuffer(packed, "<u4")))
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        cuts = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or not (reach[cuts] == ends).all():
            raise ValueError("the library's ids don't cover a text's bytes")
        cuts = (4 * cuts + 4).tolist()
        self.known.update(zip(words, map(packed.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))

    def _runs(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each of distinct pieces, with the space before it."""
        if len(self.known) > REMEMBERED or self.chars > KNOWN_CHARS:
            self.known, self.older, self.inner, self.chars = {}, self.known, {}, 0
        known, older, inner = self.known, self.older, self.inner
        missing = [p for p in pieces if p not in known]
        self.chars += sum(map(len, missing))
        new = [p for p in missing if p not in older]
        held = [p for p in missing if p in older] if len(new) < len(missing) else []
        known.update(zip(held, map(older.__getitem__, held), strict=True))
        words, apart, cut = [p for p in new if p.isalpha()], set(), []
        for p in new if len(words) < len(new) else ():
            if p.isalpha():
                continue
            if m := _WORDS.fullmatch(p):
                first, mark, second, end = m.groups("")
                cut.append((p, first, mark, second, end))
                apart.add(mark)
                if second:
                    apart.update((second, end))
            elif p and not p[0].isspace() and not p[-1].isspace():
                words.append(p)
            else:
                known[p] = self.whole(" " + p)
        firsts = {x[1] for x in cut}.difference(known, words)
        held = firsts & older.keys()
        known.update((w, older[w]) for w in held)
        words += firsts - held
        self._spaced(words)
        inner.update((w, self.whole(w)) for w in apart.difference(inner))
        for p, first, mark, second, end in cut:
            known[p] = known[first] + inner[mark] + (inner[second] + inner[end] if second else b"")
        return list(map(known.__getitem__, pieces))

    def ids(self, texts: pa.Array, *ends: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, `ends` behind each text's, and how many each text has."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, f"[{V.SPACES}] (?:[{V.SPACES}]|\\z)") if self.cuts else pa.array([True] * n)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        parts = pc.split_pattern(pc.if_else(odd, pa.scalar("", texts.type), texts), " ")
        sizes = pc.list_value_length(parts).to_numpy()
        head = np.cumsum(sizes) - sizes
        spaced = np.ones(int(sizes.sum()), bool)
        spaced[head] = False
        values = parts.flatten()
        coded = values.filter(pa.array(spaced)).dictionary_encode()
        heads = pc.if_else(odd, texts, values.take(pa.array(head))).to_pylist()
        runs = self._runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = np.empty(len(spaced), np.int64)
        at[spaced] = coded.indices.to_numpy()
        at[head] = len(runs) + np.arange(n)
        runs += map(self.whole, heads)
        if ends:
            at = np.insert(at, head + sizes, len(runs))
            head += np.arange(n)
            runs.append(np.array(ends, "<u4").tobytes())
        length = np.fromiter(map(len, runs), np.int64, len(runs)) >> 2
        sizes, begin = length.take(at), (np.cumsum(length) - length).take(at)
        begin -= np.cumsum(sizes) - sizes
        where = np.repeat(begin, sizes)
        where += np.arange(len(where))
        return np.frombuffer(b"".join(runs), "<u4").take(where), np.add.reduceat(sizes, head)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]


@lru_cache(maxsize=2)
def _library(content: bytes) -> Library:
    """One per worker process and file."""
    return Library(content)


def write(df: DataFrame, vocabulary_path: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text, append end_id, and write the ids to `path` in ascending order of identifiers.

    One exchange of the texts, by ranges of identifiers; tasks then stream through their rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    content = V.shared(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(content.value)
        part, stripe, names, sizes, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            blocks = encode_blocks(np.concatenate(held))
            columns = [pa.array([part], pa.int32()), pa.array([stripe], pa.int32()), pa.array([names], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "stripe", "ids", "sizes", "blocks"])

        for b in batches:
            id_type = b.schema.field("__id").type
            rows = max(1, TOGETHER * b.num_rows // max(b.nbytes, 1))
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                ids, counts = library.ids(some.column("__text"), end_id)
                done = 0
                for name, upto, n in zip(some.column("__id").to_pylist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    names.append(name)
                    sizes.append(n)
                    size += n
                    if size >= STRIPE:
                        held.append(ids[done:upto])
                        yield closed()
                        stripe, names, sizes, held, size, done = stripe + 1, [], [], [], 0, upto
                held.append(ids[done:])
        if names:
            yield closed()

    sorted_docs = docs.repartitionByRange("__id").sortWithinPartitions("__id", F.xxhash64("__text"), "__text")
    sorted_docs.mapInArrow(run, f"part int, stripe int, ids array<{kind}>, sizes array<bigint>, blocks array<binary>").write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids (packed) if asked for."""
    stored = spark.read.parquet(path)
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = decode_blocks(r["blocks"])
                ends = np.cumsum(r["sizes"])
                cuts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), r["sizes"], strict=True)]
                rows = len(cuts)
                columns = [pa.array([r["part"]] * rows, pa.int32()), pa.array([r["stripe"]] * rows, pa.int32()), pa.array(r["ids"], b.schema.field("ids").type.value_type), pa.array(ends - r["sizes"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(cuts if with_ids else [None] * rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "stripe", "__id", "__at", "n_tokens", "ids_crc32", "packed"])

    rows = stored.mapInArrow(run, f"part int, stripe int, __id {kind}, __at long, n_tokens long, ids_crc32 long, packed binary")
    totals = stored.select("part", "stripe", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    parts = parts.select(F.col("part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("part").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("__ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "stripe", (F.col("__base") + F.col("__ahead")).alias("__base"))
    out = rows.join(bases, ["part", "stripe"])
    return out.select(F.col("__id").alias(id_col), (F.col("__base") + F.col("__at")).alias("start"), "n_tokens", "ids_crc32", *(["packed"] if with_ids else []))
