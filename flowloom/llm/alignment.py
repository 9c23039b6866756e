"""Alignment of two tokenizers' tokens, and counts of the pairs that it links.

Both tokenizers split a space and the text. Cumulative byte lengths give where their tokens end; ends that both have cut the bytes into
groups (`intersect1d`), binary search labels tokens with groups, and repeating each token by its group's tokens of the other side gives the links.

What stands between single spaces is tokenized by itself: both tokenizers start a new token at a space that follows anything else, and
none of their tokens goes on beyond the next one, so a text's groups are those of its pieces one after another. Each distinct
piece is aligned once in a worker; texts with longer runs of spaces, or with one at an edge, are pieces as a whole. Tables of pieces start anew at a bound.

Texts are tokenized and aligned once. What later passes need is written: each document's numbers and digest, and its distinct pairs
of linked ids with how often it links them (8 bytes each before compression, less than the text itself).

The second pass counts, for each pair of ids, the documents that hold it linked: summed in the
task and then in a shuffle of two stages, by pair and salt and by pair. The third pass sums over each document's links what the counts say. It
takes the table of pairs in slices of SLICE pairs, so what is broadcast has a fixed bound: one slice, or as many passes as slices, whose
sums are added by document. The table's own size is bounded by the two vocabularies, whatever the corpus.

Edge cases: null and empty texts have no tokens, like texts whose tokens' bytes differ from a space and the text: zeros and ''. Strings of special
tokens are ordinary text. Repeated rows each give a row and each count as a document. An empty table gives an empty table. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm.scratch import materialize
from flowloom.llm.vocab import byte_letters

#: Characters of text that are aligned at once, pieces and links of pieces that a worker keeps, and pairs that it sums before it gives them on.
CHARS, PIECES, LINKS, SUMMED = 2_000_000, 400_000, 8_000_000, 2_000_000
#: Pairs of one broadcast slice (17 bytes each), and salts of the first stage of the shuffle.
SLICE, SALTS = 4_000_000, 8
SPACE_SIGN = "▁"


class Sides:
    """Both tokenizers, the bytes of their ids, and the alignment of pieces."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        data, letters = json.loads(a_file), byte_letters()
        plain = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items() if all(c in letters for c in t)}
        self.a_bytes = [plain.get(i, b"") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        sign = self.b.id_to_piece
        self.b_bytes = [bytes([int(sign(i)[1:-1], 16)]) if self.b.is_byte(i) else sign(i).replace(SPACE_SIGN, " ").encode() for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_ids = len(self.b_bytes)
        self.tables = [pa.array(x, pa.binary()) for x in (self.a_bytes, self.b_bytes)]
        numbers = [str(i) + end for ids, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(ids))]
        self.numbers = pa.array(numbers, pa.string())

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides for the pieces with a space before each, one after another, and the numbers of ids of each piece; none where their bytes differ from the piece's."""
        found = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)], self.b.encode(pieces, num_threads=1)
        counts = [np.fromiter(map(len, side), np.int64, len(pieces)) for side in found]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(found, counts, strict=True)]
        sizes = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
        whole, whose = (" " + " ".join(pieces)).encode(), np.arange(len(pieces))
        fine = all(
            len(i) and np.array_equal(np.bincount(np.repeat(whose, n), size[i], len(pieces)), sizes) and _bytes(table, i) == whole
            for i, n, size, table in zip(ids, counts, (self.a_size, self.b_size), self.tables, strict=True)
        )
        if not fine:  # some piece isn't given back as it is: look at each
            same = np.array([(" " + p).encode() == _bytes(self.tables[0], x) == _bytes(self.tables[1], y) for p, x, y in zip(pieces, *found, strict=True)], bool)
            ids = [i[np.repeat(same, n)] for i, n in zip(ids, counts, strict=True)]
            counts = [np.where(same, n, 0) for n in counts]
        return *ids, *counts

    def shown(self, x: np.ndarray, y: np.ndarray, x_group: np.ndarray, y_group: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The groups of each piece as text, a1,a2|b1;a3|b2,b3; with a semicolon at the end. ends: the first group of each piece, and the number of groups."""
        n = int(ends[-1])
        n_x, n_y = np.bincount(x_group, minlength=n), np.bincount(y_group, minlength=n)
        flat = np.empty(len(x) + len(y), np.int64)
        ahead_y, upto_x = np.concatenate([[0], np.cumsum(n_y)]), np.cumsum(n_x)
        ends_group = lambda g: np.append(g[1:] != g[:-1], True)
        flat[np.arange(len(x)) + ahead_y[x_group]] = x + ends_group(x_group) * len(self.a_size)
        flat[np.arange(len(y)) + upto_x[y_group]] = y + 2 * len(self.a_size) + ends_group(y_group) * len(self.b_size)
        taken = self.numbers.take(pa.array(flat))
        offsets, text = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1], taken.buffers()[2]
        text = text.to_pybytes() if text is not None else b""
        bounds = offsets[np.concatenate([[0], upto_x + np.cumsum(n_y)])[ends]].tolist()
        return [text[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]


def _bytes(table: pa.Array, ids) -> bytes:
    """The bytes of ids one after another."""
    taken = table.take(pa.array(ids, pa.int64()))
    return b"" if not len(taken) or taken.buffers()[2] is None else taken.buffers()[2].to_pybytes()[: int(np.frombuffer(taken.buffers()[1], np.int32)[len(taken)])]


def align(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of both sides (by their sizes in bytes): the group of each, and the links as positions in both."""
    x_end, y_end = np.cumsum(x_size), np.cumsum(y_size)
    cuts = np.intersect1d(x_end, y_end, assume_unique=True)
    x_group, y_group = np.searchsorted(cuts, x_end), np.searchsorted(cuts, y_end)
    n_y = np.bincount(y_group, minlength=len(cuts))
    each = n_y[x_group]  # links of each token of x
    left = np.repeat(np.arange(len(x)), each)
    first = np.searchsorted(y_group, x_group)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    return x_group, y_group, left, right


class Aligner:
    """Pieces that have been aligned."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[bytes] = []
        self.n = np.zeros((0, 4), np.int64)  # tokens of a and of b, groups, links
        self.fine = np.zeros(0, bool)
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)  # the pair of each link, by piece

    def _learn(self, pieces: list[str]) -> None:
        for p in pieces:
            self.place[p] = len(self.place)
        x, y, n_x, n_y = self.sides.encode(pieces)
        x_group, y_group, left, right = align(x, y, self.sides.a_size[x], self.sides.b_size[y])
        owner = np.repeat(np.arange(len(pieces)), n_x)
        last = np.append(x_group[1:] != x_group[:-1], True) if len(x) else np.zeros(0, bool)
        n_groups = np.bincount(owner[last], minlength=len(pieces))
        pair = x[left] * self.sides.b_ids + y[right]
        of = owner[left]
        n_links = np.bincount(of, minlength=len(pieces))
        fine = n_x > 0
        self.n = np.concatenate([self.n, np.stack([n_x, n_y, n_groups, n_links], axis=1)])
        self.fine = np.concatenate([self.fine, fine])
        self.pairs = np.concatenate([self.pairs, pair])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])
        self.text += self.sides.shown(x, y, x_group, y_group, np.concatenate([[0], np.cumsum(n_groups)]))

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pieces of all texts (each of one piece or more), and where each text's begin."""
        if len(self.place) > PIECES or self.n[:, 3].sum() > LINKS:
            self.forget()
        split = [t.split(" ") for t in texts]
        split = [[t] if "" in p else p for t, p in zip(texts, split, strict=True)]
        new = {p for pieces in split for p in pieces}.difference(self.place)
        if new:
            self._learn(sorted(new))
        at = np.array([self.place[p] for pieces in split for p in pieces], np.int64)
        return at, np.cumsum([0, *(len(p) for p in split[:-1])])


def _summed(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by the ascending group of each."""
    ends = np.concatenate([[0], np.cumsum(values)])
    bound = np.searchsorted(of, np.arange(n + 1))
    return ends[bound[1:]] - ends[bound[:-1]]


_aligners: dict[str, Aligner] = {}


def _worker(files: tuple[bytes, bytes]) -> Aligner:
    """This worker's aligner for these files; that of others is let go."""
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(Sides(*files))
    return _aligners[name]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about CHARS characters, and their texts (the last column)."""
    for b in batches:
        at, texts, size = 0, [], 0
        for k, x in enumerate(b.columns[-1]):
            texts.append(x.as_py())
            size += len(texts[-1])
            if size >= CHARS or k == b.num_rows - 1:
                yield b.slice(at, len(texts)), texts
                at, texts, size = k + 1, [], 0


def _aligned(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Per row: __id, its NUMBERS and groups_sha256, and its distinct pairs and how often it links them (packed, 32 bits each)."""
    files, kind = _files(df, a_path, b_path), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker(files.value)
        for b, texts in _blocks(batches):
            numbers, digests, sizes = np.zeros((len(texts), len(NUMBERS)), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64)
            seen = times = np.zeros(0, np.int64)
            filled = [k for k, t in enumerate(texts) if t]
            if filled:
                at, begins = aligner.places([texts[k] for k in filled])
                fine = np.logical_and.reduceat(aligner.fine[at], begins)
                numbers[filled] = np.where(fine[:, None], np.add.reduceat(aligner.n[at], begins, axis=0), 0)
                shown_, bounds, text = at.tolist(), [*begins.tolist(), len(at)], aligner.text
                for k, ok, i, j in zip(filled, fine.tolist(), bounds, bounds[1:], strict=False):
                    if ok:
                        digests[k] = hashlib.sha256(b"".join([text[p] for p in shown_[i:j]])[:-1]).hexdigest()
                of = np.repeat(np.arange(len(filled)), np.diff(bounds))
                of, at = of[fine[of]], at[fine[of]]
                n = np.diff(aligner.ends)[at]
                spots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(aligner.ends[at], n)
                seen, times = np.unique(np.repeat(of, n) << 32 | aligner.pairs[spots], return_counts=True)
                sizes[filled] = np.diff(np.searchsorted(seen, np.arange(len(filled) + 1) << 32))
            packed = [_packed(x, sizes) for x in (seen & 0xFFFFFFFF, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in numbers.T), pa.array(digests, pa.string()), *packed], names=["__id", *NUMBERS, "groups_sha256", "pairs", "times"])

    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.mapInArrow(run, f"__id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, pairs binary, times binary")
    return materialize(rows, "aligned-texts")


def _packed(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """x, cut into pieces of these sizes, as little-endian 32-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<u4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after another, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 250):
            yield b.slice(k, 250)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): pair = a_id * b_ids + b_id, the documents that hold it linked, and whether no pair of a_id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            distinct, where = np.unique(pairs, return_inverse=True)
            return distinct, np.bincount(where, n, len(distinct)).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(held[0][0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in held[0]], names=["pair", "n"])

        for b in _parts(batches):
            held.append(np.unique(_unpacked(b.column("pairs"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > SUMMED:
                held = [joined()]
                if len(held[0][0]) > SUMMED // 2:
                    yield from given()
                    held = []
                size = sum(len(h[0]) for h in held)
        if held:
            held = [joined()]
            yield from given()

    rows = aligned.where(F.octet_length("pairs") > 0).select("pairs").mapInArrow(run, "pair long, n long")
    salted = rows.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt")).agg(F.sum("n").alias("n"))
    sums = materialize(salted.groupBy("pair").agg(F.sum("n").alias("n")), "aligned-sums")
    most = sums.groupBy(F.floor(F.col("pair") / b_ids).alias("__a")).agg(F.max("n").alias("__most"))  # a row per id of a
    out = sums.join(most, F.floor(F.col("pair") / b_ids) == F.col("__a"))
    return materialize(out.select("pair", "n", (F.col("n") == F.col("__most")).alias("best")), "aligned-pairs")


def _files(df: DataFrame, a_path: str, b_path: str):
    """Both files as a broadcast (some 2 MB, whatever the corpus)."""
    content = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            content.append(f.read())
    return df.sparkSession.sparkContext.broadcast(tuple(content))


def _looked_up(aligned: DataFrame, table) -> DataFrame:
    """One pass over the documents' pairs with one slice of the table of pairs."""
    kind = aligned.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for b in _parts(batches):
            own, sizes = _unpacked(b.column("pairs"))
            times, of = _unpacked(b.column("times"))[0], np.repeat(np.arange(b.num_rows), sizes)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                there = times * (pairs[at] == own)
                sums = [_summed(there * best[at], of, b.num_rows), _summed(there * n[at], of, b.num_rows)]
            else:
                sums = [np.zeros(b.num_rows, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__id", *NUMBERS)), *map(pa.array, sums), b.column("groups_sha256")], names=["__id", *COUNTS, "groups_sha256"])

    return aligned.mapInArrow(run, f"__id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
COUNTS = [*NUMBERS, "n_best", "count_sum"]


def align_texts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. a_path: a tokenizers file, b_path: a sentencepiece model."""
    aligned = _aligned(df, a_path, b_path, id_col, text_col)
    table = pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size())
    slices = max(1, -(-table.count() // SLICE))
    passes = []
    for k in range(slices):
        part = table.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toArrow().sort_by("pair") if slices > 1 else table.toArrow().sort_by("pair")
        columns = tuple(part.column(c).to_numpy() for c in ("pair", "n", "best"))
        passes.append(_looked_up(aligned, df.sparkSession.sparkContext.broadcast(columns)))
    if slices == 1:
        return passes[0].select(F.col("__id").alias(id_col), *COUNTS, "groups_sha256")
    # Rows of one identifier and one digest have the same links, so their sums are equal in each pass.
    rows = [materialize(p, "aligned-pass") for p in passes]
    by = ["__id", "groups_sha256"]
    each = rows[0].select(*by, "n_best", "count_sum").dropDuplicates(by)
    for p in rows[1:]:
        each = each.union(p.select(*by, "n_best", "count_sum").dropDuplicates(by))
    sums = each.groupBy(F.col("__id").alias("__of"), F.col("groups_sha256").alias("__sha")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows[0].drop("n_best", "count_sum").join(sums, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("groups_sha256") == F.col("__sha")))
    return out.select(F.col("__id").alias(id_col), *COUNTS, "groups_sha256")
