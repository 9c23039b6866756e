"""Phrase collocation mining by contiguous pattern growth over projected prefixes.

Texts are lower-cased (A-Z), cut into pieces and words, and counted by language. First all words are counted; those too rare
to be in a phrase end every window. Then each occurrence of a frequent word points at what follows it in its piece: a
window of up to MOST - 1 more frequent words. Equal windows of a chunk of text become one pointer with a count, and pointers are projected
by prefix: a row per (language, first word) and chunk holds all that follow that word there. Tasks take the prefixes, sort a
prefix's pointers and grow it to the right, depth first: only pointers below a frequent prefix are looked at further.

Hot prefixes: a word that begins at least 1 / SHARES of all words (so at most SHARES words) is split by a hash of its
second word, in proportion, so that one task holds about that share at most. A task keeps at most HELD windows of one prefix; beyond that it gives its counts of
all phrases so far, unpruned, and starts anew: counts are summed over tasks at the end, so results are whole whatever is split.

Rare words are recognised by a bitmap of hashes of frequent ones, of at most 2**27 bits whatever the corpus: a rare word that passes only
lengthens windows, and its phrases fall to the final threshold.

Edge cases: null text counts as empty, null language as `und`. Texts without words give nothing; a phrase never spans a
piece's end. Repeated rows count each. Words are any characters but those that cut, so control characters and other white space belong
to words. An empty table gives an empty table. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

#: Bytes of text that are counted at once, windows whose prefixes are grown together, and the most of one prefix.
CHUNK, GROWN, HELD = 8 << 20, 1 << 19, 1 << 21
#: Words that begin a larger share of all words than 1 / SHARES are split.
SHARES = 512
MOST = 4
_SPACE, _CUT = 32, 10
#: A-Z to lower case, tab to space, and whatever ends a piece to a line feed.
_TABLE = bytes(_CUT if b in b".,;:!?\n\x0b\x0c\r" else _SPACE if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(data: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The words of text that _TABLE has been applied to, and the number of line feeds before each."""
    a = np.frombuffer(data + b"\n", np.uint8)
    apart = (a == _SPACE) | (a == _CUT)
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(a[~apart])), np.searchsorted(np.flatnonzero(a == _CUT), start)


def _coded(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, prepared text) of rows (__lang, __text), about CHUNK bytes each; a longer text is a chunk of its own."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("__lang").to_pylist(), b.column("__text"), strict=True):
            held.setdefault(lang, []).append(text.as_py().encode().translate(_TABLE))
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
            if sizes[lang] >= CHUNK or sum(sizes.values()) >= 2 * CHUNK:
                lang = max(sizes, key=sizes.get)
                del sizes[lang]
                yield lang, b"\n".join(held.pop(lang))
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _rows(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))


def count_words(df: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, f) of words with at least `least` occurrences, and per language a row without word: all its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            ids, names = _coded(words_of(data)[0])
            words = pa.concat_arrays([names, pa.array([None], pa.string())])
            counts = np.append(np.bincount(ids, minlength=len(names)), len(ids))
            for k in range(0, len(words), 50_000):
                part = words.slice(k, 50_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(counts[k : k + 50_000], pa.int64())], names=["lang", "word", "f"])

    sums = _rows(df, lang_col, text_col).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | F.col("word").isNull())


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bits of hashes of words, as bytes: at most 16 MB."""
    n = words.count()
    bits = 1 << min(27, max(16, (32 * n).bit_length()))
    at = F.xxhash64("word").bitwiseAND(F.lit(bits - 1))
    spots = words.select(at.alias("__at")).distinct().groupBy(F.shiftright("__at", 16).alias("__block")).agg(F.collect_list(F.col("__at").bitwiseAND(F.lit(65535)).cast("int")).alias("__spots"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, spots in zip(b.column("__block").to_pylist(), b.column("__spots"), strict=True):
                mask = np.zeros(65536, bool)
                mask[spots.values.to_numpy()] = True
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(mask, bitorder="little").tobytes()])], names=["__block", "__bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in spots.mapInArrow(pack, "__block bigint, __bits binary").collect():
        out[r["__block"] * 8192 : (r["__block"] + 1) * 8192] = np.frombuffer(r["__bits"], np.uint8)
    return out


def _in_order(columns: list[np.ndarray]) -> np.ndarray:
    """One integer a row that sorts as the columns (not negative) do, one after another."""
    key, size = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if size * wide >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key = key * wide + c
        size *= wide
    return key


def _project(lang: str, data: bytes, bitmap: np.ndarray, hot: dict[tuple[str, str], int]) -> pa.RecordBatch | None:
    """A row per prefix: (lang, word, part), its windows as text, a line each, and their counts."""
    words, piece = words_of(data)
    if len(words) < 2:
        return None
    ids, names = _coded(words)
    hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer(), 42) for w in names.cast(pa.binary())], np.uint64)
    spot = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    frequent = (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
    n = len(names)
    n_parts = np.array([hot.get((lang, w), 1) for w in names.to_pylist()], np.int32) if hot else np.ones(n, np.int32)
    fine = np.append(frequent[ids], [False] * (MOST - 1))
    piece, ids = np.append(piece, [-1] * (MOST - 1)), np.append(ids, [0] * (MOST - 1)).astype(np.int32)
    last = len(words) - 1
    at = np.flatnonzero(fine[:last] & fine[1 : last + 1] & (piece[:last] == piece[1 : last + 1]))
    if not len(at):
        return None
    columns, open_ = [ids[at]], np.ones(len(at), bool)
    for k in range(1, MOST):
        open_ = open_ & fine[at + k] & (piece[at + k] == piece[at])
        columns.append(np.where(open_, ids[at + k] + 1, 0))  # 0: the window has ended
    part = (hashes[columns[1] - 1] % n_parts[columns[0]].astype(np.uint64)).astype(np.int32)
    columns.insert(1, part)
    _, first, counts = np.unique(_in_order(columns), return_index=True, return_counts=True)
    columns = [c[first] for c in columns]
    # Words with a blank behind them, and a line's end, one after another.
    spaced = pa.concat_arrays([pc.binary_join_element_wise(names, pa.repeat("", n), " "), pa.array(["\n"])])
    flat = np.stack([*(np.where(c > 0, c - 1, -1) for c in columns[2:]), np.full(len(first), n)], axis=1)
    ends = np.cumsum((flat >= 0).sum(axis=1))
    taken = spaced.take(pa.array(flat[flat >= 0]))
    offsets, text = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1], taken.buffers()[2]
    change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
    starts = np.concatenate([[0], change])
    bounds = np.append(starts, len(first))
    text_at = offsets[np.concatenate([[0], ends])[bounds]].astype(np.int32)
    held = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(o), pa.py_buffer(x)]) for o, x in ((text_at, text), ((bounds * 4).astype(np.int32), counts.astype(np.int32)))]
    prefix = names.take(pa.array(columns[0][starts]))
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(starts)), prefix, pa.array(columns[1][starts]), *held], names=["lang", "word", "part", "windows", "counts"])


def grow(prefixes: list[tuple[str, str]], windows: list[bytes], counts: list[bytes], least: int) -> list[pa.RecordBatch]:
    """Phrases of two words and more (lang, phrase, words, f) of several prefixes, by growth to the right; those of `least` occurrences and more.

    prefixes: (language, word) for each member of windows and counts. In sorted order, what a prefix points at stands
    together, and so, below it, what each longer prefix points at.
    """
    words, line = words_of(b"".join(windows))
    ids, names = _coded(words)
    n = np.concatenate([np.frombuffer(c, np.int32) for c in counts]).astype(np.int64)
    first = np.searchsorted(line, np.arange(len(n)))
    size = np.append(first[1:], len(line)) - first
    places = {p: i for i, p in enumerate(dict.fromkeys(prefixes))}
    owner = np.repeat([places[p] for p in prefixes], [len(c) // 4 for c in counts])
    matrix = [owner, *(np.where(size > k, ids[np.minimum(first + k, len(ids) - 1)] + 1, 0) for k in range(MOST - 1))]
    order = np.argsort(_in_order(matrix), kind="stable")
    matrix, n = [c[order] for c in matrix], n[order]
    langs, heads = (pa.array([p[i] for p in places]) for i in (0, 1))
    texts, out = heads, []
    new = np.concatenate([[True], matrix[0][1:] != matrix[0][:-1]])
    texts_of = matrix[0]  # for each row, the place of its prefix in texts
    for depth in range(1, MOST):
        here = matrix[depth] > 0
        new = new | np.concatenate([[True], matrix[depth][1:] != matrix[depth][:-1]])
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n, starts)
        often = (sums >= least) & here[starts]
        if not often.any():
            break
        at = starts[often]
        texts = pc.binary_join_element_wise(texts.take(pa.array(texts_of[at])), names.take(pa.array(matrix[depth][at] - 1)), " ")
        out.append(pa.RecordBatch.from_arrays([langs.take(pa.array(matrix[0][at])), texts, pa.repeat(depth + 1, len(at)).cast(pa.int32()), pa.array(sums[often])], names=["lang", "phrase", "words", "f"]))
        run = np.cumsum(new) - 1
        keep = often[run]
        texts_of = (np.cumsum(often) - 1)[run][keep]
        matrix, n, new = [c[keep] for c in matrix], n[keep], new[keep]
    return out


def count_phrases(df: DataFrame, words: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 2 to MOST words with at least `least` occurrences. words: of `count_words`."""
    spark = df.sparkSession
    total = words.where("word IS NULL").agg(F.sum("f")).first()[0] or 0
    share = max(1, total // SHARES)
    found = words.where(F.col("word").isNotNull() & (F.col("f") >= share)).collect()  # at most SHARES rows
    hot = {(r["lang"], r["word"]): 1 + r["f"] // share for r in found}
    known = spark.sparkContext.broadcast((_bitmap(words.where("word IS NOT NULL")), hot))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            made = _project(lang, data, *known.value)
            if made is not None:
                for k in range(0, made.num_rows, 2000):
                    yield made.slice(k, 2000)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*r[:3], w.as_buffer(), c.as_buffer()) for b in batches for *r, w, c in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), b.column(4), strict=True))
        prefixes, windows, counts, size = [], [], [], 0
        for (lang, word, _), group in groupby(rows, key=lambda r: r[:3]):
            own, split = 0, False
            for *_, w, c in group:
                if own + len(c) // 4 > HELD and own:  # too much of one prefix: all counts of what is held, and of what is to come
                    yield from grow(prefixes, windows, counts, 1)
                    prefixes, windows, counts, size, own, split = [], [], [], 0, 0, True
                prefixes.append((lang, word))
                windows.append(bytes(w))
                counts.append(bytes(c))
                own += len(c) // 4
                size += len(c) // 4
            if split or size >= GROWN:
                yield from grow(prefixes, windows, counts, 1 if split else least)
                prefixes, windows, counts, size = [], [], [], 0
        if prefixes:
            yield from grow(prefixes, windows, counts, least)

    rows = _rows(df, lang_col, text_col).mapInArrow(project, "lang string, word string, part int, windows binary, counts binary")
    rows = rows.repartition("lang", "word", "part").sortWithinPartitions("lang", "word", "part")
    grown = rows.mapInArrow(tasks, "lang string, phrase string, words int, f long")
    return grown.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(start: int, length: int) -> Column:
    """`length` words of a phrase, from number `start` on."""
    return F.substring_index(F.substring_index("phrase", " ", start + length), " ", -length)


def _parts(found: DataFrame, spans) -> DataFrame:
    """found with a row for each (cut, start, length) of spans(size): columns cut and part."""
    by_size = F.lit(None).cast("array<struct<cut:int,part:string>>")
    for size in range(2, MOST + 1):
        each = [F.struct(F.lit(cut).alias("cut"), _part(start, length).alias("part")) for cut, start, length in spans(size)]
        if each:
            by_size = F.when(F.col("words") == size, F.array(*each)).otherwise(by_size)
    return found.select("*", F.inline(by_size))


def mine(df: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per language, its `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    score: the least over all cuts in two of floor(2000000 a / (l + r)). A phrase inside a longer one with at least `covered` percent of
    its occurrences is dropped.
    """
    words = materialize(count_words(df, least, lang_col, text_col), "phrase-words")
    return ranked(materialize(count_phrases(df, words, least, lang_col, text_col), "phrase-counts"), words, top, covered)


def ranked(found: DataFrame, words: DataFrame, top: int, covered: int) -> DataFrame:
    """The result of `mine` from the counts of phrases and words."""
    counts = found.select("lang", "phrase", "f").union(words.where("word IS NOT NULL").select("lang", "word", "f"))
    left, right = (counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(c)) for c in ("l", "r"))
    cuts = _parts(found, lambda size: [(k, 0, k) for k in range(1, size)]).join(left, ["lang", "part"])
    cuts = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', cut - words)")).join(right, ["lang", "part"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long")
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("__cut")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "f").agg(lowest)
    inner = lambda size: [(0, start, length) for length in range(2, size) for start in range(size - length + 1)]
    longest = _parts(found, inner).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("f").alias("__longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.coalesce(F.col("__longer").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * covered, F.lit(True)))
    best = [F.desc("__cut.score"), F.desc("f"), "phrase"]
    # The first rows of each part of a language, then of the language: no task sees all its phrases.
    some = Window.partitionBy("lang", "__salt").orderBy(*best)
    kept = kept.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__r", F.row_number().over(some)).where(F.col("__r") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = words.where("word IS NULL").select(F.col("lang").alias("__lang"), F.col("f").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", F.col("f").alias("a"), "__cut.l", "__cut.r", "n", "__cut.score")
