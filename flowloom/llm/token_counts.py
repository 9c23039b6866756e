"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For each prefix of a word the last token of its encoding follows from the last tokens of shorter prefixes, and
its count is one more than that of the prefix before that token. A text's table is its words' tables one after
another (`prefix_tables`). Each distinct word's table is kept, a byte for each prefix, so a text's count is the sum of its words'
last entries, and a cut looks into the table of the word that holds it. Only where a cut changes how the text ends (inside white space,
a contraction or a special string) is that end counted by itself; words that a full table has let go of are solved again.

Edge cases: null text counts as empty (0 bytes, 0 tokens, cut 0). Repeated rows each give a row. An empty table
gives an empty table. Other columns of the input, whatever their names, are ignored unless named in `keep`.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import vocab as V

#: Rows whose new words are looked up together.
ROWS = 200
#: Words whose tables are kept: at most some 350 MB a worker.
WORDS = 2_000_000


def _table(counts: list[int]) -> bytes | array:
    return bytes(counts) if counts[-1] < 256 else array("I", counts)


def _chained(tables: list) -> bytes | array:
    """The table of words one after another."""
    counts = [0]
    for t in tables:
        ahead = counts[-1]
        counts += [ahead + n for n in t[1:]]
    return _table(counts)


class PrefixCounter:
    """Tables of token counts by prefix, for one vocabulary."""

    def __init__(self, vocabulary: V.Vocabulary):
        self.v = vocabulary
        self.pieces = V.Pieces(vocabulary, lambda words: {w: self.table(w) for w in words}, lambda s: b"\0\1", _chained, WORDS)

    def table(self, word: str) -> bytes | array:
        """counts[i] for the first i bytes of a word (not a special string), by the recurrence over last tokens."""
        w, size = word.encode(), self.v.sizes
        last, counts = [0], [0]
        self.v.extend(w, last)
        for end in range(1, len(w) + 1):
            counts.append(counts[end - size[last[end]]] + 1)
        return _table(counts)

    def count(self, text: str) -> int:
        return sum([x[-1] for x in self.pieces.values([text])[0]])

    def prefixes(self, text: str) -> list[int]:
        """counts[i]: tokens of the first i characters, exactly as if that prefix were the whole text.

        Cutting a text changes how its end is split into words in three places: inside a run of white space,
        inside a contraction, and inside a special string. There the tail is split as the cut leaves it. A run of white
        space is one word however long, or all but its last character and then that, so the run's own table answers.
        """
        space = lambda w: bool(w) and not w.strip(V.SPACES)
        of_word, special = self.pieces.of_word, self.v.special
        counts, before, tail, own = [0], 0, "", 0  # tail: the last word, whose split a cut may change; own: its tokens; before: tokens ahead of it
        for w in self.v.words(text):
            ahead = before + own
            t = b"\0\1" if w in special else of_word(w)
            if w in special or w[0] == "'" or space(tail):
                if space(tail) and space(w):
                    t = of_word(tail + w)
                    at = list(accumulate(len(c.encode()) for c in tail + w))
                    counts += [before + t[n] for n in at[len(tail) :]]
                    before, tail, own = ahead, w, counts[-1] - ahead
                    own = of_word(w)[-1]
                    continue
                counts += [before + self.count(tail + w[:k]) for k in range(1, len(w))]
            elif w.isascii():
                counts += [ahead + n for n in t[1:-1]]
            else:
                counts += [ahead + t[n] for n in accumulate(len(c.encode()) for c in w[:-1])]
            counts.append(ahead + t[-1])
            before, tail, own = ahead, w, t[-1]
        return counts

    def cut(self, text: str, limit: int, values: list[int] | None = None) -> int:
        """The longest prefix, in characters, that has at most `limit` tokens at its end. values: those of the text's pieces."""
        if self.v._special_cut is not None and any(s in text for s in self.v.special) or V._ODD.search(text):
            start, near = 0, text
        else:
            pieces = text.split(" ")
            heads = len(self.v.words(pieces[0])) if pieces[0] else 0
            ends = list(accumulate(x[-1] for x in values or self.pieces.values([text])[0]))
            if not ends or ends[-1] <= limit:
                return len(text)
            at = max(0, bisect_right(ends, limit) - heads)  # of the pieces after the first, so many fit
            first = max(0, at - 1)
            start = len(" ".join(pieces[: first + 1])) if first else 0
            near = "".join(" " + p for p in pieces[first + 1 : at + 2]) if first else " ".join(pieces[: at + 2])
            limit -= ends[first + heads - 1] if first else 0
        return start + max(i for i, n in enumerate(self.prefixes(near)) if n <= limit)


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, cut_chars (the longest prefix within the limit, in characters).

    No shuffle: each text is looked at once where it is read.
    """
    content = V.shared(df.sparkSession, vocabulary_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(content.value)
        for b in batches:
            n_bytes, n_tokens, cuts = [], [], []
            for at in range(0, b.num_rows, ROWS):
                texts = b.column("__text").slice(at, ROWS).to_pylist()
                for text, values in zip(texts, counter.pieces.values(texts), strict=True):
                    n = sum([x[-1] for x in values])
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(n)
                    cuts.append(counter.cut(text, limit, values) if n > limit else len(text))
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(cuts, pa.int64())], names=["__id", "n_bytes", "n_tokens", "cut_chars"])

    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = rows.mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long, cut_chars long")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")


def prefix_tables(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the whole table, prefix_tokens[i] for the first i characters (i from 0)."""
    content = V.shared(df.sparkSession, vocabulary_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(content.value)
        for b in batches:
            tables = pa.array([counter.prefixes(x.as_py()) for x in b.column("__text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("__id"), tables], names=["__id", "prefix_tokens"])

    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, prefix_tokens array<int>").withColumnRenamed("__id", id_col)


_counters: dict[int, PrefixCounter] = {}


def _counter(content: bytes) -> PrefixCounter:
    v = V.parsed(content)
    if id(v) not in _counters:
        _counters[id(v)] = PrefixCounter(v)
    return _counters[id(v)]
