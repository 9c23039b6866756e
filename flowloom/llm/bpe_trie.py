"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

Distinct words of a batch form a trie; walking it depth first (which is the sorted order of the words) keeps, for
each node on the current path, the last token of that prefix. A word adds only the nodes below what it shares with
the word before it, so a shared prefix is walked once; a word's ids are read off its path backwards, token by token.

Edge cases: null text counts as empty and has no ids; null ids decode to the empty string. Repeated rows each
give a row. Special strings inside a text become their token, as the tokenizers library does by default.
An empty table gives an empty table. Columns not in `keep` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import vocab as V

#: Characters of text whose new words share one trie.
TRIE_CHARS = 1_000_000


def encode_words(v: V.Vocabulary, words: Iterable[str]) -> dict[str, bytes]:
    """Ids, packed as little-endian 32-bit integers, of each distinct word."""
    out: dict[str, bytes] = {}
    path, last, packed, size = b"", [0], v.packed, v.sizes  # the node path now walked: its bytes, and the last token at each depth
    for word in sorted(words):  # code points and their UTF-8 bytes have one order
        w = word.encode()
        shared, most = 0, min(len(path), len(w))
        while shared < most and path[shared] == w[shared]:
            shared += 1
        del last[shared + 1 :]
        v.extend(w, last)
        path, ids, depth = w, [], len(w)
        while depth:
            t = last[depth]
            ids.append(packed[t])
            depth -= size[t]
        ids.reverse()
        out[word] = b"".join(ids)
    return out


class Encoder:
    def __init__(self, v: V.Vocabulary):
        self.pieces = V.Pieces(v, lambda words: encode_words(v, words), lambda s: v.packed[v.special[s]], b"".join)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the new words of all these texts go into one trie."""
        return [b"".join(x) for x in self.pieces.values(texts)]


_encoders: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    v = V.parsed(content)
    if id(v) not in _encoders:
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


def _release() -> None:
    """Let this worker's vocabulary and words go."""
    for encoder in _encoders.values():
        encoder.pieces.forget()
    _encoders.clear()
    V.parsed.cache_clear()


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Per run of rows whose new words share a trie: the columns before the last, and packed ids of the last."""
    for b in batches:
        at, rows, size = 0, [], 0
        for k, x in enumerate(b.columns[-1]):
            rows.append(x.as_py())
            size += len(rows[-1])
            if size >= TRIE_CHARS or k == b.num_rows - 1:
                yield [c.slice(at, len(rows)) for c in b.columns[:-1]], encoder.encode(rows)
                at, rows, size = k + 1, [], 0


def _decoded(token: list[bytes], packed) -> str:
    """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(token.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _mapped(df: DataFrame, run, value, kept: tuple[str, ...], made: dict[str, str]) -> DataFrame:
    """mapInArrow over the columns of `kept` and a value; gives them and the columns of made (names and types). Names can't clash."""
    rows = df.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(kept)), value.alias("__value"))
    schema = [*(f"__{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"__made{i} {t}" for i, t in enumerate(made.values()))]
    out = rows.mapInArrow(run, ", ".join(schema))
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"__made{i}").alias(c) for i, c in enumerate(made)))


def _batch(columns: list[pa.Array], *made: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *made], names=[*(f"__{i}" for i in range(len(columns))), *(f"__made{i}" for i in range(len(made)))])


def encode_texts(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and each text's ids as binary (little-endian unsigned 32-bit). Keeps the order of rows; no shuffle."""
    content = V.shared(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids in _encoded(_encoder(content.value), batches):
            yield _batch(columns, pa.array(ids, pa.binary()))

    return _mapped(df, run, F.coalesce(F.col(text_col), F.lit("")), keep, {ids_col: "binary"})


def decode_ids(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and the text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
    content = V.shared(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = V.token_bytes(content.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield _batch(part.columns[:-1], pa.array([_decoded(token, x.as_buffer()) for x in part.columns[-1]], pa.string()))

    return _mapped(df, run, F.coalesce(F.col(ids_col), F.lit(b"")), keep, {text_col: "string"})


def round_trip(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: tuple[str, ...] = ("doc_id",), release: bool = False) -> DataFrame:
    """`encode_texts` and then `decode_ids` of those ids in one worker: the columns of `keep`, the ids, and the text they give.

    release: whether a worker lets its tables go after each task, for what else runs in it, and builds them anew for the next.
    """
    content = V.shared(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        token = encoder.pieces.v.bytes_of
        for columns, ids in _encoded(encoder, batches):
            yield _batch(columns, pa.array(ids, pa.binary()), pa.array([_decoded(token, x) for x in ids], pa.string()))
        if release:
            del encoder, token
            _release()

    return _mapped(df, run, F.coalesce(F.col(text_col), F.lit("")), keep, {ids_col: "binary", decoded_col: "string"})


def digests(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""
    return df.select(
        id_col, F.floor(F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids_col), 256).alias("ids_sha256"), F.sha2(F.col(text_col), 256).alias("decoded_sha256"),
    )
