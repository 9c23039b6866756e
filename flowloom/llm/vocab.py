"""A byte-level BPE vocabulary: word splitting and the merge rules, read from a tokenizers JSON file.

The file is read once on the driver and travels to the tasks as a broadcast of its bytes (about 1.5 MB whatever
the corpus), so executors need not have it on disk.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

#: White space as the Unicode property of that name has it (str.isspace also takes 1C to 1F).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = "s|t|re|ve|m|ll|d"
#: Bits of an identifier in a key of two, and a rank beyond all merges.
_WIDE, _NEVER = 20, 1 << 30


def _ranges(major: str) -> str:
    """The code points whose general category starts with major, as the inside of a character class."""
    runs: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == major:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """The pattern that cuts text into words before merges; frequent alternatives stand first where order is free."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:{CONTRACTIONS})| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token ids, merges and special strings of one file."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model, letters = data["model"], byte_letters()
        self.id_of = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.rank = {}
        for k, (a, b) in enumerate(pairs):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.rank[self.id_of[left], self.id_of[right]] = (k, self.id_of[left + right])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self._special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(map(len, self.id_of))
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.packed = [struct.pack("<I", i) for i in range(size)]
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in [*self.id_of.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = t
        self.sizes = [len(t) for t in self.bytes_of]
        self._made = {new: (k, pair) for pair, (k, new) in reversed(self.rank.items())}
        self._ranks = {x << _WIDE | y: k for (x, y), (k, _) in self.rank.items()}
        self._spines: tuple[dict, dict] = ({}, {})
        self._pair: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The ids of a word by its merges in order of rank; only for single tokens, to see whether each is its own encoding."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            k, new, at = min(((*self.rank.get((a, b), (1 << 30, 0)), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), key=lambda x: (x[0], x[2]))
            if k == 1 << 30:
                break
            ids[at : at + 2] = [new]
        return ids

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens at one edge of a token while it is built, lowest first, and the ranks of the merges that end them."""
        found = self._spines[side].get(token)
        if found is None:
            tokens, ends, end, t = [], [], _NEVER, token
            while True:
                tokens.append(t)
                ends.append(end)
                if t not in self._made:
                    break
                end, pair = self._made[t]
                t = pair[side]
            found = self._spines[side][token] = (tokens[::-1], ends[::-1])
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether an encoding may hold a directly before b: no merge joins the two while both are built.

        The right edge of a and the left edge of b grow by merges of rising rank. A pair of edges that stand side
        by side at some time merges, unless either is merged into its own token first (on a tie the left one is first).
        """
        known = self._pair.get(a << _WIDE | b)
        if known is None:
            if len(self._pair) > 250_000:
                self._pair.clear()
            (left, left_ends), (right, right_ends), rank = self._spine(a, 1), self._spine(b, 0), self._ranks.get
            i = j = 0
            x, x_end, y, y_end, known = left[0], left_ends[0], right[0], right_ends[0], True
            while True:
                merge = rank(x << _WIDE | y)
                if merge is not None and merge < x_end and merge <= y_end:
                    known = False
                    break
                if x_end <= y_end:
                    if x_end == _NEVER:
                        break
                    i += 1
                    x, x_end = left[i], left_ends[i]
                else:
                    j += 1
                    y, y_end = right[j], right_ends[j]
            self._pair[a << _WIDE | b] = known
        return known

    def alone(self, a: int) -> bool:
        """Whether the bytes of a encode to a itself."""
        known = self._whole.get(a)
        if known is None:
            known = self._whole[a] = self.merged(self.bytes_of[a]) == [a]
        return known

    def extend(self, word: bytes, last: list[int]) -> None:
        """Go on with `last` (last[i]: the last token of the encoding of word[:i], from 0 on) to the end of the word.

        For each prefix exactly one token fits: it ends there and may stand after the last token of what is before it.
        """
        token, pair, longest = self.id_of.get, self._pair.get, self.longest
        for end in range(len(last), len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                t = token(word[start:end])
                if t is not None:
                    before = last[start]
                    fits = pair(before << _WIDE | t) if start else self.alone(t)
                    if fits or fits is None and self.adjacent(before, t):
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary has no token for some byte")

    def parts(self, text: str):
        """(is special, string) pieces of a text: special strings count as their token wherever they stand."""
        if self._special_cut is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(x in self.special, x) for x in self._special_cut.split(text) if x]

    def words(self, text: str) -> list[str]:
        """The words and special strings of a text, in order."""
        cut = splitter().findall
        out: list[str] = []
        for special, part in self.parts(text):
            out += [part] if special else cut(part)
        return out


#: White space, a space, then white space or the end: only there would cutting at spaces split a run of white space.
_ODD = re.compile(f"[{SPACES}] (?:[{SPACES}]|\\Z)")


class Pieces:
    """Values of texts from values of their words, looked up piece by piece (what stands between two spaces).

    A space that follows anything but white space always starts a new word, so pieces can be looked up one by one;
    texts with longer runs of white space are split by the pattern as a whole. solve(words) gives each new distinct
    word's value, joined(values) that of words one after another. Memory is bounded: at `remembered` words the tables start anew.
    """

    def __init__(self, v: Vocabulary, solve, special, joined, remembered: int = 350_000):
        self.v, self.solve, self.remembered, self.special, self.joined = v, solve, remembered, special, joined
        self.spaced: dict = {}  # words of letters that follow a space, without it
        self.word: dict = {}  # all other words

    def forget(self) -> None:
        """Start the tables of words anew."""
        self.spaced.clear()
        self.word.clear()

    def values(self, texts: list[str]) -> list[list]:
        """Per text, the values of its pieces in order."""
        if len(self.spaced) + len(self.word) > self.remembered:
            self.forget()
        get, cut = self.spaced.get, splitter().findall
        held, letters, loose = [], set(), {}
        for text in texts:
            parts = []
            for special, part in self.v.parts(text):
                if special:
                    parts.append(("", [], [self.special(part)], []))
                elif _ODD.search(part):
                    loose[part] = cut(part)
                    parts.append((part, [], [], []))
                else:
                    head, *rest = part.split(" ")
                    if head:
                        loose[head] = cut(head)
                    got = list(map(get, rest))
                    gaps = [i for i, x in enumerate(got) if x is None]
                    for i in gaps:
                        p = rest[i]
                        if p.isalpha():
                            letters.add(p)
                        else:
                            p = rest[i] = " " + p
                            loose.setdefault(p, None)
                    parts.append((head, rest, got, gaps))
            held.append(parts)
        words = set()
        for p, x in loose.items():
            if x is None:
                x = loose[p] = cut(p)
            words.update(x)
        letters.update(w[1:] for w in words if w[0] == " " and w[1:].isalpha())
        letters = {p for p in letters if p not in self.spaced}
        other = {w for w in words if w[0] != " " or not w[1:].isalpha()}.difference(self.word)
        for w, x in self.solve(other.union(" " + p for p in letters)).items():
            if w in other:
                self.word[w] = x
            else:
                self.spaced[w[1:]] = x
        for p, ws in loose.items():
            found = [get(w[1:]) if w[0] == " " and w[1:].isalpha() else self.word[w] for w in ws]
            loose[p] = found if p[0] != " " else found[0] if len(found) == 1 else self.joined(found)
        out = []
        for parts in held:
            values: list = []
            for head, rest, got, gaps in parts:
                if head:
                    values += loose[head] if head[0] != " " else [loose[head]]
                for i in gaps:
                    p = rest[i]
                    got[i] = loose[p] if p[0] == " " else get(p)
                values += got
            out.append(values)
        return out

    def of_word(self, word: str):
        """The value of one word (not a special string): looked up where it is held, else solved and not kept."""
        found = self.spaced.get(word[1:]) if word[0] == " " and word[1:].isalpha() else self.word.get(word)
        return self.solve([word])[word] if found is None else found


@lru_cache(maxsize=2)
def token_bytes(content: bytes) -> list[bytes]:
    """The bytes of each id; all that decoding needs."""
    data, letters = json.loads(content), byte_letters()
    found = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    return [found.get(i, b"") for i in range(max(found) + 1)]


@lru_cache(maxsize=2)
def parsed(content: bytes) -> Vocabulary:
    """One Vocabulary per worker process and file."""
    return Vocabulary(content)


def shared(spark: SparkSession, path: str):
    """The file as a broadcast; its size is that of the vocabulary and doesn't follow the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
