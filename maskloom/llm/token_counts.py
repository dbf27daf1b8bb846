"""Exact token counts at every prefix of a text, by dynamic programming.

The encoding of a prefix ends in one certain token: the one whose left neighbour, the last token of the shorter
prefix, stays beside it when both are encoded together. So the count of a prefix is one more than the count of the
shorter prefix, and all prefixes take one pass. Counts answer how long a text is, where to cut it for a budget, and
whether a prefix fits, without encoding again.

Defined cases: null text is the empty text, with 0 tokens; a special token written out in a text is one token, as
the library's default has it; repeated rows stay; columns of the input that have the name of an output are replaced.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.bytepairs import merge_pairs, merge_table
from maskloom.llm.common import Memo, annotate, list_array, texts_of
from maskloom.llm.library import BYTE_LEVEL, byte_letters

_READY: dict = {}
_IRREGULAR = re.compile(r"(?:\A|\s) ")
_SAFE = re.compile(r"(?<=\S)(?= )")


class PrefixCounter:
    """Counts for a byte-level vocabulary, read from the text of its file."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        data = json.loads(vocabulary)
        ids: dict[str, int] = data["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        spelled = {t: bytes(map(byte_of.__getitem__, t)) for t in ids}
        self.merges = merge_table([(ids[a], ids[b], ids[a + b]) for a, b in data["model"]["merges"]])
        self.byte_ids = [ids[c] for c in letters]
        self.spelling = {ids[t]: s for t, s in spelled.items()}
        # a token that does not encode to itself ends no prefix
        self.ids = {s: ids[t] for t, s in spelled.items() if len(s) == 1 or self._encode(s) == [ids[t]]}
        self.found = ahocorasick.Automaton()
        for spelling, token in self.ids.items():
            self.found.add_word(spelling.decode("latin-1"), (len(spelling), token))
        self.found.make_automaton()
        self.special = [t["content"] for t in data["added_tokens"]]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(BYTE_LEVEL)
        self.stable = Memo(self._stable, 1_000_000)
        self.after = Memo(lambda piece: self.chunk_counts(" " + piece), 500_000)
        self.whole = Memo(self.chunk_counts, 100_000)

    def _encode(self, piece: bytes) -> list[int]:
        return merge_pairs([self.byte_ids[b] for b in piece], self.merges)

    def _stable(self, pair: int) -> bool:
        left, right = divmod(pair, 1 << 20)
        return self._encode(self.spelling[left] + self.spelling[right]) == [left, right]

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for i = 0..len(piece); ``piece`` is one piece of the splitting pattern.

        The automaton tells, for each end, the tokens that end there, the longest first; the first that stands beside
        the last token of the prefix before it is the last token here.
        """
        n, stable = len(piece), self.stable
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for at, (length, token) in self.found.iter(piece.decode("latin-1")):
            if last[at + 1] < 0:
                start = at + 1 - length
                if not start or stable[last[start] << 20 | token]:
                    last[at + 1], counts[at + 1] = token, counts[start] + 1
        return counts

    def _pieces(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def chunk_counts(self, chunk: str) -> array:
        """The count at every prefix of a chunk, piece by piece in bytes; a special token is one step.

        They are kept as arrays, which the collector of cycles need not walk through.
        """
        parts = self.split_special.split(chunk) if self.split_special else [chunk]
        out = array("I", [0])
        for i, part in enumerate(parts):
            if i % 2:
                out.append(out[-1] + 1)
                continue
            for piece in self._pieces(part):
                base, counts = out[-1], self.prefixes(piece.encode())
                out.extend([base + n for n in counts[1:]] if base else counts[1:])
        return out

    def count_chunk(self, chunk: str) -> int:
        return self.chunk_counts(chunk)[-1]

    def count(self, text: str) -> int:
        """The count at the last prefix: no piece reaches over a place where a blank follows another character, so the
        last stored counts of all chunks add up."""
        if _IRREGULAR.search(text):
            return sum([counts[-1] for counts in map(self.whole.__getitem__, _SAFE.split(text))])
        first, *rest = text.split(" ")
        return self.whole[first][-1] + sum([counts[-1] for counts in map(self.after.__getitem__, rest)])

    def table(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i = 0..len(text), counted in characters.

        Inside a piece the counts are those of its own prefixes. Two kinds of piece look ahead, so that their prefixes
        split otherwise: white space, and contractions; a run of either is split anew for its few prefixes.
        """
        out = np.zeros(len(text) + 1, np.int32)
        base, at = 0, 0
        parts = self.split_special.split(text) if self.split_special else [text]
        for i, part in enumerate(parts):
            if i % 2:
                # the beginnings of a special token are plain text
                for k in range(1, len(part)):
                    out[at + k] = self._tail(text, at, at + k, out)
                base += 1
            else:
                base = self._part(text, part, at, base, out)
            at += len(part)
            out[at] = base
        return out

    def _part(self, text: str, part: str, at: int, base: int, out: np.ndarray) -> int:
        for match in self.pattern.finditer(part):
            piece, start = match.group(), at + match.start()
            data = piece.encode()
            counts = self.prefixes(data)
            if piece[0] == "'" or piece.isspace():
                for k in range(1, len(piece)):
                    out[start + k] = self._tail(text, start, start + k, out)
                if piece.isspace() and match.end() < len(part):
                    # white space before a word: as the end of a prefix it is one piece with what stands before it
                    base += counts[-1]
                    out[start + len(piece)] = self._tail(text, start, start + len(piece), out)
                    continue
            else:
                width = 0
                for k, letter in enumerate(piece[:-1], 1):
                    width += len(letter.encode())
                    out[start + k] = base + counts[width]
                if piece[0] == " " and len(piece) > 1:
                    out[start + 1] = self._tail(text, start, start + 1, out)
            base += counts[-1]
            out[start + len(piece)] = base
        return base

    def _tail(self, text: str, start: int, end: int, out: np.ndarray) -> int:
        """Tokens of ``text[:end]``, given the counts up to the start of the white space and word before ``start``."""
        while start and text[start - 1].isspace():
            start -= 1
        while start and not text[start - 1].isspace():
            start -= 1
        while start and text[start - 1].isspace():
            start -= 1
        return int(out[start]) + self.count_chunk(text[start:end])


def counter(vocabulary: str) -> PrefixCounter:
    """One counter a worker process."""
    key = hash(vocabulary)
    if key not in _READY:
        _READY[key] = PrefixCounter(vocabulary)
    return _READY[key]


def count_tokens(df: DataFrame, text: str, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens``, the count at the last prefix."""

    def kernel():
        one = counter(vocabulary)

        def work(array):
            texts = texts_of(array)
            return [
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array([one.count(t) for t in texts], pa.int64()),
            ]

        return work

    return annotate(df, [text], kernel, "n_bytes long, n_tokens long", keep)


def prefix_counts(df: DataFrame, text: str, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``prefix_tokens``: the tokens of every prefix, from the empty one to the whole text, by characters."""

    def kernel():
        one = counter(vocabulary)

        def work(array):
            tables = [one.table(t) for t in texts_of(array)]
            lengths = np.fromiter(map(len, tables), np.int64, len(tables))
            return [list_array(np.concatenate(tables) if tables else np.zeros(0, np.int32), lengths, pa.int32())]

        return work

    return annotate(df, [text], kernel, "prefix_tokens array<int>", keep)


def truncate(text: Column, prefix_tokens: Column, budget: int) -> Column:
    """The longest prefix of at most ``budget`` tokens, read off the counts. Counts may fall from one prefix to a
    longer one, so the last that fits is taken."""
    places = F.sequence(F.lit(0), F.size(prefix_tokens) - 1)
    fits = F.filter(places, lambda i: F.get(prefix_tokens, i) <= budget)
    return F.substring(text, F.lit(1), F.array_max(fits))

