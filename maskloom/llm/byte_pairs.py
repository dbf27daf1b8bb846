"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur side by side in no vocabulary token can never end up in one token. Between them a
cut is certain, so the fragments are encoded independently of each other, each distinct fragment once, and the ids
are put together.

Defined cases: null text is the empty text; the empty text has no ids; special tokens written out in a text are
their own id, as the library's default has it; an unknown id decodes to nothing; repeated rows stay; columns of the
input that have the name of an output are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from maskloom.functions.bytepairs import BatchMerger, merge_table
from maskloom.llm.common import Memo, annotate, list_array, texts_of
from maskloom.llm.library import byte_letters, split_pieces, spread_ids

_READY: dict = {}


class Codec:
    """Encoder and decoder of a BPE vocabulary with word ends, read from the text of its file."""

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(vocabulary)
        # normalising and splitting into words are the library's; merging is done here
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        data = json.loads(vocabulary)
        model = data["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.merger = BatchMerger(merge_table([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]))
        self.letters = byte_letters()
        self.inner = np.array([ids[c] for c in self.letters])
        self.final = np.array([ids[c + self.end] for c in self.letters])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        # by id; a last entry for ids that are no token's
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 2)], pa.string())
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined = self._joined(ids)
        # for letters up to U+024F both engines know the same classes, and composing changes nothing
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pieces = Memo(limit=600_000)

    def _joined(self, ids: dict[str, int]) -> np.ndarray:
        """Whether the second byte follows the first inside some token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        table = np.zeros((256, 256), bool)
        for token in ids:
            if self.end and token.endswith(self.end):
                token = token[: -len(self.end)]
            values = [byte_of[c] for c in token]
            table[values[:-1], values[1:]] = True
        return table

    def cuts(self, letters: np.ndarray) -> np.ndarray:
        """For each byte whether a forced boundary lies before it."""
        return np.concatenate([[True], ~self.joined[letters[:-1], letters[1:]]]) if len(letters) else np.zeros(0, bool)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each word; no word is empty.

        The words are cut into fragments at word starts and forced boundaries, each fragment is merged by itself,
        and the ids stand in the order of the fragments.
        """
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        symbols = self.inner[letters]
        last = starts + lengths - 1
        symbols[last] = self.final[letters[last]]
        cut = self.cuts(letters)
        cut[starts] = True
        places = np.flatnonzero(cut)
        ids, counts = self.merger.merge(symbols, np.diff(places, append=len(letters)))
        return ids, np.add.reduceat(counts, np.searchsorted(places, starts))

    def _words(self, text: str) -> list[bytes]:
        """The words that the library's normaliser and splitter make of a text without special tokens."""
        if text.isascii() or (max(text) < "ɐ" and unicodedata.is_normalized("NFC", text)):
            return [w.encode() for w in self.pattern.findall(text.lower())]
        byte_of = {c: b for b, c in enumerate(self.letters)}
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(byte_of.__getitem__, piece)) for piece, _ in pieces]

    def _fill(self, pieces: list[str]) -> None:
        """Encode the distinct pieces that are not known, all their words side by side."""
        self.pieces.turn()
        missing = self.pieces.recall(pieces)
        # special tokens stand among the words as numbers
        rows = []
        for piece in missing:
            if self.split_special and "<|" in piece:
                row = []
                for i, part in enumerate(self.split_special.split(piece)):
                    row += [self.special[part]] if i % 2 else self._words(part) if part else []
                rows.append(row)
            else:
                rows.append(self._words(piece) if piece else [])
        ids, counts = self.encode_words([w for row in rows for w in row if isinstance(w, bytes)])
        ends = np.cumsum(counts).tolist()
        data, at, word = ids.astype("<u4").tobytes(), 0, 0
        for piece, row in zip(missing, rows):
            if all(isinstance(w, bytes) for w in row):
                word += len(row)
                end = 4 * ends[word - 1] if row else at
                self.pieces[piece] = data[at:end]
                at = end
                continue
            parts = []
            for w in row:
                if isinstance(w, bytes):
                    parts.append(data[at : 4 * ends[word]])
                    at, word = 4 * ends[word], word + 1
                else:
                    parts.append(int(w).to_bytes(4, "little"))
            self.pieces[piece] = b"".join(parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as unsigned 32-bit numbers. White space makes no token, so blanks are boundaries as well."""
        if not texts:
            return []
        pieces, codes, offsets = split_pieces(texts)
        self._fill(pieces)
        return spread_ids(list(map(self.pieces.__getitem__, pieces)), codes, offsets)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The tokens with a blank between them, which is what a vocabulary file without decoder says."""
        found = map(self.tokens.get, ids)
        return " ".join([token for token in found if token is not None])

    def decode_all(self, arrays: pa.ListArray) -> pa.Array:
        """``decode`` of each array; null for a null array."""
        ids = arrays.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        last = len(self.names) - 1
        found = self.names.take(pa.array(np.where((ids >= 0) & (ids < last), ids, last)))
        known = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
        lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = known[np.concatenate([[0], np.cumsum(lengths)])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.drop_null(), mask=arrays.is_null())
        return pc.binary_join(lists, " ")


def codec(vocabulary: str) -> Codec:
    """One codec a worker process."""
    key = hash(vocabulary)
    if key not in _READY:
        _READY[key] = Codec(vocabulary)
    return _READY[key]


def encode(df: DataFrame, text: str, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int), the ids of each whole text. ``vocabulary`` is the text of the vocabulary file."""

    def kernel():
        one = codec(vocabulary)

        def work(array):
            encoded = one.encode_all(texts_of(array))
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            return [list_array(np.frombuffer(b"".join(encoded), "<i4"), lengths, pa.int32())]

        return work

    return annotate(df, [text], kernel, "ids array<int>", keep)


def decode(df: DataFrame, ids: str, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the text of each array of ids; null for a null array."""

    def kernel():
        one = codec(vocabulary)

        def work(array):
            return [one.decode_all(array)]

        return work

    return annotate(df, [ids], kernel, "decoded string", keep)
