"""Token ids of whole texts as the tokenizers library gives them.

Texts of plain Latin characters are merged by ranks (tiktoken): the vocabulary's merges in their order are the ranks,
which gives the same ids wherever every token is what its own letters merge to; that is tried out for each token of the
vocabulary when an encoder is made. All other texts are cut into pieces, and distinct pieces go through the library
once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from maskloom.llm.common import Memo

# fixed value: how byte-level vocabularies of this kind split a text
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed value: how vocabularies with word ends split a text in lower case
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_READY: dict = {}
_SAFE = re.compile(r"(?<=\S)(?= )")
# Latin letters, digits and signs without white space: for these both regex engines know the same classes, and
# composing characters changes nothing
_PLAIN = re.compile("[!-~\u00a1-\u024f]+")
# texts of these alone are merged by ranks; a dotted capital I becomes two characters in lower case
_PLAIN_TEXT = re.compile("[\t\n\r -~\u00a1-\u012f\u0131-\u024f]*")
LIMIT = 800_000
TOGETHER = 1000


def read_vocabulary(path: str) -> str:
    """The file's text, which goes to the executors with the job; it is a vocabulary and so of bounded size."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte) if byte in shown else chr(spare))
        spare += byte not in shown
    return letters


def split_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts at blanks: the distinct pieces, the piece at each place, and where each text starts."""
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def spread_ids(values: list[bytes], codes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids (4 bytes each) of all pieces of each text, given those of each distinct piece."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(values), "<u4")
    width = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(width)])
    # place of each id inside the run of its piece
    picks = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[codes], width)
    data, cuts = flat[picks].tobytes(), (4 * ends[offsets]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def mark_words(texts: list[str]) -> list[str]:
    """Plain texts in lower case, cut as ``WORD_END`` cuts them: each word ends with a zero, and white space is gone.

    A word is a run of letters, one digit, or a run of other signs. An apostrophe that starts a run and the letters of a
    short form behind it are a word of their own.
    """
    codes = np.frombuffer(("\n".join([t.lower() for t in texts]) + "\n ").encode("utf-32-le"), "<u4")
    kinds = _KINDS[codes]
    here, after = kinds[:-1], kinds[1:]
    ends = (here != after) | (here == _DIGIT)
    quotes = np.flatnonzero((codes[:-2] == ord("'")) & (np.concatenate([[0], here[:-2]]) != _SIGN))
    if len(quotes):
        first = codes[quotes + 1]
        second = codes[np.minimum(quotes + 2, len(codes) - 1)]
        long = np.isin(first * 65536 + second, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
        short = np.isin(first, [ord(a) for a in "stmd"])
        ends[quotes[short | long]] = False
        ends[quotes[short] + 1] = True
        ends[quotes[long] + 2] = True
    codes, kept = codes[:-1], here != _BLANK
    ends &= kept
    width = kept.astype(np.int64) + ends
    place = np.cumsum(width)
    out = np.zeros(int(place[-1]) if len(place) else 0, "<u4")
    out[(place - width)[kept]] = codes[kept]
    marked = out.tobytes().decode("utf-32-le")
    # the line break put behind each text
    behind = np.cumsum([len(t) + 1 for t in texts]) - 1
    cuts = place[behind].tolist()
    return [marked[a:b] for a, b in zip([0, *cuts], cuts)]


_BLANK, _LETTER, _DIGIT, _SIGN = range(4)


def _kinds() -> np.ndarray:
    import unicodedata

    kinds = {"L": _LETTER, "N": _DIGIT}
    of_char = [kinds.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(0x250)]
    return np.array([_BLANK if chr(c) in " \t\n\r" else k for c, k in enumerate(of_char)], np.int8)


_KINDS = _kinds()


class RankEncoder:
    """Ids of plain texts by the order of the vocabulary's merges."""

    def __init__(self, data: dict, word_ends: bool):
        import tiktoken

        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        suffix = data["model"].get("end_of_word_suffix") or ""
        vocab = data["model"]["vocab"]
        self.word_ends = word_ends
        # a byte, a byte at a word's end (a zero behind it), then the merges in their order
        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocab[letter] for letter in letters]
        if word_ends:
            ranks.update({bytes([b, 0]): 256 + b for b in range(256)})
            ids += [vocab[letter + suffix] for letter in letters]
        for merge in data["model"]["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ends = word_ends and token.endswith(suffix)
            key = bytes(byte_of[c] for c in (token.removesuffix(suffix) if ends else token)) + b"\0" * ends
            if key in ranks:
                raise ValueError("two merges give the same token")
            ranks[key] = len(ids)
            ids.append(vocab[token])
        self.ids = np.array(ids, "<u4")
        pattern = "[^\0]*\0" if word_ends else BYTE_LEVEL
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = mark_words(texts) if self.word_ends and texts else texts
        return [self.ids[self.ranks.encode_ordinary(t)].tobytes() if t else b"" for t in texts]


def rank_encoder(data: dict, model, blanks_matter: bool) -> RankEncoder | None:
    """None where ids by ranks might differ: other kinds of vocabulary, or tokens that their own letters do not give.

    ``model`` makes a tokenizer of a model's settings, over words that are split and spelled already.
    """
    splits = data["pre_tokenizer"]
    known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if blanks_matter:
        right = known.items() <= splits.items() and data["normalizer"] is None
    else:
        right = splits.get("pretokenizers", [{}])[0].get("pattern") == {"Regex": WORD_END}
    if not right or data["model"].get("ignore_merges") or data["model"].get("continuing_subword_prefix"):
        return None
    suffix = data["model"].get("end_of_word_suffix") or ""
    tokens = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
    last = [t.removesuffix(suffix) for t in tokens if t.endswith(suffix)]
    wanted = [data["model"]["vocab"][t + suffix] for t in last]
    if model(data["model"]).encode(" ".join(last), add_special_tokens=False).ids != wanted:
        return None
    if suffix:  # tokens within words: merged as if nothing marked a word's end
        inner = [t for t in tokens if not t.endswith(suffix)]
        bare = model(data["model"] | {"end_of_word_suffix": None})
        if bare.encode(" ".join(inner), add_special_tokens=False).ids != [data["model"]["vocab"][t] for t in inner]:
            return None
    return RankEncoder(data, not blanks_matter)


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    No token reaches across the place between a character other than white space and a blank, so texts are cut
    there, distinct pieces are encoded once and kept in a bounded cache, and the ids are put together.
    Where ``blanks_matter`` is false (the vocabulary drops white space) every blank is such a place.

    Texts of plain Latin characters are merged by ranks instead. In others, pieces of plain Latin text are split here,
    and the library's model merges them, many in one call; all other pieces go through the library as they are.
    """

    def __init__(self, vocabulary: str, blanks_matter: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blanks_matter = blanks_matter
        # pieces after a blank, without it; pieces as they are
        self.after, self.whole = Memo(limit=LIMIT), Memo(limit=LIMIT)
        data = json.loads(vocabulary)
        self.lower = not blanks_matter
        pattern = BYTE_LEVEL if blanks_matter else data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern if blanks_matter else pattern + r"|\n")
        # the same model over words that are split and spelled already
        spelled = data | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        spelled_by = lambda model: Tokenizer.from_str(json.dumps(spelled | {"model": model}))
        self.model = spelled_by(data["model"])
        key = "ranks", hash(vocabulary), blanks_matter
        if key not in _READY:
            _READY[key] = rank_encoder(data, spelled_by, blanks_matter)
        self.ranks = _READY[key]
        letters = byte_letters()
        self.spell = {byte: letters[byte] for byte in range(256)} | {9: " "}
        # a line break stands in no plain piece, so its token marks where one ends
        self.mark = self.model.token_to_id(letters[10] + (data["model"].get("end_of_word_suffix") or ""))

    def _plain(self, pieces: list[str], prefix: str) -> list[bytes]:
        text = "".join([f"{prefix}{p}\n" for p in pieces])
        words = "\t".join(self.pattern.findall(text.lower() if self.lower else text))
        spelled = words.encode().decode("latin-1").translate(self.spell)
        ids = np.asarray(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.flatnonzero(ids == self.mark)
        data, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 4])
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _fill(self, known: Memo, pieces: list[str], prefix: str) -> list[bytes]:
        """The ids of distinct pieces."""
        known.turn()
        missing = known.recall(pieces)
        plain = [p for p in missing if _PLAIN.fullmatch(p) and "<|" not in p]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start : start + TOGETHER]
            known.update(zip(some, self._plain(some, prefix)))
        odd = [p for p in missing if p not in known]
        encoded = self.tokenizer.encode_batch_fast([prefix + p for p in odd], add_special_tokens=False)
        known.update({p: np.asarray(one.ids, "<u4").tobytes() for p, one in zip(odd, encoded)})
        return list(map(known.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.ranks is not None and "<|" not in t and bool(_PLAIN_TEXT.fullmatch(t)) for t in texts]
        by_ranks = iter(self.ranks.encode([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        by_pieces = iter(self._by_pieces([t for t, p in zip(texts, plain) if not p]))
        return [next(by_ranks if p else by_pieces) for p in plain]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        pieces, codes, offsets = split_pieces(texts)
        if not self.blanks_matter:
            return spread_ids(self._fill(self.after, pieces, ""), codes, offsets)
        # a blank after white space, or at the start: there the cut before the blank is not safe
        unsafe = np.array([not p or p[-1].isspace() for p in pieces])[codes]
        unsafe[offsets[1:] - 1] = False
        apart = np.flatnonzero(np.add.reduceat(unsafe, offsets[:-1], dtype=np.int64))
        values = self._fill(self.after, pieces, " ")
        # the first piece of a text has no blank before it
        firsts = [pieces[c] for c in codes[offsets[:-1]].tolist()]
        distinct = list(dict.fromkeys(firsts))
        at = {p: len(values) + i for i, p in enumerate(distinct)}
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = [at[p] for p in firsts]
        out = spread_ids(values + self._fill(self.whole, distinct, ""), codes, offsets)
        for i in apart.tolist():
            out[i] = b"".join(self._fill(self.whole, _SAFE.split(texts[i]), ""))
        return out


def encoder(vocabulary: str, blanks_matter: bool) -> Callable[[list[str]], list[bytes]]:
    """One encoder a worker process, which keeps its pieces from task to task."""
    key = hash(vocabulary), blanks_matter
    if key not in _READY:
        _READY[key] = TextEncoder(vocabulary, blanks_matter)
    return _READY[key].encode
