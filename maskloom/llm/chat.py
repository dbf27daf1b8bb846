"""Conversations as one text with a loss mask: rendered whole, encoded once with offsets, masked by spans.

Turns are sorted by range of (conversation, turn), so a conversation of very many turns runs over several tasks. Each
task renders its turns as they come, in fragments that end with a turn: a conversation is one fragment, unless it is
longer than ``FRAGMENT`` characters or reaches over a border between tasks. Control strings are special tokens, so no
token reaches over one, and the ids of the fragments in their order are the ids of the whole conversation.

The template of a turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts one backslash is put between
``<`` and ``|``, and one more where backslashes stand between them already; taking one away gives the text back. So a
control string never stands inside a turn.

Defined cases: null roles and texts are empty; a null conversation is a conversation of its own; turns come by number,
null first, and rows of the same number by role and text; repeated rows are turns like others; an empty table gives no
rows; columns that are not named in a call are left out of the result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from maskloom.llm.common import bound_batches, name

# fixed values: the control strings of the template
OPEN, BETWEEN, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
FRAGMENT = 1_000_000
TOGETHER = 2_000_000
_READY: dict = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def render(role: str, text: str) -> tuple[str, int]:
    """A turn by the template, and the place in it where the text begins."""
    head = f"{OPEN}{escape(role)}{BETWEEN}"
    return f"{head}{escape(text)}{CLOSE}", len(head)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from a rendered text."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(BETWEEN)
        out.append((unescape(role), unescape(text)))
    return out


def chat_tokenizer(vocabulary: str):
    """The tokenizer with the control strings as special tokens, whose offsets keep white space."""
    key = hash(vocabulary)
    if key not in _READY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (OPEN, BETWEEN, CLOSE)])
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        _READY[key] = tokenizer
    return _READY[key]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the spans (start, end). Tokens and spans are in the order of the text.

    The first token of a span is the first that ends behind the span's start, the last the last that starts before its
    end: two binary searches for each span. An empty span holds no token.
    """
    change = np.zeros(len(starts) + 1, np.int64)
    some = np.array([s for s in spans if s[1] > s[0]], np.int64).reshape(-1, 2)
    np.add.at(change, np.searchsorted(ends, some[:, 0], "right"), 1)
    np.add.at(change, np.searchsorted(starts, some[:, 1], "left"), -1)
    return np.cumsum(change[:-1]) > 0


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped: one for each run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
    runs = zip(starts[edges[::2]].tolist(), ends[edges[1::2] - 1].tolist())
    return [unescape(formatted[a:b]) for a, b in runs]


class _Fragment:
    def __init__(self, conversation, number: int, whole: bool):
        self.conversation, self.number, self.whole = conversation, number, whole
        self.parts, self.length, self.turns, self.spans = [], 0, 0, []

    def add(self, role: str, text: str) -> None:
        part, head = render(role, text)
        if role == LOSS_ROLE:
            self.spans.append((self.length + head, self.length + len(part) - len(CLOSE)))
        self.parts.append(part)
        self.length += len(part)
        self.turns += 1


FIELDS = (
    "fragment long, whole boolean, n_turns int, formatted string, ids array<int>, starts array<int>, "
    "ends array<int>, loss array<boolean>"
)


def _fragments(batches, first: int) -> Iterator[_Fragment]:
    """Fragments of one task's sorted turns. Its first and last conversation may go on in another task."""
    current, number = None, first
    for batch in batches:
        for conversation, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            role, text = role or "", text or ""
            same = current is not None and conversation == current.conversation
            if not same or current.length + len(text) > FRAGMENT:
                if current is not None:
                    current.whole = current.whole and not same
                    yield current
                current = _Fragment(conversation, number, not same and number > first)
                number += 1
            current.add(role, text)
    if current is not None:
        current.whole = False
        yield current


def format_conversations(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, vocabulary: str
) -> DataFrame:
    """One row a fragment: ``key`` (of the conversation), ``fragment`` (its fragments in ascending
    order; numbers may have gaps), ``whole`` (true: the fragment is surely its whole conversation), ``n_turns``,
    ``formatted``, and for each token ``ids``, ``starts`` and ``ends`` (code points in ``formatted``) and ``loss`` (the
    token belongs to the text of an assistant).
    """
    bound_batches(df.sparkSession)
    source = df.select(
        name(conversation).alias("key"),
        name(role).cast("string").alias("role"),
        name(text).cast("string").alias("text"),
        name(turn).alias("turn"),
        # rows alike in all else may go anywhere among each other
        F.rand(7).alias("salt"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text", "salt")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = source.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(FIELDS).fields])
    arrow = pa.schema(
        [
            ("key", to_arrow_type(kind)),
            ("fragment", pa.int64()),
            ("whole", pa.bool_()),
            ("n_turns", pa.int32()),
            ("formatted", pa.string()),
            ("ids", pa.list_(pa.int32())),
            ("starts", pa.list_(pa.int32())),
            ("ends", pa.list_(pa.int32())),
            ("loss", pa.list_(pa.bool_())),
        ]
    )

    def encode(tokenizer, fragments: list[_Fragment]) -> pa.RecordBatch:
        rows = []
        texts = ["".join(f.parts) for f in fragments]
        for f, formatted, one in zip(fragments, texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            places = np.array(one.offsets, np.int32).reshape(-1, 2)
            starts, ends = places[:, 0].copy(), places[:, 1].copy()
            loss = mask_tokens(starts, ends, f.spans)
            rows.append((f.conversation, f.number, f.whole, f.turns, formatted, one.ids, starts, ends, loss))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        from pyspark import TaskContext

        tokenizer, waiting, size = chat_tokenizer(vocabulary), [], 0
        for fragment in _fragments(batches, TaskContext.get().partitionId() << 33):
            waiting.append(fragment)
            size += fragment.length
            if size > TOGETHER:
                yield encode(tokenizer, waiting)
                waiting, size = [], 0
        if waiting:
            yield encode(tokenizer, waiting)

    return dealt.select("key", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from formatted fragments: ``key``, ``n_turns``, ``turns_sha256`` (of role, line break,
    text, line break of each turn), ``loss_chars`` and ``loss_sha256`` (of all text under the mask, unescaped) and
    ``formatted_chars``.

    Whole fragments are summed up where they lie. A sum of this kind cannot be put together from parts, so the texts of
    the other fragments go by conversation to one task each, which reads them as a stream.
    """
    kind = formatted.schema["key"].dataType
    fields = "fragment long, whole boolean, n_turns long, chars long, loss_chars long, turns binary, loss binary"
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(fields).fields])

    def lists(column: pa.Array) -> list[np.ndarray]:
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        return [flat[a:b] for a, b in zip(offsets, offsets[1:])]

    def parts(batches):
        for batch in batches:
            rows = []
            data = [batch.column(c).to_pylist() for c in ("whole", "formatted")]
            for whole, text, starts, ends, loss in zip(*data, *(lists(batch.column(c)) for c in ("starts", "ends", "loss"))):
                turns = turns_of(text)
                told = "".join([f"{role}\n{said}\n" for role, said in turns]).encode()
                under = "".join(masked_texts(text, starts, ends, loss))
                chars, under = len(under), under.encode()
                if whole:
                    told, under = hashlib.sha256(told).digest(), hashlib.sha256(under).digest()
                rows.append((len(turns), len(text), chars, told, under))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("fragment"), batch.column("whole")]
                + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=schema.fieldNames(),
            )

    arrow = pa.schema(
        [("key", to_arrow_type(kind))]
        + [(c, pa.int64()) for c in ("n_turns", "chars", "loss_chars")]
        + [(c, pa.binary()) for c in ("turns", "loss")]
    )

    def whole_conversations(batches):
        current, sums, hashes = None, None, None

        def row():
            return [current[0], *sums, hashes[0].digest(), hashes[1].digest()]

        for batch in batches:
            out = []
            for key, whole, *numbers, told, under in zip(
                *(batch.column(c).to_pylist() for c in ("key", "whole", "n_turns", "chars", "loss_chars", "turns", "loss"))
            ):
                if whole:
                    out.append([key, *numbers, told, under])
                    continue
                if current is None or current[0] != key:
                    if current is not None:
                        out.append(row())
                    current, sums, hashes = (key,), [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [a + b for a, b in zip(sums, numbers)]
                hashes[0].update(told)
                hashes[1].update(under)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row(), arrow)], schema=arrow)

    source = formatted.select("key", "fragment", "whole", "formatted", "starts", "ends", "loss")
    dealt = source.mapInArrow(parts, schema).repartition("key").sortWithinPartitions("key", "fragment")
    done = T.StructType(
        [schema["key"], *[schema[c] for c in ("n_turns", "chars", "loss_chars", "turns", "loss")]]
    )
    return dealt.mapInArrow(whole_conversations, done).select(
        "key",
        "n_turns",
        F.lower(F.hex("turns")).alias("turns_sha256"),
        "loss_chars",
        F.lower(F.hex("loss")).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
