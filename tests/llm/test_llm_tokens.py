"""Encoding, counting, packing and storing tokens, against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskloom.llm import byte_pairs, packing, token_counts, token_store
from maskloom.llm.library import TextEncoder, read_vocabulary
from maskloom.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "",
    " ",
    "  two  blanks\n\n and\tmore \x1c x　y  z ",
    "don't we'LL 'S 'l 've'r ''' it's",
    "<|endoftext|> <|startoftext|>a<|endoftext|>b <|ENDOFTEXT|>",
    "Ünḯcôde ÉCOLE İ ẞ Σας ΟΔΟΣ é Å ﬁ 漢字かな 한글 🎉🎉 a​b",
    "123 4567 3.14 $$$ ### ### && a|b ...!!!",
    "x" * 5000 + " " + "ab" * 2000 + "é" * 300,
    " " * 700 + "end" + " " * 300,
    "The the\nThe the\nThe",
    "﷐ ￾ \x00 \x7f",
]
ALPHABET = st.sampled_from(list(" ab'stlrevdmS\n\té1.É漢<|>") + ["<|endoftext|>", "'ll", "  "])
TEXTS = st.lists(ALPHABET, max_size=14).map("".join)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, None), (3, ODD[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_forced_boundaries_are_never_inside_a_token(word):
    codec = byte_pairs.Codec(read_vocabulary(WORD))
    byte_of = {c: b for b, c in enumerate(codec.letters)}
    for token in list(word.get_vocab())[::50]:
        if token in codec.special:
            continue
        data = bytes(byte_of[c] for c in token.removesuffix("</w>"))
        if data:
            assert codec.cuts(np.frombuffer(data, np.uint8))[1:].sum() == 0
    assert codec.cuts(np.frombuffer("漢a字".encode(), np.uint8)).sum() > 1
    assert (~codec.joined).sum() > 30_000


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_codec_equals_library(text):
    library, codec = Tokenizer.from_file(WORD), byte_pairs.codec(read_vocabulary(WORD))
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == ids_of(library, text)
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode(odd, word):
    vocabulary = read_vocabulary(WORD)
    encoded = byte_pairs.encode(odd, "text", vocabulary)
    assert encoded.columns == ["doc_id", "text", "ids"]
    rows = byte_pairs.decode(encoded, "ids", vocabulary).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        assert row["ids"] == ids_of(word, row["text"])
        assert row["decoded"] == word.decode(row["ids"], skip_special_tokens=False)


def test_decode_of_null_and_unknown(spark):
    df = spark.createDataFrame([(None,), ([],), ([-1, 0, 999_999],)], "ids array<int>")
    rows = byte_pairs.decode(df, "ids", read_vocabulary(WORD)).collect()
    assert [r["decoded"] for r in rows] == [None, "", "!"]


def test_bpe_query_equals_library(spark, word):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = REGISTRY["op2_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = ids_of(word, docs[row["doc_id"]])
        told = word.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_every_prefix_equals_library(text):
    library, counter = Tokenizer.from_file(BYTE), token_counts.counter(read_vocabulary(BYTE))
    table = counter.table(text).tolist()
    assert table == [len(ids_of(library, text[:i])) for i in range(len(text) + 1)]
    assert counter.count(text) == table[-1]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_library_encoder_equals_library(text):
    for path, blanks in ((WORD, False), (BYTE, True)):
        library = Tokenizer.from_file(path)
        got = np.frombuffer(TextEncoder(read_vocabulary(path), blanks).encode([text, text])[1], "<u4").tolist()
        assert got == ids_of(library, text)


def test_counts(odd, byte):
    for row in token_counts.count_tokens(odd, "text", read_vocabulary(BYTE)).collect():
        assert row["n_tokens"] == len(ids_of(byte, row["text"]))
        assert row["n_bytes"] == len((row["text"] or "").encode())


def test_truncate(spark, byte):
    df = spark.createDataFrame([(ODD[3],), ("some plain words here",), ("",), (None,)], "text string")
    table = token_counts.prefix_counts(df, "text", read_vocabulary(BYTE))
    cut = token_counts.truncate(F.coalesce("text", F.lit("")), F.col("prefix_tokens"), 3)
    for row in table.withColumn("cut", cut).collect():
        text = row["text"] or ""
        fits = [i for i in range(len(text) + 1) if len(ids_of(byte, text[:i])) <= 3]
        assert row["cut"] == text[: fits[-1]]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert byte_pairs.encode(none, "text", read_vocabulary(WORD)).count() == 0
    assert token_counts.count_tokens(none, "text", read_vocabulary(BYTE)).count() == 0
    assert packing.pack_documents(none, "doc_id", "text", read_vocabulary(BYTE), 2, 16).count() == 0
    store = token_store.write_store(none, "doc_id", "text", read_vocabulary(WORD), 1)
    assert store.read(store.keys(none, "doc_id")).count() == 0
    assert store.shards().count() == 0


# Packing


def check_packed(rows, size):
    bins = {}
    for row in rows:
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def fewest(lengths, size):
    """The optimal number of sequences by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*bins, size - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_plan_is_optimal_on_small_cases(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    chosen = packing.plan(counts, 20)
    used = np.zeros(21, int)
    for items, times in chosen:
        assert sum(items) <= 20
        for item in items:
            used[item] += times
    assert (used == counts).all()
    assert sum(times for _, times in chosen) == fewest(sorted(lengths, reverse=True), 20)


def test_plan_meets_its_limits_with_whole_results():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 1025, 5000), minlength=1025)
    for nodes in (3, 20_000):
        chosen = packing.plan(counts, 1024, nodes=nodes)
        used = np.zeros(1025, int)
        for items, times in chosen:
            assert sum(items) <= 1024
            for item in items:
                used[item] += times
        assert (used == counts).all()
    assert sum(t for _, t in chosen) <= 1.01 * packing.lower_bound(counts, 1024)


def test_pack_hot_length_and_repeats(spark):
    rows = [(i // 2, 0, 300, "c") for i in range(600)] + [(1000 + i, 0, 1 + i % 50, "d") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string")
    packed = packing.pack(df, ["doc_id", "piece"], 1024).collect()
    assert len(packed) == 900
    # three pieces of 300 fit into a sequence, and the small ones beside them
    assert check_packed(packed, 1024) == 200


def test_pack_refuses_lengths_outside(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id long, length long")
    with pytest.raises(ValueError):
        packing.pack(df, ["doc_id"], 4)


def test_cut_documents(odd, byte):
    docs = odd.withColumn("length", F.lit("x"))
    pieces = packing.cut_documents(docs, "text", read_vocabulary(BYTE), 2, 64).collect()
    assert set(pieces[0].asDict()) == {"doc_id", "text", "piece", "start", "length", "ids"}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc, got in by_doc.items():
        if doc == 3:
            continue
        want = [*ids_of(byte, got[0]["text"]), 2]
        got.sort(key=lambda p: p["piece"])
        assert b"".join(bytes(p["ids"]) for p in got) == np.asarray(want, "<u4").tobytes()
        assert all(p["length"] == 64 for p in got[1:]) and 0 < got[0]["length"] <= 64
        assert [p["start"] for p in got] == np.cumsum([0, *(p["length"] for p in got[:-1])]).tolist()


def test_packing_query(spark, byte):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = REGISTRY["op3_packing"](spark, SMALL).collect()
    total = 0
    for row in rows:
        ids = np.asarray([*ids_of(byte, docs[row["doc_id"]]), 2], "<u4")
        assert row["ids_crc32"] == zlib.crc32(ids[row["start"] : row["start"] + row["length"]].tobytes())
        total += row["length"]
    assert total == sum(len(ids_of(byte, t)) + 1 for t in docs.values())
    assert check_packed(rows, 1024) <= 1.02 * -(-total // 1024)


# Store


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    copies = np.zeros(len(keys), np.int64)
    function = token_store.PerfectHash.build(keys, copies)
    assert sorted(function.slots(keys, copies)) == list(range(len(keys)))
    again, _ = token_store.PerfectHash.load(function.dump(0) + bytes(24 * len(keys)))
    assert (again.slots(keys, copies) == function.slots(keys, copies)).all()


def test_perfect_hash_lists_what_the_levels_leave(monkeypatch):
    monkeypatch.setattr(token_store, "LEVELS", 1)
    keys, copies = np.arange(1000), np.zeros(1000, np.int64)
    function = token_store.PerfectHash.build(keys, copies)
    assert len(function.listed)
    assert sorted(function.slots(keys, copies)) == list(range(1000))


def test_store_with_nulls_repeats_and_unknown_keys(spark, word):
    rows = [(5, "b a"), (None, "zz"), (-7, None), (5, "a"), (9, ""), (None, "y"), *((i, f"w {i}") for i in range(20, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = token_store.write_store(df, "doc_id", "text", read_vocabulary(WORD), 1, rows_per_shard=8)
    got = store.read(store.keys(df, "doc_id")).join(store.shards(), "shard").collect()
    assert len(got) == len(rows)
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(np.asarray([*ids_of(word, text), 1], "<u4").tobytes())
    for key, texts in want.items():
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["copy"])
        assert sorted(bytes(r["ids"]) for r in mine) == sorted(texts)
        assert [r["copy"] for r in mine] == list(range(len(texts)))
    places = sorted((r["first"] + r["start"], r["length"], r["key"]) for r in got)
    assert [p[0] for p in places] == np.cumsum([0, *(p[1] for p in places[:-1])]).tolist()
    order = [p[2] for p in places]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    missing = spark.createDataFrame([(1, 0), (5, 2), (None, 9)], "key long, copy long")
    assert store.read(missing).count() == 0


def test_store_cuts_keys_that_many_rows_share(spark, word):
    rows = [(None, f"n {i % 70}") for i in range(90)] + [(7, "same text")] * 80 + [(7, f"k {i}") for i in range(40)]
    rows += [(i, f"w {i}") for i in range(-40, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = token_store.write_store(df, "doc_id", "text", read_vocabulary(WORD), 1, rows_per_shard=16)
    sizes = [r["n"] for r in store.entries().groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 40
    got = store.read(store.keys(df, "doc_id")).join(store.shards(), "shard").collect()
    assert len(got) == len(rows)
    want, found = {}, {}
    for key, text in rows:
        want.setdefault(key, []).append(np.asarray([*ids_of(word, text), 1], "<u4").tobytes())
    got.sort(key=lambda r: r["first"] + r["start"])
    for r in got:
        found.setdefault(r["key"], []).append((r["copy"], bytes(r["ids"])))
    assert list(found) == [None, *range(-40, 40)]
    for key, texts in want.items():
        assert [c for c, _ in found[key]] == list(range(len(texts)))
        assert sorted(x for _, x in found[key]) == sorted(texts)
    assert [r["first"] + r["start"] for r in got] == np.cumsum([0, *(r["length"] for r in got[:-1])]).tolist()


def test_store_query(spark, word):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in REGISTRY["op10_token_store"](spark, SMALL).collect()}
    at = 0
    for key, text in docs:
        ids = np.asarray([*ids_of(word, text), 1], "<u4")
        assert (rows[key]["start"], rows[key]["n_tokens"]) == (at, len(ids))
        assert rows[key]["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert len(rows) == len(docs)


def test_store_with_text_keys(spark, word):
    rows = [(f"doc-{i % 50}", f"w {i}") for i in range(120)] + [(None, "n"), ("", "empty key")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    store = token_store.write_store(df, "doc_id", "text", read_vocabulary(WORD), 1, rows_per_shard=8)
    found = {}
    for r in store.read(store.keys(df, "doc_id")).collect():
        found.setdefault(r["key"], []).append((r["copy"], bytes(r["ids"])))
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(np.asarray([*ids_of(word, text), 1], "<u4").tobytes())
    assert found.keys() == want.keys()
    for key, texts in want.items():
        assert sorted(c for c, _ in found[key]) == list(range(len(texts)))
        assert sorted(x for _, x in found[key]) == sorted(texts)
    missing = spark.createDataFrame([("doc-99", 0), ("doc-1", 9)], "key string, copy long")
    assert store.read(missing).count() == 0


def test_arrays_are_decoded_as_one_by_one():
    import public_tokenizers
    import pyarrow as pa

    from maskloom.llm import byte_pairs
    from maskloom.llm.library import read_vocabulary

    codec = byte_pairs.codec(read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    special = list(codec.special.values())
    rows = [[300, 5, 49_000], [], None, [-1, 10**9, 7], [*special, 1], [None, 320], [-5], list(range(2000))]
    array = pa.array([[1, 2], *rows], pa.list_(pa.int32())).slice(1)
    assert codec.decode_all(array).to_pylist() == [None if x is None else codec.decode(x) for x in rows]
