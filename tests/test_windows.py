import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.functions import tokens as K
from maskloom.operators import masking as M
from maskloom.operators import windows as W

SIZES = {0: 1, 1: 1, 509: 1, 510: 1, 511: 2, 764: 2, 765: 3, 5000: 19}


def frame_of(spark, sizes):
    rows = [(i, [10 + (k * 7 + i) % 500 for k in range(n)]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def windows_of(df):
    found = {}
    for r in df.orderBy("doc_id", "win").collect():
        found.setdefault(r["doc_id"], []).append(r["input_ids"])
    return found


def test_window_counts(spark):
    df = frame_of(spark, SIZES)
    counted = {r["n_tokens"]: r["n_windows"] for r in W.windows_per_document(df).collect()}
    assert counted == SIZES
    assert {d: len(w) for d, w in windows_of(W.token_windows(df)).items()} == dict(enumerate(SIZES.values()))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 90), min_size=1, max_size=20), st.integers(4, 20), st.integers(0, 19))
def test_windows_put_together_give_the_text(spark, sizes, length, overlap):
    overlap %= length - 2
    df = frame_of(spark, sizes)
    texts = {r["doc_id"]: r["ids"] for r in df.collect()}
    for doc, parts in windows_of(W.token_windows(df, max_length=length, overlap=overlap)).items():
        content = [p[1:-1] for p in parts]
        assert all(p[0] == K.SPECIALS.cls and p[-1] == K.SPECIALS.sep and len(p) <= length for p in parts)
        assert all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(content, content[1:]))
        assert content[0] + [t for p in content[1:] for t in p[overlap:]] == texts[doc]


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        K.window_count(F.lit(3), 10, 8)


def test_padding(spark):
    df = frame_of(spark, [0, 3, 510, 700])
    cut = W.token_windows(df)
    for row in W.model_inputs(W.pad_static(cut)).collect():
        n = sum(row["attention_mask"])
        assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["special_tokens_mask"]) == 512
        assert row["input_ids"][n:] == [K.SPECIALS.pad] * (512 - n)
        assert [i for i, s in enumerate(row["special_tokens_mask"]) if not s] == list(range(1, n - 1))
    sized = W.window_sizes(df)
    real = {(r["doc_id"], r["win"]): len(r["input_ids"]) for r in cut.collect()}
    assert {(r["doc_id"], r["win"]): r["n_ids"] for r in sized.collect()} == real
    for row in W.pad_dynamic(sized, batch_size=2).collect():
        batch = [n for i, (_, n) in enumerate(sorted(real.items())) if i // 2 == row["batch"]]
        assert row["padded_length"] == -(-max(batch) // 8) * 8


@pytest.mark.parametrize("batch", [1, 3, 4, 100])
def test_chunk_cap(spark, batch):
    counts = [1, 5, 1, 2, 9, 1, 1, 3, 1, 1, 4]
    df = spark.createDataFrame(list(enumerate(counts)), "idx long, n_windows int")
    want = []
    for start in range(0, len(counts), batch):
        docs = range(start, min(start + batch, len(counts)))
        want += [(d, w) for d in docs for w in range(counts[d])][: len(docs)]
    got = W.chunk_cap(df, "idx", batch).collect()
    assert sorted((r["idx"], r["win"]) for r in got) == want


def test_masks(spark):
    df = W.pad_static(W.model_inputs(W.token_windows(frame_of(spark, [0, 1, 40, 2000, 3000]))), 512)
    keys = ["doc_id", "win"]
    plan = {(r["doc_id"], r["win"], r["pos"]): r for r in M.mask_plan(df, keys, 600).collect()}
    masked = {(r["doc_id"], r["win"]): r for r in M.mask_for_training(df, keys, 600).collect()}
    original = {(r["doc_id"], r["win"]): r["input_ids"] for r in df.collect()}
    for key, ids in original.items():
        for pos, token in enumerate(ids):
            step = plan.get((*key, pos))
            assert masked[key]["labels"][pos] == (step["label"] if step else K.IGNORE)
            assert masked[key]["input_ids"][pos] == (step["new_id"] if step else token)
            if step:
                assert token == step["label"] and token not in (K.SPECIALS.pad, K.SPECIALS.cls, K.SPECIALS.sep)
    rates = M.mask_rates(df, keys).first()
    assert rates["n_chosen"] == len(plan)
    assert 0.13 < rates["n_chosen"] / rates["n_maskable"] < 0.17
    assert 0.75 < rates["n_mask"] / rates["n_chosen"] < 0.85
    other = M.mask_plan(df, keys, 600, epoch=1).count()
    assert other != len(plan) or {(r["doc_id"], r["win"], r["pos"]) for r in M.mask_plan(df, keys, 600, epoch=1).collect()} != set(plan)


def test_expansion_masks_one_position(spark):
    df = W.truncate_first(frame_of(spark, [0, 1, 5]))
    rows = M.expand_masks(df, ["doc_id"]).collect()
    assert len(rows) == 6
    texts = {r["doc_id"]: r["input_ids"] for r in df.collect()}
    for row in rows:
        restored = list(row["masked_ids"])
        assert restored[row["pos"]] == K.SPECIALS.mask
        restored[row["pos"]] = row["label"]
        assert restored == texts[row["doc_id"]]
