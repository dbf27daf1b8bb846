"""Draws side by side and rows expanded by slices: the same results as one by one."""

import hashlib

import numpy as np

from maskloom.functions import draws
from maskloom.operators import masking


def test_draws_side_by_side():
    prefixes = [b"", b"42:0:7:", b"x" * 50]
    rows, positions = np.repeat([0, 1, 2], 1200), np.tile(np.arange(1200), 3)
    for known in (prefixes, [*prefixes, b"y" * 60]):
        got = draws.draws_at(known, rows, positions)
        want = [hashlib.md5(known[r] + str(p).encode()).hexdigest() for r, p in zip(rows, positions)]
        assert ["".join(f"{n:08x}" for n in line) for line in got.tolist()] == want


def test_masks_by_the_drawn_hex_digits(spark):
    windows = [(7, 0, list(range(2, 302))), (8, 1, [2, 3]), (None, 0, [2, 9, 9, 3]), (9, 0, None)]
    df = spark.createDataFrame(windows, "doc_id long, win int, input_ids array<int>")
    want, masked, labels = [], list(windows[0][2]), [-100] * 300
    for pos in range(1, 299):
        hexed = hashlib.md5(f"42:0:7:0:{pos}".encode()).hexdigest()
        if hexed[:8] < draws.threshold(0.15, 8):
            share = [hexed[8:16] < draws.threshold(p, 8) for p in (0.8, 0.9)]
            action = "mask" if share[0] else "random" if share[1] else "keep"
            new = {"mask": 4, "random": int(hexed[16:24], 16) % 500, "keep": masked[pos]}[action]
            want.append((7, 0, pos, masked[pos], action, new))
            labels[pos], masked[pos] = masked[pos], new
    keys = ["doc_id", "win"]
    assert sorted(map(tuple, masking.mask_plan(df, keys, 500).collect())) == want
    trained = {r["doc_id"]: (r["input_ids"], r["labels"]) for r in masking.mask_for_training(df, keys, 500).collect()}
    assert trained == {7: (masked, labels), 8: ([2, 3], [-100] * 2), None: ([2, 9, 9, 3], [-100] * 4), 9: (None, None)}
    rates = masking.mask_rates(df, keys).first()
    assert (rates["n_maskable"], rates["n_chosen"]) == (298, len(want))


def test_expanded_rows(spark):
    df = spark.createDataFrame([(1, [2, 5, 6, 3]), (2, [2, 3])], "k int, input_ids array<int>")
    rows = sorted(map(tuple, masking.expand_masks(df, ["k"]).collect()))
    assert rows == [(1, 1, 5, [2, 4, 6, 3]), (1, 2, 6, [2, 5, 4, 3])]
