"""Byte-pair merging against a plain version."""

import random

import numpy as np
import pytest

from maskloom.functions.bytepairs import SHORT, BatchMerger, merge_pairs, merge_table


def plain(ids, ranks):
    ids = list(ids)
    while len(ids) > 1:
        found = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            break
        (_, merged), i = min(found)
        ids[i : i + 2] = [merged]
    return ids


@pytest.fixture(scope="module")
def table():
    rng = random.Random(7)
    rules, known = [], list(range(6))
    for merged in range(6, 60):
        pair = (rng.choice(known), rng.choice(known))
        if pair not in {(a, b) for a, b, _ in rules}:
            rules.append((*pair, merged))
            known.append(merged)
    return rules


def test_all_ways_agree(table):
    rng = random.Random(8)
    merges = merge_table(table)
    ranks = {(a, b): (i, m) for i, (a, b, m) in enumerate(table)}
    pieces = [[rng.randrange(6) for _ in range(n)] for n in [*range(70), *[rng.randrange(30) for _ in range(400)]]]
    pieces += [[0] * n for n in (1, 2, 3, SHORT, SHORT + 1, 300)]
    want = [plain(p, ranks) for p in pieces]
    assert [merge_pairs(p, merges) for p in pieces] == want
    flat = np.array([x for p in pieces for x in p])
    ids, counts = BatchMerger(merges).merge(flat, np.array([len(p) for p in pieces]))
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_nothing_to_merge(table):
    ids, counts = BatchMerger(merge_table(table)).merge(np.zeros(0, int), np.zeros(0, int))
    assert len(ids) == len(counts) == 0
    ids, counts = BatchMerger({}).merge(np.array([1, 2, 3]), np.array([2, 1]))
    assert ids.tolist() == [1, 2, 3] and counts.tolist() == [2, 1]


def test_long_piece_is_quick():
    merges = merge_table([(0, 0, 1), (1, 1, 2), (2, 2, 3)])
    assert merge_pairs([0] * 100_003, merges) == [3] * 12_500 + [1, 0]
