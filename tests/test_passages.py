"""Shared passages against a definition gram by gram."""

import random
import re

import pytest

from maskloom.operators import passages

DOCS, ITEMS = "doc_id long, text string, start string, _key long", "item_id long, text string, n_words int"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^ \t-\r]+", lower)


def grams_of(text, n):
    words = words_of(text)
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def runs_of(found):
    """(start, length) of each run of consecutive places."""
    runs = []
    for at in sorted(found):
        if runs and runs[-1][0] + runs[-1][1] == at:
            runs[-1][1] += 1
        else:
            runs.append([at, 1])
    return runs


def by_hand(docs, items, n, least):
    first = {}
    for item, text in items:
        for gram in grams_of(text, n):
            first[gram] = min(first.get(gram, item), item)
    rows, leaked = [], set()
    for key, text in docs:
        grams = grams_of(text, n)
        for start, length in runs_of(i for i, g in enumerate(grams) if g in first):
            if length + n - 1 >= least:
                rows.append((key, start, length + n - 1, first[grams[start]]))
                leaked.update(grams[start : start + length])
    counts = []
    for item, text in items:
        grams = grams_of(text, n)
        runs = runs_of(i for i, g in enumerate(grams) if g in leaked)
        counts.append((item, len(grams), sum(r[1] for r in runs), max((r[1] + n - 1 for r in runs), default=0)))
    return sorted(rows), sorted(counts)


def some_tables(seed):
    """Texts of few words, so that grams repeat and passages are tiled from several items."""
    pick = random.Random(seed)

    def text(n, letters):
        return "".join(pick.choice(letters) + pick.choice([" ", "\n", "\t ", " "]) for _ in range(n))

    items = [(i, text(pick.randrange(0, 40), "abC")) for i in range(12)] + [(20, None), (21, ""), (22, "a b")]
    docs = [(i, text(pick.randrange(0, 120), pick.choice(["abc", "abcdefg"]))) for i in range(40)]
    docs += [(50 + i, docs[3][1]) for i in range(5)]  # copies
    docs += [(60, items[4][1]), (61, "É " + items[5][1].upper()), (62, None), (63, ""), (64, " \n ")]
    return docs, items


@pytest.mark.parametrize("seed,n,least", [(1, 3, 6), (2, 5, 5), (3, 1, 4), (4, 4, 9)])
def test_passages_by_definition(spark, monkeypatch, seed, n, least):
    docs, items = some_tables(seed)
    if seed == 4:  # too many grams to broadcast
        monkeypatch.setattr(passages, "_FEW", 1)
    ours = spark.createDataFrame([(k, t, "x", 0) for k, t in docs] + [(None, items[4][1], "x", 0)], DOCS)
    theirs = spark.createDataFrame([(k, t, 1) for k, t in items], ITEMS)
    found = passages.shared_passages(ours, theirs, gram=n, least=least)
    rows, counts = by_hand(docs, items, n, least)
    assert rows
    assert sorted(tuple(r) for r in found.collect()) == rows
    assert sorted(tuple(r) for r in passages.leaked_items(ours, theirs, found, gram=n).collect()) == counts


def test_passages_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e", 1)], ITEMS)
    found = passages.shared_passages(none, one, gram=2, least=3)
    assert found.collect() == []
    assert [tuple(r) for r in passages.leaked_items(none, one, found, gram=2).collect()] == [(1, 4, 0, 0)]
    docs = spark.createDataFrame([(1, "a b c d e", "x", 0)], DOCS)
    assert passages.shared_passages(docs, one.limit(0), gram=2, least=3).collect() == []


def test_every_planted_passage_is_found(spark):
    """A passage of 13 words in the middle of long texts, one text of 100,000 words, and a passage all rows hold."""
    pick = random.Random(5)
    planted = [" ".join(f"p{i}x{j}" for j in range(13)) for i in range(20)]

    def noise(n):
        return " ".join(str(pick.randrange(10**9)) for _ in range(n))

    items = [(i, f"{noise(i)} {p} {noise(3)}", 1) for i, p in enumerate(planted)]
    docs = [(i, f"{noise(7 * i)} {planted[i % 20]} {noise(i)} {planted[0]}", "x", 0) for i in range(60)]
    docs.append((99, f"{noise(100_000)} {planted[7]}", "x", 0))
    found = passages.shared_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    rows = {(r["doc_id"], r["item"]): r["n_words"] for r in found.collect()}
    assert rows == {**{(i, i % 20): 13 for i in range(60)}, **{(i, 0): 13 for i in range(60)}, (99, 7): 13}


def test_sizes_that_make_no_sense_are_refused(spark):
    one = spark.createDataFrame([(1, "a", 1)], ITEMS)
    with pytest.raises(ValueError):
        passages.shared_passages(one.withColumnRenamed("item_id", "doc_id"), one, gram=5, least=4)
