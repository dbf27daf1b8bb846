"""Training keeps little for a word, and deals out what grows with the corpus."""

import random
import threading
import tracemalloc

import pytest

from maskloom.operators import together

LETTERS = [chr(97 + i) for i in range(26)]


def random_words(n, seed=7):
    draw = random.Random(seed)
    return [([draw.randrange(26) for _ in range(draw.randint(8, 14))], draw.randint(1, 9)) for _ in range(n)]


def held_bytes(n, start, continuation):
    """The most memory that a task holds while it learns from n words, the words it is given left out."""
    given = random_words(n)
    tracemalloc.start()
    try:
        own = together.Words()
        for symbols, count in given:
            own.add(symbols, count)
        together.learn_merges(own, start, [], len(start) + 150, 2, continuation, 10**6, lambda message: [message])
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks far smaller than the words, so that what they take once does not count."""
    for name in ("BLOCK", "CHANGES"):
        monkeypatch.setattr(together, name, 1 << 12, raising=False)


def test_a_word_takes_few_bytes(small_blocks):
    assert held_bytes(20_000, LETTERS, "") - held_bytes(10_000, LETTERS, "") < 10_000 * 120


def learn_in_threads(folder, parts, size, names=LETTERS):
    """Merges that each of several tasks finds, with the mail and the pairs of each."""
    found, mails, rankings = {}, {}, {}

    def work(task):
        own = together.Words()
        for symbols, count in parts[task]:
            own.add(symbols, count)
        mails[task] = together.Mail(str(folder), task, len(parts))
        rankings[task] = together.Ranking()
        found[task] = together.learn_merges(own, names, [], size, 2, "", 10**6, mails[task], rankings[task])

    threads = [threading.Thread(target=work, args=(task,)) for task in range(len(parts))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(120)
    return found, rankings


@pytest.mark.parametrize("named", [0, 2048])
def test_tasks_own_parts_of_the_pairs(tmp_path, monkeypatch, named):
    monkeypatch.setattr(together, "BEST", named)
    words = random_words(3_000)
    alone = together.Words()
    for symbols, count in words:
        alone.add(symbols, count)
    merges, _ = together.learn_merges(alone, LETTERS, [], 400, 2, "", 10**6, lambda message: [message])
    found, rankings = learn_in_threads(tmp_path, [words[task::3] for task in range(3)], 400)
    assert [found[task][0] for task in range(3)] == [merges] * 3
    held = [set(rankings[task].codes[rankings[task].counts > 0].tolist()) for task in range(3)]
    assert not held[0] & held[1] and not held[1] & held[2] and not held[0] & held[2]
    pairs = alone.pair_counts()[0]
    assert set.union(*held) == set(pairs.tolist())
    assert max(map(len, held)) < len(pairs) / 2


def test_a_word_with_continuations_takes_few_bytes(small_blocks):
    start = [*LETTERS, *["##" + letter for letter in LETTERS]]
    assert held_bytes(20_000, start, "##") - held_bytes(10_000, start, "##") < 10_000 * 120


@pytest.mark.parametrize("kind", ["uint16", "uint32"])
def test_kept_words_go_on_where_they_ended(tmp_path, kind):
    import numpy as np

    kind = getattr(np, kind)
    own, ranking = together.Words(kind), together.Ranking()
    for symbols, count in random_words(2_000):
        own.add(symbols, count)
    whole = together.Words()
    for symbols, count in random_words(2_000):
        whole.add(symbols, count)
    want, _ = together.learn_merges(whole, LETTERS, [], 300, 2, "", 10**6, lambda message: [message])
    first, _ = together.learn_merges(own, LETTERS, [], 300, 2, "", 40, lambda message: [message], ranking)
    together._keep(str(tmp_path / "words"), own, ranking)
    words, counts = together._kept(str(tmp_path / "words"), kind)
    names = list(LETTERS)
    for left, right in first:
        if names[left] + names[right] not in names:
            names.append(names[left] + names[right])
    second, _ = together.learn_merges(words, names, [], 300, 2, "", 10**6, lambda message: [message], counts)
    assert first + second == want and 40 <= len(first) < len(want)
    assert [p.name for p in tmp_path.iterdir()] == ["words"]


def test_a_task_reads_what_is_meant_for_it(tmp_path):
    heard = {}

    def work(task):
        mail = together.Mail(str(tmp_path), task, 3)
        for turn in range(5):
            dealt = mail.deal([f"{turn} {task} to {other}".encode() for other in range(3)])
            heard[turn, task] = sorted(dealt), sorted(mail(f"{turn} {task}".encode()))

    threads = [threading.Thread(target=work, args=(task,)) for task in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(60)
    for (turn, task), (dealt, told) in heard.items():
        assert dealt == [f"{turn} {other} to {task}".encode() for other in range(3)]
        assert told == [f"{turn} {other}".encode() for other in range(3)]
    assert len(heard) == 15 and len(list(tmp_path.iterdir())) == 3
