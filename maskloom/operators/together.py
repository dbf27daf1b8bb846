"""Vocabulary training in one stage: tasks hold their share of the words and exchange changes of pair counts.

Each task keeps its words as numbers in a few arrays, some two bytes a letter, and owns the counts of its share of the
pairs. A round takes the longest run of best pairs whose merges do not disturb each other; each task looks for them in
its arrays and merges them; then every change of a pair's count is sent to the task that owns the pair, and the owners
tell all tasks their best pairs. So a round is one pass over small arrays, and no Spark job.

The changes go through files in the folder that all executors share (``spark.checkpoint.dir``), because ``allGather`` of
a barrier stage takes a second at least. A file is written under another name and renamed, so it is whole when it is
seen, and it is deleted when all have read it.

A task holds distinct words, never occurrences, and no list of the words of a pair; the table of pairs is dealt out over
the tasks as the words are. ``tasks`` bounds how many tasks talk to each other.
A barrier stage starts anew when one of its tasks is lost. Training goes in legs, whose merges are brought to the driver
and whose words are kept in the shared folder, so a lost executor costs one leg.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.operators import vocabulary as V
from maskloom.session import materialise, scratch_path
from maskloom.sources.files import file_system

LEG = 10_000
TASKS = 64
PATIENCE = 1800  # seconds without a sign of another task before a task gives up
BLOCK = 1 << 18  # letters of words that are looked at together
CHANGES = 1 << 18  # changes that a task gathers before it adds up those of the same pair
BEST = 2048  # pairs that the tasks name together in a round
GAP = 0  # stands around words; a token is its id and one more


class Mail:
    """Messages of all tasks to all tasks, round by round."""

    def __init__(self, path: str, task: int, tasks: int):
        self.system, self.place = file_system(path)
        self.task, self.tasks, self.round = task, tasks, 0
        self.system.create_dir(self.place, recursive=True)

    def _file(self, number: int, task: int) -> str:
        return f"{self.place}/{number}-{task}"

    def __call__(self, message: bytes) -> list[bytes]:
        """The same message to all tasks; what all of them have sent."""
        return self._exchange([message], 0)

    def deal(self, messages: Sequence[bytes]) -> list[bytes]:
        """A message to each task; what all of them have sent to this one."""
        return self._exchange(messages, self.task)

    def _exchange(self, messages: Sequence[bytes], which: int) -> list[bytes]:
        self.round += 1
        mine = self._file(self.round, self.task)
        with self.system.open_output_stream(f"{mine}.draft") as out:
            out.write(np.cumsum([0, *map(len, messages)]).tobytes())
            for message in messages:
                out.write(message)
        self.system.move(f"{mine}.draft", mine)
        heard, missing = [messages[which]], [t for t in range(self.tasks) if t != self.task]
        head = 8 * (len(messages) + 1)
        pause, end = 0.0005, time.time() + PATIENCE
        while missing:
            found = self.system.get_file_info([self._file(self.round, t) for t in missing])
            for task, info in zip(list(missing), found):
                if info.is_file:
                    with self.system.open_input_file(info.path) as file:
                        starts = np.frombuffer(file.read(head), np.int64)
                        file.seek(head + int(starts[which]))
                        heard.append(file.read(int(starts[which + 1] - starts[which])))
                    missing.remove(task)
            if missing:
                if time.time() > end:
                    raise TimeoutError(f"no word from tasks {missing}")
                time.sleep(pause)
                pause = min(2 * pause, 0.02)
        # all have written this round's message, so all have read the one before
        if self.round > 1:
            self.system.delete_file(self._file(self.round - 1, self.task))
        return heard


def _code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a pair; their order is that of the pairs."""
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its counts, if that is not 0."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sums = np.add.reduceat(counts[order], starts)
    return codes[starts][sums != 0], sums[sums != 0]


class Changes:
    """Changes of pair counts, added up whenever many have come together."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.by: list[np.ndarray] = []
        self.held, self.most = 0, CHANGES

    def add(self, codes: np.ndarray, by: np.ndarray) -> None:
        self.codes.append(codes)
        self.by.append(by)
        self.held += len(codes)
        if self.held > self.most:
            self.most = max(CHANGES, 2 * len(self.total()[0]))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, by = _sums(np.concatenate(self.codes), np.concatenate(self.by))
        self.codes, self.by, self.held = [codes], [by], len(codes)
        return codes, by


class Words:
    """The words of one task: blocks of tokens with a gap before, between and after words, and the words' counts."""

    def __init__(self, kind: type = np.uint32):
        self.kind = kind
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []
        self.letters = 0

    def add(self, symbols: list[int], count: int) -> None:
        self.extend(np.array([*symbols, GAP - 1]) + 1, np.array([count]))

    def extend(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Words, each with a gap behind it."""
        self.loose.append((tokens.astype(self.kind), counts.astype(np.int64)))
        self.letters += len(tokens)
        if self.letters >= BLOCK:
            self.close()

    def close(self) -> None:
        """Make a block of what was added last."""
        if self.loose:
            tokens = [np.array([GAP], self.kind), *[t for t, _ in self.loose]]
            self.blocks.append((np.concatenate(tokens), np.concatenate([c for _, c in self.loose])))
        self.loose, self.letters = [], 0

    @staticmethod
    def _weighed(tokens: np.ndarray, gaps: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes of the pairs at the given places, without those across a gap, and the counts of their words."""
        left, right = tokens[at], tokens[at + 1]
        inside = (left != GAP) & (right != GAP)
        weights = counts[np.searchsorted(gaps, at[inside]) - 1]
        return _code(left[inside], right[inside]), weights

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        self.close()
        out = Changes()
        for tokens, counts in self.blocks:
            gaps = np.flatnonzero(tokens == GAP)
            out.add(*self._weighed(tokens, gaps, counts, np.arange(len(tokens) - 1)))
        return out.total()

    def merge(self, pairs: Sequence[tuple[int, int]], made: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Join pairs that do not disturb each other, from left to right in every word; how pair counts change."""
        self.close()
        pairs, made = np.array(pairs, np.int64) + 1, np.array(made, np.int64) + 1
        codes = _code(pairs[:, 0], pairs[:, 1])
        order = np.argsort(codes)
        codes, made = codes[order], made[order].astype(self.kind)
        # by token: bit 0 for the left ones of the pairs, bit 1 for the right ones
        sides = np.zeros(1 + self._largest(pairs), np.uint8)
        sides[pairs[:, 0]] |= 1
        sides[pairs[:, 1]] |= 2
        change = Changes()
        for i, (tokens, counts) in enumerate(self.blocks):
            at, which = self._find(tokens, pairs, sides, codes)
            if not len(at):
                continue
            gaps = np.flatnonzero(tokens == GAP)
            touched = np.zeros(len(tokens), bool)
            touched[at - 1] = touched[at] = touched[at + 1] = True
            gone, weights = self._weighed(tokens, gaps, counts, np.flatnonzero(touched))
            change.add(gone, -weights)
            tokens[at] = made[which]
            kept = np.ones(len(tokens), bool)
            kept[at + 1] = False
            tokens = tokens[kept]
            at = at - np.arange(len(at))  # each merge before has taken one token away
            gaps = np.flatnonzero(tokens == GAP)
            touched = np.zeros(len(tokens), bool)
            touched[at - 1] = touched[at] = True
            change.add(*self._weighed(tokens, gaps, counts, np.flatnonzero(touched)))
            self.blocks[i] = tokens, counts
        return change.total()

    def _largest(self, pairs: np.ndarray) -> int:
        if self.kind is np.uint16:
            return 0xFFFF
        return max([int(pairs.max()), *[int(tokens.max()) for tokens, _ in self.blocks]])

    @staticmethod
    def _find(
        tokens: np.ndarray, pairs: np.ndarray, sides: np.ndarray, codes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs begin that are to be joined, in order, and which of the codes each is."""
        if len(pairs) <= 8:
            hit = np.zeros(len(tokens) - 1, bool)
            for left, right in pairs.astype(tokens.dtype):
                hit |= (tokens[:-1] == left) & (tokens[1:] == right)
        else:
            side = sides[tokens]
            hit = (side[:-1] & 1) & (side[1:] >> 1)
        at = np.flatnonzero(hit)
        here = _code(tokens[at], tokens[at + 1])
        which = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
        same = codes[which] == here
        at, which, here = at[same], which[same], here[same]
        double = np.flatnonzero((here >> 32) == (here & 0xFFFFFFFF))
        if len(double):
            # of a row of equal tokens every second pair
            place, n = at[double], np.arange(len(double))
            first = np.concatenate([[True], place[1:] != place[:-1] + 1])
            taken = np.ones(len(at), bool)
            taken[double] = (n - np.maximum.accumulate(np.where(first, n, 0))) % 2 == 0
            at, which = at[taken], which[taken]
        return at, which


class Ranking:
    """Counts of the pairs that a task owns, best first: the highest count, then the lower ids."""

    def __init__(self):
        self.codes = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.bar = 1  # only pairs that count so much are looked at, as long as they are enough
        self.begun = False

    def change(self, codes: np.ndarray, by: np.ndarray) -> None:
        """Add to the counts; each code comes once, in order."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        self.counts[at[known]] += by[known]
        if not known.all():
            self.codes = np.insert(self.codes, at[~known], codes[~known])
            self.counts = np.insert(self.counts, at[~known], by[~known])
        here = np.count_nonzero(self.counts)
        if 4 * here < 3 * len(self.counts):
            self.codes, self.counts = self.codes[self.counts != 0], self.counts[self.counts != 0]

    def best(self, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` codes of those with a count of at least ``least``, and their counts."""
        at = np.flatnonzero(self.counts >= max(self.bar, least))
        if len(at) > 32 * most or (len(at) < most and self.bar > least):
            some = 4 * most
            self.bar = int(np.partition(self.counts, -some)[-some]) if len(self.counts) > some else least
            at = np.flatnonzero(self.counts >= max(self.bar, least))
        order = np.lexsort((self.codes[at], -self.counts[at]))[:most]
        return self.codes[at[order]], self.counts[at[order]]


def _owned(codes: np.ndarray, by: np.ndarray, exchange: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Of the changes of all tasks those of the pairs that this one owns; without ``deal`` there is one task."""
    tasks = getattr(exchange, "tasks", 1)
    if tasks == 1:
        return codes, by
    owner = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(tasks)
    parts = [np.concatenate([codes[owner == t], by[owner == t]]).tobytes() for t in range(tasks)]
    out = Changes()
    for part in exchange.deal(parts):
        out.add(*np.frombuffer(part, np.int64).reshape(2, -1))
    return out.total()


def _ranked(messages: Sequence[bytes], most: int) -> list[tuple[int, int, int]]:
    """Left, right and count of the best pairs of all tasks, as far as no task may have others in between."""
    lists = [np.frombuffer(message, np.int64).reshape(2, -1) for message in messages]
    codes, counts = np.concatenate(lists, 1)
    # the last of a full list: behind it the task has more
    last = np.concatenate([np.arange(found.shape[1]) == most - 1 for found in lists])
    order = np.lexsort((codes, -counts))
    codes, counts, last = codes[order], counts[order], last[order]
    if last.any():
        end = int(np.argmax(last)) + 1
        codes, counts = codes[:end], counts[:end]
    return list(zip(((codes >> 32) - 1).tolist(), ((codes & 0xFFFFFFFF) - 1).tolist(), counts.tolist()))


def learn_merges(
    words: Words,
    names: list[str],
    known: Sequence[tuple[int, int]],
    vocab_size: int,
    least: int,
    continuation: str,
    most: int,
    exchange: Callable[[bytes], Sequence[bytes]],
    ranking: Ranking | None = None,
) -> tuple[list[tuple[int, int]], int]:
    """The next merges after the ``known`` ones, at least ``most`` if there are so many, and the number of rounds.

    Every task calls this with its own words; ``exchange`` gives the messages of all tasks to all of them, and its
    ``deal`` those to one of them. ``ranking`` has the counts of an earlier call that ended with these words.
    """
    names, tokens = list(names), {name: i for i, name in enumerate(names)}

    def token_of(left: int, right: int) -> int:
        name = V._joined(names[left], names[right], continuation)
        if name not in tokens:
            tokens[name] = len(names)
            names.append(name)
        return tokens[name]

    for pair in known:
        words.merge([pair], [token_of(*pair)])
    ranking = Ranking() if ranking is None else ranking
    if not ranking.begun:
        ranking.change(*_owned(*words.pair_counts(), exchange))
        ranking.begun = True
    share = max(16, BEST // getattr(exchange, "tasks", 1))
    merges: list[tuple[int, int]] = []
    rounds = 0
    while len(names) < vocab_size and len(merges) < most:
        own = np.concatenate(ranking.best(share, max(least, 1))).tobytes()
        ranked = _ranked(exchange(own), share)
        chosen = V._undisturbed(ranked, names, tokens, continuation, vocab_size - len(names))
        if not chosen:
            break
        ranking.change(*_owned(*words.merge(chosen, [token_of(*pair) for pair in chosen]), exchange))
        merges += chosen
        rounds += 1
    return merges, rounds


def _keep(path: str, words: Words, ranking: Ranking) -> None:
    """Write a task's words and counts, under another name first."""
    words.close()
    system, place = file_system(path)
    arrays = [ranking.codes, ranking.counts, *[array for block in words.blocks for array in block]]
    with system.open_output_stream(f"{place}.draft") as out:
        np.lib.format.write_array(out, np.array([len(arrays), ranking.bar]))
        for array in arrays:
            np.lib.format.write_array(out, array)
    system.move(f"{place}.draft", place)


def _kept(path: str, kind: type) -> tuple[Words, Ranking]:
    system, place = file_system(path)
    words, ranking = Words(kind), Ranking()
    ranking.begun = True
    with system.open_input_stream(place) as file:
        n, ranking.bar = np.lib.format.read_array(file).tolist()
        ranking.codes, ranking.counts = (np.lib.format.read_array(file) for _ in range(2))
        words.blocks = [tuple(np.lib.format.read_array(file) for _ in range(2)) for _ in range(n // 2 - 1)]
    return words, ranking


def _drop(path: str) -> None:
    system, place = file_system(path)
    system.delete_dir(place)


def _tokens(packed: pa.Array) -> np.ndarray:
    """The tokens of words of symbols, each word with a gap behind it."""
    end = V._symbol(-1)
    text = end.join([*packed.to_pylist(), ""])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    # as _token_id does it, and one more
    return np.where(codes < 0xD800, codes, codes - 0x800) - 0xFF


def train(
    counts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    special_tokens: Sequence[str] = T.SPECIAL_TOKENS,
    continuation: str = V.CONTINUATION,
    chars: Sequence[str] | None = None,
    alphabet_limit: int = V.ALPHABET_LIMIT,
    tasks: int = TASKS,
    leg: int = LEG,
) -> V.Vocabulary:
    """The vocabulary that ``vocabulary.train`` gives, without a job for each round.

    At most ``tasks`` tasks run side by side, and no more than there are cores; the cluster must be able to run them at
    once, which a session with dynamic allocation does not promise: there use ``vocabulary.train``.
    """
    # read three times: characters, characters within words, words
    counts = materialise(counts, "word-counts")
    names = V.start_names(counts, special_tokens, continuation, chars, alphabet_limit)
    chars = sorted(chars if chars is not None else [n for n in names if len(n) == 1])
    state = V._start_state(counts, {name: i for i, name in enumerate(names)}, chars, continuation)
    state = materialise(state.groupBy("packed").agg(F.sum("cnt").alias("cnt")), "training-words")
    n_tasks = max(1, min(tasks, counts.sparkSession.sparkContext.defaultParallelism))
    dealt = state.repartition(n_tasks, "packed")
    tokens = {name: i for i, name in enumerate(names)}
    merges, rounds, all_names = [], 0, list(names)

    kind = np.uint16 if max(vocab_size, len(names)) < 0xFFFF else np.uint32
    start, earlier = dealt, None

    while len(all_names) < vocab_size:
        so_far, path = list(all_names), scratch_path(counts.sparkSession, "mail")

        def run(batches, so_far=so_far, path=path, earlier=earlier):
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            task = context.partitionId()
            # a name for this attempt of the stage, the same for all its tasks
            here = f"{path}/{context.allGather(uuid.uuid4().hex)[0]}"
            mail = Mail(here, task, n_tasks)
            words, ranking = _kept(f"{earlier}/words-{task}", kind) if earlier else (Words(kind), Ranking())
            for batch in batches:
                if not earlier:
                    words.extend(_tokens(batch.column(0)), batch.column(1).to_numpy())
            found, took = learn_merges(
                words, so_far, (), vocab_size, min_frequency, continuation, leg, mail, ranking
            )
            if len(found) >= leg:
                _keep(f"{here}/words-{task}", words, ranking)
            if task == 0:
                columns = [pa.array([p[i] for p in found], pa.int32()) for i in (0, 1)]
                at = pa.array(range(len(found)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [at, *columns, pa.array([took] * len(found), pa.int32()), pa.array([here] * len(found), pa.string())],
                    names=["at", "left", "right", "rounds", "place"],
                )

        # no more rows than tokens asked for
        rows = start.mapInArrow(run, "at int, left int, right int, rounds int, place string", barrier=True).collect()
        for row in sorted(rows, key=lambda r: r["at"]):
            left, right = row["left"], row["right"]
            name = V._joined(all_names[left], all_names[right], continuation)
            merges.append((all_names[left], all_names[right]))
            if name not in tokens:
                tokens[name] = len(all_names)
                all_names.append(name)
        rounds += rows[0]["rounds"] if rows else 0
        if earlier:
            _drop(earlier)
        earlier = rows[0]["place"] if rows else None
        if len(rows) < leg:
            break
        # the next leg reads the words as this one has left them
        start = counts.sparkSession.range(0, n_tasks, 1, n_tasks)
    if earlier:
        _drop(earlier)
    return V.Vocabulary(tokens, merges, rounds)


def train_wordpiece(df: DataFrame, vocab_size: int = 30_512, min_frequency: int = 2, text: str = "text", **options):
    """Train a WordPiece vocabulary on a text column."""
    return train(V.bert_word_counts(df, text), vocab_size, min_frequency, **options)


def train_byte_level(df: DataFrame, vocab_size: int = 30_512, min_frequency: int = 2, text: str = "text", **options):
    """Train a byte-level BPE vocabulary on a text column."""
    counts = V.word_counts(df, T.byte_level_words(F.col(text)))
    return train(counts, vocab_size, min_frequency, continuation="", chars=list(T.byte_symbols()), **options)
