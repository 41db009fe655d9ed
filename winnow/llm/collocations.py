"""Phrases whose words keep together, counted by tries over the whole corpus, level by level.

Words that are frequent in their language get numbers, most frequent first, and
the corpus is written once as runs of these numbers (0: a break, or a word too
rare to be part of any frequent phrase). Phrases of k words are found in
three passes over the numbers, given the frequent ones of k - 1:

1. A place can start a phrase only if phrases of k - 1 words start there and
   at the next word (Apriori). What such places hold is counted by 32-bit hash,
   so all phrases behind a hash that is too rare are out.
2. The distinct phrases behind the others are the candidates.
3. The candidates make a double-array trie, which is broadcast. A task moves
   the states of all its places one word on at once, level by level, and counts
   the accepting ones; the counts of all shards of the corpus are summed.

Vocabulary and candidates are handled in pieces of bounded size, each broadcast
by itself, so neither the driver nor a worker holds more than one piece of a
level at a time while it is made; there is no limit to the number of pieces.

Nulls and oddities: a null text is empty, a null language `und`; rows that
repeat count again; ids aren't read; an empty table gives no rows. Texts of any
length are read whole, and other columns of the input aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from winnow.llm.common import numbered_rows, stored, text_or_empty

LONGEST = 5
LEAST = 100
TOP = 2000
# Words, and phrases, of one broadcast piece.
WORDS_TOGETHER = 500_000
PHRASES_TOGETHER = 1_000_000
# Words counted in a task, places counted, and words of a row of numbers, before they're written.
COUNTED_TOGETHER = 250_000
KEYS_TOGETHER = 600_000
CODES_TOGETHER = 65_536
# Bytes of the numbers for each block of keys that is summed in one task.
PLACES_TOGETHER = 4_000_000
_BREAK = b"\xff"
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + 10 * _BREAK
)


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, with breaks between pieces."""
    return text.translate(_PLAIN).replace(_BREAK, b" " + _BREAK + b" ").split()


@dataclass
class Trie:
    """Moves (state, word) to the state behind it: a cell is the state's base and the word's number.

    `check` names the state that a cell belongs to. 0 is no state.
    """

    base: np.ndarray
    check: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, states: np.ndarray, words: np.ndarray, targets: np.ndarray, most: int) -> Trie:
        """A trie of the given moves; states go up to `most`."""
        order = np.lexsort((words, states))
        states, words, targets = states[order], words[order], targets[order]
        first = np.flatnonzero(np.diff(states, prepend=-1))
        size = np.diff(np.append(first, len(states)))
        width = int(words.max(initial=0)) + 1
        used = np.zeros(width + 2 * len(states) + 64, bool)
        base = np.zeros(most + 1, np.int32)
        draw = np.random.default_rng(0)
        several = np.flatnonzero(size > 1)
        for group in several[np.argsort(-size[several], kind="stable")]:
            own = words[first[group] : first[group] + size[group]]
            tries = draw.integers(0, len(used) - width + 1, 32)
            free = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
            if len(free):
                at = int(tries[free[0]])
            else:
                at = len(used)
                used = np.append(used, np.zeros(width + len(used) // 4, bool))
            used[at + own] = True
            base[states[first[group]]] = at
        alone = first[size == 1]
        room = np.flatnonzero(~used)[: len(alone)]
        base[states[alone]] = room - words[alone]
        check, target = np.zeros(len(used), np.int32), np.zeros(len(used), np.int32)
        cells = base[states] + words
        check[cells], target[cells] = states, targets
        return cls(base, check, target)

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        cells = self.base[states] + words
        inside = (cells >= 0) & (cells < len(self.check))
        cells[~inside] = 0
        return np.where(inside & (self.check[cells] == states), self.target[cells], 0)

    def keep(self, frequent: np.ndarray) -> None:
        """Forget the moves to states that aren't frequent, and the room they took."""
        cells = np.flatnonzero((self.target > 0) & np.isin(self.target, frequent))
        states = self.check[cells]
        made = Trie.of(states, cells - self.base[states], self.target[cells], len(self.base) - 1)
        self.base, self.check, self.target = made.base, made.check, made.target


Levels = list[list[Trie]]


def advance(codes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(places, states) where a phrase of all levels starts; the first level is the word's own number."""
    at = np.flatnonzero(codes)
    states = codes[at]
    padded = np.append(codes, np.zeros(len(levels) + 1, codes.dtype))
    for step, tries in enumerate(levels, 1):
        words, behind = padded[at + step], np.zeros(len(at), np.int32)
        for trie in tries:
            behind = np.maximum(behind, trie.step(states, words))
        live = behind > 0
        at, states = at[live], behind[live]
    return at, states


def safe(codes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase without its last word, last word, phrase without its first) at each place that is Apriori-safe."""
    at, states = advance(codes, levels)
    following = np.zeros(len(codes) + 1, np.int32)
    following[at] = states
    rest = following[at + 1]
    live = rest > 0
    at = at[live]
    return states[live], codes[at + len(levels) + 1], rest[live]


def hashes(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """32 bits of each pair."""
    mixed = (first.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sums of their counts."""
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column("codes"):
            yield np.frombuffer(row.as_buffer(), np.int32)


def _words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of frequent words, and a null word with the count of all per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                counts.pop(_BREAK, None)
                words, n = [*counts, None], [*counts.values(), sum(counts.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"]
                )
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, found.values())) > COUNTED_TOGETHER:
                yield from out()
        yield from out()

    counted = docs.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")


def _encoded(docs: DataFrame, vocabulary: DataFrame, pieces: int) -> DataFrame:
    """(lang, codes): the corpus as numbers; one pass of the texts, then one of the words still unknown per further piece."""
    spark = docs.sparkSession
    rows = docs
    for piece in range(pieces):
        known: dict[str, dict[bytes, int]] = {}
        own = vocabulary.filter(F.col("id").between(piece * WORDS_TOGETHER + 1, (piece + 1) * WORDS_TOGETHER))
        for lang, word, number in zip(*own.select("lang", "word", "id").toArrow().to_pydict().values(), strict=True):
            known.setdefault(lang, {_BREAK: 0})[word] = number
        sent, last = spark.sparkContext.broadcast(known), piece == pieces - 1
        rows = stored(rows.mapInArrow(_encoder(sent, last, piece == 0), "lang string, codes binary, unknown binary"), "codes")
        sent.unpersist()
    return rows


def _encoder(sent, last: bool, texts: bool) -> Callable:
    def found(words: list[bytes], lang: str) -> np.ndarray:
        known = sent.value.get(lang, {_BREAK: 0})
        return np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))

    def row(lang: str, codes: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        """`words` are those of the places that hold -1."""
        if last:
            codes = np.maximum(codes, 0)
            words = []
        live = codes != 0
        codes = codes[live | np.append(False, live[:-1])]  # breaks that follow breaks say nothing
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([np.append(codes, 0).astype(np.int32).tobytes()], pa.binary()), pa.array([b" ".join(words)], pa.binary())],
            names=["lang", "codes", "unknown"],
        )

    def of_words(lang: str, words: list[bytes]) -> pa.RecordBatch:
        codes = found(words, lang)
        return row(lang, codes, [] if last else [words[i] for i in np.flatnonzero(codes < 0)])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = held.setdefault(lang, [])
                words += words_of(text.as_py())
                words.append(_BREAK)
                if len(words) > CODES_TOGETHER:
                    yield of_words(lang, held.pop(lang))
        for lang, words in held.items():
            yield of_words(lang, words)

    def of_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, unknown in zip(batch.column("lang").to_pylist(), batch.column("codes"), batch.column("unknown"), strict=True):
                codes, words = np.frombuffer(codes.as_buffer(), np.int32).copy(), unknown.as_py().split()
                got = found(words, lang)
                codes[codes < 0] = got
                yield row(lang, codes, [words[i] for i in np.flatnonzero(got < 0)])

    return of_texts if texts else of_rest


def _opened(levels) -> Levels:
    return [[piece.value for piece in level] for level in levels]


Counted = Iterator[tuple[np.ndarray, np.ndarray]]


def _shards_summed(codes: DataFrame, blocks: int, count: Callable[[Iterator[np.ndarray]], Counted], least: int) -> DataFrame:
    """(key, n) with n >= least: what a task counts in its shard of the corpus, summed over all shards.

    A task gives its keys and counts as arrays, one pair for each block of keys
    that it holds any of, and a block's arrays are added up in one task. All
    tasks together give no more keys than the corpus has places, and blocks are
    as many as keep a block's share of those small.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in count(_numbers(batches)):
            if not len(keys):
                continue
            block = (keys % blocks).astype(np.int32)
            order = np.argsort(block, kind="stable")
            keys, counts, block = keys[order].astype(np.int64), counts[order].astype(np.int64), block[order]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(starts[1:], len(block))
            parts = list(zip(starts.tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[starts]),
                    pa.array([keys[i:j].tobytes() for i, j in parts], pa.binary()),
                    pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in parts], pa.binary()),
                ],
                names=["block", "keys", "counts"],
            )

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        keys, sums = _summed([(np.frombuffer(b"".join(frame["keys"]), np.int64), np.frombuffer(b"".join(frame["counts"]), np.uint32).astype(np.int64))])
        often = sums >= least
        return pd.DataFrame({"key": keys[often], "n": sums[often]})

    rows = codes.mapInArrow(packed, "block int, keys binary, counts binary")
    return rows.groupBy("block").applyInPandas(added, "key long, n long")


def _together(found: Counted) -> Counted:
    """Distinct keys with their sums, of about `KEYS_TOGETHER` keys at a time."""
    parts, size = [], 0
    for keys, counts in found:
        parts.append((keys, counts))
        size += len(keys)
        if size > 2 * KEYS_TOGETHER:
            parts = [_summed(parts)]
            size = len(parts[0][0])
            if size > KEYS_TOGETHER:
                yield parts.pop()
                size = 0
    if parts:
        yield _summed(parts)


def _buckets(codes: DataFrame, blocks: int, levels, least: int, k: int) -> DataFrame:
    """(key) of the 32-bit hashes that hold `least` places or more."""

    def count(shard: Iterator[np.ndarray]) -> Counted:
        tries = _opened(levels)

        def held() -> Counted:
            for numbers in shard:
                first, _, rest = safe(numbers, tries)
                found = hashes(first, rest).astype(np.int64)
                yield found, np.ones(len(found), np.int64)

        yield from _together(held())

    return stored(_shards_summed(codes, blocks, count, least).select("key"), f"buckets-{k}")


def _candidates(codes: DataFrame, blocks: int, levels, buckets: np.ndarray, shorter: DataFrame, before: int) -> DataFrame:
    """(first, rest, word, id) of all safe phrases in the buckets, numbered from `before` + 1; `word` is the last one."""
    sent = codes.sparkSession.sparkContext.broadcast(np.sort(buckets.astype(np.uint64)))

    def find(shard: Iterator[np.ndarray]) -> Counted:
        tries, wanted = _opened(levels), sent.value

        def held() -> Counted:
            for numbers in shard:
                first, _, rest = safe(numbers, tries)
                hashed = hashes(first, rest)
                hit = wanted[np.searchsorted(wanted, hashed).clip(max=len(wanted) - 1)] == hashed
                keys = first[hit].astype(np.int64) << 32 | rest[hit]
                yield keys, np.ones(len(keys), np.int64)

        yield from _together(held())

    key = F.col("key")
    split = _shards_summed(codes, blocks, find, 1).select(
        F.shiftright(key, 32).cast("int").alias("first"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("rest")
    )
    rows = split.join(shorter.select(F.col("id").alias("rest"), "word"), "rest").select("first", "rest", "word")
    numbered = numbered_rows(rows, [F.col("first"), F.col("word")], "id")
    return stored(numbered.withColumn("id", (F.col("id") + 1 + before).cast("int")), "candidates")


def _counted(codes: DataFrame, blocks: int, levels, trie, before: int, size: int, least: int) -> DataFrame:
    """(id, n) of the piece's candidates that occur `least` times or more: the accepting states of all places, counted."""

    def count(shard: Iterator[np.ndarray]) -> Counted:
        tries, sums = [*_opened(levels), [trie.value]], np.zeros(size + 1, np.int64)
        for numbers in shard:
            _, states = advance(numbers, tries)
            sums += np.bincount(states - before, minlength=size + 1)
        ids = np.flatnonzero(sums)
        yield ids + before, sums[ids]

    return _shards_summed(codes, blocks, count, least).select(F.col("key").cast("int").alias("id"), "n")


def _column(rows: DataFrame, *names: str) -> list[np.ndarray]:
    table = rows.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, together: int = PHRASES_TOGETHER) -> list[DataFrame]:
    """Of each length from 1 on: (id, word, lang, phrase, a, n, heads, tails), from 2 on with `first` and `rest`.

    `word` is the last one's number, `first` and `rest` are the phrases without
    the last and without the first word. `heads` are the counts of the phrase's first 1, 2, ... words and `tails`
    those of its words from the 1st, 2nd, ... on; `n` counts the words of the
    language.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    counted = _words(docs, least)
    totals = counted.filter("word IS NULL").select("lang", F.col("n").alias("total"))
    ordered = numbered_rows(counted.filter("word IS NOT NULL"), [F.desc("n"), F.col("lang"), F.col("word")], "id")
    vocabulary = stored(ordered.withColumn("id", (F.col("id") + 1).cast("int")), "vocabulary")
    size = vocabulary.count()
    codes = _encoded(docs, vocabulary, max(1, -(-size // WORDS_TOGETHER)))
    found = [
        stored(
            vocabulary.join(totals, "lang").select(
                "id",
                F.col("id").alias("word"),
                "lang",
                F.col("word").cast("string").alias("phrase"),
                F.col("n").alias("a"),
                F.col("total").alias("n"),
                F.array("n").alias("heads"),
                F.array("n").alias("tails"),
            ),
            "phrases-1",
        )
    ]
    places = codes.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    blocks = max(64, places // PLACES_TOGETHER)
    levels: list[list] = []
    for k in range(2, longest + 1):
        buckets = _buckets(codes, blocks, levels, least, k)
        pieces = -(-buckets.count() // together)
        level, ids, rows = [], 0, []
        for piece in range(pieces):
            (own,) = _column(buckets.filter(F.col("key") % pieces == piece), "key")
            if not len(own):
                continue
            candidates = _candidates(codes, blocks, levels, own, found[-1], ids)
            first, word, number = _column(candidates, "first", "word", "id")
            trie = Trie.of(first, word, number, size)
            sent = spark.sparkContext.broadcast(trie)
            counts = stored(_counted(codes, blocks, levels, sent, ids, len(number), least), f"counts-{k}")
            sent.unpersist()
            trie.keep(_column(counts, "id")[0])
            level.append(spark.sparkContext.broadcast(trie))
            rows.append(candidates.join(counts, "id"))
            ids += len(number)
        if not rows:
            break
        levels.append(level)
        size = ids
        found.append(stored(_joined(rows, found[0], found[-1]), f"phrases-{k}"))
    return found


def _joined(pieces: list[DataFrame], words: DataFrame, shorter: DataFrame) -> DataFrame:
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    head = shorter.select(F.col("id").alias("first"), "lang", "phrase", F.col("n").alias("total"), "heads")
    tail = shorter.select(F.col("id").alias("rest"), "tails")
    last = words.select(F.col("id").alias("word"), F.col("phrase").alias("last"))
    return (
        rows.join(head, "first")
        .join(tail, "rest")
        .join(last, "word")
        .select(
            "id",
            "first",
            "rest",
            "word",
            "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"),
            F.col("n").alias("a"),
            F.col("total").alias("n"),
            F.concat("heads", F.array("n")).alias("heads"),
            F.concat(F.array("n"), "tails").alias("tails"),
        )
    )


def _weakest_cut(k: int) -> Column:
    """The lowest-scoring cut as (score, place, l, r); sums of up to 38 digits are exact."""

    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    cuts = []
    for place in range(1, k):
        l, r = F.element_at("heads", place), F.element_at("tails", place + 1)
        above = (wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
        below = (wide(l) * wide(r)).cast("decimal(38,0)")
        score = F.call_function("div", above, below)
        cuts.append(F.struct(score.alias("score"), F.lit(place).alias("place"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, together: int = PHRASES_TOGETHER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases (None: all), by score.

    Ties go to the more frequent phrase, then to the first in the order of its
    UTF-8 bytes. A phrase is left out if a longer one holds all its occurrences.
    """
    found = frequent_phrases(docs, least, longest, together)
    empty = "lang string, phrase string, a long, l long, r long, n long, score long"
    kept = docs.sparkSession.createDataFrame([], empty)
    for k, phrases in enumerate(found[1:], 2):
        if k < len(found):
            longer = found[k]
            inside = longer.select(F.col("first").alias("id"), "a").unionByName(longer.select(F.col("rest").alias("id"), "a"))
            inside = inside.groupBy("id").agg(F.max("a").alias("held"))
            phrases = phrases.join(inside, "id", "left").filter("held IS NULL OR held < a")
        cut = phrases.withColumn("cut", _weakest_cut(k))
        kept = kept.unionByName(cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
