"""Interpolated modified Kneser-Ney language model over pairs of words.

Spark counts; the model lies in a shared folder as sorted arrays, which the
scoring tasks map into memory. Tokens are words in ASCII lower case and one end
per text.

Layout of the folder. A vocabulary shard holds the words whose 64-bit hash
begins with the shard's number: `hashes-<s>` in order, and beside it by place
`counts`, `totals` (of the pairs that begin with the word), `ones`, `twos`,
`mores` (of these pairs, how many occur once, twice, more often) and `before`
(different words seen before it). A word's id is its place in the order of all
hashes. Pair shard k holds the pairs whose key leaves k when divided by their
number: `keys-<k>` in order and `pairs-<k>`, their counts.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import shared_folder, stored, text_or_empty

# No word holds white space, so this stands for the end of a text.
END = b"\n"
# Tokens per shard, about: what one task sorts. Words that a task remembers.
TOKENS_PER_SHARD = 6_000_000
WORDS_KEPT = 700_000
TOKENS_TOGETHER = 400_000
KEYS_TOGETHER = 4_000_000
_FACTS = ("totals", "ones", "twos", "mores", "before")


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and the few numbers that go with them."""

    folder: str
    starts: tuple[int, ...]  # first id of each vocabulary shard, and the number of words
    pair_shards: int
    tokens: int
    pairs: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float  # share of the lower order that is spread over all words and the unknown one

    @property
    def words(self) -> int:
        return self.starts[-1]


def train(docs: DataFrame, usable: Column) -> Model:
    """Count the texts of the rows for which `usable` holds; a null text is an empty one.

    Blocks of counts are sorted and packed by the tasks that read texts, and
    each shard of the model is merged and written by one task, of a size that
    doesn't grow with the corpus. The driver gets sums and the sizes of shards.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "language-model")
    texts = docs.filter(usable).select(text_or_empty().cast("binary").alias("text"))
    bits = _bits(texts)
    words = stored(texts.mapInArrow(lambda b: _count_words(b, bits), _BLOCK), "word-blocks")
    merged = words.groupBy("shard").applyInPandas(
        lambda blocks: _merge_words(blocks, folder), "shard long, size long, tokens long"
    )
    sizes = {r["shard"]: r for r in stored(merged, "word-shards").collect()}
    size = [sizes[s]["size"] if s in sizes else 0 for s in range(1 << bits)]
    starts = tuple(int(x) for x in np.cumsum([0, *size]))
    tokens = sum(r["tokens"] for r in sizes.values())
    if not tokens:
        return Model(folder, starts, 0, 0, 0, *[_discounts([0] * 4)] * 2, 1.0)
    plain = Model(folder, starts, max(1, -(-tokens // TOKENS_PER_SHARD)), tokens, 0, (0, 0, 0), (0, 0, 0), 0.0)
    pairs = stored(texts.mapInArrow(lambda b: _count_pairs(b, plain), _BLOCK), "pair-blocks")
    facts = stored(pairs.groupBy("shard").applyInPandas(lambda b: _merge_pairs(b, plain), _BLOCK), "pair-facts")
    often = _sums(facts.filter("shard < 0"), 5)
    merged = facts.filter("shard >= 0").groupBy("shard").applyInPandas(lambda b: _merge_facts(b, plain), _BLOCK)
    lower = _sums(stored(merged, "word-facts"), 5)
    d = _discounts(lower)
    spread = d[0] * lower[0] + d[1] * lower[1] + d[2] * (lower[4] - lower[0] - lower[1])
    return Model(folder, starts, plain.pair_shards, tokens, often[4], _discounts(often), d, spread / often[4])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score) of every whole text; a null text is an empty one.

    `score` is the log10 probability under the model, `base_score` that of
    single tokens with one added to every count. Tokens never seen share the
    unknown word's probability. Repeated rows score alike; an empty table gives
    no rows; a model of no texts gives probability 1 to everything.
    """
    fields = "n_tokens long, n_known long, base_score double, score double"

    @F.pandas_udf(fields)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader.of(model)
        for batch in batches:
            done = [reader.score(group) for group in _groups(batch)]
            yield pd.DataFrame(np.concatenate(done) if done else np.zeros(0, _SCORES))

    texts = text_or_empty().cast("binary")
    return docs.select(F.struct("*").alias("row"), scored(texts).alias("s")).select("row", "s.*")


_BLOCK = "shard long, payload binary"
_SCORES = np.dtype([("n_tokens", "i8"), ("n_known", "i8"), ("base_score", "f8"), ("score", "f8")])


def _bits(texts: DataFrame) -> int:
    """So many bits of hash that a vocabulary shard has some ten thousand texts to itself."""
    return max(0, int(texts.count() // 20_000).bit_length())


def tokens_of(text: bytes) -> list[bytes]:
    """Words in ASCII lower case; `bytes` parts words and lowers letters by ASCII alone."""
    words = text.lower().split()
    words.append(END)
    return words


def _groups(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    group, held = [], 0
    for text in texts:
        group.append(tokens_of(text))
        held += len(group[-1])
        if held >= TOKENS_TOGETHER:
            yield group
            group, held = [], 0
    if group:
        yield group


# Blocks: whole-number columns, the first in ascending order as differences.


def _pack(*columns: np.ndarray) -> bytes:
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(np.concatenate([first, *(c.astype(np.uint64) for c in columns[1:])]).tobytes(), 1)


def _unpack(payload: bytes, columns: int) -> list[np.ndarray]:
    parts = np.frombuffer(zlib.decompress(payload), np.uint64).reshape(columns, -1)
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:]]


def _merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Blocks' rows with equal first values summed, in order."""
    first = np.concatenate([b[0] for b in blocks])
    order = np.argsort(first, kind="stable")
    first = first[order]
    at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, int)
    rest = [np.add.reduceat(np.concatenate([b[k] for b in blocks])[order], at) for k in range(1, len(blocks[0]))]
    return [first[at], *rest]


def _rows(shards: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(payloads, pa.binary())], names=["shard", "payload"])


def _split(shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A block for each shard, rows within it in the order given."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    parts = [np.split(c[order], at[1:]) for c in columns]
    return _rows([int(s) for s in shard[order][at]], [_pack(*p) for p in zip(*parts, strict=True)])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def block() -> pa.RecordBatch:
        hashes = _hashes(list(found))
        order = np.argsort(hashes)
        counts = np.fromiter(found.values(), np.uint64, len(found))
        return _split(_shard_of(hashes[order], bits), [hashes[order], counts[order]])

    for batch in batches:
        for text in batch.column(0):
            found.update(tokens_of(text.as_py()))
            if len(found) > WORDS_KEPT:
                yield block()
                found.clear()
    if found:
        yield block()


def _merge_words(blocks: pd.DataFrame, folder: str) -> pd.DataFrame:
    shard = int(blocks["shard"].iloc[0])
    hashes, counts = _merged([_unpack(p, 2) for p in blocks["payload"]])
    _save(folder, f"hashes-{shard}", hashes, np.uint64)
    _save(folder, f"counts-{shard}", counts)
    return pd.DataFrame({"shard": [shard], "size": [len(hashes)], "tokens": [int(counts.sum())]})


def _count_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader, keys, held = Reader.of(model), [], 0

    def block() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        return _split((found % np.uint64(model.pair_shards)).astype(np.int64), [found, counts])

    for batch in batches:
        for group in _groups(t.as_py() for t in batch.column(0)):
            ids, before, _ = reader.ids(group)
            keys.append(reader.keys(before, ids))
            held += len(ids)
            if held >= KEYS_TOGETHER:
                yield block()
                keys, held = [], 0
    if keys:
        yield block()


def _merge_pairs(blocks: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Write a pair shard; hand on its counts of counts and, by vocabulary shard, facts of words."""
    shard = int(blocks["shard"].iloc[0])
    keys, counts = _merged([_unpack(p, 2) for p in blocks["payload"]])
    _save(model.folder, f"keys-{shard}", keys, np.uint64)
    _save(model.folder, f"pairs-{shard}", counts)
    often = np.array([*(int((counts == n).sum()) for n in (1, 2, 3, 4)), len(counts)])
    first, second = (x.astype(np.int64) for x in np.divmod(keys, np.uint64(model.words + 1)))
    ids, at, seen = np.unique(first, return_index=True, return_counts=True)
    sums = [np.add.reduceat(c.astype(np.int64), at) for c in (counts, counts == 1, counts == 2)]
    zero = np.zeros(len(ids), np.int64)
    begins = [ids, *sums, seen - sums[1] - sums[2], zero]
    ids, seen = np.unique(second, return_counts=True)
    ends = [ids, *[np.zeros(len(ids), np.int64)] * 4, seen]
    columns = _merged([begins, ends])
    # The start of a text has the id after the last word and lies in the last shard.
    holds = np.searchsorted(np.array(model.starts[1:]), columns[0], side="right").clip(max=len(model.starts) - 2)
    facts = _split(holds, columns).to_pandas()
    return pd.concat([facts, pd.DataFrame({"shard": [-1], "payload": [often.astype(np.uint64).tobytes()]})])


def _merge_facts(blocks: pd.DataFrame, model: Model) -> pd.DataFrame:
    shard = int(blocks["shard"].iloc[0])
    low, high = model.starts[shard], model.starts[shard + 1] + (shard == len(model.starts) - 2)
    columns = _merged([_unpack(p, 6) for p in blocks["payload"]])
    at = columns[0].astype(np.int64) - low
    for name, values in zip(_FACTS, columns[1:], strict=True):
        full = np.zeros(high - low, np.uint64)
        full[at] = values
        _save(model.folder, f"{name}-{shard}", full)
    before = columns[5]
    often = np.array([*(int((before == n).sum()) for n in (1, 2, 3, 4)), int((before > 0).sum())], np.uint64)
    return pd.DataFrame({"shard": [-1], "payload": [often.tobytes()]})


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Sums of small rows of whole numbers, one per shard."""
    parts = [np.frombuffer(r["payload"], np.uint64) for r in rows.select("payload").toLocalIterator()]
    return [int(x) for x in np.sum(parts, axis=0)] if parts else [0] * width


def _discounts(often: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many occur once to four times; 0.5, 1 and 1.5 where that can't tell."""
    n1, n2, n3, n4 = often[:4]
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(found, 1))


def _files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))


def _save(folder: str, name: str, values: np.ndarray, kind: type | None = None) -> None:
    """Write an array, in the smallest type that holds it if none is named; it gets its name once it is whole."""
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    out = io.BytesIO()
    np.save(out, values.astype(kind or np.min_scalar_type(int(values.max(initial=1)))))
    unfinished = f"{root}/unfinished-{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(unfinished, compression=None) as to:
        to.write(out.getbuffer())
    files.move(unfinished, f"{root}/{name}.npy")


class Reader:
    """A model's arrays, mapped into a worker's memory."""

    _last: Reader | None = None

    @classmethod
    def of(cls, model: Model) -> Reader:
        """The worker's reader of this model; a worker keeps one from task to task."""
        if cls._last is None or cls._last.model != model:
            cls._last = cls(model)
        return cls._last

    def __init__(self, model: Model):
        self.model, self.known, self.arrays = model, {}, {}
        files, self.root = _files(model.folder)
        self.copies = None
        if not isinstance(files, pa.fs.LocalFileSystem):
            # Only local files can be mapped; the copy goes when the worker ends.
            self.copies, self.files = tempfile.TemporaryDirectory(prefix="language-model-"), files

    def array(self, name: str) -> np.ndarray:
        if name not in self.arrays:
            path = f"{self.root}/{name}.npy"
            if self.copies is not None:
                path = f"{self.copies.name}/{name}.npy"
                with self.files.open_input_stream(f"{self.root}/{name}.npy", compression=None) as of, open(path, "wb") as to:
                    while piece := of.read(1 << 20):
                        to.write(piece)
            self.arrays[name] = np.load(path, mmap_mode="r")
        return self.arrays[name]

    def places(self, group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct words, place among them of each token, of the one before it, first places of the texts).

        The last id is that of the start of a text, -1 those of words that the model doesn't know.
        """
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        place: defaultdict[bytes, int] = defaultdict(count().__next__)
        own = np.fromiter(map(place.__getitem__, chain.from_iterable(group)), np.int64, sum(map(len, group)))
        missing = [w for w in place if w not in self.known]
        self.known.update(zip(missing, self._find(_hashes(missing)).tolist(), strict=True))
        ids = np.fromiter(map(self.known.__getitem__, place), np.int64, len(place))
        firsts = np.cumsum([0, *map(len, group[:-1])])
        before = np.roll(own, 1)
        before[firsts] = len(place)
        return np.append(ids, self.model.words), own, before, firsts

    def ids(self, group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids before, first places of the texts); -1 for words that the model doesn't know."""
        ids, own, before, firsts = self.places(group)
        return ids[own], ids[before], firsts

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        starts = self.model.starts
        shard = _shard_of(hashes, (len(starts) - 1).bit_length() - 1)
        ids = np.full(len(hashes), -1, np.int64)
        for s, at in _by(shard):
            if starts[s + 1] > starts[s]:
                found, place = _search(self.array(f"hashes-{s}"), hashes[at])
                ids[at] = np.where(found, place + starts[s], -1)
        return ids

    def keys(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return before.astype(np.uint64) * np.uint64(self.model.words + 1) + ids.astype(np.uint64)

    def facts(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A number of each word; 0 for -1."""
        out = np.zeros(len(ids))
        shard = np.searchsorted(np.array(self.model.starts[1:]), ids, side="right").clip(max=len(self.model.starts) - 2)
        for s, at in _by(np.where(ids < 0, -1, shard)):
            if s >= 0:
                out[at] = self.array(f"{name}-{s}")[ids[at] - self.model.starts[s]]
        return out

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        both = np.flatnonzero((before >= 0) & (ids >= 0))
        keys = self.keys(before[both], ids[both])
        for s, at in _by((keys % np.uint64(max(1, self.model.pair_shards))).astype(np.int64)):
            found, place = _search(self.array(f"keys-{s}"), keys[at])
            out[both[at[found]]] = self.array(f"pairs-{s}")[place[found]]
        return out

    def probabilities(self, ids: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each word after the one before it, both by their place among `ids`."""
        m = self.model
        if not m.tokens:
            return np.ones(len(own))
        seen = self.facts("before", ids)
        lower = ((seen - _taken(seen, m.lower_discounts)) / m.pairs + m.lower_rest / (m.words + 1))[own]
        totals = self.facts("totals", ids)[before]
        ones, twos, mores = (self.facts(n, ids) for n in ("ones", "twos", "mores"))
        d = m.discounts
        rest = (d[0] * ones + d[1] * twos + d[2] * mores)[before]
        counts = self.pair_counts(ids[before], ids[own])
        upper = counts - _taken(counts, d) + rest * lower
        return np.where(totals > 0, upper / np.maximum(totals, 1), lower)

    def score(self, group: list[list[bytes]]) -> np.ndarray:
        """Words and pairs are looked up once each, however often the group has them."""
        m = self.model
        ids, own, before, firsts = self.places(group)
        base = np.log10((self.facts("counts", ids[:-1]) + 1) / (m.tokens + m.words + 1))
        pairs, at = np.unique(before * len(ids) + own, return_inverse=True)
        pairs_before, pairs_own = np.divmod(pairs, len(ids))
        out = np.zeros(len(group), _SCORES)
        out["n_tokens"] = [len(tokens) for tokens in group]
        out["n_known"] = np.add.reduceat((ids[own] >= 0).astype(np.int64), firsts)
        out["base_score"] = np.add.reduceat(base[own], firsts)
        out["score"] = np.add.reduceat(np.log10(self.probabilities(ids, pairs_before, pairs_own))[at], firsts)
        return out


def _taken(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def _by(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that hold it."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-2))
    for part in np.split(order, at[1:]) if len(order) else ():
        yield int(shard[part[0]]), part


def _search(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of values in an ordered array; looked up in order, so that pages are met once."""
    order = np.argsort(values)
    place = np.empty(len(values), np.int64)
    place[order] = np.searchsorted(ordered, values[order])
    place = np.minimum(place, max(len(ordered) - 1, 0))
    return (ordered[place] == values) if len(ordered) else np.zeros(len(values), bool), place
