"""Token ids of texts, with the ids of words remembered."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from winnow.llm.common import give_back_memory

# A word of letters that lower-case to one letter each, and marks that no word runs into.
_PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=-@\\[-`{-~]*)$"
_BETWEEN = " | "
# Words encoded as one text, bytes of texts whose new words are learnt together, and texts the tokenizer is given at once.
_TOGETHER = 256
_LEARNT_TOGETHER = 1 << 22
_ENCODED_TOGETHER = 32


class TokenBytes:
    """Ids as little-endian unsigned 32-bit bytes, for tokenizers of words in lower case.

    It is for tokenizers that lower-case, drop white space, and part letters
    from marks: no token then spans white space, nor a plain word and the marks
    after it. The ids of what lies between white space are remembered, and
    those of words and marks, up to `most` of each and `longest` bytes. Most of
    what is new is never met again, so beyond that only what the latest texts
    hold is kept: the frequent ones are among it.
    """

    _last: dict[str, TokenBytes] = {}

    @classmethod
    @contextmanager
    def at_work(cls, path: str) -> Iterator[TokenBytes]:
        """The worker's own for this tokenizer, for one task. A worker keeps it from task to task, packed up in between."""
        if path not in cls._last:
            cls._last = {path: cls(path)}
        own = cls._last[path]
        own._unpack()
        try:
            yield own
        finally:
            own._pack_up()

    def __init__(self, path: str, most: int = 300_000, longest: int = 60):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alone = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in (_BETWEEN, f"a{_BETWEEN}b", "a", "b")]
        # The id of the mark, if it is one that stays by itself between words.
        self.between = alone[0][0] if alone[1] == alone[2] + alone[0] + alone[3] and len(alone[0]) == 1 else None
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.packed: list[tuple[pa.Array, pa.Array]] = []
        self.most, self.longest = most, longest

    def _pack_up(self) -> None:
        """Hold what is remembered as columns, which take a fifth of the room of objects."""
        self.older.update(self.runs)
        self.runs = {}
        for held, kind in ((self.older, pa.large_binary()), (self.words, pa.large_string())):
            self.packed.append((pa.array([*held], kind), pa.array([*held.values()], pa.large_binary())))
            held.clear()
        give_back_memory()

    def _unpack(self) -> None:
        if self.packed:
            for held, (keys, ids) in zip((self.older, self.words), self.packed, strict=True):
                held.clear()
                held.update(zip(_listed(keys), _listed(ids), strict=True))
            self.packed = []

    def __call__(self, text: bytes) -> bytes:
        return self._ids([text])[0]

    def many(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text. What is new in some texts is learnt at once."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > _LEARNT_TOGETHER:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        # Splits at the six ASCII white-space bytes only, as bytes.split(), but with an empty run at an end that is one.
        runs = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = runs.values.dictionary_encode()
        met = _listed(coded.dictionary.view(pa.large_binary()))
        ids = [*map(self.runs.get, met)]
        missing = [run for run, known in zip(met, ids, strict=True) if known is None]
        if missing:
            if len(self.runs) > self.most // 2:
                just_met = {run: known for run, known in zip(met, ids, strict=True) if known is not None}
                self.older, self.runs = self.runs, just_met
            before = [*map(self.older.get, missing)]
            self.runs.update((run, known) for run, known in zip(missing, before, strict=True) if known is not None)
            missing = [run for run, known in zip(missing, before, strict=True) if known is None]
            self._learn(missing)
            ids = [*map(self.runs.__getitem__, met)]
        found = pa.array(ids, pa.large_binary()).take(coded.indices)
        for run in missing:
            if len(run) > self.longest:
                del self.runs[run]
        ends = np.frombuffer(found.buffers()[1], np.int64)[runs.offsets.to_numpy()].tolist()
        whole = found.buffers()[2]
        return [whole[start:end].to_pybytes() for start, end in zip(ends, ends[1:])]

    def _learn(self, missing: list[bytes]) -> None:
        if len(self.words) > self.most:
            self.words = {"": b""}
        texts = pa.array([run.decode("utf-8", "replace") for run in missing], pa.large_string())
        short = pa.array([len(run) <= self.longest for run in missing], pa.bool_())
        parts = pc.extract_regex(texts, _PLAIN)
        plain = pc.and_(parts.is_valid(), short)
        word, marks = parts.filter(plain).flatten()
        found = pc.binary_join_element_wise(
            self._known(pc.utf8_lower(word), self._encoded_words), self._known(marks, self._encoded), pa.scalar(b"", pa.large_binary())
        )
        odd = pc.invert(plain)
        runs = pa.array(missing, pa.large_binary())
        self.runs.update(zip(_listed(runs.filter(plain)), _listed(found), strict=True))
        self.runs.update(zip(_listed(runs.filter(odd)), self._encoded(_listed(texts.filter(odd))), strict=True))

    def _known(self, texts: pa.Array, encoded: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of words or marks, each encoded once."""
        coded = texts.dictionary_encode()
        distinct = _listed(coded.dictionary)
        new = [text for text in distinct if text not in self.words]
        self.words.update(zip(new, encoded(new), strict=True))
        return pa.array([*map(self.words.__getitem__, distinct)], pa.large_binary()).take(coded.indices)

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Of words of letters only: many are encoded as one text, with a mark between that no word holds."""
        if self.between is None:
            return self._encoded(words)
        out = []
        joined = [_BETWEEN.join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        for found in self._found(joined):
            ids = np.array(found.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)]
            whole, start = ids.tobytes(), 0
            for end in ends:
                out.append(whole[4 * start : 4 * end])
                start = end + 1
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(f.ids)}I", *f.ids) for f in self._found(texts)]

    def _found(self, texts: list[str]) -> Iterator:
        # Few at a time: what the tokenizer tells of a text takes many times its room.
        for i in range(0, len(texts), _ENCODED_TOGETHER):
            yield from self.tokenizer.encode_batch_fast(texts[i : i + _ENCODED_TOGETHER], add_special_tokens=False)


def _listed(array: pa.Array) -> list:
    """As to_pylist(), which makes a scalar of each element on the way."""
    return array.to_numpy(zero_copy_only=False).tolist()
