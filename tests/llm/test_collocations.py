"""Phrases against brute force, tries against a dictionary of moves."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from winnow.llm import collocations

DOCS = "doc_id long, text string, lang string, source string, phrase string, n long, id int"


def brute(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = collections.defaultdict(list)
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    held = collections.Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = lang, words[i : i + size]
                held[key] = max(held[key], a)
    for (lang, words), a in candidates.items():
        if 100 * held[lang, words] >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, mine in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1)
    }


def texts(seed, many):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ä", "ß-x", "A#b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    phrases = ["new york city hall", "Out Of", "a b a b a b", "x x x x x x x"]
    out = []
    for _ in range(many):
        parts = draw.choices(words, weights, k=draw.randint(1, 60))
        parts += draw.choices(phrases, k=3)
        draw.shuffle(parts)
        out.append("".join(p + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for p in parts))
    return out


def rows_of(seed=0, many=300):
    rows = [(i, t, [None, "en", "de", "und"][i % 4], "s", "x", 1, 2) for i, t in enumerate(texts(seed, many))]
    rows += [rows[1], rows[1], (None, None, None, None, None, None, None), (1, "", "en", "", "", 0, 0), (2, "a b " * 30_000, "long", "", "", 0, 0)]
    rows += [(3, " .,\t\n", "en", "", "", 0, 0), (4, "x" * 200_000 + " new york", "en", "", "", 0, 0)]
    return rows


@pytest.mark.parametrize("together, words_together", [(1_000_000, 500_000), (30, 6)])
def test_phrases_in_pieces_of_any_size(spark, monkeypatch, together, words_together):
    monkeypatch.setattr(collocations, "WORDS_TOGETHER", words_together)
    monkeypatch.setattr(collocations, "CODES_TOGETHER", 500)
    rows = rows_of(many=120) if together == 30 else rows_of()
    least, longest = (40, 3) if together == 30 else (20, 5)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, least, longest, together=together).collect()}
    assert got == brute(rows, least, longest) and len(got) > 20


def test_top_and_empty(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in collocations.collocations(docs, 20, top=7).collect()} == brute(rows, 20, top=7)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, 10**9).count() == 0


def test_trie_moves_like_a_dictionary():
    draw = np.random.default_rng(1)
    states, words = draw.integers(1, 300, 6000), draw.zipf(1.3, 6000).clip(1, 5000)
    pairs = np.unique(np.stack([states, words], axis=1), axis=0)
    targets = draw.permutation(len(pairs)) + 1
    moves = {(s, w): t for (s, w), t in zip(pairs.tolist(), targets.tolist(), strict=True)}
    trie = collocations.Trie.of(pairs[:, 0], pairs[:, 1], targets, 400)
    ask = np.concatenate([pairs, np.stack([draw.integers(1, 401, 20_000), draw.integers(1, 6000, 20_000)], axis=1)])
    assert trie.step(ask[:, 0], ask[:, 1]).tolist() == [moves.get((s, w), 0) for s, w in ask.tolist()]
    trie.keep(targets[::2])
    left = set(targets[::2].tolist())
    assert trie.step(pairs[:, 0], pairs[:, 1]).tolist() == [t if t in left else 0 for t in targets.tolist()]


def test_a_trie_gives_back_the_room_of_what_it_forgets():
    states, words = np.divmod(np.arange(40_000), 40)
    trie = collocations.Trie.of(states + 1, words + 1, np.arange(40_000) + 1, 1000)
    before = sum(a.nbytes for a in (trie.base, trie.check, trie.target))
    trie.keep(np.arange(1, 40_001, 10))
    assert sum(a.nbytes for a in (trie.base, trie.check, trie.target)) < before / 4
    assert trie.base.itemsize == 4
    assert np.flatnonzero(trie.step(states + 1, words + 1)).tolist() == list(range(0, 40_000, 10))


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, 7 * big, [big + 1, big], [big, big + 2])], "a long, n long, heads array<long>, tails array<long>")
    cut = row.select(collocations._weakest_cut(2).alias("c")).first()["c"]
    assert cut["score"] == 1000 * big * 7 * big // ((big + 1) * (big + 2)) and (cut["l"], cut["r"]) == (big + 1, big + 2)


def test_candidates_are_all_phrases_of_their_buckets(spark):
    """Also where phrases share a bucket; what tasks count is summed by key."""
    draw = np.random.default_rng(4)
    codes = draw.integers(0, 30, 5000).astype(np.int32)
    pairs = collections.Counter((a, b) for a, b in zip(codes.tolist(), codes[1:].tolist(), strict=False) if a and b)
    wanted = sorted(pairs)[::7]
    first, rest = (np.array(c) for c in zip(*wanted, strict=True))
    frame = spark.createDataFrame([(bytearray(codes.tobytes()),), (bytearray(codes[:9].tobytes()),)], "codes binary").repartition(2)
    words = spark.range(1, 30).selectExpr("int(id) AS id", "int(id) AS word")
    found = collocations._candidates(frame, 3, [], collocations.hashes(first, rest), words, 100).collect()
    assert sorted((r["first"], r["rest"]) for r in found) == wanted and all(r["word"] == r["rest"] for r in found)
    assert sorted(r["id"] for r in found) == list(range(101, 101 + len(wanted)))
    assert [(r["first"], r["rest"]) for r in sorted(found, key=lambda r: r["id"])] == wanted
    kept = collocations._buckets(frame, 5, [], 8, 2).collect()
    pairs.update((a, b) for a, b in zip(codes[:9].tolist(), codes[1:9].tolist(), strict=False) if a and b)
    often = [p for p, n in pairs.items() if n >= 8]
    assert {r["key"] for r in kept} == {int(collocations.hashes(np.array([a]), np.array([b]))[0]) for a, b in often}
