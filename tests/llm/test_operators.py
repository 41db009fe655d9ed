"""The operators against brute force, round trips and odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from winnow.llm import (
    components,
    embedding_dedup,
    kneser_ney,
    licenses,
    mixing,
    order_minhash,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    warc,
)
from winnow.llm.common import numbered_rows, remainder_of_crc, shared_folder, stored

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score string, kept string, size string, row string, place string, label string, key string, copies string, node string"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(words))


def odd_docs(spark):
    """Nulls in every column, empty and white texts, one very long, repeated rows, repeated ids, clashing names."""
    texts = [None, "", " \t\n\x0b\x0c\r", "one", prose(1, 60), prose(1, 60), prose(2, 30_000), "x" * 50_000, "é ß İ <|endoftext|>"]
    rows = [(i, t, None, ["b", "a", None][i % 3], None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, prose(3, 40), "en", "a", 1), (None, None, None, None, None), (5, "another text of the same id", "x", "", 2)]
    extra = tuple("x" for _ in CLASHES.split(", "))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOCS}, {CLASHES}"), len(rows)


# WARC


def archive(spark, rows, **options):
    folder = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")
    listed = stored(warc.write_archives(pages, folder, **options), "warc-list")
    return warc.read_archives(listed, folder), folder


def test_warc_round_trip(spark):
    rows = [
        (1, "http://a/\r\nX: y", "same", "d", "p"),
        (7, None, "same", "d", "p"),
        (3, "http://b/ü", "same", None, None),
        (4, "http://c", None, "d", "p"),
        (9, "", "", "d", "p"),
        (5, "http://d", "ß" * 300_000, "d", "p"),
        (None, "http://e", "same", "d", "p"),
        (7, None, "same", "d", "p"),
    ]
    read, folder = archive(spark, rows)
    got = sorted(
        ((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["verified"]) for r in read.collect()), key=str
    )
    want = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        first = {"same": 7, "": 9}.get(html or "", page_id)
        revisit = page_id is not None and page_id < first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, "revisit" if revisit else "response", first if revisit else None, len(data), digest, True))
    assert got == sorted(want, key=str)
    assert [bytes(r["payload"]) for r in read.filter("page_id = 5").collect()] == [("ß" * 300_000).encode()]
    again = warc.read_archives(warc.archives_of(spark, folder), folder)
    assert again.count() == len(rows)


def test_warc_threshold_rotation_and_empty(spark):
    rows = [(i, "http://a", "ab" if i % 2 else "abcdef", None, None) for i in range(20)]
    read, folder = archive(spark, rows, min_revisit_bytes=3, archive_bytes=300)
    kinds = collections.Counter((r["payload_bytes"], r["record_type"]) for r in read.collect())
    assert kinds == {(2, "response"): 10, (6, "response"): 1, (6, "revisit"): 9}
    assert warc.archives_of(spark, folder).count() > 1
    assert archive(spark, [])[0].count() == 0


def test_warc_rejects_damage(tmp_path):
    record = warc._record({"page_id": 1, "url": b"u", "payload": b"abc", "digest": hashlib.sha1(b"abc").digest(), "refers_to": None}, "d")
    import io

    whole = warc._member(record) + warc._member(record)
    found = list(warc.members(io.BytesIO(whole), piece=7))
    assert [f[0] for f in found] == [0, len(whole) // 2] and warc._row(*found[1][1:])["verified"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(whole[:-5])))
    with pytest.raises(ValueError, match="long"):
        list(warc.members(io.BytesIO(warc._member(record.replace(b"abc\r\n", b"ab\r\n")))))
    changed = next(warc.members(io.BytesIO(warc._member(record.replace(b"abc\r\n", b"abd\r\n")))))
    assert not warc._row(*changed[1:])["verified"]


# Packing


def test_packing_of_odd_rows(spark):
    docs, _ = odd_docs(spark)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter()
    for row in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 512):
            part = ids[at : at + 512]
            want[row["doc_id"], at // 512, at, len(part), zlib.crc32(part.tobytes())] += 1
    packed = stored(packing.pack(docs, WORD_BPE, capacity=512, keep_ids=True), "packed-test")
    rows = packed.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for name, parts in places.items():
        parts.sort(key=lambda p: p[0])
        assert [p[0] for p in parts] == [0, *itertools.accumulate(p[1] for p in parts)][:-1]
        assert sum(p[1] for p in parts) <= 512 and whole[name] == b"".join(bytes(p[2]) for p in parts)
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0


def test_packing_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_TOGETHER", 20)
    docs = spark.range(600, numPartitions=12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.pmod(F.xxhash64("id"), F.lit(400)).cast("int")).alias("text"))
    rows = packing.pack(docs, WORD_BPE, capacity=512).collect()
    total = sum(r["length"] for r in rows)
    assert len(rows) == 600 and len({r["sequence_id"] for r in rows}) <= -(-total // 512) * 1.03


def test_best_fit_is_tight():
    draw = random.Random(3)
    sizes = [draw.randint(1, 100) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(2000))
    assert all(sum(sizes[k] for k in b) <= 100 for b in bins) and len(bins) <= sum(sizes) / 100 * 1.02 + 1


# Mixing


def water_fill(sizes, pattern, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: pattern[i % len(pattern)] for i, s in enumerate(names)}
    full: set = set()
    total = sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return share | {s: most * sizes[s] for s in full}
        full |= above


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED_TOGETHER", 16)
    sources = {"A": 700, "a": 40, None: 90, "é": 30, "z": 5, "": 60}
    rows = [(i, prose(i, 5 + i % 40), s) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    keyed = stored(mixing.with_keys(docs).drop("row"), "mix-test")
    taken = mixing.with_copies(keyed, mixing.plan_mix(keyed, (5.0, 2.0, 1.0)))
    got = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target"), F.first("source_size").alias("s"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.first("epochs").alias("e"))
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = water_fill(sizes, (5.0, 2.0, 1.0))
    for r in got.collect():
        assert r["s"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert abs(r["t"] - r["target"]) <= 22.5 and r["e"] <= r["least"] <= r["most"] <= min(3, r["e"] + 1)
    again = mixing.mix(docs.repartition(3), (5.0, 2.0, 1.0)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in again} == {r["doc_id"]: r["copies"] for r in taken.collect() if r["copies"]}


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    mixed = mixing.mix(docs, (1.0,), share=0.25, weight=F.col("w"))
    even, odd = mixed.filter("doc_id % 2 = 0").count(), mixed.filter("doc_id % 2 = 1").count()
    assert abs(even + odd - 1000) <= 1 and 2.2 < even / odd < 3.4


def test_mixing_odd_rows(spark):
    docs, count = odd_docs(spark)
    mixed = mixing.mix(docs, (5.0, 2.0, 1.0))
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(docs.limit(0), (1.0,)).count() == 0


# Language model


def test_language_model_against_brute_force(spark):
    rows = [(i, prose(i % 50, 40) + (" The end" if i % 3 else " THE end é É")) for i in range(200)] + [(900, None), (901, ""), (None, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usable = remainder_of_crc(F.col("doc_id"), 7) != 2
    model = kneser_ney.train(docs, usable)
    got = kneser_ney.score(docs, model).select("row.*", "n_tokens", "n_known", "base_score", "score").collect()
    tokens = kneser_ney.tokens_of
    ones, pairs = collections.Counter(), collections.Counter()
    for doc_id, text in rows:
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2:
            words = tokens((text or "").encode())
            ones.update(words)
            pairs.update(zip([None, *words[:-1]], words, strict=True))
    before, after, totals = collections.Counter(w for _, w in pairs), collections.defaultdict(list), collections.Counter()
    for (a, _), n in pairs.items():
        after[a].append(n)
        totals[a] += n

    def discounts(counts):
        n = collections.Counter(counts)
        return [0, *kneser_ney._discounts([n[1], n[2], n[3], n[4]])]

    upper, lower = discounts(pairs.values()), discounts(before.values())
    rest = sum(lower[min(n, 3)] for n in before.values()) / len(pairs)

    def low(w):
        return (before[w] - lower[min(before[w], 3)]) / len(pairs) + rest / (len(ones) + 1)

    def chance(a, w):
        if a not in totals:
            return low(w)
        n = pairs[a, w]
        return (n - upper[min(n, 3)] + sum(upper[min(x, 3)] for x in after[a]) * low(w)) / totals[a]

    assert math.isclose(sum(chance(b"the", w) for w in [*ones, b"not there"]), 1.0)
    total = sum(ones.values())
    assert model.tokens == total and model.words == len(ones)
    for r in got:
        words = tokens((r["text"] or "").encode())
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in ones for w in words))
        assert math.isclose(r["base_score"], sum(math.log10((ones[w] + 1) / (total + len(ones) + 1)) for w in words))
        assert math.isclose(r["score"], sum(math.log10(chance(a, w)) for a, w in zip([None, *words[:-1]], words, strict=True)))


def test_language_model_odd_rows(spark):
    docs, count = odd_docs(spark)
    scored = kneser_ney.score(docs, kneser_ney.train(docs, F.lit(True))).collect()
    assert len(scored) == count and all(math.isfinite(r["score"]) for r in scored)
    nothing = kneser_ney.train(docs, F.lit(False))
    assert {r["score"] for r in kneser_ney.score(docs, nothing).collect()} == {0.0}
    assert kneser_ney.score(docs.limit(0), nothing).count() == 0


# Near-duplicates


def aligned_classes(rows):
    """Smallest id of the class of each row by comparing all pairs."""
    labelled = []
    for _, text in rows:
        words, seen, out = (text or "").split(), collections.Counter(), []
        for k in range(len(words) - 4):
            s = tuple(words[k : k + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        labelled.append(out)
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = (rows[a][1] or "").split() == (rows[b][1] or "").split()
        if not same and labelled[a] and labelled[b]:
            places = {s: k for k, s in enumerate(labelled[b])}
            run = order_minhash._longest_ascending([places[s] for s in labelled[a] if s in places])
            same = run / (len(labelled[a]) + len(labelled[b]) - run) >= 0.8
        if same:
            low, high = sorted((find(a), find(b)))
            at[high] = low
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return collections.Counter((rows[k][0], least[find(k)]) for k in range(len(rows)))


def varied(text: str, share: float, seed: int) -> str:
    draw, words = random.Random(seed), text.split()
    return " ".join(w + "q" if draw.random() < share else w for w in words)


def test_near_duplicates_against_all_pairs(spark):
    rows = [(k, prose(k, 30 + k % 90)) for k in range(60)]
    # Families around a text that need not have the smallest id, chains, and copies of copies.
    rows += [(100 + k, varied(prose(500, 150), 0.001 * k, k)) for k in range(60)] + [(99, varied(prose(500, 150), 0.02, 999))]
    chain = prose(600, 200)
    for k in range(12):
        chain = varied(chain, 0.015, 70 + k)
        rows.append((300 - k, chain))
    rows += [(400 + k, "a common line that all of these begin with here\n" + prose(700 + k, 6)) for k in range(40)]
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "few words"), (504, "few  words"), (None, "few words"), (None, None)]
    rows += [(505, "again " * 300), (506, "again " * 290), (507, "again " * 100), (100, rows[60][1])]
    half = prose(800, 100).split()
    rows += [(600, " ".join(half)), (601, " ".join(half[50:] + half[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = order_minhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == aligned_classes(rows)
    classes = collections.Counter(r["class_id"] for r in got if r["kept"])
    assert set(classes) == {r["class_id"] for r in got} and max(classes.values()) == 1
    kept = order_minhash.drop_near_duplicates(docs.withColumn("kept", F.lit(1)).withColumn("key", F.lit("k")))
    assert kept.columns == ["doc_id", "text", "kept", "key"]
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in got if r["kept"])


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "TOGETHER", 8)
    rows = [(k, varied(prose(1, 120), 0.0015 * k, k)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == aligned_classes(rows)


def test_near_duplicates_odd_rows(spark):
    docs, count = odd_docs(spark)
    assert order_minhash.near_duplicates(docs).count() == count
    assert order_minhash.near_duplicates(docs.limit(0)).count() == 0
    assert order_minhash.drop_near_duplicates(docs).columns == docs.columns


def test_order_counts():
    a = order_minhash.labelled_shingles(np.arange(100, dtype=np.uint16))
    turned = order_minhash.labelled_shingles(np.r_[50:100, 0:50].astype(np.uint16))
    assert order_minhash.similarity_of(a, a, 0.8) == 1.0
    assert order_minhash.similarity_of(a, turned, 0.8) == 0.0 and 0.3 < order_minhash.similarity_of(a, turned) < 0.4
    repeats = order_minhash.labelled_shingles(np.zeros(50, np.uint16))
    assert len(set(repeats.tolist())) == 46


def test_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(100)] + [(2000 + draw.randrange(300), 2000 + draw.randrange(300)) for _ in range(200)]
    edges += [(5, 5), (7, 6)]
    at: dict[int, int] = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            at[high] = low
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: find(x) for x in list(at)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Licences


def test_licences_found_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/c/x.py", prose(1, 50)),
        (3, "a/b/COPYING.txt", prose(2, 20) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + prose(3, 20)),
        (4, "a/b/y.py", prose(4, 9) + "\n# Licensed under CC BY-NC 4.0.\n"),
        (5, "a/z.py", None),
        (6, "q.py", "the driving licence of the house"),
        (7, None, "Released under the MIT License."),
        (8, None, ""),
        (9, "a/b/LICENSE.md", "nothing said"),
        (10, "ab/w.py", prose(5, 20_000) + " Licensed under the Apache License, Version 2.0."),
        (11, "a/b/c/d/v.py", ""),
        (11, "a/b/c/d/v.py", ""),
        (12, "ab/u.py", "Released under the BSD 3-Clause License."),
        (13, "ab/t.py", "This work is licensed under the GNU General Public License, version 2."),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("x"))
    got = [(r["id"], r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(files).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "MIT", "MIT", None),
            (2, None, "GPL-3.0", "a/b"),
            (3, "GPL-3.0", "GPL-3.0", None),
            (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            (5, None, "MIT", "a"),
            (6, None, None, None),
            (7, "MIT", "MIT", None),
            (8, None, None, None),
            (9, None, "GPL-3.0", "a/b"),
            (10, "Apache-2.0", "Apache-2.0", None),
            (11, None, "GPL-3.0", "a/b"),
            (11, None, "GPL-3.0", "a/b"),
            (12, "BSD-3-Clause", "BSD-3-Clause", None),
            (13, "GPL-2.0", "GPL-2.0", None),
        ],
        key=str,
    )
    assert licenses.scan(files.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
RESERVED = "Copyright (c) 2001, A. N. Author\nAll rights reserved."


def own_licences(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("path", F.lit(None).cast("string"))
    return [r["own_license"] for r in licenses.scan(files).orderBy("id").collect()]


def test_licences_wrapped_as_usual(spark):
    wants = [("MIT", MIT), ("MIT", MIT.replace("is hereby", "is\nhereby")), ("BSD-3-Clause", BSD), ("MPL-2.0", MPL)]
    wants += [("BSD-3-Clause", f"{RESERVED}\n\n{BSD}"), ("Proprietary", RESERVED), ("MIT", f"{RESERVED}\n\n{MIT}")]
    wants += [("GPL-2.0", GPL), ("GPL-3.0", GPL.replace("version 2", "version 3"))]
    wants += [("LGPL-3.0", GPL.replace("General", "Lesser General").replace("version 2", "version 3"))]
    wants += [(name, "/*\n" + "".join(f" * {line}\n" for line in text.split("\n")) + " */\nint x;") for name, text in wants]
    wants += [(name, prose(6, 400) + "\n" + text + "\n" + prose(7, 400)) for name, text in wants]
    wants.append((None, prose(8, 400)))
    assert own_licences(spark, [text for _, text in wants]) == [name for name, _ in wants]


def test_licences_in_long_lines(spark):
    grants = [("MIT", MIT), ("BSD-3-Clause", BSD), ("MPL-2.0", MPL), ("GPL-2.0", GPL)]
    joined = [(name, " ".join(text.split())) for name, text in grants]
    wants = [(name, f"{prose(9, 300)} {text.replace('.', '').replace(':', '')} {prose(10, 300)}") for name, text in joined]
    # A mark put in at every former line end, and a grant that is cut short.
    wants += [(name, f"{prose(11, 300)} {text} {prose(12, 300)}".replace("\n", " <br> ")) for name, text in grants]
    wants += [("MIT", f"{prose(13, 300)} {' '.join(joined[0][1].split()[:21])} {prose(14, 300)}")]
    assert own_licences(spark, [text for _, text in wants]) == [name for name, _ in wants]


# Vectors


def linked(rows, cosine=0.93):
    found = []
    for _, vector, label in rows:
        good = label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        v = np.array(vector if good else [0.0])
        found.append(v / np.sqrt((v * v).sum()) if good else None)
    links, at = collections.Counter(), list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = found[a], found[b]
        if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and (x * y).sum() >= cosine:
            links[a] += 1
            links[b] += 1
            at[find(a)] = find(b)
    least: dict[int, int] = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted((rows[k][0], links[k], least[find(k)], least[find(k)] == rows[k][0]) for k in range(len(rows)))


@pytest.mark.parametrize(("dims", "together"), [(64, 1024), (64, 16), (6, 1024), (1, 1024), (100, 1024)])
def test_vectors_against_all_pairs(spark, monkeypatch, dims, together):
    monkeypatch.setattr(embedding_dedup, "TOGETHER", together)
    draw = np.random.RandomState(dims)
    centres = draw.randn(12, dims)
    rows = []
    for k in range(400):
        noise = draw.choice([0.0, 0.15, 0.25, 0.35, 2.0])
        v = (centres[k % 12] + noise * draw.randn(dims)) * draw.choice([1.0, 1e-3, 50.0])
        rows.append((1000 - k, v.astype(np.float32).astype(float).tolist(), [1, 2, None][k % 3]))
    rows += [(5000, None, 1), (5001, [0.0] * dims, 1), (5002, [float("nan")] * dims, 1), (5003, [None] * dims, 1), (5004, [], 1)]
    rows += [(5005 + k, rows[0][1], 1) for k in range(5)] + [(5020, [1.0] * (dims + 1), 1), (5021, [2.0] * (dims + 1), 1), (5022, [1e300] * dims, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("k"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(table).collect())
    rows[-1] = (5022, [1.0] * dims, 2)
    assert got == linked(rows)


def test_vectors_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(table).count() == 0


# Sharding


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_permutation(count):
    places = sharding.permute(np.arange(count), count, 5)
    assert sorted(places) == list(range(count))
    assert (sharding.row_number(places % 7, places // 7, 7, count, 5) == np.arange(count)).all()


def test_shards_are_even_and_repeatable(spark):
    docs, count = odd_docs(spark)
    many = docs.select("doc_id", "text", "lang").unionByName(spark.range(100, 1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("l").alias("lang")))
    first = sharding.shard_rows(many, 7, carry=("lang",)).collect()
    again = sharding.shard_rows(many.repartition(11), 7, carry=("lang",)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == count + 900
    slots = collections.defaultdict(list)
    for r in first:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 7 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["size"] for r in first if r["doc_id"] == 0} == {16}
    assert sharding.shard_rows(many.limit(0), 7).count() == 0


def test_row_numbers(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(500)], "v int, w long").repartition(7)
    got = numbered_rows(rows, [F.col("v")], "number").collect()
    assert sorted(r["number"] for r in got) == list(range(500))
    assert [r["v"] for r in sorted(got, key=lambda r: r["number"])] == sorted(k % 5 for k in range(500))


# Quality rules


def counted(text):
    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    runs = collections.defaultdict(list)
    for k in range(len(words) - 7):
        runs[tuple(words[k : k + 8])].append(k)
    covered = {p for at in runs.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_facts_against_brute_force(spark):
    draw = random.Random(9)
    texts = ["", "\n \n", "a b c d e f g h " * 3, "one\n" * 30, prose(1, 25) + "\n" + prose(1, 25), "$% & word", "x" * 20_000, prose(2, 20_000)]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(5, 80))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "kept": F.lit("y")})
    got = quality_rules.judge(docs).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(rows)
    for r in got:
        facts = counted(r["text"] or "")
        assert tuple(r)[2:7] == facts
        assert r["base_failed"] == (facts[0] < 20 or 100 * facts[4] > 30 * facts[0])


def test_quality_cascade(spark):
    good, symbols, shouting = prose(1, 100), "word$$ " + prose(2, 60).replace(" ", "% "), prose(3, 100).upper()
    docs = spark.createDataFrame([(1, good), (2, symbols), (3, shouting), (4, "few"), (5, None)], "doc_id long, text string")
    judged = {r["doc_id"]: (r["failed_rule"], r["kept"]) for r in quality_rules.judge(docs).select("row.doc_id", "failed_rule", "kept").collect()}
    assert judged == {1: (None, True), 2: ("symbols", False), 3: ("shouting", False), 4: ("base", False), 5: ("base", False)}
    assert [r["doc_id"] for r in quality_rules.keep_good(docs).collect()] == [1]
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
    facts = quality_rules.with_facts(docs.unionByName(docs.filter("doc_id = 3"))).drop("row")
    order = quality_rules.rule_order(facts, quality_rules.RULES)
    assert sorted(order) == sorted(quality_rules.RULES) and set(order[:2]) <= {"shouting", "symbols", "short_words", "long_words"} | set(order[:2])


# Quality classifier


def labelled_docs(spark):
    rows = [(k, prose(k, 80) if k % 4 else " ".join(["$$junk%%"] * 3 + prose(k, 5).split()) * 6, 0 if k % 4 == 0 else 1) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    return docs, labels, {k: q for k, _, q in rows}


def test_classifier_on_held_out_rows(spark):
    docs, labels, truth = labelled_docs(spark)
    usable = remainder_of_crc(F.col("doc_id"), 5) != 0
    got = quality_classifier.classify(docs, labels, usable).select("row.doc_id", "score", "predicted").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 600 and len(held) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_classifier_sees_no_held_out_label(spark):
    docs, labels, _ = labelled_docs(spark)
    usable = remainder_of_crc(F.col("doc_id"), 5) != 0
    other = labels.withColumn("quality", F.when(usable, F.col("quality")).otherwise(1 - F.col("quality")))
    first, again = (quality_classifier.fit(quality_classifier.labelled(docs.repartition(3), x, usable)) for x in (labels, other))
    assert (first == again).all() and first.any()


def test_classifier_odd_rows(spark):
    docs, count = odd_docs(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    scored = quality_classifier.classify(docs, labels, F.lit(True)).collect()
    assert len(scored) == count and all(0 <= r["score"] <= 1 for r in scored)
    unlabelled = quality_classifier.classify(docs, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_a_pair_is_looked_up_once_in_a_group(spark):
    from winnow.llm import kneser_ney

    docs = spark.createDataFrame([(i, f"over and over and over w{i % 3}") for i in range(30)], "doc_id long, text string")
    reader = kneser_ney.Reader(kneser_ney.train(docs, F.lit(True)))
    looked_up, plain = [], reader.pair_counts
    reader.pair_counts = lambda before, ids: looked_up.append(len(ids)) or plain(before, ids)
    texts = [b"over and over and unknown", b"", b"over and over w1"] * 50
    group = [kneser_ney.tokens_of(text) for text in texts]
    together = reader.score(group)
    assert sum(looked_up) < 15
    assert (np.concatenate([reader.score([tokens]) for tokens in group]) == together).all()
