"""The audit of filters against brute force, whatever the order in which files arrive."""

from __future__ import annotations

import itertools
import re
import time

import pytest

from winnow.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, mask int"
LABELS = "doc_id long, quality int, toxic int, id long"


def brute(rows, labels):
    """Every count, straight from the wording of the filters."""
    good, toxic = ({i for i, q, t, _ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and min(same) < doc_id,
        }
        fails.append((lang or "", {k for k, v in bad.items() if v}, doc_id in good, doc_id in toxic))
    want = {}
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, own in enumerate(order):
                before = set(order[:step])
                gone = [f for f in mine if own in f[0] and not f[0] & before]
                total[own] += len(gone)
                want[part, "".join(order), step + 1] = [
                    sum(not f[0] & (before | {own}) for f in mine),
                    len(gone),
                    sum(own in f[0] and bool(f[0] & before) for f in mine),
                    sum(f[0] == {own} for f in mine),
                    sum(f[1] for f in gone),
                    sum(f[2] for f in gone),
                    own,
                ]
        for key in want:
            if key[0] == part:
                want[key][-1] = total[want[key][-1]]
    return {k: tuple(v) for k, v in want.items()}


def odd_rows():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b", long, long, "SHOUT " * 300, long + " #", "same " * 400, "ß" * 40 + "AB", long, "é A", "x" * 100_000, " \t\n\x0b"]
    rows = [(100 - i, t, ["en", "de", None, ""][i % 4], None, None, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, long, "en", None, None, "x", "y", 1), (None, long, "en", None, None, "x", "y", 1), (None, None, None, None, None, None, None, None)]
    rows += [(i, "copy of many", "en", None, None, "x", "y", 1) for i in range(40, 0, -1)]
    labels = [(i, i % 2, i % 3 == 0, 5) for i in range(0, 101, 2)] + [(97, None, 1, 1), (97, 1, None, 1), (None, 1, 1, 1)]
    return rows, [(a, b, None if c is None else int(c), d) for a, b, c, d in labels]


@pytest.mark.parametrize("order", [1, -1])
def test_audit_of_odd_rows_in_any_order_of_files(spark, tmp_path, order):
    rows, labels = odd_rows()
    path = str(tmp_path / "docs.parquet")
    for i, at in enumerate(list(range(0, len(rows), 7))[::order]):
        spark.createDataFrame(rows[at : at + 7], DOCS).coalesce(1).write.mode("append").parquet(path)
        if i < 3:
            time.sleep(1)  # files are taken in order of time, so the first three come first
    found = filter_audit.audit(spark, path, spark.createDataFrame(labels, LABELS), batches=6)
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == brute(rows, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(path)
    empty = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark, path, empty).count() == 0


def test_smaller_ids_take_earlier_masks_back():
    """The state function alone: what is emitted for a text whose smaller ids come later."""
    import pandas as pd

    class Held:
        value, exists = None, False
        get = property(lambda self: self.value)

        def update(self, value):
            self.value, self.exists = value, True

    state, seen = Held(), {}
    for ids in ([9, 12], [4], [7], [4, 2]):
        frame = pd.DataFrame({"id": ids, "known": True, "key": b"k", "bucket": 0, "part": "p", "mask": 1, "good": False, "toxic": False})
        entries = list(filter_audit._together(iter([frame])))
        for delta in filter_audit._least_ids((0,), iter(entries), state):
            for mask, n in zip(delta["mask"], delta["n"], strict=True):
                seen[mask] = seen.get(mask, 0) + n
    assert seen == {1: 1, 1 | filter_audit.REPEAT: 5}
