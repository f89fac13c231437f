"""Suffix dedup of a text over 16 MiB, and of data that are looked at in parts."""

import random

import numpy as np

from lantern.llm import common, suffixes
from tests.llm.test_operators import brute_cut, words


def test_repeats_beyond_16_mib_are_found(spark):
    common.prepare(spark)
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, (1 << 24) + 60_000, dtype=np.uint8)
    near, far, at = bytes(text[60:400]), bytes(text[-20_000:-19_600]), len(text) - 20_000
    rows = [(1, near.decode()), (2, "<" + far.decode() + ">"), (3, bytes(text).decode())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.dedup(frame).collect()}
    whole = bytes(text)
    assert got[1] == ([], near) and got[2] == ([], b"<" + far + b">")
    assert got[3][0] == [(60, 400), (at, at + 400)]
    assert got[3][1] == whole[:60] + whole[400:at] + whole[at + 400 :]


def test_parts_give_every_window_its_anchor(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [700, 30, 0, 50, 2000, 49, 51, 120, 900]
    data, offsets = rng.integers(97, 100, sum(sizes), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def by_window():
        owner, at, first, last, hashes, _ = suffixes.find_anchors(data, offsets)
        out = [(w, o, a, h) for o, a, f, l, h in zip(*(x.tolist() for x in (owner, at, first, last, hashes))) for w in range(f, l + 1)]
        return sorted(out)

    whole = by_window()
    assert len(whole) == sum(max(0, n - 49) for n in sizes)
    for part in (1, 97, 500, 1999):
        monkeypatch.setattr(suffixes, "PART", part)
        assert by_window() == whole


def test_hot_anchors_are_parted_by_window(spark, monkeypatch):
    """Blanks and a line that go on in many ways, so that one anchor has most keys; several ranges share it."""
    monkeypatch.setattr(suffixes, "HOT_KEYS", 20)
    monkeypatch.setattr(suffixes, "MANY", 1)
    common.prepare(spark)
    rng = random.Random(9)
    lines = [words(rng, 6, 60) for _ in range(12)]
    rows = []
    for i in range(300):
        parts = [rng.choice((" " * 30, " " * 70, "=" * 25, "Licensed under the terms of the common licence, ")) + rng.choice((words(rng, 4, 30), rng.choice(lines))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    want = sorted(brute_cut(rows))
    seen = []
    whole = suffixes.range_borders
    monkeypatch.setattr(suffixes, "range_borders", lambda samples, places, hot: seen.append((whole(samples, places, hot), hot)) or seen[-1][0])
    got = suffixes.dedup(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == want
    borders, hot = seen[0]
    assert hot and any(len(b) > suffixes.GRAM for b in borders)
