"""Benchmark items of five and six words, in every place of a text."""

import random

import pyarrow as pa

from lantern.llm import common, contamination
from tests.llm.test_operators import brute_items, words


def test_items_of_one_or_two_shingles_are_never_missed():
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(5, 60), 50_000).split() for _ in range(3000)]
    runs = []
    for t in texts:
        size = min(rng.choice((5, 6)), len(t))
        at = rng.choice((0, len(t) - size, rng.randrange(len(t) - size + 1)))
        runs.append(" ".join(t[at : at + size]))
    items = contamination.Items([*range(3000), 3000], [*runs, runs[0]])
    found = contamination.found_in(items, pa.array([" ".join(t) for t in texts]), 0.8)
    assert [sorted(f) for f in found] == [[0, 3000], *([i] for i in range(1, 3000))]


def test_parts_give_the_rows_of_one_part(spark, monkeypatch):
    """Rows with equal and null doc_ids by their own texts, however many parts the benchmark has; words are counted across line breaks."""
    common.prepare(spark)
    rng = random.Random(2)
    items = [(k, "\n".join(words(rng, 12, 3000).split())) for k in range(40)] + [(3, words(rng, 9, 3000)), (None, "a b c d e f"), (50, None)]
    rows = [(1, words(rng, 60, 3000)), (1, "x " + items[4][1] + " y " + items[40][1]), (None, items[7][1] + " " + items[7][1]), (None, "clean"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, n, ids) for i, n, ids in brute_items(rows, items)), key=repr)
    for size in (2_000_000, 100, 30):
        monkeypatch.setattr(contamination, "PART_SHINGLES", size)
        assert (len(list(contamination._parts(benchmark))) > 1) == (size < 500)
        got = contamination.contaminated(frame, benchmark).collect()
        assert sorted(((r.doc_id, r.n_items, list(r.item_ids)) for r in got), key=repr) == want, size
        kept = contamination.without_contaminated(frame, benchmark).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
