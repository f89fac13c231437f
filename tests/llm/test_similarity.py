"""Near-dedup between 0.80 and 0.85, where the pipeline's stage looks further than the query."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lantern.llm import common, minhash, neighbours
from tests.llm.test_operators import brute_near, shingle_set, words


def pairs(rng, n):
    """Texts of 104 words, each twice: two words apart or three, so that similarity is 0.82 or 0.74."""
    rows = []
    for i in range(n):
        own = words(rng, 104, 50_000).split()
        near = list(own)
        for at in ((20, 70), (20, 50, 80))[i % 2]:
            near[at] = "other"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near))]
    return rows


def test_stage_drops_copies_at_four_fifths(spark):
    common.prepare(spark)
    rows = pairs(random.Random(3), 20)
    a, b = (shingle_set(t) for _, t in rows[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i, _, _, keep in sorted(brute_near(rows, 80)) if keep]


def test_candidates_at_the_threshold():
    """Of 20,000 pairs of sets just at the threshold all are candidates, short sets too."""
    rng = np.random.default_rng(5)
    for percent, both, each in ((80, 4, 0.5), (80, 8, 1), (80, 80, 10), (85, 17, 1.5), (70, 7, 1.5), (50, 6, 3)):
        rows, agree = minhash.plan(percent)
        extra = round(2 * each)
        hashes = rng.integers(0, 1 << 64, (20_000, both + extra), dtype=np.uint64)
        one, two = both + extra // 2, np.r_[:both, both + extra // 2 : both + extra]
        a, b = np.sort(hashes[:, :one], axis=1), np.sort(hashes[:, two], axis=1)
        x, y = (minhash.signatures(s.ravel(), np.arange(len(s) + 1) * s.shape[1]) for s in (a, b))
        assert (((x & 255) == (y & 255)).sum(axis=1) >= agree).all(), percent
        assert (minhash.band_keys(x, rows) == minhash.band_keys(y, rows)).any(axis=1).all(), percent


def test_rows_count_by_themselves(spark):
    """Equal and null doc_ids: each row has its own text's group, and the stage loses no text that nothing repeats."""
    common.prepare(spark)
    rng = random.Random(8)
    a, b, c, d = (words(rng, 80, 5000) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, d), (3, d), (4, b), (4, b), (5, None), (5, ""), (None, " "), (6, "few words"), (7, "FEW words")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, group_id int").repartition(3)
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame, 80).select("doc_id", "component_id", "kept").collect()), key=repr)
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (None, None, True), (None, None, True), (None, 3, False), (3, 3, True), (4, 2, False), (4, 2, False), (5, 5, True), (5, 5, True), (None, None, True), (6, 6, True), (7, 6, False)]
    assert got == sorted(want, key=repr)
    stay = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert stay.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (3, d), (5, None), (5, ""), (None, " "), (6, "few words")], key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, frame.limit(0), "").count() == 0


def test_many_blocks(spark, monkeypatch):
    """Buckets and families over thousands of blocks of three; some members agree with no centre."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    common.prepare(spark)
    rng = random.Random(4)
    base = words(rng, 60, 5000).split()
    rows = []
    for i in range(260):
        own = list(base if i < 200 else rows[rng.randrange(200)][1].split())
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in minhash.near_duplicates(frame, 80).collect()) == sorted(brute_near(rows, 80))


def test_pairs_of_blocks_beyond_2048(spark):
    """Keys of pairs of blocks have 64 bits."""
    sized = spark.createDataFrame([(i,) for i in range(40)], "id long").selectExpr("id", f"{minhash.BLOCK} * 5000L as members")
    pairs = minhash.meeting_blocks(sized, "id")
    assert pairs.count() == 40 * 5000 and pairs.selectExpr("max(pair) p").first().p > 1 << 31
    assert pairs.selectExpr("count(distinct pair) n").first().n > 40 * 4900


def test_links_by_sets_equal_brute_force():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(0, 30))), np.uint64) for _ in range(60)]
    linked = minhash.set_links(sets, 60)
    for i, s in enumerate(sets):
        want = [len(s) > 0 and len(t) > 0 and 100 * len(np.intersect1d(s, t)) >= 60 * len(np.union1d(s, t)) for t in sets]
        assert linked(i).tolist() == want


def test_vectors_count_by_themselves(spark, monkeypatch):
    """Equal and null vec_ids: each row has its own vector's links. Low recall is an error."""
    common.prepare(spark)
    a, b, c, d = np.eye(4).tolist()
    rows = [(5, a), (5, b), (6, a), (7, b), (None, c), (None, c), (9, c), (None, d), (None, None), (8, None)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, row_id int").repartition(3)
    got = sorted((tuple(r) for r in neighbours.near_duplicates(frame, 0.9).collect()), key=repr)
    want = [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 2, 9, False), (None, 2, 9, False), (9, 2, 9, True), (None, 0, None, True), (None, 0, None, True), (8, 0, 8, True)]
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(neighbours, "audit", lambda *_: 0.5)
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(frame, 0.9)
