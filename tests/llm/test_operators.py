"""The ten operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lantern.llm import bilinear, bpe, common, components, contamination, language, minhash, neighbours, queries, rankmerge, sstable, suffixes, toxicity

EXTRA = ["sig", "keys", "u", "id", "component_id", "blob", "mark", "n", "word", "shard"]


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = words(rng, 120, 4000)
    near = base.split()
    near[60] = "other"
    passage = words(rng, 30, 4000)
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"), (9, "x" * 30_000), (10, words(rng, 9000, 3000)),
        (11, words(rng, 40, 4000) + " " + passage), (12, passage + " " + words(rng, 40, 4000)), (13, "é" * 60), (14, "a" + "é" * 60), (15, "tab\tand<|endoftext|>special <|ENDOFTEXT|>"), (None, base + " tail"), (17, "'s it's 12 345!!  ΣΑΣ"),
        (18, "same same same same same same same"), (19, base.upper()),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    rows = [(i, t, *([1] * len(EXTRA))) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def brute_cut(rows):
    """Expected (id, bytes, removed, spans, kept) of each row by looking at every window."""
    rows = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        covered = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                covered[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((None if i == -(1 << 63) else i, len(b), sum(covered), spans, bytes(c for c, k in zip(b, covered) if not k)))
    return out


def test_suffix_dedup(docs, empty):
    got = suffixes.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_id((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == by_id(brute_cut(texts()))
    assert suffixes.dedup(empty).count() == 0


def test_suffix_dedup_many_copies_and_shared_passages(spark):
    rng = random.Random(11)
    passage = words(rng, 25, 900)
    rows = [(i, words(rng, rng.randrange(5, 40), 900) + " " + passage[: rng.randrange(40, len(passage))] + ("" if i % 3 else " tail")) for i in range(150)]
    rows += [(1000 + i, rows[i % 4][1]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.dedup(frame, carry=None).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_id((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == by_id(brute_cut(rows))


def test_loser_tree_orders_and_shares():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"ab\x00c") for _ in range(rng.randrange(20, 40))) + b"\x05" for _ in range(400)}, key=lambda k: k.ljust(81, b"\0"))
    runs, every = [], []
    for r in range(5):
        own = [k for k in keys if rng.random() < 0.4]
        every += own
        shared = [0] + [suffixes.shared_prefix(a, b, 0) for a, b in zip(own, own[1:])]
        rest = np.frombuffer(b"".join(k[s:] for k, s in zip(own, shared)), np.uint8)
        ones = np.ones(len(own))
        runs.append(suffixes.Run(suffixes.pack(np.array(shared, "u1"), np.array([len(k) for k in own], "u1"), rest, ones.astype("<u4"), np.full(len(own), r, "<i8"), np.zeros(len(own), "<i8"), np.zeros(len(own), "<u4"))))
    out, last = [], b""
    for key, shared, _ in suffixes.LoserTree(runs):
        assert shared == suffixes.shared_prefix(last, key, 0)
        out.append(key)
        last = key
    assert out == sorted(every, key=lambda k: k.ljust(81, b"\0"))


def brute_links(vectors, threshold):
    n = len(vectors)
    unit = [None if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v in vectors]
    return [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold] for i in range(n)]


def brute_components(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in links[i]:
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def test_embedding_near_dedup(spark):
    common.prepare(spark)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + rng.normal(scale=0.12, size=16)).tolist() for i in range(240)] + rng.normal(size=(100, 16)).tolist()
    vectors += [vectors[0]] * 30 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [2.0], [float("inf")] * 16]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component_id string").repartition(3)
    links = brute_links(vectors, 0.9)
    comps = brute_components(len(vectors), links)
    want = [(i, len(links[i]), comps[i], comps[i] == i) for i in range(len(vectors))]
    got = sorted(tuple(r) for r in neighbours.near_duplicates(frame, 0.9).collect())
    assert got == want
    assert neighbours.near_duplicates(frame.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("size", [40, 700])
def test_embedding_near_dedup_tight_groups_face_each_other(spark, size):
    """Lists of ten are full of a vector's own group, and most links are between groups."""
    common.prepare(spark)
    rng = np.random.default_rng(size)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    angle = math.acos(0.94)
    centres = [axes[0], math.cos(angle) * axes[0] + math.sin(angle) * axes[1], math.cos(angle) * axes[0] - math.sin(angle) * axes[1], axes[5]]
    x = np.concatenate([c + rng.normal(scale=0.008, size=(size, 64)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    assert linked[:size, size : 2 * size].sum() > size * size * 0.9 and not linked[:size, 3 * size :].any()
    want = [(i, int(linked[i].sum()) - 1, 3 * size if i >= 3 * size else 0, i in (0, 3 * size)) for i in range(4 * size)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in neighbours.near_duplicates(frame, 0.9).collect()) == want


def test_bpe_equals_library_and_round_trips(docs, empty):
    library = Tokenizer.from_file(queries.BYTE_VOCAB)
    got = bpe.encode_decode(docs, queries.BYTE_VOCAB).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == want
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty, queries.BYTE_VOCAB).count() == 0


def fuzz_texts():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "b", "the", "ing", "'s", "'", "1", "23", "é", "é", "ß", "Σ", "ς", "😀", "\xa0", "​", "<|endoftext|>", "<|startoftext|>", "\x85", "aaaa", "İ", "中文", ".", "!!", "\r\n"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(1500)] + ["".join(rng.choices("etaoinshr", k=3000)), "a" * 3000]


def test_bpe_fuzz():
    library, own = Tokenizer.from_file(queries.BYTE_VOCAB), bpe.load(queries.BYTE_VOCAB)
    for t in fuzz_texts():
        ids = np.frombuffer(own.encode(t)[1], "<u4")
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert bpe.byte_text(own.decode(ids)[0].tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False).encode()


def test_bpe_remembers_many_pieces(monkeypatch):
    """Pieces of 300,000 kinds are encoded once, not each time they come."""
    own, calls = bpe.ByteBpe(queries.BYTE_VOCAB), []
    plain = own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda word: calls.append(1) or plain(word))
    texts = [" ".join(f"{a:x}.{b}" for b in range(1000)) for a in range(300)]
    first = [own.encode(t) for t in texts]
    seen = len(calls)
    own._words.clear()
    assert [own.encode(t) for t in texts] == first
    assert len(calls) - seen < 1000


def test_sstable(spark, docs, empty):
    library = Tokenizer.from_file(queries.WORD_VOCAB)
    folder = common.scratch(spark, "sst")
    manifest = sstable.write_shards(docs, queries.WORD_VOCAB, folder)
    got = sstable.read_shards(spark, folder, manifest).collect()
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in texts()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    system, _ = sstable.file_system(folder)
    found = {}
    for m in manifest:
        with system.open_input_file(m["path"]) as f:
            reader = sstable.Reader(f)
            for i, x in ids:
                hit = reader.get(i)
                if hit is not None:
                    found[i] = hit.tolist()
            assert reader.get(987654) is None
    assert found == {i: x.tolist() for i, x in ids}
    assert sstable.write_shards(empty, queries.WORD_VOCAB, common.scratch(spark, "sst")) == []
    assert sstable.read_shards(spark, folder, []).count() == 0


def test_sstable_chunks_equal_whole_texts():
    library, own = Tokenizer.from_file(queries.WORD_VOCAB), sstable.chunk_encoder(queries.WORD_VOCAB)
    rows = fuzz_texts() + [t or "" for _, t in texts()]
    for _ in range(2):  # the second time most is known
        raw = [t.encode() for t in rows]
        ids, bounds = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), [7])
        assert len(bounds) == len(rows) + 1 and bounds[-1] == len(ids)
        for t, a, b in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist()):
            assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 7]
    assert own.encode(np.zeros(0, np.uint8), np.zeros(3, np.int64), [7])[0].tolist() == [7, 7]


def test_sstable_remembered_chunks_are_small():
    """What is known takes some tens of bytes a chunk, or a worker's memory is full of it."""
    own = sstable.ChunkEncoder(queries.WORD_VOCAB)
    rows = [f"{i:x}g{i * 7919:x}".encode() for i in range(60_000)]
    tracemalloc.start()
    try:
        for k in range(0, len(rows), 5_000):
            data = b" ".join(rows[k : k + 5_000])
            own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]), [1])
        common.Words._up = common.Words._down = np.zeros(0, np.uint64)
        assert tracemalloc.get_traced_memory()[0] < 100 * len(rows)
    finally:
        tracemalloc.stop()


def test_sstable_one_identifier_in_many_rows(spark, tmp_path):
    """Two identifiers, one of them null, that have most rows: they take several shards."""
    rows = [(None if i % 3 else i, words(random.Random(i), 20)) for i in range(200)] + [(7, words(random.Random(i), 20)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    folder = common.scratch(spark, "sst")
    manifest = sstable.write_shards(frame, queries.WORD_VOCAB, folder)
    got = sorted(sstable.read_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted((i for i, _ in rows), key=lambda d: (d is not None, d or 0))
    assert len(manifest) >= 6 and max(m["docs"] for m in manifest) < 200


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(queries.WORD_VOCAB)
    got = rankmerge.count_tokens(docs, queries.WORD_VOCAB, limit=100).collect()
    counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    assert by_id(got) == by_id((i, b, n, n > 100) for i, b, n in counts)
    assert rankmerge.count_tokens(empty, queries.WORD_VOCAB).count() == 0


def test_token_counts_fuzz():
    library, own = Tokenizer.from_file(queries.WORD_VOCAB), rankmerge.load(queries.WORD_VOCAB)
    rows = fuzz_texts()
    assert own.count([t.encode() for t in rows]) == [len(library.encode(t, add_special_tokens=False).ids) for t in rows]


def shingle_set(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent):
    number = {}
    sets = [frozenset(number.setdefault(x, len(number)) for x in shingle_set(t)) for _, t in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links[i].append(j)
                links[j].append(i)
    comps = brute_components(len(rows), links)
    least = defaultdict(list)
    for (i, _), c in zip(rows, comps):
        least[c].append(i)
    return [(i, len(s), min(least[c]), i == min(least[c])) for (i, _), s, c in zip(rows, sets, comps)]


def test_minhash(docs, empty):
    rows = [(i, t) for i, t in texts() if i is not None]
    got = minhash.near_duplicates(docs.where("doc_id is not null"), 85).collect()
    assert by_id(got) == by_id(brute_near(rows, 85))
    assert minhash.near_duplicates(docs, 85).count() == len(texts())
    assert minhash.near_duplicates(empty, 85).count() == 0


def test_minhash_large_family(spark):
    """Copies of copies, most of them near the threshold, over several blocks."""
    rng = random.Random(8)
    base = words(rng, 140, 5000).split()
    rows = []
    for i in range(1200):
        own = list(base if i < 900 else rows[rng.randrange(900)][1].split())
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in minhash.near_duplicates(frame, 85).collect()) == sorted(brute_near(rows, 85))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    links = defaultdict(list)
    for u, v in edges:
        links[u].append(v)
        links[v].append(u)
    comps = brute_components(2100, [links[i] for i in range(2100)])
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for i in range(2100):
        assert got.get(i, i) == comps[i]


def test_language_model_base_and_normalisation(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(0, 60), 25 + i % 300)) for i in range(200)] + [(500, None), (501, ""), (502, "never seen words"), (502, "never seen words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", common.F.lit(1))
    train = frame.where("doc_id % 3 <> 0")
    got = sorted(tuple(r) for r in bilinear.score(frame, train).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if i % 3 for w in ws)
    size = sum(c.values()) + len(c) + 1
    want = sorted((i, len(ws), sum(c[w] > 0 for w in ws), sum(c.values()), sum(math.log10((c[w] + 1) / size) for w in ws)) for i, ws in tokens)
    assert [w[:4] for w in want] == [g[:4] for g in got]
    assert np.allclose([w[4] for w in want], [g[4] for g in got], rtol=1e-9)
    assert bilinear.score(frame.limit(0), train).count() == 0
    assert bilinear.score(frame, train.limit(0)).count() == len(rows)


def test_language_model_by_brute_force(spark, monkeypatch):
    """After training: over all words and one unseen word for each rest, probabilities add up to 1; scores are their logarithms."""
    monkeypatch.setattr(bilinear, "TARGETS", 150)
    monkeypatch.setattr(bilinear, "CONTEXTS", 40)
    monkeypatch.setattr(bilinear, "FREQUENT", 200)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60), 25 + i % 300)) for i in range(200)] + [(500, None), (501, "never w3 seen words"), (502, "w1 w1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    learned = bilinear.learn(frame.where("doc_id % 3 <> 0"))
    c = Counter(w for i, t in rows if i % 3 for w in [*(t or "").encode().split(), b"\n"])
    # which words are targets and contexts: by count, then by bytes
    order = sorted((w for w in c if w != b"\n"), key=lambda w: (-c[w], w))
    m = learned.model
    n_targets, n_contexts = len(m.target) - 1 - bilinear.REST, len(m.context) - 1 - bilinear.REST
    assert (n_targets, n_contexts) == (min(150, learned.counts.words), 40) and len(order) > n_targets

    def place(w, n):
        if w == b"\n":
            return 0
        at = order.index(w) if w in c else n
        return 1 + at if at < n else 1 + n + int(bilinear.rest_classes([w])[0])

    in_rest = Counter()
    for w in order[n_targets:]:
        in_rest[int(bilinear.rest_classes([w])[0])] += c[w] + 1

    def probability(w, one, two):
        x = m.context[place(one, n_contexts)] * m.near + m.context[place(two, n_contexts)] * m.far
        logits = m.target.astype(float) @ x.astype(float) + m.bias
        share = np.exp(logits - logits.max())
        k = place(w, n_targets)
        inside = (c[w] + 1) / (in_rest[int(bilinear.rest_classes([w])[0])] + 1) if k > n_targets else 1
        return share[k] / share.sum() * inside

    unseen = {}
    for k in range(5000):
        unseen.setdefault(int(bilinear.rest_classes([b"?%d" % k])[0]), b"?%d" % k)
    assert len(unseen) == bilinear.REST
    for one, two in ((b"\n", b"\n"), (b"w1", b"\n"), (b"w299", b"w7"), (b"never", b"w2")):
        assert abs(sum(probability(w, one, two) for w in [*c, *unseen.values()]) - 1) < 1e-6
    got = dict(bilinear.score_with(frame, learned).select("doc_id", "score").collect())
    for i, t in rows[::9] + rows[-3:]:
        ws = [b"\n", b"\n", *(t or "").encode().split(), b"\n"]
        want = sum(math.log10(probability(w, one, two)) for two, one, w in zip(ws, ws[1:], ws[2:]))
        assert abs(want - got[i]) < 1e-3 * max(1, abs(want)), i


def test_language_model_sends_counts_of_many_words(spark):
    """Counts of 60,000 words go to the executors and needn't be joined for each word of each text."""
    words = spark.range(60_000).selectExpr("cast(cast(id as string) as binary) as word", "2L as c")
    counts = bilinear.gather(words)
    assert len(counts.frequent) == 60_000 and counts.total == 120_000 and counts.distinct == 60_000 and counts.words == bilinear.TARGETS


def test_language_model_words_are_those_of_the_contract():
    """Words, their numbers and counts by brute force: odd bytes, words at the edges of texts, empty texts, words held a few at a time."""
    rng = random.Random(10)
    signs = ["a", "Z", "[", "@", "`", "{", "é", "\u00a0", "\u3000", "\x00", "\x08", "\x0e", "\x1c", "\x1f", "\x7f", *" \t\n\v\f\r"]
    for _ in range(200):
        texts = ["".join(rng.choices(signs, k=rng.randrange(8))) for _ in range(rng.randrange(6))]
        want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
        words, first = bilinear.split(pa.array(["cut off", *texts], pa.string())[1:])
        assert words.to_pylist() == [w for ws in want for w in ws]
        assert np.diff(first).tolist() == [len(ws) for ws in want] and first[0] == 0
        tails = [int.from_bytes(w[-3:], "big") * 2654435761 % 2**64 // 2**16 % bilinear.REST for ws in want for w in ws]
        assert bilinear.rest_classes(words).tolist() == bilinear.rest_classes(words.to_pylist()).tolist() == tails
        c = Counter(w for ws in want for w in ws)
        parts = [(words.slice(i, 2), np.ones(len(words.slice(i, 2)), np.int64)) for i in range(0, len(words), 2)] + [(pa.array([b"zz"], pa.binary()), np.array([3]))]
        found, total = bilinear.merged(parts)
        assert dict(zip(found.to_pylist(), total.tolist())) == {**c, b"zz": 3}
    batches = [pa.record_batch({"n": [i] * k}) for i, k in enumerate((3, 1, 40, 2, 2))]
    got = [*bilinear.grouped(batches, 50)]
    assert pa.Table.from_batches(got) == pa.Table.from_batches(batches) and [g.num_rows for g in got] == [4, 40, 4]


def test_language_model_counts_when_few_words_are_held(monkeypatch):
    rng = random.Random(13)
    rows = [words(rng, rng.randrange(40), 30) for _ in range(120)]
    batches = [pa.record_batch({"doc_id": range(i, i + 8), "text": rows[i : i + 8]}) for i in range(0, 120, 8)]
    want = Counter(w for t in rows for w in [*t.encode().split(), b"\n"])
    for limit, size in ((300_000, 1 << 20), (45, 1 << 20), (20, 1 << 20), (300_000, 1000), (300_000, 1)):
        monkeypatch.setattr(bilinear, "HELD_WORDS", limit)
        monkeypatch.setattr(bilinear, "HELD_BYTES", size)
        got = [b.to_pydict() for b in bilinear.word_counts(iter(batches))]
        assert sum((Counter(dict(zip(g["word"], g["c"]))) for g in got), Counter()) == want
        assert len(got) == (1 if limit > 31 and size > 999 else 15)
    assert [*bilinear.word_counts(iter([]))] == []


def test_language_model_looks_words_up_without_python_objects():
    """Numbers of all words take less than 2.5 times what Python needs to split texts alone (1.4 times when this was written, 4.2 with a dictionary)."""
    rng = np.random.Generator(np.random.PCG64(11))
    known = [b"w%d" % i for i in range(bilinear.TARGETS + 30_000)]
    at = (rng.pareto(0.3, 400_000).clip(0, 1e12) * 20).astype(np.int64) % (3 * len(known))
    texts = pa.array([" ".join(["w%d" % i for i in part]) for part in np.split(at, 400)], pa.string())
    zeros = np.zeros(1 + bilinear.TARGETS + bilinear.REST)
    codes = bilinear.Codes(bilinear.Counts(1, 1, 1, dict.fromkeys(known, 1), bilinear.TARGETS, zeros, zeros))

    def seconds(function):
        start = time.process_time()
        function()
        return time.process_time() - start

    alone = min(seconds(lambda: [t.lower().split() for t in common.cut_rows(*common.column_bytes(texts))]) for _ in range(5))
    assert min(seconds(lambda: codes.tokens(texts)) for _ in range(5)) < 2.5 * alone


def test_language_model_sums_of_gradients():
    """Sums by target and context are those of a loop, with numbers that stand once, often, and beyond 16 bits."""
    rng = np.random.Generator(np.random.PCG64(12))
    for top in (1, 5, 300, 70_000, 1 << 20):
        where = np.minimum(rng.geometric(2 / (top + 1), 500), top).astype(np.int32)
        rows, source = rng.normal(size=(90, 64)).astype(np.float32), rng.integers(0, 90, 500)
        at, total, order, first = bilinear.summed(where, rows, source)
        assert at.tolist() == sorted(set(where.tolist())) and where[order][first].tolist() == at.tolist()
        assert np.allclose(total, [rows[source[where == k]].sum(axis=0) for k in at], atol=1e-4)


def test_language_model_learns_context(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(("aa bb", "cc dd")[rng.randrange(2)] for _ in range(30))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = bilinear.score(frame, frame.where("doc_id < 250")).where("doc_id >= 250").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > 0.8 * got.b  # both are negative


def test_language(spark):
    rows = [(1, "the cat and the dog went to the house", "en"), (2, "le chat et le chien vont dans la maison", "fr"), (3, "the house that the man built", "en"), (4, "la maison que le monsieur a faite", "fr"), (5, None, "en"), (6, "123 ...", "fr"), (7, "words", None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(frame)
    assert profiles.languages == ["en", "fr"]
    asked = spark.createDataFrame([(1, "the dog and the man"), (2, "le chien et le monsieur"), (3, None), (4, "12 !"), (5, ""), (1, "the dog and the man")], "doc_id long, text string")
    got = language.predict(asked, profiles).collect()
    assert by_id((r.doc_id, r.lang_pred) for r in got) == by_id([(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")])
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language.learn(frame.limit(0))
    assert [r.lang_pred for r in language.predict(asked, nothing).collect()] == ["und"] * 6


def test_language_distance_by_brute_force():
    text = "Sphinx of black quartz, judge my vow. Über"
    values, offsets = language.grams([text])
    padded = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(padded.split()) + " "
    want = Counter(padded[i] for i in range(len(padded)) if padded[i] != " ")
    want += Counter(padded[i : i + 2] for i in range(len(padded) - 1))
    want += Counter(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    assert sorted(np.unique(values, return_counts=True)[1].tolist()) == sorted(want.values()) and offsets.tolist() == [0, sum(want.values())]


def test_language_accuracy_on_held_out(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    frame = common.table(spark, d, "documents")
    labels = common.table(spark, d, "labels")
    chain = toxicity.train(frame, labels.where("doc_id % 4 <> 0"), toxicity.CATEGORIES, 2000)
    got = toxicity.score(frame, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").select("p_toxic", "toxic").collect()
    hits = sum(r.toxic == 1 and r.p_toxic >= 0.5 for r in got)
    assert hits >= 0.6 * sum(r.toxic == 1 for r in got) and not sum(r.toxic == 0 and r.p_toxic >= 0.5 for r in got)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(texts())
    assert all(r.p_toxic == 0 for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.classify(empty, labels.limit(0)).count() == 0
    assert {r.p_toxic for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


def item_shingles(text):
    w, word = [], bytearray()
    for b in (text or "").encode().lower() + b" ":
        if b >= 128 or chr(b).isalnum():
            word.append(b)
        elif word:
            w.append(bytes(word))
            word = bytearray()
    return w


def brute_items(rows, items, share=0.8):
    out = []
    for i, t in rows:
        w = item_shingles(t)
        hits = set()
        for k, x in items:
            v = item_shingles(x)
            if k is None or not v:
                continue
            n = min(5, len(v))
            own = {tuple(v[j : j + n]) for j in range(max(1, len(v) - 4))}
            if len({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} & own) >= share * len(own):
                hits.add(k)
        out.append((i, len(hits), sorted(hits)))
    return out


def test_decontamination(spark, docs, empty):
    rng = random.Random(7)
    items = [(k, words(rng, n, 3000)) for k, n in enumerate([1, 3, 5, 6, 9, 12, 20, 33, 64, 120, 300])] + [(20, None), (21, ""), (None, "a b c d e f"), (5, words(rng, 12, 3000)), (22, "one two")]
    rows = list(texts())
    for k, text in [x for x in items if x[1]]:
        own = text.split()
        rows.append((100 + len(rows), words(rng, 700, 3000) + " " + text.upper() + ". " + words(rng, 700, 3000)))
        if len(own) > 20:
            own[len(own) // 2] = "changed"
            rows.append((100 + len(rows), words(rng, 300, 3000) + " " + " ".join(own) + ", " + words(rng, 300, 3000)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("item_ids", common.F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminated(frame, benchmark).collect()
    assert by_id((r.doc_id, r.n_items, list(r.item_ids)) for r in got) == by_id(brute_items(rows, items))
    kept = contamination.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, n, _ in brute_items(rows, items) if not n)
    assert contamination.contaminated(empty, benchmark).count() == 0
    assert contamination.contaminated(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(k, f"one two {k} three four five six") for k in range(20)], "item_id long, text string")
    frame = spark.createDataFrame([(1, "x one two 7 three four five six y"), (2, "none")], "doc_id long, text string")
    monkeypatch.setattr(contamination, "PART_SHINGLES", 30)
    got = contamination.contaminated(frame, benchmark).collect()
    assert by_id((r.doc_id, r.n_items, list(r.item_ids)) for r in got) == [(1, 1, [7]), (2, 0, [])]
    assert [r.doc_id for r in contamination.without_contaminated(frame, benchmark).collect()] == [2]
