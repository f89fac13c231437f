"""Language-model scores by a log-bilinear neural model.

Token counts come from all training documents. Targets are words: the ``TARGETS`` most frequent ones and the end have a vector
and a bias each; every other word belongs to a rest target by its last letters, and has within it a share by its count plus one,
with one share more for a word that training hasn't seen. Contexts are the two tokens before: the ``CONTEXTS`` most frequent words,
the end, and the rest by last letters. The context vectors, each times a diagonal matrix for its place, are added, and the product
with a target's vector plus its bias is the target's logit. Training is by noise-contrastive estimation against the unigram
distribution of targets: every task runs over its documents in gradient steps that are scaled by what each vector has moved so far,
all from the same start, and the results are averaged by the number of tokens. This is done ``ROUNDS`` times, each time with
another part of the documents; all training documents take part in the same way at every size.

Scores are normalised over all targets: a logit is a sum of two products, one for each place, so the sum of its exponentials over
all targets is, for all pairs of contexts at once, a product of two matrices. It is worked out once, in batches of targets, and the table
of ``CONTEXTS`` squared pairs goes to the executors with the vectors; all sizes are fixed. Counts of words that aren't
frequent are joined by word, so nothing that grows with the data is broadcast.

Defined results: null text: only the end token. Equal words in a hot place cost nothing more: the frequent words
are never shuffled. Without training documents every target is as likely as any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words with a vector of their own as targets and as contexts, and what all others are parted into by their last letters.
TARGETS, CONTEXTS, REST = 20_000, 960, 63
WIDTH, NOISE, ROUNDS, BATCH, RATE = 64, 128, 2, 1024, 0.07
#: Most frequent words that the executors get with their counts; the counts of all others are joined, with the same results.
FREQUENT = 200_000
#: Distinct words that a task holds before it sends their counts, and bytes of words.
HELD_WORDS, HELD_BYTES = 300_000, 64 << 20
#: Bytes of batches that are put together where a table of words is built for each.
GROUP_BYTES = 4 << 20
END = b"\n"


def rest_classes(words: pa.Array | list[bytes]) -> np.ndarray:
    """For each word the number of its rest, by its last three bytes."""
    if not isinstance(words, pa.Array):
        words = pa.array(words, pa.binary())
    data, offsets = common.column_bytes(words)
    start, end = offsets[:-1], offsets[1:]
    number = np.zeros(len(words), np.uint64)
    for back in (3, 2, 1):
        at = end - back
        number <<= np.uint64(8)
        if len(data):
            number += np.where(at < start, 0, data.take(np.maximum(at, 0)))
    return ((number * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(REST)).astype(np.int32)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts (binary), and n + 1 offsets: where each text's words start among them."""
    data, offsets = common.column_bytes(texts)
    raw = np.frombuffer(b" ".join([b"", *common.cut_rows(data, offsets), b""]), np.uint8)  # texts are parted by spaces
    low = raw | (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    inside = (low != 32) & ((low - np.uint8(9)) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
    return words, np.searchsorted(starts, offsets + np.arange(1, len(offsets) + 1))


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """For each word its place among the others, or -1."""
    return pc.index_in(words, among).fill_null(-1).to_numpy()


def grouped(batches: Iterable[pa.RecordBatch], limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, several batches at a time as long as they have at most ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


@dataclass
class Counts:
    """What is known of the training tokens: N, V, the frequent words with counts (the most frequent first), and each rest target's mass."""

    total: int
    distinct: int
    end: int
    frequent: dict[bytes, int]
    #: How many of the frequent words are targets.
    words: int
    #: For each target (the end, words, rests): sum of (count + 1) of its words; for rests one more.
    mass: np.ndarray
    #: Tokens of each target in training.
    tokens: np.ndarray


def merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of all parts, and the sum of each one's counts."""
    found = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
    total = np.bincount(found.indices.to_numpy(), np.concatenate([c for _, c in parts]), len(found.dictionary))
    return found.dictionary, total.astype(np.int64)


def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text): words and their counts; a word comes again where more are held than fit."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    rows, size, again = 0, 0, HELD_WORDS
    for batch in common.pieces(batches):
        found = split(batch.column(1))[0].dictionary_encode()
        held.append((found.dictionary, np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))))
        held.append((pa.array([END], pa.binary()), np.array([batch.num_rows])))
        rows += len(found.dictionary)
        size += found.dictionary.nbytes
        if rows > again or size > HELD_BYTES:
            held = [merged(held)]
            rows, size = len(held[0][0]), held[0][0].nbytes
            if rows > HELD_WORDS or size > HELD_BYTES // 2:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["word", "c"])
                held, rows, size = [], 0, 0
            again = rows + HELD_WORDS  # the distinct words so far, and as many new rows
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, merged(held))], ["word", "c"])


def count_words(train: DataFrame) -> DataFrame:
    """(word binary, c long) of all training tokens; the end token is END."""
    return common.written(common.arrow_map(common.texts(train), word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def gather(words: DataFrame) -> Counts:
    # the least count of a frequent word, from the counts of counts: only frequent words come to the driver
    least, room = None, FREQUENT
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(FREQUENT).collect():
        room -= r.n
        if room < 0:
            break
        least = r.c
    chosen = words.where(F.col("c") >= least) if least is not None else words.orderBy(F.desc("c"), "word").limit(FREQUENT)
    # as Arrow columns, since rows of Python objects would fill the driver
    found = chosen.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    frequent = dict(zip(found["word"].to_pylist(), found["c"].to_pylist()))
    del found
    end = frequent.pop(END, None)
    if end is None:
        row = words.where(F.col("word") == F.lit(END)).first()
        end = row.c if row else 0
    own = dict(islice(frequent.items(), TARGETS))
    apart = pa.array([END, *own], pa.binary())

    def masses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((REST + 1, 4), np.int64)  # the last row: all words
        for batch in grouped(batches):
            all_words, c = batch.column(0), batch.column(1).to_numpy()
            found[REST, 2:] += len(c), c.sum()
            other = places(all_words, apart) < 0
            rest = rest_classes(all_words)[other]
            np.add.at(found[:, 0], rest, c[other] + 1)
            np.add.at(found[:, 1], rest, c[other])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(REST + 1)), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(4))], ["k", "mass", "tokens", "seen", "n"])

    rows = common.arrow_map(words, masses, "k long, mass long, tokens long, seen long, n long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("mass", "tokens", "seen", "n"))).collect()
    known = np.array([end, *own.values()], np.float64)
    mass, tokens, total, distinct = np.ones(REST), np.zeros(REST), 0, 0
    for r in rows:
        if r.k == REST:
            total, distinct = r.n, r.seen
        else:
            mass[r.k] += r.mass
            tokens[r.k] = r.tokens
    return Counts(total, distinct, end, frequent, len(own), np.concatenate([known + 1, mass]), np.concatenate([known, tokens]))


@dataclass
class Model:
    """Vectors of contexts and targets, a diagonal for each of the two places, biases of targets."""

    context: np.ndarray
    target: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, tokens: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(9))
        contexts = 1 + min(CONTEXTS, len(tokens) - 1 - REST) + REST
        share = (tokens + 1) / (tokens + 1).sum()
        parts = rng.normal(0, 0.3, (contexts, WIDTH)), rng.normal(0, 0.1, (len(tokens), WIDTH)), np.ones(WIDTH), np.full(WIDTH, 0.5), np.log(share)
        return cls(*(p.astype(np.float32) for p in parts))

    def rows(self) -> np.ndarray:
        """As a matrix: one row for each vector, the bias last."""
        vectors = np.vstack([self.near, self.far, self.context, self.target])
        bias = np.concatenate([np.zeros(2 + len(self.context), np.float32), self.bias])
        return np.hstack([vectors, bias[:, None]])

    @classmethod
    def of(cls, m: np.ndarray, targets: int) -> Model:
        m = np.asarray(m, np.float32)
        vectors, bias = np.ascontiguousarray(m[:, :-1]), m[-targets:, -1].copy()
        return cls(vectors[2:-targets].copy(), vectors[-targets:].copy(), vectors[0].copy(), vectors[1].copy(), bias)


def summed(where: np.ndarray, rows: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of where in ascending order, for each the sum of rows[source], and the sorted order and where in it each starts."""
    order = np.argsort(where.astype(np.uint16) if where.max() < 1 << 16 else where, kind="stable")  # short numbers sort by radix
    at = where.take(order)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    times = np.append(first[1:], len(at)) - first
    pairs, source = rows.view(np.complex64), source.take(order)  # two numbers are added as one complex one, which takes half the loops
    total = pairs.take(source.take(first), axis=0)
    several = np.flatnonzero(times > 1)  # only these are added up
    if len(several):
        added = source[np.repeat(times > 1, times)]
        times = times.take(several)
        total[several] = np.add.reduceat(pairs.take(added, axis=0), np.cumsum(times) - times, axis=0)
    return at.take(first), total.view(np.float32), order, first


class Trainer:
    """Gradient steps on a model; every vector's step is divided by the root of what its gradients have been so far."""

    def __init__(self, model: Model, log_noise: np.ndarray, rate: float):
        #: log_noise: the logarithm of the number of draws expected of each target.
        self.model, self.log_noise, self.rate = model, log_noise, np.float32(rate)
        self.moved = {name: np.full(len(getattr(model, name)), 1e-2, np.float32) for name in ("context", "target", "bias")}
        self.moved |= {name: np.full(1, 1e-2, np.float32) for name in ("near", "far")}

    def _move(self, name: str, at: np.ndarray | slice, total: np.ndarray) -> None:
        """Go the way of the summed gradients of the named part's rows ``at``; a row whose sum is 0 stays as it is."""
        value, moved = getattr(self.model, name), self.moved[name]
        moved[at] += np.einsum("ij,ij->i", total, total) / WIDTH if total.ndim == 2 else total * total
        scale = self.rate / np.sqrt(moved[at])
        total *= scale[:, None] if total.ndim == 2 else scale
        value[at] += total

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
        """one, two: the context before and the one before that; noise: drawn targets, shared by the batch."""
        m, log_noise, n = self.model, self.log_noise, len(target)
        predicted = (m.context * m.near).take(one, axis=0)
        predicted += (m.context * m.far).take(two, axis=0)
        # gradients: of the targets, of the noise, of what is predicted
        rows = np.empty((n + len(noise) + n, WIDTH), np.float32)
        to_target, to_noise, to_predicted = rows[:n], rows[n:-n], rows[-n:]
        q, drawn = m.target.take(target, axis=0), m.target.take(noise, axis=0)
        real = np.einsum("ij,ij->i", predicted, q)
        real += m.bias.take(target) - log_noise.take(target)
        down = predicted @ drawn.T
        np.subtract(log_noise.take(noise) - m.bias.take(noise), down, out=down)
        with np.errstate(over="ignore"):  # an infinite exponential is a share of 0
            up = 1 / (1 + np.exp(real))  # towards 1
            np.exp(down, out=down)
        down += 1
        np.reciprocal(down, out=down)  # towards 0
        np.multiply(up[:, None], predicted, out=to_target)
        np.negative(np.matmul(down.T, predicted, out=to_noise), out=to_noise)
        np.multiply(up[:, None], q, out=to_predicted)
        to_predicted -= down @ drawn
        # sums for each target, each context one before and each context two before
        targets, contexts = len(m.target), len(m.context)
        where = np.concatenate([target, noise, one + targets, two + (targets + contexts)])
        at, total, order, first = summed(where, rows, np.concatenate([np.arange(len(rows)), np.arange(len(rows) - n, len(rows))]))
        a, b = np.searchsorted(at, (targets, targets + contexts))
        bias = np.zeros(len(where), np.float32)
        bias[:n] = up
        bias[n : n + len(noise)] = -(np.ones(n, np.float32) @ down)
        self._move("bias", at[:a], np.add.reduceat(bias.take(order), first)[:a])
        self._move("target", at[:a], total[:a])
        # by place, as the place's diagonal is the same for all of a context's tokens
        to_context, ways = np.zeros_like(m.context), []
        for chosen, sums, diagonal in ((at[a:b] - targets, total[a:b], m.near), (at[b:] - (targets + contexts), total[b:], m.far)):
            ways.append(np.einsum("ij,ij->j", sums, m.context.take(chosen, axis=0)))
            sums *= diagonal
            to_context[chosen] += sums
        self._move("context", slice(None), to_context)
        for name, way in zip(("near", "far"), ways):
            self.moved[name] += way @ way / WIDTH
            value = getattr(m, name)
            value += self.rate / 10 * way / np.sqrt(self.moved[name])


class Codes:
    """The words that are targets, and the target and context of each; those of any other word are worked out."""

    def __init__(self, counts: Counts):
        self.words = pa.array([*islice(counts.frequent, counts.words)], pa.binary())
        self.targets, self.contexts = counts.words, min(CONTEXTS, counts.words)
        at = np.arange(self.targets, dtype=np.int32)
        self.context = np.where(at < self.contexts, at + 1, 1 + self.contexts + rest_classes(self.words))

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of all texts' tokens, each text with its end: targets, contexts, where texts start; and the words that aren't targets themselves."""
        words, ends = split(texts)
        at = places(words, self.words)
        other = at < 0
        rare = words.filter(pa.array(other))
        rest = rest_classes(rare)
        context = np.append(self.context, np.int32(0)).take(at)  # -1: the last one
        context[other] = 1 + self.contexts + rest
        target = at + np.int32(1)
        target[other] = 1 + self.targets + rest
        starts = ends + np.arange(len(ends))
        return np.insert(target, ends[1:], 0), np.insert(context, ends[1:], 0), starts, rare


class Logs:
    """log10(c + 1) of the targets and of the other frequent words."""

    def __init__(self, counts: Counts):
        words, c = [*counts.frequent], np.array([*counts.frequent.values()], np.float64)
        logs = np.log10(c + 1)
        #: For each target; 0 for rests, whose words each have their own.
        self.target = np.concatenate([[np.log10(counts.end + 1)], logs[: counts.words], np.zeros(REST)])
        self.words, self.other = pa.array(words[counts.words :], pa.binary()), np.append(logs[counts.words :], 0.0)


def before(context: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context before each token and the one before that; before a text stand ends."""
    one, two = np.zeros(len(context), np.int32), np.zeros(len(context), np.int32)
    one[1:] = context[:-1]
    two[2:] = context[:-2]
    first = starts[:-1]
    one[first] = 0
    two[first] = 0
    two[first[np.diff(starts) > 1] + 1] = 0
    return one, two


def train_model(train: DataFrame, counts: Counts) -> Model:
    spark = train.sparkSession
    model = Model.start(counts.tokens)
    share = (counts.tokens + 1) ** 0.75
    share /= share.sum()
    edges, targets = np.cumsum(share), len(share)
    log_noise = np.log(share * NOISE).astype(np.float32)
    codes = Codes(counts)
    source = common.texts(train)
    for round_ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.rows(), codes))
        rate = RATE / (1 + round_)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, codes = sent.value
            trainer = Trainer(Model.of(rows, targets), log_noise, rate)
            rng = np.random.Generator(np.random.PCG64(31 + round_))
            seen = 0
            for batch in common.pieces(batches):
                target, context, starts, _ = codes.tokens(batch.column(1))
                one, two = before(context, starts)
                order = rng.permutation(len(target))
                one, two, target = one.take(order), two.take(order), target.take(order)
                draws = np.minimum(np.searchsorted(edges, rng.random((len(target) // BATCH + 1, NOISE))), targets - 1)
                for k, a in enumerate(range(0, len(target), BATCH)):
                    at = slice(a, a + BATCH)
                    trainer.step(one[at], two[at], target[at], draws[k])
                seen += len(target)
            if seen:
                m = trainer.model.rows() * np.float32(seen)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array(np.full(len(part), float(seen))), *(pa.array(np.ascontiguousarray(part[:, j])) for j in range(m.shape[1]))], ["row", "weight", *columns])

        columns = [f"x{j}" for j in range(WIDTH + 1)]
        part = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == round_)
        got = common.arrow_map(part, run, "row long, weight double, " + ", ".join(f"{c} float" for c in columns))
        mean = got.groupBy("row").agg(*((F.sum(c) / F.sum("weight")).cast("float").alias(c) for c in columns)).toPandas().sort_values("row")
        if len(mean):
            model = Model.of(mean[columns].to_numpy(), targets)
        sent.unpersist()
    return model


def normalisers(model: Model, batch: int = 4096) -> np.ndarray:
    """norm[c, d]: the logarithm of the sum over all targets of exp(logit) where c is the context before and d the one before that."""
    near, far = (model.context * model.near).astype(np.float64), (model.context * model.far).astype(np.float64)
    spans = [slice(a, a + batch) for a in range(0, len(model.target), batch)]
    logits = lambda x, s: x @ model.target[s].T.astype(np.float64)
    top_near = np.max([(logits(near, s) + model.bias[s]).max(axis=1) for s in spans], axis=0)[:, None]
    top_far = np.max([logits(far, s).max(axis=1) for s in spans], axis=0)[:, None]
    total = np.zeros((len(near), len(near)))
    for s in spans:
        total += np.exp(logits(near, s) + model.bias[s] - top_near) @ np.exp(logits(far, s) - top_far).T
    return np.log(total) + top_near + top_far.T


def log_shares(model: Model, norm: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The natural logarithm of each target's probability after the two contexts."""
    out = np.empty(len(target))
    near, far = model.context * model.near, model.context * model.far
    for a in range(0, len(target), 1 << 11):  # blocks that stay in the cache
        s = slice(a, a + (1 << 11))
        predicted = near.take(one[s], axis=0)
        predicted += far.take(two[s], axis=0)
        out[s] = np.einsum("ij,ij->i", predicted, model.target.take(target[s], axis=0))
    return out + model.bias[target] - norm[one, two]


@dataclass
class Learned:
    """All that a scorer needs: counts of all words as a table, of the frequent ones here, and the model."""

    words: DataFrame
    counts: Counts
    model: Model


def learn(train: DataFrame) -> Learned:
    words = count_words(train)
    counts = gather(words)
    return Learned(words, counts, train_model(train, counts))


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    train: the documents to learn from.
    """
    return score_with(docs, learn(train))


def score_with(docs: DataFrame, learned: Learned) -> DataFrame:
    """``score`` by what ``learn`` gave."""
    counts, model = learned.counts, learned.model
    size = counts.total + counts.distinct + 1
    log_mass, end_known = np.log10(counts.mass), counts.end > 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model, normalisers(model), log_mass, Codes(counts), Logs(counts)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, norm, log_mass, codes, known_logs = sent.value
        for batch in common.pieces(grouped(batches), limit=GROUP_BYTES):
            target, context, starts, rare = codes.tokens(batch.column(2))
            one, two = before(context, starts)
            by_target = log_shares(model, norm, one, two, target) / np.log(10) - log_mass[target]
            # log10(c + 1) of each token: here for frequent words, by a join for the others
            found = rare.dictionary_encode()
            which, at = found.indices.to_numpy(), places(found.dictionary, known_logs.words)
            in_rest = target > codes.targets
            logs = known_logs.target[target]
            logs[in_rest] = known_logs.other[at[which]]
            unknown = np.zeros(len(target), bool)
            unknown[in_rest] = at[which] < 0
            known = ~unknown & ((target > 0) | end_known)
            first = starts[:-1]
            sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), logs, by_target)]
            n = np.diff(starts)
            # the words left over, by text: each text's distinct ones and how often they stand there
            keys, times = np.unique((np.repeat(np.arange(len(n)), n)[unknown] << 32) + which[at[which] < 0], return_counts=True)
            edges = pa.array(np.searchsorted(keys >> 32, np.arange(len(n) + 1)), pa.int32())
            words = pa.ListArray.from_arrays(edges, found.dictionary.take(pa.array(keys & 0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, *sums)), words, pa.ListArray.from_arrays(edges, pa.array(times))], _NAMES)

    parts = common.written(common.arrow_map(rows, run, "row long, doc_id long, n_tokens long, n_known long, logs double, by_target double, words array<binary>, times array<long>"), "scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times")).join(learned.words, "word")
    found = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = parts.drop("words", "times").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(size))).alias("base_score"), (logs + F.col("by_target")).alias("score"),
    )


_NAMES = ["row", "doc_id", "n_tokens", "n_known", "logs", "by_target", "words", "times"]
