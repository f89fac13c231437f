"""Toxicity by a chain of classifiers.

The categories stand in a fixed order. Each has a logistic regression over the words of a document and their stems
(first bytes), and every model after the first also gets the probabilities of the categories before it. While
training, these are out-of-fold: each training document's probability comes from a model that hasn't seen the
document, so later models learn how far the earlier ones can be trusted. The model that scores is then fitted on all.

Training reads labelled rows only, at most ``sample_rows`` of them (those with the least hash of their id, so the
sample doesn't depend on the order or number of files). All documents are scored, over their whole text.

Features: a word or stem counts as 1 if it is in the document at all, as insults do their harm once; a second
feature block has the share of the document's words that it makes up, so that a long text isn't toxic by chance.

Defined results: null, empty or wordless text has probability 0 in every category. Labels that are null, and
documents with labels that contradict each other, don't train. Without any usable label, or with one class only, a
category has its base rate (0 without labels) as probability for all. Rows with equal doc_id each have a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
STEM = 5
#: Most frequent features that may be chosen from, and how many are.
CANDIDATES, FEATURES = 30_000, 400
FOLDS = 5


def features_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """Distinct words and stems (marked by a leading star) of a lower-cased text, and their counts."""
    counts: dict[bytes, int] = {}
    for w in WORD.findall(text):
        counts[w] = counts.get(w, 0) + 1
    stems: dict[bytes, int] = {}
    for w, n in counts.items():
        if len(w) > STEM:
            stem = b"*" + w[:STEM]
            stems[stem] = stems.get(stem, 0) + n
    return [*counts, *stems], [*counts.values(), *stems.values()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method; the constant isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
        hessian[np.diag_indices_from(hessian)] += shrink
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Link:
    """One category of the chain: chosen features and weights (presence, share, earlier probabilities, constant)."""

    category: str
    weights: np.ndarray
    base_rate: float
    constant: bool = False


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    links: list[Link] = field(default_factory=list)

    def matrix(self, rows: list[tuple[list[bytes], list[int]]]) -> np.ndarray:
        """Presence and share of each chosen feature."""
        n = len(self.vocabulary)
        out = np.zeros((len(rows), 2 * n), np.float32)
        get = self.vocabulary.get
        for r, (names, counts) in enumerate(rows):
            total = 0
            for name, count in zip(names, counts):
                if name[:1] != b"*":
                    total += count
                k = get(name)
                if k is not None:
                    out[r, k] = 1
                    out[r, n + k] = count
            if total:
                out[r, n:] /= total / 100
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        out = np.zeros((len(x), len(self.links)))
        for k, link in enumerate(self.links):
            out[:, k] = link.base_rate if link.constant else probability(np.hstack([x, out[:, :k]]), link.weights)
        return out


def choose(rows: list[tuple[list[bytes], list[int]]], labels: np.ndarray) -> dict[bytes, int]:
    """The features that tell the labels apart best, by the G statistic of presence; an equal number for each category."""
    total: dict[bytes, int] = {}
    for names, _ in rows:
        for name in names:
            total[name] = total.get(name, 0) + 1
    names = sorted((n for n, c in total.items() if c >= 5), key=lambda n: (-total[n], n))
    index = {n: i for i, n in enumerate(names)}
    n_docs, seen = len(rows), np.array([total[n] for n in names], np.float64)
    chosen: dict[bytes, int] = {}
    for k in range(labels.shape[1]):
        positive = np.zeros(len(names))
        usable = labels[:, k]
        for (own, _), y in zip(rows, usable):
            if y == 1:
                for name in own:
                    i = index.get(name)
                    if i is not None:
                        positive[i] += 1
        rate = max(1e-9, min(1 - 1e-9, float((usable == 1).mean())))
        a, b = positive, seen - positive
        g = a * np.log(np.maximum(a, 1e-9) / (seen * rate)) + b * np.log(np.maximum(b, 1e-9) / (seen * (1 - rate)))
        for i in np.argsort(-g, kind="stable")[: FEATURES // labels.shape[1]].tolist():
            chosen.setdefault(names[i], len(chosen))
    assert n_docs == len(labels)
    return chosen


def fit(rows: list[tuple[list[bytes], list[int]]], labels: np.ndarray, categories: list[str], folds: np.ndarray) -> Chain:
    """rows: features of each training document; labels: 0 or 1 in a column for each category; folds: 0 .. FOLDS - 1."""
    chain = Chain(choose(rows, labels) if len(rows) else {})
    x = chain.matrix(rows)
    earlier = np.zeros((len(rows), 0))
    for k, category in enumerate(categories):
        y = labels[:, k].astype(np.float64) if len(rows) else np.zeros(0)
        rate = float(y.mean()) if len(y) else 0.0
        if rate in (0.0, 1.0):
            chain.links.append(Link(category, np.zeros(0), rate, constant=True))
            earlier = np.hstack([earlier, np.full((len(rows), 1), rate)])
            continue
        full = np.hstack([x, earlier])
        held = np.full(len(rows), rate)
        for fold in range(FOLDS):
            out = folds == fold
            if out.any() and 0 < y[~out].mean() < 1:
                held[out] = probability(full[out], logistic(full[~out], y[~out]))
        chain.links.append(Link(category, logistic(full, y), rate))
        earlier = np.hstack([earlier, held[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]], sample_rows: int) -> Chain:
    """categories: (name, SQL expression over the labels table that gives 0 or 1), in chain order."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(sql).cast("int").alias(f"y{k}") for k, (_, sql) in enumerate(categories)))
    ys = [f"y{k}" for k in range(len(categories))]
    agreed = wanted.dropna().groupBy("doc_id").agg(*(F.min(y).alias(y) for y in ys), *(F.max(y).alias(f"{y}_most") for y in ys))
    for y in ys:
        agreed = agreed.where(F.col(y) == F.col(f"{y}_most"))
    sample = agreed.select("doc_id", *ys).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = common.texts(docs).join(F.broadcast(sample), "doc_id")  # at most sample_rows rows of a few integers

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for batch in common.pieces(batches):
            place = batch.schema.get_field_index("text")
            made = [features_of(t.lower()) for t in common.cut_rows(*common.column_bytes(batch.column(place)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(batch.schema.get_field_index(y)) for y in ys), pa.array([b" ".join(n) for n, _ in made], pa.binary()), pa.array([np.array(c, "<u4").tobytes() for _, c in made], pa.binary())], ["doc_id", *ys, "names", "counts"])

    schema = ", ".join(["doc_id long", *(f"{y} int" for y in ys), "names binary", "counts binary"])
    got = common.arrow_map(joined, features, schema).toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got.column("doc_id")[i].as_py(), got.column("names")[i].as_py()))
    one: dict[bytes, bytes] = {}  # equal names share their bytes
    rows = [([one.setdefault(x, x) for x in got.column("names")[i].as_py().split(b" ") if x], np.frombuffer(got.column("counts")[i].as_py(), "<u4").tolist()) for i in order]
    y = np.array([[got.column(c)[i].as_py() for c in ys] for i in order], np.int64).reshape(len(rows), len(ys))
    ids = np.array([got.column("doc_id")[i].as_py() for i in order], np.int64)
    folds = (common.mix(ids.view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    return fit(rows, y, [name for name, _ in categories], folds)


def probabilities(chain: Chain, texts: list[bytes]) -> np.ndarray:
    """A column of probabilities for each category."""
    n, get = len(chain.vocabulary), chain.vocabulary.get
    x = np.zeros((len(texts), 2 * n), np.float32)
    some = np.zeros(len(texts), bool)
    for r, text in enumerate(texts):
        words = WORD.findall(text.lower())
        some[r] = bool(words)
        own = x[r]
        for w in words:
            k = get(w)
            if k is not None:
                own[n + k] += 1
            if len(w) > STEM:
                k = get(b"*" + w[:STEM])
                if k is not None:
                    own[n + k] += 1
        own[:n] = own[n:] > 0
        if words:
            own[n:] /= len(words) / 100
    p = chain.predict(x)
    p[~some] = 0.0
    return p


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> double for each row of docs."""
    names = [f"p_{link.category}" for link in chain.links]
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES words and as many weights for each category

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            p = probabilities(sent.value, common.cut_rows(*common.column_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return common.arrow_map(common.texts(docs), run, ", ".join(["doc_id long", *(f"{c} double" for c in names)]))


def without_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", limit: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose probability of the category is under the limit."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    column = [link.category for link in chain.links].index(category)
    least = LIMIT if limit is None else limit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.with_text(batches):
            p = probabilities(sent.value, common.cut_rows(*common.column_bytes(batch.column(batch.num_columns - 1))))
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(p[:, column] < least))

    return common.arrow_map(docs, run, docs.schema)


#: The chain over the labels table: documents of low quality first, then toxic ones, then toxic ones of low quality.
CATEGORIES = [("low_quality", "1 - quality"), ("toxic", "toxic"), ("toxic_low_quality", "toxic * (1 - quality)")]
#: Labelled rows that train.
SAMPLE_ROWS = 6_000
#: From this probability on a document is toxic.
LIMIT = 0.5


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, limit: float = LIMIT) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, p_toxic_low_quality, toxic (boolean)."""
    chain = train(docs, labels, CATEGORIES, sample_rows)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= limit)
