"""Language of a document by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams of letters (1 to 3 letters, a gap before and after each word), in order
of frequency, over all documents that it is learned from. A document's own most frequent n-grams are ranked in the same
way; the out-of-place distance to a language is the sum, over them, of how far each one's rank is from its rank in the
profile, with the profile's length for those that aren't in it. The nearest language wins, of equals the first by name.

``score`` is 1 less the distance over the greatest distance that the document could have.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing has been learned. Documents without a
language aren't learned from. Rows with equal doc_id each have a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: N-grams of a profile.
PROFILE = 300
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as 64-bit codes (21 bits a letter, 0 for a gap), joined, and the texts' offsets."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[np.minimum(codes, 0x10FFFF)], codes, 0)
    # a gap before and after each text; of several gaps one is enough
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    codes = np.insert(codes, np.concatenate([ends - sizes, ends]), 0)
    owner = np.insert(owner, np.concatenate([ends - sizes, ends]), np.concatenate([np.arange(len(texts))] * 2))
    order = np.argsort(owner, kind="stable") if (owner[1:] < owner[:-1]).any() else None
    if order is not None:
        codes, owner = codes[order], owner[order]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    c, owner = codes[keep].astype(np.uint64), owner[keep]
    one = c != 0
    same = owner[1:] == owner[:-1]
    two = same & ((c[1:] != 0) | (c[:-1] != 0))
    three = same[1:] & same[:-1] & (c[1:-1] != 0) if len(c) > 2 else np.zeros(0, bool)
    pair = c[:-1] << np.uint64(21) | c[1:]
    parts = [c[one], pair[two] | np.uint64(1 << 62)]
    owners = [owner[one], owner[1:][two]]
    if len(c) > 2:
        parts.append(((pair[:-1] & np.uint64((1 << 42) - 1)) << np.uint64(21) | c[2:])[three] | np.uint64(1 << 63))
        owners.append(owner[2:][three])
    # letter by letter, so that each text's n-grams stand together
    values, who = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return values[order], np.searchsorted(who[order], np.arange(len(texts) + 1))


@dataclass
class Profiles:
    languages: list[str]
    #: All n-grams of any profile, sorted, and the rank of each in each language (PROFILE: not in it).
    codes: np.ndarray
    ranks: np.ndarray


def top(values: np.ndarray) -> np.ndarray:
    """The most frequent codes, most frequent first, of equals the least first."""
    values = np.sort(values)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(start, len(values)))
    if len(start) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        start, counts = start[counts >= least], counts[counts >= least]
    order = np.argsort(-counts, kind="stable")[:PROFILE]
    return values[start[order]]


def learn(docs: DataFrame, lang_col: str = "lang") -> Profiles:
    """docs: text and a language; all of it is counted."""
    source = docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("lang is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            langs, codes, counts = [], [], []
            for lang, parts in held.items():
                u, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                langs += [lang] * len(u)
                codes.append(u.view(np.int64))
                counts.append(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

        for batch in common.pieces(batches, limit=1 << 20):
            values, offsets = grams(batch.column(1).to_pylist())
            langs = np.array(batch.column(0).to_pylist(), object)
            owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
            for lang in dict.fromkeys(langs.tolist()):
                own = values[(langs == lang)[owner]]
                if len(own):
                    u, n = np.unique(own, return_counts=True)
                    held.setdefault(lang, []).append((u, n))
                    size += len(u)
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    counted = common.arrow_map(source, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    rows = best.select("lang", "gram", "rank").collect()  # PROFILE rows for each language
    languages = sorted({r.lang for r in rows})
    codes = np.unique(np.array([r.gram for r in rows], np.int64).view(np.uint64))
    ranks = np.full((len(codes), len(languages)), PROFILE, np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, np.int64(r.gram).astype(np.uint64)), languages.index(r.lang)] = r.rank - 1
    return Profiles(languages, codes, ranks)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers for each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in common.pieces(batches, limit=1 << 20):
            values, offsets = grams(batch.column(1).to_pylist())
            names, scores = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if a == b or not p.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = top(values[a:b])
                at = np.minimum(np.searchsorted(p.codes, own), len(p.codes) - 1)
                there = p.codes[at] == own
                place = np.arange(len(own))
                known = p.ranks[at]
                away = np.where(there[:, None] & (known < PROFILE), np.abs(known - place[:, None]), PROFILE)
                distance = away.sum(axis=0)
                k = int(np.argmin(distance))
                names.append(p.languages[k])
                scores.append(1.0 - float(distance[k]) / (PROFILE * len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.arrow_map(common.texts(docs), run, "doc_id long, lang_pred string, score double")
