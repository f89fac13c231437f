"""Benchmark decontamination: which test items does a document hold?

Items are short and documents long, so likeness of whole sets says nothing. Items are partitioned by size (their
number of shingles, in powers of two). For each partition a document is looked at through windows of two
neighbouring blocks, each as long as the partition's largest item: one window holds any such run of shingles whole, and
is never more than a few times larger than the item, so MinHash of window and item agree often enough. Blocks of
the larger partitions take their values from the blocks of the smaller ones. A window and an item that agree in
any of ``HASHES`` values are candidates; each candidate is confirmed by exact containment: at least ``share`` of the
item's distinct shingles are among the document's.

An item in one place is missed with a chance under 1e-5; the more often its shingles appear, the less.

Words are runs of letters and digits, A-Z as a-z, all bytes beyond ASCII count as letters; punctuation and white
space only part words. Shingles are of five words. Items with fewer words are one shingle of all their words, and are
looked for among the document's runs of as many words. Items of one or two distinct shingles are candidates wherever one of these
stands, without MinHash: they are too small a part of a window.

The items are broadcast in parts of at most about ``PART_SHINGLES`` shingles (a longer item is a part of its own); a larger
benchmark takes more passes, each of which adds to what the ones before have found for a row, without a shuffle.

Defined results: items without words match nothing; a null or empty text holds no item. Equal item_ids with different
texts match if one of them does; items without item_id or text are none. Rows with equal or null doc_id each have a row, by their own text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, HASHES = 5, 64
#: Shingles in the smallest block.
LEAST_BLOCK = 8
PART_SHINGLES = 2_000_000
_RNG = np.random.Generator(np.random.PCG64(4242))
_FACTORS = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SALTS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MARK_BITS = 16


class Items:
    """The items of one part: distinct shingles, and MinHash values by size partition."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words = common.Words(data, offsets, common.NOT_ALNUM)
        owner, hashes = words.shingles(SHINGLE)
        values, at = common.distinct_by_owner(owner, hashes, len(raw))
        count = np.diff(words.first)
        #: item number, its words in a shingle, distinct shingles
        self.items = [(ids[i], int(min(SHINGLE, count[i])), values[at[i] : at[i + 1]]) for i in range(len(raw)) if count[i]]
        self.levels: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}
        few: list[int] = []
        for k, (_, width, own) in enumerate(self.items):
            if width < SHINGLE:
                self.short.setdefault(width, []).append(k)
            elif len(own) < 3:
                few.append(k)
            else:
                level = max(0, int(np.ceil(np.log2(len(own) / LEAST_BLOCK))))
                self.levels.setdefault(level, []).append(k)
        shingles = np.concatenate([np.zeros(0, np.uint64), *(self.items[k][2] for k in few)])
        order = np.argsort(shingles)
        #: Shingles of items that have one or two, sorted, and the item of each.
        self.few = shingles[order], np.repeat(np.array(few, np.int64), [len(self.items[k][2]) for k in few])[order]
        self.tables = {level: self._table(members) for level, members in self.levels.items()}

    def _table(self, members: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each hash function: a table of marks, the sorted values, the item of each."""
        least = np.stack([minima(self.items[k][2], np.zeros(1, np.int64))[:, 0] for k in members], axis=1)
        marks = np.zeros((HASHES, 1 << _MARK_BITS), bool)
        values, owners = [], []
        for f in range(HASHES):
            order = np.argsort(least[f])
            marks[f, least[f] >> (32 - _MARK_BITS)] = True
            values.append(least[f][order])
            owners.append(np.array(members)[order])
        return marks, values, owners


def spread(hashes: np.ndarray, f: int) -> np.ndarray:
    """The f-th 32-bit hash of shingles; the values' high bits are as good as random."""
    with np.errstate(over="ignore"):
        x = (hashes ^ _SALTS[f]) * _FACTORS[f]
        return x ^ (x >> np.uint32(15))


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES rows of the least values of blocks of 64-bit shingles that begin at starts."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    for f in range(HASHES):
        x = spread(low, f)
        with np.errstate(over="ignore"):
            out[f] = np.minimum.reduceat(x * np.uint32(0x9E3779B1), starts)
    return out


def candidates(items: Items, owner: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
    """(text number, item) pairs that agree in a MinHash value. owner is ascending; hashes in text order."""
    out: set[tuple[int, int]] = set()
    if not len(owner) or not items.tables:
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(first, len(owner)))
    blocks = -(-count // LEAST_BLOCK)
    block_owner = np.repeat(owner[first], blocks)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + within * LEAST_BLOCK
    least = minima(hashes, starts)
    for level in range(max(items.tables) + 1):
        if level:
            # two blocks become one; a text's last block may stay alone
            head = np.flatnonzero(np.concatenate([[True], block_owner[1:] != block_owner[:-1]]))
            size = np.diff(np.append(head, len(block_owner)))
            within = np.arange(len(block_owner)) - np.repeat(head, size)
            at = np.flatnonzero(within % 2 == 0)
            least = np.minimum.reduceat(least, at, axis=1)
            block_owner = block_owner[at]
        if level not in items.tables:
            continue
        marks, values, owners = items.tables[level]
        same = block_owner[1:] == block_owner[:-1]
        alone = np.ones(len(block_owner), bool)
        alone[:-1] &= ~same
        window = least.copy()
        window[:, :-1][:, same] = np.minimum(least[:, :-1][:, same], least[:, 1:][:, same])
        for f in range(HASHES):
            maybe = np.flatnonzero(marks[f][window[f] >> np.uint32(32 - _MARK_BITS)])
            if not len(maybe):
                continue
            v = window[f][maybe]
            i, j = np.searchsorted(values[f], v, "left"), np.searchsorted(values[f], v, "right")
            for w, a, b in zip(maybe[j > i].tolist(), i[j > i].tolist(), j[j > i].tolist()):
                out.update((int(block_owner[w]), int(k)) for k in owners[f][a:b])
    return out


def holders(items: Items, owner: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
    """(text number, item) for items of one or two shingles, wherever a text has one of these."""
    values, item = items.few
    i, j = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
    return {(int(owner[w]), int(k)) for w in np.flatnonzero(j > i).tolist() for k in item[i[w] : j[w]]}


def found_in(items: Items, column: pa.Array, share: float) -> list[dict[int, float]]:
    """For each text the items that it holds, with their containment."""
    data, offsets = common.column_bytes(column)
    words = common.Words(data, offsets, common.NOT_ALNUM)
    owner, hashes = words.shingles(SHINGLE, short=False)
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    found: list[dict[int, float]] = [{} for _ in range(len(column))]
    for text, item in candidates(items, owner, hashes) | holders(items, owner, hashes):
        item_id, _, shingles = items.items[item]
        part = float(np.isin(shingles, hashes[first[text] : first[text + 1]]).sum()) / len(shingles)
        if part >= share:
            found[text][item_id] = max(part, found[text].get(item_id, 0.0))
    for width, members in items.short.items():
        owner, _ = words.shingles(width, short=False)
        runs = _as_short(words, width)
        wanted = np.array([items.items[k][2][0] for k in members], np.uint64)
        order = np.argsort(wanted)
        at = np.minimum(np.searchsorted(wanted[order], runs), len(wanted) - 1)
        for row in np.flatnonzero(wanted[order][at] == runs).tolist():
            for k in (m for m, w in zip(members, wanted) if w == runs[row]):
                found[int(owner[row])][items.items[k][0]] = 1.0
    return found


_FOUND = "doc_id long, item_ids array<long>, containments array<double>"


def _find(docs: DataFrame, items: Items, share: float, last: bool) -> DataFrame:
    """docs: doc_id, text, and after the first part what the parts before have found, which this one adds to. The last part drops the text."""
    sent = docs.sparkSession.sparkContext.broadcast(items)  # at most PART_SHINGLES shingles, or one item

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=2 << 20):
            found = found_in(sent.value, batch.column(1), share)
            if batch.num_columns > 2:
                for own, ids, parts in zip(found, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    for item, part in zip(ids, parts):
                        own[item] = max(part, own.get(item, 0.0))
            ids = [sorted(f) for f in found]
            made = [pa.array(ids, pa.list_(pa.int64())), pa.array([[f[i] for i in own] for f, own in zip(found, ids)], pa.list_(pa.float64()))]
            kept = [0] if last else [0, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], [*(("doc_id", "text")[i] for i in kept), "item_ids", "containments"])

    return common.arrow_map(docs, run, _FOUND if last else _FOUND.replace("doc_id long", "doc_id long, text string"))


def _parts(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The items in parts of at most about PART_SHINGLES words, and whether a part is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    # as many as the words that the operator sees, and up to two empty ones
    size = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first().n or 0
    parts = max(1, -(-int(size) // PART_SHINGLES))
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows]), p == parts - 1


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    out = docs
    for items, _ in _parts(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.with_text(batches, limit=2 << 20):
                found = found_in(sent.value, batch.column(batch.num_columns - 1), share)
                yield batch.select(batch.schema.names[:-1]).filter(pa.array([not f for f in found]))

        out = common.arrow_map(out, run, docs.schema)
    return out


def _as_short(words: common.Words, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words, made as those of texts with just so many words."""
    count = np.diff(words.first)
    full = np.maximum(count - width + 1, 0)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(words.first[:-1], full)
    weights = common.powers(np.uint64(0xD6E8FEB86659FD93), SHINGLE)
    with np.errstate(over="ignore"):
        total = np.full(len(at), width, np.uint64)
        for k in range(width):
            total += words.hashes[at + k] * weights[k]
    return common.mix(total)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """For each row of docs: doc_id, n_items, item_ids (ascending), containments (of these), contaminated."""
    out = common.texts(docs)
    for items, last in _parts(benchmark):
        out = _find(out, items, share, last)
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "containments", (F.size("item_ids") > 0).alias("contaminated"))
