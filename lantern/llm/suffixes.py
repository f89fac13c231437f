"""Exact substring dedup: every byte covered by a 50-byte string that also starts in an earlier document goes.

A sparse suffix array is sorted by a distributed merge sort. Sort points are chosen by content: in every window of
50 bytes the 20-byte string with the least hash (the leftmost, if tied) is its anchor, so equal windows have equal
anchors at equal places, wherever they stand. One suffix in about 16 is an anchor.

1. ``anchors``: each task sends the distinct anchor hashes of its documents, packed, by hash range; what turns up in
   two documents is marked in its documents. Windows at other anchors occur in one document only.
2. ``runs``: at each marked anchor the suffix that its windows span (the text right of the anchor, then the text left
   of it, backwards) is a sort key. A task sorts its keys into a run, keeps the smallest document of each, marks all
   others of the run as covered, and sends the run front-coded, cut by range.
3. ``merge``: a range's runs are merged by a loser tree that holds, for each run, the length of the prefix that its
   head shares with the last key put out; heads are compared beyond known prefixes only. Equal keys and keys
   with a common anchor come out next to each other; their windows decide what is covered.
4. Covered spans go back to their documents.

Marks and spans travel in blobs by bucket of documents (``per_bucket``), so a stage makes rows by task and bucket and not by
document and range; a bucket's blobs become one row for each document (``per_document``), which is joined to its text.

A string or copy that a great part of all documents holds costs each task one key, whatever its count. An anchor that goes
on in very many ways (20 blanks) would be one group of many keys; such anchors are counted in step 1, and their windows are keys
one by one, which meet only if equal, so that ranges may part them.

Defined results: null text is an empty text; texts under 50 bytes stay whole. Rows with equal doc_id are one document
number: their strings don't cover each other. A null doc_id comes before all others. Bytes are removed wherever they
fall; a character that loses some of its bytes leaves the others, so ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

LENGTH, GRAM = 50, 20
_SPAN = LENGTH - GRAM + 1
#: Anchors in a task's list before it is sent, and bytes of keys in a run.
LIST_ANCHORS, RUN_KEYS = 750_000, 200_000
#: An anchor is hot if it goes on in so many ways and has at least one in HOT_SHARE of all anchors; so at most HOT_SHARE are hot, which
#: are 8 MB to send to the tasks. A list counts ways of anchors it has MANY of.
HOT_KEYS, HOT_SHARE, MANY = 20_000, 1_000_000, 16
#: Lists whose samples go to the driver, at most about; a list has some 5 kB of them.
SAMPLED_LISTS = 4096
#: Windows looked at at once; positions among them fit in 24 bits.
PART = 1 << 20
_WIDTH = LENGTH + (_SPAN - 1) + 1
_LOW = np.uint64((1 << 24) - 1)
_FIRST = -(1 << 63)
#: In the last byte of a key: a window of a hot anchor.
_ALONE = 0x80


# --- packing --------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    head, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.dtype.itemsize]
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return np.array([len(arrays), *head], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:8], "<i8")[0])
    head = np.frombuffer(blob[8 : 8 + 16 * n], "<i8").reshape(n, 2)
    data = zstandard.ZstdDecompressor().decompress(blob[8 + 16 * n :])
    out, at = [], 0
    for (rows, width), kind in zip(head.tolist(), types):
        planes = np.frombuffer(data, np.uint8, rows * width, at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if rows else np.zeros(0, kind))
        at += rows * width
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def batches_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


_ROUTED = [("place", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]
_ROUTED_SQL = "place int, kind int, n long, blob binary"


def _deal(docs: np.ndarray, discs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of document rows; its high bits say the bucket."""
    return common.mix(docs.view(np.uint64) ^ common.mix(discs.view(np.uint64)))


def _row_order(docs: np.ndarray, discs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts the entries of each document row together, by bucket, and where in it rows begin."""
    key = _deal(docs, discs)
    order = np.argsort(key, kind="stable")
    d, x, k = docs[order], discs[order], key[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
    if new.sum() != 1 + (k[1:] != k[:-1]).sum():  # two rows with one hash
        order = np.lexsort((discs, docs, key))
        d, x = docs[order], discs[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
    return order, np.flatnonzero(new)


def per_bucket(docs: np.ndarray, discs: np.ndarray, places: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place, blob) of documents' values, the documents dealt to ``places`` by hash."""
    if not len(docs):
        return
    order, head = _row_order(docs, discs)
    counts = np.diff(np.append(head, len(docs)))
    docs, discs, values = docs[order[head]], discs[order[head]], [v[order] for v in values]
    bucket = ((_deal(docs, discs) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(places + 1))
    at = np.append(head, len(order))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[p], cuts[p + 1]
        yield p, pack(docs[i:j], discs[i:j], counts[i:j].astype("<u4"), *(v[at[i] : at[j]] for v in values))


def per_document(routed: DataFrame, types: list[str], make: Callable[..., Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """(doc_id, disc, data), one row for each document of the blobs in (place, blob). make: (docs, discs, where rows begin, *values) to such rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blob_groups(batches):
            found = []
            for blob in rows["blob"]:
                docs, discs, counts, *values = unpack(blob, "<i8", "<i8", "<u4", *types)
                found.append((np.repeat(docs, counts), np.repeat(discs, counts), *values))
            docs, discs, *values = (np.concatenate(column) for column in zip(*found))
            del found, rows
            order, head = _row_order(docs, discs)
            made = make(docs[order], discs[order], head, *(v[order] for v in values))
            while some := list(islice(made, 4096)):
                yield batches_of([("doc_id", pa.int64()), ("disc", pa.int64()), ("data", pa.binary())], some)

    return common.arrow_map(routed.select("place", "blob").repartition("place").sortWithinPartitions("place"), run, "doc_id long, disc long, data binary")


def blob_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of the rows of each place, from rows sorted by place; one place is held at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        places = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1], [True]])) if len(places) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held["place"][-1] != places[a]:
                yield held
                held = {}
            for name in batch.schema.names:
                held.setdefault(name, []).extend(batch.column(name).slice(a, b - a).to_pylist())
    if held:
        yield held


# --- anchors ----------------------------------------------------------------------------------------


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, anchor position, first window, last window, 40-bit hash, hash of all its windows) of each anchor.

    Positions have 24 bits beside the hash, so longer data are looked at in parts of PART windows. An anchor at a border comes
    twice, with the windows of each part; every window is in one part.
    """
    if len(data) <= PART + LENGTH - 1:
        return _anchors_of_part(data, offsets)
    found = []
    for a in range(0, len(data) - LENGTH + 1, PART):
        b = min(a + PART + LENGTH - 1, len(data))
        # the texts' ends within the part; a text that begins or ends outside is cut
        owner, at, first, last, hashes, spans = _anchors_of_part(data[a:b], np.clip(offsets, a, b) - a)
        found.append((owner, at + a, first + a, last + a, hashes, spans))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(6))


def gram_hash(gram: bytes) -> int:
    """The 40-bit hash of an anchor."""
    with np.errstate(over="ignore"):
        total = (common.BYTE_CODES[np.frombuffer(gram, np.uint8)] * common.powers(common.BASE, GRAM)).sum(dtype=np.uint64)
    return int(common.mix(total)) >> 24


def _anchors_of_part(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``find_anchors`` of at most PART windows."""
    n = len(data)
    none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < LENGTH:
        return none, none, none, none, no_hash, no_hash
    if len(common.Words._up) < n + 1:
        common.Words._up, common.Words._down = common.powers(common.BASE, n + n // 2 + 1), common.powers(common.BASE_INVERSE, n + n // 2 + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(common.BYTE_CODES[data] * common.Words._up[:n], out=total[1:])
        h = total[GRAM:] - total[:-GRAM]
        h *= common.Words._down[: len(h)]
        h = common.mix(h)
    h &= ~_LOW
    h |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= _SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < _SPAN:
        h = np.minimum(h[: len(h) - (_SPAN - width)], h[_SPAN - width :])
    usable = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(usable, offsets[long], 1)
    np.add.at(usable, offsets[long + 1] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(usable[:-1]))
    if not len(windows):
        return none, none, none, none, no_hash, no_hash
    best = h[windows]
    at = (best & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = windows[np.append(first[1:], len(at)) - 1]
    with np.errstate(over="ignore"):
        spans = (total[last + LENGTH] - total[windows[first]]) * common.Words._down[windows[first]]
    return np.searchsorted(offsets, at[first], side="right") - 1, at[first], windows[first], last, best[first] >> np.uint64(24), spans


def _ids(column: pa.Array) -> np.ndarray:
    """Document identifiers; null is the least integer."""
    return column.fill_null(_FIRST).to_numpy(zero_copy_only=False)


def mark_anchors(docs: DataFrame, places: int) -> DataFrame:
    """Rows for ``place``: kind 1: blobs of the hashes of documents' anchors that stand in two documents; kind 2: a sample of
    sort keys from a list of n anchors; kind 3: the 5-byte hash of an anchor that goes on in n ways, HOT_KEYS or more."""

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            docs_, discs = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            hashes = np.concatenate([h[2] for h in held])
            row = np.concatenate([h[3] + b for h, b in zip(held, base.tolist())])
            often = list(_often(hashes, np.concatenate([h[4] for h in held]), places, MANY))
            rows = [(0, 2, count, b"".join(h[5] for h in held)), *((p, 3, 0, blob) for p, blob in often)]
            held, count = [], 0
            # document rows in order, and anchors by hash and row: 40 and 24 bits
            order = np.lexsort((discs, docs_))
            docs_, discs = docs_[order], discs[order]
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            number = np.concatenate([[0], np.cumsum(docs_[1:] != docs_[:-1])])
            twin = np.concatenate([[False], (docs_[1:] == docs_[:-1]) & (discs[1:] == discs[:-1])])
            rank = (np.arange(len(order)) - _since(twin)).astype(np.uint64)[rank.astype(np.int64)]
            key = np.unique(hashes << np.uint64(24) | rank[row])
            hashes, row = key >> np.uint64(24), (key & _LOW).astype(np.int64)
            # every anchor whose hash is in two of this task's documents is marked at once
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            sizes = np.diff(np.append(start, len(hashes)))
            several = number[row[start]] != number[row[start + sizes - 1]]
            marked = np.repeat(several, sizes)
            rows += [(p, 1, 0, blob) for p, blob in per_bucket(docs_[row[marked]], discs[row[marked]], places, hashes[marked])]
            # for the others: one entry for each document row; for the marked: one for all
            keep = ~marked
            keep[start[several]] = True
            h, r, m = hashes[keep], row[keep], marked[keep]
            place = (h * np.uint64(places) >> np.uint64(40)).astype(np.int64)
            cuts = np.searchsorted(place, np.arange(places + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[p], cuts[p + 1])
                known, index = np.unique(r[own], return_inverse=True)
                index = np.where(m[own], 0, index + 1).astype("<u4")
                rows.append((p, 0, 0, pack(deltas(h[own]), index, deltas(docs_[known]), discs[known])))
            return batches_of(_ROUTED, rows)

        for batch in common.pieces(batches, limit=PART):
            data, offsets = common.column_bytes(batch.column(2))
            owner, at, _, _, hashes, ways = find_anchors(data, offsets)
            if not len(owner):
                continue
            some = at[:: max(1, len(at) // 8)][:8]
            sample = b"".join(data[a : a + LENGTH].tobytes().ljust(LENGTH, b"\0") for a in some.tolist())
            held.append((_ids(batch.column(0)), batch.column(1).to_numpy(), hashes, owner, ways.astype(np.uint32), sample))
            count += len(owner)
            if count >= LIST_ANCHORS:
                yield flush()
        if held:
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal found, count
            hashes, docs_, discs = (np.concatenate([f[i] for f in found]) for i in range(3))
            blobs = per_bucket(docs_, discs, places, hashes)
            found, count = [], 0
            return batches_of(_ROUTED, [(p, 1, 0, blob) for p, blob in blobs])

        for rows in blob_groups(batches):
            hashes, docs_, discs, marks, often, ready = [], [], [], [], [], []
            for row in zip(*(rows[name] for name, _ in _ROUTED)):
                _, kind, _, blob = row
                if kind == 0:
                    h, index, known, disc = unpack(blob, "<u8", "<u4", "<i8", "<i8")
                    hashes.append(np.cumsum(h, dtype=np.uint64))
                    slot = np.maximum(index.astype(np.int64) - 1, 0)
                    docs_.append(np.cumsum(known)[slot])
                    discs.append(disc[slot])
                    marks.append(index == 0)
                elif kind == 3:
                    h, n = unpack(blob, "<u8", "<u4")
                    often.append((np.cumsum(h, dtype=np.uint64), n))
                else:
                    ready.append(row)
            del rows
            if often:
                h, index = np.unique(np.concatenate([o[0] for o in often]), return_inverse=True)
                n = np.bincount(index, weights=np.concatenate([o[1] for o in often])).astype(np.int64)
                ready += [(0, 3, k, int(x).to_bytes(5, "little")) for x, k in zip(h[n >= HOT_KEYS].tolist(), n[n >= HOT_KEYS].tolist())]
            if ready:
                yield batches_of(_ROUTED, ready)
            if not hashes:
                continue
            h, d, x, m = (np.concatenate(y) for y in (hashes, docs_, discs, marks))
            order = np.argsort(h, kind="stable")
            h, d, x, m = h[order], d[order], x[order], m[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            twice = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | np.logical_or.reduceat(m, start)
            hit = np.repeat(twice, np.diff(np.append(start, len(h)))) & ~m
            found.append((h[hit], d[hit], x[hit]))
            count += int(hit.sum())
            if count > LIST_ANCHORS:
                yield flush()
        if count:
            yield flush()

    routed = common.arrow_map(docs, lists, _ROUTED_SQL).repartition("place").sortWithinPartitions("place")
    return common.written(common.arrow_map(routed, meet, _ROUTED_SQL), "anchors")


def _since(twin: np.ndarray) -> np.ndarray:
    """How many places before each the first of its run of twins is."""
    at = np.arange(len(twin))
    return at - np.maximum.accumulate(np.where(twin, 0, at))


def _often(hashes: np.ndarray, ways: np.ndarray, places: int, many: int) -> Iterator[tuple[int, bytes]]:
    """(place, blob) of anchors that go on in ``many`` ways in this list, and how many."""
    key = np.unique(hashes << np.uint64(24) | (ways.astype(np.uint64) & _LOW))
    h = key >> np.uint64(24)
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(start, len(h)))
    h, n = h[start[n >= many]], n[n >= many].astype("<u4")
    cuts = np.searchsorted((h * np.uint64(places) >> np.uint64(40)).astype(np.int64), np.arange(places + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, pack(deltas(h[cuts[p] : cuts[p + 1]]), n[cuts[p] : cuts[p + 1]])


def _marks_of_documents(docs: np.ndarray, discs: np.ndarray, head: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Each document's hashes, 5 bytes each."""
    raw = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :5])
    ends = np.append(head[1:], len(docs))
    for d, x, a, b in zip(docs[head].tolist(), discs[head].tolist(), head.tolist(), ends.tolist()):
        yield d, x, raw[a:b].tobytes()


# --- runs -------------------------------------------------------------------------------------------


def sort_keys(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of each anchor, as rows of _WIDTH bytes padded with zeros: text from the anchor to the end of its last
    window, text before it to the start of its first window backwards, and one more than the length of that."""
    right, left = last + LENGTH - at, at - first
    out = np.zeros((len(at), _WIDTH), np.uint8)
    columns = np.arange(LENGTH)
    source = np.minimum(at[:, None] + columns, len(data) - 1)
    out[:, :LENGTH] = np.where(columns < right[:, None], data[source], 0)
    columns = np.arange(_SPAN - 1)
    row, column = np.nonzero(columns < left[:, None])
    out[row, right[row] + column] = data[at[row] - 1 - column]
    out[np.arange(len(at)), right + left] = left + 1
    return out


def joined_spans(docs: np.ndarray, discs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same, ordered, with overlapping and touching spans of a document joined."""
    if not len(docs):
        return docs, discs, starts, ends
    order = np.lexsort((starts, discs, docs))
    docs, discs, starts, ends = docs[order], discs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    owner = np.concatenate([[0], np.cumsum((docs[1:] != docs[:-1]) | (discs[1:] != discs[:-1]))])
    lift = owner * np.int64(1 << 33)
    reach = np.maximum.accumulate(ends + lift)
    new = np.ones(len(docs), bool)
    new[1:] = (starts + lift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    stop = reach[np.append(at[1:], len(docs)) - 1] - lift[at]
    return docs[at], discs[at], starts[at], stop


def _span_blobs(docs: np.ndarray, discs: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: int) -> Iterator[tuple[int, bytes]]:
    docs, discs, starts, ends = joined_spans(docs, discs, starts, ends)
    return per_bucket(docs, discs, places, starts.astype("<u4"), ends.astype("<u4"))


def _spans_of_documents(docs: np.ndarray, discs: np.ndarray, _: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Each document's spans: unsigned 32-bit starts and ends in turn."""
    docs, discs, starts, ends = joined_spans(docs, discs, starts, ends)
    raw = np.stack([starts, ends], axis=1).astype("<u4").tobytes()
    head = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (discs[1:] != discs[:-1])]))
    for d, x, a, b in zip(docs[head].tolist(), discs[head].tolist(), head.tolist(), np.append(head[1:], len(docs)).tolist()):
        yield d, x, raw[8 * a : 8 * b]


def make_runs(marked: DataFrame, borders: list[bytes], hot: np.ndarray, places: int) -> DataFrame:
    """marked: doc_id, disc, text, marks (5 bytes each). hot: hashes of hot anchors, sorted. Rows for ``place``: kind 0: a piece of a run; kind 1: blobs of spans that the run itself shows as covered."""
    edges = np.array([b.ljust(_WIDTH, b"\0") for b in borders], f"S{_WIDTH}")

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            keys, docs_, discs, low = (np.concatenate([h[i] for h in held]) for i in range(4))
            held, count = [], 0
            strings = keys.view(f"S{_WIDTH}").reshape(-1)
            order = np.lexsort((low, discs, docs_, strings))
            keys, docs_, discs, low, strings = keys[order], docs_[order], discs[order], low[order], strings[order]
            new = np.ones(len(keys), bool)
            new[1:] = strings[1:] != strings[:-1]
            entry = np.cumsum(new) - 1
            smallest = docs_[new][entry]
            later = docs_ > smallest
            length = _WIDTH - 1 - (keys[:, ::-1] != 0).argmax(axis=1)  # a key's last byte isn't zero
            rows = [(p, 1, 0, blob) for p, blob in _span_blobs(docs_[later], discs[later], low[later], (low + length)[later], places)]
            distinct, length = keys[new], length[new] + 1
            differ = distinct[1:] != distinct[:-1]
            shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), 0)]).astype(np.int64)
            cut_entries = np.concatenate([[0], np.searchsorted(strings[new], edges), [len(distinct)]])
            keep = ~later
            entry, discs, low, docs_ = entry[keep], discs[keep], low[keep], docs_[keep]
            cut_members = np.searchsorted(entry, cut_entries)
            for p in np.flatnonzero(np.diff(cut_entries)).tolist():
                a, b, i, j = cut_entries[p], cut_entries[p + 1], cut_members[p], cut_members[p + 1]
                common_ = shared[a:b].copy()
                common_[0] = 0
                columns = np.arange(_WIDTH)
                rest = distinct[a:b][(columns >= common_[:, None]) & (columns < length[a:b, None])]
                rows.append((p, 0, 0, pack(common_.astype("u1"), length[a:b].astype("u1"), rest, np.diff(np.searchsorted(entry[i:j], np.arange(a, b + 1))).astype("<u4"), docs_[i:j], discs[i:j], low[i:j].astype("<u4"))))
            return batches_of(_ROUTED, rows)

        for batch in common.pieces(batches, limit=PART):
            data, offsets = common.column_bytes(batch.column(2))
            owner, at, first, last, hashes, _ = find_anchors(data, offsets)
            if not len(owner):
                continue
            wanted = []
            for i, marks in enumerate(batch.column(3).to_pylist()):
                raw = np.frombuffer(marks, np.uint8).reshape(-1, 5)
                h = np.zeros((len(raw), 8), np.uint8)
                h[:, :5] = raw
                wanted.append(h.view("<u8").reshape(-1) | np.uint64(i << 40))
            sought = np.sort(np.concatenate(wanted))
            mine = hashes | (owner.astype(np.uint64) << np.uint64(40))
            hit = sought[np.minimum(np.searchsorted(sought, mine), len(sought) - 1)] == mine if len(sought) else np.zeros(len(mine), bool)
            owner, at, first, last, hashes = owner[hit], at[hit], first[hit], last[hit], hashes[hit]
            if not len(owner):
                continue
            parted = np.isin(hashes, hot) if len(hot) else np.zeros(len(hashes), bool)
            if parted.any():
                # a key for each window
                size = np.where(parted, last - first + 1, 1)
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                owner, at, first, last, parted = (np.repeat(x, size) for x in (owner, at, first, last, parted))
                first = first + step
                last = np.where(parted, first, last)
            keys = sort_keys(data, at, first, last)
            keys[parted, LENGTH] |= _ALONE
            held.append((keys, _ids(batch.column(0))[owner], batch.column(1).to_numpy()[owner], first - offsets[owner]))
            count += len(owner)
            if count >= RUN_KEYS:
                yield flush()
        if held:
            yield flush()

    return common.arrow_map(marked, runs, _ROUTED_SQL)


# --- merge ------------------------------------------------------------------------------------------


class Run:
    """A cursor over a front-coded run."""

    def __init__(self, blob: bytes):
        shared, length, rest, members, self.docs, self.discs, self.low = unpack(blob, "u1", "u1", "u1", "<u4", "<i8", "<i8", "<u4")
        self.shared, self.length, self.rest = shared.tolist(), length.tolist(), rest.tobytes()
        self.ends = np.cumsum(members).tolist()
        self.at, self.byte, self.key = -1, 0, b""

    def step(self) -> int:
        """To the next key; returns the length of the prefix it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            self.key = b""
            return -1
        common_ = self.shared[self.at]
        end = self.byte + self.length[self.at] - common_
        self.key = self.key[:common_] + self.rest[self.byte : end]
        self.byte = end
        return common_

    def members(self) -> tuple[int, int]:
        return (self.ends[self.at - 1] if self.at else 0), self.ends[self.at]


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two keys that are known to agree in ``at`` bytes."""
    n = min(len(a), len(b))
    while at < n:
        step = min(8, n - at)
        if a[at : at + step] == b[at : at + step]:
            at += step
            continue
        while a[at] == b[at]:
            at += 1
        return at
    return n


class LoserTree:
    """Merges runs in key order; no byte of a prefix that two heads are known to share is looked at again.

    known[i] is the length of the prefix that head i shares with the last winner that passed its node. Of two heads
    the one that shares more is smaller; if both share as much, the bytes beyond decide, and the loser learns
    how much it shares with the winner. Ended runs have -1.
    """

    def __init__(self, runs: list[Run]):
        self.runs = runs
        n = 1
        while n < len(runs):
            n *= 2
        self.n, self.known = n, [-1] * n
        for i, run in enumerate(runs):
            self.known[i] = 0 if run.step() >= 0 else -1
        self.losers = [0] * n
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, i: int, j: int) -> tuple[int, int]:
        known = self.known
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        if known[i] < 0:
            return i, j
        a, b = self.runs[i].key, self.runs[j].key
        h = shared_prefix(a, b, known[i])
        # keys are ordered as if padded with zeros; no key is the start of another one padded so
        if h == len(a) == len(b) or (h < len(a) and h < len(b) and a[h] < b[h]) or (h == len(a) < len(b)):
            known[j] = h
            return i, j
        known[i] = h
        return j, i

    def __iter__(self) -> Iterator[tuple[bytes, int, Run]]:
        """(key, bytes it shares with the key before, the run that it heads)."""
        runs, known, losers, n, play = self.runs, self.known, self.losers, self.n, self._play
        w = self.winner
        while known[w] >= 0:
            run = runs[w]
            yield run.key, known[w], run
            known[w] = run.step()
            node = (w + n) >> 1
            while node:
                loser = losers[node]
                if known[w] > known[loser]:
                    pass
                elif known[w] < known[loser]:
                    losers[node], w = w, loser
                else:
                    w, losers[node] = play(w, loser)
                node >>= 1


class Covered:
    """Collects covered spans (doc_id, disc, start, end)."""

    def __init__(self):
        self.single: list[tuple[int, int, int, int]] = []

    def drain(self, places: int) -> pa.RecordBatch:
        every = np.array(self.single, np.int64).reshape(-1, 4)
        self.single = []
        return batches_of([_ROUTED[0], _ROUTED[3]], list(_span_blobs(*(np.ascontiguousarray(every[:, i]) for i in range(4)), places)))


def settle(group: list[tuple[bytes, list[tuple[int, int, int]]]], out: Covered) -> None:
    """A group of distinct keys with one anchor, each with its members (doc_id, disc, first window)."""
    least = []
    for key, members in group:
        smallest = min(m[0] for m in members) if len(members) > 1 else members[0][0]
        least.append(smallest)
        if len(members) > 1:
            size = len(key) - 1
            for doc, disc, low in members:
                if doc > smallest:
                    out.single.append((doc, disc, low, low + size))
    if len(group) == 1:
        return
    owner: dict[bytes, int] = {}
    windows = []
    for (key, _), smallest in zip(group, least):
        left = key[-1] - 1
        right = len(key) - 1 - left
        text = key[right : right + left][::-1] + key[:right]
        own = [text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)]
        windows.append(own)
        for w in own:
            if owner.get(w, smallest) >= smallest:
                owner[w] = smallest
    for (_, members), smallest, own in zip(group, least, windows):
        hit = [i for i, w in enumerate(own) if owner[w] < smallest]
        if hit:
            for doc, disc, low in members:
                if doc == smallest:
                    out.single += [(doc, disc, low + i, low + i + LENGTH) for i in hit]


def merge_runs(routed: DataFrame, places: int) -> DataFrame:
    """(place, blob) with covered spans."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Covered()
        for rows in blob_groups(batches):
            ready = [(p, blob) for p, kind, blob in zip(rows["place"], rows["kind"], rows["blob"]) if kind == 1]
            if ready:
                yield batches_of([_ROUTED[0], _ROUTED[3]], ready)
            runs = [Run(blob) for kind, blob in zip(rows["kind"], rows["blob"]) if kind == 0]
            del rows, ready
            if not runs:
                continue
            group: list[tuple[bytes, list[tuple[int, int, int]]]] = []
            last = b""
            for key, shared, run in LoserTree(runs):
                i, j = run.members()
                members = list(zip(run.docs[i:j].tolist(), run.discs[i:j].tolist(), run.low[i:j].tolist())) if j - i > 1 else [(run.docs.item(i), run.discs.item(i), run.low.item(i))]
                if shared < GRAM or (key[-1] >= _ALONE and not shared == len(key) == len(last)):
                    if len(group) > 1 or (group and len(group[0][1]) > 1):
                        settle(group, out)
                    group = [(key, members)]
                elif shared == len(key) == len(last):
                    group[-1][1].extend(members)
                else:
                    group.append((key, members))
                last = key
                if len(out.single) > 150_000:
                    yield out.drain(places)
            if group:
                settle(group, out)
        if out.single:
            yield out.drain(places)

    grouped = routed.repartition("place").sortWithinPartitions("place")
    return common.arrow_map(grouped, merge, "place int, blob binary")


def range_borders(samples: list[bytes], places: int, hot: set[int]) -> list[bytes]:
    """Keys that part the sorted sample evenly into at most ``places`` ranges; no border is inside an anchor, unless a hot one."""
    keys = sorted(b[i : i + LENGTH] for b in samples for i in range(0, len(b), LENGTH))
    places = min(places, len(keys) // 2)
    chosen = [keys[i * len(keys) // places] for i in range(1, places)]
    return sorted({k if gram_hash(k[:GRAM]) in hot else k[:GRAM] for k in chosen})


def whole_characters(kept: Column) -> Column:
    """Bytes as text; what is left of characters that were cut in two goes."""
    return F.coalesce(F.try_validate_utf8(kept.cast("string")), F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "\ufffd+", ""))


# --- the operator -------------------------------------------------------------------------------------


def dedup(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, spans (array of struct<start,end>), kept (binary: the bytes that stay).

    ``carry`` names further columns of docs that come along, in a struct named ``carried``.
    """
    spark = docs.sparkSession
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    rows = docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    rows = rows.withColumn("disc", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    found = mark_anchors(rows.select("doc_id", "disc", "text").where(F.octet_length("text") >= LENGTH), 4 * places)
    lists = found.where("kind = 2")
    size = lists.agg(F.count(F.lit(1)).alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("anchors")).first()
    hot = [int.from_bytes(r.blob, "little") for r in found.where((F.col("kind") == 3) & (F.col("n") >= max(HOT_KEYS, size.anchors // HOT_SHARE))).select("blob").collect()]
    if size.lists > SAMPLED_LISTS:
        lists = lists.where(F.pmod(F.xxhash64("blob"), F.lit(-(-size.lists // SAMPLED_LISTS))) == 0)
    borders = range_borders([r.blob for r in lists.select("blob").collect()], places, set(hot))

    marked = per_document(found.where("kind = 1"), ["<u8"], _marks_of_documents).withColumnRenamed("data", "marks")
    joined = rows.select("doc_id", "disc", "text").dropDuplicates(["doc_id", "disc"]) if twice else rows.select("doc_id", "disc", "text")
    joined = joined.join(marked, ["doc_id", "disc"]).select("doc_id", "disc", "text", "marks")
    covered = merge_runs(make_runs(joined, borders, np.sort(np.array(hot, np.uint64)), places), places)
    spans = per_document(covered, ["<u4", "<u4"], _spans_of_documents).withColumnRenamed("data", "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in common.pieces(batches, limit=PART):
            out = []
            for text, raw in zip(common.cut_rows(*common.column_bytes(batch.column(2))), batch.column(3).to_pylist()):
                pairs = np.frombuffer(raw or b"", "<u4").reshape(-1, 2).tolist()
                kept, at = [], 0
                for s, e in pairs:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                out.append((len(text), sum(e - s for s, e in pairs), [{"start": s, "end": e} for s, e in pairs], b"".join(kept)))
            n, removed, spans_, kept_ = zip(*out)
            ids = pa.array(np.where(batch.column(1).to_numpy(zero_copy_only=False), None, batch.column(0).to_numpy(zero_copy_only=False)).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans_], pa.int64()), pa.array(spans_, span_type), pa.array(kept_, pa.binary())], [*batch.schema.names[4:], "doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    final = rows.join(spans, ["doc_id", "disc"], "left").select("doc_id", "no_id", "text", "spans", *(["carried"] if carry else []))
    made = StructType([final.schema["carried"]] if carry else [])
    for field in StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"):
        made.add(field)
    return common.arrow_map(final, cut, made)
