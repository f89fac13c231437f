"""Token ids in sorted-string-table shards.

A shard is one file of documents in ascending order of their identifier:

    data blocks   entries: shared key bytes, own key bytes, value bytes (varints); key rest; value
    index         for each block: first key, offset, length, ids before it in the shard
    Bloom filter  ten bits a key, seven probes
    footer        fixed size: places of index and filter, documents, ids, id width, checksum of the index, magic

Keys are 8-byte big-endian integers with the sign bit flipped, so that byte order is number order; a null
identifier has an empty key and comes first. A block starts with a whole key. A lookup asks the filter, finds
the block by binary search in the index and reads that block only.

Documents are dealt to shards by quantiles of their identifiers, one task a shard; an identifier that very many rows have
takes several shards. Each task writes its shards one after the
other from a sorted stream, so memory holds one block, the index and the keys' hashes. A file is written under
a temporary name and renamed, so a repeated task does no harm. Files beyond ``FILE_BYTES`` go on in a
further part, so that a shard of very many equal identifiers is no trouble either.

Defined results: null text: only the end id. Equal identifiers: each row is an entry of its own, in the order
of their ids, in each of the shards that hold the identifier. Empty table: no files and no rows.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES, FILE_BYTES = 64 << 10, 64 << 20
MAGIC = b"LNSST001"
_FOOTER = struct.Struct("<QQQQQQII8s")
_PROBES, _BITS = 7, 10
#: Where a null identifier stands in the order.
_NULL = -(1 << 63)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """The filter bits of keys that are given as 64-bit hashes, one row each."""
    h = common.mix(keys)
    step = common.mix(h ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(bits)


def key_hash(key: bytes) -> int:
    return int.from_bytes(key, "big") ^ (0x5555 if key else 0x3333)


class Writer:
    """Writes one file to an open stream; entries come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int] = []
        self.block, self.first, self.last, self.before = bytearray(), b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()
        shared = 0
        if self.block:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.ids
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(key_hash(key))
        self.docs += 1
        self.ids += len(value) // self.width

    def _close_block(self) -> None:
        self.index.append((self.first, self.at, len(self.block), self.before))
        self.out.write(bytes(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._close_block()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) + varint(b) for k, o, n, b in self.index)
        bits = max(64, -(-self.docs * _BITS // 8) * 8)
        bloom = np.zeros(bits, bool)
        if self.hashes:
            bloom[probes(np.array(self.hashes, np.uint64), bits).ravel()] = True
        filter_bytes = np.packbits(bloom).tobytes()
        self.out.write(index + filter_bytes)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_bytes), self.docs, self.ids, self.width, zlib.crc32(index), MAGIC))
        self.out.close()


class Reader:
    """Reads from a file that can seek: the footer first, then the index, then blocks as they are needed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        self.index_at, self.index_size, self.bloom_at, self.bloom_size, self.docs, self.ids, self.width, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        source.seek(self.index_at)
        raw = source.read(self.index_size)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("not a whole shard file")
        self.index: list[tuple[bytes, int, int, int]] = []
        at = 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            key = raw[at : at + n]
            o, at = read_varint(raw, at + n)
            m, at = read_varint(raw, at)
            before, at = read_varint(raw, at)
            self.index.append((key, o, m, before))
        self._bloom: np.ndarray | None = None

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, offset, size, start = self.index[block]
        self.source.seek(offset)
        data = self.source.read(size)
        at, key = 0, b""
        while at < size:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, start, data[at : at + n]
            start += n // self.width
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids) in file order."""
        for block in range(len(self.index)):
            for key, start, value in self._entries(block):
                yield id_of(key), start, self._ids(value)

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self.source.seek(self.bloom_at)
            self._bloom = np.unpackbits(np.frombuffer(self.source.read(self.bloom_size), np.uint8)).astype(bool)
        return bool(self._bloom[probes(np.array([key_hash(key_of(doc_id))], np.uint64), len(self._bloom))].all())

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (of the first, if several have its identifier), or None."""
        if not self.index or not self.may_hold(doc_id):
            return None
        key, low, high = key_of(doc_id), 0, len(self.index)
        while low < high:  # the first block whose first key isn't smaller
            mid = (low + high) // 2
            if self.index[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        for block in range(max(0, low - 1), len(self.index)):
            if self.index[block][0] > key:
                break
            for k, _, value in self._entries(block):
                if k == key:
                    return self._ids(value)
        return None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


# --- encoding with the tokenizers library ---------------------------------------------------------


class ChunkEncoder:
    """The library's ids, with the results for chunks between ASCII white space remembered.

    Valid for vocabularies whose pre-tokenizer drops white space and parts letters from punctuation, and whose normalizer
    lowers letters: no word and no special string reaches across white space, and a word's ids are the same
    whatever punctuation follows and however its letters are written. Texts that may hold a special string go to the library whole.

    Chunks and words are told apart by a 64-bit hash: sorted arrays of hashes and slots, as dictionaries of a million objects would
    take most of a worker's memory. Ids of what is known lie one after the other in one array, from which the ids of a
    batch are gathered at once. Of chunks over ``LONGEST`` bytes nothing is remembered, nor beyond ``REMEMBER`` chunks and words.
    """

    REMEMBER, LONGEST = 2_000_000, 48
    ENDS = b".,!?;:"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self._forget()

    def _forget(self) -> None:
        #: The hashes of known chunks and words in ascending order, and the slot of each; slot i has flat[starts[i] : starts[i + 1]].
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts = array("H" if self.width == 2 else "I"), array("q", [0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], -1)

    def _append(self, ids: array) -> None:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))

    def _learn(self, chunks: list[bytes], hashes: np.ndarray, keep: int) -> tuple[np.ndarray, int]:
        """Slots of chunks that aren't known, and how many slots there are to stay: those of the first ``keep`` chunks and of their words."""
        parts = []
        for c in chunks:
            word = c.rstrip(self.ENDS)
            # a letter may become a letter and a mark, which would go with the punctuation
            composed = 0 < len(word) < len(c) and unicodedata.normalize("NFC", word.decode()).lower()[-1].isalpha()
            parts.append((word, c[len(word) :]) if composed else (c,))
        words = list(dict.fromkeys(w for own in parts for w in own))
        own_hashes = common.Words(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])).hashes
        slots = self._find(own_hashes)
        new = np.flatnonzero(slots < 0).tolist()
        ids = {words[i]: self.flat[self.starts[s] : self.starts[s + 1]] for i, s in enumerate(slots.tolist()) if s >= 0}
        for i, e in zip(new, self.tokenizer.encode_batch_fast([words[i].decode() for i in new], add_special_tokens=False)):
            ids[words[i]] = array(self.flat.typecode, e.ids)
        first = len(self.starts) - 1
        whole = [ids[own[0]] if len(own) == 1 else ids[own[0]] + ids[own[1]] for own in parts]
        for x in whole[:keep]:
            self._append(x)
        # words that are no chunks of their own here
        extra = [i for i, chunk in zip(new, np.isin(own_hashes[new], hashes).tolist()) if not chunk and len(words[i]) <= self.LONGEST]
        for i in extra:
            self._append(ids[words[i]])
        for x in whole[keep:]:
            self._append(x)
        stay = first + keep + len(extra)
        added = np.concatenate([hashes[:keep], own_hashes[extra]])
        order = np.argsort(added)
        at = np.searchsorted(self.hashes, added[order])
        self.hashes, self.slots = np.insert(self.hashes, at, added[order]), np.insert(self.slots, at, first + order)
        return np.concatenate([np.arange(first, first + keep), np.arange(stay, stay + len(chunks) - keep)]), stay

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and end), each text followed by ``end``."""
        if len(self.hashes) > self.REMEMBER:
            self._forget()
        words = common.Words(data, offsets)
        known, at, index = np.unique(words.hashes, return_index=True, return_inverse=True)
        slot = self._find(known)
        size = words.ends[at] - words.starts[at]
        new = np.flatnonzero(slot < 0)
        new = new[np.argsort(size[new] > self.LONGEST, kind="stable")]  # those to be forgotten come last
        keep = int((size[new] <= self.LONGEST).sum())
        low = common.LOWER[data].tobytes()
        chunks = [low[a:b] for a, b in zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())]
        stay = len(self.starts) - 1
        if len(new):
            slot[new], stay = self._learn(chunks, known[new], keep)
        # the ends as one more chunk after each text's
        self._append(end)
        order = np.insert(slot[index], words.first[1:], len(self.starts) - 2)
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, f"u{self.flat.itemsize}")
        length = np.diff(starts)[order]
        reach = np.cumsum(length)
        ids = flat[np.arange(reach[-1] if len(reach) else 0) + np.repeat(starts[order] - reach + length, length)]
        bounds = np.concatenate([[0], reach[words.first[1:] + np.arange(len(offsets) - 1)]]).astype(np.int64)
        del starts, flat  # the arrays can't shrink while they are looked at
        del self.flat[self.starts[stay] :]
        del self.starts[stay + 1 :]
        return self._whole_texts(data, offsets, end, ids, bounds)

    def _whole_texts(self, data: np.ndarray, offsets: np.ndarray, end: list[int], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with texts that may hold a special string encoded by the library."""
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        rows = np.unique(np.searchsorted(offsets, marks, side="right") - 1)
        if not len(rows):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        whole = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows.tolist()]
        for r, e in zip(rows.tolist(), self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            parts[r] = np.array([*e.ids, *end], ids.dtype)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_shards(docs: DataFrame, vocab_path: str, folder: str, end_id: int = 1, width: int = 2) -> list[dict]:
    """Encode, append ``end_id``, and write shard files under ``folder``.

    Returns the manifest, one entry a file in ascending order: path, docs, ids, start (ids in all files
    before it). It has a row for some ``FILE_BYTES`` of output, so it is small beside the data.
    """
    source = common.texts(docs)
    count = max(1, source.rdd.getNumPartitions())
    # an identifier that many rows have is several edges, and so several shards
    keys = source.select(F.coalesce("doc_id", F.lit(_NULL)).alias("key"))
    edges = np.array(sorted(keys.approxQuantile("key", [i / count for i in range(1, count)], 1 / (4 * count))) if count > 1 else [], dtype=np.float64).clip(_NULL, (1 << 63) - 1024).astype(np.int64)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(vocab_path)
        if encoder.width > width:
            raise ValueError("ids of this vocabulary need width 4")
        for batch in common.pieces(batches, limit=2 << 20):
            ids, bounds = encoder.encode(*common.column_bytes(batch.column(1)), [end_id])
            ids = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
            keys = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            shard, least = np.searchsorted(edges, keys, side="right"), np.searchsorted(edges, keys, side="left")
            for i in np.flatnonzero(shard > least + 1).tolist():  # any of the shards that hold this identifier
                shard[i] = least[i] + 1 + zlib.crc32(ids[i].as_py()) % (shard[i] - least[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard.astype(np.int32)), ids], ["doc_id", "shard", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        writer, shard, part, temporary, done = None, None, 0, "", []

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                name = f"{base}/shard-{shard:06d}-{part:04d}.sst"
                system.move(temporary, name)
                done.append((shard, part, name, writer.docs, writer.ids))
                writer = None

        for batch in batches:
            for doc_id, s, value in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    close()
                    shard, part = s, 0
                elif writer is not None and writer.at >= FILE_BYTES:
                    close()
                    part += 1
                if writer is None:
                    temporary = f"{base}/writing-{uuid.uuid4().hex}"
                    writer = Writer(system.open_output_stream(temporary), width)
                writer.add(key_of(doc_id), value)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["shard", "part", "path", "docs", "ids"])

    encoded = common.arrow_map(source, encode, "doc_id long, shard int, ids binary")
    dealt = encoded.repartitionById(count, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    rows = common.arrow_map(dealt, write, "shard long, part long, path string, docs long, ids long").collect()
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: (r.shard, r.part)):
        manifest.append({"path": r.path, "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    return manifest


def read_shards(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(path) as f:
                    rows = []
                    for doc_id, before, ids in Reader(f):
                        rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 8192:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return common.arrow_map(files.repartition(max(1, len(manifest))), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
