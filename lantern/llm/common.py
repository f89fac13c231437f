"""What the operators share: sessions, shared folders, Arrow batches, byte-level words and hashes.

Every operator reads ``doc_id`` and ``text`` (or the columns it names) and ignores all others, so
extra columns with clashing names do no harm. A null text counts as empty unless the operator says
otherwise. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

#: Rows of an Arrow batch handed to Python. Texts can be long, so batches are short; ``pieces`` cuts
#: them further by bytes.
BATCH_ROWS = 512
#: Bytes of text worked on at once inside a batch.
PIECE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches for the Python stages, and a checkpoint folder if the cluster names none."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/lantern-checkpoints"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/lantern-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lantern_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no DataFrame reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._lantern_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, when its results have been read."""
    _delete(spark, f"{shared_folder(spark)}/lantern-{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id long, text string) and, if columns are named to be carried, a struct ``carried`` of these; nothing else reaches the Python stages."""
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = column_offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def with_text(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``pieces`` of batches with all their columns, and one more at the end: the text, empty where it is null."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column)).fill_null("")
        wide = pa.RecordBatch.from_arrays([*batch.columns, text], schema=batch.schema.append(pa.field("\0text", text.type)))
        yield from pieces([wide], "\0text", limit)


def column_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, joined, and the n + 1 offsets of its rows."""
    offsets = column_offsets(column)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_map(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow; a worker that another operator has used before forgets that one's tables first."""
    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(owner)
        yield from function(batches)

    return df.mapInArrow(run, schema)


_owner = ""


def take_over(owner: str) -> None:
    """Workers are used again by later stages: what the operator before this one remembers is dropped, and freed memory given back."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for name in ("bpe", "rankmerge", "sstable", "language"):
        module = sys.modules.get(f"{__package__}.{name}")
        for table in ("load", "chunk_encoder", "letters"):
            if module is not None and module.__name__ != owner and hasattr(module, table):
                getattr(module, table).cache_clear()
    Words._up = Words._down = np.zeros(0, np.uint64)
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From rows that are sorted by ``keys`` (integers): batches of whole groups, and where in them groups start and end."""
    kept: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return kept[0] if len(kept) == 1 else pa.concat_batches(kept)

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for k in keys:
            values = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def last_key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        at = starts(batch)
        if kept and last_key(kept[-1], kept[-1].num_rows - 1) != last_key(batch, 0):
            whole = joined()
            yield whole, np.append(starts(whole), whole.num_rows)
            kept = []
        if len(at) > 1 or not kept:
            cut = int(at[-1])
            if cut:
                kept.append(batch.slice(0, cut))
                whole = joined()
                yield whole, np.append(starts(whole), whole.num_rows)
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        whole = joined()
        yield whole, np.append(starts(whole), whole.num_rows)


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows of bytes."""
    return column_bytes(column)[0].reshape(len(column), width)


# --- bytes, words and hashes -------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit number for each byte value, and the odd base of the polynomial hashes.
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A-Z to a-z; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What separates words when punctuation is to be ignored: ASCII that is neither letter nor digit.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    with np.errstate(over="ignore"):
        while size < n:
            step = np.uint64(pow(int(base), size, 1 << 64))
            out[size : 2 * size] = out[: min(size, n - size)] * step
            size *= 2
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of many texts at once: 64-bit hashes, and the words' range for each text."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        n = len(data)
        if len(Words._up) < n + 1:
            Words._up, Words._down = powers(BASE, n + n // 2 + 1), powers(BASE_INVERSE, n + n // 2 + 1)
        inside = ~separators[data]
        starts_at = np.zeros(n + 1, bool)
        starts_at[1:n] = inside[1:] & ~inside[:-1]
        if n:
            starts_at[0] = inside[0]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts_at[edges] = inside[edges] if n else False
        ends_at = np.zeros(n + 1, bool)
        ends_at[1:n] = inside[:-1] & ~inside[1:]
        if n:
            ends_at[n] = inside[-1]
        closing = offsets[1:][offsets[:-1] < offsets[1:]]
        ends_at[closing] = inside[closing - 1] if n else False
        self.starts, self.ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODES[LOWER[data]] * Words._up[:n], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * Words._down[self.starts])
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each run of ``size`` words; with ``short``, a text of 1 to size - 1 words has one, of all its words."""
        count = np.diff(self.first)
        full = np.maximum(count - size + 1, 0)
        with np.errstate(over="ignore"):
            weights = powers(np.uint64(0xD6E8FEB86659FD93), size)
            n = len(self.hashes)
            run = np.zeros(max(n - size + 1, 0), np.uint64)
            for k in range(size if len(run) else 0):
                run += self.hashes[k : k + len(run)] * weights[k]
            owner = np.repeat(np.arange(len(count)), full)
            at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(self.first[:-1], full)
            out = mix(run[at]) if len(at) else np.zeros(0, np.uint64)
            if short:
                few = np.flatnonzero((count > 0) & (count < size))
                extra = np.zeros(len(few), np.uint64)
                for j, i in enumerate(few):
                    own = self.hashes[self.first[i] : self.first[i + 1]]
                    extra[j] = (own * weights[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
                owner, out = np.concatenate([owner, few]), np.concatenate([out, mix(extra)])
        return owner, out


def distinct_by_owner(owner: np.ndarray, hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each owner, sorted, and owners + 1 offsets."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(owners + 1))


def cut_rows(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
