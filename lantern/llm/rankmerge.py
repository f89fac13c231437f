"""Token counts by rank-synchronous merging of ragged arrays.

The distinct words of a batch that aren't known yet are held as one ragged numpy array of symbols. In each
round every word finds its lowest-rank pair, and all words apply theirs at once; a word without a pair that
merges is done. The symbols that survive are counted. A merge can only make pairs of higher rank, so this
equals merging one pair at a time.

The vocabulary is lower-cased word BPE with word ends. Special strings in a text are single tokens, as the
library has them by default. Texts are cut at ASCII white space, which always ends a word.

Defined results: a null, empty or blank text has 0 tokens; rows are counted each for itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .bpe import byte_letters

#: Chunks whose counts a worker remembers at most, and the longest that it remembers.
REMEMBER, LONGEST = 500_000, 64


class WordCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        end = spec["model"].get("end_of_word_suffix") or ""
        self.inner = np.zeros(256, np.int64)
        self.last = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.inner[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"])]
        keys = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array([m for *_, m in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.mark = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.known: dict[bytes, int] = {}

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma doesn't depend on its place
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def chunk_words(self, chunk: bytes) -> tuple[int, list[bytes]]:
        """Special tokens in a chunk without ASCII white space, and its words as bytes."""
        text = chunk.decode()
        specials = 0
        if self.mark is not None and "<|" in text:
            parts = self.mark.split(text)
            specials = len(parts) - 1
            return specials, [w.encode() for p in parts for w in self.words.findall(self._normal(p))]
        return 0, [w.encode() for w in self.words.findall(self._normal(text))]

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (no word is empty)."""
        lengths = np.array([len(w) for w in words], np.int64)
        counts = lengths.copy()
        if not len(words):
            return counts
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = np.int64(1 << 40)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            # the lowest rank of each word
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.append(rank, none)
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(owner)))
            busy = lowest < none
            counts[owner[first[~busy]]] = sizes[~busy]
            if not busy.any():
                return counts
            hit = (rank == np.repeat(lowest, sizes)) & np.repeat(busy, sizes)
            # of overlapping hits (as in aaa) every second one counts, from the left
            starts = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(starts, place, 0))
            hit &= (place - run_start) % 2 == 0
            merged_at = np.flatnonzero(hit)
            symbols[merged_at] = self.merged[rank[merged_at]]
            keep = np.repeat(busy, sizes)
            keep[merged_at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            counts[owner[0]] = 1
        return counts

    def learn(self, chunks: set[bytes]) -> dict[bytes, int]:
        """Counts of chunks that aren't known."""
        split = [(c, *self.chunk_words(c)) for c in chunks]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for *_, ws in split for w in ws))}
        counts = self.count_words([*distinct]).tolist()
        return {c: specials + sum(counts[distinct[w]] for w in ws) for c, specials, ws in split}

    def count(self, rows: list[bytes]) -> list[int]:
        """Tokens of each text."""
        parts = [r.split() for r in rows]
        new = set().union(*parts) - self.known.keys()
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = set().union(*parts)
        known = self.known
        known.update(self.learn(new))
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return out


@lru_cache(maxsize=4)
def load(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (more than ``limit`` tokens)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocab_path)
        for batch in common.pieces(batches, limit=2 << 20):
            rows = common.cut_rows(*common.column_bytes(batch.column(1)))
            n = np.array(counter.count(rows), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.arrow_map(common.texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
