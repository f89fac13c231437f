"""Byte-level BPE encoding and decoding.

The encoder walks a word once: an Aho-Corasick automaton gives the longest token at every byte, and a
token is appended only if the pair it forms with the token before it is compatible, that is, if merging
the two tokens' bytes in rank order gives just these two tokens again. If no prefix of the longest token
is compatible, the last token is taken back and its end is marked as a dead end, so that each position
is tried a bounded number of times. The result equals that of applying the merges one by one.

The decoder is a table of offsets: token i is bytes offsets[i] to offsets[i + 1] of one string, so that
all tokens of a batch are gathered in one step.

Texts are cut by single spaces between characters that aren't white space; such pieces are encoded
independently of each other and remembered.

Defined results: a null or empty text has no tokens and decodes to an empty text. Repeated rows and equal
doc_ids are encoded each for itself. Very long words cost time and memory in proportion to their length.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The words of GPT-2's published byte-level pre-tokenizer. Fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space where a text may not simply be cut at single spaces.
_ODD = regex.compile(r"[^\S \n]|  | \n|\n |^ | $")
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Pieces and words that a worker remembers at most; then it forgets all.
REMEMBER = 600_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows at U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """(decimal ids, raw ids) of pieces, by what follows the space that each begins with; a piece that isn't known is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> tuple[str, bytes]:
        got = self.encode(" " + part)
        if len(part) < 64:
            if len(self) > REMEMBER:
                self.clear()
            self[part] = got
        return got


class ByteBpe:
    """Tables of a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        by_id = [b""] * size
        for token, i in vocab.items():
            by_id[i] = token
        for token, i in self.special.items():
            by_id[i] = token.encode()
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.length = self.lengths.tolist()
        #: The rank at which a token comes into being (single bytes: 0), and the two tokens that it is merged of.
        self.made: list[int] = [0] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"], 1):
            left, right = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b = vocab[left], vocab[right]
            self.merge[a, b] = rank
            if self.halves[vocab[left + right]] is None and len(left + right) > 1:
                self.halves[vocab[left + right]] = (a, b)
                self.made[vocab[left + right]] = rank
        usable = {t: i for t, i in vocab.items() if len(t) == 1 or self.halves[i] is not None}
        self.ids = usable
        self.automaton = ahocorasick.Automaton()
        for token, i in usable.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * size
        for token, i in usable.items():
            self.shorter[i] = next((usable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), -1)
        self._fits: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}  # the garbage collector passes over tuples of numbers
        self._pieces = _Pieces(self._piece)
        self._marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as it is asked."""
        pair = left << 32 | right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > REMEMBER:
                self._fits.clear()
            known = self._fits[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Unless a merge across the border comes before the merges on either side of it that would hide it.

        The two tokens at the border are undone, the later one first; a pair across the border that merges
        before the last undone step would have been taken instead.
        """
        before = 1 << 60
        while True:
            if self.merge.get((left, right), 1 << 60) < before:
                return False
            made_left, made_right = self.made[left], self.made[right]
            if made_left == 0 and made_right == 0:
                return True
            # equal ranks: of two equal merges the left one is applied first, so the right one is undone first
            if made_left > made_right:
                before, left = made_left, self.halves[left][1]
            else:
                # a pair of the very same rank that starts further left is applied first
                before, right = made_right + 1, self.halves[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]  # a merged token's bytes always merge to it
        n = len(word)
        longest = [-1] * (n + 1)
        for end, (size, token) in self.automaton.iter(word.decode("latin-1")):
            longest[end - size + 1] = token  # later ends overwrite: the longest stays
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter, fits, known = self.length, self.shorter, self.fits, self._fits
        while at < n:
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if not out:
                        break
                    good = known.get(out[-1] << 32 | token)
                    if fits(out[-1], token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """Ids of a piece in decimal, joined by commas, and as little-endian 32-bit integers."""
        ids: list[int] = []
        words = self._words
        for word in (piece,) if piece[1:].isalpha() and piece.isascii() and piece[0] == " " else WORDS.findall(piece):
            known = words.get(word)
            if known is None:
                if len(words) > REMEMBER:
                    words.clear()
                known = words[word] = tuple(self.encode_word(word.encode()))
                if len(word) > 64:
                    del words[word]
            ids += known
        return ",".join(map(str, ids)), struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> tuple[list[str], list[bytes]]:
        """The decimal ids of all pieces, then their raw ids."""
        parts = text.split(" ") if _ODD.search(text) is None else _CUT.split(text)
        got = [self._piece(parts[0]), *map(self._pieces.__getitem__, parts[1:])]
        return [csv for csv, _ in got], [raw for _, raw in got]

    def encode(self, text: str) -> tuple[str, bytes]:
        """The ids of a text: decimal, joined by commas; and as little-endian 32-bit integers."""
        if not text:
            return "", b""
        if not any(map(text.__contains__, self.special)):
            csv, raw = self._plain(text)
            return ",".join(csv), b"".join(raw)
        all_csv, all_raw, at = [], [], 0
        for m in [*self._marks.finditer(text), None]:
            between = text[at : m.start() if m else len(text)]
            if between:
                csv, raw = self._plain(between)
                all_csv += csv
                all_raw += raw
            if m:
                i = self.special[m.group()]
                all_csv.append(str(i))
                all_raw.append(np.array([i], "<u4").tobytes())
                at = m.end()
        return ",".join(all_csv), b"".join(all_raw)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, joined, and where each id's bytes end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self.blob[source], ends


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def byte_text(data: bytes) -> bytes:
    """UTF-8 as it is; malformed parts become U+FFFD."""
    try:
        data.decode("utf-8")
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


def encode_decode(docs: DataFrame, vocab_path: str, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (array of int), ids_csv sha256 and decoded text.

    Columns: doc_id long, n_tokens long, ids binary (little-endian unsigned 32-bit), ids_sha256 string,
    decoded string, decoded_sha256 string. ``keep`` names the columns to make beside doc_id (default all),
    so that a digest need not carry texts through Arrow.
    """
    types = {"n_tokens": "long", "ids": "binary", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
    wanted = [c for c in types if keep is None or c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in common.pieces(batches, limit=1 << 20):
            csvs, raws = [], []
            for text in batch.column(1).to_pylist():
                csv, raw = bpe.encode(text)
                csvs.append(csv)
                raws.append(raw)
            ids = np.frombuffer(b"".join(raws), "<u4")
            counts = np.array([len(r) // 4 for r in raws], np.int64)
            data, ends = bpe.decode(ids)
            ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            decoded = [byte_text(x) for x in common.cut_rows(data, ends)]
            made = {
                "n_tokens": lambda: pa.array(counts),
                "ids": lambda: pa.array(raws, pa.binary()),
                "ids_sha256": lambda: pa.array([common.sha256(c.encode()) for c in csvs]),
                "decoded": lambda: pa.array([d.decode() for d in decoded]),
                "decoded_sha256": lambda: pa.array([common.sha256(d) for d in decoded]),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(made[c]() for c in wanted)], ["doc_id", *wanted])

    schema = ", ".join(["doc_id long", *(f"{c} {types[c]}" for c in wanted)])
    return common.arrow_map(common.texts(docs), run, schema)
