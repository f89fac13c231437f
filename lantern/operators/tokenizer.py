"""Unigram tokenizer for the entity model: best segmentation by score, windows of 256 tokens, offsets in the text."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

MAX_TOKENS, OVERLAP, SLICE = 256, 48, 1270
UNKNOWN_SCORE = -100.0
MARK = "▁"


class Unigram:
    def __init__(self, vocab: list[tuple[str, float]], added: dict[str, int] | None = None):
        self.ids = {t: (i, s) for i, (t, s) in reversed(list(enumerate(vocab)))}
        for token, i in (added or {}).items():
            self.ids[token] = (i, 0.0)
        self.tokens = {i: t for t, (i, _) in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        special = lambda name, default: self.ids.get(name, (default, 0))[0]
        self.cls, self.sep, self.pad, self.unk = special("[CLS]", 1), special("[SEP]", 2), special("[PAD]", 0), special("[UNK]", 3)

    @classmethod
    def from_json(cls, text: str) -> Unigram:
        spec = json.loads(text)
        return cls([(t, s) for t, s in spec["model"]["vocab"]], {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def segment(self, word: str) -> list[str]:
        """The segmentation with the greatest sum of scores; of equals the one with the shorter last token."""
        n = len(word)
        best: list[float] = [0.0] + [float("-inf")] * n
        back = [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                known = self.ids.get(word[start:end])
                score = known[1] if known else (UNKNOWN_SCORE if end - start == 1 else None)
                if score is not None and best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        out, end = [], n
        while end:
            out.append(word[back[end] : end])
            end = back[end]
        return out[::-1]

    def pieces(self, text: str) -> list[tuple[str, int, int, int]]:
        """(token, word, start, end) of a text; the word mark has no width."""
        out, at, word = [], 0, 0
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            end = at
            while end < len(text) and not text[end].isspace():
                end += 1
            place = at
            for token in self.segment(MARK + text[at:end]):
                width = len(token) - token.count(MARK) if place == at and token.startswith(MARK) else len(token)
                out.append((token, word, place, place + width))
                place += width
            at, word = end, word + 1
        return out

    def encode(self, text: str, size: int = MAX_TOKENS) -> dict:
        text = unicodedata.normalize("NFC", text.strip())
        pieces = self.pieces(text)[: size - 2]
        ids = [self.cls, *(self.ids.get(t, (self.unk, 0))[0] for t, *_ in pieces), self.sep]
        fill = size - len(ids)
        ids += [self.pad] * fill
        return {
            "ids": ids,
            "mask": [int(i != self.pad) for i in ids],
            "tokens": ["[CLS]", *(t for t, *_ in pieces), "[SEP]", *["[PAD]"] * fill],
            "word_ids": [None, *(w for _, w, _, _ in pieces), None, *[None] * fill],
            "starts": [0, *(s for *_, s, _ in pieces), 0, *[0] * fill],
            "ends": [0, *(e for *_, e in pieces), 0, *[0] * fill],
        }

    def decode(self, ids: list[int]) -> str:
        drop = {self.cls, self.sep, self.pad}
        return "".join(self.tokens.get(i, "") for i in ids if i not in drop).replace(MARK, " ").strip()

    def windows(self, text: str) -> list[tuple[int, str]]:
        """(start, slice) of overlapping windows. A text that fits in one window is one. The start of a slice is that of its first
        character that isn't white space, so offsets within hold; slices of few tokens advance to their end, so no text is left out."""
        if len(self.pieces(text)) < MAX_TOKENS - 2:
            lead = len(text) - len(text.lstrip())
            return [(lead, text.strip())] if text.strip() else []
        out, at = [], 0
        while at < len(text):
            part = text[at : at + SLICE]
            lead = len(part) - len(part.lstrip())
            body = part.strip()
            if body:
                out.append((at + lead, body))
            found = self.pieces(body)
            if at + SLICE >= len(text) and len(found) <= MAX_TOKENS - 2:
                break
            step = MAX_TOKENS - 2 - OVERLAP
            end = lead + (found[min(step, len(found)) - 1][3] if found else len(part))
            at += max(1, end)
        return out


def encode(df: DataFrame, keys: list[str], text_col: str, tokenizer: Unigram) -> DataFrame:
    """keys, window, offset, ids, mask, tokens, word_ids, starts, ends: a row for each window of each text."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)  # a model's vocabulary
    source = df.select(*keys, text_col)
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                for k, (start, part) in enumerate(sent.value.windows(text or "")):
                    owner.append(i)
                    rows.append((k, start, sent.value.encode(part)))
            columns = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:n]]
            encoded = lambda name, kind: pa.array([r[2][name] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), encoded("ids", pa.int64()), encoded("mask", pa.int64()), encoded("tokens", pa.string()), encoded("word_ids", pa.int32()), encoded("starts", pa.int32()), encoded("ends", pa.int32())],
                [*keys, "window", "offset", "ids", "mask", "tokens", "word_ids", "starts", "ends"],
            )

    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{key_types}, window int, offset int, ids array<long>, mask array<long>, tokens array<string>, word_ids array<int>, starts array<int>, ends array<int>")


def infer(encoded: DataFrame, keys: list[str], model_path: str) -> DataFrame:
    """encoded with ``logits`` (array of arrays), by a local ONNX model, one session a worker."""
    schema = encoded.schema.add("logits", "array<array<float>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        for batch in batches:
            column = lambda name: np.array(batch.column(batch.schema.get_field_index(name)).to_pylist(), np.int64)
            (logits,) = session.run(None, {"input_ids": column("ids"), "attention_mask": column("mask")})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logits.tolist(), pa.list_(pa.list_(pa.float32())))], [*batch.schema.names, "logits"])

    return encoded.mapInArrow(run, schema)
