"""Numbers of text recognition in images: decoding of character logits, boxes from probability maps, resizing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# Fixed values of the models' contract.
THRESHOLD, BOX_SCORE, MIN_SIDE, EXPAND = 0.3, 0.5, 3, 0.3
MAX_SIDE, MULTIPLE, LINE_HEIGHT, MAX_WIDTH, MIN_WIDTH, MIN_CROP = 960, 32, 48, 1600, 4, 2


def ctc_ids(steps: Column) -> Column:
    """steps: array of logit arrays. Class of each step (the first of equals), repeats taken once, blanks (0) dropped."""
    best = F.transform(steps, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    return F.flatten(F.transform(F.array(best), lambda b: F.filter(b, lambda c, t: (c != 0) & ((t == 0) | (c != F.get(b, t - 1))))))


def ctc_text(steps: Column, dictionary: list[str]) -> Column:
    """Characters of the classes, dictionary[class - 1]; classes beyond the dictionary are left out."""
    characters = F.array(*map(F.lit, dictionary)) if dictionary else F.expr("cast(array() as array<string>)")
    return F.array_join(F.filter(F.transform(ctc_ids(steps), lambda c: F.get(characters, c - 1)), lambda s: s.isNotNull()), "")


def detection_size(width: Column, height: Column) -> Column:
    """struct<w, h, sx, sy>: the longest side at most 960, both floored to multiples of 32, and the way back."""
    scale = F.least(F.lit(1.0), F.lit(float(MAX_SIDE)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(MULTIPLE), (F.floor(F.floor(x * scale + 0.5) / MULTIPLE) * MULTIPLE).cast("int"))
    w, h = side(width), side(height)
    return F.struct(w.alias("w"), h.alias("h"), (width / w).alias("sx"), (height / h).alias("sy"))


def crop_width(width: Column, height: Column) -> Column:
    """Width of a line that is scaled to the recogniser's height."""
    return F.least(F.lit(MAX_WIDTH), F.greatest(F.lit(MIN_WIDTH), F.floor(width * LINE_HEIGHT / height + 0.5).cast("int")))


def normalise_chw(rgba: np.ndarray, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Rows by columns by four bytes to three planes of 32-bit floats."""
    return ((rgba[..., :3].astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def pack_lines(lines: list[np.ndarray]) -> np.ndarray:
    """Planes of lines of one height, padded with zeros on the right to the widest."""
    out = np.zeros((len(lines), 3, LINE_HEIGHT, max(x.shape[2] for x in lines)), np.float32)
    for i, x in enumerate(lines):
        out[i, :, :, : x.shape[2]] = x
    return out


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rows by columns by bytes at another size, by the four nearest pixels' centres."""

    def places(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = places(image.shape[0], height), places(image.shape[1], width)
    fx, fy = fx[None, :, None], fy[:, None, None]
    rows = image[y0].astype(np.float32) * (1 - fy) + image[y1].astype(np.float32) * fy
    return np.rint(rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(np.uint8)


def detection_input(rgba: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Planes for the detector, and the scale of columns and rows back to the image."""
    h, w = rgba.shape[:2]
    scale = min(1.0, MAX_SIDE / max(w, h))
    nw, nh = (max(MULTIPLE, int(np.floor(x * scale + 0.5)) // MULTIPLE * MULTIPLE) for x in (w, h))
    return normalise_chw(resize(rgba, nw, nh)), w / nw, h / nh


def line_inputs(rgba: np.ndarray, boxes: list[dict]) -> list[np.ndarray]:
    """Planes of each box's pixels at the recogniser's height; boxes with less than two pixels a side inside the image are dropped."""
    out = []
    for b in boxes:
        part = rgba[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]
        h, w = part.shape[:2]
        if min(h, w) >= MIN_CROP:
            out.append(normalise_chw(resize(part, min(MAX_WIDTH, max(MIN_WIDTH, int(np.floor(w * LINE_HEIGHT / h + 0.5)))), LINE_HEIGHT)))
    return out


Detector = Callable[[np.ndarray], np.ndarray]
Recogniser = Callable[[np.ndarray], np.ndarray]


def read_image(rgba: np.ndarray, detect: Detector, recognise: Recogniser, dictionary: list[str]) -> str:
    """Lines of text in an image. detect: planes to a map of probabilities; recognise: packed lines to logits of lines, steps, classes.

    An image that can't be read gives an empty text.
    """
    try:
        planes, sx, sy = detection_input(rgba)
        lines = line_inputs(rgba, boxes_of(np.asarray(detect(planes)), sx, sy))
        found = []
        for steps in np.asarray(recognise(pack_lines(lines))) if lines else ():
            best = steps.argmax(axis=1)
            first = np.concatenate([[True], best[1:] != best[:-1]])
            found.append("".join(dictionary[c - 1] for c in best[first & (best > 0)].tolist() if c <= len(dictionary)).strip())
        return "\n".join(t for t in found if t)
    except (ValueError, IndexError, TypeError, ArithmeticError, RuntimeError, OSError):  # damaged pixels, or a model that refuses them
        return ""


def read_images(images: DataFrame, keys: list[str], models: Callable[[], tuple[Detector, Recogniser, list[str]]]) -> DataFrame:
    """images: keys, h, w, rgba (h * w * 4 bytes). keys, text. models is called once in each task, where the sessions are made."""
    ship_package(images.sparkSession)
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None
        for batch in batches:
            ready = ready or models()
            texts = []
            for h, w, data in zip(*(c.to_pylist() for c in batch.columns[n:])):
                whole = data is not None and h and w and len(data) == h * w * 4
                texts.append(read_image(np.frombuffer(data, np.uint8).reshape(h, w, 4), *ready) if whole else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keys, "text"])

    key_types = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "h", "w", "rgba").mapInArrow(run, f"{key_types}, text string")


def label_components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components by runs of rows and union of touching runs."""
    h, w = mask.shape
    runs: list[tuple[int, int, int]] = []
    up: list[int] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[int] = []
    for y in range(h):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        for a, b in edges.reshape(-1, 2).tolist():
            i = len(runs)
            runs.append((y, a, b))
            up.append(i)
            now.append(i)
            for j in before:
                if runs[j][1] < b and a < runs[j][2]:
                    up[max(root(i), root(j))] = min(root(i), root(j))
        before = now
    labels, names = np.zeros((h, w), np.int32), {}
    for i, (y, a, b) in enumerate(runs):
        labels[y, a:b] = names.setdefault(root(i), len(names) + 1)
    return labels, len(names)


def reading_order(boxes: list[dict]) -> list[dict]:
    """By row, then from left to right; boxes whose tops are within half the median height are in one row."""
    if not boxes:
        return boxes
    heights = sorted(b["h"] for b in boxes)
    tolerance = max(4, int(heights[len(heights) // 2] / 2 + 0.5))
    return sorted(boxes, key=cmp_to_key(lambda a, b: a["y"] - b["y"] if abs(a["y"] - b["y"]) > tolerance else a["x"] - b["x"]))


def boxes_of(prob: np.ndarray, sx: float, sy: float) -> list[dict]:
    """Text boxes of a probability map, scaled back to the image, in reading order."""
    labels, n = label_components(prob >= THRESHOLD)
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if bw < MIN_SIDE or bh < MIN_SIDE or prob[ys, xs].mean() < BOX_SCORE:
            continue
        pad = int(EXPAND * min(bw, bh) / 2 + 0.5)
        # the place is kept inside the image, the size is that of the padded box even at a border
        out.append({"x": max(0, int(np.floor((x0 - pad) * sx))), "y": max(0, int(np.floor((y0 - pad) * sy))), "w": int(np.ceil((bw + 2 * pad) * sx)), "h": int(np.ceil((bh + 2 * pad) * sy))})
    return reading_order(out)


def extract_boxes(maps: DataFrame, keys: list[str]) -> DataFrame:
    """maps: keys, h, w, scale_x, scale_y, prob (h * w values). keys, boxes: array<struct<x, y, w, h>>."""
    ship_package(maps.sparkSession)
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in "xywh"]))
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns[n:])))
            found = [boxes_of(np.array(p, np.float32).reshape(h, w), sx, sy) for h, w, sx, sy, p in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, kind)], [*keys, "boxes"])

    key_types = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in keys)
    return maps.select(*keys, "h", "w", "scale_x", "scale_y", "prob").mapInArrow(run, f"{key_types}, boxes array<struct<x:int,y:int,w:int,h:int>>")


def joined_lines(lines: Column) -> Column:
    """Recognised lines, trimmed, blank ones dropped, one below the other."""
    return F.array_join(F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != ""), "\n")
