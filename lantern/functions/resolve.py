"""Overlapping findings: one fold over findings in order of start, longer first, that keeps the better of two that overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog


def _with(f: Column, sources: Column) -> Column:
    return f.withField("detector_sources", sources)


def winner(a: Column, b: Column) -> Column:
    """An address from the model takes in a postcode inside it; an expression beats the model; then confidence, length, the first."""
    address = lambda f: (f["source"] == "ner") & (f["type"] == "ADDR")
    postcode = lambda f: (f["source"] == "regex") & f["type"].isin(catalog.POSTCODES)
    inside = lambda outer, inner: (outer["start_index"] <= inner["start_index"]) & (outer["end_index"] >= inner["end_index"])
    both = F.array(F.lit("ner"), F.lit("regex"))
    only = lambda f: _with(f, F.array(f["source"]))
    length = lambda f: f["end_index"] - f["start_index"]
    return (
        F.when(address(a) & postcode(b) & inside(a, b), _with(a, both))
        .when(address(b) & postcode(a) & inside(b, a), _with(b, both))
        .when((a["source"] == "regex") & (b["source"] == "ner"), only(a))
        .when((b["source"] == "regex") & (a["source"] == "ner"), only(b))
        .when(a["confidence"] != b["confidence"], F.when(a["confidence"] > b["confidence"], only(a)).otherwise(only(b)))
        .when(length(b) > length(a), only(b))
        .otherwise(only(a))
    )


def dedup(findings: Column) -> Column:
    """The findings that stay, in order. Each is compared with the last one kept only."""

    def step(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        overlap = (last["start_index"] < f["end_index"]) & (f["start_index"] < last["end_index"])
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(winner(last, f)))
        return F.when(F.size(kept) == 0, F.array(f)).otherwise(F.when(overlap, replaced).otherwise(F.concat(kept, F.array(f))))

    ordered = F.array_sort(findings)
    return F.when(F.size(findings) <= 1, findings).otherwise(F.aggregate(ordered, F.slice(findings, 1, 0), step))
