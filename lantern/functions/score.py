"""Score, level, top risks, suggestions and breakdown of an array of findings (already deduplicated, in order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog


def weight(severity: Column) -> Column:
    out = None
    for name, value in catalog.WEIGHTS.items():
        out = F.when(severity == name, F.lit(value)) if out is None else out.when(severity == name, F.lit(value))
    return out.otherwise(F.lit(catalog.OTHER_WEIGHT))


def types(findings: Column) -> Column:
    """Types in order of first appearance."""
    return F.array_distinct(F.transform(findings, lambda f: f["type"]))


def score(findings: Column) -> Column:
    """Over types: weight of the first one's severity, times the highest confidence, times log2 of one more than their number; 0 to 100."""

    def part(t: Column) -> Column:
        own = F.filter(findings, lambda f: f["type"] == t)
        most = F.array_max(F.transform(own, lambda f: f["confidence"]))
        return weight(F.element_at(own, 1)["severity"]) * most * F.log2(F.size(own) + F.lit(1.0))

    total = F.aggregate(F.transform(types(findings), part), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(100), F.floor(total + 0.5).cast("int"))


def level(score_: Column) -> Column:
    out = None
    for limit, name in catalog.LEVELS:
        out = F.when(score_ < limit, name) if out is None else out.when(score_ < limit, name)
    return out.otherwise(catalog.TOP_LEVEL)


def _ranked(findings: Column, key) -> Column:
    """Findings by descending key, of equals the earlier first."""
    keyed = F.transform(findings, lambda f, i: F.struct((-key(f)).alias("k"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda x: x["f"])


def top_risks(findings: Column, n: int = 3) -> Column:
    return F.slice(_ranked(findings, lambda f: weight(f["severity"]) * f["confidence"]), 1, n)


def suggestions(findings: Column, n: int = 5) -> Column:
    """Of each type the most severe finding (the first of equals), the most severe types first; nothing for low severity."""
    ranked = _ranked(findings, lambda f: weight_or_zero(f["severity"]))
    names = F.transform(ranked, lambda f: f["type"])
    firsts = F.filter(ranked, lambda f, i: F.array_position(names, f["type"]) == i + 1)

    def text(f: Column) -> Column:
        name = F.regexp_replace(f["type"], "_", " ")
        value = F.when(F.length(f["value"]) > 20, F.concat(F.substring(f["value"], 1, 20), F.lit("..."))).otherwise(f["value"])
        # Wording.
        return (
            F.when(f["severity"] == "critical", F.concat(F.lit("Redact "), name, F.lit(' "'), value, F.lit('" before submitting')))
            .when(f["severity"] == "high", F.concat(F.lit("Consider removing "), name, F.lit(' "'), value, F.lit('"')))
            .when(f["severity"] == "medium", F.concat(F.lit("Review "), name, F.lit(' mention: "'), value, F.lit('"')))
        )

    return F.slice(F.filter(F.transform(firsts, text), lambda s: s.isNotNull()), 1, n)


def weight_or_zero(severity: Column) -> Column:
    return F.when(severity.isin(list(catalog.WEIGHTS)), weight(severity)).otherwise(F.lit(0.0))


def breakdown(findings: Column) -> Column:
    """How many findings each detector had a part in; ocr_count stays 0, as no detector emits it."""
    sources = lambda f: F.coalesce(f["detector_sources"], F.array(f["source"]))
    count = lambda name: F.size(F.filter(findings, lambda f: F.array_contains(sources(f), name)))
    return F.struct(count("regex").alias("regex_count"), count("ner").alias("ner_count"), count("ocr").alias("ocr_count"))
