"""Overlaps, scores, suggestions, sources, redaction, and properties over random findings."""

import random

import pytest
from pyspark.sql import functions as F

from lantern import catalog
from lantern.functions import redact, resolve, score, spans
from lantern.operators import assess


def frame(spark, cases):
    """cases: lists of (start, end, type, severity, confidence, source)."""
    rows = [(i, [(s, -e, k, e, t, "v" * (e - s), c, sev, src, None, None) for k, (s, e, t, sev, c, src) in enumerate(case)]) for i, case in enumerate(cases)]
    return spark.createDataFrame(rows, f"id int, f array<{spans.FINDING}>")


def better(a, b):
    inside = lambda o, i: o["s"] <= i["s"] and o["e"] >= i["e"]
    address = lambda x: x["src"] == "ner" and x["t"] == "ADDR"
    post = lambda x: x["src"] == "regex" and x["t"] in catalog.POSTCODES
    for x, y in ((a, b), (b, a)):
        if address(x) and post(y) and inside(x, y):
            return x | {"d": ["ner", "regex"]}
    if a["src"] != b["src"]:
        w = a if a["src"] == "regex" else b
    elif a["c"] != b["c"]:
        w = a if a["c"] > b["c"] else b
    else:
        w = b if b["e"] - b["s"] > a["e"] - a["s"] else a
    return w | {"d": [w["src"]]}


def brute(case):
    every = [{"s": s, "e": e, "t": t, "sev": sev, "c": c, "src": src, "d": None} for s, e, t, sev, c, src in case]
    if len(every) <= 1:
        return every
    out = []
    for f in sorted(every, key=lambda f: (f["s"], -f["e"])):
        if out and out[-1]["s"] < f["e"] and f["s"] < out[-1]["e"]:
            out[-1] = better(out[-1], f)
        else:
            out.append(f)
    return out


def test_overlaps_equal_a_plain_fold(spark):
    rng = random.Random(1)
    kinds = [("EMAIL", "high", "regex"), ("MY_POSTCODE", "low", "regex"), ("ADDR", "high", "ner"), ("PERSON", "medium", "ner")]
    cases = [[(s := rng.randrange(30), s + rng.randrange(1, 12), *(lambda k: (k[0], k[1], rng.choice([0.5, 0.9, 1.0]), k[2]))(rng.choice(kinds))) for _ in range(rng.randrange(7))] for _ in range(300)]
    got = frame(spark, cases).select("id", resolve.dedup(F.col("f")).alias("f"), score.score(resolve.dedup(F.col("f"))).alias("score")).orderBy("id").collect()
    for case, r in zip(cases, got):
        assert [(f.start_index, f.end_index, f.type, f.confidence, f.detector_sources) for f in r.f] == [(f["s"], f["e"], f["t"], f["c"], f["d"]) for f in brute(case)]
        assert 0 <= r.score <= 100


@pytest.mark.parametrize(
    "counts,points,level",
    [({"EMAIL": 1}, 25, "Caution"), ({"CREDIT_CARD": 1}, 40, "Caution"), ({"IP_ADDRESS": 1}, 12, "Safe"), ({"EMAIL": 3}, 50, "High"), ({"US_SSN": 2}, 63, "High"), ({"EMAIL": 1, "CREDIT_CARD": 1, "IP_ADDRESS": 1}, 77, "High"), ({"US_SSN": 50}, 100, "Critical"), ({}, 0, "Safe")],
)
def test_scores(spark, counts, points, level):
    severity = {p.type: p.severity for p in catalog.default_patterns()}
    case = [(10 * k, 10 * k + 5, t, severity[t], 1.0, "regex") for k, t in enumerate(t for t, n in counts.items() for _ in range(n))]
    r = frame(spark, [case]).select(*assess.summary(F.col("f"))).first()
    assert (r.score, r.level, r.finding_count, list(r.finding_types)) == (points, level, sum(counts.values()), list(counts))


def test_suggestions_and_top(spark):
    case = [(0, 5, "LOW", "low", 1.0, "regex"), (10, 40, "BIG_ONE", "critical", 0.5, "regex"), (50, 55, "EMAIL", "high", 1.0, "regex"), (60, 65, "EMAIL", "high", 1.0, "regex"), (70, 75, "PLACE", "medium", 1.0, "ner")]
    r = frame(spark, [case]).select(*assess.summary(F.col("f"))).first()
    assert list(r.suggestions) == ['Redact BIG ONE "' + "v" * 20 + '..." before submitting', 'Consider removing EMAIL "vvvvv"', 'Review PLACE mention: "vvvvv"']
    assert [f.type for f in r.top_risks] == ["EMAIL", "EMAIL", "BIG_ONE"]
    assert tuple(r.breakdown) == (4, 1, 0)


def test_redaction_and_shift(spark):
    text = "mail a@b.co and 10.0.0.1 end"
    base = spark.createDataFrame([(text,)], "text string")
    for mask, want in (("brackets", "mail [EMAIL] and [IP_ADDRESS] end"), ("asterisks", "mail ****** and ******** end"), ("redacted", "mail [REDACTED] and [REDACTED] end")):
        assert assess.redacted(base, ["text"], mask=mask).first().redacted_text == want
    found = assess.assess(base, ["text"])
    done = F.slice(redact.replacements(F.filter("findings", lambda f: f["type"] == "EMAIL")), 1, 1)
    left = found.select(redact.shifted(F.col("findings"), done).alias("f")).first().f
    assert [(f.type, f.start_index) for f in left] == [("IP_ADDRESS", 17)]


def test_sources(spark):
    rows = [("a", "Textbox", 0, "card 4539148803436467"), ("a", "file.txt", 1, "to x@y.org now"), ("a", "blank", 2, "  "), ("b", "Textbox", 0, None), ("c", "Textbox", 0, "x@y.org")]
    base = spark.createDataFrame(rows, "a string, label string, o int, text string")
    got = {r.a: r for r in assess.assess_sources(base, "a", "label", "o", settings=catalog.Settings(dedup_scope="source")).collect()}
    assert [(g.label, g.score) for g in got["a"].source_groups] == [("Textbox", 40), ("file.txt", 25)] and got["a"].score == 65
    assert (got["b"].score, got["b"].level, len(got["b"].source_groups)) == (0, "Safe", 0)
    assert [g.label for g in got["c"].source_groups] == ["Textbox"]
    pooled = {r.a: r for r in assess.assess_sources(base, "a", "label", "o").collect()}
    assert pooled["a"].finding_count == 1  # offsets of both texts overlap
