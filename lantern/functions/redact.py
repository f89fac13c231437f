"""Masks, redaction, offsets after redaction, and highlights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_text(f: Column, mask: str = "brackets") -> Column:
    if mask == "asterisks":
        return F.repeat(F.lit("*"), F.length(f["value"]))
    if mask == "redacted":
        return F.lit("[REDACTED]")
    return F.concat(F.lit("["), f["type"], F.lit("]"))


def replacements(findings: Column, mask: str = "brackets") -> Column:
    """array<struct<s, e, r>> of findings, from right to left."""
    pairs = F.transform(findings, lambda f: F.struct(f["start_index"].alias("s"), f["end_index"].alias("e"), mask_text(f, mask).alias("r")))
    return F.sort_array(pairs, asc=False)


def redactable(findings: Column) -> Column:
    """Findings in the text box: only these can be masked in it."""
    return F.filter(findings, lambda f: f["input_source"].isNull() | (f["input_source"] == "Textbox"))


def redact(text: Column, findings: Column, mask: str = "brackets") -> Column:
    """The text with every finding masked.

    Findings that don't overlap, which is what is left after resolution: the masks and the pieces between them, put together once.
    Others are masked from right to left, so offsets hold.
    """

    def joined(done: Column) -> Column:
        after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(done, i - 1)["e"])
        pieces = F.transform(done, lambda r, i: F.concat(F.substring(text, after(i) + 1, r["s"] - after(i)), r["r"]))
        last = F.element_at(done, -1)["e"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    def one_by_one(done: Column) -> Column:
        return F.aggregate(F.reverse(done), text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["s"]), r["r"], F.substring(t, r["e"] + 1, F.length(t))))

    def masked(done: Column) -> Column:
        apart = F.forall(F.sequence(F.lit(1), F.size(done)), lambda i: (i == 1) | (F.get(done, i - 1)["s"] >= F.get(done, i - 2)["e"]))
        return F.when(F.size(done) == 0, text).when(apart, joined(done)).otherwise(one_by_one(done))

    return F.element_at(F.transform(F.array(F.reverse(replacements(findings, mask))), masked), 1)


def shifted(findings: Column, done: Column) -> Column:
    """Findings that aren't among the replacements ``done`` (array<struct<s, e, r>>), with offsets after those."""
    left = F.filter(findings, lambda f: ~F.exists(done, lambda r: (r["s"] == f["start_index"]) & (r["e"] == f["end_index"])))

    def move(f: Column) -> Column:
        delta = F.aggregate(F.filter(done, lambda r: r["e"] <= f["start_index"]), F.lit(0), lambda a, r: a + F.length(r["r"]) - (r["e"] - r["s"]))
        return f.withField("start_index", f["start_index"] + delta).withField("end_index", f["end_index"] + delta).withField("neg_end", -(f["end_index"] + delta))

    return F.transform(left, move)


def bucket(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), severity).otherwise(F.lit("medium"))


def clamp(offset: Column, text: Column) -> Column:
    return F.least(F.greatest(offset, F.lit(0)), F.length(text))


def nearest_occurrence(text: Column, value: Column, start: Column) -> Column:
    """Offset of the occurrence of value that is nearest to start (the first of equals), or null."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.regexp_replace(value, r"\\E", r"\\E\\\\E\\Q"), F.lit("\\E")), -1)
    # one pass: where the piece ends, and the nearest place so far
    none = F.lit(None).cast("int")

    def step(a: Column, piece: Column) -> Column:
        p = a["at"] + F.length(piece)
        nearer = a["p"].isNull() | (F.abs(p - start) < F.abs(a["p"] - start))
        return F.struct((p + F.length(value)).alias("at"), F.when(nearer, p).otherwise(a["p"]).alias("p"))

    first = F.struct(F.lit(0).alias("at"), none.alias("p"))
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), first, step, lambda a: a["p"])


def time_label(then: Column, now: Column) -> Column:
    """How long ago, in words: both are timestamps."""
    seconds = now.cast("double") - then.cast("double")
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(then, "MMM d, hh:mm a"))
    )
