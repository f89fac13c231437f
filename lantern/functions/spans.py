"""Findings of a text as an array of structs, with built-in functions only: no row is shuffled or leaves the JVM.

A pattern is tried only where a cheap hint (a run of as many digits as it needs, a substring, a short expression, or for patterns
that need context any of the context words) is in the text at all; in most texts few are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from .dialect import SPACE, translate

FINDING = (
    "struct<start_index:int,neg_end:int,ord:bigint,end_index:int,type:string,value:string,confidence:double,"
    "severity:string,source:string,detector_sources:array<string>,input_source:string>"
)


def finding(type_, value, start, end, confidence, severity, source, ord_, input_source=None, sources=None) -> Column:
    """A finding. Its first fields make natural order the order of start, then of longer spans, then of ``ord``."""
    return F.struct(
        start.cast("int").alias("start_index"), (-end).cast("int").alias("neg_end"), ord_.cast("long").alias("ord"), end.cast("int").alias("end_index"),
        type_.alias("type"), value.alias("value"), confidence.cast("double").alias("confidence"), severity.alias("severity"), source.alias("source"),
        (F.lit(None) if sources is None else sources).cast("array<string>").alias("detector_sources"),
        (F.lit(None) if input_source is None else input_source).cast("string").alias("input_source"),
    )


def occurrences(text: Column, pattern: Column, matches: Column) -> Column:
    """array<struct<v, s>> of the matches that a pattern gave, with their code-point offsets."""
    pieces = F.split(text, pattern, -1)

    def place(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<v:string,s:int>>)").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.element_at(pieces, i))
            v = F.element_at(matches, i)
            return F.struct((s + F.length(v)).alias("at"), F.concat(acc["out"], F.array(F.struct(v.alias("v"), s.alias("s")))).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(matches)), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.array(pieces), place))


def line_at(text: Column, index: Column) -> Column:
    """The line that holds an offset."""
    return F.concat(F.substring_index(F.substring(text, F.lit(1), index), "\n", -1), F.substring_index(F.substring(text, index + 1, F.length(text)), "\n", 1))


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, f"[-{SPACE}]", ""))


def _java(patterns: list[catalog.Pattern], wide: bool) -> tuple[list[str], dict[str, str]]:
    java = [translate(p.regex, p.ignore_case, wide) for p in patterns]
    contexts = {p.context: translate(catalog.CONTEXTS.get(p.context, p.context), True, wide) for p in patterns if p.context}
    return java, contexts


def _hinted(text: Column, context: str, wide: bool) -> Column:
    """Whether a word of the context can be in some window: the words are looked for without their boundaries, as a window's ends may cut longer ones to size."""
    pattern = catalog.CONTEXTS.get(context, "")
    if not (pattern.startswith(r"\b(?:") and pattern.endswith(r")\b")):
        return F.lit(True)
    return F.rlike(text, F.lit(translate(pattern[2:-2], True, wide)))


def with_findings(df: DataFrame, text_col: str, patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None, name: str = "findings") -> DataFrame:
    """df with an array of findings of all patterns: pattern by pattern, each from left to right. Null text has none.

    Built in steps that Catalyst keeps apart, so that nothing is searched for twice: which digits and context words are
    in the text; what each pattern that is worth trying matches; what of that holds.
    """
    patterns = catalog.default_patterns() if patterns is None else patterns
    settings = settings or catalog.Settings()
    text = F.col(text_col)
    if not settings.enable_regex or not patterns:
        return df.withColumn(name, F.expr(f"cast(array() as array<{FINDING}>)"))
    wide = settings.unicode_boundaries
    java, contexts = _java(patterns, wide)
    own = df.columns
    # most texts have no digit, and most patterns need a run of some
    runs = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.length)
    step = df.select("*", F.when(F.rlike(text, F.lit("[0-9]")), F.array_max(runs)).otherwise(F.lit(0)).alias("_run"))
    flags = {c: f"_c{i}" for i, c in enumerate(contexts)}
    least = {c: min(catalog.DIGITS.get(p.type, 0) for p in patterns if p.context == c) for c in contexts}
    words = [((F.col("_run") >= least[c]) & _hinted(text, c, wide)).alias(n) for c, n in flags.items()]
    words.append(((F.col("_run") >= catalog.DIGITS["ID_NIK"]) & F.rlike(text, F.lit(translate(catalog.NIK_TABLE, True, wide)))).alias("_nik"))
    step = step.select("*", *words)

    def worth(p: catalog.Pattern) -> Column:
        need = F.col("_run") >= catalog.DIGITS.get(p.type, 0)
        if p.context:
            found = F.col(flags[p.context])
            return need & ((found | F.col("_nik")) if p.type == "ID_NIK" else found)
        kind, hint = catalog.HINTS.get(p.type, (None, None))
        if kind == "text":
            return need & F.contains(text, F.lit(hint))
        return need & F.rlike(text, F.lit(translate(hint))) if kind else need

    none = F.expr("cast(array() as array<string>)")
    tried = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.when(worth(p), F.regexp_extract_all(text, F.lit(java[i]), F.lit(0))).otherwise(none).alias("m")) for i, p in enumerate(patterns)))
    step = step.select(*own, "_nik", F.filter(tried, lambda t: F.size(t["m"]) > 0).alias("_hits"))
    # a generator is a fence: filters on what follows aren't pushed below it, where they would do all of this again
    return step.select(*own, F.explode_outer(F.array(_settled(text, patterns, java, contexts))).alias(name))


def _settled(text: Column, patterns: list[catalog.Pattern], java: list[str], contexts: dict[str, str]) -> Column:
    """The findings of _hits: those with context and sound numbers."""
    literal = lambda values: F.array(*map(F.lit, values))
    all_java, all_types, all_severities = literal(java), literal([p.type for p in patterns]), literal([p.severity for p in patterns])
    numbers = {c: [i for i, p in enumerate(patterns, 1) if p.context == c] for c in contexts}

    def keep(t: Column, m: Column) -> Column:
        start, end, value = m["s"], m["s"] + F.length(m["v"]), m["v"]
        name = F.element_at(all_types, t["i"])
        low = F.greatest(start - catalog.CONTEXT_WINDOW, F.lit(0))
        window = F.substring(text, low + 1, end + catalog.CONTEXT_WINDOW - low)
        back = F.greatest(start - 60, F.lit(0))
        table = (
            (name == "ID_NIK")
            & F.col("_nik")
            & F.rlike(F.substring(text, back + 1, start - back), F.lit(translate(catalog.NIK_ROW_BEFORE)))
            & F.rlike(F.substring(text, end + 1, F.lit(20)), F.lit(translate(catalog.NIK_ROW_AFTER)))
        )
        # literals, so that each expression is compiled once and not for each match
        near = reduce(lambda out, c: out.when(t["i"].isin(numbers[c]), F.rlike(window, F.lit(contexts[c]))), contexts, F.when(F.lit(False), F.lit(True))).otherwise(F.lit(True)) | table
        ocr = F.contains(text, F.lit(catalog.OCR_MARKER))
        card = F.rlike(value, F.lit(translate(catalog.CARD_SHAPE)))
        good = (
            F.when(name == "CREDIT_CARD", luhn(value))
            .when(name == "BANK_ACCT", ~(card & luhn(value)))
            .when(name == "TAX_ID", ~(ocr & F.rlike(value, F.lit(translate(catalog.OCR_PHONE)))))
            .when(name.isin(catalog.POSTCODES), ~(ocr & F.rlike(line_at(text, start), F.lit(translate(catalog.OCR_PHONE_LINE)))))
            .otherwise(F.lit(True))
        )
        return near & good

    def findings(t: Column) -> Column:
        kept = F.filter(occurrences(text, F.element_at(all_java, t["i"]), t["m"]), lambda m: keep(t, m))
        return F.transform(
            kept,
            lambda m, k: finding(F.element_at(all_types, t["i"]), m["v"], m["s"], m["s"] + F.length(m["v"]), F.lit(1.0), F.element_at(all_severities, t["i"]), F.lit("regex"), t["i"].cast("long") * (1 << 32) + k),
        )

    return F.coalesce(F.flatten(F.transform("_hits", findings)), F.expr(f"cast(array() as array<{FINDING}>)"))


def concat_findings(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)
