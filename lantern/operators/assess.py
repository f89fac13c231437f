"""Assessments: findings, score, level, top risks, suggestions and breakdown, by row or by group of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import redact, resolve, score, spans
from ..functions.dialect import js_trim

EMPTY = f"cast(array() as array<{spans.FINDING}>)"


def scan(df: DataFrame, text_col: str = "text", patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None, ner_col: str | None = None) -> DataFrame:
    """df with ``findings``: what the expressions find in the trimmed text, then what the model found (``ner_col``), nothing dropped yet."""
    settings = settings or catalog.Settings()
    # a column of its own, so that the text is trimmed once and not for every pattern
    trimmed = df.withColumn("_trimmed", js_trim(F.coalesce(F.col(text_col), F.lit(""))))
    found = spans.with_findings(trimmed, "_trimmed", patterns, settings).drop("_trimmed")
    if ner_col and settings.enable_ner:
        found = found.withColumn("findings", spans.concat_findings(F.col("findings"), F.coalesce(F.col(ner_col), F.expr(EMPTY))))
    return found


def findings_rows(df: DataFrame, keys: list[str], column: str = "findings") -> DataFrame:
    """One row for each finding."""
    f = F.col("f")
    # a plain explode infers a filter on the array, which would be worked out a second time below all projections
    return df.select(*keys, F.explode_outer(column).alias("f")).where("f is not null").select(
        *keys, f["type"].alias("type"), f["value"].alias("value"), f["start_index"].alias("start_index"), f["end_index"].alias("end_index"), f["confidence"].alias("confidence"), f["severity"].alias("severity"), f["source"].alias("source"),
        f["detector_sources"].alias("detector_sources"), f["input_source"].alias("input_source"), f["ord"].alias("ord"),
    )


def summary(findings: Column) -> list[Column]:
    """The columns of an assessment, of deduplicated findings."""
    return [
        score.score(findings).alias("score"),
        score.level(score.score(findings)).alias("level"),
        F.size(findings).alias("finding_count"),
        score.types(findings).alias("finding_types"),
        score.top_risks(findings).alias("top_risks"),
        score.suggestions(findings).alias("suggestions"),
        score.breakdown(findings).alias("breakdown"),
    ]


def assess(df: DataFrame, keys: list[str], text_col: str = "text", patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None, ner_col: str | None = None) -> DataFrame:
    """One assessment a row, with ``findings`` deduplicated. No shuffle: everything happens within the row."""
    found = scan(df, text_col, patterns, settings, ner_col).select(*keys, "findings").select(*keys, resolve.dedup(F.col("findings")).alias("findings"))
    return found.select(*keys, "findings", *summary(F.col("findings")))


def assess_sources(df: DataFrame, assessment_col: str, source_col: str, order_col: str, text_col: str = "text", patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None) -> DataFrame:
    """One assessment for each value of ``assessment_col``, over all its sources: as ``assess``, and ``source_groups``.

    Blank sources are dropped. Only findings and labels are shuffled, never texts. With ``dedup_scope`` "assessment" findings
    of different sources displace each other, as their offsets are compared though they are in different texts; with
    "source" they don't. An assessment without any text has score 0 and no findings.
    """
    settings = settings or catalog.Settings()
    trimmed = js_trim(F.coalesce(F.col(text_col), F.lit("")))
    found = df.select(F.col(assessment_col).alias("a"), F.col(source_col).cast("string").alias("label"), F.col(order_col).alias("o"), trimmed.alias("t"))
    label = F.col("label")
    found = spans.with_findings(found, "t", patterns, settings, "raw")
    found = found.select("a", "label", "o", (F.length("t") > 0).alias("some"), F.transform("raw", lambda f: f.withField("input_source", label)).alias("raw"))
    one = F.struct(F.col("o").alias("o"), label.alias("label"), F.col("raw").alias("raw"))
    grouped = found.groupBy("a").agg(F.array_sort(F.collect_list(F.when(F.col("some"), one))).alias("sources"))
    groups = F.transform(F.col("sources"), lambda s: F.struct(s["label"].alias("label"), resolve.dedup(s["raw"]).alias("findings")))
    grouped = grouped.withColumn("groups", groups)
    pooled = F.flatten(F.transform("sources", lambda s, i: F.transform(s["raw"], lambda f: f.withField("ord", f["ord"] + i.cast("long") * (1 << 40)))))
    every = resolve.dedup(pooled) if settings.dedup_scope == "assessment" else F.flatten(F.transform("groups", lambda g: g["findings"]))
    out = grouped.withColumn("findings", every)
    shown = F.filter("groups", lambda g: (F.size(g["findings"]) > 0) | (F.size("groups") > 1))
    scored = F.transform(shown, lambda g: F.struct(g["label"].alias("label"), score.score(g["findings"]).alias("score"), score.level(score.score(g["findings"])).alias("level"), F.size(g["findings"]).alias("finding_count"), g["findings"].alias("findings")))
    return out.select(F.col("a").alias(assessment_col), "findings", *summary(F.col("findings")), scored.alias("source_groups"))


def redacted(df: DataFrame, keys: list[str], text_col: str = "text", mask: str = "brackets", patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None) -> DataFrame:
    """keys, redacted_text, redactions: each row's trimmed text with all findings of the text box masked."""
    trimmed = df.select(*keys, js_trim(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    raw = spans.with_findings(trimmed, "t", patterns, settings, "raw")
    found = raw.select(*keys, "t", redact.redactable(resolve.dedup(F.col("raw"))).alias("findings"))
    return found.select(*keys, redact.redact(F.col("t"), F.col("findings"), mask).alias("redacted_text"), F.size("findings").alias("redactions"))


def highlights(df: DataFrame, keys: list[str], text_col: str = "text", patterns: list[catalog.Pattern] | None = None, settings: catalog.Settings | None = None) -> DataFrame:
    """keys, start_index, end_index, bucket of every finding in the text box (no source, or ``Textbox``)."""
    found = assess(df, keys, text_col, patterns, settings)
    rows = findings_rows(found, keys).where(F.col("input_source").isNull() | (F.col("input_source") == "Textbox"))
    return rows.select(*keys, "start_index", "end_index", redact.bucket(F.col("severity")).alias("bucket"))


def may_submit(pending: Column, status: Column, assessed: Column, text: Column, score_: Column, limit: int = 20) -> Column:
    """Whether a live text may be sent: allowed if there is nothing to send; blocked while pending, without a working assessor, after a change since the assessment, or from a score on."""
    return (
        F.when(F.length(js_trim(F.coalesce(text, F.lit("")))) == 0, True)
        .when(pending, False)
        .when(status.isin("offline", "error"), False)
        .when(~text.eqNullSafe(assessed), False)
        .otherwise(score_ < limit)
    )
