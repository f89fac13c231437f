"""From token logits to entities: softmax and argmax, words, entities, filters, and merging of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalog
from ..functions.dialect import js_trim, translate
from ..functions.spans import finding

# Labels, floor, and expressions for what isn't an entity.
LABELS = ["O", "B-PERSON", "I-PERSON", "B-ORGANISATION", "I-ORGANISATION", "B-LOCATION", "I-LOCATION", "B-ADDR", "I-ADDR"]
FLOOR = 0.30
_STRUCTURED = r"(?:@|https?:\/\/|www\.|\b[A-Z]\d{7,}\b|\b[STFGM]\d{7}[A-Z]\b|\b\d{6}-\d{2}-\d{4}\b|\b\d{9,16}\b|\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b|\+\d|\b(?:nric|nik|cccd|npwp|nrc|passport|bank|account|phone|email|tax|license|licence)\b)"
_HARD_NEGATIVE = r"\b(?:project\s+alpha|react|python|apple|microsoft|openai|google|chatgpt|gemini|finance\s+team)\b"
_ORG_SUFFIX = r"\b(?:sdn\s+bhd|pte\s+ltd|ltd|limited|inc|corp|corporation|company|group|bank|hospital|university|ministry|department|agency|foundation)\b"
_ADDRESS_CUE = r"\b(?:address|alamat|resides?|lives?|delivery|jalan|road|street|avenue|block|no\.?|unit|suite|floor|postcode|postal|zip)\b"


def round3(c: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(c * 1000 + 0.5) / 1000


def softmax_argmax(logits: Column) -> tuple[Column, Column]:
    """Index of the greatest logit (the first of equals) and its probability."""
    top = F.array_max(logits)
    return (F.array_position(logits, top) - 1).cast("int"), F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double")))


def classify(df: DataFrame, keys: list[str], logits: str = "logits", labels: list[str] = LABELS) -> DataFrame:
    """df with label and confidence."""
    index, confidence = softmax_argmax(F.col(logits))
    return df.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), index + 1)).withColumn("confidence", confidence)


def tag_of(label: Column) -> tuple[Column, Column]:
    """(bi, tag) of a label; a label without prefix counts as inside, O as outside."""
    prefixed = F.rlike(label, F.lit("^[BI]-"))
    return F.when(label == "O", "O").when(prefixed, F.substring(label, 1, 1)).otherwise("I"), F.when(prefixed, F.substring(label, 3, 100)).otherwise(label)


def words(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """tokens: keys, pos, word_id (null: special), label, confidence, start, end. One row a word: tag, confidence, start, end.

    A word's tag is the one with the greatest sum of confidences, but any tag beats O; of equal sums the first seen wins. Its
    confidence is the greatest of that tag, and 0 for O.
    """
    bi, tag = tag_of(F.col("label"))
    seen = tokens.where("word_id is not null").withColumn("bi", bi).withColumn("tag", tag)
    by_tag = seen.groupBy(*keys, "word_id", "tag").agg(F.sum("confidence").alias("total"), F.max("confidence").alias("confidence"), F.min("pos").alias("first"), F.min_by("bi", "pos").alias("bi"), F.min("start").alias("start"), F.max("end").alias("end"))
    word = W.partitionBy(*keys, "word_id")
    ranked = by_tag.withColumn("n", F.row_number().over(word.orderBy((F.col("tag") == "O").cast("int"), F.desc("total"), "first")))
    ranked = ranked.withColumn("start", F.min("start").over(word)).withColumn("end", F.max("end").over(word))
    return ranked.where("n = 1").withColumn("confidence", F.when(F.col("tag") == "O", F.lit(0.0)).otherwise(F.col("confidence"))).select(*keys, "word_id", "tag", "bi", "confidence", "start", "end")


def islands(word_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring words of one tag, as entities: tag, start, end, confidence (mean over words, three decimals), n_words."""
    order = W.partitionBy(*keys).orderBy("word_id")
    changed = (F.col("tag") != F.coalesce(F.lag("tag").over(order), F.lit(""))).cast("int")
    island = F.sum("changed").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = word_rows.withColumn("changed", changed).withColumn("island", island).where("tag <> 'O'")
    return marked.groupBy(*keys, "island", "tag").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n_words")).select(*keys, "tag", "start", "end", "mean", round3(F.col("mean")).alias("confidence"), "n_words")


def suppressed(tag: Column, value: Column) -> Column:
    """Whether a value isn't an entity after all."""
    v = js_trim(value)
    has = lambda pattern, i=True: F.rlike(v, F.lit(translate(pattern, i)))
    parts = F.filter(F.transform(F.split(v, ","), js_trim), lambda p: p != "")
    one_word = F.size(F.filter(F.split(v, translate(r"\s+")), lambda p: p != "")) == 1
    return (
        (v == "") | has(r"^\[[A-Z_]+\]$") | has(r"^[*#X-]+$", False) | has(_STRUCTURED) | has(_HARD_NEGATIVE)
        | ((tag == "LOCATION") & ((F.size(parts) > 2) | has(r"^\d")))
        | ((tag == "ORGANISATION") & one_word & ~has(_ORG_SUFFIX) & ~has(r"^[A-Z][a-z]+bank\b", False))
        | ((tag == "ADDR") & ~has(_ADDRESS_CUE) & ~has(r"\d"))
    )


def entities(tokens: DataFrame, keys: list[str], texts: DataFrame, text_col: str = "text", threshold: float = 0.35) -> DataFrame:
    """keys, findings: the model's entities of each text, filtered, neighbours merged, in the form ``assess`` takes."""
    found = islands(words(tokens, keys), keys).where(F.col("tag").isin(list(catalog.NER_SEVERITY)) & (F.col("mean") >= max(threshold, FLOOR)))
    placed = found.join(texts.select(*keys, F.col(text_col).alias("_t")), keys)
    placed = placed.withColumn("value", F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")))
    placed = placed.where(~suppressed(F.col("tag"), F.col("value")))
    severity = F.element_at(F.create_map(*(F.lit(x) for p in catalog.NER_SEVERITY.items() for x in p)), F.col("tag"))
    # two spans that are found in several windows count once
    one = finding(F.col("tag"), F.col("value"), F.col("start"), F.col("end"), F.col("confidence"), severity, F.lit("ner"), F.lit(1 << 45) + F.col("start"))
    grouped = placed.dropDuplicates([*keys, "tag", "start", "end"]).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("findings"))
    return grouped.join(texts.select(*keys, F.col(text_col).alias("_t")), keys).select(*keys, merge_adjacent(F.col("_t"), F.col("findings")).alias("findings"))


def merge_adjacent(text: Column, findings: Column) -> Column:
    """Neighbours of one type with only white space between them become one; confidences are weighted by length and rounded at each step. The end is the later one's, even if that ends earlier."""

    def step(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        gap = F.when(f["start_index"] > last["end_index"], F.substring(text, last["end_index"] + 1, f["start_index"] - last["end_index"])).otherwise(F.lit(""))
        a, b = last["end_index"] - last["start_index"], f["end_index"] - f["start_index"]
        end = f["end_index"]
        merged = last.withField("end_index", end).withField("neg_end", -end).withField("value", F.substring(text, last["start_index"] + 1, end - last["start_index"])).withField("confidence", round3((last["confidence"] * a + f["confidence"] * b) / (a + b)))
        join = (last["type"] == f["type"]) & (js_trim(gap) == "")
        return F.when(F.size(kept) == 0, F.array(f)).otherwise(F.when(join, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(merged))).otherwise(F.concat(kept, F.array(f))))

    return F.aggregate(findings, F.slice(findings, 1, 0), step)
