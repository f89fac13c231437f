"""The nearest occurrence, in whole texts, by brute force."""

import random

from lantern.functions import redact
from lantern.plans import queries
from pyspark.sql import functions as F


def brute(text, value, start):
    places = [p for p in range(len(text or "")) if text.startswith(value, p)]
    return min(places, key=lambda p: (abs(p - start), p), default=None)


def test_nearest_highlight_searches_whole_texts(spark, tmp_path):
    rng = random.Random(9)
    rows = ["x" * 2500 + "e", "x" * 150_000 + "e" + "y" * 9 + "e", "ab" * 3000, "", None, "e", "x" * 90 + "e" + "x" * 19 + "e", "e" * 40_000, "😀" * 2100 + "e"]
    rows += ["".join(rng.choice("abcd xyz" + "e" * (i % 3)) for _ in range(rng.randrange(5000))) for i in range(40)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.place for r in queries.nearest_highlight(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t, "e", 100) for i, t in enumerate(rows)}


def test_nearest_occurrence_of_longer_values(spark):
    rows = [("a.b.a.b a.b", "a.b", 6), ("axb a.b", "a.b", 0), ("\\\\Qx\\\\E \\\\Qx\\\\E", "x\\\\E", 9), ("none", "a.b", 1)]
    frame = spark.createDataFrame(rows, "t string, v string, s int")
    got = [r.p for r in frame.select(redact.nearest_occurrence(F.col("t"), F.col("v"), F.col("s")).alias("p")).collect()]
    assert got == [brute(*r) for r in rows]
