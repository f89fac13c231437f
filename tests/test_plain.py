"""Plain Python against the expressions, over random texts made of pieces that matter; and the SQL functions."""

import random

from lantern.functions import plain, sql
from lantern.operators import assess
from tests.test_detection import NEGATIVE, POSITIVE


def test_same_findings(spark):
    rng = random.Random(21)
    parts = [t for t, _ in POSITIVE.values()] + [t for _, t in NEGATIVE] + ["\n", "é", "\xa0", "OCR NORMALIZED", "😀", "alamat", "nik", "account"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randrange(8))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = assess.assess(frame, ["id"]).select("id", "findings", "score").orderBy("id").collect()
    redacted = [r.redacted_text for r in assess.redacted(frame, ["id"]).orderBy("id").collect()]
    for t, r, red in zip(texts, got, redacted):
        want = plain.resolved(plain.scan_text(t))
        assert [(f["type"], f["value"], f["start"], f["end"]) for f in want] == [(f.type, f.value, f.start_index, f.end_index) for f in r.findings], t
        assert (plain.score_of(want), plain.redact_text(t)) == (r.score, red)


def test_sql_functions(spark):
    sql.register_all(spark)
    assert [tuple(r) for r in spark.sql("SELECT type, value FROM pii_scan('mail a@b.co')").collect()] == [("EMAIL", "a@b.co")]
    r = spark.sql("SELECT pii_score(t) AS s, pii_redact(t) AS r FROM VALUES ('mail a@b.co'), (NULL) AS x(t) ORDER BY s DESC").collect()
    assert [tuple(x) for x in r] == [(25, "mail [EMAIL]"), (0, "")]
