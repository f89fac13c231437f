"""Sources, text of images, entities, tokenizer, character decoding, boxes, live events, history."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.functions import ocr_text, redact
from lantern.functions.spans import finding
from lantern.operators import assess, history, ner, ocr, tokenizer
from lantern.sources import text as sources
from lantern.streaming import live


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_html(spark):
    page = "<h1>A&amp;B</h1><script>x@y.org</script>1 &lt; 2 &amp;lt;<STYLE a>q</STYLE>&#39;&quot;&nbsp;."
    assert one(spark, page, sources.html_to_text).split() == ["A&B", "1", "<", "2", "<", "'\"", "."]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, data in {"a.HTML": b"<b>x</b>@<i>y</i>", "b.txt": b" plain a@b.co ", "c.docx": docx(["first", "second"]), "d.docx": b"broken", "e.exe": b"no", "f.png": b"x", "g.doc": b"old"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.label: r for r in sources.read_files(spark, str(tmp_path), {"image": lambda b: ("Alamat Jl\n5O450", [])}).collect()}
    assert set(got) == {"a.HTML", "b.txt", "c.docx", "d.docx", "f.png"}
    assert got["b.txt"].text == "plain a@b.co" and got["c.docx"].text == "first\n\nsecond" and got["d.docx"].text == "" and got["d.docx"].warnings
    assert got["f.png"].text.endswith("OCR NORMALIZED\nAlamat kode pos 50450")
    assert sources.parse_dict("a\r\n \nb\n") == ["a", " ", "b"] and sources.parse_dict("") == []


def test_ocr_text(spark):
    table = "NAMA NIK\nSiti3171O11203900007\nBudi3171011203900007\nHP +62.812-3456.7890\nNPW: O9.254.294.3-4O7.OOO\nclean"
    lines = one(spark, table, ocr_text.normalize).split("OCR NORMALIZED\n")[1].split("\n")
    assert lines == ["NIK: 3171011203900007", "NO HP: +62 812 3456 7890", "NPWP: 09.254.294.3-407.000"]
    assert one(spark, "nothing here", ocr_text.normalize) == "nothing here"
    assert one(spark, "alamat 50450 x\n50450", ocr_text.normalize) == "alamat 50450 x\n50450"
    assert one(spark, "OIl|!'SsBb x", ocr_text.repair) == "0111115588 x"


def test_entities(spark):
    text = "Anna Lee met Bob at Jalan Ampang 5"
    starts = [0, 5, 9, 13, 17, 20, 26, 33]
    words = text.split()
    labels = ["B-PERSON", "I-PERSON", "O", "B-PERSON", "O", "B-ADDR", "I-ADDR", "I-ADDR"]
    rows = [(1, i, i, lab, 0.8 + 0.01 * i, s, s + len(w)) for i, (lab, s, w) in enumerate(zip(labels, starts, words))]
    rows += [(1, 20, None, "B-PERSON", 0.99, 0, 0), (1, 21, 2, "I-PERSON", 0.2, 9, 12)]
    tokens = spark.createDataFrame(rows, "id int, pos int, word_id int, label string, confidence double, start int, end int")
    found = ner.entities(tokens, ["id"], spark.createDataFrame([(1, text)], "id int, text string")).first().findings
    # a tag beats outside, so "met" joins the two names
    assert [(f.type, f.value) for f in found] == [("PERSON", "Anna Lee met Bob"), ("ADDR", "Jalan Ampang 5")]
    assert found[0].confidence == pytest.approx(0.660, abs=1e-9)


def test_suppression(spark):
    cases = [("PERSON", " ", True), ("PERSON", "[NAME]", True), ("PERSON", "XXX", True), ("PERSON", "x@y", True), ("PERSON", "OpenAI", True), ("PERSON", "Anna", False), ("LOCATION", "a, b, c", True), ("LOCATION", "5 Road", True), ("ORGANISATION", "Acme", True), ("ORGANISATION", "Acme Ltd", False), ("ORGANISATION", "Maybank", False), ("ADDR", "somewhere", True), ("ADDR", "Jalan 5", False)]
    got = spark.createDataFrame(cases, "tag string, v string, want boolean").select("want", ner.suppressed(F.col("tag"), F.col("v")).alias("got"), "v").collect()
    assert [r.v for r in got if r.want != r.got] == []


def test_tokenizer_and_windows(spark):
    u = tokenizer.Unigram([("[PAD]", 0), ("[CLS]", 0), ("[SEP]", 0), ("[UNK]", 0), ("▁", -3), ("▁ab", -1), ("a", -2), ("b", -2), ("c", -2), ("▁a", -1.5), ("bc", -1.2)], {"<x>": 11})
    e = u.encode("ab  abc d", 16)
    assert e["tokens"][:7] == ["[CLS]", "▁ab", "▁a", "bc", "▁", "d", "[SEP]"] and e["ids"][5] == u.unk
    assert list(zip(e["starts"], e["ends"]))[1:6] == [(0, 2), (4, 5), (5, 7), (8, 8), (8, 9)] and e["word_ids"][1:6] == [0, 1, 1, 2, 2]
    assert u.decode(e["ids"][:4]) == "ab abc" and sum(e["mask"]) == 7
    text = " ".join(["abc"] * 900)
    windows = u.windows("  " + text)
    assert all(("  " + text)[s : s + len(p)] == p for s, p in windows) and windows[-1][0] + len(windows[-1][1]) == len(text) + 2
    got = tokenizer.encode(spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string"), ["id"], "text", u).collect()
    assert [r.id for r in got] == [1] and got[0].ids[:3] == [1, 5, 2]


def test_ctc(spark):
    path = [1, 1, 0, 1, 2, 2, 0, 0, 3, 9]
    steps = [[float(k == c) for k in range(10)] for c in path]
    frame = spark.createDataFrame([(steps,), ([],)], "s array<array<double>>")
    assert [r[0] for r in frame.select(ocr.ctc_text(F.col("s"), ["a", "b", "c"])).collect()] == ["aabc", ""]
    assert one(spark, [" a ", "", "b"], ocr.joined_lines, "array<string>") == "a\nb"


def test_boxes(spark):
    m = np.zeros((40, 60), np.float32)
    m[5:15, 30:50] = 0.9
    m[6:16, 5:20] = 0.8
    m[30:32, 5:7] = 0.9  # too small
    m[25:35, 30:50] = 0.4  # too faint
    got = ocr.extract_boxes(spark.createDataFrame([(1, 40, 60, 2.0, 1.0, m.ravel().tolist())], "id int, h int, w int, scale_x double, scale_y double, prob array<float>"), ["id"]).first().boxes
    assert [tuple(b) for b in got] == [(6, 4, 38, 14), (56, 3, 48, 14)]
    labels, n = ocr.label_components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool))
    assert n == 3 and labels[0, 0] == labels[0, 2] != labels[3, 0]
    assert ocr.pack_lines([np.ones((3, 48, 5)), np.ones((3, 48, 9))]).sum() == 3 * 48 * 14


def test_live_batch_forms(spark):
    rows = [(1, 0.0, "a"), (1, 0.1, "ab"), (1, 5.0, "ab"), (2, 1.0, "z"), (2, 1.2, "z")]
    events = spark.createDataFrame([(i, k, t, v) for i, (k, t, v) in enumerate(rows)], "id int, key long, t double, text string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r.id for r in live.debounced(events, "key", "ts", 0.3, "id").collect()) == [1, 2, 4]
    assert sorted(r.id for r in live.changed(events, "key", "ts", "text", "id").collect()) == [0, 1, 3]
    assert sorted((r.key, r.id) for r in live.latest(events.select("key", "id", "text"), "key", "id").collect()) == [(1, 2), (2, 4)]


def test_live_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key long, request_id long, text string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "a@b.co"), (2, 1, "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.debounce_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wait_ms=100)
    seen = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((r.key, r.request_id, r.score) for r in assess.assess(df, ["key", "request_id"]).select("key", "request_id", "score").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if len(seen) >= 2:
                break
    finally:
        query.stop()
    assert sorted(seen) == [(1, 2, 25), (2, 1, 0)]


def test_history(spark, tmp_path):
    texts = spark.createDataFrame([("a@b.co",), ("clean",), ("10.0.0.1 and x@y.org",)], "text string")
    history.append(assess.assess(texts, ["text"]), str(tmp_path / "h"))
    got = history.read(spark, str(tmp_path / "h")).collect()
    assert sorted(r.score for r in got) == [25, 37] and "text" not in got[0].asDict()
    history.clear(spark, str(tmp_path / "h"))
    assert history.read(spark, str(tmp_path / "h")).count() == 0


def test_submit_and_labels(spark):
    rows = [(False, "ok", "t", "t", 10, True), (True, "ok", "t", "t", 0, False), (False, "offline", "t", "t", 0, False), (False, "ok", "s", "t", 0, False), (False, "ok", "t", "t", 20, False), (True, "error", None, "  ", 99, True)]
    frame = spark.createDataFrame(rows, "p boolean, s string, a string, t string, n int, want boolean")
    assert all(r[0] == r[1] for r in frame.select("want", assess.may_submit(*map(F.col, "psatn"))).collect())
    label = lambda s: one(spark, s, lambda c: redact.time_label(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(c)), "long")
    assert [label(s) for s in (5, 120, 7300)] == ["just now", "2m ago", "2h ago"]


def test_boxes_at_borders_keep_their_size():
    prob = np.zeros((40, 60), np.float32)
    prob[0:20, 0:30] = 0.9
    (box,) = ocr.boxes_of(prob, 2.0, 1.5)
    pad = 3  # three tenths of the shorter side, halved
    assert box == {"x": 0, "y": 0, "w": (30 + 2 * pad) * 2, "h": 39}
    prob = np.zeros((40, 60), np.float32)
    prob[20:40, 30:60] = 0.9
    (box,) = ocr.boxes_of(prob, 1.0, 1.0)
    assert box == {"x": 27, "y": 17, "w": 36, "h": 26}


def test_outside_words_have_no_confidence(spark):
    rows = [(1, 0, 0, "O", 0.9, 0, 2), (1, 1, 0, "O", 0.8, 2, 4), (1, 2, 1, "O", 0.9, 5, 7), (1, 3, 1, "B-PERSON", 0.1, 7, 9)]
    tokens = spark.createDataFrame(rows, "id int, pos int, word_id int, label string, confidence double, start int, end int")
    got = ner.words(tokens, ["id"]).orderBy("word_id").select("tag", "confidence", "start", "end").collect()
    assert [tuple(r) for r in got] == [("O", 0.0, 0, 4), ("PERSON", 0.1, 5, 9)]


def test_merged_neighbours_end_where_the_later_one_ends(spark):
    text = "Anna Maria Lopez"
    rows = [(text, [(0, 16, 0.5), (5, 10, 0.8)])]
    frame = spark.createDataFrame(rows, "t string, f array<struct<s:int,e:int,c:double>>")
    made = F.transform("f", lambda f: finding(F.lit("PERSON"), F.substring(F.col("t"), f["s"] + 1, f["e"] - f["s"]), f["s"], f["e"], f["c"], F.lit("medium"), F.lit("ner"), f["s"]))
    (one,) = frame.select(ner.merge_adjacent(F.col("t"), made).alias("m")).first().m
    assert (one.start_index, one.end_index, one.value, one.confidence) == (0, 10, "Anna Maria", 0.571)


def test_redaction_of_findings_that_overlap_or_not(spark):
    rows = [("abcdefgh", [(0, 2), (2, 3), (6, 8)]), ("abcdefgh", [(0, 4), (2, 6)]), ("abc", []), ("a\U0001F600bc", [(1, 3)])]
    frame = spark.createDataFrame(rows, "t string, f array<struct<s:int,e:int>>")
    made = F.transform("f", lambda f: finding(F.lit("X"), F.substring(F.col("t"), f["s"] + 1, f["e"] - f["s"]), f["s"], f["e"], F.lit(1.0), F.lit("low"), F.lit("regex"), f["s"]))
    got = [r.r for r in frame.select(redact.redact(F.col("t"), made).alias("r")).collect()]

    def brute(text, spans):
        for s, e in sorted(spans, reverse=True):
            text = text[:s] + "[X]" + text[e:]
        return text

    assert got == [brute(t, f) for t, f in rows]


def test_only_findings_of_the_text_box_are_masked(spark):
    frame = spark.createDataFrame([([("Textbox",), (None,), ("scan.pdf",)],)], "f array<struct<input_source:string>>")
    assert [r.input_source for r in frame.select(redact.redactable(F.col("f")).alias("f")).first().f] == ["Textbox", None]
