"""Patterns, context, checks, and dialect; every pattern has a positive case, and a pure-Python scan agrees."""

import re

import pytest

from lantern import catalog
from lantern.functions.dialect import translate
from lantern.operators import assess

POSITIVE = {
    "IC_NUMBER": ("born 880512-10-5523 there", "880512-10-5523"),
    "SG_NRIC": ("nric s7654321b", "s7654321b"),
    "ID_NIK": ("ktp 3171011203900007 x", "3171011203900007"),
    "TH_NATIONAL_ID": ("national id 3-1005-00123-45-6", "3-1005-00123-45-6"),
    "VN_CCCD": ("cccd 079203001234", "079203001234"),
    "PH_NATIONAL_ID": ("philid 1234-5678-9012-3456", "1234-5678-9012-3456"),
    "BN_IC": ("identity card 01-123456", "01-123456"),
    "MM_NRC": ("nrc 12/abcde(n)654321", "12/abcde(n)654321"),
    "KH_NATIONAL_ID": ("identity card 010234567 ", None),
    "LA_ID": ("laos id ab12345678", "ab12345678"),
    "PASSPORT": ("passport K12345678", "K12345678"),
    "PHONE": ("call +65 9123 4567 now", "+65 9123 4567"),
    "ID_NPWP": ("x 09.254.294.3-407.000 y", "09.254.294.3-407.000"),
    "PH_TIN": ("tin 123-456-789-000", "123-456-789-000"),
    "TAX_ID": ("tax c2584563202", "c2584563202"),
    "DRIVER_LICENSE": ("driving licence d123456", "d123456"),
    "EMAIL": ("to Some.One@Example.ORG.", "Some.One@Example.ORG"),
    "BANK_ACCT": ("account 5550001112223", "5550001112223"),
    "CREDIT_CARD": ("card 4539-1488-0343-6467 ok", "4539-1488-0343-6467"),
    "US_SSN": ("ssn 219-09-9999", "219-09-9999"),
    "IBAN": ("iban GB29NWBK60161331926819", "GB29NWBK60161331926819"),
    "MY_VEHICLE": ("plate WXY 1234", "WXY 1234"),
    "IP_ADDRESS": ("host 10.0.255.1 up", "10.0.255.1"),
    "AWS_KEY": ("AKIA" + "A1B2" * 4, "AKIA" + "A1B2" * 4),
    "GITHUB_PAT": ("ghp_" + "aB1" * 12, "ghp_" + "aB1" * 12),
    "GOOGLE_API_KEY": ("AIza" + "x-_9Q" * 7, "AIza" + "x-_9Q" * 7),
    "SLACK_TOKEN": ("xoxb-1234567890-ab", "xoxb-1234567890-ab"),
    "STRIPE_KEY": ("pk_test_" + "a1" * 12, "pk_test_" + "a1" * 12),
    "JWT": ("eyJabc.eyJdef.ghi", "eyJabc.eyJdef.ghi"),
    "PRIVATE_KEY": ("-----BEGIN EC PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"),
    "MY_POSTCODE": ("poskod 50450", "50450"),
    "SG_POSTCODE": ("postal 018956", "018956"),
    "PH_POSTCODE": ("barangay 1000", "1000"),
}
NEGATIVE = [
    ("SG_NRIC", "code S7654321B"), ("ID_NIK", "order 3171011203900007"), ("CREDIT_CARD", "4539 1488 0343 6468"), ("IP_ADDRESS", "256.1.1.1x 10.0.0.999"), ("BANK_ACCT", "number 5550001112223"),
    ("BANK_ACCT", "account 4539148803436467"), ("PASSPORT", "item K12345678"), ("MY_POSTCODE", "part 50450"), ("TAX_ID", "part c2584563202"), ("PHONE", "3171016281234567890123"),
    ("TAX_ID", "OCR NORMALIZED npwp 62.812.3456.789"), ("PH_POSTCODE", "alamat\nNO HP: +62 812 3456 7890\nOCR NORMALIZED"), ("BANK_ACCT", "bank " + "x" * 90 + " 5550001112223"),
]


def scan(spark, texts, **settings):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = assess.scan(frame, settings=catalog.Settings(**settings))
    rows = assess.findings_rows(found, ["id"]).collect()
    return [[r for r in rows if r.id == i] for i in range(len(texts))]


def test_positive_and_negative_cases(spark):
    assert set(POSITIVE) == {p[0] for p in catalog.PATTERNS} and len(catalog.PATTERNS) == 33
    found = scan(spark, [t for t, _ in POSITIVE.values()])
    for (name, (text, value)), rows in zip(POSITIVE.items(), found):
        own = [r for r in rows if r.type == name]
        assert own, name
        assert value is None or value in [r.value for r in own]
        for r in rows:
            assert text.strip()[r.start_index : r.end_index] == r.value
    for (name, text), rows in zip(NEGATIVE, scan(spark, [t for _, t in NEGATIVE])):
        assert name not in [r.type for r in rows], (name, text)


def test_flattened_table(spark):
    (rows,) = scan(spark, ["No NIK " + "x " * 60 + "Siti Aminah 3171011203900007 +62 812 3456 7890"])
    assert "ID_NIK" in [r.type for r in rows]


def test_empty_and_null(spark):
    assert scan(spark, [None, "", "   ", "clean words only"]) == [[], [], [], []]
    assert scan(spark, ["a@b.co"], enable_regex=False) == [[]]


def python_pattern(p):
    flags = re.A | (re.I if p.ignore_case else 0)
    return re.compile(p.regex, flags)


def test_agrees_with_python(spark):
    """Raw matches of all patterns against re, on ASCII texts made of pieces of positive cases."""
    texts = [" ".join(t for t, _ in list(POSITIVE.values())[i : i + 6]) for i in range(0, 33, 3)] + ["é901231-14-5678 x901231-14-5678 901231-14-5678"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = [catalog.Pattern(p.type, p.regex, p.severity, p.ignore_case) for p in catalog.default_patterns() if p.type not in ("CREDIT_CARD", "BANK_ACCT", "TAX_ID")]
    rows = assess.findings_rows(assess.scan(frame, patterns=plain), ["id"]).collect()
    got = sorted((r.id, r.type, r.start_index, r.value) for r in rows if r.type not in catalog.POSTCODES)
    want = sorted((i, p.type, m.start(), m.group()) for i, t in enumerate(texts) for p in plain if p.type not in catalog.POSTCODES for m in python_pattern(p).finditer(t))
    assert got == want


@pytest.mark.parametrize("pattern,text,hit", [(r"\bx\b", "éx", True), (r"a\sb", "a\xa0b", True), (r"x$", "x\n", False), (r"^\s*y", "﻿y", True)])
def test_dialect(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(F.rlike("t", F.lit(translate(pattern)))).first()[0] is hit


def test_unicode_boundaries(spark):
    text = ["ที่อยู่ 12345"]
    assert [r.type for r in scan(spark, text)[0]] == []
    assert "MY_POSTCODE" in [r.type for r in scan(spark, text, unicode_boundaries=True)[0]]


def test_settings_merge():
    assert catalog.Settings.merged({"ner_threshold": 0.5, "mask": None, "other": 1}) == catalog.Settings(ner_threshold=0.5)


def test_windows_may_cut_words_to_context_words(spark):
    """The window begins 80 characters before a match, here inside a longer word."""
    text = "xxgst " + "y" * 76 + " 555-2766"
    cut = [t for t in (text[k:] for k in range(4))]
    assert [[r.value for r in rows if r.type == "TAX_ID"] for rows in scan(spark, cut)] == [["555-2766"] if "gst" in t[max(0, t.index("555") - 80) :] and (len(t) - 8 - 80 == t.index("gst") or t.startswith("gst")) else [] for t in cut]
