"""Normalisation of text read from images: helper lines for identifiers whose digits were misread, after a marker line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog
from .dialect import SPACE, translate

# Expressions.
_NIK_CONTEXT = r"\bN[I1]?K\b|N[I1]?K[:：]?|NAMA.*N[I1]?K|NIK|NK"
_TRAILING_DIGITS = r"[A-Za-z][A-Za-z0-9]*?(\d{16})$"
_PHONE = r"\+?\s*62[\s.:-]*\d{3}[\s.:-]*\d{3,4}[\s.:-]*\d{3,5}"
_LABELLED_NPWP = r"NPW[A-Z]*[:：]?\s*([0-9OILS'|!.,\s-]{12,24})"
_NPWP = r"[0-9OILS'|!]{2}\.[0-9OILS'|!]{3}\.[0-9OILS'|!]{3}\.[0-9OILS'|!]-[0-9OILS'|!]{3}\.[0-9OILS'|!]{3}"
_POSTCODE = r"([0-9OIl|!']{5})\s*$"
_ADDRESS = r"alamat|address|kode\s*pos"
_RAW_CONTEXT = r"\b(?:poskod|postcode|zip|postal|kod\s?pos|alamat|address|kode?\s?pos)\b"


def repair(c: Column) -> Column:
    """Letters that look like digits, as digits."""
    return F.translate(c, "OoIl|!'SsBb", "00111115588")


def _digits(c: Column) -> Column:
    return F.regexp_replace(repair(c), "[^0-9]", "")


def npwp(digits: Column) -> Column:
    part = lambda a, n: F.substring(digits, a, n)
    return F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("."), part(9, 1), F.lit("-"), part(10, 3), F.lit("."), part(13, 3))


def indonesian_phone(value: Column) -> Column:
    """+62 and groups of 3, 4 and the rest; null unless there are 10 to 15 digits from 62 on."""
    d = _digits(value)
    return F.when(
        d.startswith("62") & F.length(d).between(10, 15),
        F.when(F.length(d) <= 9, F.concat(F.lit("+62 "), F.substring(d, 3, 3), F.lit(" "), F.substring(d, 6, 20))).otherwise(
            F.concat(F.lit("+62 "), F.substring(d, 3, 3), F.lit(" "), F.substring(d, 6, 4), F.when(F.length(d) > 9, F.concat(F.lit(" "), F.substring(d, 10, 20))).otherwise(F.lit("")))
        ),
    )


def raw_postcode_context(text: Column, postcode: Column) -> Column:
    """Whether the first place where the postcode stands alone has an address word within 80 characters."""
    place = F.regexp_instr(text, F.concat(F.lit("(?<![0-9])"), postcode, F.lit("(?![0-9])"))) - 1
    low = F.greatest(place - 80, F.lit(0))
    return (place >= 0) & F.rlike(F.substring(text, low + 1, place + F.length(postcode) + 80 - low), F.lit(translate(_RAW_CONTEXT, True)))


def normalize(text: Column) -> Column:
    """The text, and if there are any, the marker and the distinct helper lines."""
    compact = F.upper(F.regexp_replace(text, f"[{SPACE}]+", ""))
    nik = F.rlike(compact, F.lit(translate(_NIK_CONTEXT)))
    address = F.rlike(text, F.lit(translate(_ADDRESS, True)))
    all_of = lambda line, p: F.regexp_extract_all(line, F.lit(translate(p)), F.lit(0))

    def helpers(line: Column) -> Column:
        trailing = F.regexp_extract(line, translate(_TRAILING_DIGITS), 1)
        phones = F.transform(F.filter(all_of(line, _PHONE), lambda m: F.rlike(m, F.lit("[.:-]"))), lambda m: F.concat(F.lit("NO HP: "), indonesian_phone(m)))
        labelled = _digits(F.regexp_extract(line, translate(_LABELLED_NPWP, True), 1))
        shaped = F.transform(F.filter(F.transform(all_of(line, _NPWP), _digits), lambda d: F.length(d) >= 15), lambda d: F.concat(F.lit("NPWP: "), npwp(d)))
        code = F.regexp_replace(repair(F.regexp_extract(line, translate(_POSTCODE), 1)), "[^0-9]", "")
        return F.concat(
            F.array(F.when(nik & (trailing != ""), F.concat(F.lit("NIK: "), trailing))),
            phones,
            F.array(F.when(F.length(labelled) >= 15, F.concat(F.lit("NPWP: "), npwp(labelled)))),
            shaped,
            F.array(F.when((F.length(code) == 5) & address & ~raw_postcode_context(text, code), F.concat(F.lit("Alamat kode pos "), code))),
        )

    lines = F.array_distinct(F.filter(F.flatten(F.transform(F.split(text, "\r?\n", -1), helpers)), lambda s: s.isNotNull()))
    return F.transform(F.array(lines), lambda found: F.when(F.size(found) == 0, text).otherwise(F.concat(text, F.lit(f"\n\n{catalog.OCR_MARKER}\n"), F.array_join(found, "\n"))))[0]
