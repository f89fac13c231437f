"""The same detection, resolution and scoring in plain Python, for single texts: what SQL functions call, and a check on the expressions."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from .. import catalog

_SPACE = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_TRIM = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+\\Z")


@lru_cache(maxsize=256)
def compiled(pattern: str, ignore_case: bool = False) -> re.Pattern:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append((_SPACE if in_class else f"[{_SPACE}]") if pair == "\\s" else pair)
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append("\\Z" if c == "$" and not in_class else c)
        i += 1
    return re.compile("".join(out), re.A | (re.I if ignore_case else 0))


def trim(text: str) -> str:
    return _TRIM.sub("", text)


def luhn(value: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", value)][::-1]
    return bool(digits) and sum(d if k % 2 == 0 else 2 * d // 10 + 2 * d % 10 for k, d in enumerate(digits)) % 10 == 0


def scan_text(text: str | None) -> list[dict]:
    """Findings of a text (trimmed), pattern by pattern; nothing resolved yet."""
    text = trim(text or "")
    ocr = catalog.OCR_MARKER in text
    out = []
    for order, p in enumerate(catalog.default_patterns()):
        context = compiled(catalog.CONTEXTS[p.context], True) if p.context else None
        for m in compiled(p.regex, p.ignore_case).finditer(text):
            start, end, value = m.start(), m.end(), m.group()
            if context and not context.search(text[max(0, start - catalog.CONTEXT_WINDOW) : end + catalog.CONTEXT_WINDOW]):
                row = p.type == "ID_NIK" and compiled(catalog.NIK_TABLE, True).search(text) and compiled(catalog.NIK_ROW_BEFORE).search(text[max(0, start - 60) : start]) and compiled(catalog.NIK_ROW_AFTER).search(text[end : end + 20])
                if not row:
                    continue
            if p.type == "CREDIT_CARD" and not luhn(value):
                continue
            if p.type == "BANK_ACCT" and compiled(catalog.CARD_SHAPE).search(value) and luhn(value):
                continue
            if p.type == "TAX_ID" and ocr and compiled(catalog.OCR_PHONE).search(value):
                continue
            if p.type in catalog.POSTCODES and ocr:
                line = text[text.rfind("\n", 0, start) + 1 : (text.find("\n", start) + len(text) + 1) % (len(text) + 1)]
                if compiled(catalog.OCR_PHONE_LINE).search(line):
                    continue
            out.append({"type": p.type, "value": value, "start": start, "end": end, "severity": p.severity, "order": order})
    return out


def resolved(findings: list[dict]) -> list[dict]:
    """Of two that overlap the longer stays, of equals the first (all are from expressions, with full confidence)."""
    kept: list[dict] = []
    for f in sorted(findings, key=lambda f: (f["start"], -f["end"], f["order"])):
        if kept and kept[-1]["start"] < f["end"] and f["start"] < kept[-1]["end"]:
            if f["end"] - f["start"] > kept[-1]["end"] - kept[-1]["start"]:
                kept[-1] = f
        else:
            kept.append(f)
    return kept


def score_of(findings: list[dict]) -> int:
    groups: dict[str, list[dict]] = {}
    for f in findings:
        groups.setdefault(f["type"], []).append(f)
    return min(100, math.floor(sum(catalog.WEIGHTS[g[0]["severity"]] * math.log2(1 + len(g)) for g in groups.values()) + 0.5))


def redact_text(text: str | None, mask: str = "brackets") -> str:
    out = trim(text or "")
    for f in reversed(resolved(scan_text(text))):
        r = {"asterisks": "*" * len(f["value"]), "redacted": "[REDACTED]"}.get(mask, f"[{f['type']}]")
        out = out[: f["start"]] + r + out[f["end"] :]
    return out
