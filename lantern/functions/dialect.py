"""ECMAScript patterns in Java's regular expressions.

Differences that matter: word boundaries and \\s know other characters, a flag is needed for case beyond ASCII, and $ must not
match before a final line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript, as the inside of a class.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WORD = "A-Za-z0-9_"
_UNICODE_WORD = r"\p{L}\p{M}\p{N}_"


def translate(pattern: str, ignore_case: bool = False, unicode_boundaries: bool = False) -> str:
    """The pattern for Java. A boundary next to a plain word character becomes a single look-around."""
    word = _UNICODE_WORD if unicode_boundaries else _WORD
    before, after = f"(?<![{word}])", f"(?![{word}])"
    either = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == "\\b" and not in_class:
                rest, done = pattern[i + 2 :], pattern[:i]
                if _starts_with_word(rest):
                    out.append(before)
                elif _ends_with_word(done):
                    out.append(after)
                else:
                    out.append(either)
            elif pair == "\\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class:
            c = r"\z"
        out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def _starts_with_word(rest: str) -> bool:
    """Whether whatever matches here begins with an ASCII word character, as far as can be told at a glance."""
    if rest.startswith(r"\d") or rest[:1].isalnum():
        return True
    return rest.startswith(("[STFGM]", "[A-Z]", r"(?:\d", "(?:1[0-4]|", "(?:4", "(?:[A-Z]", "(?:25["))


def _ends_with_word(done: str) -> bool:
    return done.endswith((r"\d", r"\d{2}", r"\d{3}", r"\d{4}", r"\d{5}", r"\d{6}", r"\d{8}", r"\d{9}", r"\d{10,18}", r"\d{5,12}", "[A-Z]", "[A-Za-z]{2,}", r"\d{12})", r"\d\d?)"))


_SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    """White space of ECMAScript taken off both ends; looks at the ends only."""
    return F.btrim(c, F.lit(_SPACES))


def to_utf16_offset(text: Column, index: Column) -> Column:
    """Code units before a code-point offset."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), index), "UTF-16BE")) / 2).cast("int")
