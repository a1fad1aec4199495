"""Text functions: grams of strings and of LIKE patterns, sampling by hash, epoch offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct substrings of `size` code points; none for shorter strings, null for null."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size)))
    empty = F.expr("cast(array() as array<string>)")
    return F.when(text.isNull(), F.lit(None)).when(F.length(text) < size, empty).otherwise(F.array_distinct(each))


def pattern_grams(pattern: str, size: int = GRAM, escape: str = "\\") -> list[str]:
    """Grams that every string matching a LIKE pattern must contain: of its runs of plain characters."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            run += pattern[i + 1]
            i += 1
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    runs.append(run)
    return list(dict.fromkeys(r[k : k + size] for r in runs for k in range(len(r) - size + 1)))


def like_matches(value: str, pattern: str, escape: str = "\\") -> bool:
    """LIKE on one Python string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 1
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, value, re.DOTALL) is not None


def hash_sample(key: Column, share: float, parts: int = 10_000) -> Column:
    """True for about `share` of the values of key, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(parts)) < int(round(share * parts))


def epoch_offset(ts: Column, start: str = "2010-07-19 00:00:00") -> Column:
    """Seconds since start."""
    return F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))


def stripped(text: Column) -> Column:
    """Without the white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
