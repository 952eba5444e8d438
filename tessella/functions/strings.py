"""String helpers as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequencing platforms by the name in a header.
PLATFORMS = {"SOLiD": "SOLID", "Illumina": "ILLUMINA"}


def split_any(text: Column, delimiters: str) -> Column:
    """Parts between any of the delimiter characters; empty ones are dropped."""
    return F.filter(F.split(text, f"[{re.escape(delimiters)}]"), lambda x: x != "")


def ends_with(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def in_base(number: Column, base: int) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, base))


def with_precision(number: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", number)


def platform(name: Column) -> Column:
    known = F.lit("UNKNOWN")
    for key, value in PLATFORMS.items():
        known = F.when(name == key, value).otherwise(known)
    return known


def fnv1(text: Column) -> Column:
    """The 64-bit FNV-1 hash of the UTF-8 bytes, as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h * 0x100000001B3) % 2**64 ^ b
            return h - 2**64 if h >> 63 else h

        return texts.map(one).astype("Int64")

    return run(text)
