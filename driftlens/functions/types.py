"""Broad families of declared SQL types: finer comparison would be a guess."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base names of each family over the dialects (fixed values).
FAMILIES = {
    "text": "char character varchar nvarchar nchar text string bpchar varchar2 nvarchar2 tinytext mediumtext longtext clob name",
    "number": "tinyint smallint mediumint int integer bigint int2 int4 int8 int16 int32 int64 byteint hugeint uint8 uint16 uint32 uint64"
    " float float4 float8 float32 float64 real double decimal numeric number bignumeric dec money",
    "date/time": "date datetime datetime2 smalldatetime time timetz timestamp timestamptz timestampntz timestampltz timestamp_ntz timestamp_ltz timestamp_tz",
    "boolean": "boolean bool",
}
_BASE = {word: name for name, words in FAMILIES.items() for word in words.split()}
_TAILS = {"varying", "precision", "unsigned", "signed", "with", "without", "local", "time", "zone"}


def type_family(declared: str | None) -> str | None:
    """The family of a declared type, or None where it has no obvious one."""
    if not declared or re.search(r"[<\[]", declared):
        return None
    text = re.sub(r"\(\s*\d+\s*(?:,\s*-?\d+\s*)?\)", " ", declared.strip().lower())
    first, *rest = text.split() or [""]
    return _BASE.get(first) if set(rest) <= _TAILS else None


def family(declared: Column) -> Column:
    """type_family as a column expression; null for unknown."""
    plain = F.trim(F.regexp_replace(F.lower(declared), r"\(\s*\d+\s*(,\s*-?\d+\s*)?\)", " "))
    first = F.element_at(F.split(plain, r"\s+"), 1)
    rest = F.slice(F.split(plain, r"\s+"), 2, 20)
    out = F.lit(None).cast("string")
    for name, words in FAMILIES.items():
        out = F.when(first.isin(*words.split()), name).otherwise(out)
    return F.when(~declared.rlike(r"[<\[]") & (F.size(F.array_except(rest, F.array(*map(F.lit, sorted(_TAILS))))) == 0), out)
