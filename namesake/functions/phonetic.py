"""Metaphone keys as one expression over character positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWEL = "('A', 'E', 'I', 'O', 'U')"
_SOFT = "('E', 'I', 'Y')"

#: Code of one position: c the letter, p the one before, n1 to n3 those after, b3 and b4 three and four back, i the place.
#: Every rule looks at neighbours only, so positions are independent, and other SQL engines run the same text.
RULES = f"""
CASE
  WHEN s.i = 1 AND s.c IN {_VOWEL} THEN CASE WHEN s.c = 'A' AND s.n1 = 'E' THEN 'E' ELSE s.c END
  WHEN s.i = 1 AND s.c IN ('G', 'K', 'P') AND s.n1 = 'N' THEN 'N'
  WHEN s.i = 1 AND s.c = 'W' AND s.n1 = 'R' THEN 'R'
  WHEN s.i = 1 AND s.c = 'W' AND (s.n1 = 'H' OR s.n1 IN {_VOWEL}) THEN 'W'
  WHEN s.i = 1 AND s.c = 'X' THEN 'S'
  WHEN s.i = 2 AND (s.c = 'N' AND s.p IN ('G', 'K', 'P') OR s.p = 'W' AND s.c IN ('R', 'H')) THEN ''
  WHEN s.c = s.p AND s.c <> 'C' THEN ''
  WHEN s.c = 'B' THEN CASE WHEN s.p = 'M' THEN '' ELSE 'B' END
  WHEN s.c = 'C' THEN CASE
    WHEN s.n1 IN {_SOFT} THEN CASE WHEN s.n1 = 'I' AND s.n2 = 'A' THEN 'X' WHEN s.p = 'S' THEN '' ELSE 'S' END
    WHEN s.n1 = 'H' THEN CASE WHEN s.p = 'S' AND s.n2 = 'W' THEN '' WHEN s.n2 = 'R' OR s.p = 'S' THEN 'K' ELSE 'X' END
    ELSE 'K' END
  WHEN s.c = 'D' THEN CASE WHEN s.n1 = 'G' AND s.n2 IN {_SOFT} THEN 'J' ELSE 'T' END
  WHEN s.c = 'G' THEN CASE
    WHEN s.p = 'D' AND s.n1 IN {_SOFT} THEN ''
    WHEN s.n1 = 'H' THEN CASE WHEN s.b3 IN ('B', 'D', 'H') OR s.b4 = 'H' THEN '' ELSE 'F' END
    WHEN s.n1 = 'N' THEN CASE WHEN s.n2 NOT BETWEEN 'A' AND 'Z' OR s.n2 = 'E' AND s.n3 = 'D' THEN '' ELSE 'K' END
    WHEN s.n1 IN {_SOFT} AND s.p <> 'G' THEN 'J'
    ELSE 'K' END
  WHEN s.c = 'H' THEN CASE WHEN s.n1 IN {_VOWEL} AND s.p NOT IN ('C', 'G', 'P', 'S', 'T') THEN 'H' ELSE '' END
  WHEN s.c = 'K' THEN CASE WHEN s.p = 'C' THEN '' ELSE 'K' END
  WHEN s.c = 'P' THEN CASE WHEN s.n1 = 'H' THEN 'F' ELSE 'P' END
  WHEN s.c = 'Q' THEN 'K'
  WHEN s.c = 'S' THEN CASE
    WHEN s.n1 = 'I' AND s.n2 IN ('O', 'A') OR s.n1 = 'H' OR s.n1 = 'C' AND s.n2 = 'H' AND s.n3 = 'W' THEN 'X'
    ELSE 'S' END
  WHEN s.c = 'T' THEN CASE
    WHEN s.n1 = 'I' AND s.n2 IN ('O', 'A') THEN 'X'
    WHEN s.n1 = 'H' THEN '0'
    WHEN s.n1 = 'C' AND s.n2 = 'H' THEN ''
    ELSE 'T' END
  WHEN s.c = 'V' THEN 'F'
  WHEN s.c IN ('W', 'Y') THEN CASE WHEN s.n1 IN {_VOWEL} THEN s.c ELSE '' END
  WHEN s.c = 'X' THEN 'KS'
  WHEN s.c = 'Z' THEN 'S'
  WHEN s.c IN ('F', 'J', 'L', 'M', 'N', 'R') THEN s.c
  ELSE '' END"""


def _letters(x: str, struct: str, field: str) -> str:
    parts = {"i": "i"} | {k: f"substring({x}, cast(i + {v} as int), 1)" for k, v in (("c", 0), ("n1", 1), ("n2", 2), ("n3", 3))}
    parts |= {k: f"CASE WHEN i > {v} THEN substring({x}, cast(i - {v} as int), 1) ELSE '' END" for k, v in (("p", 1), ("b3", 3), ("b4", 4))}
    return struct.format(", ".join(field.format(k, v) for k, v in parts.items()))


def with_metaphone(df: DataFrame, name: str, out: str, length: int = 8) -> DataFrame:
    """``df`` with column ``out``: the Metaphone key of column ``name``, its first ``length`` codes.

    Null for null, empty where there is no letter A to Z. Leading characters that are no letters are skipped; others
    stand between letters and have no code.
    """
    upper = f"{out}_upper"
    codes = f"transform(transform(sequence(1, char_length({upper})), i -> {_letters(upper, 'named_struct({})', chr(39) + '{}' + chr(39) + ', {}')}), s -> {RULES})"
    df = df.withColumn(upper, F.regexp_replace(F.upper(F.col(name)), "^[^A-Z]+", ""))
    return df.withColumn(out, F.expr(f"CASE WHEN {upper} = '' THEN '' ELSE left(array_join({codes}, ''), {length}) END")).drop(upper)


def metaphone_duckdb(name: str, length: int = 8) -> str:
    """The same key in DuckDB's SQL, for comparisons."""
    upper = f"regexp_replace(upper({name}), '^[^A-Z]+', '')"
    codes = f"list_transform(list_transform(range(1, length({upper}) + 1), lambda i: {_letters(upper, '{{{}}}', chr(39) + '{}' + chr(39) + ': {}')}), lambda s: {RULES})"
    return f"CASE WHEN {upper} = '' THEN '' ELSE left(array_to_string({codes}, ''), {length}) END"
