"""Non-destructive text views of names and addresses, as Columns.

ASCII text is normalised by built-in expressions. Other text needs compatibility forms and full case folding, which have no
built-in expression: it goes to one Arrow UDF, which gets nulls for the ASCII rows so that they cost nothing there. Project
the views once and persist or write them before filtering on them, otherwise a filter evaluates the UDF again.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal-form suffixes of names, and street words by their abbreviation.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "sarl", "sas", "sa", "eurl")
STREETS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "ln": "lane"}


class _Kept(dict):
    """Translation table, filled as code points turn up: alphanumerics and combining marks stay, all else is a blank."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        self[point] = point if c.isalnum() or unicodedata.category(c)[0] == "M" else 32
        return self[point]


_KEPT = _Kept()


@functools.cache
def _accented() -> re.Pattern[str]:
    """A base followed by marks; the class of marks comes from the same Unicode tables as the names."""
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p))[0] == "M"]
    starts = [p for p in points if p - 1 not in (known := set(points))]
    marks = "".join(f"{re.escape(chr(s))}-{re.escape(chr(next(e for e in range(s, sys.maxunicode + 2) if e + 1 not in known)))}" for s in starts)
    return re.compile(f"([^{marks}])([{marks}]+)")


def conservative_text(text: str | None) -> str:
    """Compatibility form, case folded, & spelled out; runs of anything but alphanumerics and marks become one blank."""
    folded = unicodedata.normalize("NFKC", text or "").casefold().replace("&", " and ")
    return " ".join(folded.translate(_KEPT).split())


def accent_fold_text(text: str) -> str:
    """Marks on bases whose Unicode name is Latin are dropped; all others (Indic vowel signs) stay."""
    parted = unicodedata.normalize("NFD", text)
    bare = _accented().sub(lambda m: m[1] if "LATIN" in unicodedata.name(m[1], "") else m[0], parted)
    return unicodedata.normalize("NFC", bare)


@F.pandas_udf(StringType())
def _conservative(text: pd.Series) -> pd.Series:
    return text.map(conservative_text, na_action="ignore")


@F.pandas_udf(StringType())
def _accent_fold(text: pd.Series) -> pd.Series:
    return text.map(accent_fold_text, na_action="ignore")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def conservative(text: Column, ascii_only: bool = False) -> Column:
    """Normalised view; never null (null gives the empty string). ascii_only: all texts are known to be ASCII, so that rows
    needn't pass by a Python worker at all."""
    raw = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return plain if ascii_only else F.when(is_ascii(raw), plain).otherwise(_conservative(F.when(~is_ascii(raw), raw)))


def accent_fold(normalized: Column) -> Column:
    return F.when(is_ascii(normalized), normalized).otherwise(_accent_fold(F.when(~is_ascii(normalized), normalized)))


def _suffix_pattern() -> str:
    return rf"^(\S+(?: \S+)*?)((?: (?:{'|'.join(SUFFIXES)}))*)$"


def core(normalized: Column) -> Column:
    """A normalised name without its trailing legal forms; the first word always stays."""
    return F.regexp_extract(normalized, _suffix_pattern(), 1)


def suffix(normalized: Column) -> Column:
    return F.ltrim(F.regexp_extract(normalized, _suffix_pattern(), 2))


def standardized(normalized: Column) -> Column:
    """A normalised address with whole street abbreviations spelled out."""
    words = F.create_map(*[F.lit(x) for pair in STREETS.items() for x in pair])
    return F.array_join(F.transform(F.split(normalized, " "), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def numbers(normalized: Column) -> Column:
    """Runs of decimal digits of any script, in order, repeats included."""
    return F.regexp_extract_all(normalized, F.lit(r"\p{Nd}+"), F.lit(0))


def name_views(text: Column, normalized: Column | None = None) -> Column:
    """Struct (raw, normalized, accent_folded, core, suffix)."""
    n = conservative(text) if normalized is None else normalized
    return F.struct(text.alias("raw"), n.alias("normalized"), accent_fold(n).alias("accent_folded"), core(n).alias("core"), suffix(n).alias("suffix"))


def address_views(text: Column, normalized: Column | None = None) -> Column:
    """Struct (raw, normalized, accent_folded, standardized, numbers)."""
    n = conservative(text) if normalized is None else normalized
    return F.struct(text.alias("raw"), n.alias("normalized"), accent_fold(n).alias("accent_folded"), standardized(n).alias("standardized"), numbers(n).alias("numbers"))


def trim_spaces(text: Column) -> Column:
    """Trims every Unicode space separator, but no tab or line feed."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def is_missing(text: Column) -> Column:
    return text.isNull() | (trim_spaces(text) == "")
