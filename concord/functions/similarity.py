"""Pair similarity and the heuristic tags of a pair."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from . import text as T


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio; the order of the arguments matters, two empty texts give 1."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _scripts_of(text: str) -> list[str]:
    return sorted({unicodedata.name(c, "?").partition(" ")[0] for c in set(text) if c.isalpha()})


@F.pandas_udf(ArrayType(StringType()))
def scripts(text: pd.Series) -> pd.Series:
    """First words of the Unicode names of a text's letters, which tell its scripts apart."""
    return text.map(_scripts_of)


def tags(a_name: Column, a_address: Column, b_name: Column, b_address: Column) -> Column:
    """Comma-joined tags that fit a pair of normalised names and addresses (a: the clean side); other_variation if none.

    Meant for samples: two ratios a pair run in Python.
    """
    name, address = ratio(a_name, b_name), ratio(a_address, b_address)
    words = lambda x: F.array_sort(F.split(x, " "))
    left, right = scripts(a_name), scripts(b_name)
    rules = [
        ("near_exact", (name >= 0.95) & (address >= 0.95)),
        ("suffix_variation", (T.core(a_name) == T.core(b_name)) & (T.suffix(a_name) != T.suffix(b_name))),
        ("possible_typo", (name >= 0.75) & (name < 0.95)),
        ("token_reorder", (a_name != b_name) & (words(a_name) == words(b_name))),
        ("address_abbreviation", (a_address != b_address) & (T.standardized(a_address) == T.standardized(b_address))),
        ("possible_transliteration", (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)),
        ("weak_name_strong_address", (name < 0.5) & (address > 0.85)),
        ("strong_name_weak_address", (name > 0.85) & (address < 0.5)),
        ("possible_severe_corruption", (name < 0.5) & (address < 0.5)),
    ]
    found = F.concat_ws(",", *[F.when(rule, tag) for tag, rule in rules])
    return F.when(found == "", "other_variation").otherwise(found)
